"""Language-model scores by context-tree weighting, beside a unigram baseline.

Both score the text's words (A-Z lower-cased), single blanks between them, and its end. The model
cuts them into units, a unit being a word with the blank, or the end mark 0xFF, that follows it.

Depths 0 to ``D`` predict a unit's bytes, one bit after the other: the context of a byte is the
bytes before it in its unit, up to ``D`` of them, the latest first. At every context of every depth
a Krichevsky-Trofimov estimator counts each of the 255 binary decisions; the weighted probability
of a node is half its own estimate's and half the product of its children's, and the prediction
mixes all depths with the weights this gives after all training data.

The last depth reaches over the blank: its context is the whole unit before (the text's start for
the first). There whole units are decided, by the estimator's rule with the shallower depths'
probability p in the place of its even chance: (n + a p) / (N + a), with n of the context's N
training units equal to this one. ``STRENGTHS`` lists the values of a; they are mixed by the
probability that each gives to the context's sequence of old and new units, a^t G(a) / G(a + N)
with t different ones. A context never seen leaves p as it is.

That makes the job one of chained dictionaries, none of which any machine holds whole:

1. Each task turns its documents into chunks: lists of unit numbers, the chunk's different units and
   its different pairs of neighbours, with training counts. Units and pairs go to the part of their
   (first) word's hash; the pairs of a word that follows a sampled share of the text large enough
   to fill a task are spread over several parts by their second word.
2. A part adds up its units' and pairs' counts. The pairs' answers go into a table. Its units become
   (context, byte) codes, which go to parts by the latest three context bytes, below which the
   context tree hangs whole. The top of the tree (depths 0 to 2: 2^16 contexts of 255 decisions at
   most) is summed up from there, finished on the driver and broadcast.
3. Codes' log probabilities go back to the parts, where they add up to units', and these and the
   pairs' answers go to the chunks, where they add up to documents'.

What goes to a part is sorted and compressed, and what comes back is in the same order, without
keys. Pairs are told apart by hashes (48 bits of the first word, 40 of the second). No task sees more than its part or chunk, and
frequent words or copies cost no more than others. Prices travel in single precision.
"""
from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, fold, materialise, table

D = 7
#: bits of the second word's hash
BITS = 40
#: what the depth of the word before adds to a context's count, for the shallower depths
STRENGTHS = 8.0 ** np.arange(7)
START = np.uint64((1 << 48) - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 0.5 or more: seven steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y - np.log(shift)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def half_mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log((exp a + exp b) / 2)"""
    m = np.maximum(a, b)
    return m + np.log(0.5 * np.exp(a - m) + 0.5 * np.exp(b - m))


def unit_codes(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each unit its code (context bytes from the latest, then the byte), and the units' lengths.

    Contexts that reach before the unit's start are filled up with 0xFF, which no context holds.
    """
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    b = np.frombuffer(b"".join(units), np.uint8).astype(np.uint64)
    place = np.arange(len(b)) - np.repeat(lengths.cumsum() - lengths, lengths)
    code = np.zeros(len(b), np.uint64)
    for d in range(1, D + 1):
        past = np.full(len(b), 0xFF, np.uint64)
        inside = np.flatnonzero(place >= d)
        past[inside] = b[inside - d]
        code = (code << np.uint64(8)) | past
    return (code << np.uint64(8)) | b, lengths


def _levels(code: np.ndarray):
    """For each of the eight decisions of a byte: its node (1 to 255) and bit."""
    byte = (code & np.uint64(0xFF)).astype(np.int64)
    for k in range(8):
        yield ((1 << k) | (byte >> (8 - k))).astype(np.uint64), (byte >> (7 - k)) & 1


def subtree(code: np.ndarray, n: np.ndarray):
    """The tree below depth 3 for sorted, different codes that hold whole contexts of depth 3.

    Yields for each decision: the node and bit of each code, the mixture of depths 3 and more for
    a one there, and for each (context of depth 2, node) the key, the sum of its children's log
    probabilities and the counts.
    """
    context = code >> np.uint64(8)
    for node, bit in _levels(code):
        row_key, prev, mixed = (context << np.uint64(8)) | node, None, None
        key, row = np.unique(row_key, return_inverse=True)
        n1 = np.bincount(row, n * bit, len(key))
        n0 = np.bincount(row, n * (1 - bit), len(key))
        for d in range(D, 2, -1):
            if d < D:
                up = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))
                key, inverse = np.unique(up, return_inverse=True)
                n0, n1, below = (np.bincount(inverse, v, len(key)) for v in (n0, n1, total))
                row = inverse[row]
            own = kt(n0, n1)
            q = (n1 + 0.5) / (n0 + n1 + 1)
            if d == D:
                total, mixed = own, q[row]
            else:
                total = half_mix(own, below)
                w = 0.5 * np.exp(own - total)
                mixed = w[row] * q[row] + (1 - w[row]) * mixed
        up = ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))
        top, inverse = np.unique(up, return_inverse=True)
        yield node, bit, mixed, (top, *(np.bincount(inverse, v, len(top)) for v in (total, n0, n1)))


def top_tree(key: np.ndarray, below: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (context of depth 2, node), by key: a, b such that a + b * p mixes p with depths 0 to 2."""
    order = key.argsort(kind="stable")
    key, below, n0, n1 = key[order], below[order], n0[order], n1[order]
    a, b = np.zeros(len(key)), np.ones(len(key))
    row, at = np.arange(len(key)), key
    for _ in range(3):
        own = kt(n0, n1)
        total = half_mix(own, below)
        w, q = 0.5 * np.exp(own - total), (n1 + 0.5) / (n0 + n1 + 1)
        a, b = w[row] * q[row] + (1 - w[row]) * a, (1 - w[row]) * b
        at, inverse = np.unique(((at >> np.uint64(16)) << np.uint64(8)) | (at & np.uint64(0xFF)), return_inverse=True)
        n0, n1, below = (np.bincount(inverse, v, len(at)) for v in (n0, n1, total))
        row = inverse[row]
    return key, a, b


def word_depth(n: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts with so many training units, so many of them different: logs of g, b such that a unit seen k times has k g + b p."""
    (ns, at), (ts, of) = (np.unique(x, return_inverse=True) for x in (n, kinds))
    both, row = np.unique(at * len(ts) + of, return_inverse=True)
    big, t = ns[both // len(ts)].astype(np.float64)[:, None], ts[both % len(ts)].astype(np.float64)[:, None]
    a = STRENGTHS[None, :]
    fit = np.where(big > 0, (t - 1) * np.log(a) - log_gamma(a + np.maximum(big, 1)) + log_gamma(a + 1), 0.0)
    w = np.exp(fit - fit.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    return np.log((w / (big + a)).sum(1))[row], np.log((w * a / (big + a)).sum(1))[row]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class _Numbers(dict):
    """Numbers new keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_TYPES = [np.uint64, np.uint32, np.float32]


def _pack(*arrays) -> bytes:
    """Arrays (of whole numbers from 0, single floats, or bytes) as planes of bytes, each compressed by itself."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for x in arrays:
        x = np.asarray(x)
        if x.dtype.kind in "bui":
            x = x.astype(np.uint64 if x.dtype.itemsize == 8 else np.uint32)
            width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        else:
            width = 4
            x = x.astype(np.float32)
        planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width]
        out.append(np.array([_TYPES.index(x.dtype), width, len(x)], np.int64).tobytes())
        for k in range(width):
            packed = z.compress(np.ascontiguousarray(planes[:, k]).tobytes())
            out += [np.int64(len(packed)).tobytes(), packed]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    """What :func:`_pack` was given: whole numbers come back as uint64."""
    z, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(data):
        kind, width, n = np.frombuffer(data, np.int64, 3, at).tolist()
        at += 24
        planes = np.zeros((n, np.dtype(_TYPES[kind]).itemsize), np.uint8)
        for k in range(width):
            length = int(np.frombuffer(data, np.int64, 1, at)[0])
            planes[:, k] = np.frombuffer(z.decompress(data[at + 8 : at + 8 + length]), np.uint8)
            at += 8 + length
        out.append(planes.reshape(-1).view(_TYPES[kind]).astype(np.float32 if kind == 2 else np.uint64, copy=False))
    return out


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 16


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts rise with the hash."""
    return (((h >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _code_part(code: np.ndarray, parts: int) -> np.ndarray:
    """Codes of one context of depth 3 have one part."""
    return _part(((code >> np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), parts)


def _bounds(part: np.ndarray):
    """Stretches of equal parts: part, start, end."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)])


class _Pairs:
    """A chunk's different pairs of neighbouring units, laid out by part.

    Units are numbered by their words' hashes; ``numbers`` has the units of all texts, ``starts``
    where texts start, ``part`` the parts of the units and ``parts`` - 1 for the start of a text, whose
    number is the next one. The pairs of unit ``frequent[k]`` are spread over ``over[k]`` parts by
    their second unit's part.
    """

    def __init__(self, numbers, starts, part, parts: int, frequent, over, counted=None):
        size = len(part) - 1
        key = np.empty(len(numbers), np.int64)
        key[1:] = numbers[:-1]
        key[starts] = size
        key *= size
        key += numbers
        if counted is None:  # of each token its pair
            different, self.pair = np.unique(key, return_inverse=True)
        else:  # of each pair how many tokens count
            key <<= 1
            key |= counted
            key.sort()
            new = np.flatnonzero(np.diff(key >> 1, prepend=-1))
            different, n = key[new] >> 1, np.add.reduceat(key & 1, new)
        del key
        first, second = (different // size).astype(np.int32), (different % size).astype(np.int32)
        del different
        to = part[first]
        if len(frequent):
            spread = np.ones(size + 1, np.int64)
            spread[frequent] = over
            to = (to + part[second] % spread[first]) % parts
        self.order = np.argsort(to, kind="stable")
        self.part, self.first, self.second = (x[self.order] for x in (to, first, second))
        self.n = None if counted is None else n[self.order]
        self.new = np.flatnonzero((np.diff(self.first, prepend=-1) != 0) | (np.diff(self.part, prepend=-1) != 0))
        self.many = np.diff(self.new, append=len(self.first))

    def blobs(self, context: np.ndarray, second: np.ndarray):
        """Part and data: contexts, pairs of each, and second units, as differences, and counts; ``context`` and ``second`` have what stands for each unit."""
        for part, a, b in _bounds(self.part):
            i, j = np.searchsorted(self.new, (a, b))
            new, u = self.new[i:j] - a, second[self.second[a:b]]
            step = np.diff(u, prepend=np.uint64(0))
            step[new] = u[new]
            yield part, _pack(np.diff(context[self.first[self.new[i:j]]], prepend=np.uint64(0)), self.many[i:j], step, self.n[a:b])


_ROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
_ROW_DDL = "kind int, part int, chunk long, data binary, tokens long, kinds long"
#: kinds of rows: a chunk's documents, units and pairs on their way to a part, pairs' answers, a part's units, codes, sums of spread contexts, prices
DOCS, UNITS, PAIRS, ANSWERS, PART, CODES, SPREAD, PRICES = range(8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_ROW.names)


def frequent_words(texts: DataFrame, share: float, hot_tokens: int, parts: int, most: int = 1 << 16) -> dict[int, int]:
    """Word hashes that some ``hot_tokens`` units or more follow, by a sample of ``texts`` (one column), with the parts to spread those over.

    Only the routing of pairs hangs on this, no result. ``most`` words at most.
    """
    def count(batches):
        seen = Counter()
        for b in batches:
            for t in each_text(b.column(0)):
                words = t.lower().split()
                seen.update(words)
                seen[None] += 1
        top = seen.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([int(START) if w is None else _word_hash(w) for w, _ in top], pa.int64()), pa.array([n for _, n in top], pa.int64())], names=["h", "n"])

    found = texts.sample(share, seed=7).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= max(20.0, hot_tokens * share)).orderBy(F.desc("n"), "h").limit(most).collect()
    return {r.h: min(parts, -(-int(r.n / share) // hot_tokens) + 1) for r in found}


def scores(docs: DataFrame, folds: int = 7, held: int = 2, chunk_bytes: int = 10_000_000, part_bytes: int = 12_000_000, hot_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs``.

    bits_per_byte is the code length of the scored bytes (words, single blanks and the end) by byte.

    Learns from the rows whose fold isn't ``held``. Null texts are empty: one end token. A null
    doc_id counts as the text '' when folds are dealt. Rows that repeat are learned from and
    scored each. An empty table gives an empty result; with no rows to learn from N is 0, base
    scores are those of the formula and every bit of the model costs one bit. Further columns are
    ignored. ``chunk_bytes`` and ``part_bytes`` of text make a chunk and a part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    hot = frequent_words(rows.select("text"), min(1.0, 16_000_000 / max(1, size)), hot_tokens, parts)

    popular = np.array(sorted(hot), np.uint64)

    def cut(batches):
        seq, size, index, ids, out, texts, total = 0, 0, _Numbers(), [], [], [], []

        def close():
            lengths = np.array([len(t) for t in texts], np.int64)
            numbers = np.frombuffer(b"".join(texts), np.uint32)
            aside = np.array(out, bool)
            names = list(index)
            texts.clear()
            index.clear()
            ends = np.array([w[-1:] == b"\xff" for w in names])
            h = np.array([_word_hash(w[:-1] if e else w) for w, e in zip(names, ends.tolist())], np.uint64)
            order = np.lexsort((ends, h))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            h, ends, names = h[order], ends[order], [names[k] for k in order.tolist()]
            names = [w if e else w + b" " for w, e in zip(names, ends.tolist())]
            numbers = place[numbers]
            counted = np.repeat(~aside, lengths)
            n, every = np.bincount(numbers[counted], minlength=len(h)), np.bincount(numbers, minlength=len(h))
            by_count = np.argsort(-every, kind="stable")  # the smaller the numbers, the smaller the file
            rank = np.empty(len(h), np.int32)
            rank[by_count] = np.arange(len(h))
            known = np.array([i is not None for i in ids], bool)
            chunk = _task() << 32 | seq
            part, context = np.append(_part(h, parts), parts - 1), np.append(h, START)
            frequent = np.flatnonzero(np.isin(context, popular))
            data = _pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), known, aside, lengths, np.array(total, np.int64), np.diff(part, prepend=0), frequent, context[frequent], by_count, rank[numbers])
            yield _batch([(DOCS, (_task() * 17 + seq) % parts, chunk, data, int((~aside).sum()), 0)])
            made = [(UNITS, p, chunk, _pack(np.array(list(map(len, names[a:b])), np.int64), np.frombuffer(b"".join(names[a:b]), np.uint8), n[a:b]), 0, 0) for p, a, b in _bounds(part[:-1])]
            pairs = _Pairs(numbers, lengths.cumsum() - lengths, part, parts, frequent, [hot[x] for x in context[frequent].tolist()], counted)
            second = (h >> np.uint64(48 - BITS) << np.uint64(1)) | ends.astype(np.uint64)
            made += [(PAIRS, p, chunk, blob, 0, 0) for p, blob in pairs.blobs(context, second)]
            for a in range(0, len(made), 64):
                yield _batch(made[a : a + 64])

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each_text(b.column(2))):
                ids.append(i)
                out.append(h)
                words = t.lower().split() or [b""]
                words[-1] += b"\xff"
                texts.append(array("I", map(index.__getitem__, words)))
                total.append(sum(map(len, words)) + len(words) - 1)
                size += len(t)
                if size > chunk_bytes:
                    yield from close()
                    seq, size, index, ids, out, texts, total = seq + 1, 0, _Numbers(), [], [], [], []
        if ids:
            yield from close()

    def meet(sent: pd.DataFrame) -> pd.DataFrame:
        part, made = int(sent.part.iloc[0]), list(sent[sent.kind == DOCS].itertuples(index=False, name=None))
        units = sent[sent.kind == UNITS]
        if len(units):
            lengths, text, n = (np.concatenate(x) for x in zip(*map(_unpack, units.data)))
            offsets = np.append(0, lengths.astype(np.int64).cumsum())
            each = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(text.astype(np.uint8))]).dictionary_encode()
            at, different = each.indices.to_numpy(), each.dictionary.to_pylist()
            total = np.bincount(at, n, len(different)).astype(np.int64)
            words = pa.array([w[:-1] for w in different], pa.large_binary()).dictionary_encode()
            word_of = words.indices.to_numpy()
            counts = np.bincount(word_of, total, len(words.dictionary)).astype(np.int64)
            real = pc.binary_length(words.dictionary).to_numpy() > 0
            code, size = unit_codes(different)
            codes, inverse = np.unique(code, return_inverse=True)
            seen = np.bincount(inverse, np.repeat(total, size), len(codes)).astype(np.int64)
            known = np.where(real[word_of], counts[word_of] + 1, 0)
            many = [int(np.frombuffer(x, np.int64, 1, 16)[0]) for x in units.data]
            made.append((PART, part, 0, _pack(units.chunk.to_numpy(), many, at, known, size, np.frombuffer(b"".join(different), np.uint8)), int(counts[real].sum()), int((counts[real] > 0).sum())))
            to = _code_part(codes, parts)
            order = np.argsort(to, kind="stable")
            codes, seen = codes[order], seen[order]
            made += [(CODES, p, part, _pack(np.diff(codes[a:b], prepend=np.uint64(0)), seen[a:b]), 0, 0) for p, a, b in _bounds(to[order])]
        pairs = sent[sent.kind == PAIRS]
        if len(pairs):
            got = [_unpack(x) for x in pairs.data]
            contexts, context_of = np.unique(np.concatenate([x[0].cumsum() for x in got]), return_inverse=True)
            many, step, n = (np.concatenate([x[k] for x in got]) for k in (1, 2, 3))
            many = many.astype(np.int64)
            new = many.cumsum() - many
            u = step.cumsum()
            u -= np.repeat(u[new] - step[new], many)
            if len(contexts) >> (62 - BITS):
                u = np.unique(u, return_inverse=True)[1].astype(np.uint64)
                width = int(len(u)).bit_length()
            else:
                width = BITS + 1
            key, pair_of = np.unique((np.repeat(context_of, many).astype(np.uint64) << np.uint64(width)) | u, return_inverse=True)
            each = np.bincount(pair_of, n, len(key)).astype(np.int64)
            own = (key >> np.uint64(width)).astype(np.int64)
            n, kinds = np.bincount(own, each, len(contexts)).astype(np.int64), np.bincount(own, each > 0, len(contexts)).astype(np.int64)
            i = j = 0
            for chunk, x in zip(pairs.chunk.tolist(), got):
                c, p = context_of[i : i + len(x[0])], pair_of[j : j + len(x[2])]
                i, j = i + len(c), j + len(p)
                made.append((ANSWERS, part, chunk, _pack(each[p], n[c], kinds[c]), 0, 0))
            spread = np.isin(contexts, popular)
            if spread.any():
                made.append((SPREAD, part, 0, _pack(contexts[spread], n[spread], kinds[spread]), 0, 0))
        return _frame(made)

    second = materialise(rows.mapInArrow(cut, _ROW_DDL).repartition(parts, "part").groupBy("part").applyInPandas(meet, _ROW_DDL), "parts")
    of = lambda *kinds: second.filter(F.col("kind").isin(*kinds))
    tokens, kinds, n_train = second.agg(*[F.sum(F.when(F.col("kind") == k, F.col(c))) for k, c in ((PART, "tokens"), (PART, "kinds"), (DOCS, "tokens"))]).first()
    n_train = n_train or 0
    n_all, v = (tokens or 0) + n_train, (kinds or 0) + (n_train > 0)
    sums: dict[int, list[int]] = {}
    for r in of(SPREAD).select("data").collect() if hot else []:  # a row a part, an entry for each part that a frequent word is spread over
        for h, n, t in zip(*(x.tolist() for x in _unpack(r.data))):
            had = sums.setdefault(h, [0, 0])
            had[0], had[1] = had[0] + n, had[1] + t
    spread_sums = spark.sparkContext.broadcast((np.array(sorted(sums), np.uint64), np.array([sums[h] for h in sorted(sums)], np.int64).reshape(-1, 2)))
    codes = of(CODES).select("part", "chunk", "data").repartition(parts, "part").persist(StorageLevel.DISK_ONLY)

    def gather(batches):
        keys, got = [], []
        for b in batches:
            keys += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            got += [_unpack(x) for x in b.column(2).to_pylist()]
        if not got:
            return None
        different, inverse = np.unique(np.concatenate([x[0].cumsum() for x in got]), return_inverse=True)
        return keys, [len(x[0]) for x in got], different, inverse, np.bincount(inverse, np.concatenate([x[1] for x in got]), len(different))

    def tops(batches):
        if (got := gather(batches)) is not None:
            for _, _, _, (key, below, n0, n1) in subtree(got[2], got[4]):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(below), pa.array(n0), pa.array(n1)], names=["key", "below", "n0", "n1"])

    top = codes.mapInArrow(tops, "key long, below double, n0 double, n1 double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("below", "n0", "n1")]).toPandas()
    shared = spark.sparkContext.broadcast(top_tree(top.key.to_numpy(np.int64).view(np.uint64), *(top[c].to_numpy(np.float64) for c in ("below", "n0", "n1"))))

    def priced(batches):
        if (got := gather(batches)) is not None:
            keys, sizes, code, inverse, n = got
            key, a, b = shared.value
            cost = np.zeros(len(code))
            two = (code >> np.uint64(48)) << np.uint64(8)
            for node, bit, mixed, _ in subtree(code, n):
                at = np.searchsorted(key, two | node)
                p = a[at] + b[at] * mixed
                cost += np.log(np.where(bit == 1, p, 1 - p))
            cost, at = cost[inverse].astype(np.float32), 0
            for (part, sender), size in zip(keys, sizes):
                yield _batch([(PRICES, sender, part, _pack(cost[at : at + size]), 0, 0)])
                at += size

    def units_back(sent: pd.DataFrame) -> pd.DataFrame:
        part = int(sent.part.iloc[0])
        chunk, many, at, known, size, text = (x.astype(np.int64) for x in _unpack(sent[sent.kind == PART].data.iloc[0]))
        ends = size.cumsum()
        text = text.astype(np.uint8)
        code, _ = unit_codes([text[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())])
        codes, inverse = np.unique(code, return_inverse=True)
        cost = np.empty(len(codes))
        cost[np.argsort(_code_part(codes, parts), kind="stable")] = np.concatenate([_unpack(x)[0] for x in sent[sent.kind == PRICES].sort_values("chunk").data])
        total = np.add.reduceat(cost[inverse], ends - size)
        made, a = [], 0
        for c, m in zip(chunk.tolist(), many.tolist()):
            made.append((PRICES, part, c, _pack(known[at[a : a + m]], total[at[a : a + m]].astype(np.float32)), 0, 0))
            a += m
        return _frame(made)

    units = of(PART).unionByName(codes.mapInArrow(priced, _ROW_DDL)).repartition(parts, "part").groupBy("part").applyInPandas(units_back, _ROW_DDL)
    scale = float(np.log(10))
    floor = float(np.log10(n_all + v + 1))

    def docs_back(sent: pd.DataFrame) -> pd.DataFrame:
        ids, known, aside, lengths, n_bytes, step, frequent, hashes, by_count, numbers = _unpack(sent[sent.kind == DOCS].data.iloc[0])
        known, aside, frequent = known > 0, aside > 0, frequent.astype(np.int64)
        lengths, numbers = lengths.astype(np.int64), by_count.astype(np.int32)[numbers.astype(np.int32)]
        back = lambda kind: [np.concatenate(x) for x in zip(*map(_unpack, sent[sent.kind == kind].sort_values("part").data))]
        c, cost = back(PRICES)
        c = c.astype(np.int64) - 1
        base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1) - floor, 0.0)
        starts = lengths.cumsum() - lengths
        total = lambda x: np.add.reduceat(x, starts)
        pairs = _Pairs(numbers, starts, step.cumsum().astype(np.int64), parts, frequent, [hot[x] for x in hashes.tolist()])
        seen, n, kinds = (x.astype(np.int64) for x in back(ANSWERS))
        if len(frequent):  # their counts come from several parts
            names, whole = spread_sums.value
            at = np.full(len(step), -1)
            at[frequent] = np.searchsorted(names, hashes)
            at = at[pairs.first[pairs.new]]
            n, kinds = (np.where(at >= 0, whole[at, k], x) for k, x in enumerate((n, kinds)))
        g, b = (np.repeat(x, pairs.many) for x in word_depth(n, kinds))
        price = b + cost.astype(np.float64)[pairs.second]
        old = seen > 0
        price[old] = np.logaddexp(np.log(seen[old]) + g[old], price[old])
        by_pair = np.empty(len(price))
        by_pair[pairs.order] = price
        score = total(by_pair[pairs.pair]) / scale
        ids = ids.view(np.int64)
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64") if known.all() else pd.array([int(i) if k else None for i, k in zip(ids, known)], "Int64"),
            "held_out": aside, "n_tokens": total((c >= 0).astype(np.int64)[numbers]) + 1, "n_known": total((c > 0).astype(np.int64)[numbers]) + (n_train > 0),
            "train_tokens": n_all, "base_score": total(base[numbers]) + np.log10(n_train + 1) - floor, "score": score, "bits_per_byte": -score * np.log2(10) / n_bytes.astype(np.float64)})

    return of(DOCS, ANSWERS).unionByName(units).repartition(parts, "chunk").groupBy("chunk").applyInPandas(
        docs_back, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op6_query(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))
