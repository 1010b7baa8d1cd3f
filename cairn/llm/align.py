"""Alignment of two tokenizers' tokens over a corpus, through a dictionary of token groups.

Vocabulary A is byte-level BPE, B is BPE over pieces that mark blanks; both cut the same bytes, a blank
and the text. Where tokens of both end at one byte, a group ends; all A tokens of a group are linked
with all its B tokens. A text is a sequence of groups, and few groups make up most of it:

1. Tasks cut their documents into chunks. A chunk interns its groups: a document becomes group numbers
   and how often it holds each. The links of a group are expanded once for the chunk, and a pair
   of ids counts once for each document whose groups link it.
2. Chunks' pair counts add up over the corpus; each A id's highest count marks its best pairs.
3. The corpus's different groups are expanded once each, joined with the pair counts and summed up: what
   one occurrence of the group is worth.
4. That goes back to the chunks by group key, and there to documents by group number.

So rows that move are a chunk's different groups and pairs, never a document's tokens, and a chunk,
a group or one A id's pairs is the most that any task holds. A worker keeps the groups of the words that
it has met, within fixed bounds, and asks the tokenizers only about new ones.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import each_text, shared_dir, table
from .tokenout import _byte_alphabet

#: words, and bytes of them, that a worker keeps between chunks at most
_WORDS, _BYTES = 150_000, 16_000_000
#: rows of a group's expansion that are sent at once
_SENT = 100_000
#: how byte-level vocabularies cut a text before merging (a fixed value of that format)
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: blanks of any kind at the start of what follows a blank 0x20, or none there at all
_BLANK_NEXT = re.compile(rb" (?:$|[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_BLANK_FIRST = re.compile(rb"$|[\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: letters, then ASCII signs
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_STEM = re.compile(rb"(" + _LETTER + rb"+)([!-/:-@\[-`{-~]+)")
#: words that can be encoded in one string with others
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+")
_LETTERS = {*map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))} - {"×", "÷"}
_SIGNS = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}


def words_of(text: bytes) -> list[bytes]:
    """A text cut before single blanks that stand between other characters; each word goes without its blank.

    No token of a byte-level vocabulary and none of a vocabulary of pieces reaches over such a cut.
    """
    found = text.split(b" ")
    if not _BLANK_NEXT.search(b" " + text):
        return found
    out, runs = [], False
    for k, w in enumerate(found):
        if k and (runs or _BLANK_FIRST.match(w)):
            out[-1] += b" " + w
        else:
            out.append(w)
        runs = not w
    return out


class _Numbers(dict):
    """Numbers new keys as they come, and lists them."""

    def __init__(self):
        self.keys_in_order = []

    def __missing__(self, key):
        self[key] = n = len(self.keys_in_order)
        self.keys_in_order.append(key)
        return n


class Aligner:
    """The groups of words under two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.paths = path_a, path_b
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in _byte_alphabet().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(back.__getitem__, token))
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        rules = [x and json.loads(x.__getstate__()) for x in (self.a.normalizer, self.a.pre_tokenizer, self.a.post_processor)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = rules == [None, _BYTE_LEVEL, None] and not any("▁" in p.lstrip("▁") for p in plain)
        self.stems = self.cuts and not any("\n" in p or any(x in _LETTERS and y in _SIGNS for x, y in zip(p, p[1:])) for p in plain)
        self.ranks = self._ranks()
        self.forget()

    def _ranks(self):
        """The merges of A as ranks, where ids rise with the merges; it cuts long strings faster."""
        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = sum(len(x) == 1 for x in self.bytes_a)
        if not self.cuts or single != 256 or any(x >= y for x, y in zip(made, made[1:])) or len(made) + single != len(self.bytes_a):
            return None
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a)}, special_tokens={})

    def full(self) -> bool:
        return len(self.words) > _WORDS or self.held > _BYTES

    def forget(self) -> None:
        self.held = 0
        self.words, self.pieces, self.groups = _Numbers(), _Numbers(), _Numbers()
        self.piece_groups: list[list[int] | None] = []
        #: by word: the groups' places in ``flat``, numbers of A and B tokens and links, and the groups as text; None where the tokens' bytes aren't the word's
        self.first, self.flat, self.text = [0], [], []

    def cut(self, text: bytes) -> list[bytes]:
        return words_of(text) if self.cuts else [text]

    def learn(self) -> None:
        """Encode the words that were numbered since the last time."""
        fresh = self.words.keys_in_order[len(self.text):]
        spelt = []
        self.held += sum(map(len, fresh))
        for w in fresh:
            m = _STEM.fullmatch(w) if self.stems else None
            spelt.append((self.pieces[b" " + m[1]], self.pieces[m[2]]) if m else (self.pieces[b" " + w],))
        self._encode(self.pieces.keys_in_order[len(self.piece_groups):])
        names = self.groups.keys_in_order
        for parts in spelt:
            found = [self.piece_groups[p] for p in parts]
            if any(f is None for f in found):
                self.text.append(None)
            else:
                found = found[0] if len(found) == 1 else found[0] + found[1]
                self.flat += found
                self.text.append(";".join(map(names.__getitem__, found)))
            self.first.append(len(self.flat))

    def _encode(self, pieces: list[bytes]) -> None:
        """Groups of pieces, each a blank and a word or a run of signs after letters."""
        if not pieces:
            return
        taken, a, b = [], [], []
        joins = [k for k, p in enumerate(pieces) if p[:1] == b" " and self.ranks is not None and _PLAIN.fullmatch(p, 1)]
        for k in range(0, len(joins), 2000):
            block = joins[k : k + 2000]
            text = b"".join([pieces[i] for i in block])
            x, y = self.ranks.encode_ordinary(text.decode()), self.b.encode(text[1:].decode(), num_threads=1)
            if b"".join(map(self.bytes_b.__getitem__, y)) == text:
                taken += block
                a.append(x)
                b.append(y)
        alone = sorted({*range(len(pieces))}.difference(taken))
        rest = [pieces[k].decode() for k in alone]
        for k, x, t in zip(alone, self.a.encode_batch_fast(rest, add_special_tokens=False), rest):
            x, y = x.ids, self.b.encode(t[1:], num_threads=1) if t[0] == " " else self.b.encode("\n" + t, num_threads=1)[2:]
            if b"".join(map(self.bytes_a.__getitem__, x)) == pieces[k] == b"".join(map(self.bytes_b.__getitem__, y)):
                taken.append(k)
                a.append(x)
                b.append(y)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
        ends = np.cumsum([len(pieces[k]) for k in taken], dtype=np.int64)
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        upto_a, upto_b = (np.searchsorted(x, common, "right").tolist() for x in (ends_a, ends_b))
        names_a, names_b = (list(map(str, x.tolist())) for x in (a, b))
        i = j = 0
        groups, flat = self.groups, []
        for p, q in zip(upto_a, upto_b):
            flat.append(groups[f"{names_a[i]}|{names_b[j]}" if p - i == 1 == q - j else f"{','.join(names_a[i:p])}|{','.join(names_b[j:q])}"])
            i, j = p, q
        upto = np.searchsorted(common, ends, "right").tolist()
        found: list[list[int] | None] = [None] * len(pieces)
        i = 0
        for k, e in zip(taken, upto):
            found[k] = flat[i:e]
            i = e
        self.piece_groups += found


def group_ids(key: str) -> tuple[list[int], list[int]]:
    """The A and B ids of a group written ``a1,a2|b1,b2``."""
    a, _, b = key.partition("|")
    return [int(x) for x in a.split(",")], [int(x) for x in b.split(",")]


def group_links(key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of ids that a group links, and how often each."""
    (x, m), (y, n) = (np.unique(ids, return_counts=True) for ids in group_ids(key))
    return np.repeat(x, len(y)), np.tile(y, len(x)), np.repeat(m, len(y)) * np.tile(n, len(x))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


DOCS, GROUPS, PAIRS = range(3)
_ROW = pa.schema([
    ("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("number", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_DDL = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, number array<int>, times array<int>, key string, a int, b int, n long"


def _rows(kind: int, chunk: int, size: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": pa.array(np.full(size, kind, np.int32)), "chunk": pa.array(np.full(size, chunk, np.int64))}
    return pa.RecordBatch.from_arrays([columns.get(f.name, None) if f.name in columns else pa.nulls(size, f.type) for f in _ROW], schema=_ROW)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, counts.cumsum()).astype(np.int32)), pa.array(values.astype(np.int32)))


def _chunk(made: Aligner, number: int, ids: list, texts: list[np.ndarray]):
    """The rows of a chunk; ``texts`` has each document's words, none for one without tokens."""
    made.learn()
    names, texts_of = made.groups.keys_in_order, made.text
    ok = np.array([t is not None for t in texts_of], bool)
    texts = [t if len(t) and ok[t].all() else t[:0] for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    word = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    first, flat = np.array(made.first, np.int64), np.array(made.flat, np.int64)
    many = (first[1:] - first[:-1])[word]
    # all groups of all documents, in order
    begin = np.repeat(first[word] - (many.cumsum() - many), many)
    group = flat[begin + np.arange(len(begin))]
    doc = np.repeat(np.repeat(np.arange(len(texts)), size), many)
    used, local = np.unique(group, return_inverse=True)
    del begin, group
    keys = [names[g] for g in used.tolist()]
    ids_of = [group_ids(k) for k in keys]
    n_a, n_b = (np.array([len(x[k]) for x in ids_of], np.int64) for k in (0, 1))
    held, times = np.unique(doc * max(1, len(keys)) + local, return_counts=True)
    of, which = held // max(1, len(keys)), held % max(1, len(keys))
    total = lambda x: np.bincount(of, x[which] * times, len(texts)).astype(np.int64)  # noqa: E731  below 2**53
    sha = ["" if not len(t) else hashlib.sha256(";".join([texts_of[w] for w in t.tolist()]).encode()).hexdigest() for t in texts]
    each = np.bincount(of, minlength=len(texts))
    yield _rows(DOCS, number, len(texts), doc_id=pa.array(ids, pa.int64()), n_a=pa.array(total(n_a)), n_b=pa.array(total(n_b)), n_groups=pa.array(total(np.ones(len(keys), np.int64))), n_links=pa.array(total(n_a * n_b)),
                groups_sha256=pa.array(sha, pa.string()), number=_lists(each, which), times=_lists(each, times))
    for k in range(0, len(keys), _SENT):
        yield _rows(GROUPS, number, len(keys[k : k + _SENT]), key=pa.array(keys[k : k + _SENT], pa.string()), n=pa.array(np.arange(k, min(len(keys), k + _SENT))))
    # a document that links a pair in several of its groups counts once
    links = [group_links(k) if x > 1 or y > 1 else (ids_of[i][0], ids_of[i][1], None) for i, (k, x, y) in enumerate(zip(keys, n_a.tolist(), n_b.tolist()))]
    code = np.fromiter(chain.from_iterable(x[0] for x in links), np.int64) << 32 | np.fromiter(chain.from_iterable(x[1] for x in links), np.int64)
    linked = np.array([len(x[0]) for x in links], np.int64)
    pair, pair_of = np.unique(code, return_inverse=True)
    start = linked.cumsum() - linked
    many = linked[which]
    at = pair_of[np.repeat(start[which] - (many.cumsum() - many), many) + np.arange(many.sum())]
    both = np.unique(np.repeat(of, many) * max(1, len(pair)) + at)
    count = np.bincount(both % max(1, len(pair)), minlength=len(pair))
    for k in range(0, len(pair), _SENT):
        part = pair[k : k + _SENT]
        yield _rows(PAIRS, number, len(part), a=pa.array((part >> 32).astype(np.int32)), b=pa.array((part & 0xFFFFFFFF).astype(np.int32)), n=pa.array(count[k : k + _SENT]))


def chunks(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = 4_000_000) -> DataFrame:
    """Encode every row of ``docs`` and write its chunks' documents, groups and pair counts to a table in the shared folder."""
    def run(batches):
        from pyspark import TaskContext

        made, number, size, ids, texts = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                words = made.cut(t) if t else []
                ids.append(i)
                texts.append(np.fromiter(map(made.words.__getitem__, words), np.int32, len(words)))
                size += len(t)
                if size > chunk_bytes:
                    yield from _chunk(made, number, ids, texts)
                    number, size, ids, texts = number + 1, 0, [], []
                    if made.full():
                        made.forget()
        if ids:
            yield from _chunk(made, number, ids, texts)
        if made.full():
            made.forget()

    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/chunks"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, _DDL).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return spark.read.schema(_DDL).parquet(path)


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, n, best: in how many documents of the corpus the ids are linked, and whether that is A id's highest count.

    One A id has at most as many pairs as B has ids, which bounds the window.
    """
    n = parts.filter(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return n.select("a", "b", "n", (F.col("n") == F.max("n").over(W.partitionBy("a"))).alias("best"))


def group_values(parts: DataFrame) -> DataFrame:
    """key, n_best, count_sum: over the links of one occurrence of each different group."""
    def expand(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            links, at, held = [], [], 0
            for k in keys:
                x = group_links(k)
                for i in range(0, len(x[0]), _SENT):
                    part = [y[i : i + _SENT] for y in x]
                    links.append(part)
                    at += [k] * len(part[0])
                    held += len(part[0])
                    if held >= _SENT:
                        yield send(at, links)
                        links, at, held = [], [], 0
            if at:
                yield send(at, links)

    def send(at, links):
        a, b, m = (np.concatenate(x) for x in zip(*links))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m.astype(np.int64))], names=["key", "a", "b", "m"])

    different = parts.filter(F.col("kind") == GROUPS).select("key").distinct()
    links = different.mapInArrow(expand, "key string, a int, b int, m long").join(pair_counts(parts), ["a", "b"])
    return links.groupBy("key").agg(F.sum(F.col("m") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Null and empty texts, and texts whose tokens' bytes aren't a blank and the text (those that hold
    U+2581, B's mark of a blank), have no tokens: zeros and ''. Every row is a document of its own,
    repeated ones too; a null doc_id stays null. Texts of any length are whole; one beyond
    ``chunk_bytes`` is a chunk by itself. Further columns are ignored; an empty table gives an empty result.
    """
    parts = chunks(docs, path_a, path_b, chunk_bytes)
    values = parts.filter(F.col("kind") == GROUPS).select("chunk", F.col("n").alias("at"), "key").join(group_values(parts), "key").select(F.col("chunk").alias("to"), "at", "n_best", "count_sum")
    own = parts.filter(F.col("kind") == DOCS).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "number", "times")

    def back(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        worth = np.zeros((2, int(found["at"].max()) + 1 if len(found) else 0), np.int64)
        for k, c in enumerate(("n_best", "count_sum")):
            worth[k, found["at"].to_numpy()] = found[c].to_numpy()
        sums = [[int((w[np.asarray(x, np.int64)] * np.asarray(t, np.int64)).sum()) for x, t in zip(rows["number"], rows["times"])] for w in worth]
        out = rows[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(n_best=sums[0], count_sum=sums[1], groups_sha256=rows["groups_sha256"])

    return own.groupBy("chunk").cogroup(values.groupBy("to")).applyInPandas(back, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_query(spark, sf_dir):
    return aligned(table(spark, sf_dir, "documents"), *default_vocabularies())
