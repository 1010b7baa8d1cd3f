"""Token ids in binary shards, compressed by document with one shared zstandard dictionary.

A store is a folder of two Parquet tables, so that any store Spark can write to will do:

``dictionary``  one row: hash (sha256 of the dictionary), data, width (bytes an id), end_id.
``shards``      part, seq, before (ids of the part's earlier shards), dict_hash, n_tokens, least,
                most (of doc_id), doc_ids, counts (ids by document), offsets (of the documents' frames in payload, one more at the end),
                payload (one zstandard frame for each document, ids little-endian).

Shards follow each other by (part, seq), documents within them in order, so the rank of an id
in the corpus is known from the counts alone, and one short document is read by its offsets
without touching the rest of its shard.

With a vocabulary whose rules are ``_PIECEWISE`` texts are cut at the blanks 0x20 and 0x09-0x0D,
which none of its tokens crosses. About a MB of texts at a time is cut and their pieces numbered by Arrow; each
worker keeps the ids of pieces it has met, some ``_CACHE`` of them, and asks the tokenizer about new
ones only, thousands of words at a time. With any other vocabulary the tokenizer gets whole texts.
"""
from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, each_text, materialise, shared_dir, text_buffer

_CACHE = 200_000
#: bytes of text whose pieces are numbered at once, and new words that are asked for at once
_SPAN, _ASK = 1_000_000, 5_000
#: characters whose kind is told from their bytes
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_GAP = re.compile(rb"[ \t-\r]")
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: the kind of each byte; 0xC3 begins the letters from U+00C0 to U+00FF, other characters beyond ASCII begin with a byte of kind _OTHER
_KIND = np.array([_BLANK if b in b" \t\n\v\f\r" else _LETTER if bytes([b]).isalpha() or 0x80 <= b < 0xC0 or b == 0xC3 else _DIGIT if bytes([b]).isdigit() else _SIGN if 32 < b < 127 else _OTHER for b in range(256)], np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: bytes of frames after which a shard is closed
SHARD_BYTES = 4_000_000


#: the rules under which a text's ids are those of its pieces: blanks only part words, lower-casing goes by character, bytes stand for themselves
_PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes texts piece by piece; the ids are those of the whole text's encoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.alphabet = _byte_alphabet()
        self.table = "".join(" " if b == 32 else self.alphabet[b] for b in range(256))
        self.seen: dict[str, bytes] = {}
        self.piecewise = self._cut_at_blanks()
        #: by id: whether it ends a word; None where that can't be told
        self.last = self._word_ends()
        #: the model without the rules, for words already cut, in lower case and spelt in the byte alphabet
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()

    def _cut_at_blanks(self) -> bool:
        t = self.tokenizer
        rules = {"normalizer": t.normalizer, "pre_tokenizer": t.pre_tokenizer, "post_processor": t.post_processor}
        same = all(_PIECEWISE[k] == (None if v is None else json.loads(v.__getstate__())) for k, v in rules.items())
        return same and all(x.content.startswith("<|") and not re.search(r"\s", x.content) and not x.lstrip and not x.rstrip for x in t.get_added_tokens_decoder().values())

    def _word_ends(self) -> np.ndarray | None:
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ids = self.tokenizer.get_vocab()
        if not self.piecewise or not suffix or any(c + suffix not in ids for c in self.alphabet.values()):
            return None
        last = np.zeros(max(ids.values()) + 1, bool)
        last[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        return last

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words that the rules leave whole, asked for at once."""
        text = " ".join(words)
        if not text.isascii():
            text = codecs.charmap_decode(text.encode(), "strict", self.table)[0]
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words):  # a text that spells the suffix itself
            return [self._whole(w) for w in words]
        ends, data = ends.tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> None:
        words = []
        for p in pieces:
            if self.last is None or "<|" in p or not _PLAIN.fullmatch(p):
                self.seen[p] = self._whole(p)
            else:
                words.append(p)
        for a in range(0, len(words), _ASK):
            some = words[a : a + _ASK]
            self.seen.update(zip(some, self._words(some)))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        seen = self.seen
        new = [p for p in pieces if p not in seen]
        if len(seen) + len(new) > _CACHE:  # those met again are the frequent ones
            seen = self.seen = {p: seen[p] for p in pieces if p in seen}
        self._learn(new)
        return [seen[p] for p in pieces]

    def encode_all(self, texts: pa.Array):
        """Yield each row's ids as little-endian unsigned 32-bit integers; null rows are empty."""
        if not self.piecewise:
            yield from (self._whole(t.decode()) for t in each_text(texts))
            return
        for some in _spans(texts, _SPAN):
            some = some.fill_null("")
            if len(some) == 1:  # perhaps a long one
                yield b"".join(ids for part in _parts(next(each_text(some)), _SPAN) for ids in self._encode(pa.array([part], pa.binary()).cast(some.type)))
            else:
                yield from self._encode(some)

    def _encode(self, texts: pa.Array):
        words, rows = _cut(texts)
        words = words.dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        data, ends, _ = text_buffer(ids)
        ends = ends[rows].tolist()
        for a, b in zip(ends, ends[1:]):
            yield bytes(data[a:b])

    def encode(self, text: bytes) -> bytes:
        """The ids of one text."""
        return next(self.encode_all(pa.array([text], pa.binary()).cast(pa.string())))


def _spans(texts: pa.Array, size: int):
    """A column in slices of about so many bytes, one row at least."""
    offsets, a = text_buffer(texts)[1], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield texts.slice(a, b - a)
        a = b


def _parts(text: bytes, size: int):
    """A text cut at blanks into parts of about so many bytes."""
    a = 0
    while a < len(text):
        gap = _GAP.search(text, a + size)
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in lower case, and where each row's begin, with the end.

    A word is what the rules leave whole, but a piece with any character beyond ``_PLAIN``, or with
    the beginning of a special token, stays as it is.
    """
    data, offsets, _ = text_buffer(texts)
    data, rows = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]
    # one more place, so that what follows a byte can be asked for; no byte there is part of a word
    kind, after = np.append(_KIND[data], np.uint8(_BLANK)), np.append(data[1:], [np.uint8(32)] * (len(data) > 0))
    first = np.zeros(len(kind), bool)
    first[rows] = True
    lead = data == 0xC3
    kind[:-1][lead & ((after == 0x97) | (after == 0xB7))] = _OTHER  # signs amid the letters
    kind[:-1][(data == ord("<")) & (after == ord("|")) & ~first[1:]] = _OTHER
    shown = kind != _BLANK
    begins = first | (kind == _DIGIT)
    begins[1:] |= kind[1:] != kind[:-1]
    same = np.ones(len(data), bool)
    if (kind == _OTHER).any():
        piece = first.copy()
        piece[1:] |= shown[1:] != shown[:-1]
        number = np.cumsum(piece)
        odd = np.zeros(number[-1] + 1, bool)
        odd[number[kind == _OTHER]] = True
        odd = odd[number]
        begins = np.where(odd, piece, begins)
        same = ~odd[:-1]
    data[same] = _LOWER[data[same]]
    upper = np.flatnonzero(lead & same & (after >= 0x80) & (after <= 0x9E)) + 1
    data[upper] += 0x20
    # short forms: an apostrophe that begins a word takes one or two letters with it
    mark = np.flatnonzero((data == ord("'")) & begins[:-1] & same & ~first[1:] & (kind[1:] == _LETTER))
    one, two = data[mark + 1], np.where(first[mark + 2], 0, np.append(data, np.uint8(0))[mark + 2])
    one, two = np.isin(one, list(b"stmd")), np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[mark[one | two] + 1] = False
    begins[np.append(mark[one] + 2, mark[two] + 3)] = True
    begins, shown = begins[:-1], shown[:-1]
    at = np.append(np.flatnonzero(begins[shown]), shown.sum())
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[shown]))
    return words, np.searchsorted(np.flatnonzero(begins & shown), rows)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, max_docs: int = 1000, max_chars: int = 50_000, size: int = 65_536) -> bytes:
    """A dictionary from the ids of at most ``max_docs`` documents of up to ``max_chars`` characters,
    those with the lowest id hash; empty if their ids take less than 20 KB, too little to train one."""
    import zstandard

    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, max_chars))
    chosen = able.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_narrow(ids + end, width) for ids in enc.encode_all(b.column(0))], pa.binary())], names=["ids"])

    # of documents that share an id the one with the smallest text
    texts = able.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    samples = sorted(bytes(r.ids) for r in texts.select("text").mapInArrow(run, "ids binary").collect())
    if sum(map(len, samples)) < 20 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1, order: tuple[str, ...] = ("doc_id",), level: int = 3) -> None:
    """Encode every whole text of ``docs`` and write a store into ``folder``.

    Documents are stored by ``order`` (columns of ``docs``), nulls first, rows that tie in the
    order they are read. Null texts are empty: their only id is ``end_id``. Repeated rows are
    stored as often; an empty table gives a store without shards; further columns are ignored.
    """
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 65_536 else 4
    data = train_dictionary(docs, path, end_id, width)
    digest = hashlib.sha256(data).hexdigest()
    end = np.array([end_id], "<u4").tobytes()
    # as an Arrow table, which needs no workers
    row = pa.table([pa.array([digest]), pa.array([data], pa.binary()), pa.array([width], pa.int32()), pa.array([end_id], pa.int32())], names=["hash", "data", "width", "end_id"])
    spark.createDataFrame(row, "hash string, data binary, width int, end_id int").coalesce(1).write.parquet(f"{folder}/dictionary")

    def compress(batches):
        enc = encoder(path)
        made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for b in batches:
            n, frames = [], []
            for ids in enc.encode_all(b.column(1)):
                n.append(len(ids) // 4 + 1)
                frames.append(made.compress(_narrow(ids + end, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(frames, pa.binary()), *b.columns[2:]], names=["doc_id", "n", "frame", *names])

    names = [f"o{i}" for i in range(len(order))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[docs[c].alias(x) for c, x in zip(order, names)])
    kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in names)
    frames = materialise(rows.mapInArrow(compress, f"doc_id long, n int, frame binary, {kinds}").withColumn("tie", F.monotonically_increasing_id()), "frames")

    def pack(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, offsets, payload = [], [], [0], []

        def shard():
            known = [i for i in ids if i is not None]
            cells = [part, seq, before, digest, sum(counts), min(known, default=None), max(known, default=None), ids, counts, offsets, b"".join(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, _SHARD)], schema=_SHARD)

        for b in batches:
            for i, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if ids and offsets[-1] + len(frame) > SHARD_BYTES:
                    yield shard()
                    seq, before = seq + 1, before + sum(counts)
                    ids, counts, offsets, payload = [], [], [0], []
                ids.append(i)
                counts.append(n)
                offsets.append(offsets[-1] + len(frame))
                payload.append(frame)
        if ids:
            yield shard()

    keys = [F.col(x).asc_nulls_first() for x in names] + [F.col("tie")]
    parts = max(1, frames.rdd.getNumPartitions())
    laid = frames.repartitionByRange(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    laid.select("doc_id", "n", "frame").mapInArrow(pack, _SHARD_DDL).write.parquet(f"{folder}/shards")
    discard(frames)


_SHARD_DDL = "part int, seq int, before long, dict_hash string, n_tokens long, least long, most long, doc_ids array<long>, counts array<int>, offsets array<long>, payload binary"
_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("dict_hash", pa.string()), ("n_tokens", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def _reader(spark: SparkSession, folder: str):
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.data)
    if hashlib.sha256(data).hexdigest() != row.hash:
        raise ValueError("the dictionary doesn't match its hash")
    return data, row.hash, row.width


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids for every document of a store, or for the given ids only.

    Asked for ids, the reader passes over shards whose range of ids holds none of them and
    decompresses only the frames wanted.
    """
    return _decoded(spark, folder, doc_ids, "ids array<long>", lambda ids: (ids.astype(np.int64),))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document of a store, from the ids read back."""
    return _decoded(spark, folder, None, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes())))


def _decoded(spark, folder, doc_ids, columns, digest):
    import zstandard

    data, expected, width = _reader(spark, folder)
    shards = spark.read.schema(_SHARD_DDL).parquet(f"{folder}/shards")
    # a part is what one task wrote: there are no more of them than partitions, whatever the shards
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards
    if doc_ids is not None:
        rows = rows.filter(F.exists(F.array(*[F.lit(i).cast("long") for i in doc_ids]), lambda i: i.between(F.col("least"), F.col("most"))))
    rows = rows.join(F.broadcast(base), F.col("part") == F.col("p")).select((F.col("base") + F.col("before")).alias("start"), "dict_hash", "doc_ids", "counts", "offsets", "payload")
    wanted = None if doc_ids is None else set(doc_ids)
    names = ["doc_id", "start", *[c.split()[0] for c in columns.split(", ")]]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64()) if "array" in c else pa.int64() for c in columns.split(", ")]]

    def run(batches):
        made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
        for b in batches:
            for k in range(b.num_rows):
                start, found, ids, counts, offsets = (b.column(c)[k].as_py() for c in range(5))
                if found != expected:
                    raise ValueError("a shard was written with another dictionary")
                payload = memoryview(b.column(5)[k].as_buffer())
                out = [[] for _ in names]
                for i, n, lo, hi in zip(ids, counts, offsets, offsets[1:]):
                    if wanted is None or i in wanted:
                        for column, v in zip(out, (i, start, *digest(_wide(made.decompress(payload[lo:hi]), width)))):
                            column.append(v)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, "doc_id long, start long, " + columns)


def op8_query(spark, sf_dir):
    folder = f"{shared_dir(spark)}/tokens"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return token_digests(spark, folder)
