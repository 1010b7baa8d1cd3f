"""Benchmark decontamination by spaced seeds.

Two fixed masks select 5 of 6 and 5 of 9 consecutive tokens and ignore the places between; together
they hit every stretch of 15 tokens in which at most 3 are substituted. A third one (5 of 8) is
for items of 8 to 14 tokens: the three hit every such item with as many substitutions as the
threshold allows its length. The seed hashes of the
benchmark are joined with those of the documents; around each hit the item is laid over the
document and the aligned tokens are compared. An item leaks into a document if some 15 aligned
tokens (all of a shorter item) agree in 80 % or more.

Hits become alignments in portions of ``_PORTION``. A document with more of them, through words
that repeat, is taken item by item: its places by hash stay as they are, and each item's alignments
are marked in a row of bits. So memory doesn't grow with the product of repetitions.

The benchmark goes to the workers in blocks of about ``block_bytes`` of text, by item hash, each a
table of bounded size; a benchmark of several blocks takes as many passes over the documents. Only
words that occur in the block can be part of a seed, so other words need no hashing.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, passing, table

MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 7, 8))
#: for items shorter than the window
SHORT_MASK = (0, 1, 3, 6, 7)
WINDOW, AGREE = 15, 0.8
#: items of fewer tokens than this must occur whole and unchanged
SHORT = 8
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BITMAP = 22
_SLICE, _PORTION = 1_000_000, 1_000_000


def _seeds(x: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which all selected tokens are known (not negative), and the hashes of the selections."""
    n = len(x) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    able = x[:n] >= 0
    for o in mask[1:]:
        able = able & (x[o : o + n] >= 0)
    at = np.flatnonzero(able)
    h = np.full(len(at), salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, o in enumerate(mask):
            h = (h ^ (x[at + o].astype(np.uint64) + np.uint64(1))) * _K[j % 5]
            h ^= h >> np.uint64(29)
    return at, h


@dataclass
class Index:
    """The seeds of one block of benchmark items."""

    words: dict[bytes, int] = field(default_factory=dict)
    tokens: np.ndarray = None
    first: np.ndarray = None
    ids: list = None
    masks: tuple = MASKS
    hashes: np.ndarray = None
    places: np.ndarray = None
    bitmap: np.ndarray = None

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]]) -> Index:
        own, cut = cls(ids=[]), []
        for item, text in items:
            if words := (text or "").encode().lower().split():
                own.ids.append(item)
                cut.append(np.array([own.words.setdefault(w, len(own.words)) for w in words], np.int64))
        own.first = np.cumsum([0, *map(len, cut)])
        own.tokens = np.concatenate(cut) if cut else np.zeros(0, np.int64)
        lengths = {len(c) for c in cut if len(c) < SHORT}
        third = [SHORT_MASK] if any(SHORT <= len(c) < WINDOW for c in cut) else []
        own.masks = (*MASKS, *third, *[tuple(range(n)) for n in sorted(lengths)])
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c, first in zip(cut, own.first):
            for k, mask in enumerate(own.masks):
                whole = k >= len(MASKS) + len(third)
                if len(mask) == len(c) if whole or len(c) < SHORT else k < len(MASKS) or len(c) < WINDOW:
                    at, h = _seeds(c, mask, k)
                    hashes.append(h)
                    places.append(at + first)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        own.hashes, own.places = h[order], p[order]
        own.bitmap = np.zeros(2**_BITMAP, bool)
        own.bitmap[h >> np.uint64(64 - _BITMAP)] = True
        return own

    def find(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text its hits: (item_id, matched, window_matched, window, doc_start), one for each item, best alignment first."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not len(self.hashes):
            return out
        get, pad = self.words.get, [-1] * (max(m[-1] for m in self.masks) + 1)
        run: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        first = 0
        for i, t in enumerate(texts):
            starts.append(len(run))
            run += [get(w, -1) for w in t.lower().split()]
            ends.append(len(run))
            run += pad
            if len(run) > _SLICE or i == len(texts) - 1:
                self._slice(np.array(run, np.int64), np.array(starts), np.array(ends), out, first)
                run, starts, ends, first = [], [], [], i + 1
        return out

    def _slice(self, x, starts, ends, out, first):
        found = []
        for k, mask in enumerate(self.masks):
            at, h = _seeds(x, mask, k)
            some = self.bitmap[h >> np.uint64(64 - _BITMAP)]
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            hit = hi > lo
            found.append(np.stack([at[hit], lo[hit], (hi - lo)[hit]]))
        at, lo, n = np.concatenate(found, 1)
        order = at.argsort(kind="stable")
        at, lo, n = at[order], lo[order], n[order]
        doc = np.searchsorted(starts, at, "right") - 1
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))  # the hits of a document follow each other
        many = np.add.reduceat(n, firsts) if len(firsts) else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple] = {}
        k = 0
        lasts = [*firsts[1:].tolist(), len(at)]
        while k < len(firsts):
            if many[k] > _PORTION:
                self._repeated(x, int(doc[firsts[k]]), at[firsts[k] : lasts[k]], lo[firsts[k] : lasts[k]], n[firsts[k] : lasts[k]], starts, ends, best)
                k += 1
                continue
            end, size = k, 0
            while end < len(firsts) and size + many[end] <= _PORTION:
                size += int(many[end])
                end += 1
            own = slice(firsts[k], lasts[end - 1])
            at_, lo_, n_ = at[own], lo[own], n[own]
            place = self.places[np.repeat(lo_ - (n_.cumsum() - n_), n_) + np.arange(size)]
            item = np.searchsorted(self.first, place, "right") - 1
            base = np.repeat(at_, n_) - (place - self.first[item])
            laid = np.unique(np.stack([np.repeat(doc[own], n_), item, base]), axis=1)
            cuts = np.flatnonzero((np.diff(laid[0], prepend=-1) != 0) | (np.diff(laid[1], prepend=-1) != 0))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), laid.shape[1]]):
                self._verify(x, int(laid[0, a]), int(laid[1, a]), laid[2, a:z], starts, ends, best)
            k = end
        for (d, i), v in sorted(best.items()):
            out[first + d].append((self.ids[i], *v))

    def _repeated(self, x, d, at, lo, n, starts, ends, best):
        """One document in which seeds repeat often: its alignments, item by item."""
        seeds, group = np.unique(lo, return_inverse=True)
        by_seed = group.argsort(kind="stable")
        cuts = np.searchsorted(group[by_seed], np.arange(len(seeds) + 1))
        count = n[by_seed[cuts[:-1]]]
        place = self.places[np.repeat(seeds - (count.cumsum() - count), count) + np.arange(int(count.sum()))]
        seed = np.repeat(np.arange(len(seeds)), count)
        item = np.searchsorted(self.first, place, "right") - 1
        order = item.argsort(kind="stable")
        item, place, seed = item[order], place[order], seed[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(item)]):
            i = int(item[a])
            size, low = int(self.first[i + 1] - self.first[i]), int(starts[d])
            able = np.zeros(int(ends[d]) - low + size + 1, bool)  # by base, from low - size
            for q, g in zip((place[a:z] - self.first[i]).tolist(), seed[a:z].tolist()):
                able[at[by_seed[cuts[g] : cuts[g + 1]]] - q - low + size] = True
            self._verify(x, d, i, np.flatnonzero(able) + low - size, starts, ends, best)

    def _verify(self, x, d, i, bases, starts, ends, best):
        """Keeps the best of the alignments of item i that begin at these places, in rising order, if any holds."""
        own = self.tokens[self.first[i] : self.first[i + 1]]
        n, start, end = len(own), int(starts[d]), int(ends[d])
        w = min(WINDOW, n)
        need = w if n < SHORT else AGREE * w
        bases = bases[(bases + n >= start + w) & (bases <= end - w)]
        step = max(1, _PORTION // n)
        for a in range(0, len(bases), step):
            b = bases[a : a + step]
            at = b[:, None] + np.arange(n)[None, :]
            inside = (at >= start) & (at < end)
            eq = (x[np.clip(at, 0, len(x) - 1)] == own[None, :]) & inside
            sums = np.concatenate([np.zeros((len(b), 1), np.int32), eq.cumsum(1, dtype=np.int32)], 1)
            agree = sums[:, w:] - sums[:, :-w]
            agree = np.where(inside[:, : n - w + 1] & inside[:, w - 1 :], agree, -1)
            top = agree.argmax(1)
            score = agree[np.arange(len(b)), top]
            for r in np.flatnonzero(score >= need).tolist():
                new = (int(sums[r, -1]), int(score[r]), w, int(b[r]) + int(top[r]) - start)
                if (d, i) not in best or new[:2] > best[d, i][:2]:
                    best[d, i] = new
                    if new[0] == n:  # no later one is better
                        return


_HIT = pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("window_matched", pa.int32()), ("window", pa.int32()), ("doc_start", pa.int32())])
_HIT_DDL = "struct<item_id:bigint,matched:int,window_matched:int,window:int,doc_start:int>"


def blocks(benchmark: DataFrame, block_bytes: int = 32_000_000):
    """Indexes of the benchmark's items, one block after the other."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k)
        yield Index.build(sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def _scan(rows: DataFrame, index: Index) -> DataFrame:
    """Adds ``hits`` to (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            found = shared.value.find(list(each_text(b.column(1))))
            hits = pa.array([[dict(zip(("item_id", "matched", "window_matched", "window", "doc_start"), h)) for h in x] for x in found], pa.list_(_HIT))
            yield pa.RecordBatch.from_arrays([b.column(0), hits], names=["row", "hits"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, hits array<{_HIT_DDL}>")


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, item_id, matched, window_matched, window, doc_start: one row for each item found in a document.

    matched counts the agreeing tokens of the best alignment, window_matched those of its best
    window, doc_start is the token of the document where that window begins. Null or blank texts
    of either table leak nothing; items of fewer than eight tokens must occur whole and unchanged;
    items with the same text are found each under its own id, rows that repeat an item count once;
    a null item_id or doc_id stays null; documents that repeat come out repeated. Empty tables give an empty result; further
    columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("row"), docs["text"].cast("string").alias("text"))
    out = None
    for index in blocks(benchmark, block_bytes):
        part = _scan(rows, index).select(F.col("row").alias("doc_id"), F.explode("hits").alias("hit")).select("doc_id", "hit.*")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 32_000_000) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with their columns; null and blank texts stay, repeated rows each; see :func:`leaks`."""
    for index in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = passing(docs, lambda texts, shared=shared: pa.array([not hits for hits in shared.value.find(list(each_text(texts)))], pa.bool_()))
    return docs


def op7_query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
