"""Benchmark items in documents: SimHash of item-sized windows, then exact similarity.

Items are cut into word 5-grams; a gram weighs as many bytes as its words have, so what
it weighs depends on nothing else. Every place of a document that holds a gram of an item
proposes the item-sized window that aligns the two (clipped at the edges of the document);
so do places up to `SLIDE` words away, and those between two such windows that start close
to each other.
Windows get a 128-bit SimHash. The multi-index splits fingerprints into blocks of
`BLOCK_BITS` bits: of two within the radius, at least one block differs in `PROBE` bits or
fewer, so lookups of each block among the items' block values and all their neighbours to
that distance find every pair within the radius, and few others. Candidates are then
verified by the weighted Jaccard similarity of their grams, at least 0.8.

Items travel to the tasks in blocks of at most `ITEM_BYTES` bytes of text, so what is
broadcast has a fixed bound; a larger benchmark takes more passes over the documents.
Results do not depend on the blocks.

Defined results: words are separated by the ASCII white space of `common.SPACE` alone;
case of A-Z does not matter; an item of fewer than five words has all its words as its one
gram; null or empty texts and items match nothing; repeated rows and ties are judged
alike, each row on its own; a null id stays null; further columns are ignored; an empty
table gives an empty result; an item longer than a block is a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

GRAM = 5
LEAST = 0.8
BITS, BLOCK_BITS, PROBE = 128, 16, 3
BLOCKS = BITS // BLOCK_BITS
#: Were every block off by more than PROBE bits, the distance would be larger than this.
RADIUS = BLOCKS * (PROBE + 1) - 1
ITEM_BYTES = 2 << 20
#: A window may start so many words from one that is aligned with an item.
SLIDE = 2
#: The most words between two windows for those in between to be tried.
GAP = 16
#: Items in a part of the index.
PART = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_hashes(raw: np.ndarray, off: np.ndarray, n: int):
    """(hash of the n words at each word, their bytes, offsets of rows in words); a gram
    counts only where it ends in its row."""
    low = _LOWER[raw]
    start, end, woff = C.word_bounds(low, off)
    words = C.word_hashes(low, start, end)
    size = np.concatenate(([0], np.cumsum(end - start)))
    return C.Rolling(words).grams(n) + np.uint64(n), (size[n:] - size[:-n]).astype(np.float64), woff


def sim_hashes(grams: np.ndarray, weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints (rows x BITS, 0 or 1) of rows of weighted grams; no row is empty."""
    out = np.empty((len(off) - 1, BITS), np.uint8)
    for half in range(BITS // 64):
        h = C.mix(grams + np.uint64(half + 1))
        for i in range(64):
            sign = np.where((h >> np.uint64(i)) & np.uint64(1), weights, -weights)
            out[:, half * 64 + i] = np.add.reduceat(sign, off[:-1]) > 0
    return out


def packed(prints: np.ndarray, kind: type) -> np.ndarray:
    """Fingerprints as rows of unsigned numbers."""
    return np.ascontiguousarray(np.packbits(prints, axis=1)).view(kind)


#: All differences of up to PROBE bits.
_NEAR = np.array([sum(1 << b for b in bits) for n in range(PROBE + 1) for bits in combinations(range(BLOCK_BITS), n)], np.uint16)


def weighed(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams, what each weighs, and how often each stands there."""
    kinds, first, count = np.unique(grams, return_index=True, return_counts=True)
    return kinds, weight[first], count


class MultiIndex:
    """Of up to PART fingerprints: for each block and value, which of them have a value
    within PROBE bits of it."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = packed(prints, np.uint64)
        self.lists = []
        who = np.repeat(np.arange(len(prints), dtype=np.uint16), len(_NEAR))
        for values in packed(prints, np.uint16).T:
            near = (values[:, None] ^ _NEAR[None, :]).reshape(-1)
            order = np.argsort(near, kind="stable")
            count = np.bincount(near, minlength=1 << BLOCK_BITS)
            self.lists.append((np.concatenate(([0], np.cumsum(count))), who[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item) within the radius, by way of the blocks."""
        pairs = []
        for values, (off, items) in zip(packed(prints, np.uint16).T, self.lists, strict=True):
            first = off[values]
            size = off[values.astype(np.int64) + 1] - first
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            pairs.append(np.repeat(np.arange(len(prints)), size) << 16 | items[at])
        pairs = np.unique(np.concatenate(pairs))
        who, item = pairs >> 16, pairs & 0xFFFF
        far = np.bitwise_count(packed(prints, np.uint64)[who] ^ self.prints[item]).sum(1)
        return who[far <= RADIUS], item[far <= RADIUS]


class Items:
    """An index of items whose grams have n words."""

    def __init__(self, ids: list, texts: list[str], n: int) -> None:
        raw, off = C.buffers(pa.array(texts, pa.large_string()))
        grams, weight, woff = gram_hashes(raw, off, n)
        self.n, self.ids = n, ids
        self.words = np.diff(woff)
        self.count = self.words - n + 1
        spans = list(zip(woff[:-1].tolist(), self.count.tolist(), strict=True))
        flat = np.concatenate([grams[a : a + c] for a, c in spans])
        heavy = np.concatenate([weight[a : a + c] for a, c in spans])
        item = np.repeat(np.arange(len(ids)), self.count)
        place = np.concatenate([np.arange(c) for c in self.count])
        order = np.argsort(flat, kind="stable")
        self.sorted, self.item, self.place = flat[order], item[order], place[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(flat >> np.uint64(44)).astype(np.int64)] = True
        starts = np.concatenate(([0], np.cumsum(self.count)))
        self.prints = sim_hashes(flat, heavy, starts)
        self.sets = [weighed(flat[a:b], heavy[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        self.parts = [(at, MultiIndex(self.prints[at : at + PART])) for at in range(0, len(ids), PART)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item) within the radius."""
        found = [(who, item + at) for at, part in self.parts for who, item in [part.candidates(prints)]]
        return np.concatenate([who for who, _ in found]), np.concatenate([item for _, item in found])

    def similarity(self, grams: np.ndarray, weight: np.ndarray, item: int) -> float:
        mine, heavy, count = weighed(grams, weight)
        theirs, other_heavy, other = self.sets[item]
        _, a, b = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        both = float((heavy[a] * np.minimum(count[a], other[b])).sum())
        return both / (float((heavy * count).sum() + (other_heavy * other).sum()) - both)

    def between(self, row: np.ndarray, item: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows, those that start up to SLIDE words from one, and those that start
        between two of a row and item: where words came in or went, or where what stands
        around is light, the best window may be aligned with no gram."""
        slide = np.arange(-SLIDE, SLIDE + 1)
        row, item, first = (np.repeat(row, len(slide)), np.repeat(item, len(slide)), (first[:, None] + slide).reshape(-1))
        low, n = first.min(), len(self.ids)
        wide = int(first.max() - low) + 1
        key = np.unique((row * n + item) * wide + first - low)
        row, item, first = key // wide // n, key // wide % n, key % wide + low
        step = np.diff(first, append=first[-1:] + 1)
        same = np.concatenate(((row[1:] == row[:-1]) & (item[1:] == item[:-1]), [False]))
        size = np.where(same & (4 * step <= self.words[item]) & (step <= GAP), step, 1)
        each = np.repeat(np.arange(len(row)), size)
        return row[each], item[each], first[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)

    def search(self, grams: np.ndarray, weight: np.ndarray, woff: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, last word + 1) of the windows that match."""
        out: list[tuple[int, int, float, int, int]] = []
        maybe = np.flatnonzero(self.filter[(grams >> np.uint64(44)).astype(np.int64)])
        g = grams[maybe]
        left, right = np.searchsorted(self.sorted, g, "left"), np.searchsorted(self.sorted, g, "right")
        row = np.searchsorted(woff, maybe, "right") - 1
        ok = (right > left) & (maybe + self.n <= woff[row + 1])
        maybe, left, right, row = maybe[ok], left[ok], right[ok], row[ok]
        for part in np.array_split(np.arange(len(maybe)), max(1, int((right - left).sum()) >> 16)):
            size = right[part] - left[part]
            if not size.sum():
                continue
            each = np.repeat(part, size)
            at = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + left[each]
            item, r = self.item[at], row[each]
            r, item, first = self.between(r, item, maybe[each] - self.place[at])
            last = np.minimum(first + self.words[item], woff[r + 1])
            first = np.maximum(first, woff[r])
            windows = np.unique(np.stack((r, first, last)), axis=1)
            for w in np.array_split(windows, max(1, windows.shape[1] >> 11), axis=1):
                r, first, last = w
                count = last - first - self.n + 1
                w = np.flatnonzero(count > 0)
                if not len(w):
                    continue
                r, first, last, count = r[w], first[w], last[w], count[w]
                off = np.concatenate(([0], np.cumsum(count)))
                at = np.arange(off[-1]) - np.repeat(off[:-1], count) + np.repeat(first, count)
                flat, heavy = grams[at], weight[at]
                who, item = self.candidates(sim_hashes(flat, heavy, off))
                for k, i in zip(who.tolist(), item.tolist(), strict=True):
                    s = self.similarity(flat[off[k] : off[k + 1]], heavy[off[k] : off[k + 1]], i)
                    if s >= least - 1e-9:
                        base = int(woff[r[k]])
                        out.append((int(r[k]), i, s, int(first[k]) - base, int(last[k]) - base))
        return out


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of at most ITEM_BYTES bytes (a longer item alone)."""
    size = F.octet_length("text").cast("long")
    known = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = known.agg(F.sum(size)).first()[0] or 0
    if total <= ITEM_BYTES:
        rows = [tuple(r) for r in known.collect()]
        if rows:
            yield rows
        return

    parts = 2 * (total // ITEM_BYTES + 1)
    dealt = C.settle(known.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
    for part in range(parts):
        rows, held = [], 0
        for r in dealt.where(F.col("part") == part).select("item_id", "text").toLocalIterator():
            if rows and held + len(r[1].encode()) > ITEM_BYTES:
                yield rows
                rows, held = [], 0
            rows.append(tuple(r))
            held += len(r[1].encode())
        if rows:
            yield rows


#: The index that this worker has built last, by the name of its block.
_BUILT: dict[str, list[Items]] = {}


def index_of(name: str, block: list[tuple]) -> list[Items]:
    """Items of a block by the number of words in their grams; those without words match nothing."""
    if name not in _BUILT:
        _BUILT.clear()
        _, _, woff = C.word_bounds(*C.buffers(pa.array([t for _, t in block], pa.large_string())))
        by_n: dict[int, list[tuple]] = {}
        for item, n in zip(block, np.diff(woff).tolist(), strict=True):
            if n:
                by_n.setdefault(min(GRAM, n), []).append(item)
        _BUILT[name] = [Items([i for i, _ in v], [t for _, t in v], n) for n, v in by_n.items()]
    return _BUILT[name]


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word): each document and item that
    match, with the best window (the first of equal ones)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = C.keyed(docs)
    out = spark.createDataFrame([], "d long, th long, item_id long, similarity double, start_word int, end_word int")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(*shared.value)
            for b in C.all_pieces(batches, 1 << 21):
                raw, off = C.buffers(b.column("text"))
                d, th = b.column("d").to_numpy(), b.column("th").to_numpy()
                found: dict[tuple, tuple] = {}
                for items in index:
                    grams, weight, woff = gram_hashes(raw, off, items.n)
                    for row, item, s, first, last in items.search(grams, weight, woff, least):
                        key, value = (row, items.ids[item]), (-s, first, last)
                        if key not in found or value < found[key]:
                            found[key] = value
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d[r]) for r, _ in found], pa.int64()), pa.array([int(th[r]) for r, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()),
                     pa.array([-v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.int32()), pa.array([v[2] for v in found.values()], pa.int32())],
                    names=["d", "th", "item_id", "similarity", "start_word", "end_word"],
                )

        out = out.unionByName(rows.mapInArrow(run, "d long, th long, item_id long, similarity double, start_word int, end_word int"))
    return out


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(C.documents(spark, sf_dir), C.read(spark, sf_dir, "benchmark"))
    return out.select(C.doc_id_back(), "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "end_word")


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLES: dict[str, str] = {}
