"""Pairs of texts with a Jaccard similarity of word 5-grams of at least 0.8.

Texts with one set of 5-grams are one entry with a number of copies. Entries that agree
in a band of MinHash values are linked to the smallest of the band, and the components
of these links hold all candidates. A component is compared block against block, so a
large one is spread over many tasks and no pair is ever a row. Inside a block pair, the
MinHash values of a pair are compared in steps; it is dropped when the posterior
probability of reaching the threshold falls below `TOLERANCE`; the others are verified
with their exact sets. Only sums of links and a spanning forest leave a block pair.

Defined results: a text of fewer than five words has all its words as its one gram; a
text without words (null, empty) has no links and is a class of its own; every row
counts, so exactly repeated rows link; a null doc_id is the smallest id and stays null;
classes led by different texts of one id differ in class_th, the text hash of the first
row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import connected_components
from leadspark.llm import common as C

GRAM = 5
LEAST = 0.8
BANDS, PER_BAND = 32, 4
#: A pair is dropped when its chance of reaching the threshold is less than this.
TOLERANCE = 1e-7
STEP = 16
BLOCK = 128
_A = C.mix(np.arange(1, BANDS * PER_BAND + 1, dtype=np.uint64)) | np.uint64(1)


def gram_sets(raw: np.ndarray, off: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams of every row, sorted in each row; offsets of rows."""
    start, end, woff = C.word_bounds(raw, off)
    words = C.word_hashes(raw, start, end)
    size = np.diff(woff)
    rows = len(size)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(rows), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + woff[row]
    last = np.minimum(first + n, woff[row + 1])
    grams = C.Rolling(words).blocks(first, last) + (last - first).astype(np.uint64)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])))
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(rows + 1))


def signatures(grams: np.ndarray, off: np.ndarray, k: int = BANDS * PER_BAND) -> np.ndarray:
    """MinHash values (k x rows, 32 bits); rows without grams have the largest value."""
    rows = len(off) - 1
    out = np.full((k, rows), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        at = off[some]
        for i in range(k):
            out[i, some] = np.minimum.reduceat(((grams * _A[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_names(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's set."""
    size = np.diff(off).astype(np.uint64)
    out = []
    for salt in (1, 2):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(C.mix(grams + np.uint64(salt)), dtype=np.uint64)))
        out.append(C.mix(sums[off[1:]] - sums[off[:-1]] + size))
    return out[0], out[1]


def least_matches(least: float = LEAST, tolerance: float = TOLERANCE, k: int = BANDS * PER_BAND, step: int = STEP) -> dict[int, int]:
    """After n compared values, how many must agree: with m of n agreeing, the similarity is
    Beta(m + 1, n - m + 1) from a flat prior; its upper tail is a binomial sum."""
    out = {}
    for n in range(step, k + 1, step):
        # P(similarity >= least) = P(Binomial(n + 1, least) <= m)
        tail, m = 0.0, -1
        for j in range(n + 1):
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(least) + (n + 1 - j) * math.log(1 - least))
            if tail >= tolerance:
                m = j
                break
        out[n] = m if m >= 0 else n
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which pairs (columns i and j of sig) are still possible after all steps."""
    live = np.arange(len(i))
    agree = np.zeros(len(i), np.int64)
    at = 0
    for n, m in needed.items():
        agree[live] += (sig[at:n, i[live]] == sig[at:n, j[live]]).sum(0)
        live = live[agree[live] >= m]
        at = n
    return live


def entries(docs: DataFrame) -> DataFrame:
    """(d, th, s1, s2, n, bands) of every row; n: size of its set; bands: keys of its bands."""
    C.small_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 21):
            grams, off = gram_sets(*C.buffers(b.column("text")))
            sig = signatures(grams, off)
            keys = np.empty((b.num_rows, BANDS), np.uint64)
            for i in range(BANDS):
                key = np.full(b.num_rows, i + 1, np.uint64)
                for v in sig[i * PER_BAND : (i + 1) * PER_BAND]:
                    key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64))
                keys[:, i] = key
            s1, s2 = set_names(grams, off)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("th"), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.diff(off).astype(np.int32)), bands],
                names=["d", "th", "s1", "s2", "n", "bands"],
            )

    return docs.mapInArrow(run, "d long, th long, s1 long, s2 long, n int, bands array<bigint>")


def compare_blocks(members: DataFrame, least: float) -> DataFrame:
    """members: (c, s1, s2, copies, blocks, text). (s1, s2, root1, root2, links)."""
    mine = F.pmod(F.xxhash64("s1", "s2"), "blocks").cast("int")
    pairs = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("c", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "s1", "s2", "copies", "text")
    dealt = pairs.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y")
    needed = least_matches(least)
    names = ("c", "x", "y", "mine", "s1", "s2", "copies", "text")

    def one(rows: list[tuple]) -> list[tuple]:
        k = len(rows)
        x, y = rows[0][1], rows[0][2]
        text = pa.array([r[7] for r in rows], pa.large_string())
        grams, off = gram_sets(*C.buffers(text))
        sig = signatures(grams, off)
        sets = [grams[a:b] for a, b in pairwise(off.tolist())]
        block = np.array([r[3] for r in rows])
        i, j = np.triu_indices(k, 1)
        if x != y:
            far = block[i] != block[j]
            i, j = i[far], j[far]
        size = np.diff(off)
        near = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
        i, j = i[near], j[near]
        live = surviving(sig, i, j, needed)
        i, j = i[live], j[live]
        copies = np.array([r[6] for r in rows])
        links, root = np.zeros(k, np.int64), list(range(k))

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if both >= least * (len(sets[p]) + len(sets[q]) - both) - 1e-9:
                links[p] += copies[q]
                links[q] += copies[p]
                a, b = top(p), top(q)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return [(rows[v][4], rows[v][5], rows[top(v)][4], rows[top(v)][5], int(links[v])) for v in range(k) if links[v]]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            out = one(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["s1", "s2", "root1", "root2", "links"])

        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                if held and r[:3] != held[-1][:3]:
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    return dealt.mapInArrow(run, "s1 long, s2 long, root1 long, root2 long, links long")


def ngram_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs: (d, th, text). (d, th, class, class_th, n_links) of every row; (class, class_th) is
    the smallest (d, th) of the class: texts that share an id, or have none, stay apart."""
    rows = C.settle(entries(docs))
    sets = rows.where("n > 0").groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min(F.struct("d", "th")).alias("r"), F.first("bands").alias("bands"))
    sets = C.settle(sets)
    name = F.struct("s1", "s2")
    keys = sets.select("s1", "s2", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(name).alias("hub"), F.max(name).alias("last")).where("hub <> last").select("key", "hub")
    close = keys.join(hubs, "key").select(name.alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    parts = connected_components(close)
    sizes = parts.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = parts.join(sizes, "label").select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.xxhash64("label").alias("c"), "blocks")
    members = members.join(sets.select("s1", "s2", "copies", "r.d", "r.th"), ["s1", "s2"])
    # A representative may stand on repeated rows; one of them is enough.
    members = members.join(docs, ["d", "th"]).select("c", "s1", "s2", "copies", "blocks", "text")
    repeated = rows.groupBy("d", "th").count().where("count > 1").limit(1).count() > 0
    if repeated:
        members = members.dropDuplicates(["s1", "s2"])
    found = C.settle(compare_blocks(members, least))
    links = found.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    true = connected_components(found.select(name.alias("a"), F.struct(F.col("root1").alias("s1"), F.col("root2").alias("s2")).alias("b")))
    true = true.select(F.col("node.s1").alias("s1"), F.col("node.s2").alias("s2"), F.col("label").alias("c"))
    known = sets.select("s1", "s2", "copies", F.col("r").alias("least")).join(links, ["s1", "s2"], "left").join(true, ["s1", "s2"], "left")
    known = known.select("s1", "s2", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("c", name).alias("c"))
    low = known.groupBy("c").agg(F.min("least").alias("least")).select("c", F.col("least.d").alias("class"), F.col("least.th").alias("class_th"))
    known = known.join(low, "c").select("s1", "s2", "class", "class_th", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    # Rows without grams share one name; they stay apart.
    found_rows = rows.where("n > 0").join(known, ["s1", "s2"]).select("d", "th", "class", "class_th", "n_links")
    return found_rows.unionByName(rows.where("n = 0").select("d", "th", F.col("d").alias("class"), F.col("th").alias("class_th"), F.lit(0).cast("long").alias("n_links")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_classes(C.keyed(C.documents(spark, sf_dir)))
    return out.select(C.doc_id_back(), C.doc_id_back("class").alias("class_id"), "n_links", "class_th")


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
