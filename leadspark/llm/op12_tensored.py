"""Near copies of documents by tensored MinHash tables.

A table key is a pair: one value of a left collection and one of a right collection of
`SIDE` values each, where a value joins `TOGETHER` MinHash values. `SIDE` squared tables so
cost 2 * SIDE * TOGETHER MinHash values in place of SIDE**2 * 2 * TOGETHER. Two sets meet in
some table if and only if they agree in one value of either side; at a similarity of 0.8
they miss each other with a chance of 2 * (1 - 0.8**TOGETHER)**SIDE, 7e-5 here.

Texts with one set of shingles are one entry. Every table key has a hub, its least entry;
each other entry of the key is compared with it on the full sets, a hub with many partners
in many tasks. Verified links give components. Entries of keys that do not lie in one
component by then are open. What two open sets of different components share at the
similarity is known to hold a shingle that is among the rare ones of both, at a place that
leaves room for the rest (`rare_meetings`, exact). Entries that so meet form groups; a group is
cut into blocks by bytes and entries, and a pair of blocks is a task's unit, so no pair is
ever a row. A group's largest component is not compared with itself.

Defined results: A-Z count as a-z; a text of fewer than four words has all its words as its
one shingle; a text without words (null, empty) has no shingles, is linked with nothing and
is its own component; rows repeated exactly are copies, each with the same result; a null
doc_id is the smallest id and stays null, its row is kept if it leads its component; ids
must be integers (else TypeError); texts of any length are taken whole; further columns are
ignored; an empty table gives an empty result. Shingles have 64 bits, entries 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.components import connected_components
from leadspark.llm import common as C
from leadspark.llm.op6_ngram_join import gram_sets, set_names, signatures

GRAM = 4
#: Least similarity in hundredths.
LEAST = 80
SIDE, TOGETHER = 10, 2
#: Partners of a hub in one unit; a block has 8 times as many entries, and SHINGLES shingles.
BLOCK = 128
SHINGLES = 1 << 18
#: Shingles that are compared at once inside a pair of blocks, if more than FEW entries hold them.
COLUMNS = 1 << 12
FEW = 16


def lowered(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z as a-z."""
    return raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32)).astype(np.uint8)


def collections(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x (2 * SIDE) values: the left collection, then the right one."""
    sig = signatures(grams, off, 2 * SIDE * TOGETHER)
    out = np.empty((len(off) - 1, 2 * SIDE), np.uint64)
    for i in range(2 * SIDE):
        value = np.full(len(off) - 1, i + 1, np.uint64)
        for v in sig[i * TOGETHER : (i + 1) * TOGETHER]:
            value = C.mix(value * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64))
        out[:, i] = value
    return out


def entries(docs: DataFrame) -> DataFrame:
    """(d, th, name, n, first, second) of every row: n the size of its set, the two collections."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 21):
            raw, off = C.buffers(b.column("text"))
            grams, goff = gram_sets(lowered(raw), off, GRAM)
            values = collections(grams, goff).view(np.int64)
            ends = pa.array(np.arange(0, (b.num_rows + 1) * SIDE, SIDE, dtype=np.int32))
            sides = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values[:, a : a + SIDE]).reshape(-1))) for a in (0, SIDE)]
            name = set_names(grams, goff)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("th"), pa.array(name), pa.array(np.diff(goff).astype(np.int64)), *sides], names=["d", "th", "name", "n", "first", "second"])

    return docs.mapInArrow(run, "d long, th long, name long, n long, first array<bigint>, second array<bigint>")


def table_keys(sets: DataFrame) -> DataFrame:
    """(name, key): every pair of a left and a right value."""
    left = sets.select("name", F.explode("first").alias("x"), "second")
    return left.select("name", "x", F.explode("second").alias("y")).select("name", F.xxhash64("x", "y").alias("key"))


def packed_sets(members: DataFrame) -> DataFrame:
    """members: (name, text). (name, grams): the sorted shingles as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 21):
            raw, off = C.buffers(b.column("text"))
            grams, goff = gram_sets(lowered(raw), off, GRAM)
            data = pa.py_buffer(grams.tobytes())
            ends = pa.py_buffer((goff * 8).astype(np.int64).tobytes())
            large = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, ends, data])
            yield pa.RecordBatch.from_arrays([b.column("name"), large.cast(pa.binary())], names=["name", "grams"])

    return members.mapInArrow(run, "name long, grams binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets: shingles of few sets by their
    pairs, the others in bounded strips."""
    k = len(sets)
    grams = np.concatenate(sets)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    out = np.zeros(k * k, np.int64)
    few = (held[column] > 1) & (held[column] <= FEW)
    r, c = row[few], column[few]
    out += np.bincount(r * (k + 1), minlength=k * k)
    for far in range(1, FEW):
        same = np.flatnonzero(c[far:] == c[:-far])
        if not len(same):
            break
        i, j = r[same], r[same + far]
        out += np.bincount(np.concatenate((i * k + j, j * k + i)), minlength=k * k)
    out = out.reshape(k, k)
    many = held > FEW
    keep = many[column]
    row = row[keep]
    column = (np.cumsum(many) - 1)[column[keep]]
    for low in range(0, int(many.sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        strip = np.zeros((k, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        strip[row[a:b], column[a:b] - low] = 1
        out += np.rint(strip @ strip.T).astype(np.int64)
    return out


Unit = list[tuple]


def by_units(dealt: DataFrame, links: Callable[[Unit], list[tuple[int, int]]]) -> DataFrame:
    """dealt: (g, x, y, mark, name, grams) in order of units (g, x, y). (a, b) of links."""
    names = ("g", "x", "y", "mark", "name", "grams")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Unit = []

        def done() -> pa.RecordBatch:
            found = links(held)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                if held and r[:3] != held[-1][:3]:
                    yield done()
                    held = []
                held.append((*r[:5], np.frombuffer(r[5], np.uint64)))
        if held:
            yield done()

    return dealt.mapInArrow(run, "a long, b long")


def star_links(unit: Unit) -> list[tuple[int, int]]:
    """Links of a hub (mark 0) with its partners (mark 1)."""
    hubs = [r for r in unit if r[3] == 0]
    return [(r[4], h[4]) for h in hubs[:1] for r in unit if r[3] and alike(h[5], r[5])]


def block_links(unit: Unit) -> list[tuple[int, int]]:
    """A spanning forest of the links between entries of two blocks that lie in different components (mark)."""
    k = len(unit)
    _, part = np.unique(np.array([r[3] for r in unit], np.int64), return_inverse=True)
    if part.max() == 0:
        return []
    both = common_counts([r[5] for r in unit])
    size = np.array([len(r[5]) for r in unit])
    near = (100 + LEAST) * both >= LEAST * (size[:, None] + size[None, :])
    near &= part[:, None] != part[None, :]
    free = np.ones(k, bool)
    out = []
    for start in np.flatnonzero(near.any(1)).tolist():
        todo = [start] if free[start] else []
        free[start] = False
        while todo:
            v = todo.pop()
            found = np.flatnonzero(near[v] & free).tolist()
            free[found] = False
            todo += found
            out += [(unit[w][4], unit[v][4]) for w in found]
    return out


def star(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs: (a, b) with b the hub. Those that are links; a hub has a unit for each BLOCK partners."""
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("units"))
    partners = pairs.join(size, "b").select(F.col("b").alias("g"), F.pmod(F.xxhash64("a"), "units").cast("int").alias("x"), F.lit(1).alias("mark"), F.col("a").alias("name"))
    hubs = size.select(F.col("b").alias("g"), F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("x"), F.lit(0).alias("mark"), F.col("b").alias("name"))
    rows = partners.unionByName(hubs).join(held, "name").select("g", "x", F.lit(0).alias("y"), "mark", "name", "grams")
    return by_units(rows.repartition("g", "x").sortWithinPartitions("g", "x", "mark"), star_links)


def spread(sets: DataFrame) -> DataFrame:
    """sets: (name, t, grams). (name, t, n, gram) of every shingle; n is the size of its set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 20, "grams"):
            raw, off = C.buffers(b.column("grams"))
            n = np.diff(off) // 8
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b.column("name").take(at), b.column("t").take(at), pa.array(n).take(at), pa.array(raw.view(np.int64))], names=["name", "t", "n", "gram"])

    return sets.select("name", "t", "grams").mapInArrow(run, "name long, t long, n long, gram long")


def rare_meetings(opened: DataFrame, held: DataFrame) -> DataFrame:
    """opened: (name, t): entries and their components. (a, b): edges that join all entries of
    different components that reach the similarity, and as few others as shingles tell.

    Only shingles that lie in two components count; each entry has them in one order, from the
    rarest. The rarest that two entries share has `place` of an entry's shingles from there on,
    so they share no more than that. At the similarity they share LEAST percent of either, and
    LEAST / (100 + LEAST) of both sizes: this bounds the place and the other's size.
    """
    each = spread(opened.join(held, "name"))
    common = each.groupBy("gram").agg(F.count("*").alias("df"), F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("gram", "df")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("df"), F.desc("gram")))
    first = each.join(common, "gram").select("gram", "name", "t", "n", place.alias("place"))
    first = C.settle(first.where(F.col("place") * 100 >= F.col("n") * LEAST))
    sizes = first.groupBy("gram").agg(F.min("n").alias("smallest"))
    fits = F.col("place") * (100 + LEAST) >= (F.col("n") + F.col("smallest")) * LEAST
    fitting = C.settle(first.join(sizes, "gram").where(fits).select("gram", "name", "t"))
    least = fitting.groupBy("gram").agg(F.min("name").alias("b"), F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("gram", "b")
    return fitting.join(least, "gram").select(F.col("name").alias("a"), "b").distinct()


def blocks(entries: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(entries / (8 * BLOCK)), F.ceil(shingles / SHINGLES)).cast("int")


def between(groups: DataFrame, held: DataFrame) -> DataFrame:
    """groups: (g, name, t): links between the entries of a group, by pairs of blocks. The blocks of
    the group's largest component t come first, and do not meet each other."""
    parts = groups.join(held.select("name", (F.octet_length("grams") / 8).alias("n")), "name").groupBy("g", "t").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    whole = parts.groupBy("g").agg(F.max(F.struct("n", "c", "t")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    size = whole.select("g", F.col("main.t").alias("main"), blocks(F.col("main.c"), F.col("main.n")).alias("own"), blocks(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("rest"))
    inner = F.col("t") == F.col("main")
    hashed = F.xxhash64("name")
    mine = F.when(inner, F.pmod(hashed, "own")).otherwise(F.col("own") + F.pmod(hashed, "rest")).cast("int")
    other = F.sequence(F.when(inner, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("rest") - 1)
    dealt = groups.join(size, "g").select("g", "name", "t", mine.alias("mine"), F.explode(other).alias("other"))
    dealt = dealt.select("g", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.col("t").alias("mark"), "name").join(held, "name")
    return by_units(dealt.select("g", "x", "y", "mark", "name", "grams").repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "name"), block_links)


def near_copies(docs: DataFrame) -> DataFrame:
    """docs: (d, th, text). (d, th, n, component) of every row; component is the least d of it."""
    rows = C.settle(entries(docs))
    sets = C.settle(rows.where("n > 0").groupBy("name").agg(F.min(F.struct("d", "th")).alias("r"), F.first("first").alias("first"), F.first("second").alias("second")))
    keys = table_keys(sets)
    hubs = keys.groupBy("key").agg(F.min("name").alias("hub"), F.max("name").alias("last")).where("hub <> last").select("key", "hub")
    met = C.settle(keys.join(hubs, "key").where("name <> hub"))
    pairs = C.settle(met.select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    # A representative may stand on repeated rows; one of them is enough.
    spoken = wanted.join(sets.select("name", "r.d", "r.th"), "name").join(docs, ["d", "th"]).select("name", "text")
    if rows.groupBy("d", "th").count().where("count > 1").limit(1).count():
        spoken = spoken.dropDuplicates(["name"])
    held = C.settle(packed_sets(spoken))
    found = C.settle(star(pairs, held))
    parts = connected_components(found).select(F.col("node").alias("name"), F.col("label").alias("t"))
    # Entries of a key besides its hub that are not in one component have still to be compared.
    at = met.join(parts, "name", "left").select("key", "name", F.coalesce("t", "name").alias("t"))
    open_keys = at.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("key")
    left = C.settle(at.join(open_keys, "key").select("name", "t").distinct())
    if left.limit(1).count():
        groups = connected_components(rare_meetings(left, held)).select(F.col("label").alias("g"), F.col("node").alias("name"))
        more = C.settle(between(groups.join(left, "name").select("g", "name", "t"), held))
        known = parts.select(F.col("name").alias("a"), F.col("t").alias("b")).where("a <> b")
        parts = connected_components(known.unionByName(more)).select(F.col("node").alias("name"), F.col("label").alias("t"))
    first = sets.select("name", F.col("r.d").alias("least")).join(parts, "name", "left")
    low = first.where("t is not null").groupBy("t").agg(F.min("least").alias("lowest"))
    first = first.join(low, "t", "left").select("name", F.coalesce("lowest", "least").alias("component"))
    out = rows.where("n > 0").join(first, "name").select("d", "th", "n", "component")
    return out.unionByName(rows.where("n = 0").select("d", "th", "n", F.col("d").alias("component")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(C.keyed(C.documents(spark, sf_dir)))
    return out.select(C.doc_id_back(), F.col("n").alias("n_shingles"), C.doc_id_back("component").alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))


QUERIES = {"op12_minhash_near_dedup": op12_minhash_near_dedup}
ORACLES: dict[str, str] = {}
