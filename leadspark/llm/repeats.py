"""Windows of a fixed number of units (bytes or words) that occur more than once.

The search never ships a row for each position. Each window elects the smallest
hash of the m-grams inside it (its anchor), a choice that depends on the window
alone; so two equal windows elect the same anchor at the same place inside them.
One row stands for a run of windows with one anchor; it carries the hash of the
anchor, the hash of its surroundings (everything that such a window can reach)
and the place. Rows are counted by anchor with map-side sums; anchors that occur
once are dropped. Equal surroundings are one entry with a weight. The texts of
the few entries whose anchor has different surroundings are then compared
exactly, group by group, by the caller's matcher. A group with more entries
than the caller allows is not put into one task: its entries are cut into narrower runs of
windows, grouped by what the windows of a run share, and equal ones are one again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm import common as C

#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 21

OCC = "anchor long, outer long, d long, th long, at long"
#: A run's place in one number: the anchor's place (45 bits) and how far ahead of it the
#: run's first and last windows start, each less than the window's length.
FIELD = 9


def pack(mid, p0, p1):
    return (mid.astype(np.int64) << FIELD | (mid - p0)) << FIELD | (mid - p1)


def unpack(at: np.ndarray):
    """mid, p0, p1 of packed places."""
    low = (1 << FIELD) - 1
    mid = at >> 2 * FIELD
    return mid, mid - (at >> FIELD & low), mid - (at & low)


def reach(mid, size, k: int, m: int):
    """The units that windows with an anchor at mid can hold, in a row of that size."""
    return np.maximum(0, mid - (k - m)), np.minimum(size, mid + k)


def units_of(kind: str, raw: np.ndarray, off: np.ndarray):
    """(units, offsets of rows in units, starts, ends); the last two for words only."""
    if kind == "bytes":
        return C.byte_units(raw), off, None, None
    start, end, woff = C.word_bounds(raw, off)
    return C.word_hashes(raw, start, end), woff, start, end


def anchors(units: np.ndarray, off: np.ndarray, k: int, m: int):
    """Runs of windows with one anchor: row, anchor place, first and last window
    (places count in units from the start of the batch), anchor hash."""
    n = len(units)
    if n < k:
        return None
    roll = C.Rolling(units)
    grams = roll.grams(m)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w, step = k - m + 1, 1
    while step * 2 <= w:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if w > step:
        best = np.minimum(best[: len(best) - (w - step)], best[w - step :])
    at = (best & low).astype(np.int64)  # of each window start
    row = np.searchsorted(off, np.arange(len(at)), "right") - 1
    inside = np.arange(len(at)) + k <= off[row + 1]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return None
    at, row = at[windows], row[windows]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(windows)])) - 1
    mid = at[first]
    return roll, row[first], mid, windows[first], windows[last], grams[mid]


def occurrences(docs: DataFrame, kind: str, k: int, m: int) -> DataFrame:
    """docs: (d, th, text). A row for each run of windows with one anchor."""
    assert k < 1 << FIELD

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, AT_ONCE):
            raw, off = C.buffers(b.column("text"))
            units, uoff, _, _ = units_of(kind, raw, off)
            found = anchors(units, uoff, k, m)
            if found is None:
                continue
            roll, row, mid, p0, p1, gram = found
            base = uoff[row]
            lo, hi = (x + base for x in reach(mid - base, uoff[row + 1] - base, k, m))
            outer = roll.blocks(lo, hi) ^ C.mix((((mid - lo) << 32) | (hi - lo)).astype(np.uint64))
            cols = [gram.view(np.int64), outer.view(np.int64), b.column("d").to_numpy()[row], b.column("th").to_numpy()[row]]
            cols.append(pack(*(x - base for x in (mid, p0, p1))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=OCC.replace(" long", "").split(", "))

    return docs.mapInArrow(run, OCC)


def cut(docs: DataFrame, wanted: DataFrame, kind: str, k: int, m: int) -> DataFrame:
    """wanted: (d, th, anchor, outer, n, at). Adds the units that a run can reach as
    text, words joined by one space."""
    lists = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "outer", "n", "at")).alias("w"))
    both = docs.join(lists, ["d", "th"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, AT_ONCE):
            raw, off = C.buffers(b.column("text"))
            _, uoff, start, end = units_of(kind, raw, off) if kind == "words" else (None, off, None, None)
            data = raw.tobytes()
            lists = b.column("w")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), size)
            f = {name: flat.field(name).to_numpy() for name in ("anchor", "outer", "n", "at")}
            mid, p0, p1 = unpack(f["at"])
            left, right = reach(mid, np.diff(uoff)[row], k, m)
            lo, hi = left + uoff[row], right + uoff[row]
            if kind == "words":
                part = [b" ".join(data[start[i] : end[i]] for i in range(x, y)) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            else:
                part = [data[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            mine = b.column("d").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f["anchor"]), pa.array(f["outer"]), pa.array(mine), pa.array(f["n"]), *(pa.array((x - left).astype(np.int32)) for x in (mid, p0, p1)), pa.array(part, pa.binary())],
                names=["anchor", "outer", "d", "n", "mid", "p0", "p1", "part"],
            )

    return both.mapInArrow(run, "anchor long, outer long, d long, n long, mid int, p0 int, p1 int, part binary")


Matcher = Callable[[list[tuple]], list[list[tuple[int, int]]]]


def match_groups(entries: DataFrame, matcher: Matcher, at_once: int = 1 << 20) -> DataFrame:
    """Groups of entries with one anchor, whole groups at a time. The matcher gets
    (group, outer, d, n, mid, p0, p1, part) of each entry and gives its repeated
    spans, in units relative to the anchor."""
    dealt = entries.repartition("anchor").sortWithinPartitions("anchor", "d", "outer")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            spans = matcher(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([np.array(s, np.int32).tobytes() for s in spans], pa.binary())],
                names=["anchor", "outer", "spans"],
            )

        for b in batches:
            names = ("anchor", "outer", "d", "n", "mid", "p0", "p1", "part")
            for r in zip(*(b.column(x).to_pylist() for x in names), strict=True):
                if held and r[0] == held[-1][0] and r[1] == held[-1][1]:
                    continue  # a repeated row of the input
                if weight > at_once and r[0] != held[-1][0]:
                    yield done(held)
                    held, weight = [], 0
                held.append(r)
                weight += len(r[7])
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "anchor long, outer long, spans binary")


def split(entries: DataFrame, kind: str, k: int, width: int) -> DataFrame:
    """Cuts each entry into runs of at most `width` window starts, aligned at the anchor. A
    run is grouped by what all windows of such a run share, so equal windows stay together."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, AT_ONCE, "part"):
            raw, off = C.buffers(b.column("part"))
            units, uoff, start, end = units_of(kind, raw, off)
            roll = C.Rolling(units)
            f = {x: b.column(x).to_numpy() for x in ("anchor", "outer", "d", "n", "mid", "p0", "p1")}
            r0, r1 = (f["mid"] - f["p1"]) // width, (f["mid"] - f["p0"]) // width
            size = r1 - r0 + 1
            row = np.repeat(np.arange(b.num_rows), size)
            r = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + r0[row]
            mid = f["mid"][row]
            first = np.maximum(f["p0"][row], mid - (r + 1) * width + 1)
            last = np.minimum(f["p1"][row], mid - r * width)
            base = uoff[row]
            core = roll.blocks(base + mid - r * width, base + mid - (r + 1) * width + 1 + k)
            key = C.mix(core ^ f["anchor"][row].view(np.uint64)) + r.astype(np.uint64)
            lo, hi = base + first, base + last + k
            name = roll.blocks(lo, hi) ^ C.mix(((mid - first) << 32 | (hi - lo)).astype(np.uint64))
            data = raw.tobytes()
            if kind == "words":
                part = [b" ".join(data[start[i] : end[i]] for i in range(x, y)) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            else:
                part = [data[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            cols = [key.view(np.int64), name.view(np.int64), f["anchor"][row], f["outer"][row], f["d"][row], f["n"][row], (mid - first).astype(np.int32), np.zeros(len(row), np.int32), (last - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array(part, pa.binary())], names=["anchor", "outer", "a0", "o0", "d", "n", "mid", "p0", "p1", "part"])

    return entries.mapInArrow(run, "anchor long, outer long, a0 long, o0 long, d long, n long, mid int, p0 int, p1 int, part binary")


def resolve(entries: DataFrame, kind: str, k: int, matcher: Matcher, earlier_only: bool, widths: tuple[int, ...], most: int, used: list[DataFrame]) -> DataFrame:
    """Spans of entries of any number: groups of up to `most` by the matcher, the others
    cut into narrower runs, where most entries are equal and so are one, and so on. Every
    step is settled, so plans stay small; `used` gathers the tables."""

    def keep(df: DataFrame) -> DataFrame:
        used.append(C.settle(df))
        return used[-1]

    sizes = entries.groupBy("anchor").agg(F.count("*").alias("size"))
    entries = keep(entries.join(sizes, "anchor"))
    spans = match_groups(entries.where(F.col("size") <= most), matcher)
    if not widths or not entries.where(F.col("size") > most).limit(1).count():
        return keep(spans)
    runs = keep(split(entries.where(F.col("size") > most), kind, k, widths[0]))
    one = runs.groupBy("anchor", "outer").agg(F.sum("n").alias("n"), F.min(F.struct("d", "mid", "p0", "p1", "part")).alias("r"))
    group = one.groupBy("anchor").agg(F.count("*").alias("kinds"))
    inner = one.join(group.where("kinds > 1"), "anchor").select("anchor", "outer", "n", "r.*")
    deeper = resolve(inner, kind, k, matcher, earlier_only, widths[1:], most, used)
    known = one.select("anchor", "outer", F.col("n").alias("total"), F.col("r.d").alias("least")).join(deeper, ["anchor", "outer"], "left")
    whole = F.col("d") > F.col("least") if earlier_only else F.col("total") > 1
    hits = runs.join(known, ["anchor", "outer"]).where(whole | (F.length("spans") > 0))
    hits = hits.select("a0", "o0", "mid", "p1", F.when(~whole, F.col("spans")).alias("spans")).groupBy("a0", "o0").agg(F.collect_list(F.struct("mid", "p1", "spans")).alias("found"))

    def join_up(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column("found").to_pylist():
                pairs = [np.array([-x["mid"], x["p1"] - x["mid"] + k], np.int32).tobytes() if x["spans"] is None else x["spans"] for x in found]
                out.append(b"".join(pairs))
            yield pa.RecordBatch.from_arrays([b.column("a0"), b.column("o0"), pa.array(out, pa.binary())], names=["anchor", "outer", "spans"])

    return keep(spans.unionByName(hits.mapInArrow(join_up, "anchor long, outer long, spans binary")))


def repeated(docs: DataFrame, kind: str, k: int, m: int, matcher: Matcher, earlier_only: bool, widths: tuple[int, ...], most: int, write_first: bool) -> DataFrame:
    """docs: (d, th, text). (d, th, found): for each row with repeats the spans in units that
    repeated windows cover. earlier_only: a window counts if it also starts in a row with a
    smaller d; otherwise if it starts anywhere else. most: entries (different surroundings) of
    one anchor that one task compares; widths: of the runs that entries of a larger group are
    cut into, ever narrower, the last 1. write_first: whether the runs are written before
    they are counted, or found a second time."""
    occ = occurrences(docs, kind, k, m)
    if write_first:
        occ = C.settle(occ)
    anchor = occ.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    found = C.settle(occ.join(anchor, "anchor"))
    if write_first:
        C.forget(occ)

    entry = found.groupBy("anchor", "outer").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "at")).alias("r"))
    group = entry.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("fewest"), F.min("r.d").alias("a"), F.max("r.d").alias("b"))
    group = group.where("size > 1 and " + ("a < b" if earlier_only else "fewest = 1")).select("anchor", "size")
    wanted = C.settle(entry.join(group, "anchor").select("anchor", "outer", "n", "size", "r.*"))
    fields = ["d", "th", "anchor", "outer", "n", "at"]
    used: list[DataFrame] = []
    spans = match_groups(cut(docs, wanted.where(F.col("size") <= most).select(*fields), kind, k, m), matcher)
    if wanted.where(F.col("size") > most).limit(1).count():
        hot = cut(docs, wanted.where(F.col("size") > most).select(*fields), kind, k, m).dropDuplicates(["anchor", "outer"])
        spans = spans.unionByName(resolve(hot, kind, k, matcher, earlier_only, widths, most, used))

    spans = C.settle(spans)
    known = entry.select("anchor", "outer", "n", F.col("r.d").alias("least")).join(spans, ["anchor", "outer"], "left").where("n > 1 or spans is not null")
    whole = F.col("d") > F.col("least") if earlier_only else F.col("n") > 1
    at = found.join(known, ["anchor", "outer"]).select("d", "th", "at", F.when(~whole, F.col("spans")).alias("spans"), whole.alias("whole"))
    at = at.where(F.col("whole") | (F.length("spans") > 0))
    done = C.settle(at.groupBy("d", "th").agg(F.collect_list(F.struct("at", "spans")).alias("found")))
    C.forget(found, wanted, spans, *used)
    return done


def covered(found: pa.ListArray, row: int, units: int, k: int) -> np.ndarray:
    """Which of a row's units its spans cover."""
    edge = np.zeros(units + 1, np.int64)
    spans = found[row].as_py() if found[row].is_valid else []
    if spans:
        mid, p0, p1 = unpack(np.array([s["at"] for s in spans]))
        pairs = [
            np.array([(p0[i], p1[i] + k)]) if s["spans"] is None else np.frombuffer(s["spans"], np.int32).reshape(-1, 2) + mid[i]
            for i, s in enumerate(spans)
        ]
        pairs = np.concatenate(pairs)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge)[:units] > 0
