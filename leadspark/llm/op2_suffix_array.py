"""Removal of byte strings that occur more than once, by sorted suffixes.

Two-stage sorting of a group of entries: suffixes smaller than their successor are
sorted directly; each larger one is placed from its successor by a scan of the
first-byte buckets in order; then common prefixes of neighbours tell the windows
that occur again. `repeats` finds the groups and spreads the work.

Defined results: a null text is empty; texts below the length lose nothing; exactly
repeated rows count as two occurrences; a null doc_id stays null; further columns of
the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import repeats as R

LENGTH = 400
GRAM = 64
#: Entries whose suffixes are sorted together; a group with more is cut into runs of windows.
ENTRIES = 256
#: Windows in the runs that entries of larger groups are cut into.
WIDTHS = (32, 1)


def suffix_order(data: np.ndarray, seg: np.ndarray, since: np.ndarray, upto: np.ndarray, depth: int) -> np.ndarray:
    """Places in suffix order, comparing at least `depth` bytes. seg: offsets of the
    segments; a suffix ends with its segment. since, upto: the first place of each segment
    that is asked for and the one after the last; what follows serves only as tail."""
    n = len(data)
    end = np.repeat(seg[1:], np.diff(seg))
    place = np.arange(n)
    last = place == end - 1
    nxt = np.minimum(place + 1, n - 1)
    # A suffix is small if its next different byte is larger; the end is smallest.
    differs = last | (data != data[nxt])
    stop = np.flatnonzero(differs)[np.searchsorted(np.flatnonzero(differs), place)]
    small = ~last[stop] & (data[stop] < data[np.minimum(stop + 1, n - 1)])
    # Places asked for, and what follows up to the next small suffix or the end.
    size = np.diff(seg)
    asked = (place < np.repeat(seg[:-1] + upto, size)) & (place >= np.repeat(seg[:-1] + since, size))
    small_at = np.flatnonzero(small | last)
    need = asked.copy()
    tail = np.minimum(seg[:-1] + upto, seg[1:] - 1)
    nearest = small_at[np.minimum(np.searchsorted(small_at, tail), len(small_at) - 1)]
    nearest = np.minimum(nearest, seg[1:] - 1)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, tail, 1)
    np.add.at(mark, nearest + 1, -1)
    need |= np.cumsum(mark)[:n] > 0

    raw = data.tobytes()
    ends = end.tolist()
    # First stage: direct sort of the small ones.
    direct = sorted(np.flatnonzero(small & need).tolist(), key=lambda p: raw[p : min(p + depth, ends[p])])
    direct = np.array(direct, np.int64)
    dbyte = data[direct]
    # Second stage: scan the buckets of first bytes in order. The end of a segment comes
    # before every byte, so the last places of segments open the larger part of a bucket.
    large = need & ~small
    ahead: list[list[np.ndarray]] = [[] for _ in range(256)]
    open_at = np.flatnonzero(last & large)
    for b in np.unique(data[open_at]).tolist():
        ahead[b].append(open_at[data[open_at] == b])
    out = []

    def hand_on(found: np.ndarray, b: int) -> np.ndarray:
        """Gives the larger predecessors of sorted places to their buckets; those of bucket b come back."""
        before = found - 1
        ok = (before >= 0) & (found > 0)
        before = before[ok]
        before = before[large[before] & (end[before] == end[found[ok]])]
        pb = data[before]
        same = before[pb == b]
        rest, rb = before[pb > b], pb[pb > b]
        if len(rest):
            order = np.argsort(rb, kind="stable")
            rest, rb = rest[order], rb[order]
            at = np.flatnonzero(np.concatenate(([True], rb[1:] != rb[:-1])))
            for x, part in zip(rb[at].tolist(), np.split(rest, at[1:]), strict=True):
                ahead[x].append(part)
        return same

    for b in range(256):
        now = np.concatenate(ahead[b]) if ahead[b] else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = hand_on(now, b)
        mine = direct[dbyte == b]
        if len(mine):
            out.append(mine)
            hand_on(mine, b)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefix(data: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to depth, in steps of eight bytes at first."""
    length = np.zeros(len(a), np.int64)
    room = np.minimum(np.minimum(end[a] - a, end[b] - b), depth)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
    live = np.arange(len(a))
    while len(live):
        at = length[live]
        go = (at + 8 <= room[live]) & (words[np.minimum(a[live] + at, len(data))] == words[np.minimum(b[live] + at, len(data))])
        live = live[go]
        length[live] += 8
    live = np.flatnonzero(length < room)
    while len(live):
        at = length[live]
        live = live[data[a[live] + at] == data[b[live] + at]]
        length[live] += 1
        live = live[length[live] < room[live]]
    return length


def match_suffixes(entries: list[tuple], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans, relative to the anchor, of each entry's windows that another entry of its
    group holds, or that stand for more than one place."""
    parts = [e[7] for e in entries]
    seg = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    p0 = np.array([e[5] for e in entries])
    p1 = np.array([e[6] for e in entries])
    order = suffix_order(data, seg, p0, p1 + 1, length)
    entry = np.searchsorted(seg, order, "right") - 1
    mine = (order >= seg[entry] + p0[entry]) & (order <= seg[entry] + p1[entry])
    order, entry = order[mine], entry[mine]
    out: list[list[tuple[int, int]]] = [[] for _ in entries]
    if len(order) < 1:
        return out
    end = np.repeat(seg[1:], np.diff(seg))
    same = common_prefix(data, end, order[:-1], order[1:], length) >= length
    run = np.concatenate(([0], np.cumsum(~same)))
    name = np.array([e[0] for e in entries])
    group = np.unique(name, return_inverse=True)[1][entry]
    weight = np.array([e[3] for e in entries])[entry]
    key = run * (group.max() + 1) + group
    kinds, at = np.unique(key, return_inverse=True)
    again = np.bincount(at, weights=weight, minlength=len(kinds))[at] > 1
    hits = np.sort(order[again])
    who = np.searchsorted(seg, hits, "right") - 1
    mid = np.array([e[4] for e in entries])
    if len(hits):
        new = np.concatenate(([True], (np.diff(hits) > length) | (np.diff(who) > 0)))
        first = np.flatnonzero(new)
        final = np.concatenate((first[1:], [len(hits)])) - 1
        for f, t in zip(first.tolist(), final.tolist(), strict=True):
            e = int(who[f])
            base = int(seg[e] + mid[e])
            out[e].append((int(hits[f]) - base, int(hits[t]) + length - base))
    return out


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text, kept (binary: the bytes left), n_bytes, n_removed, n_spans of every row."""
    C.small_batches(docs.sparkSession)
    rows = C.keyed(docs)
    found = R.repeated(rows, "bytes", length, gram, lambda e: match_suffixes(e, length), False, WIDTHS, ENTRIES, True)
    both = rows.join(found, ["d", "th"], "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, gone, spans = [], [], [], []
            lists = b.column("found")
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = text.encode()
                size.append(len(raw))
                if lists[i].is_valid:
                    cover = R.covered(lists, i, len(raw), length)
                    kept.append(np.frombuffer(raw, np.uint8)[~cover].tobytes())
                    gone.append(int(cover.sum()))
                    spans.append(len(C.runs(cover)[0]))
                else:
                    kept.append(raw)
                    gone.append(0)
                    spans.append(0)
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("text"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, spans))],
                names=["d", "text", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    done = both.mapInArrow(run, "d long, text string, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.select(C.doc_id_back(), "text", "kept", "n_bytes", "n_removed", "n_spans")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLES: dict[str, str] = {}
