"""Periodic runs of words: maximal stretches that repeat with a smallest period.

A suffix automaton takes the words of a text one by one. Its suffix links form a tree kept
by link-cut access: each preferred path has one colour, the place where its strings ended
last. A new word accesses the path of its own suffixes. Where the path enters a segment
with the colour j and the greatest length l, the last l words equal those that end at j and
no longer ones do; so l = i - j means that a square is complete just here whose left end
cannot move, and every run is met once, at its first square. Its right end is then found by
comparing words at that distance. Recolouring costs O(log n) segments a word (amortised).

Only stretches that can hold a run of `SHORTEST` words reach the automaton: a run repeats
some `GRAM` words (half of SHORTEST) at each of its words inside itself, so words outside
all repeated grams of a stretch cut it, until nothing changes. Words are compared
themselves there, hashes only leave stretches out.

Defined results: a null or empty text has no words, no run and an empty collapsed text;
text between words is dropped and one space put in its place; equal words are equal bytes
(no folding of case); ties of length go to the smallest start, then period; ids may have any
type, be null or repeat, each row is a text of its own; a text without an id is not damaged
in the query; texts of any length are taken whole in one task; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadspark.llm import common as C

c = F.col
SHORTEST = 12
GRAM = SHORTEST // 2

Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of words with its link tree in paths of one colour.

    State 0 is the root and stands for "none" in the splay trees, of which it is no part.
    In a splay tree the deeper states of a path are to the right; the colour of a path is
    kept at the root of its tree, whose parent is the link of the path's topmost state.
    """

    def __init__(self) -> None:
        self.size, self.link, self.to = [0], [-1], [{}]
        self.left, self.right, self.up, self.colour = [0], [0], [0], [-1]
        self.last, self.n = 0, 0

    def _state(self, size: int, link: int, to: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.to.append(to)
        self.left.append(0)
        self.right.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        """Makes x the root of its tree; the colour moves with the root."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            p = up[x]
            if p == 0:
                return
            at_left = left[p] == x
            if not at_left and right[p] != x:
                return
            g = up[p]
            p_left = g != 0 and left[g] == p
            if g != 0 and (p_left or right[g] == p):
                above = g
                g_up = up[g]
                g_left = g_up != 0 and left[g_up] == g
                g_right = g_up != 0 and right[g_up] == g
                if p_left:
                    if at_left:  # both to the left: p over g, then x over p
                        b, d = right[x], right[p]
                        left[g], right[p], left[p], right[x] = d, g, b, p
                        if d:
                            up[d] = g
                        if b:
                            up[b] = p
                        up[g], up[p] = p, x
                    else:
                        a, b = left[x], right[x]
                        right[p], left[g], left[x], right[x] = a, b, p, g
                        if a:
                            up[a] = p
                        if b:
                            up[b] = g
                        up[p] = up[g] = x
                elif at_left:
                    a, b = left[x], right[x]
                    right[g], left[p], left[x], right[x] = a, b, g, p
                    if a:
                        up[a] = g
                    if b:
                        up[b] = p
                    up[p] = up[g] = x
                else:
                    b, d = left[x], left[p]
                    right[g], left[p], right[p], left[x] = d, g, b, p
                    if d:
                        up[d] = g
                    if b:
                        up[b] = p
                    up[g], up[p] = p, x
                up[x] = g_up
                if g_left:
                    left[g_up] = x
                elif g_right:
                    right[g_up] = x
                else:
                    colour[x] = colour[above]
                    return
            else:  # p is the root
                if at_left:
                    b = right[x]
                    left[p], right[x] = b, p
                else:
                    b = left[x]
                    right[p], left[x] = b, p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
                colour[x] = colour[p]
                return

    def append(self, word: int) -> list[int]:
        """Takes one word; the periods of the runs whose first square it completes."""
        size, link, to = self.size, self.link, self.to
        left, right, up, colour = self.left, self.right, self.up, self.colour
        i, last = self.n, self.last
        self.n = i + 1
        new = self._state(size[last] + 1, 0, {})
        p = last
        while p != -1 and word not in to[p]:
            to[p][word] = new
            p = link[p]
        if p != -1:
            q = to[p][word]
            if size[p] + 1 != size[q]:
                twin = self._state(size[p] + 1, link[q], dict(to[q]))
                while p != -1 and to[p].get(word) == q:
                    to[p][word] = twin
                    p = link[p]
                link[q] = twin
                # The twin has ended where q has: it joins q's path just above q.
                self._splay(q)
                above = left[q]
                left[twin] = above
                if above:
                    up[above] = twin
                left[q], up[twin] = twin, q
                q = twin
            link[new] = up[new] = q
        self.last = new
        found = []
        x, below = up[new], new
        while x:
            self._splay(x)
            j = colour[x]
            if size[x] == i - j:
                found.append(i - j)
            deeper = right[x]
            if deeper:
                colour[deeper] = j
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        self._splay(new)
        return found


def runs(words: list[int], shortest: int = SHORTEST) -> list[Run]:
    """(start, length, period) of the runs of a sequence of at least `shortest` words, by start, then period."""
    automaton = Automaton()
    n = len(words)
    out = []
    for i, word in enumerate(words):
        for period in automaton.append(word):
            end = i + 1
            while end < n and words[end] == words[end - period]:
                end += 1
            start = i + 1 - 2 * period
            if end - start >= shortest:
                out.append((start, end - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words (by hash, of all rows) outside of which there is no run: each place
    lies in a gram that occurs twice in its stretch."""
    grams = C.Rolling(words).grams(GRAM)
    home = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(grams))
    at = at[home[: len(grams)] == home[GRAM - 1 :][: len(grams)]] if len(grams) else at
    part = home
    while len(at):
        key = C.mix(grams[at] + part[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if twice.all():
            break
        at = at[twice]
        # A stretch goes on while the next gram begins at or before the word after the last one, in the same row.
        new = np.concatenate(([True], (np.diff(at) > GRAM) | (home[at[1:]] != home[at[:-1]]))) if len(at) else np.zeros(0, bool)
        part = np.zeros(len(words), np.int64)
        part[at] = np.cumsum(new)
    if not len(at):
        return []
    new = np.concatenate(([True], part[at[1:]] != part[at[:-1]]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    out = np.stack((at[first], at[last] + GRAM), 1)
    return [(a, b) for a, b in out.tolist() if b - a >= SHORTEST]


def runs_of_rows(raw: np.ndarray, off: np.ndarray) -> tuple[list[list[Run]], list[bytes]]:
    """Runs and the collapsed text of every row (UTF-8)."""
    start, end, woff = C.word_bounds(raw, off)
    hashes = C.word_hashes(raw, start, end)
    data = raw.tobytes()
    found: list[list[Run]] = [[] for _ in range(len(off) - 1)]
    for a, b in stretches(hashes, woff):
        row = int(np.searchsorted(woff, a, "right")) - 1
        ids: dict[bytes, int] = {}
        words = [ids.setdefault(data[x:y], len(ids)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
        shift = a - int(woff[row])
        found[row] += [(s + shift, n, p) for s, n, p in runs(words)]
    collapsed = []
    for row, mine in enumerate(found):
        words = data[off[row] : off[row + 1]].split()
        if mine:
            kept = np.ones(len(words), bool)
            for s, n, p in mine:
                kept[s + p : s + n] = False
            words = [words[k] for k in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(words))
    return found, collapsed


def find_runs(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). (doc_id, runs, collapsed): the runs (start, length, period) by start,
    then period, and the text without the repeated periods."""
    C.small_batches(docs.sparkSession)
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 21):
            found, collapsed = runs_of_rows(*C.buffers(b.column("text")))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends), struct)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists.cast(arrow.field("runs").type), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=arrow)

    return C.texts(docs).mapInArrow(go, schema)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by the checksum of the id, the words from some
    place on repeat with a period."""
    h = F.crc32(c("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = C.texts(docs).withColumn("h", h).withColumn("words", F.when(c("h") % 10 == 0, words))
    g, n = F.floor(c("h") / 10), F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - c("a")) / (3 + g % 8)))
    again = F.transform("words", lambda w, i: F.when(i < c("a"), w).otherwise(F.get("words", (c("a") + (i - c("a")) % c("p")).cast("int"))))
    return rows.select("doc_id", F.when(c("a").isNotNull(), F.concat_ws(" ", again)).otherwise(c("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(made_periodic(C.documents(spark, sf_dir)))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    out = out.withColumn("best", longest)
    length = -c("best.least")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), c("best.start").alias("start"), length.alias("length"), c("best.period").alias("period"),
        F.floor(1000 * length / c("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
