"""Removal of word windows that an earlier document already holds, by suffix automata.

The reference side of a group (one anchor of `repeats`) is a bounded shard: a suffix
automaton of its word sequences, grown in ascending document order. Each sequence is
streamed through the automaton of the earlier documents; its matching statistics give
the maximal spans of at least `WORDS` words. Shards travel by shuffle, not by broadcast:
all documents are references, so no bound on a broadcast would hold.

Defined results: a null text has no words; texts below the length lose nothing; rows
with one doc_id are one document; a null doc_id is smallest and stays null; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C
from leadspark.llm import repeats as R

WORDS = 13
GRAM = 4
#: Sequences in a shard; a group with more is cut into runs of windows.
SHARD = 2048
#: Windows in the runs that sequences of larger groups are cut into.
WIDTHS = (5, 1)


class SuffixAutomaton:
    """Of several sequences of words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        to = nxt[last].get(w)
        if to is not None:
            if length[to] == length[last] + 1:
                return to
            return self._clone(last, w, to)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest suffix of the words so far that occurs."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(w)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def match_automaton(entries: list[tuple], least: int = WORDS) -> list[list[tuple[int, int]]]:
    """Spans, relative to the anchor, of at least `least` words that an entry of a
    smaller document of the group holds. Entries come in order of group, then d."""
    out: list[list[tuple[int, int]]] = []
    at = 0
    while at < len(entries):
        group = entries[at][0]
        shard, pending, d = SuffixAutomaton(), [], None
        while at < len(entries) and entries[at][0] == group:
            e = entries[at]
            if e[2] != d:
                for words in pending:
                    shard.add(words)
                pending, d = [], e[2]
            words = e[7].split(b" ")
            spans: list[tuple[int, int]] = []
            if len(shard.next) > 1:
                for i, size in enumerate(shard.matching(words)):
                    if size >= least:
                        lo, hi = i - size + 1 - e[4], i + 1 - e[4]
                        while spans and spans[-1][1] >= lo:
                            lo = min(lo, spans.pop()[0])
                        spans.append((lo, hi))
            out.append(spans)
            pending.append(words)
            at += 1
    return out


def substring_dedup(docs: DataFrame, least: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, text, kept (words joined by one space), n_words, n_removed of every row."""
    C.small_batches(docs.sparkSession)
    rows = C.keyed(docs)
    found = R.repeated(rows, "words", least, gram, lambda e: match_automaton(e, least), True, WIDTHS, SHARD, False)
    both = rows.join(found, ["d", "th"], "left")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, R.AT_ONCE):
            raw, off = C.buffers(b.column("text"))
            start, end, woff = C.word_bounds(raw, off)
            data = raw.tobytes()
            lists = b.column("found")
            kept, size, gone = [], np.diff(woff), []
            for i in range(b.num_rows):
                x, y = int(woff[i]), int(woff[i + 1])
                pairs = zip(start[x:y].tolist(), end[x:y].tolist(), strict=True)
                if lists[i].is_valid:
                    cover = R.covered(lists, i, y - x, least)
                    gone.append(int(cover.sum()))
                    kept.append(b" ".join([data[s:e] for (s, e), c in zip(pairs, cover.tolist(), strict=True) if not c]).decode())
                else:
                    gone.append(0)
                    kept.append(b" ".join([data[s:e] for s, e in pairs]).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("text"), pa.array(kept, pa.string()), pa.array(size.astype(np.int64)), pa.array(gone, pa.int64())],
                names=["d", "text", "kept", "n_words", "n_removed"],
            )

    done = both.mapInArrow(run, "d long, text string, kept string, n_words long, n_removed long")
    return done.select(C.doc_id_back(), "text", "kept", "n_words", "n_removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES: dict[str, str] = {}
