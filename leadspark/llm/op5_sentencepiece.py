"""SentencePiece encoding by suffix-array matching, and decoding.

Texts are cut before runs of the space sign, where no piece reaches over; equal chunks
are encoded once and kept for later batches. The chunks of a batch are concatenated and
indexed by a suffix array (of character starts); each piece is looked up by binary
search, which gives its range of occurrences. The occurrences are edges from a start to
an end; sorted by position they are relaxed: while an edge spans exactly two symbols of
a chunk, the one with the best score (the leftmost of equal ones) makes them one. That
is byte-pair encoding as the SentencePiece library does it; characters that are no piece
fall back to bytes.

Defined results: a null or empty text has no ids; every row gives one row; further
columns are ignored; the space sign U+2581 itself is decoded as a space, as in the
library. The model's normaliser must be the identity with a dummy prefix, which the
model named in the query has.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

SIGN = "▁"
#: Chunks with their ids that a worker keeps.
KEPT = 400_000
#: Characters of new chunks that are indexed at once; their edges take some 200 bytes each.
AT_ONCE = 400_000
#: Longer chunks (in characters) are merged one by one from the same edges.
LONG = 64
_CHUNK = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")


class Pieces:
    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = np.zeros(256, np.uint32)
        normal, ids = [], []
        self.out: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.out.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                normal.append(p.encode())
                ids.append(i)
                self.out.append(p.replace(SIGN, " ").encode())
        order = sorted(range(len(normal)), key=normal.__getitem__)
        self.text = [normal[i] for i in order]
        self.id = np.array([ids[i] for i in order])
        self.size = np.array([len(t) for t in self.text])
        self.head = np.array([int.from_bytes(t[:8].ljust(8, b"\0"), "big") for t in self.text], np.uint64)
        self.tail = np.array([int.from_bytes(t[:8].ljust(8, b"\xff"), "big") for t in self.text], np.uint64)
        #: Of ids: 0 for the best score, equal for equal scores.
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        self.decoded = pa.array(self.out, pa.large_binary())
        self.cache: dict[str, bytes] = {}

    def edges(self, data: bytes, starts: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all occurrences of pieces, by way of the suffix array of
        `starts`; limit: where the chunk of each start ends."""
        padded = np.frombuffer(data + bytes(16), np.uint8)
        words = np.ndarray((len(data) + 9,), ">u8", padded, 0, (1,))
        high, low = words[starts].astype(np.uint64), words[starts + 8].astype(np.uint64)
        order = np.argsort(high)
        equal = np.diff(high[order]) == 0
        tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
        mine = order[tied]
        order[tied] = mine[np.lexsort((low[mine], high[mine]))]
        starts, limit, high, low = starts[order], limit[order], high[order], low[order]
        left, right = np.searchsorted(high, self.head, "left"), np.searchsorted(high, self.tail, "right")
        for i in np.flatnonzero((self.size > 8) & (right > left)).tolist():
            part = low[left[i] : right[i]]
            rest = self.text[i][8:16]
            a = np.searchsorted(part, np.uint64(int.from_bytes(rest.ljust(8, b"\0"), "big")), "left")
            b = np.searchsorted(part, np.uint64(int.from_bytes(rest.ljust(8, b"\xff"), "big")), "right")
            left[i], right[i] = left[i] + a, left[i] + b
        size = right - left
        piece = np.repeat(np.arange(len(self.text)), size)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size) + left[piece]
        start, end = starts[at], starts[at] + self.size[piece]
        ok = end <= limit[at]
        for i in np.flatnonzero((self.size[piece] > 16) & ok).tolist():
            ok[i] = data[start[i] : end[i]] == self.text[piece[i]]
        start, end, piece = start[ok], end[ok], piece[ok]
        order = np.argsort(start * (int(self.size.max(initial=0)) + 1) + (end - start))
        return start[order], end[order], self.id[piece[order]]

    def encode_new(self, chunks: list[str]) -> list[bytes]:
        coded = [c.encode() for c in chunks]
        data = b"".join(coded)
        raw = np.frombuffer(data, np.uint8)
        off = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.diff(np.searchsorted(starts, off))
        limit = np.repeat(off[1:], chars)
        start, end, piece = self.edges(data, starts, limit)
        n = len(raw)
        # Symbols as the place of the next one; at first each is a character.
        after = np.zeros(n + 1, np.int64)
        after[starts] = np.concatenate((starts[1:], [n]))
        live = np.zeros(n + 1, bool)
        live[starts] = True
        live[n] = True
        chunk = np.repeat(np.arange(len(coded)), np.diff(off))[start]
        name = np.full(n + 1, -1, np.int64)
        single = after[start] == end
        name[start[single]] = piece[single]
        wide = ~single
        start, end, piece, chunk = start[wide], end[wide], piece[wide], chunk[wide]
        long = chars[chunk] > LONG
        for c in np.unique(chunk[long]).tolist():
            mine = np.flatnonzero(chunk == c)
            self._one_by_one(start[mine], end[mine], piece[mine], int(off[c]), int(off[c + 1]), after, live, name)
        start, end, piece, chunk = start[~long], end[~long], piece[~long], chunk[~long]
        # The best of a chunk, and the leftmost of equal ones, has the least key.
        key = self.rank[piece] * (n + 1) + start
        while len(start):
            alive = np.flatnonzero(live[start] & live[end])
            start, end, piece, chunk, key = start[alive], end[alive], piece[alive], chunk[alive], key[alive]
            ready = np.flatnonzero((after[start] != end) & (after[np.minimum(after[start], n)] == end))
            if not len(ready):
                break
            c = chunk[ready]
            first = np.flatnonzero(np.diff(c, prepend=-1))
            least = np.minimum.reduceat(key[ready], first)
            best = ready[key[ready] == np.repeat(least, np.diff(np.append(first, len(c))))]
            best = best[np.diff(chunk[best], prepend=-1) > 0]
            live[after[start[best]]] = False
            after[start[best]] = end[best]
            name[start[best]] = piece[best]
        return self._ids(raw, off, live, after, name)

    def _one_by_one(self, start, end, piece, lo: int, hi: int, after, live, name) -> None:
        best = {(a, b): (-float(self.score[p]), int(p)) for a, b, p in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True)}
        nxt, prev = {}, {}
        at, last = lo, None
        while at < hi:
            nxt[at] = int(after[at])
            prev[at] = last
            last, at = at, nxt[at]
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < hi and (a, nxt[b]) in best:
                heapq.heappush(heap, (best[a, nxt[b]][0], a, nxt[b]))

        for a in list(nxt):
            offer(a)
        while heap:
            _, a, b = heapq.heappop(heap)
            if a not in nxt or nxt[a] >= hi or nxt[a] == b or nxt.get(nxt[a]) != b:
                continue
            gone = nxt.pop(a), prev[a]
            mid = gone[0]
            del nxt[mid]
            nxt[a] = b
            if b < hi:
                prev[b] = a
            live[mid] = False
            after[a] = b
            name[a] = best[a, b][1]
            offer(a)
            if prev[a] is not None:
                offer(prev[a])

    def _ids(self, raw, off, live, after, name) -> list[bytes]:
        symbols = np.flatnonzero(live[:-1])
        known = name[symbols] >= 0
        size = np.where(known, 1, after[symbols] - symbols)
        at = np.repeat(symbols, size)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.where(np.repeat(known, size), name[at], self.byte_id[raw[at + inside]]).astype("<u4")
        data = ids.tobytes()
        cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(symbols, off)] * 4
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CHUNK.findall(SIGN + t.replace(" ", SIGN)) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.cache))
        if new:
            if len(self.cache) + len(new) > KEPT:
                self.cache.clear()
                new = list(set().union(*cut))
            part: list[str] = []
            size = 0
            for i, chunk in enumerate(new, 1):
                part.append(chunk)
                size += len(chunk)
                if size >= AT_ONCE or i == len(new):
                    self.cache.update(zip(part, self.encode_new(part), strict=True))
                    part, size = [], 0
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        every = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        raw, off = C.buffers(self.decoded.take(pa.array(every)))
        cut = off[np.concatenate(([0], np.cumsum(size)))].tolist()
        data = raw.tobytes()
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            text = data[a:b].decode(errors="replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


_LOADED: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """Each worker loads a model once."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _column(docs: DataFrame, source: str, to: str, kind: str, arrow: pa.DataType, apply) -> DataFrame:
    names = [c for c in docs.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in C.all_pieces(batches, 1 << 21, source):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(apply(b.column(source).to_pylist()), arrow)], names=[*names, to])

    return docs.select(*names).mapInArrow(run, f"{schema}, `{to}` {kind}")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 32-bit) to rows with a text that is not null."""
    C.small_batches(docs.sparkSession)
    return _column(docs, "text", "ids", "binary", pa.binary(), lambda t: pieces(model).encode(t))


def decode(coded: DataFrame, model: str) -> DataFrame:
    """Adds `decoded` (text) to rows with `ids`."""
    return _column(coded, "ids", "decoded", "string", pa.string(), lambda x: pieces(model).decode(x))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, exact (whether decoding gives the text back). Encodes and
    decodes in one worker, so ids and decoded texts are not sent on."""
    C.small_batches(docs.sparkSession)
    rows = C.texts(docs)

    def run(batches) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in C.all_pieces(batches, 1 << 21):
            texts = b.column("text").to_pylist()
            ids = p.encode(texts)
            exact = [back == t.replace(SIGN, " ") for back, t in zip(p.decode(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(exact, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "exact"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, exact boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.documents(spark, sf_dir), model_path())


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
