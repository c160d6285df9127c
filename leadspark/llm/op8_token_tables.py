"""Token ids in sorted-string-table shards.

Documents are dealt by ranges of doc_id and sorted; each task writes its documents into
shards in the shared folder. A shard holds blocks of about `BLOCK` bytes; a block's keys
(doc_id, and a number among rows of one doc_id) share prefixes with the key before, and
the block is compressed. After the blocks come a sparse index (last key, place and size
of each block), a Bloom filter of the doc_ids, and a footer of fixed size. A shard gets
a new name on each attempt, and only the names that tasks return are read, so a lost
executor or a repeated task leaves at most an unused file.

Defined results: a null text is empty and holds the end id only; rows of one doc_id stand
in order of their text hash; a null doc_id is the smallest id and stays null; further
columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.llm import common as C

END_ID = 2
BLOCK = 1 << 18
SHARD = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"IDTABLE1"
FOOTER = struct.Struct("<QQQQQQ8s")
#: Chunks with their ids that a worker keeps.
KEPT = 1_400_000

# White space as the tokenizer's pattern has it. A chunk is a word with the one space
# before it, or the white space before that; the pattern never reaches over its edges.
_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class Encoder:
    """Of the tokenizers library; equal chunks are encoded once and kept."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CHUNK.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self.cache))
        if new:
            if len(self.cache) + len(new) > KEPT:
                self.cache.clear()
                new = list(set().union(*cut))
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.cache.update(zip(part, self._library(part), strict=True))
        get = self.cache.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        for i in odd:
            out[i] = self._library([texts[i]])[0]
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def key_of(doc_id: int, number: int = 0) -> bytes:
    """Bytes in the order of (doc_id, number)."""
    return struct.pack(">QI", doc_id + 2**63, number)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(doc_id: int, bits: int) -> list[int]:
    h = C.mix(np.array([doc_id & (2**64 - 1), (doc_id + 1) & (2**64 - 1)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    a, b = int(h[0]), int(h[1]) | 1
    return [((a + i * b) & (2**64 - 1)) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, filesystem, path: str) -> None:
        self.path = path
        self.file = filesystem.open_output_stream(path)
        self.press = zstandard.ZstdCompressor(level=3)
        self.block, self.last, self.raw = [], b"", 0
        self.index: list[bytes] = []
        self.ids: list[int] = []
        self.at = self.n_docs = self.n_ids = 0
        self.first = None

    def add(self, doc_id: int, number: int, ids: bytes) -> None:
        key = key_of(doc_id, number)
        self.first = doc_id if self.first is None else self.first
        same = 0
        while same < len(self.last) and self.last[same] == key[same]:
            same += 1
        rest = key[same:]
        self.block += [bytes((same, len(rest))), rest, _varint(len(ids)), ids]
        self.raw += len(ids) + len(rest) + 4
        self.last = key
        self.ids.append(doc_id)
        self.n_docs += 1
        self.n_ids += len(ids) // 4
        if self.raw >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.press.compress(b"".join(self.block))
            self.file.write(data)
            self.index.append(self.last + struct.pack("<QQ", self.at, len(data)))
            self.at += len(data)
            self.block, self.last, self.raw = [], b"", 0

    def close(self) -> tuple:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.ids))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for d in set(self.ids):
            for p in _bloom_places(d, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.file.write(index)
        self.file.write(bloom.tobytes())
        self.file.write(FOOTER.pack(self.at, len(index), bits, self.n_docs, self.n_ids, END_ID, MAGIC))
        self.file.close()
        return self.path, self.first, self.n_docs, self.n_ids


class Shard:
    """Reads a shard; a lookup reads the footer, the index, the filter and one block."""

    def __init__(self, uri: str) -> None:
        filesystem, path = fs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        at, index, bits, self.n_docs, self.n_ids, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token table")
        self.bits = bits
        raw = self._read(at, index)
        self.bloom = np.frombuffer(self._read(at + index, (bits + 7) // 8), np.uint8)
        self.keys = [raw[i : i + 12] for i in range(0, len(raw), 28)]
        self.places = [struct.unpack("<QQ", raw[i + 12 : i + 28]) for i in range(0, len(raw), 28)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[int, bytes]]:
        data = zstandard.ZstdDecompressor().decompress(self._read(*self.places[i]))
        at, key = 0, b""
        while at < len(data):
            same, rest = data[at], data[at + 1]
            key = key[:same] + data[at + 2 : at + 2 + rest]
            size, at = _read_varint(data, at + 2 + rest)
            yield struct.unpack(">QI", key)[0] - 2**63, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def lookup(self, doc_id: int) -> list[bytes]:
        """The ids of each row of the document; none if the shard has no such document."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(doc_id, self.bits)):
            return []
        out = []
        i = bisect.bisect_left(self.keys, key_of(doc_id))
        while i < len(self.places):
            rows = list(self.block(i))
            out += [v for d, v in rows if d == doc_id]
            if not rows or rows[-1][0] != doc_id:
                break
            i += 1
        return out


def write_tables(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes shards below `folder` (a URI that all machines share). (path, first, n_docs,
    n_ids, start) of each; start: the ids in all shards before."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = C.keyed(docs).repartitionByRange("d").sortWithinPartitions("d", "th")

    def run(batches) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        done, shard, last, number = [], None, None, 0
        end = struct.pack("<I", END_ID)
        for b in C.all_pieces(batches, 1 << 22):
            coded = encoder(tokenizer).encode(b.column("text").to_pylist())
            for d, ids in zip(b.column("d").to_pylist(), coded, strict=True):
                number = number + 1 if d == last else 0
                if shard is not None and shard.at >= SHARD and d != last:
                    done.append(shard.close())
                    shard = None
                if shard is None:
                    shard = ShardWriter(filesystem, f"{base}/{uuid.uuid4().hex}.idt")
                shard.add(d, number, ids + end)
                last = d
        if shard is not None:
            done.append(shard.close())
        scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
        yield pa.RecordBatch.from_arrays(
            [pa.array([scheme + x[0] for x in done], pa.string()), *(pa.array([x[i] for x in done], pa.int64()) for i in (1, 2, 3))], names=["path", "first", "n_docs", "n_ids"]
        )

    shards = C.settle(rows.mapInArrow(run, "path string, first long, n_docs long, n_ids long"))
    # One row for each shard of 64 MB.
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tables(shards: DataFrame) -> DataFrame:
    """(d, start, ids) of every document, from the files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                for i in range(len(shard.places)):
                    d, ids = zip(*shard.block(i), strict=True)
                    size = np.array([len(x) // 4 for x in ids])
                    starts = start + np.cumsum(size) - size
                    start += int(size.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(starts), pa.array(ids, pa.binary())], names=["d", "start", "ids"])

    # A task for each shard or two: the rows are few, but each stands for a file.
    return shards.select("path", "start").repartition(max(1, shards.count()), "path").mapInArrow(run, "d long, start long, ids binary")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_dir(spark)}/token-tables-{uuid.uuid4().hex}"
    shards = write_tables(C.documents(spark, sf_dir), tokenizer_path(), folder)
    out = read_tables(shards)
    return out.select(C.doc_id_back(), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_tables": op8_token_tables}
ORACLES: dict[str, str] = {}
