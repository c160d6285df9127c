"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: White space that separates words, in every operator that counts words.
SPACE = " \t\n\x0b\x0c\r"
#: A null doc_id takes part as the smallest id and is null again in the result.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the input's rows; a null text is empty."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(d, th, text): d is doc_id, an integer, with null as the smallest id; th a hash of the
    text, so that (d, th) names a row up to exact repetition."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}: ids are compared as numbers")
    rows = texts(docs)
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64("text").alias("th"),
        "text",
    )


def doc_id_back(col: str = "d") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it
    is unset, a folder of this machine if Spark runs in one process, else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written as a table in the shared folder and read from
    there. The tables of an application share one folder, removed when the driver ends.
    The collection lets Spark's cleaner drop the shuffle files that the table replaces."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/settled-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    drop_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if _IN_STAGE:
        _OF_STAGES.append(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that no later job reads."""
    for t in tables:
        _remove(t.sparkSession, t.settled_at)
        if t.settled_at in _OF_STAGES:
            _OF_STAGES.remove(t.settled_at)


def begin_stage(docs: DataFrame) -> None:
    """Removes what earlier stages of a pipeline have settled, but for the table docs itself."""
    stay = getattr(docs, "settled_at", None)
    for path in [p for p in _OF_STAGES if p != stay]:
        _remove(docs.sparkSession, path)
        _OF_STAGES.remove(path)
    drop_shuffles(docs.sparkSession)


def stage(f: Callable) -> Callable:
    """A stage of a pipeline: what it settles goes when the next stage begins. Its result
    must be written before that."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_stage(docs)
        _IN_STAGE.append(f.__name__)
        try:
            return f(spark, docs, sf_dir)
        finally:
            _IN_STAGE.pop()

    return run


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_FOLDERS: set[str] = set()
_IN_STAGE: list[str] = []
_OF_STAGES: list[str] = []


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder stays for the cluster's clean-up
        pass


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the Arrow batches that Python workers hold: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind, len(col) + 1, col.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about `most` bytes of text (or one row)."""
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def all_pieces(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from pieces(batch, most, column)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words of every row, and the offsets of rows in words."""
    n = len(raw)
    inside = np.ones(n + 1, bool)
    inside[:n] = ~_IS_SPACE[raw]
    inside[n] = False
    first = np.zeros(n + 1, bool)
    first[off] = True  # a row's first byte never goes on with the row before
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (first | ~before))
    stop_here = before & (first | ~inside)
    end = np.flatnonzero(stop_here)
    return start, end, np.searchsorted(start, off)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 2**64))
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, b in enumerate((_B, _B_INV)):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any block of a sequence of 64-bit units, from prefix sums mod 2**64."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(units * power[:n], out=self.prefix[1:])

    def blocks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, m: int) -> np.ndarray:
        n = len(self.prefix) - m
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[m:] - self.prefix[:-m]) * self.inverse[:n])


def byte_units(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    return mix(Rolling(_TABLE[raw]).blocks(start, end) + (end - start).astype(np.uint64))


def runs(flags_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags_at.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
