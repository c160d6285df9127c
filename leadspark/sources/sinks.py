"""Tables that are written again without harm (IO8, IO9): a second write of the same rows changes nothing.

Both sinks replace whole partitions: they read the partitions that the new rows lie in, merge, settle the
merged rows, and overwrite just these partitions. The merged rows are settled because a task
that is run again must not read a partition that is already replaced. Of new rows with equal keys
the greatest stays; keys that are null are equal to each other. The columns must be those of
the table. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from leadspark.components import settle

c = F.col


def _stored(new: DataFrame, path: str, part: str) -> DataFrame | None:
    """The table's rows in the partitions that `new` lies in, with the columns of `new`; None without a table."""
    try:
        old = new.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if set(old.columns) != set(new.columns):
        raise ValueError(f"columns differ from those of the table: {sorted(set(old.columns) ^ set(new.columns))}")
    old = old.select(*(c(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in new.schema))
    return old.join(new.select(part).distinct(), part, "left_semi")


def _once(new: DataFrame, keys: list[str]) -> DataFrame:
    return new.groupBy(*keys).agg(F.max(F.struct(*(f"`{x}`" for x in new.columns))).alias("row")).select("row.*")


def _replace(rows: DataFrame, path: str, part: str) -> None:
    # A partition is a few files; a large one is split.
    rows.hint("rebalance", c(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_daily(new: DataFrame, path: str, keys: list[str], day: str = "day") -> None:
    """IO9: snapshot rows by day and keys; new ones take the place of old ones, other rows of their days stay.
    Days must not be null."""
    new = settle(_once(new, [day, *keys]))
    if new.where(c(day).isNull()).limit(1).count():
        raise ValueError("a snapshot needs a day")
    old = _stored(new, path, day)
    if old is not None:
        a, b = old.alias("a"), new.select(day, *keys).alias("b")
        same = [c(f"a.{k}").eqNullSafe(c(f"b.{k}")) for k in keys]
        new = settle(a.join(b, [c(f"a.{day}") == c(f"b.{day}"), *same], "left_anti").unionByName(new))
    _replace(new, path, day)


def write_mirror(new: DataFrame, path: str, key: str, buckets: int) -> Row:
    """IO8: rows by key, with new values over the old ones (nulls leave them). Returns (updated, appended).
    The table lies in buckets of hashed keys, and only those with a new row are written; `buckets` is the
    same for all writes of a table."""
    new = settle(_once(new, [key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    old = _stored(new, path, "bucket")
    if old is None:
        counts = new.agg(F.lit(0).alias("updated"), F.count("*").alias("appended"))
        merged = new
    else:
        a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
        both = a.join(b, [c("a.bucket") == c("b.bucket"), c(f"a.{key}").eqNullSafe(c(f"b.{key}"))], "full_outer")
        merged = settle(both.select(*(F.coalesce(f"b.{x}", f"a.{x}").alias(x) for x in new.columns), "_old", "_new"))
        counts = merged.where("_new").agg(F.count("_old").alias("updated"), F.count(F.when(c("_old").isNull(), 1)).alias("appended"))
        merged = merged.drop("_old", "_new")
    out = counts.first()
    _replace(merged, path, "bucket")
    return out
