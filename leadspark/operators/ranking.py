"""Places in an order within groups of any size, without a group in one task (T4, T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import settle

c = F.col


def with_place(rows: DataFrame, groups: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row in its group; the order should be total, equal rows are told apart
    by chance. Rows are dealt by ranges of (groups, order), so a large group lies in many ranges:
    a place is the rows of the group in earlier ranges, a sum over one count a range, plus the
    place inside the range. Nulls in a group are a group."""
    dealt = settle(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(*(c(g).alias(f"_g{i}") for i, g in enumerate(groups)), c("_range").alias("_r"), "_before")
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)))
    same = c("_range") == c("_r")
    for i, g in enumerate(groups):
        same = same & c(g).eqNullSafe(c(f"_g{i}"))
    return inside.join(offsets, same).withColumn(name, (c("_before") + c("_at")).cast("int")).select(*rows.columns, name)
