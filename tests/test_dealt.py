"""Costly expressions on rows of one small file run in as many tasks as there are cores."""

import pytest

from leadspark.components import dealt
from leadspark.plans import lead_queries as L
from leadspark.plans.inputs import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [lambda s: table(s, SF, "raw"), lambda s: L._v1_rows(s, SF), lambda s: L._niche_rows(s, SF)])
def test_rows_of_one_file_reach_many_tasks(spark, rows):
    sizes = rows(spark).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism


def test_more_partitions_than_cores_stay(spark):
    many = spark.range(1000, numPartitions=50)
    assert dealt(many, "id").rdd.getNumPartitions() == 50
