import random

from pyspark.sql import functions as F

from leadspark.operators.ranking import with_place


def test_places_across_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, id int").repartition(7)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = {x.id: x.place for x in with_place(df, ["g"], [F.col("score").desc_nulls_last(), F.col("id").asc()]).collect()}
    finally:
        spark.conf.unset(key)
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[x[2]] for x in mine] == list(range(1, len(mine) + 1))
    assert with_place(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0
