import pytest

from leadspark.sources import sinks as K

DAYS = "day string, campaign string, state string, n long"


def rows(spark, path, *columns):
    return sorted(map(repr, (tuple(r) for r in spark.read.parquet(path).select(*columns).collect())))


def test_days_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "daily")
    write = lambda *r: K.write_daily(spark.createDataFrame(list(r), DAYS), path, ["campaign", "state"])
    write(("1996-03-13", "a", None, 1), ("1996-03-13", None, None, 2), ("1996-03-14", "a", "CA", 3))
    new = [("1996-03-13", None, None, 9), ("1996-03-13", None, None, 8), ("1996-03-15", "b", "TX", 4)]
    other = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "daily" / "day=1996-03-14").iterdir()}
    want = sorted(map(repr, [("a", None, 1), (None, None, 9), ("a", "CA", 3), ("b", "TX", 4)]))
    for _ in range(2):
        write(*new)
        assert rows(spark, path, "campaign", "state", "n") == want
    write()
    assert rows(spark, path, "campaign", "state", "n") == want
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "daily" / "day=1996-03-14").iterdir()} == other


def test_days_refuse_nulls_and_other_columns(spark, tmp_path):
    path = str(tmp_path / "daily")
    with pytest.raises(ValueError):
        K.write_daily(spark.createDataFrame([(None, "a", "b", 1)], DAYS), path, ["campaign"])
    K.write_daily(spark.createDataFrame([("d", "a", "b", 1)], DAYS), path, ["campaign"])
    with pytest.raises(ValueError):
        K.write_daily(spark.createDataFrame([("d", "a", 1)], "day string, campaign string, n long"), path, ["campaign"])


def test_mirror_counts_and_keeps(spark, tmp_path):
    path = str(tmp_path / "mirror")
    write = lambda *r: tuple(K.write_mirror(spark.createDataFrame(list(r), "k string, a string, l array<string>"), path, "k", 4))
    assert write(("1", "x", ["p"]), ("2", "y", None), (None, "n", None)) == (0, 3)
    assert write(("2", None, ["q"]), ("3", "z", None), (None, "m", None)) == (2, 1)
    want = sorted(map(repr, [("1", "x", ["p"]), ("2", "y", ["q"]), ("3", "z", None), (None, "m", None)]))
    assert rows(spark, path, "k", "a", "l") == want
    assert write(("2", None, ["q"]), ("3", "z", None), (None, "m", None)) == (3, 0)
    assert rows(spark, path, "k", "a", "l") == want
    assert write() == (0, 0)
