from pathlib import Path

from pyspark.sql import functions as F

from fleetspan.operators import sizing


def test_released_tables_are_gone(spark):
    table = sizing.written_table(spark.range(5))
    (path,) = {f.removeprefix("file:").rsplit("/", 1)[0] for f in table.inputFiles()}
    before = sizing.generation(spark)
    assert Path(path).is_dir() and sizing.release_tables(spark) >= 1
    assert not Path(path).exists() and sizing.generation(spark) == before + 1
    assert sizing.release_tables(spark) == 0


def test_queries_go_on_after_a_release(spark):
    from checks.registry import QUERIES, fleet

    d = "/root/testdata/sf0.001"
    first = sorted(map(repr, QUERIES["eol_bucket_counts"](spark, d).collect()))
    old = fleet(spark, d)
    sizing.release_tables(spark)
    assert fleet(spark, d) is not old
    assert sorted(map(repr, QUERIES["eol_bucket_counts"](spark, d).collect())) == first


def test_members_tell_their_tables(spark):
    a, b = (spark.createDataFrame([(v,) for v in values], "k string") for values in (["x", "y", None, "x"], ["y", "z"]))
    found = {r["_member"]: r["_in"] for r in sizing.members_of((a, "k"), (b, "k")).collect()}
    assert found == {"x": 1, "y": 3, None: 1, "z": 2}
    df = spark.createDataFrame([("x",), ("z",), (None,), ("q",)], "k string")
    assert [r.k for r in sizing.without_members(df, "k", sizing.members_of((a, "k"), (b, "k")), 0b10).orderBy(F.col("k")).collect()] == [None, "q", "x"]
