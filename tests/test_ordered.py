import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.operators.ordered import exact_percentiles, running_sums, with_neighbours


@pytest.mark.parametrize("parts", [2, 7, 128])
@pytest.mark.parametrize("kind", ["spread", "few", "hot", "one"])
def test_percentiles(spark, kind, parts):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=997),
        "few": rng.integers(0, 4, 500).astype(float),
        "hot": np.concatenate([np.zeros(600), rng.normal(size=300) * 1e6]),
        "one": np.array([5.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    (row,) = exact_percentiles(df, "v", probs, parts=parts).collect()
    np.testing.assert_allclose(row.quantiles, np.quantile(values, probs), rtol=1e-12, atol=1e-12)


def test_percentiles_per_set(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 10), ("c", None)], "g string, v int")
    found = {r.g: r.quantiles for r in exact_percentiles(df, "v", [0.5], by="g").collect()}
    assert found == {"a": [1.5], "b": [10.0]}
    assert exact_percentiles(df.filter("g = 'c'"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("parts", [2, 16])
def test_running_sums_and_neighbours(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(rng.integers(0, 9)), bool(rng.random() < 0.2)) for g in (1, 2) for v in set(rng.integers(0, 400, 300))]
    df = spark.createDataFrame(rows, "g int, v double, n bigint, known boolean")
    out = running_sums(df, "g", "v", {"total": "n"}, parts).orderBy("g", "v").collect()
    for g in (1, 2):
        mine = sorted(r for r in rows if r[0] == g)
        got = [r for r in out if r.g == g]
        assert [r.total for r in got] == list(np.cumsum([r[2] for r in mine]))
        assert {r.total_total for r in got} == {sum(r[2] for r in mine)}
    value = F.when(F.col("known"), F.col("v"))
    near = with_neighbours(df, "g", "v", value, parts).orderBy("g", "v").collect()
    for r in near:
        known = sorted(v for g, v, _, k in rows if g == r.g and k)
        assert r.previous == max((v for v in known if v < r.v), default=None)
        assert r.next == min((v for v in known if v > r.v), default=None)
