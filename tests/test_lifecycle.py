import datetime as dt

import pytest

from fleetspan.functions.lifecycle import check_horizon, lifecycle_measures, with_lifecycle

DAY = dt.date(2025, 6, 1)


def test_boundaries(spark):
    days = [-1000, -365, -1, 0, 365, 366, 1095, 2000, None]
    rows = [
        (i, None if d is None else DAY + dt.timedelta(days=d), 0.0 if i == 2 else None, 50.0 if i < 4 else None, None, None)
        for i, d in enumerate(days)
    ]
    df = spark.createDataFrame(
        rows,
        "i int, modeldata_eol date, pricing_total_estimate double, modeldata_material_cost double, "
        "software_version string, firmware_version string",
    )
    out = with_lifecycle(df, DAY, 365).orderBy("i").collect()
    assert [r.days_to_eol for r in out] == days
    assert [r.eol_bucket for r in out] == ["overdue"] * 3 + ["within_horizon"] * 2 + ["future"] * 3 + ["unknown"]
    assert [r.support_coverage_score for r in out] == [
        0.0, 0.0, 364 / 1460 * 100, 25.0, 50.0, 731 / 1460 * 100, 100.0, 100.0, 30.0,
    ]
    assert [r.security_risk_score for r in out] == [90.0] * 3 + [60.0] * 2 + [30.0] * 3 + [55.0]
    # A rollup of zero beats the material cost.
    assert [r.replacement_cost_estimate for r in out] == [50.0, 50.0, 0.0, 50.0] + [0.0] * 5
    assert [r.near_term_cost_component for r in out] == [50.0, 50.0, 0.0, 50.0] + [0.0] * 5


def test_versions_and_absent_columns(spark):
    df = spark.createDataFrame([(1, "17.1"), (2, None)], "i int, software_version string")
    out = lifecycle_measures(with_lifecycle(df, "2025-06-01")).orderBy("i").collect()
    assert [r.security_risk_score for r in out] == [45.0, 55.0]
    assert [r.m_unknown for r in out] == [1, 1]


def test_text_dates(spark):
    df = spark.createDataFrame([("2025-06-02",), ("02.06.2025",)], "modeldata_eol string")
    assert {r.days_to_eol for r in with_lifecycle(df, DAY).collect()} == {1, None}


def test_horizon():
    assert check_horizon(0) == 0
    with pytest.raises(ValueError):
        check_horizon(-1)


def test_sums_of_amounts_do_not_depend_on_the_order(spark):
    """Cents whose sums of doubles differ with the layout; ranks must not."""
    import random

    from pyspark.sql import functions as F

    from fleetspan.functions.lifecycle import exact, mean, total

    rng = random.Random(1)
    cents = [rng.randint(1, 10**9) for _ in range(3000)]
    found = set()
    for parts in (1, 3, 11):
        rng.shuffle(cents)
        df = spark.createDataFrame([(c / 100,) for c in cents], "v double").repartition(parts)
        df = df.select(exact("v").alias("m_near_term"), F.lit(1).cast("bigint").alias("m_devices"))
        row = df.agg(total("near_term", "t"), mean("near_term", "m")).first()
        found.add((row.t, row.m))
    assert found == {(sum(cents) / 100, sum(cents) / 100 / len(cents))}
