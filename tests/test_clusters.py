import datetime as dt

import pytest

from fleetspan.plans import clusters

DAY = dt.date(2025, 6, 1)
SCHEMA = (
    "device_name string, device_source string, loc_state string, loc_site_code string, loc_site_name string, "
    "loc_latitude double, loc_longitude double, modeldata_eol date"
)


def devices(spark, rows):
    """(name, source, state, site, site name, days to EoL or None)"""
    return spark.createDataFrame(
        [(n, s, st, c, sn, 1.0, 2.0, None if d is None else DAY + dt.timedelta(days=d)) for n, s, st, c, sn, d in rows], SCHEMA
    )


FLEET = [
    ("a", "X", "GA", "ABC", "Site", -10), ("b", "Y", "GA", "ABC", "Site", 20), ("c", "X", "GA", "ABC", "Site", None),
    ("d", "X", "AL", "ABC", None, 400), ("e", "X", "AL", "XYZ", None, None), ("f", "X", None, "XYZ", None, 1),
]


def test_site_clusters(spark):
    out = clusters.site_clusters(devices(spark, FLEET), DAY).collect()
    assert [(r.cluster_id, r.device_count) for r in out] == [("GA-ABC", 3), ("AL-ABC", 1), ("AL-XYZ", 1)]
    ga = out[0]
    assert (ga.eol_known_devices, ga.overdue_devices, ga.remaining_days_total, ga.remaining_days_avg) == (2, 1, 10, 5.0)
    assert ga.remaining_days_weighted_total == 0
    assert (out[2].remaining_days_total, out[2].remaining_days_avg, out[2].overdue_devices) == (None, None, 0)


@pytest.mark.parametrize(
    ("totals", "low", "high"),
    [([1, 2, 3, 10], 1.3, 7.9), ([5], 4.0, 6.0), ([7, 7], 6.0, 8.0), ([None], -365.0, 365.0), ([], -365.0, 365.0)],
)
def test_metric_domain(spark, totals, low, high):
    df = spark.createDataFrame(
        [("GA", i + 1, t) for i, t in enumerate(totals)],
        "loc_state string, device_count bigint, remaining_days_weighted_total bigint",
    )
    (row,) = clusters.metric_domain(df).collect()
    assert (round(row.metric_min, 9), round(row.metric_max, 9)) == (low, high)
    assert row.max_device_count == row.global_max_device_count == max(len(totals), 1)
    (empty,) = clusters.metric_domain(df, "AL").collect()
    assert (empty.metric_min, empty.metric_max, empty.max_device_count) == (-365.0, 365.0, 1)


def test_urgency(spark):
    table = clusters.cluster_table(devices(spark, FLEET), DAY)
    out = {r.cluster_id: r for r in clusters.cluster_urgency(table).collect()}
    assert out["GA-ABC"].urgency_position == 0.0 and out["AL-ABC"].urgency_position == 1.0
    assert out["AL-XYZ"].urgency_position is None
    assert out["GA-ABC"].base_radius == 32.0 and round(out["AL-ABC"].base_radius, 6) == round(4 + 28 / 3**0.5, 6)
    assert {r.base_radius for r in clusters.cluster_urgency(table, "al").collect()} == {32.0}


def test_payload(spark):
    payload = clusters.cluster_payload(devices(spark, FLEET), DAY, state="al")
    assert [r.cluster_id for r in payload["clusters"].collect()] == ["AL-ABC", "AL-XYZ"]
    assert payload["scale"].first().global_max_device_count == 3


def test_location_summaries(spark):
    twice = [*FLEET, ("a", "Y", "GA", "ABC", "Site", -10)]
    out = {(r.loc_state, r.loc_site_code): r for r in clusters.location_summaries(devices(spark, twice), DAY, 20).collect()}
    ga = out["GA", "ABC"]
    assert (ga.device_count, ga.total_devices, ga.consistent) == (3, 4, False)
    assert (ga.overdue_count, ga.within_horizon_count, ga.future_count, ga.unknown_count, ga.known_count) == (2, 1, 0, 1, 3)
    assert ga.sources == {"X": 2, "Y": 2} and ga.overdue_share == 50.0
    assert out["AL", "ABC"].consistent and out["AL", "ABC"].future_count == 1
    with pytest.raises(Exception, match="GA-ABC"):
        clusters.check_consistent(clusters.location_summaries(devices(spark, twice), DAY)).collect()
    assert clusters.check_consistent(clusters.location_summaries(devices(spark, FLEET), DAY)).count() == 3


def test_requested_locations(spark):
    wanted = clusters.requested_locations(spark, [(" ga", "abc"), ("ZZ", "AAA")])
    out = {r.loc_state: r for r in clusters.location_summary(devices(spark, FLEET), wanted, DAY).collect()}
    assert out["GA"].found and out["GA"].total_devices == 3
    assert not out["ZZ"].found and out["ZZ"].total_devices == 0 and out["ZZ"].device_count is None
    twice = devices(spark, [*FLEET, ("a", "Y", "GA", "ABC", "Site", -10)])
    with pytest.raises(Exception, match="GA-ABC"):
        clusters.location_summary(twice, wanted, DAY).collect()
    assert clusters.location_summary(twice, wanted, DAY, strict=False).where("found").first().device_count == 3
    with pytest.raises(ValueError):
        clusters.requested_locations(spark, [("GEO", "ABC")])
    with pytest.raises(ValueError):
        clusters.requested_locations(spark, [("GA", "ABCD")])


def test_bucket_counts(spark):
    (row,) = clusters.bucket_counts(devices(spark, FLEET), DAY, 20).collect()
    assert row.asDict() == {
        "total_devices": 6, "overdue_count": 1, "within_horizon_count": 2, "future_count": 1, "unknown_count": 2, "known_count": 4,
    }
