import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetspan.plans import findings, reports

DAY = dt.date(2025, 6, 1)


@pytest.fixture(scope="module")
def fleet(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        site = rng.choice(["AAA"] * 6 + ["BBB", "CCC", "DDD"])
        days = rng.choice([None, -400, -3, 0, 200, 365, 366, 900])
        rows.append(
            (
                f"d{i}", rng.choice(["CatCtr", "NA", None, ""]), rng.choice(["GA", "AL", None]), site,
                rng.choice([f"Site {site}", None]), rng.choice([1.5, 2.5]), 3.0, rng.choice(["M1", "M2", None]),
                None if days is None else DAY + dt.timedelta(days=days), rng.choice([None, 10.0, 25.0]), rng.choice([None, 7.0]),
                rng.choice([None, 3.0]), rng.choice([None, "17"]), rng.choice([None, "O1", "O2"]), rng.choice([None, "G"]),
                rng.choice([None, "C1", "C2"]),
            )
        )
    return spark.createDataFrame(
        rows,
        "device_name string, device_source string, loc_state string, loc_site_code string, loc_site_name string, "
        "loc_latitude double, loc_longitude double, device_model string, modeldata_eol date, pricing_total_estimate double, "
        "modeldata_material_cost double, modeldata_labor_cost double, software_version string, loc_owner string, "
        "loc_call_group string, modeldata_category string",
    )


def values(df):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_bundle_equals_single_reports(fleet):
    frame = findings.findings_frame(fleet, DAY)
    sites = findings.site_summary(frame)
    bundle = findings.findings(fleet, DAY)
    for name, single in {
        "kpis": findings.findings_kpis(sites),
        "top_overdue_sites": findings.top_overdue_sites(sites),
        "site_risk_cost_scatter": findings.site_risk_scatter(sites),
        "state_exposure": findings.state_exposure(frame),
        "source_lifecycle_mix": findings.source_lifecycle_mix(frame),
        "model_hotspots": findings.model_hotspots(frame),
    }.items():
        assert values(bundle[name]) == values(single), name


def test_totals_agree(fleet):
    frame = findings.findings_frame(fleet, DAY)
    kpi = findings.findings_kpis(findings.site_summary(frame)).first()
    states = findings.state_exposure(frame, 99).agg(F.sum("total_devices"), F.sum("near_term_cost")).first()
    assert (kpi.total_devices, kpi.near_term_cost_estimate) == tuple(states)
    bad = findings.site_summary(frame).filter(
        "overdue_count + within_horizon_count + future_count + unknown_count <> total_devices "
        "or near_term_cost > replacement_cost_total or eol_known_devices <> total_devices - unknown_count"
    )
    assert bad.count() == 0


def test_longer_horizon_never_loses_devices(fleet):
    def within(h):
        return findings.source_lifecycle_mix(findings.findings_frame(fleet, DAY, h)).agg(F.sum("within_horizon_count")).first()[0]

    assert within(0) <= within(199) < within(200) <= within(365) < within(366)


def test_layout_does_not_matter(fleet):
    one = findings.site_summary(findings.findings_frame(fleet, DAY))
    other = findings.site_summary(findings.findings_frame(fleet.repartition(5, "device_model"), DAY))
    assert values(one) == values(other)


def test_ties_at_the_cut(spark):
    rows = [("GA", f"S{i:02d}", "n", "x", 1, 1, 0.0, 5, 0.0) for i in range(15, 0, -1)]
    sites = spark.createDataFrame(
        rows,
        "loc_state string, loc_site_code string, loc_site_name string, site_id string, total_devices int, overdue_count int, "
        "overdue_rate double, unknown_count int, near_term_cost double",
    )
    assert [r.site_code for r in findings.top_overdue_sites(sites).collect()] == [f"S{i:02d}" for i in range(1, 11)]


def test_no_devices(fleet):
    kpi = findings.findings_kpis(findings.site_summary(findings.findings_frame(fleet.filter("false"), DAY))).first()
    assert tuple(kpi) == (0, 0, 0, 0, 0.0)


def test_suite_equals_single_reports(fleet):
    frame = reports.report_frame(fleet, DAY)
    suite = reports.report_suite(fleet, DAY)
    singles = {
        "eol_bucket_distribution": reports.eol_bucket_distribution(frame),
        "days_to_eol_distribution": reports.days_histogram(frame),
        "overdue_age_distribution": reports.overdue_age_histogram(frame),
        "top_overdue_sites": reports.top_sites(frame),
        "state_exposure": reports.exposure_by_state(frame),
        "source_lifecycle_mix": reports.source_mix(frame),
        "category_lifecycle_heatmap": reports.category_heatmap(frame),
        "model_hotspots": reports.hot_models(frame),
        "risk_cost_scatter": reports.risk_scatter(frame),
        "owner_risk_boxplot": reports.owner_risk_box(frame),
        "call_group_backlog": reports.call_group_backlog(frame),
        "unknown_eol_by_state": reports.unknown_by_state(frame),
        "cost_composition": reports.cost_by_bucket(frame),
        "site_priority_matrix": reports.site_priority_matrix(frame),
    }
    assert set(suite) == set(singles)
    for name, single in singles.items():
        assert values(suite[name]) == values(single), name


def test_report_frame_tolerates_missing_columns(spark):
    frame = reports.report_frame(spark.createDataFrame([("d",)], "device_name string"), DAY)
    row = frame.first()
    assert (row.device_source, row.site_id, row.eol_bucket, row.security_risk_score) == ("NA", "NA-NA", "unknown", 55.0)
    assert reports.top_sites(frame).count() == 0 and reports.days_histogram(frame).count() == 0
    assert reports.days_density(frame).count() == 0
    with pytest.raises(ValueError):
        reports.report_frame(spark.createDataFrame([("d",)], "x string"), DAY)


def test_histogram_and_density(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    days = [int(d) for d in rng.normal(100, 300, 400)]
    rows = [("d", DAY + dt.timedelta(days=d)) for d in days]
    frame = reports.report_frame(spark.createDataFrame(rows, "device_name string, modeldata_eol date"), DAY)
    out = reports.days_histogram(frame, 40).orderBy("bin").collect()
    counts, edges = np.histogram(days, bins=40)
    np.testing.assert_allclose([r.bin_start for r in out], edges[:-1])
    assert sum(r.n_devices for r in out) == 400
    # Values on an inner edge may fall on either side of it in floating point.
    assert sum(abs(r.n_devices - c) for r, c in zip(out, counts)) <= 4
    curve = reports.days_density(frame).orderBy("point").collect()
    x = np.linspace(min(days), max(days), 200)
    h = np.std(days, ddof=1) * len(days) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - np.array(days)) / h) ** 2).sum(1) / (h * np.sqrt(2 * np.pi))
    want *= (max(days) - min(days)) / 40
    np.testing.assert_allclose([r.density for r in curve], want, rtol=1e-9)
    single = reports.report_frame(spark.createDataFrame(rows[:1], "device_name string, modeldata_eol date"), DAY)
    flat = reports.days_histogram(single, 40).filter("n_devices > 0").collect()
    assert [(r.bin, r.n_devices) for r in flat] == [(20, 1)]


def test_owner_box(spark):
    import numpy as np

    scores = [20.0] * 9 + [30.0] * 3 + [45.0] + [90.0] * 2
    df = spark.createDataFrame([("O", s, 1) for s in scores] + [(None, 50.0, 1)], "loc_owner string, security_risk_score double, m_devices bigint")
    out = {r.loc_owner: r for r in reports.owner_risk_box(df).collect()}
    q1, q2, q3 = np.quantile(scores, [0.25, 0.5, 0.75])
    r = out["O"]
    assert (r.q1, r.median, r.q3, r.n_devices) == (q1, q2, q3, 15)
    top = q3 + 1.5 * (q3 - q1)
    assert r.whisker_high == max(s for s in scores if s <= top) and r.n_outliers == sum(s > top for s in scores)
    assert out["Unknown"].median == 50.0
    assert [r.loc_owner for r in reports.owner_risk_box(df, 1).collect()] == ["O"]
