"""The data behind each distribution chart.

All reports take ``report_frame``; like the findings they sum additive measures.
Null group keys drop out, as in the charts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lifecycle import (
    BUCKETS, DEFAULT_HORIZON_DAYS, MEASURES, check_horizon, lifecycle_measures, mean, percent, total, with_lifecycle,
)
from ..functions.text import require_columns, source_label, strip, with_optional
from ..operators.sizing import written_table

TEXT_COLUMNS = (
    "device_source", "loc_state", "loc_site_code", "loc_site_name", "loc_owner", "loc_call_group",
    "modeldata_category", "device_model",
)
GRAIN_KEYS = ("site_id", *TEXT_COLUMNS, "eol_bucket", "days_to_eol", "security_risk_score")
KDE_POINTS = 200


def report_frame(devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """All devices with derived columns; absent optional columns count as null."""
    require_columns(devices, ["device_name"], "device dataset")
    check_horizon(horizon_days)
    devices = with_optional(devices, dict.fromkeys(TEXT_COLUMNS, "string"))
    frame = with_lifecycle(devices, as_of, horizon_days).withColumns(
        {
            "device_source": source_label("device_source"),
            "loc_state": F.upper(strip("loc_state")),
            "loc_site_code": F.upper(strip("loc_site_code")),
        }
    )
    site_id = F.concat(F.coalesce("loc_state", F.lit("NA")), F.lit("-"), F.coalesce("loc_site_code", F.lit("NA")))
    return lifecycle_measures(frame.withColumn("site_id", site_id))


def report_grain(frame: DataFrame) -> DataFrame:
    """Measures per combination of all report keys; any report gives the same on it."""
    return frame.groupBy(*GRAIN_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _sited(frame: DataFrame) -> DataFrame:
    return frame.dropna(subset=["loc_state", "loc_site_code", "loc_site_name"])


def _fixed_rows(*rows: dict[str, Column]) -> Column:
    return F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]).alias("rows")


def bucket_label(bucket: str, horizon_days: int) -> str:
    return f"Within {horizon_days}d" if bucket == "within_horizon" else bucket.title()


def eol_bucket_distribution(frame: DataFrame, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    rows = _fixed_rows(
        *[
            {
                "position": F.lit(i),
                "eol_bucket": F.lit(b),
                "label": F.lit(bucket_label(b, horizon_days)),
                "n_devices": F.coalesce(F.sum(f"m_{b}"), F.lit(0)),
            }
            for i, b in enumerate(BUCKETS, 1)
        ]
    )
    return frame.agg(rows).select(F.inline("rows"))


def histogram(frame: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value, zero-filled, last bin closed.

    Values are merged before anything else, so the counts table is as small as
    the number of distinct days; a single distinct value gets a range of one.
    """
    counts = written_table(
        frame.select(value.alias("v"), "m_devices")
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.sum("m_devices").alias("n"))
    )
    flat = F.when(F.min("v") == F.max("v"), 0.5).otherwise(0.0)
    limits = counts.agg(
        F.struct((F.min("v") - flat).alias("low"), (F.max("v") + flat).alias("high")).alias("r")
    )
    r = F.col("r")
    place = F.least(F.floor((F.col("v") - r["low"]) * bins / (r["high"] - r["low"])), F.lit(bins - 1)).cast("int")
    per_bin = counts.withColumn("r", limits.scalar()).groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))
    # Bounded: one entry per bin.
    filled = per_bin.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    width = (r["high"] - r["low"]) / bins
    return (
        filled.filter(F.size("found") > 0)
        .withColumn("r", limits.scalar())
        .select("found", "r", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            "bin",
            (r["low"] + F.col("bin") * width).alias("bin_start"),
            (r["low"] + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce(F.element_at("found", F.col("bin")), F.lit(0)).alias("n_devices"),
        )
    )


def days_histogram(frame: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(frame, F.col("days_to_eol"), bins)


def overdue_age_histogram(frame: DataFrame, bins: int = 35) -> DataFrame:
    overdue = frame.filter(F.col("days_to_eol") < 0)
    return histogram(overdue, -F.col("days_to_eol"), bins)


def days_density(frame: DataFrame, bins: int = 40, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian density of days to EoL (Scott width) on a grid, scaled to the histogram.

    Every distinct day adds to every grid point, so the work is linear in
    distinct days; the sums are combined before they are shuffled.
    """
    counts = written_table(
        frame.filter(F.col("days_to_eol").isNotNull())
        .groupBy(F.col("days_to_eol").cast("double").alias("v"))
        .agg(F.sum("m_devices").cast("double").alias("n"))
    )
    n = F.sum("n")
    squares = F.sum(F.col("n") * F.col("v") * F.col("v")) - F.sum(F.col("n") * F.col("v")) ** 2 / n
    stats = written_table(
        counts.agg(
            n.alias("n_all"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            (F.sqrt(squares / (n - 1)) * F.pow(n, F.lit(-0.2))).alias("h"),
        ).filter((F.col("n_all") > 1) & (F.col("h") > 0))
    )
    s = F.col("s")
    one = stats.select(F.struct("n_all", "low", "high", "h").alias("s")).scalar()
    spread = (
        counts.withColumn("s", one)
        .filter(s.isNotNull())
        .select("v", "n", "s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("x", s["low"] + (s["high"] - s["low"]) * F.col("point") / float(points - 1))
    )
    kernel = F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / s["h"], F.lit(2.0)))
    sums = spread.groupBy("point").agg(F.first("x").alias("days_to_eol"), F.sum(kernel).alias("total"), F.first("s").alias("s"))
    scale = (s["high"] - s["low"]) / bins / (s["h"] * F.sqrt(F.lit(2.0) * F.pi()))
    return sums.select("point", "days_to_eol", (F.col("total") * scale).alias("density"))


def top_sites(frame: DataFrame, n: int = 10) -> DataFrame:
    return (
        _sited(frame)
        .groupBy("loc_state", "loc_site_code", "loc_site_name")
        .agg(total("overdue", "overdue_count"), total("devices", "total_devices"), total("near_term", "near_term_cost"))
        .orderBy(
            F.desc("overdue_count"), F.desc("near_term_cost"), F.desc("total_devices"), "loc_state", "loc_site_code",
            "loc_site_name",
        )
        .limit(n)
        .withColumn("site_label", F.concat("loc_state", F.lit("-"), "loc_site_code"))
    )


def exposure_by_state(frame: DataFrame, n: int = 15) -> DataFrame:
    return (
        frame.filter(F.col("loc_state").isNotNull())
        .groupBy("loc_state")
        .agg(total("near_term", "near_term_cost"), total("overdue", "overdue_count"))
        .orderBy(F.desc("near_term_cost"), "loc_state")
        .limit(n)
    )


def source_mix(frame: DataFrame, normalize: bool = True) -> DataFrame:
    """Devices per source and bucket, or shares of the source."""
    counts = frame.groupBy("device_source").agg(*[total(b, b) for b in BUCKETS])
    if not normalize:
        return counts
    everything = F.col("overdue") + F.col("within_horizon") + F.col("future") + F.col("unknown")
    return counts.select(
        "device_source", *[F.when(everything > 0, F.col(b) / everything).otherwise(0.0).alias(b) for b in BUCKETS]
    )


def category_heatmap(frame: DataFrame, n: int = 12) -> DataFrame:
    return (
        frame.groupBy(F.coalesce("modeldata_category", F.lit("Unknown")).alias("modeldata_category"))
        .agg(*[total(b, b) for b in BUCKETS])
        .orderBy(F.desc("overdue"), "modeldata_category")
        .limit(n)
    )


def hot_models(frame: DataFrame, n: int = 12) -> DataFrame:
    return (
        frame.filter(F.col("device_model").isNotNull())
        .groupBy("device_model")
        .agg(total("devices", "total_devices"), total("overdue", "overdue_count"), total("near_term", "near_term_cost"))
        .orderBy(F.desc("overdue_count"), F.desc("near_term_cost"), F.desc("total_devices"), "device_model")
        .limit(n)
    )


def risk_scatter(frame: DataFrame, n: int = 500) -> DataFrame:
    # Marker size 20 + sqrt(cost) / 20 within 18 .. 220.
    size = F.lit(20.0) + F.sqrt("near_term_cost") / 20.0
    return (
        _sited(frame)
        .groupBy("site_id", "loc_site_name", "loc_state", "loc_site_code")
        .agg(
            total("devices", "total_devices"),
            mean("coverage", "support_coverage_score"),
            mean("risk", "security_risk_score"),
            total("near_term", "near_term_cost"),
            total("overdue", "overdue_count"),
        )
        .orderBy(F.desc("total_devices"), F.desc("near_term_cost"), "site_id", "loc_site_name", "loc_state", "loc_site_code")
        .limit(n)
        .withColumns(
            {
                "overdue_rate": percent("overdue_count", "total_devices"),
                "marker_size": F.least(F.greatest(size, F.lit(18.0)), F.lit(220.0)),
            }
        )
    )


def largest_owners(frame: DataFrame, n: int = 8) -> DataFrame:
    owner = F.coalesce("loc_owner", F.lit("Unknown"))
    return (
        frame.groupBy(owner.alias("loc_owner"))
        .agg(F.sum("m_devices").alias("n_devices"))
        .orderBy(F.desc("n_devices"), "loc_owner")
        .limit(n)
    )


def owner_scores(frame: DataFrame, n: int = 8) -> DataFrame:
    """Devices per risk score for the largest owners. Eight scores exist, so the result is small."""
    owner = F.coalesce("loc_owner", F.lit("Unknown"))
    scores = written_table(
        frame.groupBy(owner.alias("loc_owner"), "security_risk_score").agg(F.sum("m_devices").alias("m_devices"))
    )
    return scores.join(largest_owners(scores, n), "loc_owner", "left_semi").withColumnRenamed("m_devices", "n_devices")


def owner_risk_box(frame: DataFrame, n: int = 8) -> DataFrame:
    """Box statistics of the risk score for the largest owners: quartiles, whiskers, outliers."""
    scores = owner_scores(frame, n)
    score = F.col("security_risk_score")
    boxes = scores.groupBy("loc_owner").agg(
        F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n_devices")).alias("q"),
        F.collect_list(F.struct(score.alias("score"), "n_devices")).alias("scores"),
        F.sum("n_devices").alias("n_devices"),
    )
    q = F.col("q")
    reach = (q[2] - q[0]) * 1.5
    inside = F.filter("scores", lambda s: (s["score"] >= F.col("low")) & (s["score"] <= F.col("high")))
    outside = F.filter("scores", lambda s: (s["score"] < F.col("low")) | (s["score"] > F.col("high")))
    return (
        boxes.withColumns({"low": q[0] - reach, "high": q[2] + reach})
        .withColumns({"inside": inside, "outside": outside})
        .select(
            "loc_owner",
            "n_devices",
            q[0].alias("q1"),
            q[1].alias("median"),
            q[2].alias("q3"),
            F.array_min(F.transform("inside", lambda s: s["score"])).alias("whisker_low"),
            F.array_max(F.transform("inside", lambda s: s["score"])).alias("whisker_high"),
            F.aggregate("outside", F.lit(0).cast("bigint"), lambda a, s: a + s["n_devices"]).alias("n_outliers"),
        )
    )


def call_group_backlog(frame: DataFrame, n: int = 12) -> DataFrame:
    return (
        frame.filter(F.col("loc_call_group").isNotNull())
        .groupBy("loc_call_group")
        .agg(
            total("overdue", "overdue_count"),
            total("within_horizon", "within_count"),
            total("devices", "total_devices"),
        )
        .orderBy(F.desc("overdue_count"), F.desc("within_count"), F.desc("total_devices"), "loc_call_group")
        .limit(n)
    )


def unknown_by_state(frame: DataFrame, n: int = 15) -> DataFrame:
    return (
        frame.filter(F.col("loc_state").isNotNull())
        .groupBy("loc_state")
        .agg(total("devices", "total_devices"), total("unknown", "unknown_count"))
        .orderBy(F.desc("unknown_count"), "loc_state")
        .limit(n)
        .withColumn("unknown_rate", percent("unknown_count", "total_devices"))
    )


def cost_by_bucket(frame: DataFrame) -> DataFrame:
    """Replacement and labour cost per bucket in fixed order, zero-filled."""

    def within(b: str, measure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("eol_bucket") == b, F.col(measure))).cast("double"), F.lit(0.0))

    rows = _fixed_rows(
        *[
            {
                "position": F.lit(i),
                "eol_bucket": F.lit(b),
                "replacement_cost": within(b, "m_replacement"),
                "labor_cost": within(b, "m_labor"),
            }
            for i, b in enumerate(BUCKETS, 1)
        ]
    )
    return frame.agg(rows).select(F.inline("rows"))


def site_priority_matrix(frame: DataFrame, n: int = 250) -> DataFrame:
    # Marker size 30 + 12 * sqrt(unknown + 1) within 24 .. 220.
    size = F.lit(30.0) + F.sqrt(F.col("unknown_count") + 1) * 12.0
    return (
        _sited(frame)
        .groupBy("site_id", "loc_site_name")
        .agg(
            total("overdue", "overdue_count"),
            total("within_horizon", "within_count"),
            total("unknown", "unknown_count"),
            total("near_term", "near_term_cost"),
            mean("risk", "security_risk_score"),
        )
        .withColumn("action_backlog", F.col("overdue_count") + F.col("within_count"))
        .orderBy(F.desc("action_backlog"), F.desc("near_term_cost"), "site_id", "loc_site_name")
        .limit(n)
        .withColumn("marker_size", F.least(F.greatest(size, F.lit(24.0)), F.lit(220.0)))
    )


def report_suite(
    devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS
) -> dict[str, DataFrame]:
    """All fourteen reports; the devices are read once, into the grain table."""
    grain = written_table(report_grain(report_frame(devices, as_of, horizon_days)))
    return {
        "eol_bucket_distribution": eol_bucket_distribution(grain, horizon_days),
        "days_to_eol_distribution": days_histogram(grain),
        "overdue_age_distribution": overdue_age_histogram(grain),
        "top_overdue_sites": top_sites(grain),
        "state_exposure": exposure_by_state(grain),
        "source_lifecycle_mix": source_mix(grain),
        "category_lifecycle_heatmap": category_heatmap(grain),
        "model_hotspots": hot_models(grain),
        "risk_cost_scatter": risk_scatter(grain),
        "owner_risk_boxplot": owner_risk_box(grain),
        "call_group_backlog": call_group_backlog(grain),
        "unknown_eol_by_state": unknown_by_state(grain),
        "cost_composition": cost_by_bucket(grain),
        "site_priority_matrix": site_priority_matrix(grain),
    }
