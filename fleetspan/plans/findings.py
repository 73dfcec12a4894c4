"""Site, state, source and model findings for a reference date and a horizon.

Every summary sums additive measures. ``findings_frame`` has them per device;
``findings_grain`` has the same columns pre-aggregated, so each summary takes
either: a single report reads the devices once, the bundle reads the small
grain table five times.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lifecycle import (
    BUCKETS, DEFAULT_HORIZON_DAYS, MEASURES, check_horizon, exact, lifecycle_measures, mean, percent, total, with_lifecycle,
)
from ..operators.sizing import written_table
from ..sources.devices import mappable

SITE_KEYS = ("loc_state", "loc_site_code", "loc_site_name", "site_id")
GRAIN_KEYS = (*SITE_KEYS, "device_source", "device_model")


def findings_frame(devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """Mapped devices with derived columns, measures and a site id."""
    check_horizon(horizon_days)
    frame = with_lifecycle(mappable(devices), as_of, horizon_days).withColumns(
        {
            "site_id": F.concat("loc_state", F.lit("-"), "loc_site_code"),
            "device_source": F.coalesce("device_source", F.lit("NA")),
        }
    )
    return lifecycle_measures(frame)


def findings_grain(frame: DataFrame) -> DataFrame:
    """Measures per site, source and model."""
    return frame.groupBy(*GRAIN_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def site_summary(frame: DataFrame) -> DataFrame:
    return (
        frame.groupBy(*SITE_KEYS)
        .agg(
            total("devices", "total_devices"),
            *[total(b, f"{b}_count") for b in BUCKETS],
            total("days_known", "eol_known_devices"),
            mean("days", "avg_days_to_eol", weight="days_known"),
            mean("coverage", "support_coverage_score"),
            mean("risk", "security_risk_score"),
            total("replacement", "replacement_cost_total"),
            total("near_term", "near_term_cost"),
        )
        .withColumn("overdue_rate", percent("overdue_count", "total_devices"))
    )


def top_overdue_sites(sites: DataFrame, n: int = 10) -> DataFrame:
    return (
        sites.orderBy(F.desc("overdue_count"), F.desc("near_term_cost"), F.desc("total_devices"), *SITE_KEYS)
        .limit(n)
        .select(
            F.col("loc_state").alias("state"), F.col("loc_site_code").alias("site_code"),
            F.col("loc_site_name").alias("site_name"), "site_id", "total_devices", "overdue_count", "overdue_rate",
            "near_term_cost",
        )
    )


def site_risk_scatter(sites: DataFrame, n: int = 350) -> DataFrame:
    """Largest sites with scores, costs and the marker size drawn for them."""
    # Marker size 7 + sqrt(cost) / 28 within 7 .. 40.
    size = F.lit(7.0) + F.sqrt(F.greatest(F.col("near_term_cost"), F.lit(0.0))) / 28.0
    return (
        sites.orderBy(F.desc("total_devices"), F.desc("overdue_count"), F.desc("near_term_cost"), *SITE_KEYS)
        .limit(n)
        .select(
            "site_id", F.col("loc_site_name").alias("site_name"), F.col("loc_state").alias("state"),
            F.col("loc_site_code").alias("site_code"), "total_devices", "support_coverage_score",
            "security_risk_score", "replacement_cost_total", "near_term_cost", "overdue_rate",
            F.least(F.greatest(size, F.lit(7.0)), F.lit(40.0)).alias("marker_size"),
        )
    )


def state_exposure(frame: DataFrame, n: int = 15) -> DataFrame:
    return (
        frame.filter(F.col("loc_state").isNotNull())
        .groupBy(F.col("loc_state").alias("state"))
        .agg(
            total("devices", "total_devices"),
            total("overdue", "overdue_count"),
            total("unknown", "unknown_count"),
            mean("coverage", "support_coverage_score"),
            mean("risk", "security_risk_score"),
            total("near_term", "near_term_cost"),
        )
        .orderBy(F.desc("near_term_cost"), F.desc("overdue_count"), "state")
        .limit(n)
    )


def source_lifecycle_mix(frame: DataFrame) -> DataFrame:
    return (
        frame.groupBy("device_source")
        .agg(total("devices", "total_devices"), *[total(b, f"{b}_count") for b in BUCKETS])
        .orderBy(F.desc("total_devices"), "device_source")
    )


def model_hotspots(frame: DataFrame, n: int = 12) -> DataFrame:
    return (
        frame.filter(F.col("device_model").isNotNull())
        .groupBy("device_model")
        .agg(
            total("devices", "total_devices"),
            total("overdue", "overdue_count"),
            total("near_term", "near_term_cost"),
            mean("risk", "security_risk_score"),
        )
        .orderBy(F.desc("overdue_count"), F.desc("near_term_cost"), F.desc("total_devices"), "device_model")
        .limit(n)
    )


def findings_kpis(sites: DataFrame) -> DataFrame:
    """Portfolio totals, as one row; zeros for no devices."""
    zero = F.lit(0)
    return sites.agg(
        F.coalesce(F.sum("total_devices"), zero).alias("total_devices"),
        F.count(F.lit(1)).alias("total_sites"),
        F.coalesce(F.sum("overdue_count"), zero).alias("overdue_devices"),
        F.coalesce(F.sum("unknown_count"), zero).alias("unknown_eol_devices"),
        F.coalesce(F.sum(exact("near_term_cost")).cast("double"), F.lit(0.0)).alias("near_term_cost_estimate"),
    )


def findings(
    devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS
) -> dict[str, DataFrame]:
    """All findings; the devices are read once, into the grain table."""
    grain = written_table(findings_grain(findings_frame(devices, as_of, horizon_days)))
    sites = site_summary(grain)
    return {
        "kpis": findings_kpis(sites),
        "top_overdue_sites": top_overdue_sites(sites),
        "site_risk_cost_scatter": site_risk_scatter(sites),
        "state_exposure": state_exposure(grain),
        "source_lifecycle_mix": source_lifecycle_mix(grain),
        "model_hotspots": model_hotspots(grain),
    }
