"""Map clusters, colour scale and location summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lifecycle import (
    BUCKETS, DEFAULT_HORIZON_DAYS, check_horizon, days_to_eol, eol_bucket, lifecycle_measures, mean, percent, total,
    with_lifecycle,
)
from ..operators.ordered import exact_percentiles
from ..operators.sizing import settle, written_table
from ..sources.devices import mappable

CLUSTER_KEYS = ("loc_state", "loc_site_code", "loc_site_name", "loc_latitude", "loc_longitude")
# Fixed values.
DEFAULT_DOMAIN = (-365.0, 365.0)
RADIUS_BASE = 4.0
RADIUS_SPAN = 28.0
PRUNING_REQUESTS = 1000  # up to so many requested locations are known to the plan


def check_state(state: str) -> str:
    code = str(state).strip().upper()
    if len(code) != 2:
        raise ValueError("state must be a 2-letter code")
    return code


def check_site(site_code: str) -> str:
    code = str(site_code).strip().upper()
    if len(code) != 3:
        raise ValueError("site code must be a 3-letter code")
    return code


def site_clusters(devices: DataFrame, as_of: dt.date | str) -> DataFrame:
    """One row per mapped site: size, overdue devices, plain and weighted remaining days."""
    return largest_first(cluster_table(devices, as_of))


def largest_first(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(
        F.desc("device_count"), "loc_state", "loc_site_code", "loc_site_name", "loc_latitude", "loc_longitude"
    )


def cluster_table(devices: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The clusters in no particular order."""
    frame = lifecycle_measures(with_lifecycle(mappable(devices), as_of))
    return (
        frame.groupBy(*CLUSTER_KEYS)
        .agg(
            total("devices", "device_count"),
            total("days_known", "eol_known_devices"),
            total("overdue", "overdue_devices"),
            total("days", "remaining_days_total"),
            mean("days", "remaining_days_avg", weight="days_known"),
            total("weighted_days", "remaining_days_weighted_total"),
        )
        .withColumn("cluster_id", F.concat("loc_state", F.lit("-"), "loc_site_code"))
    )


def in_state(clusters: DataFrame, state: str | None) -> DataFrame:
    """Clusters of one state; no state means all."""
    if state is None or not str(state).strip():
        return clusters
    return clusters.filter(F.col("loc_state") == check_state(state))


def metric_domain(clusters: DataFrame, state: str | None = None) -> DataFrame:
    """Colour scale (10th and 90th percentile over all clusters) and largest clusters.

    One row also for an empty scope. ``clusters`` should be a written table: it is
    read for the maxima and again for the percentiles.
    """
    spread = exact_percentiles(clusters, "remaining_days_weighted_total", [0.1, 0.9])
    scope = in_state(clusters, state)
    maxima = scope.agg(
        F.coalesce(F.max("device_count"), F.lit(1)).alias("max_device_count"), F.count(F.lit(1)).alias("_n")
    )
    everything = clusters.agg(F.coalesce(F.max("device_count"), F.lit(1)).alias("m"))
    q = F.col("_q")
    usable = (F.col("_n") > 0) & q.isNotNull()
    widen = F.when(q[0] == q[1], 1.0).otherwise(0.0)
    return (
        maxima.withColumns({"_q": spread.scalar(), "global_max_device_count": everything.scalar()})
        .select(
            F.when(usable, q[0] - widen).otherwise(DEFAULT_DOMAIN[0]).alias("metric_min"),
            F.when(usable, q[1] + widen).otherwise(DEFAULT_DOMAIN[1]).alias("metric_max"),
            "max_device_count",
            "global_max_device_count",
        )
    )


def cluster_urgency(clusters: DataFrame, state: str | None = None) -> DataFrame:
    """Position on the colour scale (0 urgent .. 1 relaxed) and marker radius per cluster."""
    scale = written_table(metric_domain(clusters, state))
    bounds = scale.select(
        F.struct(
            F.col("metric_min").alias("low"),
            F.when(F.col("metric_min") == F.col("metric_max"), F.col("metric_max") + 1)
            .otherwise(F.col("metric_max"))
            .alias("high"),
            F.greatest(
                F.lit(1), F.col("global_max_device_count" if state is None else "max_device_count")
            ).alias("largest"),
        )
    ).scalar()
    b = F.col("_b")
    metric = F.col("remaining_days_weighted_total")
    position = (F.greatest(b["low"], F.least(b["high"], metric)) - b["low"]) / (b["high"] - b["low"])
    return in_state(clusters, state).withColumn("_b", bounds).select(
        "cluster_id",
        "loc_site_name",
        "loc_latitude",
        "loc_longitude",
        "device_count",
        F.when(metric.isNotNull(), position).alias("urgency_position"),
        (RADIUS_BASE + F.lit(RADIUS_SPAN) * F.sqrt("device_count") / F.sqrt(b["largest"])).alias("base_radius"),
    )


def cluster_payload(devices: DataFrame, as_of: dt.date | str, state: str | None = None) -> dict[str, DataFrame]:
    """Clusters of the scope and their scale, over one written site table."""
    clusters = written_table(cluster_table(devices, as_of))
    return {"clusters": largest_first(in_state(clusters, state)), "scale": metric_domain(clusters, state)}


def location_summaries(devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """Every mapped location in one pass: devices, buckets, remaining days, sources.

    ``device_count`` counts names, ``total_devices`` rows; they differ when a join
    has multiplied devices, which ``consistent`` reports. A site with many rows is
    spread over its names and sources before the rows of the site meet.
    """
    check_horizon(horizon_days)
    keys = ["loc_state", "loc_site_code"]
    frame = lifecycle_measures(with_lifecycle(mappable(devices), as_of, horizon_days))
    sums = ("m_devices", *(f"m_{b}" for b in BUCKETS), "m_days_known", "m_days")
    per_name = frame.groupBy(*keys, "device_name", "device_source", "loc_site_name").agg(*[F.sum(m).alias(m) for m in sums])
    # A name in two sources counts once: at its first source.
    one_name = Window.partitionBy(*keys, "device_name").orderBy("device_source", "loc_site_name")
    named = F.col("device_name").isNotNull() & (F.row_number().over(one_name) == 1)
    per_source = (
        per_name.withColumn("m_names", named.cast("bigint"))
        .groupBy(*keys, "device_source")
        .agg(F.collect_set("loc_site_name").alias("site_names"), *[F.sum(m).alias(m) for m in (*sums, "m_names")])
    )
    by_site = per_source.groupBy(*keys).agg(
        # The few names of a site; a minimum over texts would sort all rows.
        F.array_min(F.flatten(F.collect_list("site_names"))).alias("site_name"),
        total("names", "device_count"),
        total("days_known", "eol_known_devices"),
        total("overdue", "overdue_devices"),
        total("days", "remaining_days_total"),
        mean("days", "remaining_days_avg", weight="days_known"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("device_source", "m_devices")))).alias("sources"),
        total("devices", "total_devices"),
        *[total(b, f"{b}_count") for b in BUCKETS],
        total("days_known", "known_count"),
    )
    return (
        by_site.withColumn("consistent", F.col("device_count") == F.col("total_devices"))
        .withColumns({f"{b}_share": percent(f"{b}_count", "total_devices") for b in BUCKETS})
    )


def requested_locations(spark, requests: list[tuple[str, str]]) -> DataFrame:
    rows = [(check_state(s), check_site(c)) for s, c in requests]
    return spark.createDataFrame(rows, "loc_state string, loc_site_code string")


def location_summary(
    devices: DataFrame,
    requests: DataFrame,
    as_of: dt.date | str,
    horizon_days: int = DEFAULT_HORIZON_DAYS,
    strict: bool = True,
) -> DataFrame:
    """Summaries of the requested locations, with ``found`` and zero counts where there is none.

    The requests are measured: while they are few they are broadcast, and their
    states prune the scan of a dataset laid out by state. ``strict`` fails the job
    when names and rows of a location differ.
    """
    check_horizon(horizon_days)
    keys = ["loc_state", "loc_site_code"]
    (wanted,) = settle(requests.select(*keys).distinct())
    asked = wanted.table
    if wanted.n_rows <= PRUNING_REQUESTS:
        devices = devices.where(F.col("loc_state").isin([r[0] for r in asked.select("loc_state").distinct().collect()]))
    local = devices.join(F.broadcast(asked) if wanted.fits_broadcast else asked, keys, "left_semi")
    found = location_summaries(local, as_of, horizon_days)
    found = check_consistent(found) if strict else found
    # As many locations as requests at most, and that many are known to fit.
    out = asked.join(F.broadcast(found) if wanted.n_rows <= PRUNING_REQUESTS else found, keys, "left")
    counts = ["total_devices", "known_count", *(f"{b}_count" for b in BUCKETS)]
    return out.withColumns(
        {
            "found": F.col("total_devices").isNotNull(),
            "horizon_days": F.lit(int(horizon_days)),
            **{c: F.coalesce(c, F.lit(0)) for c in counts},
        }
    )


def check_consistent(summaries: DataFrame) -> DataFrame:
    """Fail the job when names and rows of a location differ (a join multiplied devices)."""
    message = F.concat(F.lit("location totals differ from bucket totals: "), "loc_state", F.lit("-"), "loc_site_code")
    return summaries.withColumn(
        "consistent", F.when(~F.col("consistent"), F.raise_error(message).cast("boolean")).otherwise(F.col("consistent"))
    )


def bucket_counts(devices: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """Devices per lifecycle bucket, as one row."""
    check_horizon(horizon_days)
    days = days_to_eol("modeldata_eol", as_of)
    named = devices.select(eol_bucket(days, horizon_days).alias("bucket"))
    known = F.count_if(F.col("bucket") != "unknown")
    return named.agg(
        F.count(F.lit(1)).alias("total_devices"),
        *[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in BUCKETS],
        known.alias("known_count"),
    )
