"""Summaries of scored devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lifecycle import percent
from ..operators.sizing import written_table
from ..sources.predictions import CLASS_LABELS

# Fixed values.
CLASS_ORDER = (-1, 1, 0)
BIN_EDGES = (0.2, 0.4, 0.6, 0.8, 1.0)
BIN_LABELS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")


def in_class(c: int) -> Column:
    return F.col("predicted_behavior_class") == c


def class_label(c: Column | str = "predicted_behavior_class") -> Column:
    value = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("string")
    for number, label in CLASS_LABELS.items():
        out = F.when(value == number, label).otherwise(out)
    return out


def at_risk() -> Column:
    return F.col("predicted_behavior_class").isin(-1, 1)


def prediction_kpis(scored: DataFrame) -> DataFrame:
    """Counts per class and the share at risk, as one row."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_scored"),
        F.count_if(in_class(-1)).alias("predicted_passed_eol"),
        F.count_if(in_class(1)).alias("predicted_within_365"),
        F.count_if(in_class(0)).alias("predicted_gt_365"),
        F.count_if(at_risk()).alias("predicted_risk_total"),
    ).withColumn("predicted_risk_rate", percent("predicted_risk_total", "total_scored"))


def class_mix(scored: DataFrame) -> DataFrame:
    """One row per class in fixed order, zero where a class has no rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(place).alias("position"),
                F.lit(c).alias("class_id"),
                F.lit(CLASS_LABELS[c]).alias("label"),
                F.count_if(in_class(c)).alias("n_rows"),
                F.count(F.lit(1)).alias("n_all"),
            )
            for place, c in enumerate(CLASS_ORDER, 1)
        ]
    )
    return scored.agg(rows.alias("rows")).select(F.inline("rows")).select(
        "position", "class_id", "label", F.col("n_rows").alias("n_devices"),
        percent("n_rows", "n_all").alias("share_pct"),
    )


def _risk_by(scored: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return (
        scored.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(name))
        .agg(
            F.count(F.lit(1)).alias("total_devices"),
            F.count_if(at_risk()).alias("predicted_risk_devices"),
            F.count_if(in_class(-1)).alias("predicted_passed_eol"),
            F.count_if(in_class(1)).alias("predicted_within_365"),
        )
        .orderBy(F.desc("predicted_risk_devices"), F.desc("predicted_passed_eol"), F.desc("total_devices"), name)
        .limit(n)
    )


def state_risk(scored: DataFrame, n: int = 15) -> DataFrame:
    return _risk_by(scored, "loc_state", "state", n).withColumn(
        "predicted_risk_rate", percent("predicted_risk_devices", "total_devices")
    )


def model_risk(scored: DataFrame, n: int = 12) -> DataFrame:
    return _risk_by(scored, "device_model", "device_model", n)


def source_mix(scored: DataFrame) -> DataFrame:
    return (
        scored.groupBy("device_source")
        .agg(
            F.count(F.lit(1)).alias("total_devices"),
            F.count_if(in_class(-1)).alias("predicted_passed_eol"),
            F.count_if(in_class(1)).alias("predicted_within_365"),
            F.count_if(in_class(0)).alias("predicted_gt_365"),
        )
        .orderBy(F.desc("total_devices"), "device_source")
    )


def confidence_bin(c: Column | str) -> Column:
    """Bin 1..5, closed on the right; values beyond 0..1 are clipped, null has no bin."""
    value = F.col(c) if isinstance(c, str) else c
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(BIN_EDGES[:-1], 1):
        out = out.when(value <= edge, i)
    return out.otherwise(len(BIN_EDGES))


def confidence_histogram(scored: DataFrame) -> DataFrame:
    """Five bins, zero-filled; no rows when no device has a confidence."""
    place = F.col("place")
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("bin"), F.count_if(place == i).alias("n_devices"))
            for i, label in enumerate(BIN_LABELS, 1)
        ]
    )
    return (
        scored.select(confidence_bin("prediction_confidence").alias("place"))
        .filter(place.isNotNull())
        .agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"))
        .filter(F.col("n") > 0)
        .select(F.inline("rows"))
    )


def prediction_mix(scored: DataFrame, n: int = 12) -> DataFrame:
    """Data of the prediction chart: devices per class label, then the states most at risk."""
    classes = class_mix(scored).select(
        F.lit("class").alias("part"), F.col("position").cast("bigint").alias("position"),
        F.col("label").alias("name"), F.col("n_devices").alias("total_devices"),
        F.lit(None).cast("bigint").alias("predicted_risk_devices"),
    )
    states = (
        scored.filter(F.col("loc_state").isNotNull())
        .groupBy(F.col("loc_state").alias("name"))
        .agg(F.count(F.lit(1)).alias("total_devices"), F.count_if(at_risk()).alias("predicted_risk_devices"))
        .orderBy(F.desc("predicted_risk_devices"), F.desc("total_devices"), "name")
        .limit(n)
        .select(
            F.lit("state").alias("part"), F.lit(None).cast("bigint").alias("position"), "name", "total_devices",
            "predicted_risk_devices",
        )
    )
    return classes.unionAll(states)


def most_confident(scored: DataFrame, n: int = 15) -> DataFrame:
    return scored.orderBy(
        F.desc_nulls_last("prediction_confidence"),
        *[F.asc_nulls_last(c) for c in scored.columns if c != "prediction_confidence"],
    ).limit(n)


def inferences(scored: DataFrame | None) -> dict:
    """All summaries and whether there are any scored devices at all."""
    if scored is None:
        return {"available": False}
    compact = ("predicted_behavior_class", "prediction_confidence", "loc_state", "device_model", "device_source")
    scored = written_table(scored.select(*compact))
    return {
        "available": not scored.isEmpty(),
        "kpis": prediction_kpis(scored),
        "class_mix": class_mix(scored),
        "state_risk": state_risk(scored),
        "model_risk": model_risk(scored),
        "source_mix": source_mix(scored),
        "confidence_distribution": confidence_histogram(scored),
    }
