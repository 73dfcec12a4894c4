"""Lifecycle, risk and cost expressions for a reference date and a horizon."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, to_date, with_optional

# Fixed values.
DEFAULT_HORIZON_DAYS = 365
BUCKETS = ("overdue", "within_horizon", "future", "unknown")
BASE_RISK = {"overdue": 80.0, "within_horizon": 50.0, "future": 20.0, "unknown": 45.0}
MISSING_VERSION_RISK = 10.0
UNKNOWN_COVERAGE = 30.0
COVERAGE_LEAD_DAYS = 365.0
COVERAGE_SPAN_DAYS = 1460.0


def check_horizon(horizon_days: int) -> int:
    if horizon_days < 0:
        raise ValueError("horizon_days must be >= 0")
    return int(horizon_days)


def as_date(as_of: dt.date | str) -> Column:
    day = dt.date.fromisoformat(as_of[:10]) if isinstance(as_of, str) else as_of
    return F.lit(day).cast("date")


def eol_date(df: DataFrame, name: str = "modeldata_eol") -> Column:
    """The EoL column as a date, whatever type it arrives in."""
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.col(name)
    return F.to_date(name) if kind.startswith("timestamp") else to_date(name)


def days_to_eol(eol: Column | str, as_of: dt.date | str) -> Column:
    """Days from the reference date to EoL; negative when past, null when unknown."""
    return F.date_diff(col(eol), as_date(as_of))


def eol_bucket(days: Column | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> Column:
    d = col(days)
    return (
        F.when(d.isNull(), "unknown")
        .when(d < 0, "overdue")
        .when(d <= check_horizon(horizon_days), "within_horizon")
        .otherwise("future")
    )


def is_overdue(days: Column | str) -> Column:
    return F.coalesce(col(days) < 0, F.lit(False))


def weighted_days(days: Column | str) -> Column:
    """Remaining days; days past EoL weigh double."""
    d = col(days)
    return F.when(d >= 0, d).otherwise(d * 2)


def replacement_cost(pricing: Column | str, material: Column | str) -> Column:
    return F.coalesce(col(pricing), col(material), F.lit(0.0))


def support_coverage(days: Column | str) -> Column:
    d = col(days)
    score = (d + F.lit(COVERAGE_LEAD_DAYS)) / F.lit(COVERAGE_SPAN_DAYS) * 100.0
    return F.when(d.isNull(), UNKNOWN_COVERAGE).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def security_risk(bucket: Column | str, version_missing: Column | str) -> Column:
    b = col(bucket)
    base = F.lit(BASE_RISK["unknown"])
    for name in BUCKETS:
        base = F.when(b == name, BASE_RISK[name]).otherwise(base)
    extra = F.when(col(version_missing), MISSING_VERSION_RISK).otherwise(0.0)
    return F.least(F.greatest(base + extra, F.lit(0.0)), F.lit(100.0))


def near_term_cost(bucket: Column | str, cost: Column | str) -> Column:
    return F.when(col(bucket).isin("overdue", "within_horizon"), col(cost)).otherwise(0.0)


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole, and 0 for an empty whole."""
    p, w = col(part), col(whole)
    return F.when(w > 0, p / w * 100.0).otherwise(0.0)


OPTIONAL_INPUTS = {
    "modeldata_eol": "date",
    "pricing_total_estimate": "double",
    "modeldata_material_cost": "double",
    "modeldata_labor_cost": "double",
    "software_version": "string",
    "firmware_version": "string",
}


def with_lifecycle(df: DataFrame, as_of: dt.date | str, horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """Add the derived lifecycle, score and cost columns in three projections that Catalyst merges."""
    check_horizon(horizon_days)
    df = with_optional(df, OPTIONAL_INPUTS)
    return (
        df.withColumns(
            {
                "days_to_eol": days_to_eol(eol_date(df), as_of),
                "replacement_cost_estimate": replacement_cost("pricing_total_estimate", "modeldata_material_cost"),
                "labor_cost_estimate": F.coalesce("modeldata_labor_cost", F.lit(0.0)),
                "version_missing": F.isnull("software_version") & F.isnull("firmware_version"),
            }
        )
        .withColumns(
            {
                "eol_bucket": eol_bucket("days_to_eol", horizon_days),
                "support_coverage_score": support_coverage("days_to_eol"),
            }
        )
        .withColumns(
            {
                "security_risk_score": security_risk("eol_bucket", "version_missing"),
                "near_term_cost_component": near_term_cost("eol_bucket", "replacement_cost_estimate"),
            }
        )
    )


def exact(value: Column | str) -> Column:
    """A score or an amount as a decimal: sums of it do not depend on the order of the rows, so neither do ranks by them."""
    return col(value).cast("decimal(28,9)")


def lifecycle_measures(df: DataFrame) -> DataFrame:
    """Additive measures per row (``m_*``); sums of them feed every count, total and mean."""
    bucket = F.col("eol_bucket")
    return df.withColumns(
        {
            "m_devices": F.lit(1).cast("bigint"),
            **{f"m_{b}": (bucket == b).cast("bigint") for b in BUCKETS},
            "m_days_known": F.col("days_to_eol").isNotNull().cast("bigint"),
            "m_days": F.col("days_to_eol").cast("bigint"),
            "m_weighted_days": weighted_days("days_to_eol").cast("bigint"),
            "m_coverage": exact("support_coverage_score"),
            "m_risk": exact("security_risk_score"),
            "m_replacement": exact("replacement_cost_estimate"),
            "m_near_term": exact("near_term_cost_component"),
            "m_labor": exact("labor_cost_estimate"),
        }
    )


MEASURES = (
    "m_devices", *(f"m_{b}" for b in BUCKETS), "m_days_known", "m_days", "m_weighted_days",
    "m_coverage", "m_risk", "m_replacement", "m_near_term", "m_labor",
)


# Measures that are decimals; what is reported of them are doubles.
DECIMALS = ("coverage", "risk", "replacement", "near_term", "labor")


def total(measure: str, name: str) -> Column:
    added = F.sum(f"m_{measure}")
    return (added.cast("double") if measure in DECIMALS else added).alias(name)


def mean(measure: str, name: str, weight: str = "devices") -> Column:
    """Mean of a measure over its rows; null where no row has one."""
    return F.try_divide(F.sum(f"m_{measure}").cast("double"), F.sum(f"m_{weight}")).alias(name)
