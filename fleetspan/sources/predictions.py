"""Reading and writing the table of scored devices."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_key, numeric, require_columns, strip, with_optional

# Fixed values.
CLASSES = (-1, 0, 1)
CLASS_LABELS = {-1: "Likely Passed EoL", 1: "Likely EoL <= 365d", 0: "Likely EoL > 365d"}

SCHEMA = {
    "predicted_behavior_class": "int",
    "prediction_confidence": "double",
    "loc_state": "string",
    "device_model": "string",
    "device_source": "string",
}


def normalize_predictions(df: DataFrame) -> DataFrame:
    """Keep rows of a known class, fill absent columns, bring all to their types."""
    require_columns(df, ["predicted_behavior_class"], "predictions")
    df = with_optional(df, SCHEMA)
    label = numeric(df, "predicted_behavior_class")
    return df.filter(label.isin(*CLASSES)).withColumns(
        {
            "predicted_behavior_class": label.cast("int"),
            "prediction_confidence": numeric(df, "prediction_confidence"),
            "loc_state": normalize_key("loc_state"),
            "device_model": strip("device_model"),
            "device_source": F.coalesce(strip("device_source"), F.lit("NA")),
        }
    )


def load_predictions(spark: SparkSession, candidates: list[str]) -> DataFrame | None:
    """The first of the candidate tables that exists, or None."""
    for path in candidates:
        try:
            found = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return normalize_predictions(found)
    return None


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
