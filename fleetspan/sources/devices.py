"""Reading and writing the device dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lifecycle import eol_date
from ..functions.text import normalize_key, numeric, require_columns, source_label, strip
from ..operators.dataset import devices_from_tabs
from .tabs import Tabs

FILES_PER_STATE = 16
FINISHED = "_SUCCESS"  # fixed value: the marker of a committed write

REQUIRED = (
    "device_name", "loc_state", "loc_site_code", "loc_site_name", "loc_latitude", "loc_longitude", "modeldata_eol",
    "device_source",
)


def normalize_devices(df: DataFrame) -> DataFrame:
    """Check the required columns and bring keys, coordinates and dates to their types."""
    require_columns(df, REQUIRED, "device dataset")
    return df.withColumns(
        {
            "loc_state": normalize_key("loc_state"),
            "loc_site_code": normalize_key("loc_site_code"),
            "loc_site_name": strip("loc_site_name"),
            "loc_latitude": numeric(df, "loc_latitude"),
            "loc_longitude": numeric(df, "loc_longitude"),
            "modeldata_eol": eol_date(df),
            "device_source": source_label("device_source"),
        }
    )


def mappable(df: DataFrame) -> DataFrame:
    """Devices whose site can be put on a map."""
    return df.dropna(subset=["loc_state", "loc_site_code", "loc_latitude", "loc_longitude"])


class _Folder:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.at = self._path(path)
        self.store = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self) -> bool:
        return self.store.exists(self.at)

    def finished(self) -> bool:
        """Spark puts the marker into a folder when the job that writes it has committed."""
        return self.store.exists(self._path(self.at, FINISHED))

    def remove(self) -> None:
        self.store.delete(self.at, True)

    def rename(self, other: _Folder) -> None:
        if not self.store.rename(self.at, other.at):
            raise OSError(f"could not rename {self.at} to {other.at}")


def write_devices(df: DataFrame, path: str, by_state: bool = False) -> None:
    """Publish the dataset as Parquet; ``by_state`` lays it out for state filters, in a bounded number of files per state.

    It is written beside the path and then renamed. A reader sees the old dataset,
    the new one, or for a moment none, but never a part of one; a job that ends
    early leaves what was there before. Reading the path while writing it is fine.
    """
    spark, name = df.sparkSession, path.rstrip("/")
    target, fresh, old = (_Folder(spark, p) for p in (name, f"{name}.{uuid.uuid4().hex}.new", f"{name}.{uuid.uuid4().hex}.old"))
    if by_state:
        spread = F.pmod(F.xxhash64("device_name"), F.lit(FILES_PER_STATE))
        df.repartition("loc_state", spread).write.partitionBy("loc_state").parquet(fresh.at.toString())
    else:
        df.write.parquet(fresh.at.toString())
    replaced = target.there()
    if replaced:
        target.rename(old)
    try:
        fresh.rename(target)
    except Exception:
        if replaced and not target.there():
            old.rename(target)
        raise
    if replaced:
        old.remove()


def load_devices(spark: SparkSession, path: str, tabs: Tabs | None = None) -> DataFrame:
    """The finished dataset at the path; where there is none and tabs are given, it is built from them and published first.

    A folder without the marker of a finished job is not a dataset.
    """
    if not _Folder(spark, path.rstrip("/")).finished():
        if tabs is None:
            raise FileNotFoundError(f"PATH_NOT_FOUND: no finished device dataset at {path}")
        write_devices(normalize_devices(devices_from_tabs(tabs)), path)
    return normalize_devices(spark.read.parquet(path))
