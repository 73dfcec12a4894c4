"""Inventory tabs: contracts, all-text typing and reading per-tab exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import null_tokens, snake_columns
from ..operators.sizing import join_dimension, settle, written_table

# Tab names in their required order.
TAB_ORDER = (
    "SOLID", "SOLID-Loc", "NA", "PrimeAP", "PrimeWLC", "CatCtr", "Decom", "ModelData", "Pricing", "Glossary",
)
DATASET_TABS = ("CatCtr", "ModelData", "NA", "Pricing", "PrimeAP", "PrimeWLC", "SOLID", "SOLID-Loc")
INVENTORY_TABS = ("CatCtr", "PrimeAP", "PrimeWLC", "NA")

# The columns each tab is read for, in snake case.
TAB_COLUMNS = {
    "SOLID": ("site_code", "state", "site_name", "street_address_1", "street_address_2", "city", "zip"),
    "SOLID-Loc": (
        "site_code", "site_name", "latitude", "longitude", "physicaladdresscounty", "call_group", "owner",
    ),
    "NA": (
        "host_name", "device_model", "device_ip", "device_type", "device_status", "device_vendor", "serial_number",
        "software_version", "firmware_version", "uptime", "free_ports", "total_ports", "ports_in_use",
    ),
    "PrimeAP": (
        "name", "model", "ipaddress", "status", "serialnumber", "softwareversion", "type", "controlleripaddress",
        "controllername", "uptime", "countrycode",
    ),
    "PrimeWLC": (
        "devicename", "manufacturer_part_partnumber", "ipaddress", "reachability",
        "manufacturer_part_serialnumber", "softwareversion", "softwaretype", "devicetype", "productfamily",
        "adminstatus", "location",
    ),
    "CatCtr": (
        "hostname", "platformid", "dnsresolvedmanagementaddress", "family", "reachabilitystatus", "serialnumber",
        "softwareversion", "type", "vendor", "associatedwlcip", "managementstate", "role",
    ),
    "Decom": ("site_cd",),
    "ModelData": (
        "model", "model_parent", "category", "in_scope", "repl_device", "eos", "eol", "dna_y_n", "dna_part_number",
        "stg_config_y_n", "de_hrs", "se_hrs", "fot_hrs", "pm_hrs", "de_cost", "se_cost", "fot_cost", "labor_cost",
        "device_cost", "dna_cost", "staging_cost", "tax_oh", "material_cost",
    ),
    "Pricing": ("parent_product", "product", "device", "pricing", "labor_de", "labor_se", "labor_fo"),
    "Glossary": (),
}

ROW_INDEX = "source_row_index"
Tabs = dict[str, DataFrame]


def check_tab_set(tabs: Tabs) -> None:
    """The whole workbook: exact names in the exact order."""
    if tuple(tabs) != TAB_ORDER:
        raise ValueError(f"expected the tabs {list(TAB_ORDER)}, got {list(tabs)}")


def check_dataset_tabs(tabs: Tabs) -> None:
    """The tabs the device dataset needs, in any order."""
    missing = sorted(set(DATASET_TABS) - set(tabs))
    if missing:
        raise ValueError(f"required tabs are missing: {missing}")


def conform(name: str, df: DataFrame) -> DataFrame:
    """One tab with every cell as text and the columns it is read for present.

    The row index stays a long. A timestamp at midnight is a date and is written as one.
    """
    kinds = dict(df.dtypes)
    columns = [*df.columns, *(c for c in TAB_COLUMNS[name] if c not in df.columns)]
    if name in INVENTORY_TABS and ROW_INDEX not in columns:
        columns.append(ROW_INDEX)
    cells = []
    for c in columns:
        cell = F.col(f"`{c}`") if c in df.columns else F.lit(None)
        if kinds.get(c, "").startswith("timestamp"):
            cell = F.when(cell == F.date_trunc("day", cell), F.date_format(cell, "yyyy-MM-dd")).otherwise(cell.cast("string"))
        cells.append(cell.cast("bigint" if c == ROW_INDEX else "string").alias(c))
    return df.select(*cells)


def _sums_before(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_before``: the rows (``_n``) of all parts that sort first. A row per file or part of a file, in one task."""
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _counts_rows(scan: DataFrame) -> bool:
    """Does the format tell the position of a row in its file?"""
    try:
        scan.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def number_rows(scan: DataFrame) -> DataFrame:
    """Add the row number, from 0, in the order of the files by name and of the rows in each file.

    Must be applied to the scan itself. The numbers do not depend on how Spark
    splits the files, which changes with the settings and the cores at hand. Parquet
    tells the position of each row, so the rows of the files before are added. Other
    formats do not: their rows are written once with the part of the file and the
    place that one and the same scan saw, and numbered from that. The tables of files
    and parts are measured before they are joined; a row without a number is an error.
    """
    columns = [f"`{c}`" for c in scan.columns]
    path = F.col("_metadata.file_path").alias("_path")
    if _counts_rows(scan):
        keys = ["_path"]
        placed = scan.select(*columns, path, F.col("_metadata.row_index").alias("_place"))
        sizes = scan.select(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_first"))
    else:
        keys = ["_path", "_start"]
        seen = scan.select(*columns, path, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"))
        placed = written_table(seen)
        sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    known = _sums_before(sizes, keys).select(*[F.col(k).alias(f"{k}_of") for k in keys], "_before", "_first")
    joined = join_dimension(placed, settle(known)[0], [(k, f"{k}_of") for k in keys], spread_by="_place")
    number = F.col("_before") + F.col("_place") - F.col("_first")
    lost = F.raise_error(F.lit("a row of a file that was not there when its rows were counted")).cast("bigint")
    return joined.select(*columns, F.coalesce(number, lost).alias(ROW_INDEX))


def read_tab(spark: SparkSession, path: str, name: str, fmt: str, multiline: bool = False) -> DataFrame:
    """One tab. ``multiline`` accepts line breaks in CSV cells, at the price of one task per file."""
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"')
    else:
        raw = spark.read.format(fmt).load(path)
    if name in INVENTORY_TABS and ROW_INDEX not in snake_columns(raw).columns:
        raw = number_rows(raw)
    return conform(name, snake_columns(null_tokens(raw) if fmt == "csv" else raw))


def read_tabs(spark: SparkSession, directory: str, fmt: str = "parquet", multiline: bool = False) -> Tabs:
    """Read one export per tab (``<directory>/<tab name>.<fmt>``, a path or URI), all cells untyped."""
    if fmt not in ("parquet", "csv", "orc"):
        raise ValueError(f"unsupported tab format: {fmt}")
    return {n: read_tab(spark, f"{directory.rstrip('/')}/{n}.{fmt}", n, fmt, multiline) for n in TAB_ORDER}


def tab_shapes(tabs: Tabs) -> DataFrame:
    """Rows and columns of every tab."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("tab"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for n, df in tabs.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
