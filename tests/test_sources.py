import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetspan.functions.text import to_date
from fleetspan.plans.evaluation import macro_auc
from fleetspan.sources.devices import load_devices, normalize_devices, write_devices
from fleetspan.sources.tabs import ROW_INDEX, conform, number_rows, read_tabs
from fleetspan.operators.dataset import devices_from_tabs


def written(tabs, folder, fmt="parquet"):
    for name, df in tabs.items():
        df.write.format(fmt).save(f"{folder}/{name}.{fmt}")


def test_tabs_from_a_uri(spark, tabs_from, tmp_path):
    written(tabs_from(SOLID=[{"state": "GA", "site_code": "ABC"}]), tmp_path)
    for directory in (f"file://{tmp_path}", f"file://{tmp_path}/"):
        assert read_tabs(spark, directory)["SOLID"].count() == 1


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_rows_are_numbered_in_file_order(spark, tmp_path, fmt):
    """The later file is the longer one, which Spark reads first."""
    sizes, first = (3, 900, 40), 0
    for part, size in enumerate(sizes):
        df = spark.range(first, first + size, 1, 1).select(F.col("id").cast("string").alias("n"), F.lit("x" * 50).alias("pad"))
        df.write.option("header", True).format(fmt).save(str(tmp_path / f"in{part}"))
        (source,) = (p for p in (tmp_path / f"in{part}").iterdir() if p.name.startswith("part-"))
        (tmp_path / "tab").mkdir(exist_ok=True)
        (tmp_path / "tab" / f"part-{part}.{fmt}").write_bytes(source.read_bytes())
        first += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = spark.read.option("header", True).format(fmt).load(str(tmp_path / "tab"))
        got = [int(r["n"]) for r in number_rows(scan).orderBy(ROW_INDEX).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(sum(sizes)))


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path, fmt):
    """The split size changes between planning and running, and between two readings."""
    df = spark.range(0, 4000, 1, 1).select(F.col("id").cast("string").alias("n"), F.lit("x" * 40).alias("pad"))
    options = {"parquet.block.size": "8192"} if fmt == "parquet" else {}
    df.coalesce(1).write.options(header=True, **options).format(fmt).save(str(tmp_path / "t"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    found = []
    try:
        for planned, run in (("16384", "30000"), ("70000", "9000")):
            spark.conf.set(name, planned)
            numbered = number_rows(spark.read.option("header", True).format(fmt).load(str(tmp_path / "t")))
            spark.conf.set(name, run)
            found.append([(int(r["n"]), r[ROW_INDEX]) for r in numbered.orderBy(ROW_INDEX).collect()])
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] == [(k, k) for k in range(4000)]


def test_an_empty_tab_has_no_numbers(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        spark.range(0).select(F.col("id").cast("string").alias("n")).write.option("header", True).format(fmt).save(str(tmp_path / fmt))
        assert number_rows(spark.read.schema("n string").option("header", True).format(fmt).load(str(tmp_path / fmt))).count() == 0


def test_an_aborted_write_is_no_dataset(spark, tabs_from, tmp_path):
    tabs = tabs_from(NA=[{"host_name": "GAABC-1", "device_model": "m"}])
    path = tmp_path / "devices"
    write_devices(normalize_devices(devices_from_tabs(tabs)), str(path))
    (path / "_SUCCESS").unlink()  # as a job leaves it that ends early
    with pytest.raises(FileNotFoundError, match="finished"):
        load_devices(spark, str(path))
    assert load_devices(spark, str(path), tabs).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["devices"]


def test_a_failed_write_leaves_the_dataset(spark, tabs_from, tmp_path):
    path = str(tmp_path / "devices")
    devices = normalize_devices(devices_from_tabs(tabs_from(NA=[{"host_name": "GAABC-1", "device_model": "m"}])))
    write_devices(devices, path)
    broken = devices.withColumn("device_name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        write_devices(broken, path)
    assert load_devices(spark, path).count() == 1
    # A dataset may be written from itself.
    write_devices(load_devices(spark, path).withColumn("uptime", F.lit("7")), path)
    assert load_devices(spark, path).first()["uptime"] == "7"


def test_timestamps_of_dates_survive(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2), "m"), (dt.datetime(2025, 1, 2, 3), "n"), (None, "o")], "eol timestamp, model string")
    texts = [r["eol"] for r in conform("ModelData", df).orderBy("model").collect()]
    assert texts == ["2025-01-02", "2025-01-02 03:00:00", None]
    shown = spark.createDataFrame([("2025-01-02 00:00:00",), ("2025-01-02T00:00:00.000",), ("2025-01-02 01:00:00",), ("x",)], "t string")
    assert [r[0] for r in shown.select(to_date("t")).collect()] == [dt.date(2025, 1, 2)] * 2 + [None] * 2


def test_dataset_is_built_where_absent(spark, tabs_from, tmp_path):
    tabs = tabs_from(NA=[{"host_name": "GAABC-1", "device_model": "m"}, {"host_name": "GAABD-1", "device_model": "m"}])
    path = str(tmp_path / "devices")
    built = load_devices(spark, path, tabs)
    assert built.count() == 2
    assert load_devices(spark, path).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_devices(spark, str(tmp_path / "none"))


def test_few_files_per_state(spark, tabs_from, tmp_path):
    tabs = tabs_from(NA=[{"host_name": f"GAABC-{k}", "device_model": "m"} for k in range(200)])
    devices = normalize_devices(devices_from_tabs(tabs)).repartition(40)
    write_devices(devices, str(tmp_path / "d"), by_state=True)
    assert 1 <= len(list((tmp_path / "d").glob("loc_state=*/*.parquet"))) <= 16


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_scores_are_an_error(spark, missing):
    df = spark.createDataFrame([(0, 0.1, 0.9), (1, missing, 0.2)], "y int, a double, b double")
    with pytest.raises(Exception, match="missing score"):
        macro_auc(df, "y", {0: "a", 1: "b"}).collect()
