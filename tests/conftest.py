import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetspan-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from fleetspan.operators.sizing import release_tables

    release_tables(session)
    session.stop()


@pytest.fixture(scope="session")
def tabs_from(spark):
    """Build all tabs from rows given as dicts; absent tabs are empty."""
    from fleetspan.sources.tabs import INVENTORY_TABS, ROW_INDEX, TAB_COLUMNS, TAB_ORDER

    def build(**rows):
        tabs = {}
        for tab in TAB_ORDER:
            columns = list(TAB_COLUMNS[tab]) or ["term"]
            types = [f"{c} string" for c in columns]
            given = rows.get(tab.replace("-", "_"), [])
            values = [tuple(r.get(c) for c in columns) for r in given]
            if tab in INVENTORY_TABS:
                types.append(f"{ROW_INDEX} bigint")
                values = [(*v, r.get(ROW_INDEX, i)) for i, (v, r) in enumerate(zip(values, given))]
            tabs[tab] = spark.createDataFrame(values, ", ".join(types))
        return tabs

    return build
