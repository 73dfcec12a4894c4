"""Checks on the physical plans, and of the queries against their SQL twins."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from checks.compare import connection, difference  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from checks.twins import TWINS  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "device_dataset", "cross_source_filter", "filter_audit", "site_clusters", "metric_domain", "cluster_urgency",
        "location_summary_horizon", "site_summary", "state_exposure", "rep_days_hist", "rep_days_kde", "rep_owner_box",
        "rep_source_mix", "missing_rates", "ml_folds", "weight_grid", "macro_auc", "roc_points", "confidence_hist",
    ],
)
def test_plan_stays_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    for bad in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition, ENSURE_REQUIREMENTS, [id=none"):
        assert bad not in text


def test_flagship_plan(spark):
    text = plan(QUERIES["top_overdue_sites"](spark, DATA))
    # One shuffle to choose a row per name, one to sum up sites.
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("WindowGroupLimit") == 2 and "TakeOrderedAndProject" in text
    assert text.count("SortMergeJoin") == 0
    # Only the columns in use are read, with the filters pushed into the files.
    assert text.count("lineitem.parquet]") == 4
    assert "l_extendedprice" not in text and "PushedFilters: [IsNotNull(l_linenumber), IsNotNull(l_suppkey)]" in text


def test_sites_multiply_devices_last(spark):
    """Whatever is shuffled for models or prices moves before sites that share a code multiply the devices."""
    for name in ("device_dataset", "clean_devices", "device_metrics"):
        logical = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        outermost = next(line for line in logical.splitlines() if "Join " in line)
        assert "loc_site_code" in outermost


def test_split_writes_the_columns_in_use(spark, monkeypatch):
    from checks import registry

    written = []
    monkeypatch.setattr(registry, "written_table", lambda df: written.append(df.columns) or df.localCheckpoint())
    QUERIES["split_distribution"](spark, DATA)
    QUERIES["split_stats"](spark, DATA)
    assert written == [["device_name", "target", "model_group"], ["device_name", "target", "model_group", "device_model"]]


def test_audit_plan(spark):
    """Each inventory is read once, nothing is joined to count: one exchange of hosts, one of sites."""
    for name in ("filter_audit", "tabs_row_counts"):
        text = plan(QUERIES[name](spark, DATA))
        main = text.split("Subquery:")[0].split("+- == Initial Plan ==")[0]
        assert text.count("SortMergeJoin") == 0
        assert main.count("Exchange hashpartitioning") <= 2 and main.count("lineitem.parquet]") == 4


def test_membership_plan(spark):
    """The better sources are merged once; every inventory meets what it gave."""
    df = QUERIES["cross_source_filter"](spark, DATA)
    df.collect()  # exchanges are shared while the plan runs
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") >= 2 and text.count("lineitem.parquet]") <= 6


def test_location_lookup_plan(spark):
    """The few requested locations are known to the scan and broadcast; the devices are neither shuffled nor sorted for them."""
    text = plan(QUERIES["location_summary"](spark, DATA))
    assert "SortMergeJoin" not in text and "SortAggregate" not in text and "LeftSemi" in text
    assert "SortAggregate" not in plan(QUERIES["location_summary_horizon"](spark, DATA))


def test_skewed_anti_join_is_split(spark):
    from pyspark.sql import functions as F

    from fleetspan.operators.sizing import absent_from

    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60000, 1, 6).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad")
        )
        right = spark.range(0, 30000).select(F.concat(F.lit("k"), "id").alias("k"))
        out = absent_from(left, "k", (right, "k"))
        assert out.count() == 40000 + 10000
        collected = out.agg(F.count_distinct("pad"))
        collected.collect()
        assert "skew=true" in plan(collected)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


def test_every_operator_is_registered():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) - set(TWINS) == {"ml_train_score"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    assert difference(QUERIES[name](spark, DATA), duck.sql(TWINS[name])) is None
