"""The registered queries: one per operator, over the whole tables of a directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.functions import scores, text
from fleetspan.functions.lifecycle import days_to_eol, eol_bucket
from fleetspan.operators import dataset, filters
from fleetspan.operators.sizing import generation, new_folder, written_table
from fleetspan.plans import clusters, evaluation, findings, inferences, model, reports
from fleetspan.sources.binding import AS_OF, HORIZON, bind_tabs, view
from fleetspan.sources.devices import mappable, normalize_devices
from fleetspan.sources.predictions import normalize_predictions
from fleetspan.sources.tabs import INVENTORY_TABS, ROW_INDEX, Tabs, read_tabs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The registered forest has the library's defaults (500 trees) and is fitted on all training rows.
TRAINING = model.TrainingOptions()
# Elements of an embedding, each taken for a logit.
LOGITS = 64
SCORES = {-1: "p_passed", 0: "p_beyond", 1: "p_within"}


def query(key: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[key] = function
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of the rows; compare them rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


class Fleet:
    """Tabs of one directory, the filters the dataset needs, and its written dimensions."""

    def __init__(self, spark: SparkSession, d: str):
        self.tabs = bind_tabs(spark, d)
        # The dataset is the same with all filters.
        self.filtered = filters.apply_filters(self.tabs, cross_source=False)

    @cached_property
    def dims(self) -> dataset.Dimensions:
        return dataset.dimensions(self.filtered)

    @cached_property
    def devices(self) -> DataFrame:
        return normalize_devices(dataset.device_dataset(self.filtered, self.dims))


_FLEET: dict[tuple[str, int, str], Fleet] = {}


def fleet(spark: SparkSession, d: str) -> Fleet:
    """Queries on one directory share the small written dimensions until ``release_tables`` deletes them; not the devices."""
    key = (spark.sparkContext.applicationId, generation(spark), d)
    if key not in _FLEET:
        _FLEET.clear()
        _FLEET[key] = Fleet(spark, d)
    return _FLEET[key]


def devices(spark: SparkSession, d: str) -> DataFrame:
    return fleet(spark, d).devices


def on_fleet(key: str, function: Callable[[Fleet], DataFrame]) -> None:
    QUERIES[key] = lambda spark, d: function(fleet(spark, d))


def on_tabs(key: str, function: Callable[[Tabs], DataFrame]) -> None:
    on_fleet(key, lambda f: function(f.tabs))


def on_filtered(key: str, function: Callable[[Tabs], DataFrame]) -> None:
    on_fleet(key, lambda f: function(f.filtered))


def on_devices(key: str, function: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[key] = lambda spark, d: function(devices(spark, d))


def on_findings(key: str, function: Callable[[DataFrame], DataFrame]) -> None:
    on_devices(key, lambda df: function(findings.findings_frame(df, AS_OF, HORIZON)))


def on_reports(key: str, function: Callable[[DataFrame], DataFrame]) -> None:
    on_devices(key, lambda df: function(reports.report_frame(df, AS_OF, HORIZON)))


def on_predictions(key: str, function: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[key] = lambda spark, d: function(normalize_predictions(view(spark, d, "predictions")))


def on_scored(key: str, function: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[key] = lambda spark, d: function(view(spark, d, "scored"))


# --- tabs, keys, filters -----------------------------------------------------


on_tabs("tabs_row_counts", filters.tab_counts)


@query("read_tabs_roundtrip")
def read_tabs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The tabs written as files without row numbers, read back, numbered by their place, and reduced to a row per name."""
    folder = new_folder(spark, "tabs")
    for name, tab in fleet(spark, d).tabs.items():
        if name in INVENTORY_TABS:
            tab = tab.repartitionByRange(ROW_INDEX).sortWithinPartitions(ROW_INDEX).drop(ROW_INDEX)
        tab.write.parquet(f"{folder}/{name}.parquet")
    tabs = filters.apply_filters(read_tabs(spark, folder), cross_source=False)
    return dataset.best_source_rows(dataset.device_union(tabs)).select("device_name", "device_source", "device_model")


on_tabs(
    "null_tokens",
    lambda t: text.null_tokens(t["Pricing"].select("parent_product", "product", "device", "pricing")),
)
on_tabs(
    "normalize_keys",
    lambda t: t["CatCtr"].select(
        "source_row_index",
        "hostname",
        text.normalize_key("hostname", strip_domain=True).alias("host_key"),
        text.normalize_key("hostname").alias("host_text"),
    ),
)
on_tabs(
    "filter_catctr",
    lambda t: filters.filter_catctr(t["CatCtr"]).select("hostname", "family", "reachabilitystatus", "source_row_index"),
)
on_tabs(
    "filter_na",
    lambda t: filters.filter_na(t["NA"]).select("host_name", "device_type", "device_status", "source_row_index"),
)
on_tabs("filter_modeldata", lambda t: filters.filter_modeldata(t["ModelData"]).select("model", "category"))
on_tabs(
    "active_sites",
    lambda t: filters.active_sites(t["SOLID"], t["Decom"])
    .select(F.lit("SOLID").alias("tab"), "site_code")
    .unionAll(filters.active_sites(t["SOLID-Loc"], t["Decom"]).select(F.lit("SOLID-Loc"), "site_code")),
)


@query("cross_source_filter")
def cross_source_filter(spark: SparkSession, d: str) -> DataFrame:
    tabs = fleet(spark, d).tabs
    kept = filters.drop_cross_source(
        filters.filter_catctr(tabs["CatCtr"]), tabs["PrimeAP"], tabs["PrimeWLC"], tabs["NA"]
    )
    hosts = {"PrimeAP": "name", "PrimeWLC": "devicename", "NA": "host_name"}
    parts = [
        kept[n].select(F.lit(n).alias("tab"), F.col(c).alias("host"), "source_row_index") for n, c in hosts.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


on_tabs("overlap_hosts", filters.overlap_hosts)
on_tabs(
    "site_coverage_gaps",
    lambda t: filters.site_coverage_gaps(
        filters.active_sites(t["SOLID"], t["Decom"]), filters.active_sites(t["SOLID-Loc"], t["Decom"])
    ),
)
on_tabs(
    "na_value_counts",
    lambda t: filters.value_counts(filters.apply_filters(t)["NA"], ["device_type", "device_status"]),
)
on_tabs("filter_audit", filters.filter_audit)

# --- device dataset ----------------------------------------------------------

on_tabs(
    "source_frames",
    lambda t: dataset.device_union(t).select(
        "device_source", "source_device_id", "device_name", "device_model_raw", "device_model", "source_row_index"
    ),
)
on_tabs("device_union", lambda t: dataset.device_union(filters.apply_filters(t)))
on_tabs(
    "device_type",
    lambda t: dataset.with_device_type(dataset.device_union(filters.apply_filters(t))).select(
        "device_name", "device_source", "source_row_index", "device_type"
    ),
)
on_filtered(
    "device_dedup",
    lambda t: dataset.best_source_rows(dataset.device_union(t)).select(
        "device_name", "device_source", "source_row_index", "device_model"
    ),
)
on_filtered("device_codes", lambda t: dataset.deduplicated(t).select("device_name", "state_code", "site_code"))
on_filtered("location_dim", lambda t: dataset.location_dim(t["SOLID"], t["SOLID-Loc"]))
on_filtered("model_dim", lambda t: dataset.model_dim(t["ModelData"]))
on_tabs("pricing_rollup", lambda t: dataset.pricing_rollup(t["Pricing"]))
on_tabs("pricing_dim", lambda t: dataset.pricing_dim(t["Pricing"]))
on_fleet(
    "device_location",
    lambda f: dataset.join_location(dataset.deduplicated(f.filtered), f.dims.location).select(
        "device_name", "loc_state", "loc_site_code", "loc_site_name", "loc_latitude", "loc_longitude",
        "location_matched",
    ),
)
on_fleet(
    "device_model_join",
    lambda f: dataset.join_model(dataset.deduplicated(f.filtered), f.dims.model).select(
        "device_name", "modeldata_model", "modeldata_category", "modeldata_eol", "modeldata_material_cost",
        "repl_device_key",
    ),
)
on_fleet("device_dataset", lambda f: dataset.device_dataset(f.filtered, f.dims))
on_fleet("clean_devices", lambda f: dataset.clean_devices(dataset.device_dataset(f.filtered, f.dims)))
on_fleet("join_fanout", lambda f: dataset.join_fanout(f.filtered, f.dims))
on_devices("reconciliation", dataset.reconciliation)
on_devices(
    "load_devices",
    lambda df: df.select(
        "device_name", "loc_state", "loc_site_code", "loc_site_name", "loc_latitude", "loc_longitude",
        F.col("modeldata_eol").cast("string").alias("modeldata_eol"), "device_source",
    ),
)
on_devices("mappable_devices", lambda df: mappable(df).select("device_name", "loc_state", "loc_site_code"))

# --- lifecycle ---------------------------------------------------------------

on_devices(
    "days_to_eol",
    lambda df: df.select(
        "device_name", F.col("modeldata_eol").cast("string").alias("modeldata_eol"),
        days_to_eol("modeldata_eol", AS_OF).alias("days_to_eol"),
    ),
)
on_devices(
    "eol_bucket",
    lambda df: df.select("device_name", eol_bucket(days_to_eol("modeldata_eol", AS_OF), HORIZON).alias("eol_bucket")),
)
on_devices("eol_bucket_counts", lambda df: clusters.bucket_counts(df, AS_OF, HORIZON))
on_findings(
    "device_metrics",
    lambda df: df.select(
        "device_name", "site_id", "days_to_eol", "eol_bucket", "replacement_cost_estimate", "labor_cost_estimate",
        "version_missing", "support_coverage_score", "security_risk_score", "near_term_cost_component",
    ),
)

# --- clusters ----------------------------------------------------------------

on_devices("site_clusters", lambda df: rounded(clusters.site_clusters(df, AS_OF), "remaining_days_avg"))
on_devices(
    "clusters_by_state",
    lambda df: rounded(clusters.in_state(clusters.cluster_table(df, AS_OF), " ac "), "remaining_days_avg"),
)
on_devices(
    "metric_domain",
    lambda df: rounded(
        clusters.metric_domain(written_table(clusters.cluster_table(df, AS_OF))), "metric_min", "metric_max"
    ),
)
on_devices(
    "cluster_urgency",
    lambda df: rounded(
        clusters.cluster_urgency(written_table(clusters.cluster_table(df, AS_OF))), "urgency_position", "base_radius"
    ),
)


def _sources_as_text(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.withColumn("sources", F.array_join(pairs, ","))


on_devices(
    "location_summary_horizon",
    lambda df: _sources_as_text(rounded(clusters.location_summaries(df, AS_OF, HORIZON), "remaining_days_avg")),
)


@query("location_summary")
def location_summary(spark: SparkSession, d: str) -> DataFrame:
    wanted = clusters.requested_locations(spark, [("ac", "abf"), ("ZZ", "ZZZ")])
    out = clusters.location_summary(devices(spark, d), wanted, AS_OF, HORIZON)
    shares = [c for c in out.columns if c.endswith("_share")]
    return _sources_as_text(rounded(out.drop("consistent", *shares), "remaining_days_avg"))


# --- findings ----------------------------------------------------------------

_MEANS = ("support_coverage_score", "security_risk_score")
on_findings("site_summary", lambda df: rounded(findings.site_summary(df), "avg_days_to_eol", *_MEANS))
on_findings("top_overdue_sites", lambda df: findings.top_overdue_sites(findings.site_summary(df)))
on_findings(
    "site_risk_scatter",
    lambda df: rounded(findings.site_risk_scatter(findings.site_summary(df)), "marker_size", *_MEANS),
)
on_findings("state_exposure", lambda df: rounded(findings.state_exposure(df), *_MEANS))
on_findings("source_lifecycle_mix", findings.source_lifecycle_mix)
on_findings("model_hotspots", lambda df: rounded(findings.model_hotspots(df), "security_risk_score"))
on_findings("findings_kpis", lambda df: findings.findings_kpis(findings.site_summary(df)))

# --- predictions -------------------------------------------------------------

on_predictions("load_predictions", lambda df: df)
on_predictions("pred_kpis", inferences.prediction_kpis)
on_predictions("class_mix", inferences.class_mix)
on_predictions("pred_state_risk", inferences.state_risk)
on_predictions("pred_model_risk", inferences.model_risk)
on_predictions("pred_source_mix", inferences.source_mix)
on_predictions("confidence_hist", inferences.confidence_histogram)
on_predictions(
    "top_confident",
    lambda df: inferences.most_confident(
        df.select(
            "predicted_behavior_class", "loc_state", "device_model", "device_source", "prediction_confidence"
        )
    ),
)
on_predictions("rep_pred_mix", inferences.prediction_mix)

# --- reports -----------------------------------------------------------------

on_reports("rep_eol_bucket", lambda df: reports.eol_bucket_distribution(df, HORIZON))
on_reports("rep_days_hist", reports.days_histogram)
on_reports(
    "rep_days_kde",
    lambda df: rounded(rounded(reports.days_density(df), "days_to_eol"), "density", digits=4),
)
on_reports("rep_overdue_age", reports.overdue_age_histogram)
on_reports("rep_top_sites", reports.top_sites)
on_reports("rep_state_exposure", reports.exposure_by_state)
on_reports("rep_source_mix", reports.source_mix)
on_reports("rep_category_heat", reports.category_heatmap)
on_reports("rep_model_hotspots", reports.hot_models)
on_reports("rep_risk_scatter", lambda df: rounded(reports.risk_scatter(df), "marker_size", *_MEANS))
on_reports("owner_risk_box", reports.owner_scores)
on_reports("rep_owner_box", reports.owner_risk_box)
on_reports("rep_call_group", reports.call_group_backlog)
on_reports("rep_unknown_state", reports.unknown_by_state)
on_reports("rep_cost_bucket", reports.cost_by_bucket)
on_reports(
    "site_priority_matrix",
    lambda df: rounded(reports.site_priority_matrix(df), "marker_size", "security_risk_score"),
)

# --- model -------------------------------------------------------------------

on_devices("ml_target", lambda df: model.training_rows(df, AS_OF))
on_devices(
    "ml_known_unknown",
    lambda df: model.known_eol(df)
    .select("device_name", F.lit("known").alias("part"))
    .unionAll(model.unknown_eol(df).select("device_name", F.lit("unknown"))),
)
on_devices("class_distribution", lambda df: model.class_distribution(model.training_rows(df, AS_OF)))
on_devices("missing_rates", model.missing_preview)


def _groups(df: DataFrame) -> DataFrame:
    return written_table(model.group_table(model.training_rows(df, AS_OF)))


def _split(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Split rows; of the features only the named ones are written, or all where none are named."""
    rows = model.training_rows(df, AS_OF)
    kept = rows if features is None else rows.select("device_name", "target", "model_group", *features)
    return model.split_rows(written_table(kept))


on_devices("ml_folds", lambda df: model.deal_folds(_groups(df), model.TEST_FOLDS, model.TEST_SEED))
on_devices(
    "ml_best_fold",
    lambda df: rounded(
        model.fold_scores(model.deal_folds(_groups(df), model.TEST_FOLDS, model.TEST_SEED), model.TEST_SHARE), "score"
    ),
)
on_devices("split_stats", lambda df: model.split_stats(_split(df, ["device_model"])))
on_devices("split_distribution", lambda df: model.class_distribution(_split(df, []), by_split=True))
on_devices("usable_features", lambda df: model.feature_rates(_split(df), model.feature_columns(df)))


@query("ml_impute")
def ml_impute(spark: SparkSession, d: str) -> DataFrame:
    frame = devices(spark, d)
    columns = model.feature_columns(frame)
    train = _split(frame).where("split = 'train'")
    texts = [c for c in columns if c not in model.NUMERIC_FEATURES]
    return model.fill_values(train, texts, [c for c in columns if c in model.NUMERIC_FEATURES])


@query("ml_features")
def ml_features(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all known devices over the dictionary of the training split: width, slots in use, and their sum."""
    frame = devices(spark, d)
    split = _split(frame)
    encoder, _, _ = model.fit_preparation(split, model.feature_columns(frame))
    return encoder.sparse(split, "device_name").select(
        "device_name", "target", "split", F.col("_sparse.size").alias("n_slots"), F.size("_sparse.indices").alias("n_active"),
        F.aggregate("_sparse.indices", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("slot_sum"),
    )


@query("ml_dictionary")
def ml_dictionary(spark: SparkSession, d: str) -> DataFrame:
    frame = devices(spark, d)
    encoder, _, _ = model.fit_preparation(_split(frame), model.feature_columns(frame))
    return encoder.dictionary


@query("ml_train_score")
def ml_train_score(spark: SparkSession, d: str) -> DataFrame:
    frame, features = model.model_input(devices(spark, d))
    frame = written_table(frame)
    fitted, _ = model.train_lifecycle_model(frame, AS_OF, TRAINING, features)
    return model.score_unknown(fitted, frame)


# --- evaluation --------------------------------------------------------------


def _with_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("scores", F.array(*SCORES.values()))


on_scored(
    "weighted_decision",
    lambda df: model.decide(_with_scores(df), {-1: 2.0, 0: 1.0, 1: 1.5}).select(
        "doc_id", "predicted_behavior_class", "prediction_confidence"
    ),
)
on_scored("weight_grid", lambda df: evaluation.weight_grid(_with_scores(df)))
on_scored("confusion_matrix", evaluation.confusion_matrix)
on_scored("class_report", lambda df: rounded(evaluation.classification_report(df), "precision", "recall", "f1"))
on_scored(
    "macro_auc",
    lambda df: rounded(evaluation.macro_auc(df, "actual", SCORES), "macro_auc", "auc_0", "auc_1", "auc_2"),
)
on_scored(
    "roc_curves",
    lambda df: rounded(evaluation.roc_curves(df, "actual", SCORES), "fpr", "tpr").select("class_id", "fpr", "tpr"),
)


def _evaluation(df: DataFrame) -> DataFrame:
    """Everything that one grouped count gives, as (part, name, value)."""
    found = evaluation.evaluate(df, "actual", "predicted", SCORES)
    text = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    metrics = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in ("precision", "recall", "f1", "support")])
    areas = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in ("macro_auc", "auc_0", "auc_1", "auc_2")])
    parts = [
        found["confusion"].select(F.lit("confusion").alias("part"), text(F.col("actual"), F.col("predicted")).alias("name"), F.col("value").cast("double")),
        found["report"].select("name", F.inline(metrics)).select(F.lit("report"), text(F.col("name"), F.col("m")), "v"),
        found["auc"].select(F.inline(areas)).select(F.lit("auc"), "m", "v"),
        found["roc"].groupBy("class_id").count().select(F.lit("roc_corners"), text(F.col("class_id")), F.col("count").cast("double")),
        found["macro_roc"].agg(F.avg("macro_tpr")).select(F.lit("macro_roc"), F.lit("mean_tpr"), F.col("avg(macro_tpr)")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return rounded(out, "value")


on_scored("model_evaluation", _evaluation)
on_scored("roc_points", lambda df: rounded(evaluation.macro_roc(df, "actual", SCORES), "fpr", "macro_tpr"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("logits"))


@query("eval_loss")
def eval_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.evaluation_loss(_logits(spark, d), "logits", "label", LOGITS), "value")


@query("softmax_scores")
def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(scores.softmax("logits").alias("softmax"), scores.sigmoid("logits").alias("sigmoid"))
    out = _logits(spark, d).select("vec_id", F.posexplode(both).alias("class_id", "s"))
    return rounded(out.select("vec_id", "class_id", "s.softmax", "s.sigmoid"), "softmax", "sigmoid")
