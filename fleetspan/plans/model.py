"""The lifecycle model: features, grouped split, training, tuning, scoring.

Devices with a known EoL date train a random forest that tells which lifecycle
class the devices with an unknown date resemble.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lifecycle import DEFAULT_HORIZON_DAYS, days_to_eol
from ..functions.scores import CLASSES, best_class, weight_array, weighted
from ..functions.text import require_columns, to_double, with_optional
from ..operators.dataset import NOT_ANALYSED, SPARSE
from ..operators.ordered import running_sums
from ..operators.sizing import join_dimension, settle, written_table
from .encoding import Encoder, fit_encoder, load_encoder, medians, most_frequent, value_counts
from .evaluation import check_classes, evaluate, weight_grid
from .forest import Forest, fit_forest, load_forest
from .inferences import class_label

# Columns of the clean dataset that the model does not use.
UNINFORMATIVE = (
    "device_name", "device_source", "location_matched", "loc_site_name", "loc_address_1", "loc_zip",
    "loc_longitude", "loc_latitude", "device_reachability", "device_vendor", "device_ip", "serial_number", "uptime",
    "modeldata_in_scope", "modeldata_dna_y_n", "modeldata_dna_part_number", "modeldata_material_cost",
    "modeldata_de_hrs", "modeldata_se_hrs", "modeldata_fot_hrs", "modeldata_de_cost", "modeldata_se_cost",
    "modeldata_fot_cost", "modeldata_labor_cost", "modeldata_device_cost", "modeldata_dna_cost",
    "modeldata_staging_cost", "modeldata_tax_oh", "repl_device_key", "replacement_device_sku",
    "replacement_device_cost", "replacement_labor_de_hours", "replacement_labor_se_hours",
    "replacement_labor_fo_hours", "pricing_component_count", "pricing_total_estimate", "source_device_id",
)
META = (
    "device_name", "device_source", "loc_state", "loc_site_code", "loc_site_name", "device_model", "device_type",
    "modeldata_eol",
)
NUMERIC_FEATURES = ("free_ports", "total_ports", "ports_in_use")
NO_MODEL = "UNKNOWN_MODEL"
MISSING_LIMIT = 0.5
TEST_FOLDS, TEST_SEED, TEST_SHARE = 5, 42, 0.20
VALIDATION_FOLDS, VALIDATION_SEED, VALIDATION_SHARE = 4, 43, 0.25
HEAVY_GROUPS = 64  # the largest groups are placed one by one
SPLITS = ("train", "val", "test")


# --- rows and features -------------------------------------------------------


def feature_columns(devices: DataFrame) -> list[str]:
    """Columns the model may use: without noise, identity, cost and the date itself."""
    require_columns(devices, [*SPARSE, *NOT_ANALYSED, *UNINFORMATIVE, "modeldata_eol"], "device dataset")
    out = {*SPARSE, *NOT_ANALYSED, *UNINFORMATIVE, "modeldata_eol"}
    return [c for c in devices.columns if c not in out]


def located(devices: DataFrame) -> DataFrame:
    return devices.filter(F.col("loc_state").isNotNull())


def known_eol(devices: DataFrame) -> DataFrame:
    return located(devices).filter(F.col("modeldata_eol").isNotNull())


def unknown_eol(devices: DataFrame) -> DataFrame:
    return located(devices).filter(F.col("modeldata_eol").isNull())


def lifecycle_class(days: Column) -> Column:
    """-1 past EoL, 1 within a year, 0 later."""
    return F.when(days < 0, -1).when(days <= DEFAULT_HORIZON_DAYS, 1).otherwise(0)


def model_input(devices: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns that training and scoring read, and the names of the features among them."""
    features = feature_columns(devices)
    return devices.select(*dict.fromkeys([*META, *features])), features


def training_rows(devices: DataFrame, as_of: dt.date | str, features: list[str] | None = None) -> DataFrame:
    """Known devices with target, model group and features (numbers as doubles)."""
    features = features or feature_columns(devices)
    target = lifecycle_class(days_to_eol("modeldata_eol", as_of))
    return known_eol(devices).select(
        "device_name",
        target.alias("target"),
        F.coalesce("device_model", F.lit(NO_MODEL)).alias("model_group"),
        *feature_values(features),
    )


def feature_values(features: list[str]) -> list[Column]:
    return [to_double(c).alias(c) if c in NUMERIC_FEATURES else F.col(c) for c in features]


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls per column, by one pass."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.avg(F.isnull(f"`{c}`").cast("int")).alias("missing_rate"))
            for c in columns
        ]
    )
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def most_missing(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    return (
        missing_rates(df, columns)
        .withColumn("too_sparse", F.col("missing_rate") > MISSING_LIMIT)
        .orderBy(F.desc("missing_rate"), "column")
        .limit(n)
    )


def missing_preview(devices: DataFrame, n: int = 10) -> DataFrame:
    """The features most often missing among all located devices, with a known date or without."""
    features = feature_columns(devices)
    return most_missing(located(devices).select(*feature_values(features)), features, n)


def _class_rows(scope: Column, within: Column | None = None) -> list[Column]:
    def count(condition: Column) -> Column:
        return F.count_if(condition if within is None else condition & within)

    return [
        F.struct(scope.alias("scope"), F.lit(c).alias("target"), count(F.col("target") == c).alias("n_rows"), count(F.lit(True)).alias("n_all"))
        for c in CLASSES
    ]


def class_distribution(df: DataFrame, by_split: bool = False) -> DataFrame:
    """Rows and share per class in class order, zero-filled; per split where there are splits."""
    rows = _class_rows(F.lit("all"))
    if by_split:
        rows = [r for s in SPLITS for r in _class_rows(F.lit(s), F.col("split") == s)]
    out = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    share = F.round(F.try_divide("n_rows", "n_all"), 3).alias("share")
    return out.select(F.col("scope").alias("split"), "target", "n_rows", share) if by_split else out.select("target", "n_rows", share)


# --- grouped stratified split ------------------------------------------------


def group_table(rows: DataFrame) -> DataFrame:
    """Class counts per model group; folds and their quality need nothing more."""
    return rows.groupBy("model_group").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("target") == c).alias(f"n_{c + 1}") for c in CLASSES]
    )


def _place_heavy(groups: list, folds: int, totals: dict[int, int]) -> list[tuple[str, int]]:
    """Each group, largest first, to the fold that holds least of its classes; the first such fold on ties."""
    held = [dict.fromkeys(CLASSES, 0) for _ in range(folds)]
    out = []
    for g in groups:
        costs = [sum(load[c] * g[f"n_{c + 1}"] / max(totals[c], 1) for c in CLASSES) for load in held]
        fold = costs.index(min(costs))
        for c in CLASSES:
            held[fold][c] += g[f"n_{c + 1}"]
        out.append((g["model_group"], fold))
    return out


def deal_folds(groups: DataFrame, folds: int, seed: int, heavy: int = HEAVY_GROUPS) -> DataFrame:
    """Add a fold per group so that rows and class mix are alike in all folds; groups are never split.

    The ``heavy`` largest groups are placed one by one, each where its classes are
    rarest so far. The others are lined up per main class in the order of a hash and
    cut into pieces of equal rows by their running sums, so a fold is off by less
    than one of them per class. Only the largest groups reach the driver.
    """
    counts = [f"n_{c + 1}" for c in CLASSES]
    noise = F.md5(F.concat(F.lit(f"{seed}:"), "model_group"))
    noisy = groups.withColumn("_noise", noise)
    whole = groups.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts]).first()  # one row
    largest = noisy.orderBy(F.desc("n_rows"), "_noise", "model_group").limit(heavy).collect()
    placed = _place_heavy(largest, folds, {c: whole[n] for c, n in zip(CLASSES, counts)})
    table = groups.sparkSession.createDataFrame(placed, "_placed string, fold int")  # at most ``heavy`` rows
    joined = noisy.join(F.broadcast(table), F.col("model_group") == F.col("_placed"), "left").drop("_placed")

    most = F.greatest(*[F.col(n) for n in counts])
    main = F.when(F.col("n_0") == most, 0).when(F.col("n_1") == most, 1).otherwise(2)
    tail = joined.where("fold is null").drop("fold").withColumns({"_main": main, "_line": F.concat("_noise", "model_group")})
    lined = running_sums(tail, "_main", "_line", {"_upto": "n_rows"})
    cut = F.least(F.expr(f"(_upto - n_rows) * {folds} div _upto_total"), F.lit(folds - 1)).cast("int")
    dealt = lined.select(*groups.columns, cut.alias("fold"))
    return joined.where("fold is not null").select(*groups.columns, "fold").unionAll(dealt)


def fold_scores(dealt: DataFrame, share: float) -> DataFrame:
    """How well each fold stands for the whole; lowest score is best, first on ties.

    10 per missing class, plus the distance of its class ratios and of its size.
    """
    sums = ["n_rows", *(f"n_{c + 1}" for c in CLASSES)]
    per = dealt.groupBy("fold").agg(*[F.sum(c).alias(c) for c in sums])
    # Bounded: one entry per fold.
    rows = per.agg(
        F.collect_list(F.struct("fold", *sums)).alias("rows"), *[F.sum(c).alias(f"all_{c}") for c in sums]
    ).select(F.inline("rows"), *[f"all_{c}" for c in sums])
    missing = sum(((F.col(f"n_{c + 1}") == 0).cast("int") for c in CLASSES), F.lit(0))
    ratio = sum(
        (
            F.abs(F.col(f"n_{c + 1}") / F.col("n_rows") - F.col(f"all_n_{c + 1}") / F.col("all_n_rows"))
            for c in CLASSES
        ),
        F.lit(0.0),
    )
    size = F.abs(F.col("n_rows") / F.col("all_n_rows") - F.lit(share))
    scored = rows.select("fold", *sums, missing.alias("missing_classes"), (missing * 10.0 + ratio + size).alias("score"))
    best = F.array_min(F.transform("rows", lambda r: F.struct(r["score"], r["fold"])))["fold"]
    listed = scored.agg(F.collect_list(F.struct("fold", *sums, "missing_classes", "score")).alias("rows"))
    return listed.withColumn("best", best).select("best", F.inline("rows")).select(
        "fold", *sums, "missing_classes", "score", (F.col("fold") == F.col("best")).alias("is_best")
    )


def hold_out(groups: DataFrame, folds: int, seed: int, share: float) -> DataFrame:
    """Add ``held_out``: does the group belong to the best fold?"""
    dealt = written_table(deal_folds(groups, folds, seed))
    best = fold_scores(dealt, share).filter("is_best").select("fold")
    return dealt.withColumn("held_out", F.col("fold") == best.scalar()).drop("fold")


def group_splits(groups: DataFrame) -> DataFrame:
    """Every model group with its split: test, validation or train."""
    first = hold_out(groups, TEST_FOLDS, TEST_SEED, TEST_SHARE)
    rest = first.filter(~F.col("held_out")).drop("held_out")
    second = hold_out(rest, VALIDATION_FOLDS, VALIDATION_SEED, VALIDATION_SHARE)
    test = first.filter("held_out").select(F.col("model_group").alias("_group"), F.lit("test").alias("split"))
    other = second.select(
        F.col("model_group").alias("_group"), F.when(F.col("held_out"), "val").otherwise("train").alias("split")
    )
    return test.unionAll(other)


def split_rows(rows: DataFrame) -> DataFrame:
    """Training rows with the column ``split``; groups stay together."""
    (splits,) = settle(group_splits(written_table(group_table(rows))))
    return join_dimension(rows, splits, [("model_group", "_group")], spread_by="device_name").drop("_group")


def split_stats(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("device_model").alias("n_models"),
        *[F.count_if(F.col("target") == c).alias(f"n_{c + 1}") for c in CLASSES],
    )


# --- preparation -------------------------------------------------------------


def fill_values(train: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Most frequent text (lowest on ties) and exact median per column; all-null columns have none."""
    modes = most_frequent(value_counts(train, categorical))
    out = modes.select("column", "text_value", F.lit(None).cast("double").alias("number_value"))
    if not numeric:
        return out
    return out.unionAll(medians(train, numeric).select("column", F.lit(None).cast("string"), "number_value"))


# --- training and scoring ----------------------------------------------------


@dataclass
class LifecycleModel:
    """A fitted forest with its encoder, feature list and decision weights."""

    forest: Forest
    encoder: Encoder
    features: list[str]
    weights: dict[int, float] = field(default_factory=lambda: dict.fromkeys(CLASSES, 1.0))

    def scores(self, rows: DataFrame, spread_by: str = "device_name") -> DataFrame:
        """Add ``scores``: the class probabilities in class order."""
        encoded = rows if "features" in rows.columns else self.encoder.transform(rows, spread_by)
        # All trees are asked once per vector, not once per row: devices multiplied by a join, and those alike, share it.
        vectors = encoded.select(F.col("features").alias("_vector")).distinct()
        scored = vectors.select("_vector", self.forest.class_shares("_vector").alias("scores"))
        return encoded.join(scored, F.col("features") == F.col("_vector"), "left").drop("_vector")


@dataclass
class TrainingOptions:
    """The forest is fitted on all training rows, unless a caller asks for a sample by hash of the name of ``fit_rows`` rows."""

    trees: int = 500
    max_depth: int = 30
    min_leaf: int = 2
    seed: int = 42
    fit_rows: int | None = None


def training_counts(train: DataFrame, features: list[str]) -> tuple[dict[str, float], dict[int, int]]:
    """Share of nulls per feature and rows per class of the training split, by one pass."""
    missing = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.isnull(f"`{c}`").cast("int")).alias("rate")) for c in features])
    row = train.agg(missing.alias("missing"), *[F.count_if(F.col("target") == c).alias(f"n_{c + 1}") for c in CLASSES]).first()
    return {r["column"]: r["rate"] for r in row["missing"]}, {c: row[f"n_{c + 1}"] for c in CLASSES}


def usable(rates: dict[str, float | None]) -> list[str]:
    """Features that are not mostly missing."""
    return [c for c, rate in rates.items() if rate is not None and rate <= MISSING_LIMIT]


def usable_features(train: DataFrame, features: list[str]) -> list[str]:
    """Features that are not mostly missing in the training split."""
    return usable(training_counts(train, features)[0])


def feature_rates(split: DataFrame, features: list[str]) -> DataFrame:
    """Missing rate of every feature in the training split, and whether the feature is used."""
    rates = missing_rates(split.where("split = 'train'"), features)
    return rates.withColumn("used", F.coalesce(F.col("missing_rate") <= MISSING_LIMIT, F.lit(False)))


def class_weights(counts: dict[int, int]) -> dict[int, float]:
    """Weight n / (classes * n_class) per class; every class must occur."""
    check_classes([c for c, n in counts.items() if n > 0])
    whole = sum(counts.values())
    return {c: whole / (len(CLASSES) * n) for c, n in counts.items()}


def with_class_weights(train: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """The weight of its class per row, and the class as a label from zero."""
    counts = counts or {r["target"]: r["n_rows"] for r in class_distribution(train).collect()}  # three rows
    weight = F.lit(1.0)
    for c, w in class_weights(counts).items():
        weight = F.when(F.col("target") == c, w).otherwise(weight)
    return train.withColumns({"weight": weight, "label": (F.col("target") + 1).cast("double")})


def fit_preparation(split: DataFrame, features: list[str]) -> tuple[Encoder, list[str], dict[int, int]]:
    """Encoder, used features and class counts of the training split: two passes over it."""
    train = split.where("split = 'train'")
    rates, counts = training_counts(train, features)
    kept = usable(rates)
    encoder = fit_encoder(train, [c for c in kept if c not in NUMERIC_FEATURES], [c for c in kept if c in NUMERIC_FEATURES])
    return encoder, kept, counts


def fitted_rows(train: DataFrame, counts: dict[int, int], options: TrainingOptions) -> DataFrame:
    """The training rows the forest is fitted on: all of them, or the sample of names by hash that the caller asks for."""
    whole = sum(counts.values())
    if options.fit_rows is None or whole <= options.fit_rows:
        return train
    grain = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(options.seed), "device_name"), F.lit(grain))
    return train.where(place < int(grain * options.fit_rows / whole))


def fit(encoded: DataFrame, counts: dict[int, int], options: TrainingOptions = TrainingOptions()) -> Forest:
    """The forest on encoded training rows."""
    weights = class_weights(counts)
    rows = with_class_weights(fitted_rows(encoded, counts, options), counts)
    return fit_forest(rows, [weights[c] for c in CLASSES], options.trees, options.max_depth, options.min_leaf, options.seed)


def tune(model: LifecycleModel, validation: DataFrame) -> LifecycleModel:
    """Pick the decision weights with the best macro-F1 on the validation split."""
    grid = weight_grid(model.scores(validation), actual="target", scores="scores")
    best = grid.filter("is_best").first()  # one row
    return LifecycleModel(
        model.forest, model.encoder, model.features, {-1: best["weight_passed"], 0: 1.0, 1: best["weight_within"]}
    )


def decide(scored: DataFrame, weights: dict[int, float], scores: str = "scores") -> DataFrame:
    """Class with the greatest weighted score, and that score as confidence (may exceed 1)."""
    values = weighted(scores, weight_array(weights))
    return scored.withColumns(
        {"predicted_behavior_class": best_class(values), "prediction_confidence": F.array_max(values)}
    )


def train_lifecycle_model(
    devices: DataFrame,
    as_of: dt.date | str,
    options: TrainingOptions = TrainingOptions(),
    features: list[str] | None = None,
) -> tuple[LifecycleModel, DataFrame]:
    """Fit on the training split and tune on the validation split; also returns the split rows.

    ``features`` names the features of a frame already cut down by ``model_input`` and written.
    Where the caller asks for a sample, the vectors have slots for the values that occur there only,
    as a forest fitted on it can tell no others apart.
    """
    rows = training_rows(devices, as_of, features)
    split = split_rows(rows if features else written_table(rows))
    features = features or feature_columns(devices)
    encoder, kept, counts = fit_preparation(split, features)
    if options.fit_rows is not None and sum(counts.values()) > options.fit_rows:
        encoder = encoder.restricted(fitted_rows(split.where("split = 'train'"), counts, options))
    # The only other copy of the rows: all splits with their vectors, read by fit, tuning and evaluation.
    encoded = encoder.transform(split, "device_name")
    model = LifecycleModel(fit(encoded.where("split = 'train'"), counts, options), encoder, kept)
    return tune(model, encoded.where("split = 'val'")), encoded


def evaluate_model(model: LifecycleModel, split: DataFrame) -> dict[str, DataFrame]:
    """Report, confusion, AUC and ROC curve of the model on the test split, from one grouped count."""
    tested = decide(model.scores(split.where("split = 'test'")), model.weights)
    names = {c: f"score_{c + 1}" for c in CLASSES}
    tested = tested.withColumns({name: F.element_at("scores", k) for k, name in enumerate(names.values(), 1)})
    return evaluate(tested, "target", "predicted_behavior_class", names)


def score_unknown(model: LifecycleModel, devices: DataFrame) -> DataFrame:
    """Predicted class, label and confidence for located devices without an EoL date."""
    devices = with_optional(devices, {c: "string" for c in model.features})
    meta = [F.col(c).alias(f"meta_{c}") for c in META if c in devices.columns]
    rows = unknown_eol(devices).select(*meta, *feature_values(model.features))
    decided = decide(model.scores(rows, "meta_device_name"), model.weights)
    return decided.select(
        *[F.col(f"meta_{c}").alias(c) for c in META if c in devices.columns],
        "predicted_behavior_class",
        class_label().alias("predicted_behavior_label"),
        "prediction_confidence",
    )


def save_model(model: LifecycleModel, path: str) -> None:
    model.forest.save(f"{path}/forest")
    model.encoder.save(f"{path}/encoder")
    SparkSession.active().createDataFrame(
        [(model.features, {int(k): float(v) for k, v in model.weights.items()})],
        "features array<string>, weights map<int, double>",
    ).write.mode("overwrite").parquet(f"{path}/decision")


def load_model(spark, path: str) -> LifecycleModel:
    row = spark.read.parquet(f"{path}/decision").first()
    forest, encoder = load_forest(spark, f"{path}/forest"), load_encoder(spark, f"{path}/encoder")
    return LifecycleModel(forest, encoder, list(row["features"]), dict(row["weights"]))
