import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetspan.operators.dataset import COLUMN_ORDER
from fleetspan.plans import evaluation, model

DAY = dt.date(2025, 6, 1)
EXTRA = ("software_type", "source_location", "country_code", "management_state", "device_role", "free_ports")


@pytest.fixture(scope="module")
def devices(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        m = rng.choice([0] * 10 + list(range(60)))
        days = None if i % 4 == 0 else {0: -100, 1: 100, 2: 900}[m % 3]
        rows.append(
            {
                "device_name": f"d{i}", "device_source": "NA", "loc_state": rng.choice(["GA", "AL", "MS"]) if i % 50 else None,
                "loc_site_code": "ABC", "device_model": f"M{m}", "device_type": ["AP", "Switch", "Router"][m % 3],
                "software_version": rng.choice(["17", "16", None]), "free_ports": rng.choice(["1", "2", "9", None]),
                "modeldata_eol": None if days is None else DAY + dt.timedelta(days=days),
            }
        )
    columns = [*COLUMN_ORDER, *EXTRA]
    schema = ", ".join(f"{c} {'date' if c == 'modeldata_eol' else 'string'}" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def test_rows_and_features(devices):
    features = model.feature_columns(devices)
    assert "device_model" in features and "device_name" not in features and "modeldata_eol" not in features
    rows = model.training_rows(devices, DAY)
    assert dict(rows.dtypes)["free_ports"] == "double"
    assert rows.count() + model.unknown_eol(devices).count() == devices.filter("loc_state is not null").count()
    with pytest.raises(ValueError):
        model.feature_columns(devices.drop("uptime"))
    rates = {r["column"]: r.missing_rate for r in model.missing_rates(rows, features).collect()}
    assert rates["device_role"] == 1.0 and rates["device_model"] == 0.0
    assert model.most_missing(rows, features, 1).first()["too_sparse"]


def test_folds(devices):
    groups = model.group_table(model.training_rows(devices, DAY))
    dealt = model.deal_folds(groups, 5, 42)
    out = {r.model_group: r.fold for r in dealt.collect()}
    assert len(out) == groups.count() and set(out.values()) == set(range(5))
    assert out == {r.model_group: r.fold for r in model.deal_folds(groups.repartition(3), 5, 42).collect()}
    assert out != {r.model_group: r.fold for r in model.deal_folds(groups, 5, 1).collect()}
    sums = {r.fold: (r.n_rows, r.n_0, r.n_1, r.n_2) for r in dealt.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_0", "n_1", "n_2")]).collect()}
    whole = [sum(v[i] for v in sums.values()) for i in range(4)]

    def score(v):
        ratio = sum(abs(v[i] / v[0] - whole[i] / whole[0]) for i in (1, 2, 3))
        return 10.0 * sum(v[i] == 0 for i in (1, 2, 3)) + ratio + abs(v[0] / whole[0] - 0.2)

    best = [r for r in model.fold_scores(dealt, 0.2).collect()]
    for r in best:
        assert r.score == pytest.approx(score(sums[r.fold]))
    assert [r.fold for r in best if r.is_best] == [min(sums, key=lambda f: (score(sums[f]), f))]


@pytest.mark.parametrize("heavy", [0, 5, 64])
def test_folds_are_even_up_to_the_largest_group(spark, heavy):
    rng = random.Random(3)
    sizes = [rng.randint(1, 6) for _ in range(300)] + [rng.randint(20, 90) for _ in range(heavy)]
    rows = []
    for k, n in enumerate(sizes):
        mix = [0, 0, 0]
        for _ in range(n):
            mix[rng.choice([0, 0, 1, 2]) if k % 4 else k % 3] += 1
        rows.append((f"g{k}", n, *mix))
    groups = spark.createDataFrame(rows, "model_group string, n_rows bigint, n_0 bigint, n_1 bigint, n_2 bigint")
    dealt = model.deal_folds(groups, 5, 42, heavy)
    assert sorted(r.model_group for r in dealt.collect()) == sorted(r[0] for r in rows)
    held = [r.n for r in dealt.groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()]
    largest = max(sizes)
    assert len(held) == 5 and max(held) - min(held) <= (3 if heavy == 0 else 2) * largest


def test_fit_rows_bounds_the_fit(devices):
    split = model.split_rows(model.training_rows(devices, DAY))
    encoder, _, counts = model.fit_preparation(split, model.feature_columns(devices))
    train = encoder.transform(split.where("split = 'train'"), "device_name")
    small = model.fit(train, counts, model.TrainingOptions(trees=2, max_depth=3, fit_rows=200))
    assert small.getNumTrees == 2 and small.numFeatures == encoder.width


def test_vectors_follow_the_fitted_sample(devices):
    """The forest sees slots for the values of its sample only, and multiplied rows get the scores of the plain transform."""
    from pyspark.ml.functions import vector_to_array

    split = model.split_rows(model.training_rows(devices, DAY))
    encoder, _, _ = model.fit_preparation(split, model.feature_columns(devices))
    options = model.TrainingOptions(trees=3, max_depth=4, fit_rows=60)
    fitted, encoded = model.train_lifecycle_model(devices, DAY, options)
    assert fitted.forest.numFeatures == fitted.encoder.width < encoder.width
    rows = lambda df: sorted((r.device_name, *r.scores) for r in df.collect())
    twice = encoded.unionAll(encoded)
    plain = fitted.forest.transform(twice).withColumn("scores", vector_to_array("probability"))
    scored = fitted.scores(twice)
    assert rows(scored) == rows(plain)
    assert scored.columns == [*encoded.columns, "scores"]


def test_split_distribution(devices):
    split = model.split_rows(model.training_rows(devices, DAY))
    rows = model.class_distribution(split, by_split=True).collect()
    assert [(r.split, r.target) for r in rows] == [(s, c) for s in ("train", "val", "test") for c in (-1, 0, 1)]
    assert sum(r.n_rows for r in rows) == split.count()
    assert all(abs(sum(r.share for r in rows if r.split == s) - 1) < 0.002 for s in ("train", "val", "test"))


def test_preview_counts_all_located_devices(devices):
    rates = {r["column"]: r.missing_rate for r in model.missing_preview(devices, 30).collect()}
    located = devices.where("loc_state is not null")
    assert rates["free_ports"] == pytest.approx(located.where("free_ports is null").count() / located.count())


def test_split_keeps_groups_together(devices):
    rows = model.training_rows(devices, DAY)
    split = model.split_rows(rows)
    assert split.count() == rows.count() and split.filter("split is null").count() == 0
    assert split.groupBy("model_group").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    stats = {r.split: r for r in model.split_stats(split).collect()}
    assert set(stats) == {"train", "val", "test"}
    assert stats["train"].n_models + stats["val"].n_models + stats["test"].n_models == rows.select("device_model").distinct().count()


def test_fill_values(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 4.0, None), ("b", None, None), ("a", 2.0, None), (None, 8.0, None)], "t string, n double, e string")
    found = {r["column"]: (r.text_value, r.number_value) for r in model.fill_values(df, ["t", "e"], ["n"]).collect()}
    assert found == {"t": ("a", None), "n": (None, 3.0)}


def test_train_tune_score(spark, devices, tmp_path):
    options = model.TrainingOptions(trees=5, max_depth=5)
    fitted, split = model.train_lifecycle_model(devices, DAY, options)
    assert "device_role" not in fitted.features and "free_ports" in fitted.features
    out = model.score_unknown(fitted, devices)
    assert out.count() == model.unknown_eol(devices).count()
    assert {r[0] for r in out.select("predicted_behavior_class").distinct().collect()} <= {-1, 0, 1}
    assert out.filter("prediction_confidence <= 0 or predicted_behavior_label is null or device_name is null").count() == 0
    test = model.decide(fitted.scores(split.filter("split = 'test'")), fitted.weights)
    sums = test.select(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)).collect()
    assert all(abs(r[0] - 1.0) < 1e-9 for r in sums)
    report = {r.name: r for r in evaluation.classification_report(test, "target", "predicted_behavior_class").collect()}
    assert report["accuracy"].f1 > 0.8  # the type tells the class
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.load_model(spark, str(tmp_path / "m"))
    assert again.weights == fitted.weights and again.features == fitted.features

    parts = model.evaluate_model(fitted, split)
    assert parts["report"].where("name = 'accuracy'").first().f1 == pytest.approx(report["accuracy"].f1)
    assert parts["confusion"].agg(F.sum("value")).first()[0] == split.filter("split = 'test'").count()
    assert 0.5 < parts["auc"].first().macro_auc <= 1.0 and parts["macro_roc"].count() >= 2

    def rows(df):
        return sorted(map(repr, df.collect()))

    assert rows(model.score_unknown(again, devices)) == rows(out)


def test_training_needs_all_classes(devices):
    rows = model.training_rows(devices, DAY).filter("target <> 1")
    with pytest.raises(ValueError, match="expected classes"):
        model.with_class_weights(rows)
