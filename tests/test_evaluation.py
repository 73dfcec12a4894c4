import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.functions import scores
from fleetspan.plans import evaluation

CLASSES = [-1, 0, 1]
SCORES = {-1: "a", 0: "b", 1: "c"}


def sample(spark, n=300, seed=1, labels=(-1, 0, 1)):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        p = rng.integers(1, 6, 3) / 1.0
        p = p / p.sum()
        rows.append((int(rng.choice(labels)), *map(float, p)))
    return rows, spark.createDataFrame(rows, "actual int, a double, b double, c double")


def brute_auc(rows, k):
    pos = [r[1 + k] for r in rows if r[0] == CLASSES[k]]
    neg = [r[1 + k] for r in rows if r[0] != CLASSES[k]]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def brute_curve(rows, k):
    """All threshold points, then those on straight lines removed."""
    s = np.array([r[1 + k] for r in rows])
    y = np.array([r[0] == CLASSES[k] for r in rows])
    cuts = sorted(set(s), reverse=True)
    tp = np.array([(y & (s >= c)).sum() for c in cuts])
    fp = np.array([(~y & (s >= c)).sum() for c in cuts])
    keep = [0]
    for i in range(1, len(cuts) - 1):
        if tp[i + 1] - tp[i] != tp[i] - tp[i - 1] or fp[i + 1] - fp[i] != fp[i] - fp[i - 1]:
            keep.append(i)
    keep.append(len(cuts) - 1)
    return np.r_[0, fp[keep] / (~y).sum()], np.r_[0, tp[keep] / y.sum()]


@pytest.mark.parametrize("parts", [3, 128])
def test_auc_and_roc(spark, parts):
    rows, df = sample(spark)
    row = evaluation.macro_auc(df, "actual", SCORES, parts).first()
    want = [brute_auc(rows, k) for k in range(3)]
    np.testing.assert_allclose([row.auc_0, row.auc_1, row.auc_2, row.macro_auc], [*want, np.mean(want)], rtol=1e-12)

    curves = [brute_curve(rows, k) for k in range(3)]
    found = evaluation.roc_curves(df, "actual", SCORES, parts).collect()
    for c, (fpr, tpr) in zip(CLASSES, curves):
        mine = sorted((r.fpr, r.tpr) for r in found if r.class_id == c)
        np.testing.assert_allclose(mine, sorted(zip(fpr, tpr)), rtol=1e-12)
    grid = np.unique(np.concatenate([c[0] for c in curves]))
    macro = np.mean([np.interp(grid, *c) for c in curves], axis=0)
    out = sorted(tuple(r) for r in evaluation.macro_roc(df, "actual", SCORES, parts).collect())
    np.testing.assert_allclose(out, list(zip(grid, macro)), rtol=1e-12)


def test_auc_of_an_absent_class(spark):
    _, df = sample(spark, labels=(-1, 0))
    row = evaluation.macro_auc(df, "actual", SCORES).first()
    assert row.auc_2 is None and row.macro_auc is None and row.auc_0 is not None
    with pytest.raises(ValueError, match=r"\[1\]"):
        evaluation.check_classes([-1, 0])


def test_confusion_and_report(spark):
    pairs = [(-1, -1), (-1, 0), (0, 0), (0, 0), (0, -1), (0, 0)]
    df = spark.createDataFrame(pairs, "actual int, predicted int")
    cells = {(r.actual, r.predicted): r.value for r in evaluation.confusion_matrix(df).collect()}
    assert cells[-1, -1] == 1 and cells[0, 0] == 3 and cells[0, -1] == 1 and cells[1, 1] == 0 and len(cells) == 9
    shares = {(r.actual, r.predicted): r.value for r in evaluation.confusion_matrix(df, normalize=True).collect()}
    assert shares[0, 0] == 0.75 and shares[1, 0] == 0.0
    report = {r.name: r for r in evaluation.classification_report(df).collect()}
    assert (report["-1"].precision, report["-1"].recall, report["-1"].f1, report["-1"].support) == (0.5, 0.5, 0.5, 2)
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0.0, 0.0, 0.0, 0)
    assert report["accuracy"].f1 == pytest.approx(4 / 6)
    assert report["macro avg"].f1 == pytest.approx((0.5 + 0.75) / 3)
    assert report["weighted avg"].f1 == pytest.approx((0.5 * 2 + 0.75 * 4) / 6)


def test_weight_grid(spark):
    rows, df = sample(spark, 200, 4, labels=(-1, 0))
    out = sorted(evaluation.weight_grid(df.withColumn("scores", F.array("a", "b", "c"))).collect(), key=lambda r: r.position)
    best = (-1.0, None)
    for r in out:
        w = np.array([r.weight_passed, 1.0, r.weight_within])
        chosen = [CLASSES[int(np.argmax(np.array(x[1:]) * w))] for x in rows]
        f1 = []
        for c in CLASSES:
            tp = sum(x[0] == c == k for x, k in zip(rows, chosen))
            both = sum(x[0] == c for x in rows) + sum(k == c for k in chosen)
            if both:
                f1.append(2 * tp / both)
        assert r.macro_f1 == pytest.approx(np.mean(f1))
        if r.macro_f1 > best[0]:
            best = (r.macro_f1, r.position)
    assert len(out) == 24 and [r.position for r in out if r.is_best] == [best[1]]


def test_decisions_and_losses(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.2, 0.5, 0.3],)], "s array<double>")
    weights = scores.weight_array({1: 2.0})
    assert [r[0] for r in df.select(scores.best_class(scores.weighted("s", weights))).collect()] == [-1, 1]
    logits = [[1000.0, 0.0, -1000.0], [0.1, -0.2, 0.3]]
    df = spark.createDataFrame([(x, y) for x, y in zip(logits, [0, 2])], "x array<double>, y int")
    out = {r.loss: r.value for r in evaluation.evaluation_loss(df, "x", "y", 3).collect()}
    x, hot = np.array(logits), np.eye(3)[[0, 2]]
    lse = x.max(1) + np.log(np.exp(x - x.max(1, keepdims=True)).sum(1))
    assert out["cross_entropy_loss"] == pytest.approx(np.mean(lse - (x * hot).sum(1)))
    assert out["mse_loss"] == pytest.approx(np.mean((x - hot) ** 2))
    bce = np.maximum(x, 0) - x * hot + np.log1p(np.exp(-abs(x)))
    assert out["bce_with_logits_loss"] == pytest.approx(bce.mean())
    soft = df.select(scores.softmax("x"), scores.sigmoid("x")).collect()
    assert soft[0][0] == pytest.approx([1.0, 0.0, 0.0]) and sum(soft[1][0]) == pytest.approx(1.0)
    assert soft[1][1] == pytest.approx(list(1 / (1 + np.exp(-x[1]))))


def test_one_count_gives_the_whole_evaluation(spark):
    rows, df = sample(spark, 250, 6)
    rng = np.random.default_rng(2)
    tested = spark.createDataFrame([(*r, int(rng.choice(CLASSES))) for r in rows], "actual int, a double, b double, c double, predicted int")
    found = evaluation.evaluate(tested, "actual", "predicted", SCORES)
    same = lambda x, y: sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    assert same(found["report"], evaluation.classification_report(tested))
    assert same(found["confusion"], evaluation.confusion_matrix(tested))
    assert same(found["auc"], evaluation.macro_auc(tested, "actual", SCORES))
    assert same(found["roc"].drop("score"), evaluation.roc_curves(tested, "actual", SCORES).select("class_id", "fpr", "tpr"))
    assert same(found["macro_roc"], evaluation.macro_roc(tested, "actual", SCORES))
