"""Evaluation of a three-class classifier: confusion, report, ROC, AUC, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import CLASSES, best_class, bce_with_logits, cross_entropy, one_hot, squared_error, weighted
from ..operators.ordered import running_sums, with_neighbours
from ..operators.sizing import written_table

# Fixed values.
NEGATIVE_WEIGHTS = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0)
POSITIVE_WEIGHTS = (1.0, 1.5, 2.0, 3.0)


def check_classes(found: list[int]) -> None:
    missing = [c for c in CLASSES if c not in found]
    if missing:
        raise ValueError(f"the model lacks expected classes {missing}; it has {sorted(found)}")


def _rows(condition: Column, weight: str | None) -> Column:
    """Rows that fulfil a condition; ``weight`` names a column that tells for how many rows each one stands."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def confusion_matrix(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", normalize: bool = False, weight: str | None = None
) -> DataFrame:
    """Nine cells in class order, zero-filled; ``normalize`` divides by the row total (0 for none)."""
    a, p = F.col(actual), F.col(predicted)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("actual"),
                F.lit(j).alias("predicted"),
                _rows((a == i) & (p == j), weight).alias("n"),
                _rows((a == i) & p.isin(*CLASSES), weight).alias("row_total"),
            )
            for i in CLASSES
            for j in CLASSES
        ]
    )
    cells = df.agg(cells.alias("cells")).select(F.inline("cells"))
    if not normalize:
        return cells.select("actual", "predicted", F.col("n").alias("value"))
    share = F.when(F.col("row_total") > 0, F.col("n") / F.col("row_total")).otherwise(0.0)
    return cells.select("actual", "predicted", share.alias("value"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _class_scores(n: dict[tuple[int, int], Column]) -> dict[int, dict[str, Column]]:
    """Precision, recall, F1, support and use per class from the nine counts (0 for 0/0)."""
    out = {}
    for c in CLASSES:
        support = n[c, CLASSES[0]] + n[c, CLASSES[1]] + n[c, CLASSES[2]]
        chosen = n[CLASSES[0], c] + n[CLASSES[1], c] + n[CLASSES[2], c]
        out[c] = {
            "precision": _ratio(n[c, c], chosen),
            "recall": _ratio(n[c, c], support),
            "f1": _ratio(2 * n[c, c], support + chosen),
            "support": support,
            "used": (support + chosen > 0).cast("int"),
        }
    return out


def _cell(i: int, j: int) -> str:
    return f"n_{i + 1}{j + 1}"


def _cells(actual: Column, predicted: Column, weight: str | None = None) -> list[Column]:
    return [
        _rows((actual == i) & (predicted == j), weight).alias(_cell(i, j)) for i in CLASSES for j in CLASSES
    ]


def _counted() -> dict[tuple[int, int], Column]:
    return {(i, j): F.col(_cell(i, j)) for i in CLASSES for j in CLASSES}


def classification_report(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", weight: str | None = None
) -> DataFrame:
    """Rows per class, then accuracy, macro and support-weighted mean."""
    counted = df.agg(*_cells(F.col(actual), F.col(predicted), weight))
    per = _class_scores(_counted())
    everything = per[-1]["support"] + per[0]["support"] + per[1]["support"]
    right = F.col(_cell(-1, -1)) + F.col(_cell(0, 0)) + F.col(_cell(1, 1))

    def macro(metric: str) -> Column:
        return (per[-1][metric] + per[0][metric] + per[1][metric]) / 3

    def by_support(metric: str) -> Column:
        return _ratio(sum((per[c][metric] * per[c]["support"] for c in CLASSES), F.lit(0.0)), everything)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            support.alias("support"),
        )

    metrics = ("precision", "recall", "f1")
    accuracy = _ratio(right, everything)
    rows = F.array(
        *[row(str(c), *[per[c][m] for m in metrics], per[c]["support"]) for c in CLASSES],
        row("accuracy", accuracy, accuracy, accuracy, everything),
        row("macro avg", *[macro(m) for m in metrics], everything),
        row("weighted avg", *[by_support(m) for m in metrics], everything),
    )
    return counted.select(rows.alias("rows")).select(F.inline("rows"))


def macro_f1() -> Column:
    """Mean F1 over the classes that occur as label or prediction, from counted cells."""
    per = _class_scores(_counted())
    used = per[-1]["used"] + per[0]["used"] + per[1]["used"]
    return _ratio(per[-1]["f1"] + per[0]["f1"] + per[1]["f1"], used)


def weight_grid(df: DataFrame, actual: str = "actual", scores: str = "scores") -> DataFrame:
    """Macro-F1 of every weight candidate; the first best one is marked.

    Candidates multiply rows in flight only: they are counted before the shuffle,
    which moves at most 24 rows per task.
    """
    candidates = F.array(
        *[
            F.struct(
                F.lit(i * len(POSITIVE_WEIGHTS) + j).alias("position"), F.lit(wn).alias("weight_passed"),
                F.lit(wp).alias("weight_within"),
            )
            for i, wn in enumerate(NEGATIVE_WEIGHTS)
            for j, wp in enumerate(POSITIVE_WEIGHTS)
        ]
    )
    weights = F.array("weight_passed", F.lit(1.0), "weight_within")
    keys = ("position", "weight_passed", "weight_within")
    tried = df.select(F.col(actual), F.col(scores), F.inline(candidates))
    chosen = tried.withColumn("_chosen", best_class(weighted(scores, weights)))
    grid = chosen.groupBy(*keys).agg(*_cells(F.col(actual), F.col("_chosen"))).select(*keys, macro_f1().alias("macro_f1"))
    # Bounded: 24 rows, one per candidate.
    rows = grid.agg(F.collect_list(F.struct(*keys, "macro_f1")).alias("rows"))
    best = F.array_max(F.transform("rows", lambda r: F.struct(r["macro_f1"], -r["position"])))
    return rows.withColumn("best", -best["col2"]).select("best", F.inline("rows")).select(
        *keys, "macro_f1", (F.col("position") == F.col("best")).alias("is_best")
    )


# --- ROC ---------------------------------------------------------------------


def one_vs_rest(df: DataFrame, actual: str, scores: dict[int, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row and class: is it the class, and the score given to it. A missing score is an error."""

    def known(name: str) -> Column:
        score = F.col(name).cast("double")
        return F.when(score.isNull() | F.isnan(score), F.raise_error(F.lit(f"missing score in {name}")).cast("double")).otherwise(score)

    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_id"),
                (F.col(actual) == c).cast("bigint").alias("hit"),
                known(name).alias("score"),
            )
            for c, name in scores.items()
        ]
    )
    return df.select(*keep, F.inline(rows))


def score_counts(df: DataFrame, actual: str, scores: dict[int, str]) -> DataFrame:
    """Positives and negatives per class and distinct score; all later steps work on this."""
    return (
        one_vs_rest(df, actual, scores)
        .groupBy("class_id", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    )


def class_auc(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Area under the ROC curve per class; null for a class with one kind of label only."""
    ranked = running_sums(counts, "class_id", "score", {"pos_sum": "pos", "neg_sum": "neg"}, parts)
    # Negatives below, and half of those at the same score.
    won = F.col("pos") * (F.col("neg_sum") - F.col("neg") / 2)
    return ranked.groupBy("class_id").agg(
        F.try_divide(F.sum(won), F.first("pos_sum_total") * F.first("neg_sum_total")).alias("auc")
    )


def macro_auc(df: DataFrame, actual: str, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    """Mean AUC over the classes, as one row; null when a class has no AUC."""
    return _macro_auc(score_counts(df, actual, scores), scores, parts)


def _macro_auc(counts: DataFrame, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    per = class_auc(counts, parts)
    return per.agg(
        F.when(F.count("auc") == len(scores), F.avg("auc")).alias("macro_auc"),
        *[F.max(F.when(F.col("class_id") == c, F.col("auc"))).alias(f"auc_{c + 1}") for c in scores],
    )


def roc_curves(df: DataFrame, actual: str, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    """Corner points of every class's ROC curve, from (0, 0) to (1, 1).

    A point between two equal steps lies on a straight line and is left out.
    """
    return _roc_curves(score_counts(df, actual, scores), scores, parts)


def _roc_curves(counts: DataFrame, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    counts = counts.withColumn("fall", -F.col("score"))
    step = F.struct("pos", "neg")
    walked = with_neighbours(counts, "class_id", "fall", step, parts)
    bend = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
    corner = F.isnull("previous") | F.isnull("next") | bend
    walked = walked.withColumn("corner", corner).drop("previous", "next")
    summed = running_sums(walked, "class_id", "fall", {"tp": "pos", "fp": "neg"}, parts)
    points = summed.filter("corner").select(
        "class_id",
        F.try_divide("fp", "fp_total").alias("fpr"),
        F.try_divide("tp", "tp_total").alias("tpr"),
        "score",
    )
    origin = F.array(*[F.lit(c) for c in scores])
    start = points.sparkSession.range(1).select(
        F.explode(origin).alias("class_id"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(None).cast("double").alias("score"),
    )
    return points.unionByName(start)


def macro_roc(df: DataFrame, actual: str, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    """Mean ROC curve on the union of the classes' false positive rates.

    Between the points of a class its curve is linear; at a vertical step the
    upper end counts.
    """
    return _macro_roc(roc_curves(df, actual, scores, parts), scores, parts)


def _macro_roc(curves: DataFrame, scores: dict[int, str], parts: int | None = None) -> DataFrame:
    at = (
        curves
        .filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
        .groupBy("class_id", "fpr")
        .agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    )
    grid = at.select("fpr").distinct().select("fpr", F.explode(F.array(*[F.lit(c) for c in scores])).alias("class_id"))
    rows = grid.join(at, ["class_id", "fpr"], "left")
    known = F.when(F.col("high").isNotNull(), F.struct("fpr", "low", "high"))
    near = with_neighbours(rows, "class_id", "fpr", known, parts)
    before, after = F.col("previous"), F.col("next")
    slope = (after["low"] - before["high"]) / (after["fpr"] - before["fpr"])
    line = before["high"] + slope * (F.col("fpr") - before["fpr"])
    return near.groupBy("fpr").agg(
        F.when(F.count(F.coalesce("high", line)) == len(scores), F.avg(F.coalesce("high", line))).alias("macro_tpr")
    )


# --- all of it from one count --------------------------------------------------


def evaluation_counts(df: DataFrame, actual: str, predicted: str, scores: dict[int, str]) -> DataFrame:
    """Rows per class, score given to it, actual and predicted class: all that an evaluation needs, by one pass over the rows."""
    known = one_vs_rest(df.select(actual, predicted, *scores.values()), actual, scores, (actual, predicted))
    return known.groupBy("class_id", "score", F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def evaluate(df: DataFrame, actual: str, predicted: str, scores: dict[int, str]) -> dict[str, DataFrame]:
    """Report, confusion, AUC and ROC curves; the rows are read once, into a written count."""
    counts = written_table(evaluation_counts(df, actual, predicted, scores))
    one = counts.where(F.col("class_id") == next(iter(scores)))  # every row once
    hit = F.col("actual") == F.col("class_id")
    by_score = written_table(
        counts.groupBy("class_id", "score").agg(_rows(hit, "n").alias("pos"), _rows(~F.coalesce(hit, F.lit(False)), "n").alias("neg"))
    )
    curves = _roc_curves(by_score, scores)
    return {
        "report": classification_report(one, weight="n"),
        "confusion": confusion_matrix(one, weight="n"),
        "auc": _macro_auc(by_score, scores),
        "roc": curves.select("class_id", "fpr", "tpr", "score"),
        "macro_roc": _macro_roc(curves, scores),
    }


# --- losses ------------------------------------------------------------------

LOSSES = ("cross_entropy_loss", "bce_with_logits_loss", "mse_loss")


def evaluation_loss(df: DataFrame, logits: str, label: str, size: int) -> DataFrame:
    """Mean loss over all rows, one row per kind of loss."""
    target = one_hot(label, size)
    per_row = {
        "cross_entropy_loss": cross_entropy(logits, label),
        "bce_with_logits_loss": bce_with_logits(logits, target),
        "mse_loss": squared_error(logits, target),
    }
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("loss"), F.avg(n).alias("value"), F.count(n).alias("n_rows"))
            for n in LOSSES
        ]
    )
    return df.select(*[c.alias(n) for n, c in per_row.items()]).agg(rows.alias("rows")).select(F.inline("rows"))
