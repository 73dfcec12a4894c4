"""Class scores: weighted decisions, softmax, sigmoid and losses over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Class order of every score array.
CLASSES = (-1, 0, 1)


def doubles(scores: Column | str) -> Column:
    return col(scores).cast("array<double>")


def weighted(scores: Column | str, weights: Column) -> Column:
    return F.zip_with(col(scores), weights, lambda s, w: s * w)


def weight_array(weights: dict[int, float]) -> Column:
    """Decision weights in class order; a class without one counts 1."""
    return F.array(*[F.lit(float(weights.get(c, 1.0))) for c in CLASSES])


def best_class(scores: Column) -> Column:
    """Class with the greatest score, the first one on ties."""
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return F.element_at(classes, F.array_position(scores, F.array_max(scores)).cast("int"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column | str) -> Column:
    x = doubles(logits)
    powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(powers, lambda p: p / array_sum(powers))


def sigmoid(logits: Column | str) -> Column:
    return F.transform(doubles(logits), lambda v: 1.0 / (1.0 + F.exp(-v)))


def one_hot(label: Column | str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == col(label)).cast("double"))


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """log-sum-exp minus the logit of the label (counted from 0)."""
    x = doubles(logits)
    top = F.array_max(x)
    return top + F.log(array_sum(F.transform(x, lambda v: F.exp(v - top)))) - F.get(x, col(label))


def bce_with_logits(logits: Column | str, targets: Column) -> Column:
    """Mean over the elements, in the form that does not overflow."""
    x = doubles(logits)
    terms = F.zip_with(x, targets, lambda v, t: F.greatest(v, F.lit(0.0)) - v * t + F.log1p(F.exp(-F.abs(v))))
    return array_sum(terms) / F.size(x)


def squared_error(outputs: Column | str, targets: Column) -> Column:
    x = doubles(outputs)
    return array_sum(F.zip_with(x, targets, lambda v, t: (v - t) * (v - t))) / F.size(x)
