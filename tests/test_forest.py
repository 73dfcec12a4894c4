import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from checks.registry import TRAINING
from fleetspan.plans import forest, model

N, WIDTH = 1500, 436


@pytest.fixture(scope="module")
def data():
    """A number that may be zero and three text columns; the class follows the number and two of the texts."""
    rng = np.random.default_rng(3)
    number, texts = rng.integers(0, 9, N).astype(float), [rng.integers(0, c, N) for c in (5, 30, 400)]
    slots = [[*([0] if x else []), 1 + a, 6 + b, 36 + c] for x, a, b, c in zip(number, *texts)]
    values = [[*([x] if x else []), 1.0, 1.0, 1.0] for x in number]
    labels = ((texts[0] == 2) | (number > 6)).astype(int) + (texts[1] < 8)
    return slots, values, labels


def batches(data, order, size):
    slots, values, labels = data
    for a in range(0, N, size):
        at = order[a : a + size]
        if not len(at):
            return
        hashes = [hash((tuple(slots[i]), tuple(values[i]))) for i in at]
        columns = [pa.array(hashes, pa.int64()), pa.array(labels[at], pa.int32()), pa.array([slots[i] for i in at], pa.list_(pa.int32())), pa.array([values[i] for i in at], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "label", "slots", "held"])


def walk(tree, slots, values):
    feature, child, threshold, leaf = (np.frombuffer(b, k) for b, k in zip(tree, ("i4", "i4", "f8", "f4")))
    held, node = dict(zip(slots, values)), 0
    while feature[node] >= 0:
        node = child[node] + (held.get(int(feature[node]), 0.0) > threshold[node])
    return node, leaf.reshape(-1, 3)[child[node]]


def growth(rows, tree, depth=12):
    return forest._Growth(rows, np.array([1.0, 2.0, 3.0]), 21, depth, 2, np.random.default_rng([42, tree]))


def test_a_task_holds_every_row_in_any_layout(data):
    rows = forest.gathered(batches(data, np.arange(N), 400), N, 4, WIDTH)
    assert len(rows.labels) == N and np.bincount(rows.labels).tolist() == np.bincount(data[2]).tolist()
    assert sorted(rows.numbers) == [0] and rows.numbers[0].sum() == sum(x[0] for s, x in zip(*data[:2]) if s[0] == 0)
    for s in range(1, WIDTH):
        held = rows.posted[rows.starts[s] : rows.starts[s + 1]]
        assert sorted(held.tolist()) == np.flatnonzero((rows.slots == s).any(axis=0)).tolist()
    with pytest.raises(ValueError, match="training rows"):
        forest.gathered(batches(data, np.arange(N - 5), 400), N, 4, WIDTH)
    other = forest.gathered(batches(data, np.random.default_rng(1).permutation(N), 333), N, 4, WIDTH)
    assert growth(rows, 5).grown() == growth(other, 5).grown()


def test_leaves_hold_the_rows_that_reach_them(data):
    """Both ways of counting, by lists of rows and by the rows themselves, against every row's own way down."""
    rows = forest.gathered(batches(data, np.arange(N), 400), N, 4, WIDTH)
    for small in (0, 64, 10 * N):
        one = growth(rows, 1)
        one.small = small
        tree, reached = one.grown(), {}
        for r in np.flatnonzero(one.times).tolist():
            slots = [int(s) for s in rows.slots[:, r] if s < WIDTH]
            node, _ = walk(tree, [0, *slots], [rows.numbers[0][r], *[1.0] * len(slots)])
            reached.setdefault(node, np.zeros(3))[rows.labels[r]] += one.times[r]
        leaves = [k for k, f in enumerate(one.feature) if f < 0]
        assert sorted(reached) == leaves and len(leaves) > 10
        assert all((reached[k] == one.counts[k]).all() and reached[k].sum() >= 2 for k in leaves)


def test_scores_are_the_average_of_all_trees(data):
    rows = forest.gathered(batches(data, np.arange(N), 400), N, 4, WIDTH)
    trees = [growth(rows, k).grown() for k in range(6)]
    slots, values = [*data[0][:300], [], [435, 1]], [*data[1][:300], [], [1.0, 1.0]]
    found = forest.scored([np.array(s, dtype=np.int32) for s in slots], [np.array(v) for v in values], forest.steps_of(trees, WIDTH, 3, [0]))
    plain = np.array([np.mean([walk(t, s, v)[1] for t in trees], axis=0, dtype=np.float64) for s, v in zip(slots, values)])
    assert np.abs(found - plain / plain.sum(axis=1, keepdims=True)).max() < 1e-9
    assert (found.argmax(axis=1)[:300] == data[2][:300]).mean() > 0.6


def test_drawn_slots_are_different():
    rng = np.random.default_rng(2)
    for k, width in ((1, 1), (3, 5), (5, 5), (20, 400), (30, 100_000), (400, 90_000)):
        drawn = forest.drawn_slots(rng, 50, k, width)
        assert drawn.shape == (50, k) and drawn.min() >= 0 and drawn.max() < width
        assert all(len(set(line)) == k for line in drawn.tolist())


def test_forest_does_not_depend_on_the_partitions(spark, data, tmp_path):
    rows = [(Vectors.sparse(WIDTH, s, v), float(c)) for s, v, c in zip(*data[:2], data[2].tolist())]
    df = spark.createDataFrame(rows, ["features", "label"])
    one = forest.fit_forest(df, [1.0, 2.0, 3.0], trees=7, max_depth=8, min_leaf=2, seed=42)
    two = forest.fit_forest(df.repartition(5), [1.0, 2.0, 3.0], trees=7, max_depth=8, min_leaf=2, seed=42)
    assert one.getNumTrees == 7 and one.numFeatures == WIDTH and one.numbers == [0]
    assert one.trees == two.trees and len(set(one.trees)) == 7
    one.save(str(tmp_path / "f"))
    again = forest.load_forest(spark, str(tmp_path / "f"))
    assert vars(again) == vars(one) | {"_sent": None}
    scores = [r[0] for r in again.transform(df.limit(50)).select(vector_to_array("probability")).collect()]
    assert all(abs(sum(s) - 1.0) < 1e-9 for s in scores)


def test_registered_forest_is_fitted_on_all_rows(spark):
    """Every training row is used, however many there are, unless a caller names a bound."""
    train = spark.range(9000).select(F.concat(F.lit("d"), "id").alias("device_name"))
    counts = {-1: 3_000_000, 0: 3_000_000, 1: 3_000_000}
    assert model.fitted_rows(train, counts, TRAINING).count() == 9000
    assert model.fitted_rows(train, counts, model.TrainingOptions()).count() == 9000
    assert TRAINING.trees == 500 and TRAINING.max_depth == 30
