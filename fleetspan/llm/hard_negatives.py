"""Hard-negative mining over STR-packed R-trees.

The rows are ranged by label and first coordinate and cut into slabs of bounded size.
Each slab is packed by sort-tile-recursive into an R-tree: leaves of near rows under
minimum bounding boxes. For a query a box gives the interval its inner products lie
in, coordinate by coordinate. A best-first queue takes boxes by their highest product
and leaves out those outside the wanted score window, of the wrong label, or that
cannot beat the k-th result: strictly below it, or equal with larger keys only.

Queries are packed into blocks and meet every tree once. A block is searched as one: boxes
no query of it can use are left out, the products with the others come from one matrix
product, and what is below the k-th result of an earlier tree goes no further. Queries
whose products need more than a double take the queue, one by one. Trees and blocks are
joined by a group number, so the work is dealt evenly; only the best few of a query in
each tree leave the task, and Spark ranks them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.operators.sizing import written_table

TREE_ROWS = 4096
LEAF_ROWS = 64
FAN = 8
TILED = 3  # coordinates a slab is tiled by, those with the widest spread
BLOCK_ANCHORS = 512
GROUPS_A_CORE = 4
ROWS_AT_ONCE = 16  # pairs of a tree and a block in an Arrow batch: about 40 MB at 64 coordinates
EXACT = float(1 << 53)
MOST_LONG = (1 << 63) - 1

_TREE = "tree long, label string, width int, ids binary, data binary, starts binary, low binary, high binary"


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of few rows while a table of large rows is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scaled_rows(rows: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, once per key; v holds whole numbers as doubles."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    exact = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(float(scale)))
    # floor() gives a long; beyond it a double is whole already.
    small = lambda x: F.abs(x) < F.lit(float(1 << 52))
    v = F.transform(exact, lambda x: F.when(small(x), F.floor(F.when(small(x), x)).cast("double")).otherwise(x))
    taken = rows.where(usable).select(F.col(key).alias("vec_id"), label.cast("string").alias("label"), v.alias("v"))
    return taken.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.label", "one.v")


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def str_order(data: np.ndarray, leaf: int = LEAF_ROWS, tiled: int = TILED) -> np.ndarray:
    """Sort-tile-recursive: the order in which every ``leaf`` rows make a leaf."""
    axes = np.argsort(-np.ptp(data, axis=0), kind="stable")[:tiled] if data.size else np.zeros(0, dtype=np.int64)

    def tile(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        if depth == axes.size or rows.size <= leaf:
            yield rows
            return
        rows = rows[np.argsort(data[rows, axes[depth]], kind="stable")]
        leaves = -(-rows.size // leaf)
        slices = int(np.ceil(leaves ** (1 / (axes.size - depth))))
        size = -(-leaves // slices) * leaf
        for k in range(0, rows.size, size):
            yield from tile(rows[k : k + size], depth + 1)

    return np.concatenate(list(tile(np.arange(len(data)), 0)))


def _packed_tree(number: int, label: str, ids: list[int], vectors: list) -> tuple:
    data, names = _matrix(vectors), np.array(ids, dtype=np.int64)
    order = str_order(data)
    data, names = data[order], names[order]
    starts = np.arange(0, len(names), LEAF_ROWS)
    low, high = np.minimum.reduceat(data, starts, axis=0), np.maximum.reduceat(data, starts, axis=0)
    return (number, label, data.shape[1], names.tobytes(), data.tobytes(), starts.tobytes(), low.tobytes(), high.tobytes())


def packed_trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row per tree of at most ``tree_rows`` rows of one label. Equal vectors are dealt out by their keys."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        label, ids, vectors = None, [], []

        def tree() -> pd.DataFrame:
            nonlocal number
            number += 1
            return pd.DataFrame([_packed_tree(number, label, ids, vectors)], columns=[c.split()[0] for c in _TREE.split(", ")])

        for batch in batches:
            for key, name, vector in zip(batch["vec_id"].tolist(), batch["label"], batch["v"]):
                if ids and (name != label or len(ids) >= tree_rows):
                    yield tree()
                    ids, vectors = [], []
                label = name
                ids.append(key)
                vectors.append(vector)
        if ids:
            yield tree()

    order = ["label", "c0", "vec_id"]
    ranged = rows.withColumn("c0", F.coalesce(F.get("v", F.lit(0)), F.lit(0.0))).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("vec_id", "label", "v").mapInPandas(task, _TREE)


class Tree:
    """An unpacked tree: leaves, and nodes over every FAN of them, up to one root; ``levels[0]`` are the leaves."""

    def __init__(self, row, width: int):
        d = row.width
        at = lambda b, kind: np.frombuffer(b, dtype=kind)
        pad = lambda m: np.pad(m, ((0, 0), (0, width - d)))
        self.ids = at(row.ids, np.int64)
        self.data = pad(at(row.data, np.float64).reshape(len(self.ids), d))
        starts = at(row.starts, np.int64)
        self.starts = np.append(starts, len(self.ids))
        least = np.minimum.reduceat(self.ids, starts)
        self.levels = [(pad(at(row.low, np.float64).reshape(len(starts), d)), pad(at(row.high, np.float64).reshape(len(starts), d)), least)]
        while len(self.levels[-1][2]) > 1:
            low, high, least = self.levels[-1]
            cuts = np.arange(0, len(least), FAN)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts)))


@dataclass
class Goal:
    """The best ``k`` scores from low to high, by score and then by smaller key."""

    low: float
    high: float
    k: int


def best_first(tree: Tree, query: np.ndarray, goals: list[Goal], exact: bool, leave_out: int | None = None, visited: list | None = None) -> list[list[tuple[int, int]]]:
    """For every goal its (score, key) pairs in this tree, best first."""
    plus, minus = np.maximum(query, 0), np.minimum(query, 0)
    bounds, scores = {}, {}

    def bound(level: int) -> tuple[list, list, list]:
        if level not in bounds:
            low, high, least = tree.levels[level]
            bounds[level] = ((high @ plus + low @ minus).tolist(), (low @ plus + high @ minus).tolist(), least.tolist())
        return bounds[level]

    # Rounding of the bounds: they are whole numbers below EXACT on the exact path, and widened on the other.
    slack = 0.0 if exact else 1e-9 * float(np.abs(query).sum() * max(np.abs(tree.data).max(initial=0), 1.0)) + 1.0

    def leaf_scores(leaf: int) -> np.ndarray:
        if leaf not in scores:
            a, b = tree.starts[leaf], tree.starts[leaf + 1]
            if exact:
                scores[leaf] = tree.data[a:b] @ query
            else:
                whole = [int(x) for x in query]
                scores[leaf] = np.array([sum(int(x) * y for x, y in zip(row, whole)) for row in tree.data[a:b]], dtype=object)
            if visited is not None:
                visited.append(leaf)
        return scores[leaf]

    out = []
    for goal in goals:
        best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -key)

        def useless(upper: float, lower: float, least: int) -> bool:
            if upper + slack < goal.low or lower - slack > goal.high:
                return True
            top = min(upper + slack, goal.high)
            return len(best) == goal.k and (top < best[0][0] or (top == best[0][0] and least > -best[0][1]))

        queue = []

        def push(level: int, node: int) -> None:
            upper, lower, least = (x[node] for x in bound(level))
            if not useless(upper, lower, least):
                heapq.heappush(queue, (-min(upper, goal.high), least, level, node, lower, upper))

        push(len(tree.levels) - 1, 0)
        while queue:
            _, least, level, node, lower, upper = heapq.heappop(queue)
            if useless(upper, lower, least):
                continue
            if level:
                for child in range(node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][2]))):
                    push(level - 1, child)
                continue
            found = leaf_scores(node)
            wanted = (found >= goal.low) & (found <= goal.high)
            if len(best) == goal.k:
                wanted &= found >= best[0][0]
            start = tree.starts[node]
            for i in np.flatnonzero(wanted).tolist():
                key = int(tree.ids[start + i])
                if key == leave_out:
                    continue
                entry = (int(found[i]), -key)
                if len(best) < goal.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        out.append([(score, -key) for score, key in sorted(best, reverse=True)])
    return out


def best_of_block(
    tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, leave_out: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``best_first`` finds on the exact path, for all queries of a block at once: goal, queries, keys and scores.

    ``low``, ``high`` and ``floor`` hold a row per goal and a column per query. A floor is a score that ``k`` rows of
    trees met so far reach; what lies below cannot be among the best ``k`` of all. Floors are raised in place.
    """
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    box_low, box_high, _ = tree.levels[0]
    upper, lower = plus @ box_high.T + minus @ box_low.T, plus @ box_low.T + minus @ box_high.T
    useful = np.zeros(len(tree.starts) - 1, dtype=bool)
    for a, b, f in zip(low, high, floor):
        useful |= ((upper >= np.maximum(a, f)[:, None]) & (lower <= b[:, None])).any(axis=0)
    rows = np.flatnonzero(np.repeat(useful, np.diff(tree.starts)))
    if not rows.size:
        return
    ids, scores = tree.ids[rows], queries @ tree.data[rows].T
    if leave_out is not None:
        scores[leave_out[:, None] == ids] = np.nan  # within no window
    for goal in range(len(low)):
        inside = (scores >= np.maximum(low[goal], floor[goal])[:, None]) & (scores <= high[goal][:, None])
        full = np.flatnonzero(np.count_nonzero(inside, axis=1) >= k)
        if full.size:
            least = np.partition(np.where(inside[full], scores[full], -np.inf), -k, axis=1)[:, -k]
            floor[goal, full] = least
            inside[full] &= scores[full] >= least[:, None]
        query, row = np.nonzero(inside)
        order = np.lexsort((ids[row], -scores[query, row], query))
        query, row = query[order], row[order]
        best = np.arange(query.size) - np.searchsorted(query, query) < k
        query, row = query[best], row[best]
        yield goal, query, ids[row], scores[query, row].astype(np.int64)


def _long(score: int) -> int:
    if abs(score) > MOST_LONG:
        raise OverflowError(f"an inner product of {score} does not fit a long; use a smaller scale")
    return score


@dataclass
class Block:
    """Anchors of one block as arrays; ``goal_ids`` and ``goal_scores`` have a row per goal, ``n_goals`` says how many count."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    queries: np.ndarray
    n_goals: np.ndarray
    goal_ids: np.ndarray
    goal_scores: np.ndarray


_BLOCK = "block long, anchor_width int, anchor_ids binary, anchor_labels array<string>, anchor_data binary, n_goals binary, goal_ids binary, goal_scores binary"


def _pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks as bytes, so that each is taken apart once and not for every tree it meets."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    for batch in batches:
        for number, anchors in zip(batch["block"].tolist(), batch["anchors"]):
            queries = _matrix([a["v"] for a in anchors])
            goals = [list(a["goals"]) if "goals" in a else [] for a in anchors]
            found = np.zeros((2, max(map(len, goals)), len(goals)), dtype=np.int64)
            for i, given in enumerate(goals):
                for j, g in enumerate(given):
                    found[:, j, i] = g["positive_id"], g["positive_score"]
            ids = np.array([a["vec_id"] for a in anchors], dtype=np.int64)
            counts = np.array([len(g) for g in goals], dtype=np.int64)
            row = (number, queries.shape[1], ids.tobytes(), [a["label"] for a in anchors], queries.tobytes(), counts.tobytes(), found[0].tobytes(), found[1].tobytes())
            yield pd.DataFrame([row], columns=names)


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors in blocks, packed; written, because every group of trees gets a copy."""
    n_blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    row = F.struct(*anchors.columns)
    blocks = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(row).alias("anchors"))
    with _small_batches(anchors.sparkSession):
        return written_table(blocks.mapInPandas(_pack_blocks, _BLOCK))


def _search(trees: DataFrame, anchors: DataFrame, task, schema: str) -> DataFrame:
    """Every block of anchors against every tree; written, as the batches are bounded only while this runs.

    The anchors are copied once for each group of trees. Groups follow the cores at work, not the rows, and each is a
    task of its own, whatever the bytes it reads.
    """
    spark = trees.sparkSession
    n_groups = max(1, min(trees.count(), GROUPS_A_CORE * spark.sparkContext.defaultParallelism))
    grouped = trees.withColumn("group", F.pmod(F.xxhash64("tree"), F.lit(n_groups)).cast("int"))
    copies = _blocks(anchors).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    pairs = grouped.repartition(n_groups, "group").join(copies.repartition(n_groups, "group").hint("merge"), "group")
    with _small_batches(spark):
        return written_table(pairs.mapInPandas(task, schema))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Tree, str, Block, bool]]:
    at = lambda b: np.frombuffer(b, dtype=np.int64)
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = at(row.anchor_ids)
            queries = np.frombuffer(row.anchor_data, dtype=np.float64).reshape(len(ids), row.anchor_width)
            width = max(row.width, row.anchor_width)
            tree = Tree(row, width)
            queries = np.pad(queries, ((0, 0), (0, width - row.anchor_width)))
            goals = (at(b).reshape(-1, len(ids)) for b in (row.goal_ids, row.goal_scores))
            block = Block(row.block, ids, np.array(row.anchor_labels, dtype=object), queries, at(row.n_goals), *goals)
            exact = np.abs(queries).max(initial=0) * np.abs(tree.data).max(initial=0) * max(width, 1) < EXACT
            yield tree, row.label, block, bool(exact)


def _positives(trees: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {}
        columns = ["anchor_id", "positive_id", "positive_score"]
        for tree, label, block, exact in _pairs(batches):
            same = np.flatnonzero(block.labels == label)
            if not same.size:
                continue
            if exact:
                known = floors.setdefault(block.number, np.full((1, len(block.ids)), -np.inf))
                floor, open_ = known[:, same], np.full((1, same.size), np.inf)
                for _, query, key, score in best_of_block(tree, block.queries[same], -open_, open_, floor, k, leave_out=block.ids[same]):
                    yield pd.DataFrame(dict(zip(columns, (block.ids[same[query]], key, score))))
                known[:, same] = floor
                continue
            out = []
            for i in same.tolist():
                (found,) = best_first(tree, block.queries[i], [Goal(-np.inf, np.inf, k)], exact, leave_out=int(block.ids[i]))
                out += [(int(block.ids[i]), key, _long(score)) for score, key in found]
            yield pd.DataFrame(out, columns=columns)

    found = _search(trees, anchors, task, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return written_table(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"))


def _negatives(low_percent: int, high_percent: int, k: int):
    """The task that finds, for every positive of an anchor, the best rows of other labels within its window."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {}
        columns = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        for tree, name, block, exact in _pairs(batches):
            others = np.flatnonzero(block.labels != name)
            if not others.size or not len(block.goal_ids):
                continue
            if exact and np.abs(block.goal_scores.astype(np.float64)).max(initial=0) < EXACT:
                known = floors.setdefault(block.number, np.full(block.goal_ids.shape, -np.inf))
                floor, score = known[:, others], block.goal_scores[:, others]
                counts = np.arange(len(score))[:, None] < block.n_goals[others]
                low = np.where(counts, -(-low_percent * score // 100), np.inf)
                high = np.where(counts, high_percent * score // 100, -np.inf)
                for goal, query, key, found in best_of_block(tree, block.queries[others], low, high, floor, k):
                    at = others[query]
                    yield pd.DataFrame(dict(zip(columns, (block.ids[at], block.goal_ids[goal, at], key, block.goal_scores[goal, at], found))))
                known[:, others] = floor
                continue
            out = []
            for i in others.tolist():
                n = int(block.n_goals[i])
                scores = list(zip(block.goal_ids[:n, i].tolist(), block.goal_scores[:n, i].tolist()))
                windows = [Goal(-(-low_percent * s // 100), high_percent * s // 100, k) for _, s in scores]
                for (positive, score), best in zip(scores, best_first(tree, block.queries[i], windows, exact)):
                    out += [(int(block.ids[i]), positive, negative, score, _long(s)) for s, negative in best]
            yield pd.DataFrame(out, columns=columns)

    return task


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become ``floor(scale * x)`` and scores are exact inner products. An
    anchor is a row whose key fulfils ``anchor`` (divisible by 100); its positives are
    its best other rows of the same label. For each positive come the best rows of
    other labels whose score is from ``low_percent`` to ``high_percent`` of its score;
    ties go to the smaller key. Keys are whole numbers.

    Rows with a null key, label, vector or component, or a component that is not finite,
    take no part. A key given several times counts once, with the smallest label and
    vector. Components missing in the shorter of two vectors count as zero. Scores
    beyond a long raise. An empty table, or one without anchors, gives an empty result;
    other columns play no part.
    """
    label = F.col(label) if isinstance(label, str) else label
    taken = written_table(scaled_rows(rows, key, label, vector, scale))
    wanted = F.pmod(F.col("vec_id"), F.lit(100)) == 0 if anchor is None else anchor
    anchors = taken.where(wanted).select("vec_id", "label", "v")
    trees = written_table(packed_trees(taken))
    found = _positives(trees, anchors, positives)
    goals = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("goals"))

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    mined = _search(trees, anchors.join(goals, "vec_id"), _negatives(low_percent, high_percent, negatives), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
