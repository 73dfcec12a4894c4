"""Benchmark decontamination: windows of an item's size within a small edit distance of the item.

CGK random walks embed word sequences so that few edits become few differing
positions; bit-sampling LSH on a few positions of the embedding, repeated with
other walks until the wanted recall, finds candidate windows; each candidate is
verified by its exact edit distance in words.

Only windows that can match are embedded. An item cut into one part more than edits
are allowed has a part that every match holds unchanged, so a window must lie around
such a part. The parts of all items are looked up in one pass over the rolling hashes
of a text, however many items and lengths there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.workers import kept
from fleetspan.operators.sizing import written_table

WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


TAG_BITS = 18  # leading bits of a hash by which most others are told apart


@dataclass(frozen=True)
class Decontamination:
    similarity: float = 0.8  # 1 - edits / words of the item
    recall: float = 0.95  # for windows with as many edits as allowed
    sampled: int = 2  # embedded positions per key
    min_words: int = 5  # shorter items would match by chance; they too can be looked for, then exactly, as no edit is allowed
    block_items: int = 5000  # items per pass over the documents
    pairs: int = 2000  # on which the recall is measured, twice
    repetitions: int = 400  # at most; items of a length that needs more are compared with every window around a part
    seed: int = 11

    def edits(self, words: int) -> int:
        return int(words * (1 - self.similarity) + 1e-9)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two arrays (pairs, words), a row of the table at a time."""
    n = b.shape[1]
    steps = np.arange(n + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(a), n + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


class Walks:
    """CGK walks: at step t the walk emits the word it stands on and moves on if a random bit of (t, word) is set."""

    def __init__(self, repetition: int, words: int, settings: Decontamination):
        rng = np.random.default_rng((settings.seed, repetition, words))
        self.words = words
        self.at = np.unique(rng.integers(0, max(1, 2 * words), settings.sampled))
        self.factor = rng.integers(1, 1 << 63, self.at[-1] + 1, dtype=np.uint64) | np.uint64(1)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """A number for the sampled positions of each row (row, words and a closing column)."""
        place, lane = np.zeros(len(rows), np.int64), np.arange(len(rows))
        key = np.zeros(len(rows), np.uint64)
        sampled = set(self.at.tolist())
        for t, factor in enumerate(self.factor):
            word = rows[lane, place]
            if t in sampled:
                key = (key ^ word) * MIX
                key ^= key >> np.uint64(29)
            place += (((word + np.uint64(1)) * factor) >> np.uint64(61) & np.uint64(1)).astype(np.int64)
            np.minimum(place, self.words, out=place)
        return key


def _closed(rows: np.ndarray) -> np.ndarray:
    """With a closing symbol that no word has, where the walk rests."""
    end = np.full((len(rows), 1), np.uint64(1 << 62), np.uint64)
    return np.concatenate([rows.astype(np.uint64), end], axis=1)


def edited_pairs(rows: np.ndarray, settings: Decontamination, n_pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Items and copies of them with as many random edits as allowed, both closed."""
    rng = np.random.default_rng((settings.seed, rows.shape[1], seed))
    n, edits = rows.shape[1], settings.edits(rows.shape[1])
    left, right = [], []
    for k in range(n_pairs):
        row = rows[k % len(rows)].tolist()
        copy = list(row)
        for _ in range(edits):
            at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
            copy[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1 << 40, 1 << 41))]
        copy += rng.integers(1 << 40, 1 << 41, max(0, n - len(copy))).tolist()
        left.append(row)
        right.append(copy[:n])
    a, b = _closed(np.array(left, np.uint64)), _closed(np.array(right, np.uint64))
    near = edit_distances(a[:, :n], b[:, :n]) <= edits
    return a[near], b[near]


def lower_bound(share: float, n: int) -> float:
    """Lower end of the 95 % interval of a share measured on n trials (Wilson)."""
    z = 1.96
    return (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def repetitions_for(rows: np.ndarray, settings: Decontamination) -> int | None:
    """Repetitions that reach the recall with certainty on fresh edited copies of the items; None when there are not enough.

    The bound has to hold on one set of copies, and again on a second one, on which
    the number was not chosen.
    """
    if not settings.edits(rows.shape[1]):
        return 1
    needed = 4
    for seed in (1, 2):
        a, b = edited_pairs(rows, settings, settings.pairs, seed)
        found = np.zeros(len(a), bool)
        for repetition in range(settings.repetitions):
            walk = Walks(repetition, rows.shape[1], settings)
            left = np.flatnonzero(~found)
            found[left] = walk.keys(a[left]) == walk.keys(b[left])
            if repetition + 1 >= needed and lower_bound(found.mean(), len(found)) >= settings.recall:
                needed = repetition + 1
                break
        else:
            return None
    return needed


def part_bounds(words: int, edits: int) -> list[tuple[int, int]]:
    """An item cut into edits + 1 parts of nearly equal length: first word and end of each."""
    cuts = [words * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(cuts, cuts[1:]))


def run_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` ids from every place on."""
    n = max(len(ids) - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ ids[k : k + n].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(31)
    return out


class Items:
    """The items of a block, by length: vocabulary, walks and keys."""

    def __init__(self, items: list[tuple[object, list[str]]], settings: Decontamination):
        self.settings = settings
        items = [(i, w) for i, w in items if len(w) >= settings.min_words]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.weights = np.random.default_rng(settings.seed).integers(1, 1 << 62, max([1, *(len(w) for _, w in items)]))
        self.by_length = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}  # by length of the part: its hash, the item's length, its place in the item
        for n in sorted({len(w) for _, w in items}):
            own = [(i, [self.vocabulary[w] for w in ws]) for i, ws in items if len(ws) == n]
            rows = np.array([w for _, w in own], np.uint64)
            repetitions = repetitions_for(rows, settings)
            walks = [Walks(r, n, settings) for r in range(repetitions or 0)]
            tables = []
            for walk in walks:
                keys = walk.keys(_closed(rows))
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order))
            self.by_length[n] = ([i for i, _ in own], rows, walks, tables)
            for first, end in part_bounds(n, settings.edits(n)):
                for h in set(run_hashes(rows[:, first:end].reshape(-1), end - first)[:: end - first].tolist()):
                    parts.setdefault(end - first, []).append((h, n, first))
        self.parts = {}
        for length, found in parts.items():
            table = np.array(sorted(found), dtype=[("hash", np.uint64), ("n", np.int64), ("first", np.int64)])
            hashes, tags = np.ascontiguousarray(table["hash"]), np.zeros(1 << TAG_BITS, bool)
            tags[hashes >> np.uint64(64 - TAG_BITS)] = True
            self.parts[length] = (hashes, tags, table["n"], table["first"])

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """By length of the items: the starts of windows around an unchanged part of one of them."""
        spans: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        words, known = ids.astype(np.uint64), ids > 0
        every, whole = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool)
        for length in range(1, min(max(self.parts, default=0), len(ids)) + 1):
            # One step of run_hashes after the other: each length goes on from the one before.
            n = len(ids) - length + 1
            every = (every[:n] ^ words[length - 1 :]) * MIX
            every ^= every >> np.uint64(31)
            whole = whole[:n] & known[length - 1 :]
            if length not in self.parts:
                continue
            hashes, tags, sizes, firsts = self.parts[length]
            at = np.flatnonzero(whole & tags[every >> np.uint64(64 - TAG_BITS)])
            mine = every[at]
            low = np.searchsorted(hashes, mine, "left")
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == mine)
            low, at = low[hit], at[hit]
            counts = np.searchsorted(hashes, mine[hit], "right") - low
            entry = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin, of = np.repeat(at, counts) - firsts[entry], sizes[entry]
            for n in np.unique(of).tolist():
                edits, mid = self.settings.edits(n), begin[of == n]
                spans.setdefault(n, []).append((mid - edits, mid + edits + 1))
        out = {}
        for n, found in spans.items():
            room = len(ids) - n + 1
            if room > 0:
                depth = np.zeros(room + 1, np.int64)
                for low, high in found:
                    np.add.at(depth, np.clip(low, 0, room), 1)
                    np.add.at(depth, np.clip(high, 0, room), -1)
                out[n] = np.flatnonzero(np.cumsum(depth[:room]) > 0)
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(number of the text, item, edits, first word, words of the item): the best window for each text and item."""
        get, parts = self.vocabulary.get, []
        for text in texts:
            parts.append(np.fromiter(map(get, words_of(text), repeat(0)), np.int64))
            parts.append(np.zeros(1, np.int64))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.cumsum([len(p) for p in parts])[1::2]  # one past the closing zero of each text
        best: dict[tuple[int, int, int], tuple[int, int]] = {}
        for n, starts in self.windows(ids).items():
            _, rows, walks, tables = self.by_length[n]
            allowed = self.settings.edits(n)
            owner = np.searchsorted(ends, starts, "right")
            inside = starts + n < ends[owner] if len(starts) else np.zeros(0, bool)
            starts, owner = starts[inside], owner[inside]
            if not len(starts):
                continue
            # Equal windows are looked up once; a hash sorts them, and only rows equal to their group's first share it.
            windows = ids[starts[:, None] + np.arange(n)]
            hashes = windows @ self.weights[:n]
            _, firsts, which = np.unique(hashes, return_index=True, return_inverse=True)
            odd = (windows != windows[firsts[which]]).any(axis=1)
            if odd.any():
                which[odd] = len(firsts) + np.arange(odd.sum())
                firsts = np.concatenate([firsts, np.flatnonzero(odd)])
            different = windows[firsts].astype(np.uint64)
            closed, pairs = _closed(different), []
            for walk, (keys, order) in zip(walks, tables):
                mine = walk.keys(closed)
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(high > low)
                counts = (high - low)[hit]
                item = order[np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
                pairs.append(np.unique(np.repeat(hit, counts) * len(rows) + item))
            if not walks:  # the walks would not reach the recall
                pairs = [np.arange(len(different) * len(rows))]
            near: dict[int, list[tuple[int, int]]] = {}
            candidates = np.unique(np.concatenate(pairs))
            for k in range(0, len(candidates), 4096):
                window, item = np.divmod(candidates[k : k + 4096], len(rows))
                distance = edit_distances(different[window], rows[item])
                for w, i, d in zip(window[distance <= allowed], item[distance <= allowed], distance[distance <= allowed]):
                    near.setdefault(int(w), []).append((int(i), int(d)))
            if not near:
                continue
            for k in np.flatnonzero(np.isin(which, list(near))):
                text, start = int(owner[k]), int(starts[k])
                first = start - (int(ends[text - 1]) if text else 0)
                for item, distance in near[int(which[k])]:
                    name = (text, n, item)
                    if name not in best or (distance, first) < best[name]:
                        best[name] = (distance, first)
        return [(t, self.by_length[n][0][i], d, s, n) for (t, n, i), (d, s) in sorted(best.items())]


def _item_blocks(benchmark: DataFrame, settings: Decontamination, key: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """The items, each once, in blocks of bounded size; at least one block."""
    chosen = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    block: list[tuple[object, list[str]]] = []
    started = False
    for row in chosen.distinct().toLocalIterator():
        block.append((row["item_id"], words_of(row["text"])))
        if len(block) == settings.block_items:
            yield block
            block, started = [], True
    if block or not started:
        yield block


FOUND = ("item_id", "edits", "start_word", "n_words")


def _search(docs: DataFrame, items: list[tuple[object, list[str]]], settings: Decontamination, text: str) -> tuple[Column, Broadcast]:
    """Arrays of what is found in a text, one element per item, and the shared block of items."""
    shared = docs.sparkSession.sparkContext.broadcast({"items": items, "settings": settings.__dict__})

    @F.pandas_udf("item_id array<bigint>, edits array<int>, start_word array<int>, n_words array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = kept(shared.value, lambda: Items(shared.value["items"], Decontamination(**shared.value["settings"])))
        for texts in batches:
            found: list[list[tuple]] = [[] for _ in range(len(texts))]
            for t, *rest in index.matches(texts.tolist()):
                found[t].append(rest)
            yield pd.DataFrame({name: [[f[k] for f in rows] for rows in found] for k, name in enumerate(FOUND)})

    return find(F.col(text)), shared


def _by_block(benchmark: DataFrame, settings: Decontamination, key: str, text: str, step: Callable[[list, bool], None]) -> None:
    """Run ``step(items, last)`` for every block of items; the driver holds two blocks at most."""
    blocks = _item_blocks(benchmark, settings, key, text)
    items: list | None = next(blocks)
    while items is not None:
        following = next(blocks, None)
        step(items, following is None)
        items = following


def contaminated(
    docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination(), key: str = "doc_id",
    text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, edits, similarity, start_word and n_words.

    Words are runs of letters and digits in lower case. The best window counts; on
    ties the first. Null and empty texts and items match nothing, nor do items under
    ``min_words`` words; repeated rows of documents give repeated rows, repeated
    items count once. The items are the stated query set: they are taken in blocks
    of bounded size, each against all documents, so nothing is shuffled. What a block
    gives is written before the next one is sent. Other columns play no part.
    """
    parts: list[DataFrame] = []

    def step(items: list, last: bool) -> None:
        found, shared = _search(docs, items, settings, text)
        rows = docs.select(F.col(key).alias("doc_id"), found.alias("found"))
        each = rows.select("doc_id", F.explode(F.arrays_zip(*[F.col(f"found.{n}").alias(n) for n in FOUND])).alias("m"))
        part = each.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in FOUND])
        if not last:
            part = written_table(part)
            shared.destroy()
        parts.append(part)

    _by_block(benchmark, settings, item_key, item_text, step)
    return reduce(DataFrame.unionAll, parts).withColumn("similarity", F.lit(1.0) - F.col("edits") / F.col("n_words"))


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination(), text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The documents in which no item is found, with their own columns; same rules as ``contaminated``."""
    out = docs

    def step(items: list, last: bool) -> None:
        nonlocal out
        found, shared = _search(out, items, settings, text)
        out = out.where(F.size(found["item_id"]) == 0)
        if not last:
            out = written_table(out)
            shared.destroy()

    _by_block(benchmark, settings, item_key, item_text, step)
    return out
