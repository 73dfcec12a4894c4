"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most d bits share at least 8 - d of
their 8 bytes at the same positions. Posting lists of single bytes would hold one
row in 256 each, so the lists are keyed by sets of positions that any such choice
of shared bytes must contain. Pairs that meet in a list are tallied: how many bytes do they
share in place? Those that reach the guaranteed number are verified on the bits.
Equal fingerprints are merged before, and a list gives a spanning forest of its
links instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.components import connected_components
from fleetspan.operators.sizing import written_table

SEED = 42
BYTES = 8
BLOCK = 1024  # rows of a list per task group; longer lists are dealt out by pairs of blocks
SMALL = 24  # lists up to this length are compared all at once, longer ones by search
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit number; no words: zero."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split act on ASCII letters and on \\x20 and \\x09-\\x0D only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), HASHES_AT_ONCE):
        cuts = map(slice, starts[k : k + HASHES_AT_ONCE], ends[k : k + HASHES_AT_ONCE])
        n = min(HASHES_AT_ONCE, len(starts) - k)
        h = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_column(text: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return hashed(F.col(text))


def covering_positions(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - distance of the 8 positions contain one of them.

    For distance 4 these are 20 triples: positions fall into three classes, and a
    triple lies in one class or has two in one class and one in the next. For other
    distances all sets of the shared size are taken.
    """
    shared = BYTES - distance
    if shared < 1:
        raise ValueError("a distance of 8 or more guarantees no shared byte")
    if shared != 4:
        return list(combinations(range(BYTES), shared))
    kind = [0, 0, 0, 1, 1, 1, 2, 2]

    def wanted(three: tuple[int, ...]) -> bool:
        k = sorted(kind[p] for p in three)
        return k[0] == k[2] or any(k.count(c) == 2 and k.count((c + 1) % 3) == 1 for c in range(3))

    return [t for t in combinations(range(BYTES), 3) if wanted(t)]


def _postings(nodes: DataFrame, distance: int) -> DataFrame:
    """(list, bytes, fp): one row per list a fingerprint is in."""
    entries = []
    for number, places in enumerate(covering_positions(distance)):
        key = F.lit(0).cast("long")
        for p in places:
            key = key.bitwiseOR(F.shiftleft(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * p))
        entries.append(F.struct(F.lit(number).alias("list"), key.alias("bytes")))
    return nodes.select("fp", F.explode(F.array(*entries)).alias("at")).select("at.list", "at.bytes", "fp")


_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then check: which pairs share the guaranteed bytes and differ in few enough bits?"""
    x = a ^ b
    differing = np.bitwise_count((((x & _LOW7) + _LOW7) | x) & _HIGH)  # one bit per byte that differs
    found = differing <= distance
    found[found] = np.bitwise_count(x[found]) <= distance
    return found


def forest(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints, by breadth-first search."""
    rest, wave = fps, []
    while len(rest) or wave:
        if not wave:
            wave, rest = [rest[:1]], rest[1:]
        at = wave.pop()
        for one in at:
            hit = linked(rest, one, distance)
            if hit.any():
                new = rest[hit]
                yield np.full(len(new), one), new
                wave.append(new)
                rest = rest[~hit]


def _links(distance: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = ["list", "bytes", "low", "high"]

        def edges(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
            new = np.concatenate([[True], (rows[group].to_numpy()[1:] != rows[group].to_numpy()[:-1]).any(axis=1)])
            number, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fps)))
            found = []
            small = sizes[number] <= SMALL
            kept, member = fps[small], number[small]
            for step in range(1, int(min(SMALL, sizes.max()))):
                same = np.flatnonzero(member[step:] == member[:-step])
                hit = same[linked(kept[same], kept[same + step], distance)]
                found.append((kept[hit], kept[hit + step]))
            for k in np.flatnonzero(sizes > SMALL):
                found.extend(forest(fps[starts[k] : starts[k] + sizes[k]], distance))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pd.DataFrame({"a": pairs[0], "b": pairs[1]})

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0  # the last list may go on
            held = rows.iloc[cut:]
            if cut:
                yield from edges(rows.iloc[:cut])
        if held is not None and len(held):
            yield from edges(held)

    return search


def fingerprint_links(nodes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that differ in at most ``distance`` bits.

    Not every link is listed, but what is linked is connected. A list longer than
    ``block`` is dealt out: each pair of its blocks is searched by itself.
    """
    postings = _postings(nodes, distance)
    lengths = postings.groupBy("list", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = postings.join(lengths, ["list", "bytes"]).withColumn("blocks", blocks).withColumn("own", own)
    dealt = met.select("list", "bytes", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "list", "bytes", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )
    group = ["list", "bytes", "low", "high"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(_links(distance), "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest key reachable) of every row.

    Null and empty texts have the fingerprint zero and are linked like any other. A
    null key is in its component but never names it, unless all its keys are null:
    then component_id is null. Repeated rows give equal rows. Whole texts are
    hashed. Other columns of ``docs`` play no part.
    """
    hashed = written_table(docs.select(F.col(key).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")))
    nodes = written_table(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), distance, block))
    rooted = written_table(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(names, "root").select("fp", "component_id")
    return hashed.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
