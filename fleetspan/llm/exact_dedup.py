"""Exact duplicates with a heavy-hitter split; DataFrame and SQL functions only.

Frequent digests are found by a Misra-Gries style sketch (the frequent-items
sketch behind ``approx_top_k``), counted exactly, and the verified ones are
broadcast: their rows are settled where they lie. All other digests go through an
ordinary shuffle of narrow rows: they are summed up, copies in one task first, and
joined back, where adaptive execution can split what is still uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.sizing import written_table

# Counters of the sketch. A digest that holds more than about 1 / TRACKED of all rows cannot be missed.
TRACKED = 1024
# Sketches are merged in two steps, so that no task reads those of all tasks.
MERGE_GROUPS = 64
# A verified digest is broadcast when it holds at least this share of the rows: at most 1 / share rows.
HEAVY_SHARE = 1 / 256

WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text: str) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " "), 256)


def frequent_digests(rows: DataFrame, digest: str, tracked: int = TRACKED) -> DataFrame:
    """Candidates for frequent digests, at most ``tracked / 2`` of them, by a two-step merge of sketches."""
    small = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate({digest}, {tracked})").alias("sketch")
    )
    # Grouped by a constant: an empty table has no sketch to merge.
    merged = small.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked // 2})")).alias("top"))
    return found.select(F.col("top.item").alias(digest))


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"), text_digest(text).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
    )


def _settled(rows: DataFrame, tracked: int, heavy_share: float) -> DataFrame:
    """Rows (doc_id, text_sha256, row) of a written table with the row that stays and the size of the group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row")))
    least = max(2, int(rows.count() * heavy_share))
    candidates = frequent_digests(rows, "text_sha256", tracked)
    # Not more rows than candidates: below a few hundred.
    winners = written_table(
        rows.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(first.alias("stays"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rare = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = rare.groupBy("text_sha256").agg(first.alias("stays"), F.count(F.lit(1)).alias("group_size"))
    return heavy.unionByName(rare.join(groups, "text_sha256"))


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED, heavy_share: float = HEAVY_SHARE
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is made one
    space; null is the empty text. The row with the smallest key stays, a null key
    comes last; of repeated rows with the same key exactly one stays. An empty
    table gives an empty result; other columns of ``docs`` play no part.
    """
    return _settled(written_table(_digests(docs, key, text)), tracked, heavy_share).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256",
    )
