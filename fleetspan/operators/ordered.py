"""Running sums, neighbours and exact percentiles over large ordered sets.

A window over a whole ordered set would put all of it into one task. Here the
set is cut into ranges of about equal size. Each range is scanned by its own
task, and only one row per range is combined, so the result is the exact one.

``by`` names the column of independent sets (a class, a feature); it must have
few values. The value in ``order`` must be unique within a set, which callers
get by aggregating on it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import written_table



def with_ranges(df: DataFrame, by: str, order: str, parts: int | None = None) -> DataFrame:
    """Deal the rows out in the order of set and value, and add ``_range``: the partition a row came to; written once.

    The ranges are those of the exchange, as many as the session or ``parts`` asks
    for, so they grow with the data. Any ranges give the same results. Equal values
    of a set are never parted.
    """
    dealt = df.repartitionByRange(by, order) if parts is None else df.repartitionByRange(parts, by, order)
    return written_table(dealt.withColumn("_range", F.spark_partition_id()))


def running_sums(df: DataFrame, by: str, order: str, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Add inclusive running sums (``name -> column``) and set totals (``name_total``)."""
    ranged = with_ranges(df, by, order, parts)
    before = Window.partitionBy("_set").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_set")
    offsets = (
        ranged.groupBy(F.col(by).alias("_set"), F.col("_range").alias("_part"))
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
        .select(
            "_set",
            "_part",
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
            *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums],
        )
    )
    inside = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(by).eqNullSafe(F.col("_set")) & (F.col("_range") == F.col("_part"))
    # Bounded: a row per range and set, of which only neighbours share a range.
    joined = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(offsets), same)
    return joined.withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in sums}).drop(
        "_set", "_part", "_range", *[f"_off_{n}" for n in sums]
    )


def with_neighbours(df: DataFrame, by: str, order: str, value: Column, parts: int | None = None) -> DataFrame:
    """Add ``previous`` and ``next``: the nearest non-null value before and after each row."""
    ranged = with_ranges(df.withColumn("_value", value), by, order, parts)
    back = Window.partitionBy("_set").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_set").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("_value").isNotNull(), F.col(order))
    edges = (
        ranged.groupBy(F.col(by).alias("_set"), F.col("_range").alias("_part"))
        .agg(F.max_by("_value", known).alias("_last"), F.min_by("_value", known).alias("_first"))
        .select(
            "_set",
            "_part",
            F.last("_last", ignorenulls=True).over(back).alias("_carry_back"),
            F.first("_first", ignorenulls=True).over(ahead).alias("_carry_ahead"),
        )
    )
    inside = Window.partitionBy(by, "_range").orderBy(order)
    to_here = inside.rowsBetween(Window.unboundedPreceding, -1)
    from_here = inside.rowsBetween(1, Window.unboundedFollowing)
    same = F.col(by).eqNullSafe(F.col("_set")) & (F.col("_range") == F.col("_part"))
    joined = ranged.withColumns(
        {
            "_near_back": F.last("_value", ignorenulls=True).over(to_here),
            "_near_ahead": F.first("_value", ignorenulls=True).over(from_here),
        }
    ).join(F.broadcast(edges), same)
    return joined.withColumns(
        {
            "previous": F.coalesce("_near_back", "_carry_back"),
            "next": F.coalesce("_near_ahead", "_carry_ahead"),
        }
    ).drop(
        "_set", "_part", "_range", "_value", "_near_back", "_near_ahead", "_carry_back", "_carry_ahead"
    )


def exact_percentiles(
    df: DataFrame, value: str, probs: list[float], by: str | None = None, parts: int | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, as the array ``quantiles`` per set.

    Equal values are merged first. A set without values has no row.
    """
    if by is None:
        df, key = df.withColumn("_one", F.lit(1)), "_one"
    else:
        key = by
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, key, value, {"_upto": "_n"}, parts)
    # A row covers the ranks [_upto - _n, _upto).
    picked = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_upto_total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picked.append(F.max(F.when(covers, F.col(value))).alias(f"{side}{i}"))
        picked.append(F.max(place - F.floor(place)).alias(f"part{i}"))
    found = ranked.groupBy(key).agg(*picked)
    lerp = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}") for i in range(len(probs))]
    quantiles = F.array(*[c.cast("double") for c in lerp]).alias("quantiles")
    return found.select(quantiles) if by is None else found.select(by, quantiles)
