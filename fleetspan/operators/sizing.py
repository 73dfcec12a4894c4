"""Size checks, dimension joins, membership joins and shared intermediate tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and stays below both bounds.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
FALLBACK_SALTS = 16


@dataclass(frozen=True)
class Dimension:
    """A written dimension table with its measured size."""

    table: DataFrame
    n_rows: int
    n_bytes: int

    @property
    def fits_broadcast(self) -> bool:
        return self.n_rows <= BROADCAST_ROWS and self.n_bytes <= BROADCAST_BYTES


def settle(*tables: DataFrame) -> list[Dimension]:
    """Write dimensions once and measure what was written, all in one job.

    The joins that follow know their true size and do not compute them again.
    """
    written = [written_table(df) for df in tables]
    sizes = None
    for place, df in enumerate(written):
        width = F.lit(16 * len(df.columns))
        for name in df.columns:
            width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
        one = df.agg(
            F.lit(place).alias("place"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(width), F.lit(0)).alias("n_bytes")
        )
        sizes = one if sizes is None else sizes.unionAll(one)
    found = {r["place"]: r for r in sizes.collect()}  # one row per dimension
    return [Dimension(df, found[i]["n_rows"], found[i]["n_bytes"]) for i, df in enumerate(written)]


def _splits_skew(spark: SparkSession) -> bool:
    return (
        spark.conf.get("spark.sql.adaptive.enabled", "true") == "true"
        and spark.conf.get("spark.sql.adaptive.skewJoin.enabled", "true") == "true"
    )


def _match(pairs: list[tuple[str, str]], null_safe: bool) -> Column:
    out = None
    for left, right in pairs:
        same = F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right)
        out = same if out is None else out & same
    return out


def join_dimension(
    facts: DataFrame,
    dim: Dimension,
    on: list[tuple[str, str]],
    spread_by: str,
    null_safe: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """Left outer join of facts with a dimension; every match is kept.

    * A dimension measured below the bounds is broadcast, so the facts stay where they are.
    * A larger one is joined by shuffle, where adaptive execution splits a key that
      holds many facts.
    * Where the session has that switched off (or ``salts`` is given), the facts of
      a key are spread by a hash of ``spread_by`` over copies of the dimension row.
    """
    if salts is None and dim.fits_broadcast:
        return facts.join(F.broadcast(dim.table), _match(on, null_safe), "left")
    if salts is None and _splits_skew(facts.sparkSession):
        return facts.join(dim.table, _match(on, null_safe), "left")
    n = salts or FALLBACK_SALTS
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(n)).cast("int"))
    copies = dim.table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    same = _match(on, null_safe) & (F.col("_salt") == F.col("_copy"))
    return spread.join(copies, same, "left").drop("_salt", "_copy")


Keys = tuple[DataFrame, str]


def members_of(*tables: Keys) -> DataFrame:
    """Every key of the given tables once (``_member``), and in which of them it occurs: bit k of ``_in`` for table k.

    Merging them first means that a key repeated on this side is combined before
    the shuffle, that several tables cost one join, and that a hot key on the
    other side meets a single row and can be split by adaptive execution. Joins of
    one query that take the same members share the aggregate.
    """
    parts = None
    for k, (table, key) in enumerate(tables):
        part = table.select(F.col(key).alias("_member"), F.lit(1 << k).alias("_in"))
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("_member").agg(F.bit_or("_in").alias("_in"))


def _among(members: DataFrame, places: int) -> DataFrame:
    """The members that occur in one of the tables whose bits are set."""
    return members.where(F.col("_in").bitwiseAND(F.lit(places)) != 0).select("_member")


def without_members(df: DataFrame, key: str, members: DataFrame, places: int) -> DataFrame:
    """Rows whose key is no member of the tables whose bits are set in ``places``; null matches null."""
    return df.join(_among(members, places), F.col(key).eqNullSafe(F.col("_member")), "left_anti")


def absent_from(df: DataFrame, key: str, *others: Keys) -> DataFrame:
    """Rows whose key occurs in none of the other tables; null matches null."""
    return without_members(df, key, members_of(*others), (1 << len(others)) - 1)


def present_in(df: DataFrame, key: str, *others: Keys) -> DataFrame:
    """Rows whose key occurs in one of the other tables; null matches null."""
    members = _among(members_of(*others), (1 << len(others)) - 1)
    return df.join(members, F.col(key).eqNullSafe(F.col("_member")), "left_semi")


def mark_members(df: DataFrame, key: str, others: dict[str, Keys]) -> DataFrame:
    """Add a flag per other table: does the key occur there? Null matches null."""
    joined = df.join(members_of(*others.values()), F.col(key).eqNullSafe(F.col("_member")), "left")
    flags = {f: F.coalesce(F.col("_in").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False)) for k, f in enumerate(others)}
    return joined.withColumns(flags).drop("_member", "_in")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` as the session names it.

    A session without that setting gets a folder below its warehouse, which all
    executors resolve in the same way; no machine-local folder is ever used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


# Folders written by this process, by application, and how often they were released; see release_tables.
_WRITTEN: dict[str, list[str]] = {}
_RELEASED: dict[str, int] = {}


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """Name of a fresh folder in the shared folder, remembered for release_tables."""
    path = f"{shared_folder(spark)}/fleetspan-{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written_table(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage for results that several later steps read, survives the loss
    of executors, and gives Catalyst true sizes for the steps that follow. The
    table stays until ``release_tables``.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generation(spark: SparkSession) -> int:
    """How often this application's tables were released: what was written in an earlier generation is gone."""
    return _RELEASED.get(spark.sparkContext.applicationId, 0)


def release_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written; frames that read them end here."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _RELEASED[spark.sparkContext.applicationId] = generation(spark) + 1
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
