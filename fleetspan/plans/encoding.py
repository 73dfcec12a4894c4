"""Dictionary encoding: fill, one-hot and assemble, with the dictionary as a distributed table.

The distinct values of all text columns are counted once. The counts give the most
frequent value of each column, and, numbered by running sums in the order of column
and value, the slot of every value. Rows meet the dictionary by measured joins, a
column at a time, and become sparse vectors as wide as the dictionary. Neither the
driver nor a task ever holds a dictionary; 60 values and 60 million take the same path.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.ordered import exact_percentiles, running_sums
from ..operators.sizing import BROADCAST_BYTES, BROADCAST_ROWS, Dimension, join_dimension, new_folder, written_table


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of every value that occurs; one exchange for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    counted = rows.select(F.inline(pairs)).where(F.col("value").isNotNull())
    return counted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counted: DataFrame) -> DataFrame:
    """The most frequent value per column, the lowest on ties; a column without values has no row."""
    return counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("text_value"))


def medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The exact median per column; a column without values has no row."""
    numbers = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    found = exact_percentiles(rows.select(F.inline(numbers)), "value", [0.5], by="column")
    return found.select("column", F.element_at("quantiles", 1).alias("number_value"))


@dataclass
class Encoder:
    """Fill values in slot order, and the dictionary (``column``, ``value``, ``slot``) with rows and bytes per column."""

    numbers: dict[str, float]
    texts: dict[str, str]
    dictionary: DataFrame
    sizes: dict[str, tuple[int, int]]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(n for n, _ in self.sizes.values())

    def _side(self, column: str, small: bool) -> Dimension:
        """The part of one column; the sides that are broadcast are below the bounds all together."""
        part = self.dictionary.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("slot").alias(f"_slot_{column}"))
        n, size = self.sizes[column]
        return Dimension(part, n, size) if small else Dimension(part, BROADCAST_ROWS + 1, BROADCAST_BYTES + 1)

    def sparse(self, rows: DataFrame, spread_by: str) -> DataFrame:
        """Add ``_sparse``: size, slots and values of each row; a value the dictionary lacks has no slot."""
        ranked = sorted(self.texts, key=lambda c: self.sizes[c])
        fits = {}
        for c, n, size in zip(ranked, accumulate(self.sizes[c][0] for c in ranked), accumulate(self.sizes[c][1] for c in ranked)):
            fits[c] = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
        columns = rows.columns
        out = rows.withColumns({f"_in_{c}": F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in self.texts.items()})
        # The joins that move rows come last, when short slots stand for the other texts.
        for c in sorted(self.texts, key=lambda c: not fits[c]):
            out = join_dimension(out, self._side(c, fits[c]), [(f"_in_{c}", "_value")], spread_by).drop("_value", f"_in_{c}")

        def entry(slot: Column, value: Column) -> Column:
            return F.struct(slot.cast("int").alias("i"), value.cast("double").alias("v"))

        # In the order of the slots, as a sparse vector asks for.
        entries = [entry(F.lit(k), F.coalesce(F.col(f"`{c}`"), F.lit(v))) for k, (c, v) in enumerate(self.numbers.items())]
        entries += [entry(F.col(f"_slot_{c}"), F.lit(1.0)) for c in self.texts]
        used = F.filter(F.array(*entries), lambda e: e["i"].isNotNull() & (e["v"] != 0))
        out = out.withColumn("_used", used) if entries else out.withColumn("_used", F.array().cast("array<struct<i:int,v:double>>"))
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(self.width).alias("size"),
            F.col("_used.i").alias("indices"), F.col("_used.v").alias("values"),
        )
        return out.select(*[f"`{c}`" for c in columns], vector.alias("_sparse"))

    def transform(self, rows: DataFrame, spread_by: str) -> DataFrame:
        """Add the vector ``features``; written once, because a vector is read from a file as what it is."""
        spark = rows.sparkSession
        encoded = self.sparse(rows, spread_by).withColumnRenamed("_sparse", "features")
        path = new_folder(spark, "features")
        encoded.write.parquet(path)
        fields = [f for f in encoded.schema.fields if f.name != "features"]
        return spark.read.schema(StructType([*fields, StructField("features", VectorUDT())])).parquet(path)

    def restricted(self, rows: DataFrame) -> Encoder:
        """The encoder without the values that no row holds, once filled; the others keep their order and close up.

        In these rows the slots left out are zero throughout, so nothing fitted on them can depend on such a slot.
        """
        if not self.texts:
            return self
        filled = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(v)).alias(c) for c, v in self.texts.items()])
        held = value_counts(filled, list(self.texts)).select("column", "value")
        kept = written_table(self.dictionary.select("column", "value").join(held, ["column", "value"], "left_semi"))
        return _numbered(kept, self.numbers, self.texts)

    def save(self, path: str) -> None:
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        spark = self.dictionary.sparkSession
        rows = [(k, "number", c, None, float(v), 0, 0) for k, (c, v) in enumerate(self.numbers.items())]
        rows += [(k, "text", c, v, None, *self.sizes[c]) for k, (c, v) in enumerate(self.texts.items())]
        schema = "place int, kind string, column string, text_value string, number_value double, n_values bigint, n_bytes bigint"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_encoder(spark: SparkSession, path: str) -> Encoder:
    rows = sorted(spark.read.parquet(f"{path}/columns").collect(), key=lambda r: r["place"])  # one row per column
    texts = [r for r in rows if r["kind"] == "text"]
    return Encoder(
        {r["column"]: r["number_value"] for r in rows if r["kind"] == "number"}, {r["column"]: r["text_value"] for r in texts},
        spark.read.parquet(f"{path}/dictionary"), {r["column"]: (r["n_values"], r["n_bytes"]) for r in texts},
    )


def fit_encoder(train: DataFrame, texts: list[str], numbers: list[str]) -> Encoder:
    """Fill values and dictionary of the training rows. Numbers have the first slots; columns without values are left out."""
    found = {r["column"]: r["number_value"] for r in medians(train, numbers).collect()} if numbers else {}  # one row per column
    filled = {c: found[c] for c in numbers if c in found}
    if not texts:
        return Encoder(filled, {}, train.sparkSession.createDataFrame([], "column string, value string, slot bigint"), {})
    counted = written_table(value_counts(train, texts))
    # One row per column. The value that fills a gap occurs, so the dictionary needs no other.
    modes = {r["column"]: r["text_value"] for r in most_frequent(counted).collect()}
    return _numbered(counted, filled, {c: modes[c] for c in texts if c in modes})


def _numbered(counted: DataFrame, numbers: dict[str, float], texts: dict[str, str]) -> Encoder:
    """The encoder of a written table of columns and values: slots by running sums, columns in the order of ``texts``."""
    size = F.sum(F.octet_length("value") + 16)
    measured = {r["column"]: (r["n"], r["size"]) for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("n"), size.alias("size")).collect()}
    kept = [c for c in texts if c in measured]
    first = dict(zip(kept, accumulate((measured[c][0] for c in kept), initial=len(numbers))))
    placed = running_sums(counted.select("column", "value", F.lit(1).cast("bigint").alias("one")), "column", "value", {"place": "one"})
    start = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else F.create_map().cast("map<string,int>")
    slots = placed.select("column", "value", (start[F.col("column")] + F.col("place") - 1).cast("bigint").alias("slot"))
    return Encoder(numbers, {c: texts[c] for c in kept}, written_table(slots), {c: measured[c] for c in kept})
