"""A training corpus from ``documents``: five stages, each one of the corpus operators over all that the stage before kept.

Stages return the columns of their input, whatever further ones there are, and take
empty tables, null keys and texts, and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm.decontaminate import without_benchmark
from fleetspan.llm.language import UNKNOWN, fitted, language_column
from fleetspan.llm.mixing import mixed_sample
from fleetspan.llm.queries import END_ID, ENCODER, MIX
from fleetspan.llm.simhash import simhash_components
from fleetspan.llm.token_shards import encoded_documents
from fleetspan.operators.sizing import written_table

MIN_LANGUAGE_SCORE = 0.35  # of the most probable language; below it a text is of no language the model knows
SHINGLE_WORDS, MAX_BITS = 4, 4


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) or without a probable language go; equal texts fare alike.

    Where no row is labelled there is no language to know, and all go.
    """
    languages, model = fitted(docs)
    found = free_name(docs, "language")
    marked = docs.withColumn(found, language_column(languages, model, "text"))
    known = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)
    return marked.where(known).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest key stays, once; a row without a key cannot be told apart and stays.

    Unlike texts under one key are different documents, in the order of a hash of the
    text. Of a row given several times with other columns that differ, the first in
    the order of those columns stays. Null and empty texts are a group.
    """
    key, digest = free_name(docs, "key"), free_name(docs, "digest")
    names = {key: F.col("doc_id"), digest: F.xxhash64(F.coalesce("text", F.lit("")))}
    named = docs.withColumns(names)
    name = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.col(digest).alias("digest")))
    found = simhash_components(named.select(name.alias("name"), "text"), SHINGLE_WORDS, MAX_BITS, key="name").where("doc_id is not null")
    decided = found.groupBy("doc_id.key", "doc_id.digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("component_id") == F.col("doc_id")).alias("stays")
    )
    decided = written_table(decided.select(F.col("key").alias(key), F.col("digest").alias(digest), "n", "stays").where("n > 1 or not stays"))
    on = [key, digest]
    once = named.join(decided.select(*on), on, "left_anti").select(*docs.columns)
    again = named.join(decided.where("stays").select(*on), on, "left_semi")
    place, row = free_name(docs, "place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    again = again.withColumn(place, F.row_number().over(Window.partitionBy(*on).orderBy(row))).where(F.col(place) == 1)
    return once.unionAll(again.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the wanted shares of sources, languages and topics; repeated rows of a key stay or go together."""
    return mixed_sample(docs, MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and where each document lies in them: a row per row, null and empty texts hold the end id."""
    return encoded_documents(docs, public_tokenizers.path(ENCODER), END_ID)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", token_stage),
]

# Trained networks, searches and tokenizers are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir))
    return docs
