"""A corpus pipeline over `documents`: language, near-duplicates, benchmark leaks,
personal data, packing. Each stage gets what the one before it kept; all but the last
return the columns of documents.

1 language: documents that language ID rejects go; lang stays as it was given.
2 near_duplicates: rows are compared, whether ids repeat or are null; of each class the row with the smallest
  id stays, of equal ids the first by text, one without an id only where no row of the class has one.
3 decontamination: rows that contain a text of the benchmark go, whatever the ids of either.
4 pii: personal data is replaced, n_chars follows.
5 packing: the pieces of sequences of 2048 tokens.

Defined results: language rejects null, empty and letterless texts, so the later stages get such rows only where they are
called on their own: there a null text is no copy of another, empty texts are copies of each other, both hold no leak and no personal data, and pack as
an end id; texts of any length are whole; rows that repeat are copies; ties are broken as said above; an empty
table gives no rows; other columns pass through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, op5_decontamination, op6_pii_surrogates, op7_packing, op9_language_id, op10_near_dedup

#: Row numbers that are broadcast, 8 bytes each; beyond it rows are joined by key.
KEYS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = op9_language_id.language_profiles(docs)
    results = tuple(common.free_name(r, docs) for r in op9_language_id.RESULTS)
    found = op9_language_id.identified(docs, profiles, docs.columns, results=results)
    return found.filter(~F.col(results[2])).drop(*results)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, stored, so that it stays; and the number's name."""
    key = common.free_name("key", docs)
    return common.stored(docs.withColumn(key, F.monotonically_increasing_id()), "zstd"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    own = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), "text")
    classes = op10_near_dedup.classes(own.select(F.col("key").alias("doc_id"), "text")).toDF("key", "class_id")
    of = common.stored(own.select("key", "id").join(classes, "key"))
    low = common.stored(of.groupBy("class_id").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1").select("class_id", "low"))
    several = common.stored(of.join(low, "class_id"))
    first = common.stored(several.filter("id <=> low").select("key", "class_id"))
    alone = first.groupBy("class_id").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    # texts are read only where rows of the smallest id are several
    tied = common.stored(first.join(alone.filter("n > 1").select("class_id"), "class_id"))
    by_text = common.small(tied, KEYS).join(own.select("key", "text"), "key").groupBy("class_id").agg(F.min(F.struct("text", "key")).alias("x")).select("x.key")
    stays = alone.filter("n = 1").select("key").unionAll(by_text)
    gone = common.stored(several.select("key").join(stays, "key", "left_anti"))
    return rows.join(common.small(gone, KEYS), rows[key] == gone["key"], "left_anti").drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows, key = keyed(docs)
    leaks = common.stored(op5_decontamination.leaks(rows.select(F.col(key).alias("doc"), "text"), items))
    return rows.join(common.small(leaks, KEYS), rows[key] == leaks["doc"], "left_anti").drop(key)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = common.free_name("n_entities", docs)
    return op6_pii_surrogates.redacted(docs, count=count).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).drop(count)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express rank-order profiles, ProbMinHash classes, surrogates or bin packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again; what a stage has stored goes when it is written."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            made = common.stored(stage(spark, docs, sf_dir))
            keep.append(made)
        if hasattr(docs, "_drop"):
            common.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
