"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, packing. Each stage works on what the one
before kept, which lies in the shared folder as Parquet between stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join, language_id, packing, substring_dedup
from ledgerloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; the model learns from labelled documents of this stage's input."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id; documents without id stay.

    Where ids repeat, one row of an id stays (the smallest hash of its text); otherwise nothing has to be sorted for it.
    """
    groups = written(jaccard_join.join(docs), "pipeline-groups")
    lead = groups.where("doc_id = component_id").select("doc_id")
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct().join(lead.distinct(), "doc_id", "left_anti"), "pipeline-gone")
    kept = jaccard_join.without(docs.select(*COLUMNS), gone)
    if lead.count() != lead.distinct().count():
        one = kept.where("doc_id is not null").withColumn("h", F.xxhash64("text")).groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), "h").alias("row")).select("doc_id", "row.*")
        kept = one.unionByName(kept.where("doc_id is null"))
    return kept


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that earlier documents have; documents of which nothing is left go."""
    cut = substring_dedup.dedup(docs.select(*COLUMNS))
    kept = cut.where((F.size("removed") == 0) | (F.trim("kept_text") != ""))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]
ORACLE_SQL: str | None = None  # tokenizers, trained models and set joins at this size are beyond SQL; tests hold brute force against it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
