"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrajobs.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from terrajobs.llm.common import table, without_ids
from terrajobs.llm.queries import tokenizer_path
from terrajobs.storage import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows not held out; documents whose language cannot be told go."""
    net = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, net, carry=("text", "lang", "source", "n_chars")).filter(F.col("lang_pred") != language_id.UNKNOWN).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; documents left without a line go."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    return out.filter("n_lines = 0 or n_removed < n_lines").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    dropped = stash(near_dedup.near_duplicates(docs).filter("not kept").select("doc_id"), "dropped")
    return without_ids(docs.select(COLUMNS), "doc_id", dropped, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
