"""Queries of the corpus operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrajobs.llm import chat_format, conversation_repair, decontaminate, language_id, line_dedup, near_dedup, ngram_join, packing, periodic, quality_model, quality_rules, secret_scan, substring_dedup
from terrajobs.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.format_conversations(turns).drop("formatted", "loss_spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def _components_sql(n: int, percent: int, kept: str) -> str:
    """Components of the documents whose sets of n-word shingles meet the threshold."""
    gram = " || chr(1) || ".join(["w"] + [f"lead(w, {k}) OVER s" for k in range(1, n)])
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
grams AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {gram} AS g FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, string_agg(w, chr(1) ORDER BY i) FROM words WHERE n < {n} GROUP BY doc_id),
sized AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
reach AS (SELECT a AS doc_id, a AS label FROM links UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.doc_id),
least AS (SELECT doc_id, min(label) AS label FROM reach GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM (SELECT doc_id, md5(string_agg(g, chr(2) ORDER BY g)) AS h FROM grams GROUP BY doc_id))
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.label, d.doc_id) AS component_id{kept}, c.class_id
FROM documents d LEFT JOIN sized s USING (doc_id) LEFT JOIN least l USING (doc_id) LEFT JOIN classes c USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_dedup, op2_secret_scan, op3_language_id, op4_line_dedup, op5_quality_rules, op6_quality_model, op7_decontaminate, op8_packing, op9_chat_format, op10_substring_dedup, op11_ngram_join, op12_conversation_repair, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    kept = ", coalesce(l.label, d.doc_id) = d.doc_id AS kept"
    return {"op1_near_dedup": _components_sql(4, 80, kept), "op11_ngram_join": _components_sql(3, 90, ""), "op4_line_dedup": line_dedup.ORACLE, "op9_chat_format": chat_format.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE}
