"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, contamination, jaccard, langid, lines, merkle, mixing, packing, pii, records, rules, sharding, toxicity
from .common import crc_of_id, fold, table
from .oracles import OP11_SQL, OP12_SQL, OP13_SQL


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.language_id(docs).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", "confident")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT host, no_host, count(*) AS host_pages FROM d GROUP BY ALL),
l AS (SELECT host, no_host, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT host, no_host, line, count(*) AS pages FROM l GROUP BY ALL),
b AS (SELECT host, no_host, list(line) AS gone FROM c JOIN n USING (host, no_host)
      WHERE pages >= {lines.MIN_PAGES} AND pages > CAST({lines.MAX_RATIO} AS DOUBLE) * host_pages GROUP BY ALL),
k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(gone, []), trim(x, ' '))) AS kept
      FROM d LEFT JOIN b USING (host, no_host))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text
FROM k
"""


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *rules.COUNTS, "base_failed", "anomaly", "kept")


def op11_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(merkle.FIELDS)
    # one more than the largest long still has a decimal form
    longer = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    found = merkle.manifest(docs, longer, crc_of_id() % 7 == 0, ("doc_id",))
    folded = F.when(F.size("copied") > 0, F.element_at("copied", -1)).otherwise(F.col("version_leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), folded.alias("folded_root"), "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_records": op2_token_records,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_context_mixing": op9_context_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_jump_sharding": op11_jump_sharding,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {"op8_line_dedup": OP8_SQL, "op11_jump_sharding": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_collocations": OP13_SQL}
