"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.annulus import cluster_vectors, clusters_sql
from tagloom.llm.common import Stash
from tagloom.llm.decontam import find_leaks
from tagloom.llm.html_main import extract_main_text
from tagloom.llm.langid import identify_languages
from tagloom.llm.line_dedup import drop_repeated_lines
from tagloom.llm.lm_katz import katz_scores
from tagloom.llm.mixing import MIX_SQL, mix_sources
from tagloom.llm.ngram_join import ngram_jaccard_groups
from tagloom.llm.quality_cotrain import score_quality
from tagloom.llm.quality_rules import judge_quality
from tagloom.llm.ranked_search import SEARCH_SQL, search_documents
from tagloom.llm.token_files import read_token_ids, write_token_ids
from tagloom.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """The remainder that says whether a document is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(_table(spark, sf_dir, "documents"), size=5, percent=80).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), fold(7) == 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(3) != 1)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(5) != 1)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "p_text", "p_metadata", "score", "kept")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_table(spark, sf_dir, "documents"), fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2:")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stash(spark).root}/ids"
    write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_ids(spark, path, ("doc_id", "start", "n_tokens", "ids_crc32"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_toxicity, op4_benchmark_decontamination, op5_line_dedup, op6_quality_classifier, op7_source_mixing, op8_quality_rules, op9_html_extraction, op10_language_id, op11_centroid_clustering, op12_token_files, op13_ranked_search)
    }


#: Line deduplication in DuckDB.
LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, g.k IS NOT NULL AND l.doc_id <> g.keeper AS gone FROM l LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP_SQL, "op7_source_mixing": MIX_SQL, "op11_centroid_clustering": clusters_sql(), "op13_ranked_search": SEARCH_SQL}
