"""The corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination, source mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import Stash, one_row_per_id, other_name
from tagloom.llm.decontam import Q, find_leaks
from tagloom.llm.langid import UNKNOWN, fit, predict
from tagloom.llm.line_dedup import OUTPUTS, drop_repeated_lines
from tagloom.llm.mixing import mix_sources
from tagloom.llm.ngram_join import ngram_jaccard_groups

#: A document stays if its language leads the next one by this score; 0.5 is no lead at all, whatever the number of languages.
LEAST_SCORE = 0.505


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with columns that clash with ``names`` renamed, and each column by its old name."""
    new = {c: other_name(f"{c}_", [*docs.columns, *names]) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(new), {c: F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go.

    So null and empty texts go. Where no row has a language there is nothing to learn from and all
    documents with a letter stay. Repeated rows and rows without doc_id are judged each for itself; an
    empty table stays empty; columns named like the operator's are kept as they are.
    """
    model = fit(docs, F.lit(True))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    apart, column = _aside(docs, ("lang_pred", "score"))
    found = predict(apart, model, tuple(apart.columns))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*column.values())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, if need be with an empty text.

    Null texts become empty. Rows without doc_id stay whole and don't count; rows that repeat a doc_id
    count as one document and each stays. A tie can't be: the largest doc_id keeps a line. n_chars is
    counted anew; columns named like the operator's are kept as they are.
    """
    apart, column = _aside(docs, OUTPUTS)
    kept = drop_repeated_lines(apart, columns=tuple(c for c in apart.columns if c not in ("text", "n_chars")))
    new = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return kept.select(*(new.get(c, column[c]) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the least doc_id stays.

    Of rows that repeat a doc_id one stays, that with the greatest text. Rows without doc_id can't be
    told apart from others and all stay. Empty and null texts are like nothing and stay.
    """
    single = one_row_per_id(docs)
    first = ngram_jaccard_groups(single).where("component_id = doc_id").select("doc_id")
    return single.join(first, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go.

    Passages of fewer than Q letters and digits tell nothing, as many documents have such words, and
    don't count. Rows without doc_id stay; rows that repeat a doc_id go together; null texts stay.
    """
    telling = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= Q
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(telling)).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The appearances of documents in the mixture; null sources are a source, repeated rows appear each for itself."""
    return mix_sources(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: Language ID, the groups of near-duplicates and the alignment have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; each result but the last is a table in the shared folder."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
