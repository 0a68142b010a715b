"""The corpus pipeline: documents without toxic ones, near copies and repeated passages, pseudonymised and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.llm import packing, pii, repeats, setjoin, toxicity
from cairntrace.llm.common import free_name, table, written
from cairntrace.llm.queries import KEY, THRESHOLD, toxicity_scorer, word_vocabulary


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of `docs`, `n_chars` being that of the changed text."""
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; null texts have nothing toxic, repeated rows go or stay together."""
    scorer = toxicity_scorer(spark, sf_dir, docs)
    score = free_name(docs, "__score")
    return toxicity.score(docs, scorer, score_col=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; equal rows once.  Null and empty texts
    are like no other one; a null id is smaller than all others."""
    k, t, h = (free_name(docs, n) for n in ("__k", "__t", "__h"))
    keep = setjoin.representatives(docs).select(F.col("doc_id").alias(k), F.col("th").alias(t))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col(k)) & (F.col(h) == F.col(t)), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document or place holds; null texts stay null."""
    removed, kept, left = (free_name(docs, n) for n in ("__removed", "__kept", "__text"))
    marked = repeats.mark_repeats(docs, removed_col=removed, kept_col=kept, kept_text_col=left)
    text = F.when(F.col("text").isNotNull(), F.col(left))
    return _with_text(docs, marked.withColumn("text", text))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal numbers, dates and addresses; null texts stay null."""
    return _with_text(docs, pii.pseudonymise(docs, KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences; a null text is an empty one."""
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", cut_repeats),
    ("pseudonyms", hide_persons),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
