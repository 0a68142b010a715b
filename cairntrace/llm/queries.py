"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.llm import (
    bilinear, chat, decision_list, merkle, packing, pii, repeats, rule_ensemble, runs, setjoin, subwords, topk, toxicity,
)
from cairntrace.llm.common import held_out, table, written
from cairntrace.llm.textstats import RATES, labelled_sample, text_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Bound of the labelled rows that the quality models are fitted on.
LABELLED = 20_000
#: Key of the pseudonyms; a deployment passes its own.
KEY = "cairntrace-pseudonyms"
#: Documents with a score from here on count as label 1.
THRESHOLD = 0.3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    made = chat.format_chats(rows.unionByName(extra)).select(
        "conv_id",
        "valid",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_learned(F.col("segments")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said_back = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_back, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", LABELLED)
    known = written(text_stats(labelled, keep=["y"]).select("doc_id", "y", *RATES), "labelled-stats")
    rules = decision_list.learn(known, RATES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return text_stats(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & rules.kept()).alias("kept"),
        rules.rule_number().alias("rule"),
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").where(~out)
    labelled = labelled_sample(docs, labels, "quality", LABELLED)
    known = written(text_stats(labelled, keep=["y"]).select("doc_id", "y", *RATES), "labelled-stats")
    model = rule_ensemble.fit(known, RATES)
    scored = text_stats(docs).select("doc_id", out.alias("held_out"), model.score().alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def count_of(kind: str) -> Column:
        return F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(kind) for kind in pii.KINDS]
    return pii.pseudonymise(docs, KEY).select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), *counts)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary())


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = subwords.encode(table(spark, sf_dir, "documents"), piece_model(), dropout=0.1, seed=17)
    back = subwords.decode(made, piece_model(), keep=("doc_id", "text", "ids"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, factor=1024, every=100)


def toxicity_scorer(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Scorer:
    """Learned from labels of the rows that aren't held out, and the characters of all of `docs`."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    return toxicity.train(docs, labelled_sample(docs, labels, "toxic", LABELLED))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_scorer(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeats.mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return marked.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        cut.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bilinear.score(docs, bilinear.train(docs.where(~held_out(F.col("doc_id"), 7, 2))))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), extend=True).drop("runs")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
