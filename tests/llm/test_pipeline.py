"""The registered queries against SQL, and the pipeline's stages on small documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairntrace.llm.oracles import ORACLES
from cairntrace.llm.queries import QUERIES
from checks.compare import compare_one, duck

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    status, rows, detail = compare_one(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert status == "ok" and rows > 0, detail


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    words = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(200)]
    passage = " ".join(words[:60])
    extra = [
        (10**6, " ".join(words[60:160])), (10**6 + 1, " ".join(words[60:160])), (10**6 + 2, " ".join(words[60:159] + ["new"])),
        (10**6 + 3, "Start " + passage + " end one."), (10**6 + 4, " ".join(words[160:]) + " " + passage + " end two 4111111111111111."),
        (10**6 + 5, None), (None, "no id"),
    ]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema)
    docs = docs.unionByName(more)
    at = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_passages", "pseudonyms", "packing"]
    kept = stages["toxicity"](spark, at, SF)
    assert kept.columns == docs.columns
    # too few labels there to learn from
    larger, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    left = stages["toxicity"](spark, larger, LARGER)
    toxic, clean = (labels.where(f"toxic = {y}") for y in (1, 0))
    assert left.join(toxic, "doc_id").count() <= 0.6 * toxic.count()
    assert left.join(clean, "doc_id").count() >= 0.98 * clean.count()
    one = stages["near_duplicates"](spark, kept, SF)
    ids = {r["doc_id"] for r in one.collect()}
    assert 10**6 in ids and not ids & {10**6 + 1, 10**6 + 2} and {10**6 + 3, 10**6 + 4, 10**6 + 5, None} <= ids
    cut = stages["repeated_passages"](spark, one, SF)
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert set(texts) == ids and cut.columns == docs.columns
    assert passage in texts[10**6 + 3]["text"] and words[30] not in texts[10**6 + 4]["text"]
    assert texts[10**6 + 5]["text"] is None and texts[10**6 + 4]["n_chars"] == len(texts[10**6 + 4]["text"])
    hidden = stages["pseudonyms"](spark, cut, SF)
    assert "4111111111111111" not in next(r["text"] for r in hidden.collect() if r["doc_id"] == 10**6 + 4)
    pieces = stages["packing"](spark, hidden, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


def test_stages_leave_columns_of_any_name_alone(spark):
    """Names that the stages use for themselves, on rows with nulls, and on no rows."""
    names = ["__score", "__h", "__k", "__t", "__text", "__removed", "__kept", "__m", "pii", "th", "id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (7 * 10**6, "", None, "s", 0)], docs.schema))
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    for stage_docs in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, stage_docs, SF)
            assert out.columns == docs.columns, name
            for r in out.collect():
                own = "-" if r["doc_id"] is None else str(r["doc_id"])
                assert all(r[n] == n + own for n in names), name
        assert (corpus_pipeline.STAGES[-1][1](spark, stage_docs, SF).count() > 0) == (stage_docs is docs)
