"""Pipelines end to end on small written inputs."""

import random

import pytest
from pyspark.sql import functions as F

from cairntrace.operators import learning, accuracy, coerce, features, generate
from cairntrace.operators.compare import GateThresholds
from cairntrace.plans import pipelines
from cairntrace.session import settle


@pytest.fixture(scope="module")
def swf_file(tmp_path_factory):
    rng = random.Random(7)
    rows, ts = ["; header"], 0
    for i in range(1, 401):
        ts += rng.randint(1, 30)
        run = rng.randint(10, 3000)
        user = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        rows.append(f"{i} {ts} {rng.randint(0, 400)} {run} {rng.choice([1, 4, 16])} -1 -1 -1 {run * 2} -1 1 {user} 1 -1 1 1 -1 -1")
    path = tmp_path_factory.mktemp("raw") / "trace.swf"
    path.write_text("\n".join(rows))
    return str(path)


@pytest.fixture(scope="module")
def ingested(spark, swf_file, tmp_path_factory):
    return pipelines.run_ingest(spark, "swf", swf_file, str(tmp_path_factory.mktemp("out")), "t1")


def test_ingest(ingested, swf_file):
    report = ingested["quality"].first()
    assert (report.row_count, report.comment_lines, report.requested_mem_null_rate) == (400, 1, 1.0)
    meta = ingested["metadata"].first()
    assert meta.filename == "trace.swf" and len(meta.sha256) == 64
    assert ingested["jobs"].first().dataset_id == "t1"


def test_ingest_rejects_unknown_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported source"):
        pipelines.run_ingest(spark, "lsf", "x", str(tmp_path), "t")


def test_features(ingested, tmp_path):
    out = pipelines.run_features(ingested["jobs"], str(tmp_path), "t1")
    assert out["features"].count() == 400 and len(out["features"].columns) == 25
    assert out["splits"].filter("segment = 'train'").count() == 3
    rates = {r.column: r.null_rate for r in out["report"].collect()}
    assert rates["requested_mem"] == 1.0 and rates["user_runtime_median_lookback"] == 0.0


def schedule(jobs, wait):
    return jobs.withColumn("wait_sec", F.expr(wait)).withColumns(
        {"start_ts": F.expr("submit_ts + wait_sec"), "end_ts": F.expr("submit_ts + wait_sec + runtime_actual_sec")}
    )


def test_suite_over_two_traces(spark, ingested):
    jobs = ingested["jobs"].withColumn("dataset_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    slow = F.when(F.col("dataset_id") == "b", F.expr("wait_sec * 5")).otherwise(F.col("wait_sec"))
    plans = jobs.withColumn("policy_id", F.lit("fifo")).unionByName(
        schedule(jobs, "wait_sec * 9 DIV 10").withColumn("policy_id", F.lit("quick"))
    )
    shifted = schedule(plans.withColumn("wait_sec", slow), "wait_sec")
    # Shrinking every wait empties the top bins, which the KL limit alone would reject.
    out = pipelines.run_suite(jobs, shifted, 64, "fifo", limits=GateThresholds(wait_kl=10.0))
    status = {r.dataset_id: r for r in out["traces"].collect()}
    assert status["a"].status == "pass" and status["a"].selected_policy_id == "quick"
    assert status["b"].status == "fail" and status["b"].recommendation_status == "blocked"
    assert "fidelity_failed" in status["b"].failure_modes
    assert out["suite"].first().suite_status == "partial"


def test_stress_compare(spark, tmp_path):
    trace = pipelines.run_stress(spark, "burst_shock", 300, str(tmp_path))
    out = pipelines.run_stress_compare(trace, schedule(trace, "wait_sec * 2"), 64)
    assert out["status"].first().status == "pass"
    changes = {r.metric: r.ratio for r in out["degrade"].collect()}
    assert changes["mean_wait_sec"] == pytest.approx(1.0) and "starved_rate" not in changes


def test_bench_gate(spark, tmp_path):
    steps = {"count": (1000, lambda: spark.range(1000).groupBy().count())}
    history = str(tmp_path / "history")
    first = pipelines.run_bench(spark, steps, history, "p", samples=2).first()
    assert first.status == "pass" and first.prior_window_records == 0 and first.samples == 2
    again = pipelines.run_bench(spark, steps, history, "p", samples=1, workload="heavy_tail").first()
    assert again.prior_window_records == 1 and again.baseline_median > 0


def test_runtime_model_beats_the_global_mean(spark, tmp_path):
    """Run time follows the request, which the model sees and the naive predictors do not."""
    jobs = generate.gen_trace(spark, 600)
    table = settle(features.feature_table(jobs, causal=True))
    rows = settle(features.time_split(coerce.training_frame(table)))
    train, valid, test = (rows.filter(F.col("segment") == s) for s in ("train", "valid", "test"))
    model = learning.fit_runtime(train, valid, {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3})
    scored = settle(model.score(test))
    assert scored.filter("p10 < 1 OR p50 < p10 OR p90 < p50").count() == 0
    gains = {r.baseline: r.mae_improvement for r in accuracy.evaluate_quantiles(scored, train).collect()}
    assert gains["global_mean"] > 0 and gains["global_median"] > 0
    assert 0.4 < accuracy.quantile_losses(scored, "runtime_actual_sec").first().interval_coverage_p10_p90 <= 1.0
