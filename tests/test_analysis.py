"""Hand examples, identities and bounds of the analysis operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairntrace.operators import accuracy, coerce, compare, decide, features, generate, learning, metrics, placement, queues
from cairntrace.operators.sliding import sliding_counts

JOB = "job_id bigint, submit_ts bigint, start_ts bigint, end_ts bigint, requested_cpus int, user_id bigint"


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(i, i * 10, i * 10 + (i * 37) % 90, i * 10 + (i * 37) % 90 + 30 + (i * 53) % 400, 1 + i % 4, i % 5) for i in range(60)]
    return spark.createDataFrame(rows, JOB)


def test_objective_hand_example(spark):
    df = spark.createDataFrame([(1, 0, 0, 100, 2, 1), (2, 0, 60, 160, 2, 2)], JOB)
    m = metrics.objective_metrics(df, 4, cap_sec=50).first()
    assert (m.job_count, m.mean_wait_sec, m.makespan_sec, m.starved_rate) == (2, 30.0, 160.0, 0.5)
    assert m.utilization_cpu == pytest.approx(400 / 640) and m.jain == 1.0 and m.fairness_dev == 0.0
    assert m.p95_bsld == pytest.approx(1.0 + 0.95 * 0.6)


def test_metrics_of_nothing(spark):
    m = metrics.objective_metrics(spark.createDataFrame([], JOB), 4).first()
    assert (m.job_count, m.p95_bsld, m.utilization_cpu, m.starved_rate, m.jain, m.active_users) == (0, 0, 0, 0, 1, 0)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="end_ts"):
        metrics.job_metrics(spark.createDataFrame([(1, 2)], "submit_ts bigint, start_ts bigint"), 4)


def test_bounds(jobs):
    m = metrics.objective_metrics(jobs, 3, by=["user_id"]).collect()
    assert all(0 <= r.utilization_cpu <= 1 and 0 < r.jain <= 1 and 0 <= r.fairness_dev < 1 and r.p95_bsld >= 0 for r in m)


def test_distance_to_itself(jobs):
    assert compare.wait_kl(jobs, jobs).first()[0] == pytest.approx(0.0, abs=1e-12)
    assert compare.slowdown_ks(jobs, jobs).first()[0] == 0.0
    assert compare.queue_corr(jobs, jobs, 10).first()[0] == pytest.approx(1.0)


def test_gate_skips_distribution_tests_on_small_samples(jobs):
    few = jobs.filter("job_id < 20")
    slow = few.withColumns({"start_ts": F.col("start_ts") + 500, "end_ts": F.col("end_ts") + 500, "policy_id": F.lit("p")})
    gate = compare.fidelity_gate(few, slow, 8).first()
    assert gate.skipped_small_sample and gate.wait_kl_divergence == 0.0 and gate.status == "fail"
    same = compare.fidelity_gate(jobs, jobs.withColumn("policy_id", F.lit("p")), 8).first()
    assert same.status == "pass" and same.fail_reasons == [] and not same.skipped_small_sample


def test_gate_per_dataset(jobs):
    """Two traces at once: each candidate is compared with the observed rows of its own trace."""
    two = jobs.withColumn("dataset_id", F.lit("a")).unionByName(
        jobs.filter("job_id >= 5").withColumns({"dataset_id": F.lit("b"), "start_ts": F.col("start_ts") + 3})
    )
    cands = two.withColumn("policy_id", F.lit("same"))
    gate = compare.fidelity_gate(two, cands, 8, within=["dataset_id"]).collect()
    assert {(r.dataset_id, r.status, round(r.slowdown_ks_statistic, 9)) for r in gate} == {("a", "pass", 0.0), ("b", "pass", 0.0)}


METRICS = "policy_id string, p95_bsld double, utilization_cpu double, fairness_dev double, jain double, starved_rate double"


@pytest.fixture(scope="module")
def cands(spark):
    rows = [
        ("better", 5.0, 0.7, 0.10, 0.90, 0.01),
        ("starving", 4.0, 0.8, 0.10, 0.90, 0.50),
        ("worse", 12.0, 0.5, 0.20, 0.80, 0.01),
        ("twin", 5.0, 0.7, 0.10, 0.90, 0.01),
    ]
    return spark.createDataFrame(rows, METRICS)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("base", 10.0, 0.6, 0.10, 0.90, 0.01)], METRICS)


def test_recommendation(cands, base, spark):
    ranked = {r.policy_id: r for r in decide.recommend(cands, base).collect()}
    assert ranked["better"].rank == 1 and ranked["twin"].rank == 2 and ranked["better"].accepted
    assert ranked["starving"].rejection_reasons == ["starved_rate_exceeded"]
    assert ranked["worse"].rejection_reasons == ["fairness_dev_delta_exceeded", "jain_delta_exceeded", "primary_kpi_not_improved"]
    gate = spark.createDataFrame([("fail",)], "status string")
    status = decide.recommendation_status(decide.recommend(cands, base, gate)).first()
    assert status.status == "blocked" and status.selected_policy_id is None
    assert status.likely_causes[0] == "fidelity_failed" and len(status.failure_modes) == 4


def test_pareto_keeps_equal_points(cands, base):
    front = {r.policy_id for r in decide.pareto_front(cands, base).filter("pareto_frontier").collect()}
    assert front == {"starving"}
    pair = cands.filter("policy_id IN ('better', 'twin', 'worse')")
    assert {r.policy_id for r in decide.pareto_front(pair, base).filter("pareto_frontier").collect()} == {"better", "twin"}


def test_psi(spark):
    rows = [(float(i % 100), 5.0, float(i % 100) + 60) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, k double, y double")
    same = {r.feature: r for r in accuracy.psi(df, df, ["x", "k"]).collect()}
    assert same["x"].psi_value < 0.01 and same["k"].psi_value == 0.0
    moved = accuracy.psi(df, df.withColumn("x", F.col("y")), ["x"]).first()
    assert moved.psi_value > 0.2 and moved.flagged and moved.out_of_range_count == 600
    assert accuracy.psi(df.limit(5), df, ["x"]).count() == 0


def test_feedback_severity(spark):
    rows = [(i, 50.0, 100.0, 200.0, 90.0 if i < 6 else 500.0) for i in range(10)]
    df = spark.createDataFrame(rows, "job_id bigint, p10 double, p50 double, p90 double, actual_sec double")
    scored = accuracy.score_predictions(df.drop("actual_sec"), df.select("job_id", "actual_sec"))
    report = accuracy.feedback_report(scored).first()
    assert report.interval_coverage == 0.6 and report.drift_severity == "mild" and report.overestimate_rate == 0.6
    last = accuracy.feedback_report(scored, last_n=4, order=["job_id"]).first()
    assert last.drift_severity == "severe" and last.total_predictions == 4
    none = accuracy.feedback_report(scored.filter("false")).first()
    assert none.total_predictions == 0 and none.drift_severity == "none"


def test_ensemble_weights_and_floor(spark):
    rows = [("a", 1, 10.0, 20.0, 30.0), ("b", 1, 40.0, 5.0, 0.0), ("a", 2, 0.0, 0.1, 0.2), ("b", 2, 0.0, 0.1, 0.2)]
    members = spark.createDataFrame(rows, "model string, job_id bigint, p10 double, p50 double, p90 double")
    losses = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model string, pinball_loss double")
    out = {r.job_id: (r.p10, r.p50, r.p90) for r in accuracy.ensemble(members, losses).collect()}
    assert out[1] == (16.25, 17.5, 22.5) and out[2] == (1.0, 1.0, 1.0)


def test_estimates(spark):
    df = spark.createDataFrame(
        [(1, 100, 300), (2, 100, None), (3, 100, 0)], "job_id bigint, runtime_actual_sec bigint, runtime_requested_sec bigint"
    )
    preds = spark.createDataFrame([(1, 10.0, 20.5, 40.0)], "job_id bigint, p10 double, p50 double, p90 double")
    out = {r.job_id: r for r in coerce.attach_estimates(df, "p50", preds, 0.5).collect()}
    assert (out[1].runtime_p50_sec, out[1].runtime_guard_sec, out[1].estimate_source) == (20, 30, "prediction")
    assert (out[2].runtime_estimate_sec, out[2].estimate_source) == (100, "actual_fallback")
    assert out[3].estimate_source == "actual_fallback"


def test_fold_plans(spark):
    def ranges(n, **settings):
        rows = spark.range(1).select(F.lit(n).alias("n")).select(F.inline(features.fold_ranges(F.col("n"), **settings)))
        return [tuple(r) for r in rows.collect()]

    bounds = [(f, s, a, b) for f, _, s, a, b in ranges(20)]
    assert bounds[:3] == [(1, "train", 0, 14), (1, "validation", 14, 17), (1, "test", 17, 18)]
    assert bounds[-1] == (3, "test", 19, 20)
    assert [r[2:] for r in ranges(3)] == [("train", 0, 1), ("validation", 1, 2), ("test", 2, 3)]
    with pytest.raises(Exception, match="three rows"):
        ranges(2)
    with pytest.raises(ValueError):
        ranges(20, train_fraction=0.9, val_fraction=0.2)


def test_split_ranges(spark):
    def ranges(column):
        return [tuple(r) for r in spark.range(1).select(F.inline(column)).collect()]

    def split(n):
        return [r[2:] for r in ranges(features.time_ranges(F.lit(n)))]

    assert split(1) == [("train", 0, 1), ("valid", 0, 1), ("test", 0, 1)]
    assert split(2) == [("train", 0, 1), ("valid", 1, 2), ("test", 1, 2)]
    assert split(10) == [("train", 0, 8), ("valid", 8, 9), ("test", 9, 10)]
    assert split(29) == [("train", 0, 23), ("valid", 23, 26), ("test", 26, 29)]
    # 0.7 times 90 falls short of 63
    assert split(90) == [("train", 0, 62), ("valid", 62, 76), ("test", 76, 90)]
    assert ranges(features.cv_ranges(F.lit(43), 3))[2:] == [
        (2, "cv", "train", 0, 20), (2, "cv", "validation", 20, 30), (3, "cv", "train", 0, 30), (3, "cv", "validation", 30, 40),
    ]
    with pytest.raises(Exception, match="needs 10 rows"):
        ranges(features.cv_ranges(F.lit(39), 3))


def test_folds_are_chronological(jobs):
    folds = features.split_summary(features.chronological_folds(jobs))
    assert all(r.chronology_ok for r in features.chronology_ok(folds).collect())


def test_queue_hand_example(spark):
    df = spark.createDataFrame([(1, 0, 10, 20, 2, 1), (2, 5, 5, 9, 4, 1), (3, 10, 30, 40, 1, 1)], JOB)
    at = {r.job_id: r for r in queues.queue_at_submit(df).collect()}
    assert [at[i].queue_congestion_at_submit_jobs for i in (1, 2, 3)] == [0, 1, 1]
    assert [at[i].time_since_prev_submit_sec for i in (1, 2, 3)] == [0, 5, 5]
    series = {r.ts: r.queue_len_jobs for r in queues.observed_queue(df).collect()}
    assert series == {0: 1, 5: 1, 10: 1, 30: 0}
    grid = {r.ts: r.queue_len_jobs for r in queues.resample_hold(queues.observed_queue(df), 7).collect()}
    assert grid == {0: 1, 7: 1, 14: 1, 21: 1, 28: 1}


def test_best_fit(spark):
    df = spark.createDataFrame([(1,), (3,), (5,), (500,)], "requested_cpus int")
    out = {r.requested_cpus: r for r in placement.best_fit(df, [16, 4, 1, 8]).collect()}
    assert [out[c].optimal_node_cpus for c in (1, 3, 5, 500)] == [1, 4, 8, 16]
    assert [out[c].fragmentation_risk for c in (1, 3, 5, 500)] == ["low", "medium", "high", "low"]


def test_sliding_window_edges(spark):
    log = spark.createDataFrame([("k", t) for t in (0, 0, 59, 60, 119, 300)], "key string, ts bigint")
    out = {r.ts: r.in_window for r in sliding_counts(log, 60, 2).collect()}
    assert out == {0: 2, 59: 3, 60: 2, 119: 2, 300: 1}


def test_generators_do_not_depend_on_partitioning(spark):
    a = generate.gen_trace(spark, 500).collect()
    b = generate.gen_jobs(spark.range(1, 501).repartition(7)).collect()
    assert sorted(a) == sorted(b)
    tail = generate.scenario(generate.gen_trace(spark, 300), "heavy_tail")
    assert tail.filter("end_ts <> start_ts + runtime_actual_sec OR runtime_actual_sec < 120").count() == 0
    with pytest.raises(ValueError):
        generate.scenario(tail, "unknown")


def test_permutation_keeps_values(spark, jobs):
    mixed = learning.shuffled(jobs, "requested_cpus", 1, 0)
    assert sorted(r[0] for r in mixed.select("requested_cpus").collect()) == sorted(r[0] for r in jobs.select("requested_cpus").collect())
    assert mixed.join(jobs.withColumnRenamed("requested_cpus", "was"), "job_id").filter("requested_cpus <> was").count() > 0


def test_grid_points_are_not_sorted(spark, monkeypatch):
    """A long quiet stretch costs a row per slice, not one per grid point."""
    sizes = []
    cut = queues.slice_by_time
    monkeypatch.setattr(queues, "slice_by_time", lambda rows: (sizes.append(rows.count()), cut(rows))[1])
    rows = [("a", 5, 1.0, None), ("a", 5, None, 7.0), ("a", 3_000_011, 2.0, None), ("b", 100, 4.0, None)]
    series = spark.createDataFrame(rows, "k string, ts bigint, o double, c double")
    ends = spark.createDataFrame([("a", 0, 5_000_000), ("b", 90, 200), ("c", 0, 60)], "k string, start_ts bigint, end_ts bigint")
    got = queues.resample_hold(series, 60, ends, ["o", "c"], ["k"])
    assert sorted(map(tuple, got.filter("k <> 'a'").collect())) == [("b", 90, 0.0, 0.0), ("b", 150, 4.0, 0.0), ("c", 0, 0.0, 0.0), ("c", 60, 0.0, 0.0)]
    held = got.filter("k = 'a'").groupBy("o", "c").agg(F.count("*").alias("n"), F.min("ts"), F.max("ts")).collect()
    assert sorted(map(tuple, held)) == [(0.0, 0.0, 1, 0, 0), (1.0, 7.0, 50_000, 60, 3_000_000), (2.0, 7.0, 33_333, 3_000_060, 4_999_980)]
    assert sizes[0] < 100


def _cut_rows(monkeypatch, module):
    sizes = []
    cut = module.slice_by_range
    monkeypatch.setattr(module, "slice_by_range", lambda rows, *a: (sizes.append(rows.count()), cut(rows, *a))[1])
    return sizes


def test_quantiles_order_few_values(spark, monkeypatch):
    from cairntrace.operators import quantiles as q

    sizes = _cut_rows(monkeypatch, q)
    values = [((i * 7919) % 20011) ** 2 / 7 - 1000 for i in range(20000)]
    rows = [(("a", "b")[i % 3 == 0], v) for i, v in enumerate(values)] + [("a", None), ("b", 5.0), ("b", 5.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    asked = {r.k: r for r in q.quantiles(df, {"x": F.col("x")}, probs, ["k"]).collect()}
    assert sizes[0] < 1000 and set(asked) == {"a", "b"}
    for k in "ab":
        own = np.array([v for name, v in rows if name == k and v is not None])
        assert asked[k].x_n == len(own)
        assert [asked[k][f"x_p{p * 100:g}"] for p in probs] == pytest.approx(list(np.quantile(own, probs)))
    monkeypatch.setattr(q, "HISTOGRAMS", 0)
    assert {r.k: r for r in q.quantiles(df, {"x": F.col("x")}, probs, ["k"]).collect()} == asked
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,), (2.0,), (0.0,)], "x double")
    assert q.quantiles(odd, {"x": F.col("x")}, [0.25, 0.5]).first()[1:] == (1.0, 2.0)
    assert q.quantiles(odd.filter("x < 0"), {"x": F.col("x")}, [0.5]).first() == (0, None)


def test_slowdown_distance_orders_few_values(spark, monkeypatch):
    sizes = _cut_rows(monkeypatch, compare)

    def jobs(waits):
        return [(0, w, w + 60 + i % 97) for i, w in enumerate(waits)]

    one, two = jobs([(i * 7919) % 9973 for i in range(9973)]), jobs([(i * 31) % 9973 * 11 // 10 for i in range(9973)])
    schema = "submit_ts bigint, start_ts bigint, end_ts bigint"
    observed = spark.createDataFrame([*one, (None, None, None)], schema)
    other = spark.createDataFrame([(p, *r) for p, rows in (("p", two), ("same", one)) for r in rows], f"policy_id string, {schema}")
    got = {r.policy_id: r.slowdown_ks_statistic for r in compare.slowdown_ks(observed.dropna(), other, ["policy_id"]).collect()}
    x, y = (np.sort([e / max(e - s, 60) for _, s, e in rows]) for rows in (one, two))
    both = np.concatenate([x, y])
    gap = np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max()
    assert got == {"p": pytest.approx(gap), "same": 0.0}
    assert compare.slowdown_ks(observed, observed).first()[0] == 0.0
    assert compare.slowdown_ks(observed.filter("submit_ts > 9"), observed).first()[0] == 0.0
    traces = [t.withColumn("dataset_id", F.explode(F.array(F.lit("a"), F.lit("b")))) for t in (observed.dropna(), other)]
    within = compare.slowdown_ks(*traces, ["policy_id"], ["dataset_id"]).collect()
    assert {(r.dataset_id, r.policy_id): r.slowdown_ks_statistic for r in within} == {(d, p): v for d in "ab" for p, v in got.items()}


def test_importance_scores_all_repeats_at_once(spark):
    df = spark.range(300).selectExpr("id AS job_id", "id % 50 AS a", "id % 3 AS b", "double(id % 50) AS runtime_actual_sec")
    calls = []

    def score(rows):
        calls.append(1)
        return rows.withColumn("p50", F.col("a").cast("double"))

    got = {r.feature: r for r in learning.importance(score, df, ["a", "b"], repeats=4).collect()}
    assert len(calls) == 2 and got["b"].importance_mean == 0 and got["a"].importance_mean > 1
    one = []
    for k in range(4):
        rows = learning.with_donors(learning.numbered(df, 42), ["a", "b"], 42, k)
        one.append(rows.agg(F.avg(F.abs(F.col("runtime_actual_sec") - F.col("_donor.a")))).first()[0])
    assert got["a"].importance_mean == pytest.approx(sum(one) / 4)
