"""Slice-wise running values against plain loops, with groups that span many slices."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairntrace.operators import history, ordered
from cairntrace.operators.quantiles import quantiles


def walk(n, groups, seed=3):
    """Rows whose first group holds a third of everything."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(groups)}"
        rows.append((g, i, rng.randint(-6, 5), rng.choice([None, i])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return walk(600, 5)


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, ts bigint, d bigint, v bigint")


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_matches_a_loop(spark, rows, groups):
    sliced = ordered.slice_by_range(frame(spark, rows), [*groups, "ts"], slices=7)
    assert sliced.select("_slice").distinct().count() > 3
    out = ordered.running(
        sliced, [F.col("ts")], groups, {"s": F.col("d")}, {"last": F.col("v")}, {"prev": F.col("v")}, grand=True
    ).collect()
    got = {r.ts: (r.s, r.last, r.prev, r.s_all) for r in out}
    total = {}
    for g, ts, d, v in rows:
        key = g if groups else 0
        total[key] = total.get(key, 0) + d
    state = {}
    for g, ts, d, v in sorted(rows, key=lambda r: r[1]):
        key = g if groups else 0
        s, last = state.get(key, (0, None))
        now = v if v is not None else last
        assert got[ts] == (s + d, now, last, total[key])
        state[key] = (s + d, now)


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("by_time", [False, True])
def test_clamped_sum_matches_a_loop(spark, rows, groups, by_time):
    df = frame(spark, rows)
    sliced = ordered.slice_by_time(df, width=50) if by_time else ordered.slice_by_range(df, [*groups, "ts"], slices=7)
    got = {r.ts: r.q for r in ordered.clamped_sums(sliced, [F.col("ts")], {"q": F.col("d")}, groups).collect()}
    state = {}
    for g, ts, d, _ in sorted(rows, key=lambda r: r[1]):
        key = g if groups else 0
        state[key] = max(0, state.get(key, 0) + d)
        assert got[ts] == state[key]


def test_row_index(spark, rows):
    out = ordered.row_index(ordered.slice_by_range(frame(spark, rows), ["ts"], slices=5), [F.col("ts")])
    assert sorted((r.ts, r.row_idx) for r in out.collect()) == [(i, i) for i in range(600)]


def jobs_frame(spark, n=900, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(12)}"
        run = rng.choice([7, 7, 7, rng.randrange(1, 4000)])
        asked = rng.choice([None, run * 2, run + 5])
        rows.append((i, 1000 + rng.randrange(20000), user if user != "u3" else None, run, asked, rng.choice([1, 2, 8])))
    schema = "job_id bigint, submit_ts bigint, user_id string, runtime_actual_sec bigint, runtime_requested_sec bigint, requested_cpus int"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("causal", [False, True])
def test_user_lookbacks_across_slices(spark, causal):
    df, rows = jobs_frame(spark)
    out = {r.job_id: r for r in history.user_lookbacks(df, causal).collect()}
    runs = [r[3] for r in rows]
    ratios = [r[4] / r[3] for r in rows if r[4] is not None]
    for job, submit, user, run, asked, _ in rows:
        if causal:
            seen = [r for r in rows if r[2] == user and r[1] + r[3] <= submit]
        else:
            seen = [r for r in rows if r[2] == user and (r[1], r[0]) < (submit, job)]
        got = out[job]
        assert got.user_job_count_lookback == len(seen)
        assert got.user_runtime_median_lookback == (np.median([r[3] for r in seen]) if seen else np.median(runs))
        want = np.var([r[3] for r in seen]) if seen else np.var(runs)
        assert got.user_runtime_var_lookback == pytest.approx(want, rel=1e-9, abs=1e-6)
        known = [r[4] / r[3] for r in seen if r[4] is not None]
        assert got.user_overrequest_mean_lookback == pytest.approx(np.mean(known) if known else np.median(ratios))


def test_lookbacks_of_one_user_spanning_all_slices(spark):
    rng = random.Random(1)
    rows = [(i, i, "only", rng.randrange(50), None, 1) for i in range(800)]
    df = spark.createDataFrame(
        rows,
        "job_id bigint, submit_ts bigint, user_id string, runtime_actual_sec bigint, runtime_requested_sec bigint, requested_cpus int",
    )
    got = {r.job_id: r.user_runtime_median_lookback for r in history.user_lookbacks(df).collect()}
    want = pd.Series([r[3] for r in rows]).shift(1).expanding().median()
    assert all(got[i] == want[i] for i in range(1, 800))


def test_two_latest_completions(spark):
    df, rows = jobs_frame(spark)
    out = {r.job_id: (r.last_run, r.prev_run) for r in history.asof_history(df).collect()}
    for job, submit, user, *_ in rows:
        done = sorted((r[1] + r[3], r[1], r[0], r[3]) for r in rows if r[2] == user and r[1] + r[3] <= submit)
        latest = [d[3] for d in done[::-1][:2]] + [None, None]
        assert out[job] == (latest[0], latest[1])


@pytest.mark.parametrize("half_life", [7 * 86400.0, 10.0])
def test_fairshare_matches_the_sum(spark, half_life):
    """The short half-life spans thousands of half-lives, where a single scale would overflow."""
    df, rows = jobs_frame(spark, 300)
    out = {r.job_id: r.priority_score for r in history.fairshare(df, half_life).collect()}
    for job, submit, user, *_ in rows:
        used = sum(
            r[5] * r[3] * 2.0 ** ((r[1] + r[3] - submit) / half_life)
            for r in rows
            if r[2] == user and r[1] + r[3] <= submit
        )
        assert -out[job] == pytest.approx(used, rel=1e-9, abs=1e-12)


def test_tsafrir_hand_example(spark):
    rows = [(1, 0, 1, 100, 1000), (2, 150, 1, 200, 1000), (3, 400, 1, 10, 120), (4, 500, 2, 10, 50)]
    df = spark.createDataFrame(
        rows, "job_id bigint, submit_ts bigint, user_id bigint, runtime_actual_sec bigint, runtime_estimate_sec bigint"
    ).withColumn("requested_cpus", F.lit(1))
    out = {r.job_id: r for r in history.tsafrir(df).collect()}
    assert [out[i].tsafrir_runtime_sec for i in (1, 2, 3, 4)] == [1000, 100, 120, 50]
    assert [out[i].tsafrir_history_count for i in (1, 2, 3, 4)] == [0, 1, 2, 0]
    assert [out[i].tsafrir_clamped for i in (1, 2, 3, 4)] == [False, False, True, False]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 40, 500), rng.random(500)
    df = spark.createDataFrame([(int(x), float(y), int(i % 3)) for i, (x, y) in enumerate(zip(a, b))], "a bigint, b double, g int")
    out = {r.g: r for r in quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.1, 0.5, 0.95], ["g"]).collect()}
    for g in range(3):
        for name, x in (("a", a[g::3]), ("b", b[g::3])):
            for p, tag in ((0.1, "p10"), (0.5, "p50"), (0.95, "p95")):
                assert out[g][f"{name}_{tag}"] == pytest.approx(np.quantile(x, p))
    empty = quantiles(df.filter("g > 9"), {"a": F.col("a")}, [0.5]).first()
    assert (empty.a_n, empty.a_p50) == (0, None)


def test_release_before_the_action_changes_nothing(spark):
    from cairntrace.operators import queues
    from cairntrace.operators.ordered import release
    from cairntrace.plans import fixtures as fx

    jobs = fx.jobs(spark, "/root/testdata/sf0.001")
    kept = queues.queue_at_submit(jobs).orderBy("job_id").collect()
    again = queues.queue_at_submit(jobs)
    release()
    assert again.orderBy("job_id").collect() == kept


def test_slices_grow_in_number_not_in_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 20)
    df = frame(spark, rows)
    sliced = ordered.slice_by_range(df, ["ts"], slices=2)
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] < 100
    assert sorted(sliced.drop("_slice").collect(), key=lambda r: r.ts) == sorted(df.collect(), key=lambda r: r.ts)
    place = {r.ts: r.row_idx for r in ordered.row_index(sliced, [F.col("ts")]).collect()}
    assert place == {ts: i for i, ts in enumerate(sorted(r[1] for r in rows))}


def test_tasks_of_a_learner_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from cairntrace.operators import learning
    from cairntrace.session import settle

    rows = settle(spark.range(4000).coalesce(1))
    assert learning.fit_rows(rows).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(learning, "FIT_ROWS", 100)
    dealt = learning.fit_rows(rows)
    assert max(dealt.rdd.glom().map(len).collect()) <= 200 and dealt.count() == 4000
