"""Checks over sets of jobs, the frontier, file digests and event positions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cairntrace.operators import coerce, decide, invariants, quality


def documents(spark, *snapshots):
    return spark.createDataFrame([(json.dumps(s),) for s in snapshots], "value string")


def snapshot(clock, capacity, free, queued=(), running=()):
    return {
        "clock_ts": clock, "capacity_cpus": capacity, "free_cpus": free,
        "queued_jobs": [{"job_id": j, "submit_ts": t} for j, t in queued],
        "running_jobs": [{"job_id": j, "allocated_cpus": c} for j, c in running],
    }


def test_snapshot_violations(spark):
    docs = documents(
        spark,
        snapshot(1, 8, 3, [(10, 0), (11, 1)], [(12, 4), (13, 1)]),
        snapshot(2, 8, -1, [], [(12, 9)]),
        snapshot(3, 8, 9),
        snapshot(4, 8, 0, [(12, 4), (14, 5), (14, 3)], [(12, 5), (15, 3)]),
    )
    got = {tuple(r) for r in invariants.snapshot_violations(docs).collect()}
    assert got == {
        (2, "free_cpus_negative", None), (3, "free_cpus_exceeds_capacity", None), (3, "cpu_conservation_broken", None),
        (4, "job_exists_in_queue_and_running", 12), (4, "queued_job_submit_in_future", 14),
    }


def test_queued_while_running_matches_seconds(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        submit = rng.randrange(60)
        start = submit + rng.randrange(15)
        rows.append((str(rng.choice([1, 1, 2, 30, 4])), submit, start, start + rng.randrange(20)))
    df = spark.createDataFrame(rows, "job_id string, submit_ts long, start_ts long, end_ts long")
    got = set()
    for r in invariants.queued_while_running(df).collect():
        got |= {(r.job_id, t) for t in range(r.from_ts, r.to_ts)}
    want = {
        (j, t)
        for j in {r[0] for r in rows}
        for t in range(120)
        if any(r[0] == j and r[1] <= t < r[2] for r in rows) and any(r[0] == j and r[2] <= t < r[3] for r in rows)
    }
    assert got == want and want


def test_conservation(spark):
    jobs = spark.createDataFrame([(0, 10, 4), (5, 20, 2), (10, 12, 4)], "start_ts long, end_ts long, requested_cpus int")
    reported = spark.createDataFrame([(0, 4), (5, 3), (9, 2), (10, 9), (12, -1), (30, 8)], "ts long, free_cpus long")
    got = {tuple(r) for r in invariants.conservation(jobs, 8, reported).collect()}
    assert got == {
        (5, 6, 3, "cpu_conservation_broken"), (10, 6, 9, "cpu_conservation_broken"), (10, 6, 9, "free_cpus_exceeds_capacity"),
        (12, 2, -1, "cpu_conservation_broken"), (12, 2, -1, "free_cpus_negative"),
    }


def test_frontier_matches_all_pairs(spark):
    rng = random.Random(3)
    # a third of the points lie on a plane, where none dominates another
    points = [tuple(float(rng.randrange(30)) for _ in range(3)) for _ in range(400)]
    points += [(float(a), float(b), 60.0 - a - b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(200))]
    rows = points + points[:50]
    df = spark.createDataFrame([*rows, (None, 99.0, 99.0)], "a double, b double, c double")
    marked = decide.mark_frontier(df.repartition(7), ["a", "b", "c"])

    def dominated(p):
        return any(all(x >= y for x, y in zip(q, p)) and q != p for q in points)

    want = {p for p in points if not dominated(p)}
    got = marked.collect()
    assert {(r.a, r.b, r.c) for r in got if r.pareto_frontier} == want and len(got) == len(rows) + 1
    assert all(r.pareto_dominated != r.pareto_frontier for r in got)
    plan = marked._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_file_larger_than_one_value(spark, tmp_path):
    large = tmp_path / "large.bin"
    with large.open("wb") as out:
        out.write(b"begin")
        out.truncate(3 << 30)
        out.seek(0, 2)
        out.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    want = hashlib.sha256()
    with large.open("rb") as f:
        while block := f.read(1 << 24):
            want.update(block)
    got = {r.filename: (r.length, r.sha256) for r in quality.dataset_fingerprint(spark, str(tmp_path)).collect()}
    assert got["large.bin"] == ((3 << 30) + 3, want.hexdigest())
    assert got["small.bin"] == (3, hashlib.sha256(b"abc").hexdigest())
    # Spark's readers leave out empty files
    assert "none.bin" not in got


def test_positions_are_the_order(spark):
    rows = [(5, "submit", 1, 0), (5, "complete", 9, 1), (5, "dispatch", None, 2), (5, "submit", None, 3), (4, "dispatch", 2, 4), (5, "submit", 1, 5)]
    events = spark.createDataFrame(rows, "ts long, event_type string, job_id long, event_id long")
    placed = {r.event_id: r.pos for r in coerce.event_positions(events, "event_id").collect()}
    assert placed == {4: 0, 1: 1, 3: 2, 0: 3, 5: 4, 2: 5}
    assert [r.event_id for r in coerce.order_events(events, "event_id").collect()] == sorted(placed, key=placed.get)


@pytest.mark.parametrize("column", ["a", "b"])
def test_shuffled_values_are_another_rows(spark, column):
    from cairntrace.operators import learning

    df = spark.createDataFrame([(i, i, -i) for i in range(200)], "job_id long, a long, b long")
    out = learning.shuffled(df, column, 3, 0).collect()
    assert sorted(r[column] for r in out) == sorted(r[column] for r in df.select(column).collect())
    assert all(abs(r[column]) != r.job_id for r in out)
    again = learning.shuffled(df, column, 3, 1)
    assert {tuple(r) for r in out} != {tuple(r) for r in again.collect()}


def test_search_keeps_failed_trials(spark):
    from cairntrace.operators import learning

    rng = random.Random(4)
    rows = [
        (i, 1000 + i, 60 * (1 + i % 7), 30 * (1 + i % 7) + rng.randrange(20), 1 + i % 4, "q", "p", f"u{i % 5}", None, i % 24, i % 7)
        for i in range(240)
    ]
    names = "job_id long, submit_ts long, runtime_requested_sec long, runtime_actual_sec long, requested_cpus int, queue_id string, partition_id string, user_id string, group_id string, submit_hour int, submit_dow int"
    df = spark.createDataFrame(rows, names).withColumns(
        {c: F.lit(1.0) for c in learning.NUMERIC if c not in ("requested_cpus", "runtime_requested_sec")}
    )
    space = {"n_estimators": [2, 4], "max_depth": [3], "learning_rate": [0.5]}
    trials = learning.tune(df, n_trials=4, n_folds=2, space=space).collect()
    assert [t.n_estimators for t in trials] == [2.0, 4.0, 2.0, 4.0] and all(t.status == "ok" for t in trials)
    # the stage of a larger fit scores as a fit of that size does
    alone = learning.tune(df, n_trials=1, n_folds=2, space={**space, "n_estimators": [2]}).first()
    assert alone.score == pytest.approx(trials[0].score)
    other = learning.tune(df, n_trials=1, n_folds=2, alpha=0.9, space=space).first()
    assert other.status == "ok" and other.score > 0
    bad = learning.tune(df, n_trials=2, n_folds=2, space={**space, "max_depth": [99]}).collect()
    assert [t.status for t in bad] == ["error", "error"] and all(t.error and t.score is None for t in bad)
    assert trials[0].without_effect == []
