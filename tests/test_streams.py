"""Streams with a state of their own, over landings that come late and out of order."""

import os
import random
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cairntrace.operators.accuracy import outcome_columns
from cairntrace.streaming import jobs as st
from cairntrace.streaming.state import BUCKETS

EVENTS = "queue_id string, ts long, dj long, dc long"


@pytest.fixture(scope="module", autouse=True)
def _few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Streamed:
    """A folder that parts land in, each streamed with the same checkpoint."""

    def __init__(self, spark, folder, schema, start):
        self.spark, self.schema, self.start = spark, schema, start
        self.landed, self.out, self.mark = (str(folder / n) for n in ("landed", "out", "mark"))

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.landed)
        source = self.spark.readStream.schema(self.schema).parquet(self.landed)
        self.start(source, self.out, self.mark).awaitTermination()
        return self.spark.read.parquet(self.out).collect()


def depths(events):
    """Floored running sums per queue and second."""
    out = {}
    for q in {e[0] for e in events}:
        net = {}
        for e in events:
            if e[0] == q:
                was = net.get(e[1], (0, 0))
                net[e[1]] = (was[0] + e[2], was[1] + e[3])
        jobs = cpus = 0
        for ts in sorted(net):
            jobs, cpus = max(0, jobs + net[ts][0]), max(0, cpus + net[ts][1])
            out[q, ts] = (jobs, cpus)
    return out


def test_live_queue_over_landings(spark, tmp_path):
    rng = random.Random(6)
    events = [
        ("hot" if rng.random() < 0.4 else f"q{rng.randrange(3)}", rng.randrange(5000), rng.choice([1, 1, -1]), rng.randrange(-9, 12))
        for _ in range(900)
    ]
    rng.shuffle(events)
    parts = [events[k::3] for k in range(3)]
    stream = Streamed(spark, tmp_path, EVENTS, lambda s, out, mark: st.stream_queue(s, out, mark, "6000 seconds"))
    for part in parts[:2]:
        stream.land(part)
    rows = stream.land(parts[2] + [("end", 20_000, 0, 0)])
    got = {(r.queue_id, r.ts): (r.queue_len_jobs, r.queue_len_cpu_demand) for r in rows if r.queue_id != "end"}
    assert got == depths(events) and len(got) == sum(r.queue_id != "end" for r in rows)


def test_changes_behind_the_watermark_still_count(spark, tmp_path):
    stream = Streamed(spark, tmp_path, EVENTS, lambda s, out, mark: st.stream_queue(s, out, mark, "10 seconds"))
    stream.land([("a", 100, 2, 2), ("a", 500, 0, 0)])
    rows = stream.land([("a", 50, 3, 3), ("a", 700, -1, -1), ("a", 900, 0, 0)])
    # the second 50 is long past when its change comes: it counts from the one after the last told, 101, on
    assert sorted((r.ts, r.queue_len_jobs) for r in rows) == [(100, 2), (101, 5), (500, 5), (700, 4)]


def test_a_stream_without_its_state_does_not_start_over(spark, tmp_path):
    start = lambda s, out, mark: st.stream_queue(s, out, mark, "10 seconds")
    stream = Streamed(spark, tmp_path, EVENTS, start)
    stream.land([("a", 100, 2, 2), ("a", 500, 0, 0)])
    lost = str(tmp_path / "lost")
    shutil.copytree(stream.mark, lost, ignore=lambda folder, names: names if os.path.basename(folder) == "state" else [])
    stream.mark = lost
    with pytest.raises(StreamingQueryException):
        stream.land([("a", 800, 2, 2)])


def test_live_counts_over_landings(spark, tmp_path):
    rng = random.Random(9)
    log = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(3000)) for _ in range(700)]
    start = lambda s, out, mark: st.stream_request_counts(s, out, mark, "4000 seconds", 100, 5)
    stream = Streamed(spark, tmp_path, "key long, ts long", start)
    stream.land(log[::2])
    rows = [r for r in stream.land(log[1::2] + [(-1, 20_000)]) if r.key >= 0]
    want = {(k, t): sum(q == k and t - 100 < u <= t for q, u in log) for k, t in log}
    assert {(r.key, r.ts): r.in_window for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.in_window > 5) for r in rows)


def test_live_counts_drop_states_that_are_over(spark, tmp_path):
    start = lambda s, out, mark: st.stream_request_counts(s, out, mark, "10 seconds", 100, 5)
    stream = Streamed(spark, tmp_path, "key long, ts long", start)
    stream.land([(1, t) for t in range(0, 1000, 10)] + [(1, 5000)])
    source = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "waiting").load(stream.mark)
    # of the stretches behind the watermark nothing is left, but the two of the last request
    assert source.count() == 2


def test_live_counts_of_many_keys_share_states(spark, tmp_path):
    """As many states as buckets and stretches, however many keys; long and missing keys stay what they are."""
    keys = [None, *(2**60 + k for k in range(200))]
    log = [(k, t) for k in keys for t in (10, 40, 150)]
    start = lambda s, out, mark: st.stream_request_counts(s, out, mark, "10 seconds", 100, 1)
    stream = Streamed(spark, tmp_path, "key long, ts long", start)
    stream.land(log)
    source = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "waiting").load(stream.mark)
    assert source.select("key").distinct().count() <= 2 * BUCKETS
    rows = [r for r in stream.land([(-1, 9000)]) if r.key != -1]
    assert {(r.key, r.ts): r.in_window for r in rows} == {(k, t): n for k in keys for t, n in ((10, 1), (40, 2), (150, 1))}
    assert len(rows) == len(log) and all(r.over_limit == (r.in_window > 1) for r in rows)


def test_each_job_passes_once(spark, tmp_path):
    schema = "job_id string, submit_ts long"
    start = lambda s, out, mark: st.write_stream(st.each_job_once(s), out, mark, None)
    stream = Streamed(spark, tmp_path, schema, start)
    stream.land([("a", 5), ("b", 6), ("a", 5)])
    stream.land([("c", 1), ("a", 9)])
    rows = stream.land([("b", 0), ("c", 2), ("d", 3)])
    assert sorted(r.job_id for r in rows) == ["a", "b", "c", "d"]


def test_sketched_tail_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(86_400 * (i % 3) + rng.randrange(86_400), 0.0, float(rng.randrange(10**6)), 10.0**7) for i in range(6000)]
    schema = "done long, p10 double, p50 double, p90 double"

    def scored(df):
        df = df.withColumn("done_at", F.timestamp_seconds("done")).withColumn("actual_sec", F.lit(0.0))
        return df.withColumns(outcome_columns(F.col("actual_sec")))

    def start(s, out, mark):
        rolled = st.rolling_accuracy(scored(s).withWatermark("done_at", "1 hour"))
        return st.write_stream(rolled, out, mark, None)

    stream = Streamed(spark, tmp_path, schema, start)
    stream.land(rows[:3000])
    stream.spark = spark
    got = {r.w.start: r for r in stream.land(rows[3000:] + [(86_400 * 9, 0.0, 0.0, 0.0)])}
    exact = {r.w.start: r for r in st.rolling_accuracy(scored(spark.createDataFrame(rows, schema))).collect()}
    assert got.keys() >= set(list(exact)[:1]) and len(got) >= 2
    for day, r in got.items():
        errors = sorted(x[2] for x in rows if x[0] // 86_400 == int(day.timestamp()) // 86_400)
        if r.predictions == len(errors):
            assert sum(e <= r.p95_error for e in errors) / len(errors) == pytest.approx(0.95, abs=0.01)
            assert exact[day].p95_error == pytest.approx(errors[int(0.95 * len(errors))], rel=0.01)
