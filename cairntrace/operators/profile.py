"""Trace profile: sizes, heavy tails, over-requests, congestion, user skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.operators.facts import side_by_side
from cairntrace.operators.metrics import wait_sec
from cairntrace.operators.quantiles import quantiles
from cairntrace.operators.queues import profile_queue
from cairntrace.schema import require, user_key

# Workload classes.
HEAVY_TAIL_RATIO = 50.0
LOW_WAIT_SEC = 10.0


def _run() -> Column:
    return F.coalesce(F.col("runtime_actual_sec"), F.lit(0))


def _overrequest() -> Column:
    asked, run = F.col("runtime_requested_sec"), _run()
    return F.when(asked.isNotNull() & (run > 0), asked.cast("double") / run)


def profile_quantiles(jobs: DataFrame) -> DataFrame:
    """Quantiles of CPUs, run time and over-request ratio in one counting pass."""
    return quantiles(
        jobs,
        {"cpus": F.col("requested_cpus"), "run": _run(), "ratio": _overrequest()},
        {"cpus": [0.5, 0.9, 0.99, 1.0], "run": [0.5, 0.9, 0.95, 0.99], "ratio": [0.5, 0.9, 0.95]},
    )


def _size_columns() -> list[Column]:
    return [
        F.col("cpus_p50").alias("requested_cpus_p50"),
        F.col("cpus_p90").alias("requested_cpus_p90"),
        F.col("cpus_p99").alias("requested_cpus_p99"),
        F.col("cpus_p100").alias("requested_cpus_max"),
    ]


def _tail_columns() -> list[Column]:
    return [
        F.col("run_p50").alias("runtime_p50_sec"),
        F.col("run_p90").alias("runtime_p90_sec"),
        F.col("run_p95").alias("runtime_p95_sec"),
        F.col("run_p99").alias("runtime_p99_sec"),
        F.when(F.col("run_p50") > 0, F.col("run_p99") / F.col("run_p50")).alias("tail_ratio_p99_over_p50"),
    ]


def _overrequest_columns() -> list[Column]:
    return [
        F.col("ratio_n").alias("sample_size"),
        F.col("ratio_p50"),
        F.col("ratio_p90"),
        F.col("ratio_p95"),
    ]


def profile_sizes(jobs: DataFrame) -> DataFrame:
    return quantiles(jobs, {"cpus": F.col("requested_cpus")}, [0.5, 0.9, 0.99, 1.0]).select(*_size_columns())


def profile_runtime(jobs: DataFrame) -> DataFrame:
    return quantiles(jobs, {"run": _run()}, [0.5, 0.9, 0.95, 0.99]).select(*_tail_columns())


def profile_overrequest(jobs: DataFrame) -> DataFrame:
    return quantiles(jobs, {"ratio": _overrequest()}, [0.5, 0.9, 0.95]).select(*_overrequest_columns())


def profile_congestion(jobs: DataFrame) -> DataFrame:
    """Mean, p95 and maximum queue length over seconds with events."""
    series = profile_queue(jobs)
    tail = quantiles(series, {"q": F.col("queue_len_jobs")}, [0.95]).select(F.col("q_p95").alias("queue_len_p95"))
    base = series.agg(
        F.avg("queue_len_jobs").alias("queue_len_mean"),
        F.max("queue_len_jobs").cast("double").alias("queue_len_max"),
        F.count("*").alias("event_count"),
    )
    return side_by_side([base, tail], []).select("queue_len_mean", "queue_len_p95", "queue_len_max", "event_count")


def profile_users(jobs: DataFrame) -> DataFrame:
    """Number of users, share of the largest and of the five largest, Herfindahl index."""
    counts = jobs.groupBy(user_key().alias("user_key")).agg(F.count("*").alias("n"))
    whole = counts.agg(
        F.count("*").alias("unique_users"),
        F.sum("n").alias("jobs"),
        F.max("n").alias("top"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
    )
    top5 = counts.orderBy(F.desc("n")).limit(5).agg(F.sum("n").alias("top5"))
    total = F.col("jobs").cast("double")
    return side_by_side([whole, top5], []).select(
        "unique_users",
        (F.col("top") / total).alias("top_user_share"),
        (F.col("top5") / total).alias("top_5_users_share"),
        (F.col("squares") / (total * total)).alias("user_hhi"),
    )


def profile_range(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.min("submit_ts").alias("submit_min"),
        F.max("submit_ts").alias("submit_max"),
        F.min("start_ts").alias("start_min"),
        F.max("end_ts").alias("end_max"),
    )


def trace_profile(jobs: DataFrame) -> DataFrame:
    """The whole profile as one nested row."""
    require(
        jobs,
        {"submit_ts", "start_ts", "end_ts", "runtime_actual_sec", "runtime_requested_sec", "requested_cpus", "user_id"},
        "profile",
    )
    spread = profile_quantiles(jobs)
    parts = {
        "time_range": profile_range(jobs),
        "job_size_distribution": spread.select(*_size_columns()),
        "runtime_heavy_tail": spread.select(*_tail_columns()),
        "overrequest_distribution": spread.select(*_overrequest_columns()),
        "congestion_regime": profile_congestion(jobs),
        "user_skew": profile_users(jobs),
    }
    rows = jobs.agg(F.count("*").alias("row_count"))
    return side_by_side([rows, *[df.select(F.struct("*").alias(name)) for name, df in parts.items()]])


def workload_class(jobs: DataFrame) -> DataFrame:
    """heavy_tail if p99/p50 > 50, else low_congestion if the mean wait is under 10 s, else balanced."""
    tails = quantiles(jobs, {"run": _run()}, [0.5, 0.99])
    waits = jobs.agg(F.avg(wait_sec()).alias("mean_wait_sec"))
    both = side_by_side([tails, waits], [])
    ratio = F.when(F.col("run_p50") > 0, F.col("run_p99") / F.col("run_p50")).otherwise(F.lit(1.0))
    return both.select(
        ratio.alias("tail_ratio"),
        "mean_wait_sec",
        F.when(ratio > HEAVY_TAIL_RATIO, "heavy_tail")
        .when(F.col("mean_wait_sec") < LOW_WAIT_SEC, "low_congestion")
        .otherwise("balanced")
        .alias("workload_class"),
    )
