"""Job, fairness and starvation metrics of job tables (one row per trace or policy)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.operators.facts import side_by_side, with_group_totals
from cairntrace.operators.quantiles import quantiles
from cairntrace.schema import require, user_key

STARVATION_CAP_SEC = 172800
SLOWDOWN_FLOOR_SEC = 60
DEFAULT_CAPACITY = 64
OBJECTIVE = [
    "job_count",
    "mean_wait_sec",
    "p95_wait_sec",
    "throughput",
    "makespan_sec",
    "utilization_cpu",
    "p95_bsld",
    "starved_rate",
    "starved_jobs",
    "total_jobs",
    "fairness_dev",
    "jain",
    "active_users",
]


def wait_sec() -> Column:
    return F.greatest(F.col("start_ts") - F.col("submit_ts"), F.lit(0))


def run_sec() -> Column:
    return F.greatest(F.col("end_ts") - F.col("start_ts"), F.lit(0))


def bounded_slowdown(wait: Column | None = None, run: Column | None = None) -> Column:
    """(wait + run) / max(run, 60)."""
    wait = wait_sec() if wait is None else wait
    run = run_sec() if run is None else run
    return (wait + run).cast("double") / F.greatest(run, F.lit(SLOWDOWN_FLOOR_SEC)).cast("double")


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _totals(jobs: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    return jobs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(wait_sec()).alias("mean_wait"),
        F.min("submit_ts").alias("first"),
        F.max("end_ts").alias("last"),
        F.sum(F.col("requested_cpus").cast("double") * run_sec()).alias("cpu_sec"),
        *extra,
    )


def _job_columns(capacity_cpus: int) -> list[Column]:
    zero = F.lit(0.0)
    span = _span()
    return [
        F.col("n").cast("double").alias("job_count"),
        F.coalesce("mean_wait", zero).alias("mean_wait_sec"),
        F.coalesce("wait_p95", zero).alias("p95_wait_sec"),
        F.when(span > 0, F.col("n") / span).otherwise(zero).alias("throughput"),
        span.alias("makespan_sec"),
        _utilisation(capacity_cpus).alias("utilization_cpu"),
        F.coalesce("bsld_p95", zero).alias("p95_bsld"),
    ]


def _span() -> Column:
    return F.greatest(F.coalesce(F.col("last") - F.col("first"), F.lit(0)), F.lit(0)).cast("double")


def _utilisation(capacity_cpus: int) -> Column:
    span = _span()
    return F.when(span > 0, _clamp01(F.col("cpu_sec") / (span * F.lit(float(capacity_cpus))))).otherwise(0.0)


def _tails(jobs: DataFrame, by: Sequence[str], slowdown: Column, nearest: bool = False) -> DataFrame:
    tails = quantiles(jobs, {"wait": wait_sec(), "bsld": slowdown}, [0.95], by, nearest=nearest)
    return tails.drop("wait_n", "bsld_n")


def job_metrics(jobs: DataFrame, capacity_cpus: int, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean/p95 wait, throughput, makespan, utilisation and p95 bounded slowdown."""
    require(jobs, {"submit_ts", "start_ts", "end_ts", "requested_cpus"}, "job metrics")
    both = side_by_side([_totals(jobs, by), _tails(jobs, by, bounded_slowdown())], by)
    return both.select(*by, *_job_columns(capacity_cpus))


def job_metrics_nearest(jobs: DataFrame, capacity_cpus: int, by: Sequence[str] = ()) -> DataFrame:
    """Alternate definition used for published cluster tables: max(1, wait / max(run, 10)),
    nearest-rank p95, utilisation clamped to 0..1."""
    require(jobs, {"submit_ts", "start_ts", "end_ts", "requested_cpus"}, "job metrics")
    slowdown = F.greatest(wait_sec() / F.greatest(run_sec(), F.lit(10)), F.lit(1.0))
    zero = F.lit(0.0)
    both = side_by_side([_totals(jobs, by), _tails(jobs, by, slowdown, nearest=True)], by)
    return both.select(
        *by,
        F.col("n").alias("job_count"),
        F.coalesce("mean_wait", zero).alias("mean_wait_sec"),
        F.coalesce("wait_p95", zero).alias("p95_wait_sec"),
        F.coalesce("bsld_p95", zero).alias("p95_bsld"),
        _span().alias("makespan_sec"),
        _utilisation(capacity_cpus).alias("utilization_mean"),
    )


def _starvation_columns(cap_sec: int) -> list[Column]:
    late = (wait_sec() > F.lit(cap_sec)).cast("double")
    return [
        F.coalesce(F.avg(late), F.lit(0.0)).alias("starved_rate"),
        F.coalesce(F.sum(late), F.lit(0.0)).alias("starved_jobs"),
        F.count("*").cast("double").alias("total_jobs"),
    ]


def starvation(jobs: DataFrame, cap_sec: int = STARVATION_CAP_SEC, by: Sequence[str] = ()) -> DataFrame:
    """Share and number of jobs that waited longer than the cap."""
    return jobs.groupBy(*by).agg(*_starvation_columns(cap_sec))


def user_usage(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """CPU-seconds per user."""
    if "user_id" not in jobs.columns:
        jobs = jobs.withColumn("user_id", F.lit(None).cast("string"))
    return jobs.groupBy(*by, user_key().alias("user_key")).agg(
        F.sum(F.col("requested_cpus").cast("double") * run_sec()).alias("cpu_sec")
    )


def fairness(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance of CPU-second shares from equal shares, Jain index, number of users."""
    usage = user_usage(jobs, by)
    totals = usage.groupBy(*by).agg(F.sum("cpu_sec").alias("total"), F.count("*").alias("users"))
    shares = with_group_totals(usage, totals, by)
    share = F.col("cpu_sec") / F.nullif(F.col("total"), F.lit(0.0))
    stats = shares.groupBy(*by).agg(
        F.max("total").alias("total"),
        F.max("users").alias("users"),
        F.sum(F.abs(share - 1.0 / F.col("users"))).alias("dev"),
        F.sum(share).alias("s1"),
        F.sum(share * share).alias("s2"),
    )
    used = F.coalesce(F.col("total"), F.lit(0.0)) > 0
    return stats.select(
        *by,
        F.when(used, 0.5 * F.col("dev")).otherwise(0.0).alias("fairness_dev"),
        F.when(used, F.col("s1") * F.col("s1") / (F.col("users") * F.col("s2"))).otherwise(1.0).alias("jain"),
        F.when(used, F.col("users").cast("double")).otherwise(0.0).alias("active_users"),
    )


def objective_metrics(
    jobs: DataFrame, capacity_cpus: int, cap_sec: int = STARVATION_CAP_SEC, by: Sequence[str] = ()
) -> DataFrame:
    """Everything the constraint contract and the scores are computed from."""
    require(jobs, {"submit_ts", "start_ts", "end_ts", "requested_cpus"}, "objective metrics")
    totals = _totals(jobs, by, _starvation_columns(cap_sec))
    both = side_by_side([totals, _tails(jobs, by, bounded_slowdown()), fairness(jobs, by)], by)
    return both.select(*by, *_job_columns(capacity_cpus), *OBJECTIVE[7:])


def infer_capacity(jobs: DataFrame) -> DataFrame:
    """Largest CPU count any job asked for or got; 64 when there is none."""
    peaks = [F.max(F.col(c).try_cast("bigint")) for c in ("requested_cpus", "allocated_cpus") if c in jobs.columns]
    if not peaks:
        peak = F.lit(None).cast("bigint")
    else:
        peak = F.greatest(*peaks) if len(peaks) > 1 else peaks[0]
    return jobs.agg(F.greatest(F.lit(1), F.coalesce(peak, F.lit(DEFAULT_CAPACITY))).cast("bigint").alias("capacity_cpus"))
