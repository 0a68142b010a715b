"""Synthetic stress traces: reproducible per (id, seed), whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.operators.facts import fact
from cairntrace.operators.ordered import SLICE, row_index, running_sums, slice_by_range
from cairntrace.operators.quantiles import quantiles

PRIME = 2147483647
SLICE_IDS = 1 << 16

# Ranges of the base trace and the scenarios.
CPU_CHOICES = (1, 2, 4, 8, 16)
WEEK = 7 * 86400
HEAVY_TAIL_ALPHA = 1.2
TARGET_UTIL = 0.35
TOP_USER_SHARE = 0.65
BURST_FACTOR, BURST_SPAN = 4, 1800


def draw(column: Column, seed: int, stream: int) -> Column:
    """Pseudo-random integer in [0, PRIME) from an id: two rounds of modular mixing."""
    x = (column * 48271 + F.lit(seed * 69621 + stream * 40692)) % PRIME
    return (x * x % PRIME * 16807 + x) % PRIME


def between(column: Column, seed: int, stream: int, low: int, high: int) -> Column:
    return F.lit(low) + draw(column, seed, stream) % F.lit(high - low + 1)


def gen_jobs(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Base trace for ids 1..n (column `id`): gaps 1-30 s, run 60-3600 s, wait 0-300 s, 40 users."""
    i = F.col("id")
    sliced = ids.select("id", between(i, seed, 1, 1, 30).alias("gap"), F.floor(i / SLICE_IDS).alias(SLICE))
    timed = running_sums(sliced, [i], {"submit_ts": F.col("gap")})
    cpus = F.array(*[F.lit(c) for c in CPU_CHOICES])
    df = timed.select(
        i.alias("job_id"),
        "submit_ts",
        between(i, seed, 3, 0, 300).alias("wait_sec"),
        between(i, seed, 2, 60, 3600).alias("runtime_actual_sec"),
        F.element_at(cpus, (between(i, seed, 5, 1, 5)).cast("int")).alias("allocated_cpus"),
        F.element_at(cpus, (between(i, seed, 6, 1, 5)).cast("int")).alias("requested_cpus"),
        F.lit(None).cast("bigint").alias("requested_mem"),
        F.lit(1).alias("status"),
        between(i, seed, 7, 1, 40).alias("user_id"),
        between(i, seed, 8, 1, 10).alias("group_id"),
        F.lit(1).alias("queue_id"),
        F.lit(1).alias("partition_id"),
        between(i, seed, 4, 1000, 2500).alias("_thousandths"),
    )
    # The request is the run time times 1.000 .. 2.500.
    df = df.withColumn("runtime_requested_sec", F.expr("runtime_actual_sec * _thousandths DIV 1000"))
    return consistent(df.drop("_thousandths"))


def gen_trace(spark: SparkSession, n_jobs: int, seed: int = 42) -> DataFrame:
    return gen_jobs(spark.range(1, n_jobs + 1), seed)


def consistent(jobs: DataFrame) -> DataFrame:
    """Recompute start, end and ratio from submit, wait, run and request."""
    return jobs.withColumns({"start_ts": F.col("submit_ts") + F.col("wait_sec")}).withColumns(
        {
            "end_ts": F.col("start_ts") + F.col("runtime_actual_sec"),
            "runtime_overrequest_ratio": F.col("runtime_requested_sec").cast("double") / F.col("runtime_actual_sec"),
        }
    )


def heavy_tail(base: DataFrame, seed: int = 42, alpha: float = HEAVY_TAIL_ALPHA) -> DataFrame:
    """Pareto run times from 120 s up to a week, requests 1.5 times that."""
    u = (draw(F.col("job_id"), seed, 9) + 1) / F.lit(float(PRIME))
    run = F.least(F.floor(60.0 * (1.0 + F.pow(u, F.lit(-1.0 / alpha)))), F.lit(WEEK)).cast("bigint")
    out = base.withColumn("runtime_actual_sec", run)
    return consistent(out.withColumn("runtime_requested_sec", F.expr("runtime_actual_sec * 3 DIV 2")))


def low_congestion(base: DataFrame, target_util: float = TARGET_UTIL) -> DataFrame:
    """Evenly spaced submissions that never wait."""
    spacing = int(max(10, 1.0 / max(target_util, 0.05) * 30))
    return consistent(base.withColumns({"submit_ts": F.col("job_id") * spacing, "wait_sec": F.lit(0).cast("bigint")}))


def user_skew(base: DataFrame, top_user_share: float = TOP_USER_SHARE) -> DataFrame:
    """The first share of the jobs belongs to user 1."""
    n = fact(base.agg(F.count("*").alias("n"))).getField("n")
    first = F.col("job_id") <= F.floor(n * F.lit(top_user_share))
    return base.withColumn("user_id", F.when(first, F.lit(1).cast("bigint")).otherwise(F.col("user_id")))


def burst_shock(base: DataFrame, factor: int = BURST_FACTOR, span_sec: int = BURST_SPAN) -> DataFrame:
    """Submissions of a span after the 40 % point arrive `factor` times as fast; jobs renumbered."""
    start = fact(quantiles(base, {"s": F.col("submit_ts")}, [0.4])).getField("s_p40").cast("bigint")
    moved = base.withColumn("_from", start)
    inside = (F.col("submit_ts") >= F.col("_from")) & (F.col("submit_ts") < F.col("_from") + span_sec)
    squeezed = F.col("_from") + F.floor((F.col("submit_ts") - F.col("_from")) / factor).cast("bigint")
    moved = moved.withColumn("submit_ts", F.when(inside, squeezed).otherwise(F.col("submit_ts"))).drop("_from")
    order = [F.col("submit_ts"), F.col("job_id")]
    ranked = row_index(slice_by_range(moved, order), order)
    return consistent(ranked.withColumn("job_id", F.col("row_idx") + 1).drop(SLICE, "row_idx", "row_idx_rows"))


SCENARIOS = {
    "heavy_tail": heavy_tail,
    "low_congestion": low_congestion,
    "user_skew": user_skew,
    "burst_shock": burst_shock,
}


def scenario(base: DataFrame, name: str, **params) -> DataFrame:
    """A stress scenario of a base trace."""
    if name not in SCENARIOS:
        raise ValueError(f"unsupported scenario {name!r}: use one of {sorted(SCENARIOS)}")
    return SCENARIOS[name](base, **params)
