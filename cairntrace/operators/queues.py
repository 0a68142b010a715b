"""Queue depth, occupancy and arrival gaps over a whole trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairntrace.operators.facts import with_group_totals
from cairntrace.operators.ordered import (
    SLICE,
    TICK_WIDTH,
    clamped_sums,
    running,
    running_sums,
    slice_by_range,
    slice_by_time,
)
from cairntrace.schema import id_order, require, user_key


def _submits_and_starts(jobs: DataFrame) -> DataFrame:
    """Submit (kind 0, +) and start (kind 1, -) events of each job."""
    cpus = F.col("requested_cpus").cast("bigint")

    def event(ts: str, kind: int, sign: int) -> Column:
        return F.struct(
            F.col(ts).alias("ts"),
            F.lit(kind).alias("kind"),
            F.lit(sign).cast("bigint").alias("dj"),
            (cpus * sign).alias("dc"),
        )

    return jobs.select("job_id", F.inline(F.array(event("submit_ts", 0, 1), event("start_ts", 1, -1))))


def _net_per_tick(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net change of waiting jobs and CPUs per second, summed map-side before the shuffle."""
    cpus = F.col("requested_cpus").cast("bigint")

    def event(ts: str, sign: int) -> Column:
        return F.struct(F.col(ts).alias("ts"), F.lit(sign).cast("bigint").alias("dj"), (cpus * sign).alias("dc"))

    events = jobs.select(*by, F.inline(F.array(event("submit_ts", 1), event("start_ts", -1))))
    return (
        events.filter(F.col("ts").isNotNull())
        .groupBy(*by, "ts")
        .agg(F.sum("dj").alias("dj"), F.sum("dc").alias("dc"))
    )


def queue_at_submit(jobs: DataFrame) -> DataFrame:
    """Waiting jobs and CPUs each job finds at its submission, and the gap to the previous submission.

    Submissions count before starts of the same second; depths never go below zero.
    """
    require(jobs, {"job_id", "submit_ts", "start_ts", "requested_cpus"}, "queue at submit")
    events = _submits_and_starts(jobs)
    order: list[Column] = [F.col("ts"), F.col("kind"), *id_order(jobs)]
    sliced = slice_by_range(events, order)
    state = clamped_sums(sliced, order, {"q_jobs": F.col("dj"), "q_cpus": F.col("dc")})
    submitted = F.when(F.col("kind") == 0, F.col("ts"))
    state = running(state, order, previous={"prev_ts": submitted}, source=sliced)
    return state.filter(F.col("kind") == 0).select(
        "job_id",
        (F.col("q_jobs") - F.col("dj")).alias("queue_congestion_at_submit_jobs"),
        (F.col("q_cpus") - F.col("dc")).alias("queue_congestion_at_submit_cpu"),
        F.greatest(F.coalesce(F.col("ts") - F.col("prev_ts"), F.lit(0)), F.lit(0)).alias("time_since_prev_submit_sec"),
    )


def observed_queue(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Queue length per second with events, floored at zero as carried state."""
    require(jobs, {"submit_ts", "start_ts", "requested_cpus"}, "observed queue")
    ticks = slice_by_time(_net_per_tick(jobs, by))
    depth = {"queue_len_jobs": F.col("dj"), "queue_len_cpu_demand": F.col("dc")}
    return clamped_sums(ticks, [F.col("ts")], depth, by).select(*by, "ts", *depth)


def profile_queue(jobs: DataFrame) -> DataFrame:
    """Queue length per second with events, floored on output only."""
    require(jobs, {"submit_ts", "start_ts"}, "profile queue")
    ticks = slice_by_time(_net_per_tick(jobs.select("submit_ts", "start_ts", F.lit(0).alias("requested_cpus"))))
    out = running_sums(ticks, [F.col("ts")], {"net": F.col("dj")})
    return out.select("ts", F.col("dj").alias("delta"), F.greatest(F.col("net"), F.lit(0)).alias("queue_len_jobs"))


def grid(bounds: DataFrame, cadence_sec: int, by: Sequence[str] = ()) -> DataFrame:
    """Points start, start + cadence, ... up to end for each row (start_ts, end_ts) of `bounds`.

    Built in stretches that are spread over tasks before they expand.
    """
    if cadence_sec <= 0:
        raise ValueError("cadence_sec must be > 0")
    stretch = cadence_sec * max(1, TICK_WIDTH // cadence_sec)
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(cadence_sec).cast("bigint")
    return (
        bounds.filter(F.col("start_ts").isNotNull())
        .select(*by, F.col("start_ts").alias("lo"), F.greatest("start_ts", "end_ts").alias("hi"))
        .select(*by, "hi", F.explode(F.sequence("lo", "hi", F.lit(stretch).cast("bigint"))).alias("s"))
        .repartition(tasks, *by, "s")
        .select(*by, F.explode(F.sequence("s", F.least("hi", F.col("s") + F.lit(stretch - 1)), step)).alias("ts"))
    )


def resample_hold(
    series: DataFrame,
    cadence_sec: int = 60,
    bounds: DataFrame | None = None,
    values: Sequence[str] = ("queue_len_jobs",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Step series on a fixed grid: each point takes the latest non-null value at or before it, else 0.

    `bounds` holds (start_ts, end_ts) per group; by default the extent of the series.  A row of the
    series holds until the next one, and gives the grid points in between: points are neither sorted nor shuffled.
    """
    if cadence_sec <= 0:
        raise ValueError("cadence_sec must be > 0")
    if bounds is None:
        bounds = series.groupBy(*by).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    ends = bounds.filter(F.col("start_ts").isNotNull()).select(
        *by, F.col("start_ts").alias("_lo"), F.greatest("start_ts", "end_ts").alias("_hi")
    )
    nothing = [F.lit(None).cast("double").alias(v) for v in values]
    points = series.select(*by, "ts", *[F.col(v).cast("double").alias(v) for v in values])
    # one row opens each slice of the grid, so that a slice without a change has a row that holds
    width = F.lit(TICK_WIDTH).cast("bigint")
    opening = F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))
    marks = ends.select(*by, F.explode(opening).alias("_s")).select(*by, (F.col("_s") * width).alias("ts"), *nothing)
    sliced = slice_by_time(points.unionByName(marks))
    later = F.lead("ts").over(Window.partitionBy(SLICE, *by).orderBy("ts"))
    until = sliced.withColumn("_until", F.coalesce(later, (F.col(SLICE) + 1) * width))
    held = running(until, [F.col("ts")], by, lasts={f"held_{v}": F.col(v) for v in values}, source=sliced)
    held = with_group_totals(held, ends, by)
    step = F.lit(cadence_sec).cast("bigint")
    first = F.col("_lo") + step * F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("ts") - F.col("_lo")) / step))
    runs = held.withColumns({"_first": first, "_last": F.least(F.col("_until") - 1, "_hi")}).filter("_first <= _last")
    return runs.select(
        *by,
        F.explode(F.sequence("_first", "_last", step)).alias("ts"),
        *[F.coalesce(f"held_{v}", F.lit(0.0)).alias(v) for v in values],
    )


def submit_gaps(jobs: DataFrame) -> DataFrame:
    """Seconds since the previous submission, over all jobs and per user (first of each: 0)."""
    require(jobs, {"job_id", "submit_ts", "user_id"}, "submit gaps")
    slim = jobs.select("job_id", "submit_ts", user_key().alias("user_key"))
    order = [F.col("submit_ts"), *id_order(jobs)]
    everyone = slice_by_range(slim, order)
    out = running(everyone, order, previous={"prev_ts": F.col("submit_ts")}).drop("_slice")
    sliced = slice_by_range(out, [F.col("user_key"), *order])
    out = running(sliced, order, ["user_key"], previous={"user_prev_ts": F.col("submit_ts")})

    def gap(prev: str) -> Column:
        return F.greatest(F.coalesce(F.col("submit_ts") - F.col(prev), F.lit(0)), F.lit(0))

    return out.select(
        "job_id",
        gap("prev_ts").alias("time_since_prev_submit_sec"),
        gap("user_prev_ts").alias("user_submit_gap_sec_lookback"),
    )


def occupancy(jobs: DataFrame, capacity_cpus: int) -> DataFrame:
    """Running and free CPUs after each second in which a job starts or ends."""
    require(jobs, {"start_ts", "end_ts", "requested_cpus"}, "occupancy")
    cpus = F.col("requested_cpus").cast("bigint")
    deltas = jobs.select(F.col("start_ts").alias("ts"), cpus.alias("d")).unionByName(
        jobs.select(F.col("end_ts").alias("ts"), (-cpus).alias("d"))
    )
    ticks = slice_by_time(deltas.groupBy("ts").agg(F.sum("d").alias("d")))
    out = running_sums(ticks, [F.col("ts")], {"running_cpus": F.col("d")})
    return out.select("ts", "running_cpus", (F.lit(capacity_cpus) - F.col("running_cpus")).alias("free_cpus"))


def free_at(jobs: DataFrame, capacity_cpus: int, points: DataFrame) -> DataFrame:
    """Free CPUs at the given times (column `ts`): a look-up in the occupancy step function."""
    steps = occupancy(jobs, capacity_cpus).select("ts", F.lit(0).alias("probe"), F.col("free_cpus").alias("v"))
    probes = points.select("ts").distinct().select("ts", F.lit(1).alias("probe"), F.lit(None).cast("bigint").alias("v"))
    sliced = slice_by_time(steps.unionByName(probes))
    held = running(sliced, [F.col("ts"), F.col("probe")], lasts={"held": F.col("v")})
    return held.filter(F.col("probe") == 1).select("ts", F.coalesce("held", F.lit(capacity_cpus)).alias("free_cpus"))


def capacity_violations(jobs: DataFrame, capacity_cpus: int) -> DataFrame:
    """Seconds after which more CPUs run than exist."""
    return occupancy(jobs, capacity_cpus).filter(F.col("running_cpus") > capacity_cpus)


def queue_rank(jobs: DataFrame, policy: str, snapshot: str) -> DataFrame:
    """Position of each queued job in its snapshot under an ordering policy."""
    first = {
        "fifo": None,
        "shortest_first": F.col("runtime_estimate_sec"),
        "longest_first": -F.col("runtime_estimate_sec"),
        "fairshare": -F.coalesce(F.col("priority_score"), F.lit(0.0)),
    }
    if policy not in first:
        raise ValueError(f"unsupported policy {policy!r}")
    lead = first[policy]
    keyed = jobs if lead is None else jobs.withColumn("_lead", lead)
    order = ([] if lead is None else [F.col("_lead")]) + [F.col("submit_ts"), *id_order(jobs)]
    sliced = slice_by_range(keyed, [F.col(snapshot), *order])
    out = running_sums(sliced, order, {"queue_rank": F.lit(1).cast("bigint")}, [snapshot])
    return out.drop("_slice", "_lead")


def fifo_prefix(queue: DataFrame, snapshot: str, free: str = "free_cpus") -> DataFrame:
    """Jobs a strict FIFO pass would start per snapshot: in order until the first that does not fit.

    Requests are positive, so everything before the first misfit is exactly the rows
    whose running CPU sum stays within the free count.
    """
    order = [F.col("submit_ts"), *id_order(queue)]
    sliced = slice_by_range(queue.filter(F.col("requested_cpus") > 0), [F.col(snapshot), *order])
    out = running_sums(sliced, order, {"cpus_so_far": F.col("requested_cpus").cast("bigint")}, [snapshot])
    return out.filter(F.col("cpus_so_far") <= F.col(free)).drop("_slice")
