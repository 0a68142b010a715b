"""Bringing job tables into the shape an analysis needs; run-time estimates; row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.functions.scalars import day_of_week, hour_of_day
from cairntrace.operators.facts import fact
from cairntrace.operators.history import fairshare, tsafrir
from cairntrace.operators.ordered import SLICE, row_index, slice_by_range
from cairntrace.operators.quantiles import quantiles
from cairntrace.schema import OPTIONAL, require, with_optional

# Heuristic used when no model is available.
HEURISTIC_BASE_SEC = 1800
HEURISTIC_P50, HEURISTIC_P90 = 0.72, 1.08
HEURISTIC_DEPTH_CAP, HEURISTIC_DEPTH_SCALE = 2000, 10000.0
HEURISTIC_MIN_SEC = 60

TRAINING_FEATURES = [
    "requested_cpus",
    "runtime_requested_sec",
    "requested_mem",
    "queue_id",
    "partition_id",
    "user_id",
    "group_id",
    "submit_hour",
    "submit_dow",
    "user_overrequest_mean_lookback",
    "user_runtime_median_lookback",
    "queue_congestion_at_submit_jobs",
]


def _whole(name: str) -> Column:
    return F.col(name).try_cast("double").try_cast("bigint")


def coerce_features(jobs: DataFrame) -> DataFrame:
    """Rows usable for features: numeric times and CPUs, run time >= 0, CPUs >= 1."""
    needed = ["submit_ts", "start_ts", "end_ts", "runtime_actual_sec", "requested_cpus"]
    require(jobs, {"job_id", *needed}, "feature build")
    df = with_optional(jobs).withColumns({c: _whole(c) for c in needed}).dropna(subset=["job_id", *needed])
    return df.withColumns(
        {
            "runtime_actual_sec": F.greatest("runtime_actual_sec", F.lit(0)),
            "requested_cpus": F.greatest("requested_cpus", F.lit(1)).cast("int"),
            "runtime_requested_sec": _whole("runtime_requested_sec"),
            "requested_mem": _whole("requested_mem"),
        }
    )


def _with_requested_cpus(jobs: DataFrame) -> DataFrame:
    if "requested_cpus" in jobs.columns:
        return jobs
    if "allocated_cpus" not in jobs.columns:
        raise ValueError("trace requires requested_cpus or allocated_cpus")
    return jobs.withColumn("requested_cpus", F.col("allocated_cpus"))


def coerce_trace(jobs: DataFrame) -> DataFrame:
    """Rows usable as a workload, with `runtime_estimate_sec` = request if positive, else actual."""
    require(jobs, {"job_id", "submit_ts", "runtime_actual_sec"}, "trace")
    df = with_optional(_with_requested_cpus(jobs))
    needed = ["submit_ts", "runtime_actual_sec", "requested_cpus"]
    df = df.withColumns({c: _whole(c) for c in needed}).dropna(subset=["job_id", *needed])
    asked = _whole("runtime_requested_sec")
    df = df.withColumns(
        {
            "runtime_actual_sec": F.greatest("runtime_actual_sec", F.lit(0)),
            "requested_cpus": F.greatest("requested_cpus", F.lit(1)).cast("int"),
            "runtime_requested_sec": F.when(asked > 0, asked),
        }
    )
    return df.withColumn("runtime_estimate_sec", F.coalesce("runtime_requested_sec", "runtime_actual_sec"))


def observed_jobs(jobs: DataFrame) -> DataFrame:
    """Rows with known submit, start and end; CPUs >= 1."""
    require(jobs, {"job_id", "submit_ts", "start_ts", "end_ts"}, "observed jobs")
    needed = ["submit_ts", "start_ts", "end_ts", "requested_cpus"]
    df = _with_requested_cpus(jobs).withColumns({c: _whole(c) for c in needed}).dropna(subset=["job_id", *needed])
    return df.withColumn("requested_cpus", F.greatest("requested_cpus", F.lit(1)).cast("int"))


def training_frame(df: DataFrame) -> DataFrame:
    """Features and target for model training: neutral defaults, non-positive requests null, run time >= 1."""
    require(df, {"submit_ts", "runtime_actual_sec", "requested_cpus"}, "training dataset")
    given = set(df.columns)
    df = with_optional(df, [c for c in OPTIONAL])
    needed = ["submit_ts", "runtime_actual_sec", "requested_cpus"]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in needed}).dropna(subset=needed)
    asked, mem = F.col("runtime_requested_sec").try_cast("double"), F.col("requested_mem").try_cast("double")
    df = df.withColumns(
        {
            "submit_ts": F.col("submit_ts").cast("bigint"),
            "runtime_actual_sec": F.greatest("runtime_actual_sec", F.lit(1.0)),
            "requested_cpus": F.greatest("requested_cpus", F.lit(1.0)),
            "runtime_requested_sec": F.when(asked > 0, asked),
            "requested_mem": F.when(mem > 0, mem),
        }
    )
    any_mem = fact(df.agg(F.count("requested_mem").alias("n"))).getField("n") > 0
    ratio = F.lit(1.0)
    if "user_overrequest_mean_lookback" in given:
        ratio = F.coalesce(F.col("user_overrequest_mean_lookback").try_cast("double"), F.lit(1.0))
    median = F.lit(1.0)
    if "user_runtime_median_lookback" in given:
        fill = fact(quantiles(df, {"run": F.col("runtime_actual_sec")}, [0.5])).getField("run_p50")
        median = F.coalesce(F.col("user_runtime_median_lookback").try_cast("double"), fill)
    depth = F.lit(0)
    if "queue_congestion_at_submit_jobs" in given:
        depth = F.coalesce(_whole("queue_congestion_at_submit_jobs"), F.lit(0))
    return df.withColumns(
        {
            "requested_mem": F.when(any_mem, F.col("requested_mem")).otherwise(F.lit(0.0)),
            "submit_hour": hour_of_day(F.col("submit_ts")),
            "submit_dow": day_of_week(F.col("submit_ts")),
            "user_overrequest_mean_lookback": ratio,
            "user_runtime_median_lookback": median,
            "queue_congestion_at_submit_jobs": depth.cast("bigint"),
        }
    )


def eval_frame(df: DataFrame) -> DataFrame:
    """Add feature columns a scored table lacks; hour and weekday come from the submit time."""
    absent = {c: F.lit(None).cast("double") for c in TRAINING_FEATURES if c not in df.columns}
    out = df.withColumns(absent) if absent else df
    if "submit_ts" in df.columns:
        ts = F.col("submit_ts").try_cast("bigint")
        out = out.withColumns(
            {
                "submit_hour": F.coalesce(F.col("submit_hour").cast("int"), hour_of_day(ts)),
                "submit_dow": F.coalesce(F.col("submit_dow").cast("int"), day_of_week(ts)),
            }
        )
    return out


# --------------------------------------------------------------------------- run-time estimates


def _asked_or_actual() -> tuple[Column, Column]:
    asked = _whole("runtime_requested_sec")
    has = F.coalesce(asked > 0, F.lit(False))
    return F.when(has, asked).otherwise(F.col("runtime_actual_sec").cast("bigint")), has


def attach_estimates(
    jobs: DataFrame,
    mode: str = "default",
    predictions: DataFrame | None = None,
    guard_k: float = 0.5,
) -> DataFrame:
    """Add p50/p90/guard/estimate run times and their source.

    default    request if positive, else actual
    fairshare  default plus `priority_score`
    tsafrir    the user's two latest completions
    p50, p10   predictions (job_id, p10, p50, p90) where there are any, else default
    """
    estimate, has = _asked_or_actual()
    names = ["runtime_p50_sec", "runtime_p90_sec", "runtime_guard_sec", "runtime_estimate_sec"]
    if mode in ("default", "fairshare"):
        source = F.when(has, "requested_fallback").otherwise("actual_fallback")
        out = jobs.withColumns({**{n: estimate for n in names}, "estimate_source": source})
        return out.join(fairshare(jobs), "job_id") if mode == "fairshare" else out
    if mode == "tsafrir":
        out = tsafrir(jobs.withColumn("runtime_estimate_sec", estimate))
        source = (
            F.when(F.col("tsafrir_history_count") >= 2, "tsafrir_history_2")
            .when(F.col("tsafrir_history_count") >= 1, "tsafrir_history_1")
            .otherwise("tsafrir_cold_start")
        )
        return out.withColumns({**{n: F.col("tsafrir_runtime_sec") for n in names}, "estimate_source": source})
    if mode not in ("p50", "p10"):
        raise ValueError(f"unsupported estimate mode {mode!r}")
    if predictions is None:
        raise ValueError("prediction modes need a predictions table")
    preds = predictions.select("job_id", *[F.col(q).alias(f"_{q}") for q in ("p10", "p50", "p90")])
    df = jobs.join(preds, "job_id", "left")
    known = F.col("_p50").isNotNull()

    def half_even(c: Column) -> Column:
        return F.bround(c).cast("bigint")

    p50 = F.greatest(F.lit(1), half_even(F.col("_p50")))
    p90 = F.greatest(p50, half_even(F.col("_p90")))
    p10 = F.greatest(F.lit(1), half_even(F.col("_p10")))
    if mode == "p10":
        chosen, guard = p10, half_even(p10 + F.lit(float(guard_k)) * (p50 - p10))
    else:
        chosen, guard = p50, half_even(p50 + F.lit(float(guard_k)) * (p90 - p50))
    return df.withColumns(
        {
            "runtime_p50_sec": F.when(known, p50).otherwise(estimate),
            "runtime_p90_sec": F.when(known, p90).otherwise(estimate),
            "runtime_guard_sec": F.greatest(F.lit(1), F.when(known, guard).otherwise(estimate)),
            "runtime_estimate_sec": F.when(known, chosen).otherwise(estimate),
            "estimate_source": F.when(known, "prediction").when(has, "requested_fallback").otherwise("actual_fallback"),
        }
    ).drop("_p10", "_p50", "_p90")


# Estimate sources behind each counter.
SOURCE_COUNTERS = {
    "prediction_used": ("prediction",),
    "requested_fallback": ("requested_fallback",),
    "actual_fallback": ("actual_fallback",),
    "tsafrir_history": ("tsafrir_history_1", "tsafrir_history_2"),
    "tsafrir_cold_start": ("tsafrir_cold_start",),
}


def estimate_accounting(jobs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many jobs, and which share, took their estimate from each source."""
    used = {k: F.count_if(F.col("estimate_source").isin(*names)) for k, names in SOURCE_COUNTERS.items()}
    total = F.greatest(F.count("*"), F.lit(1))
    return jobs.groupBy(*by).agg(
        *[c.alias(f"{k}_count") for k, c in used.items()],
        *[(c / total).alias(f"{k}_rate") for k, c in used.items()],
        F.count("*").alias("total_scheduled_jobs"),
    )


def prediction_features(jobs: DataFrame) -> DataFrame:
    """Model inputs per job with the defaults used when history is not known yet."""
    have = set(jobs.columns)

    def or_default(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    df = with_optional(jobs)
    asked = _whole("runtime_requested_sec")
    return df.select(
        "job_id",
        "submit_ts",
        "requested_cpus",
        asked.alias("runtime_requested_sec"),
        "requested_mem",
        "queue_id",
        "partition_id",
        "user_id",
        "group_id",
        or_default("user_overrequest_mean_lookback", F.lit(1.0)).cast("double").alias("user_overrequest_mean_lookback"),
        or_default("user_runtime_median_lookback", asked).cast("bigint").alias("user_runtime_median_lookback"),
        or_default("queue_congestion_at_submit_jobs", F.lit(0)).cast("bigint").alias("queue_congestion_at_submit_jobs"),
    )


def heuristic_estimates(df: DataFrame, guard_k: float = 0.5) -> DataFrame:
    """Run-time estimates without a model, from the request and the queue depth (`queue_depth_jobs`)."""
    asked = F.col("runtime_requested_sec").cast("double")
    base = F.when(asked != 0, asked).otherwise(F.lit(float(HEURISTIC_BASE_SEC)))
    depth = F.coalesce(F.col("queue_depth_jobs"), F.lit(0))
    factor = F.lit(1.0) + F.least(depth, F.lit(HEURISTIC_DEPTH_CAP)) / F.lit(HEURISTIC_DEPTH_SCALE)
    p50 = F.greatest(F.lit(HEURISTIC_MIN_SEC), (base * F.lit(HEURISTIC_P50) * factor).cast("bigint"))
    p90 = F.greatest(p50, (base * F.lit(HEURISTIC_P90) * factor).cast("bigint"))
    return df.withColumns({"runtime_p50_sec": p50, "runtime_p90_sec": p90}).withColumn(
        "runtime_guard_sec",
        (F.col("runtime_p50_sec") + F.lit(float(guard_k)) * (F.col("runtime_p90_sec") - F.col("runtime_p50_sec"))).cast("bigint"),
    )


# --------------------------------------------------------------------------- row checks, events, snapshots


def job_violations(jobs: DataFrame) -> DataFrame:
    """Jobs whose times or CPUs contradict each other, with the list of failed checks."""
    checks = {
        "job_start_before_submit": F.col("start_ts") < F.col("submit_ts"),
        "job_end_before_start": F.col("end_ts") < F.col("start_ts"),
        "job_nonpositive_cpu": F.col("requested_cpus") <= 0,
    }
    failed = F.array_remove(F.array(*[F.when(c, F.lit(n)).otherwise("") for n, c in checks.items()]), "")
    out = jobs.select("job_id", failed.alias("failed_invariants"), F.lit("error").alias("severity"))
    return out.filter(F.size("failed_invariants") > 0)


# Order of events within one second.
EVENT_ORDER = {"complete": 0, "submit": 1, "dispatch": 2}


def event_rank() -> Column:
    rank = F.lit(None).cast("int")
    for name, n in EVENT_ORDER.items():
        rank = F.when(F.col("event_type") == name, n).otherwise(rank)
    return rank


def event_keys(events: DataFrame, tie: str | None = None) -> list[Column]:
    """Sort keys of events: time, then complete < submit < dispatch, then job id (missing ids first), then `tie`."""
    return [F.col("ts"), event_rank(), F.coalesce(F.col("job_id"), F.lit(-1)), *([F.col(tie)] if tie else [])]


def order_events(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Events globally sorted by `event_keys`."""
    return events.orderBy(*event_keys(events, tie))


def event_positions(events: DataFrame, tie: str) -> DataFrame:
    """Events with their place `pos` in the order of `order_events`, `tie` (unique) deciding among equal ones."""
    names = ["_ts", "_rank", "_id", "_tie"]
    keyed = events.withColumns(dict(zip(names, event_keys(events, tie), strict=True)))
    order = [F.col(n) for n in names]
    return row_index(slice_by_range(keyed, order), order, name="pos").drop(SLICE, *names)


_QUEUED = (
    "array<struct<job_id:bigint,submit_ts:bigint,requested_cpus:bigint,runtime_estimate_sec:bigint,"
    "runtime_p90_sec:bigint,runtime_guard_sec:bigint,estimate_source:string>>"
)
_RUNNING = "array<struct<job_id:bigint,end_ts:bigint,allocated_cpus:bigint>>"
SNAPSHOT_SCHEMA = (
    "clock_ts bigint, capacity_cpus bigint, free_cpus bigint, "
    f"queued_jobs {_QUEUED}, running_jobs {_RUNNING}"
)


def parse_snapshots(documents: DataFrame) -> DataFrame:
    """Snapshots of JSON text `value` that are complete and consistent (0 <= free <= capacity, capacity > 0)."""
    df = documents.select(F.from_json("value", SNAPSHOT_SCHEMA).alias("s")).select("s.*").dropna()
    return df.filter(
        (F.col("capacity_cpus") > 0) & (F.col("free_cpus") >= 0) & (F.col("free_cpus") <= F.col("capacity_cpus"))
    )


def explode_snapshot(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued and running jobs of snapshot documents; negative run times count as 0."""
    snapshots = parse_snapshots(documents)
    head = ["clock_ts", "capacity_cpus", "free_cpus"]
    floor0 = ["runtime_estimate_sec", "runtime_p90_sec", "runtime_guard_sec"]
    queued = snapshots.select(*head, F.inline("queued_jobs"))
    queued = queued.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c))) for c in floor0})
    return queued, snapshots.select(*head, F.inline("running_jobs"))


def state_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of each row as JSON with its columns in name order."""
    canonical = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.withColumn("state_hash", F.sha2(canonical, 256))
