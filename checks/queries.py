"""Registered queries over the test tables, named as in `oracles.py`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions import scalars as sc
from cairntrace.operators import (
    accuracy,
    coerce,
    compare,
    decide,
    features,
    generate,
    history,
    invariants,
    metrics,
    placement,
    profile,
    quality,
    queues,
    sliding,
)
from cairntrace.plans import fixtures as fx
from cairntrace.sources import live, pbs, replay, sacct, swf

CAPACITY = 128
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on_jobs(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """Register a query that starts from the derived job table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fx.jobs(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns (a per-column digit count overrides)."""

    def one(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        return (F.round(F.col(name), special.get(name, digits)) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, t) for n, t in df.dtypes])


def joined(c: str) -> Column:
    return F.array_join(F.col(c), ",").alias(c)


# --------------------------------------------------------------------------- metrics


@on_jobs
def objective_metrics(jobs):
    return rounded(metrics.objective_metrics(jobs, CAPACITY), 9)


@on_jobs
def objective_by_policy(jobs):
    return rounded(metrics.objective_metrics(fx.candidates(jobs), CAPACITY, by=["policy_id"]), 8)


@on_jobs
def job_metrics_nearest(jobs):
    return rounded(metrics.job_metrics_nearest(jobs, CAPACITY), 8)


@on_jobs
def starvation(jobs):
    return rounded(metrics.starvation(jobs, by=["queue_id"]), 9)


@on_jobs
def fairness_by_user(jobs):
    """Usage and share of each user."""
    usage = metrics.user_usage(jobs)
    total = usage.agg(F.sum("cpu_sec")).scalar()
    return usage.select("user_key", "cpu_sec", F.round(F.col("cpu_sec") / total, 9).alias("share"))


@on_jobs
def fairness(jobs):
    return rounded(metrics.fairness(jobs, by=["queue_id"]), 9)


@on_jobs
def infer_capacity(jobs):
    return metrics.infer_capacity(jobs)


# --------------------------------------------------------------------------- sources


@on_jobs
def swf_parse(jobs):
    return rounded(swf.parse(fx.raw_swf(jobs)))


@on_jobs
def swf_line_stats(jobs):
    return swf.line_stats(fx.raw_swf(jobs))


@on_jobs
def sacct_parse(jobs):
    return sacct.parse(fx.raw_sacct(jobs)).drop("runtime_requested_sec", "runtime_overrequest_ratio")


@on_jobs
def sacct_line_stats(jobs):
    return sacct.parse_stats(fx.raw_sacct(jobs))


def _headed_dump(lines, folder):
    """Write sacct lines with the columns turned round, each file with its header."""
    names = sacct.DEFAULT_COLUMNS
    fields = [F.get("t", F.lit(i)).alias(n) for i, n in reversed(list(enumerate(names)))]
    turned = lines.select(F.split("value", r"\|").alias("t")).select(*fields)
    turned.write.mode("append").csv(folder, sep="|", header=True, quote="\0", emptyValue="", nullValue="")


@query
def sacct_mixed_headers(spark, sf_dir):
    """Half of the dump in files without a header, half in files with another column order."""
    folder = scratch(spark, "sacct")
    lines = fx.raw_sacct(fx.jobs(spark, sf_dir))
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    lines.where(half == 0).write.mode("append").text(folder)
    _headed_dump(lines.where(half == 1), folder)
    return sacct.read_sacct(spark, folder).drop("runtime_requested_sec", "runtime_overrequest_ratio")


@on_jobs
def pbs_parse(jobs):
    return rounded(pbs.parse(fx.raw_pbs(jobs)))


@on_jobs
def pbs_line_stats(jobs):
    return pbs.parse_stats(fx.raw_pbs(jobs))


@on_jobs
def sacct_extract_parse(jobs):
    return live.parse_sacct_extract(fx.raw_extract(jobs))


@on_jobs
def qstat_json_parse(jobs):
    return live.parse_qstat_json(fx.raw_qstat(jobs)).drop("group")


@on_jobs
def live_to_canonical(jobs):
    return live.live_to_canonical(live.parse_sacct_extract(fx.raw_extract(jobs)))


@on_jobs
def sync_summary(jobs):
    rows = live.parse_sacct_extract(fx.raw_extract(jobs))
    return live.sync_summary(rows, fx.predictions(jobs).filter("job_id % 3 <> 0"))


@on_jobs
def replay_csv_import(jobs):
    return replay.import_replay(fx.replay_rows(jobs), fx.replay_workload(jobs))


@on_jobs
def workload_export_jobs(jobs):
    return replay.export_workload(jobs, 64)[0]


@on_jobs
def workload_export_profiles(jobs):
    return replay.export_workload(jobs, 64)[1]


@on_jobs
def jobs_json_export(jobs):
    return replay.export_jobs_json(jobs)


# --------------------------------------------------------------------------- quality


@on_jobs
def quality_report(jobs):
    lines = fx.raw_swf(jobs)
    return rounded(quality.quality_report(swf.parse(lines), swf.parse_stats(lines)), 9)


@on_jobs
def null_rates(jobs):
    return rounded(quality.null_rates(jobs), 9)


@query
def suite_verify(spark, sf_dir):
    """Hashes of documents against a manifest with missing, changed and unlocked entries."""
    docs = fx.table(spark, sf_dir, "documents")
    files = docs.filter("doc_id % 5 <> 0").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"), F.sha2("text", 256).alias("sha256")
    )
    expected = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("other"), 256)).when(
        F.col("doc_id") % 7 != 0, F.sha2("text", 256)
    )
    manifest = docs.filter("doc_id % 3 <> 0").select(
        F.concat(F.lit("t"), F.col("doc_id")).alias("trace_id"),
        F.concat(F.lit("doc"), F.col("doc_id")).alias("filename"),
        expected.alias("sha256"),
    )
    return quality.verify_suite(files, manifest)


# --------------------------------------------------------------------------- coercion, checks, estimates


@on_jobs
def coerce_features(jobs):
    messy = jobs.withColumns(
        {
            "runtime_actual_sec": F.expr("CASE WHEN job_id % 19 = 0 THEN -5 ELSE runtime_actual_sec END"),
            "requested_cpus": F.expr("CASE WHEN job_id % 23 = 0 THEN 0 ELSE requested_cpus END"),
            "start_ts": F.expr("CASE WHEN job_id % 29 = 0 THEN NULL ELSE start_ts END"),
        }
    ).drop("partition_id")
    keep = ["job_id", "submit_ts", "start_ts", "runtime_actual_sec", "requested_cpus", "partition_id"]
    return coerce.coerce_features(messy).select(*keep)


@on_jobs
def coerce_trace(jobs):
    messy = jobs.withColumn(
        "runtime_requested_sec", F.expr("CASE WHEN job_id % 6 = 0 THEN 0 ELSE runtime_requested_sec END")
    )
    return coerce.coerce_trace(messy.drop("requested_cpus")).select(
        "job_id", "submit_ts", "runtime_actual_sec", "requested_cpus", "runtime_requested_sec", "runtime_estimate_sec"
    )


@on_jobs
def observed_jobs(jobs):
    gaps = jobs.withColumn("end_ts", F.expr("CASE WHEN job_id % 31 = 0 THEN NULL ELSE end_ts END"))
    return coerce.observed_jobs(gaps).select("job_id", "submit_ts", "start_ts", "end_ts", "requested_cpus")


@on_jobs
def training_frame(jobs):
    with_history = jobs.withColumn("user_runtime_median_lookback", F.expr("IF(job_id % 4 = 0, NULL, wait_sec)"))
    out = coerce.training_frame(with_history)
    return rounded(out.select("job_id", *coerce.TRAINING_FEATURES, "runtime_actual_sec"))


@on_jobs
def eval_frame(jobs):
    return coerce.eval_frame(jobs.drop("queue_id")).select(
        "job_id", "submit_hour", "submit_dow", F.col("queue_id").cast("double").alias("queue_id"), "requested_cpus"
    )


@on_jobs
def attach_estimates_default(jobs):
    return _estimates(coerce.attach_estimates(jobs, "default"))


@on_jobs
def attach_estimates(jobs):
    preds = fx.predictions(jobs).filter("job_id % 4 <> 0")
    return _estimates(coerce.attach_estimates(jobs, "p50", preds, 0.5))


@on_jobs
def attach_estimates_p10(jobs):
    preds = fx.predictions(jobs).filter("job_id % 4 <> 0")
    return _estimates(coerce.attach_estimates(jobs, "p10", preds, 0.25))


@on_jobs
def attach_estimates_history(jobs):
    return _estimates(coerce.attach_estimates(jobs, "tsafrir"))


def _estimates(df: DataFrame) -> DataFrame:
    cols = ["runtime_p50_sec", "runtime_p90_sec", "runtime_guard_sec", "runtime_estimate_sec"]
    return df.select("job_id", *[F.col(c).cast("bigint").alias(c) for c in cols], "estimate_source")


@on_jobs
def estimate_accounting(jobs):
    preds = fx.predictions(jobs).filter("job_id % 4 <> 0")
    return rounded(coerce.estimate_accounting(coerce.attach_estimates(jobs, "p50", preds)), 9)


@on_jobs
def prediction_features(jobs):
    return coerce.prediction_features(jobs)


@on_jobs
def heuristic_estimates(jobs):
    depth = jobs.withColumn("queue_depth_jobs", F.col("wait_sec") % 5000)
    cols = ["runtime_p50_sec", "runtime_p90_sec", "runtime_guard_sec"]
    return coerce.heuristic_estimates(depth).select("job_id", *[F.col(c).cast("bigint").alias(c) for c in cols])


@on_jobs
def job_violations(jobs):
    messy = jobs.withColumns(
        {
            "start_ts": F.expr("CASE WHEN job_id % 17 = 0 THEN submit_ts - 1 ELSE start_ts END"),
            "end_ts": F.expr("CASE WHEN job_id % 34 = 0 THEN submit_ts - 9 ELSE end_ts END"),
            "requested_cpus": F.expr("CASE WHEN job_id % 51 = 0 THEN 0 ELSE requested_cpus END"),
        }
    )
    return coerce.job_violations(messy).select("job_id", joined("failed_invariants"), "severity")


@on_jobs
def capacity_violations(jobs):
    return queues.capacity_violations(jobs, CAPACITY)


@on_jobs
def snapshot_violations(jobs):
    """Snapshots with a queued and a running job each, whose counts and times contradict each other now and then."""
    doc = (
        "to_json(named_struct('clock_ts', job_id, 'capacity_cpus', 64, 'free_cpus', job_id % 70 - 3,"
        " 'queued_jobs', array(named_struct('job_id', job_id, 'submit_ts', job_id + IF(job_id % 5 = 0, 10, 0))),"
        " 'running_jobs', array(named_struct('job_id', job_id + job_id % 3, 'allocated_cpus', allocated_cpus))))"
    )
    return invariants.snapshot_violations(jobs.select(F.expr(doc).alias("value")))


@on_jobs
def queued_while_running(jobs):
    """Every fourth job is submitted again halfway through its run, and waits until it ends."""
    again = jobs.filter("job_id % 4 = 0").select(
        "job_id", F.expr("start_ts + runtime_actual_sec DIV 2").alias("submit_ts"), F.col("end_ts").alias("start_ts"),
        F.expr("end_ts + 60").alias("end_ts"),
    )
    return invariants.queued_while_running(jobs.select("job_id", "submit_ts", "start_ts", "end_ts").unionByName(again))


@on_jobs
def conservation(jobs):
    """Reported free CPUs, every fourth one too many, against the jobs that run."""
    points = jobs.select(F.expr("submit_ts DIV 50000 * 50000").alias("ts"))
    reported = queues.free_at(jobs, CAPACITY, points)
    wrong = F.when(F.expr("ts DIV 50000 % 4 = 0"), 1).otherwise(0)
    return invariants.conservation(jobs, CAPACITY, reported.withColumn("free_cpus", F.col("free_cpus") + wrong))


@query
def event_order(spark, sf_dir):
    """Position of each event in the deterministic order of its second."""
    return coerce.event_positions(_typed_events(spark, sf_dir), "event_id").select("event_id", "pos")


def _typed_events(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "unix_timestamp(ts) DIV 600 AS ts",
        "element_at(array('submit', 'dispatch', 'complete'), cast(event_id % 3 + 1 AS INT)) AS event_type",
        "CASE WHEN event_id % 8 = 0 THEN NULL ELSE user_id END AS job_id",
    )


@on_jobs
def snapshot_queued(jobs):
    return coerce.explode_snapshot(fx.snapshot_documents(jobs))[0].select(
        "clock_ts", "free_cpus", "job_id", "requested_cpus", "runtime_estimate_sec"
    )


@on_jobs
def snapshot_running(jobs):
    return coerce.explode_snapshot(fx.snapshot_documents(jobs))[1].drop("capacity_cpus")


@on_jobs
def state_hash(jobs):
    return coerce.state_hash(jobs.select("job_id", "submit_ts", "requested_cpus")).select("job_id", "state_hash")


# --------------------------------------------------------------------------- scalar formats


@on_jobs
def scalar_time_formats(jobs):
    run = "runtime_actual_sec"
    df = jobs.selectExpr(
        "job_id",
        f"{fx._dashed(f'{run} + job_id % 3 * 86400')} AS elapsed",
        f"concat({run} DIV 60, ':', {run} % 60) AS minutes",
        f"cast({run} AS STRING) AS seconds",
        f"{fx._iso('submit_ts')} AS iso",
        "date_format(timestamp_seconds(submit_ts), 'yyyy-MM-dd HH:mm') AS minute_stamp",
        "date_format(timestamp_seconds(submit_ts), 'MM/dd/yyyy HH:mm:ss') AS us",
        "date_format(timestamp_seconds(submit_ts), 'E MMM d HH:mm:ss yyyy') AS qstat",
        f"concat(1 + job_id % 4, ':', {fx._clock(run)}) AS walltime",
        "CASE WHEN job_id % 2 = 0 THEN 'Unknown' ELSE 'n/a' END AS none",
    )
    c = F.col
    return df.select(
        "job_id",
        sc.elapsed_sec(c("elapsed")).alias("elapsed"),
        sc.elapsed_sec(c("minutes")).alias("minutes"),
        sc.elapsed_sec(c("seconds")).alias("seconds"),
        sc.slurm_datetime(c("iso")).alias("iso"),
        sc.slurm_datetime(c("minute_stamp")).alias("minute_stamp"),
        sc.pbs_timestamp(c("us")).alias("us"),
        sc.qstat_datetime(c("qstat")).alias("qstat"),
        sc.pbs_walltime_sec(c("walltime")).alias("walltime"),
        sc.slurm_datetime(c("none")).alias("none"),
        sc.hour_of_day(sc.slurm_datetime(c("iso"))).alias("hour"),
        sc.day_of_week(sc.slurm_datetime(c("iso"))).alias("dow"),
        sc.is_peak_hour(sc.slurm_datetime(c("iso"))).alias("peak"),
    )


@on_jobs
def scalar_memory_formats(jobs):
    n = "(1 + wait_sec)"
    df = jobs.selectExpr(
        "job_id",
        f"concat({n}, 'K') AS k", f"concat({n}, 'Mc') AS m", f"concat({n}, 'Gn') AS g", f"concat({n}, 'T') AS t",
        f"cast({n} AS STRING) AS bare", f"concat({n}, 'b') AS pb", f"concat({n}, 'kb') AS pkb",
        f"concat({n}, 'GB') AS pgb", f"concat({n}, 'tb') AS ptb",
    )
    slurm = {x: sc.slurm_memory_mb(F.col(x)).alias(x) for x in ("k", "m", "g", "t", "bare")}
    pbs_cols = {x: sc.pbs_memory_mb(F.col(x)).alias(x) for x in ("pb", "pkb", "pgb", "ptb")}
    return df.select("job_id", *slurm.values(), *pbs_cols.values(), sc.pbs_memory_mb(F.col("bare")).alias("pbare"))


@on_jobs
def job_id_classes(jobs):
    raw = F.expr(
        "CASE job_id % 5 WHEN 0 THEN cast(job_id AS STRING) WHEN 1 THEN concat(job_id, '_7')"
        " WHEN 2 THEN concat(job_id, '.batch') WHEN 3 THEN concat(job_id, '_7.0') ELSE concat('x', job_id) END"
    )
    pbs_raw = F.expr("CASE WHEN job_id % 2 = 0 THEN concat(job_id, '[3].srv') ELSE concat(job_id, '.srv') END")
    return jobs.select("job_id", sc.slurm_job_id(raw).alias("j"), sc.pbs_job_id(pbs_raw).alias("pbs_id")).select(
        F.col("job_id").alias("n"), F.col("j.id").alias("id"), "j.array_index", "j.is_step", "pbs_id"
    )


@on_jobs
def nodes_spec(jobs):
    spec = F.expr(
        "CASE job_id % 4 WHEN 0 THEN concat(requested_cpus, ':ppn=2+1:ppn=3') WHEN 1 THEN concat('nodes=', requested_cpus)"
        " WHEN 2 THEN concat('ppn=', requested_cpus) ELSE '' END"
    )
    return jobs.select("job_id", sc.nodes_spec_cpus(spec).alias("cpus"))


@on_jobs
def attribute_map(jobs):
    """A repeated key keeps its last value; tokens without '=' are dropped."""
    text = F.expr("concat('a=', job_id, ' noise b=x=', user_id, '  a=', wait_sec)")
    m = sc.attribute_map(F.coalesce(text, F.lit("a=0")))
    return jobs.select("job_id", F.try_element_at(m, F.lit("a")).alias("a"), F.try_element_at(m, F.lit("b")).alias("b"))


@on_jobs
def scalar_classes(jobs):
    ratio = F.col("runtime_overrequest_ratio")
    return jobs.select(
        "job_id",
        sc.job_size_class(F.col("requested_cpus")).alias("size_class"),
        sc.user_class(F.coalesce(ratio, F.lit(1.0))).alias("user_class"),
        sc.swf_int(F.expr("CASE WHEN job_id % 3 = 0 THEN '-1' ELSE concat(wait_sec, '.9') END")).alias("swf"),
        sc.slurm_state(F.expr("CASE WHEN job_id % 3 = 0 THEN ' ' ELSE ' cancelled by 7' END")).alias("state"),
        sc.profile_id(F.col("wait_sec") / F.lit(16.0)).alias("profile"),
        F.round(sc.pinball(F.col("wait_sec").cast("double"), F.col("runtime_actual_sec").cast("double"), 0.9), 6).alias("pinball"),
        F.round(sc.from_log(F.log1p("wait_sec")), 3).alias("seconds"),
        F.round(sc.relative_divergence(F.col("wait_sec").cast("double"), F.col("runtime_actual_sec").cast("double"), 60.0), 6).alias("divergence"),
    )


# --------------------------------------------------------------------------- queues and order


@on_jobs
def queue_at_submit(jobs):
    return queues.queue_at_submit(jobs)


@on_jobs
def observed_queue(jobs):
    return queues.observed_queue(jobs)


@on_jobs
def profile_queue(jobs):
    return queues.profile_queue(jobs)


@on_jobs
def queue_resampled(jobs):
    return queues.resample_hold(queues.observed_queue(jobs), 3600)


@on_jobs
def occupancy(jobs):
    return queues.occupancy(jobs, CAPACITY)


@on_jobs
def free_at(jobs):
    points = jobs.select(F.expr("submit_ts DIV 50000 * 50000").alias("ts"))
    return queues.free_at(jobs, CAPACITY, points).withColumn("free_cpus", F.col("free_cpus").cast("bigint"))


@on_jobs
def submit_gaps(jobs):
    return queues.submit_gaps(jobs)


@on_jobs
def queue_ranks(jobs):
    out = None
    for policy in ("fifo", "shortest_first", "longest_first", "fairshare"):
        one = queues.queue_rank(fx.snapshots(jobs), policy, "snapshot_id").select(
            F.lit(policy).alias("policy"), "snapshot_id", "job_id", "queue_rank"
        )
        out = one if out is None else out.unionByName(one)
    return out


@on_jobs
def fifo_prefix(jobs):
    return queues.fifo_prefix(fx.snapshots(jobs), "snapshot_id").select("snapshot_id", "job_id", "cpus_so_far")


@query
def sliding_counts(spark, sf_dir):
    return sliding.sliding_counts(fx.request_log(spark, sf_dir), 3600, 2)


# --------------------------------------------------------------------------- history, features, folds


@on_jobs
def user_lookbacks(jobs):
    return _lookbacks(history.user_lookbacks(jobs))


def _lookbacks(df: DataFrame) -> DataFrame:
    """The variance as a standard deviation, whose rounding has no ties."""
    df = df.withColumn("user_runtime_std_lookback", F.sqrt("user_runtime_var_lookback"))
    return rounded(df.drop("user_runtime_var_lookback"), 6, user_runtime_std_lookback=3)


@on_jobs
def user_lookbacks_causal(jobs):
    return _lookbacks(history.user_lookbacks(jobs, causal=True))


@on_jobs
def feature_table(jobs):
    return _lookbacks(features.feature_table(jobs))


@on_jobs
def asof_history(jobs):
    return history.asof_history(jobs)


@on_jobs
def tsafrir(jobs):
    df = history.tsafrir(coerce.coerce_trace(jobs))
    return df.select("job_id", "tsafrir_runtime_sec", "tsafrir_history_count", "tsafrir_clamped")


@on_jobs
def fairshare(jobs):
    return history.fairshare(jobs).select(
        "job_id", (F.round(-F.col("priority_score"), 0) + F.lit(0.0)).alias("decayed_usage")
    )


@on_jobs
def chronological_folds(jobs):
    return features.split_summary(features.chronological_folds(jobs))


@on_jobs
def fold_chronology(jobs):
    return features.chronology_ok(features.split_summary(features.chronological_folds(jobs)))


@on_jobs
def time_split(jobs):
    return features.time_split(jobs).select("job_id", "segment", "row_idx")


@on_jobs
def cv_folds(jobs):
    return features.split_summary(features.cv_folds(jobs)).drop("mode")


@on_jobs
def stable_order(jobs):
    return features.indexed(jobs).select("job_id", "row_idx")


# --------------------------------------------------------------------------- profile


@on_jobs
def trace_profile(jobs):
    p = profile.trace_profile(jobs)
    nested = [f"{g}.*" for g, t in p.dtypes if t.startswith("struct")]
    return rounded(p.select("row_count", *nested), 8)


@on_jobs
def profile_sizes(jobs):
    return rounded(profile.profile_sizes(jobs))


@on_jobs
def profile_runtime(jobs):
    return rounded(profile.profile_runtime(jobs))


@on_jobs
def profile_overrequest(jobs):
    return rounded(profile.profile_overrequest(jobs))


@on_jobs
def profile_congestion(jobs):
    return rounded(profile.profile_congestion(jobs))


@on_jobs
def user_skew(jobs):
    return rounded(profile.profile_users(jobs), 9)


@on_jobs
def profile_range(jobs):
    return profile.profile_range(jobs)


@on_jobs
def workload_class(jobs):
    return rounded(profile.workload_class(jobs))


# --------------------------------------------------------------------------- placement


@on_jobs
def best_fit_node(jobs):
    df = jobs.withColumn("asked", 1 + (F.col("job_id") * 31 + F.col("wait_sec")) % 150)
    out = placement.best_fit(df, request="asked")
    return rounded(out.select("job_id", "optimal_node_cpus", "waste_ratio", "frag_label", "fragmentation_risk"))


@query
def best_fit_size_table(spark, sf_dir):
    """Node sizes from a table: the distinct part sizes."""
    sizes = fx.table(spark, sf_dir, "part").select("p_size")
    df = fx.jobs(spark, sf_dir).withColumn("asked", 1 + (F.col("job_id") * 31 + F.col("wait_sec")) % 60)
    out = placement.best_fit(df, sizes, request="asked")
    return rounded(out.select("job_id", "optimal_node_cpus", "waste_ratio"))


@on_jobs
def fragmentation_mix(jobs):
    df = jobs.withColumn("asked", 1 + (F.col("job_id") * 31 + F.col("wait_sec")) % 150)
    return rounded(placement.fragmentation_mix(placement.best_fit(df, request="asked")))


# --------------------------------------------------------------------------- comparison


@on_jobs
def core_divergence(jobs):
    return rounded(compare.core_divergence(jobs, fx.candidates(jobs), CAPACITY, ["policy_id"]).drop("sample_size"), 8)


@on_jobs
def wait_kl(jobs):
    return rounded(compare.wait_kl(jobs, fx.candidates(jobs), ["policy_id"]), 8)


@on_jobs
def slowdown_ks(jobs):
    return rounded(compare.slowdown_ks(jobs, fx.candidates(jobs), ["policy_id"]), 9)


@on_jobs
def queue_corr(jobs):
    return rounded(compare.queue_corr(jobs, fx.candidates(jobs), 60, ["policy_id"]), 7)


@on_jobs
def self_distance(jobs):
    """A table compared with itself: no divergence, no distance, full correlation."""
    same = jobs.withColumn("policy_id", F.lit("same"))
    out = compare.wait_kl(jobs, same, ["policy_id"]).join(compare.slowdown_ks(jobs, same, ["policy_id"]), "policy_id")
    return rounded(out.join(compare.queue_corr(jobs, same, 60, ["policy_id"]), "policy_id"), 7)


def _gate(jobs):
    limits = compare.GateThresholds()
    return compare.fidelity_gate(jobs, fx.candidates(jobs), CAPACITY, ["policy_id"], limits)


@on_jobs
def fidelity_gate(jobs):
    out = _gate(jobs)
    return rounded(out.withColumn("fail_reasons", F.array_join("fail_reasons", ",")), 7)


@on_jobs
def fidelity_gate_all(jobs):
    return compare.gate_status(_gate(jobs))


# --------------------------------------------------------------------------- decisions


def _cands_and_base(jobs):
    return (
        metrics.objective_metrics(fx.candidates(jobs), CAPACITY, by=["policy_id"]),
        metrics.objective_metrics(jobs, CAPACITY),
    )


@on_jobs
def constraints(jobs):
    return decide.constraints(*_cands_and_base(jobs)).select("policy_id", joined("violations"), "constraints_passed")


@on_jobs
def weighted_score(jobs):
    out = decide.weighted_score(*_cands_and_base(jobs))
    return rounded(out.select("policy_id", "delta_p95_bsld", "delta_utilization", "fairness_penalty", "score"), 7)


def _relaxed(jobs):
    """Candidates per queue and policy, with few starved jobs, so that some pass the contract."""
    calm = jobs.withColumns({"wait_sec": F.col("wait_sec") % 150000}).withColumns(
        {"start_ts": F.expr("submit_ts + wait_sec"), "end_ts": F.expr("submit_ts + wait_sec + runtime_actual_sec")}
    )
    named = fx.candidates(calm).withColumn("policy_id", F.concat_ws("-", "policy_id", "queue_id"))
    return (
        metrics.objective_metrics(named, CAPACITY, by=["policy_id"]),
        metrics.objective_metrics(calm, CAPACITY),
    )


@on_jobs
def recommend(jobs):
    out = decide.recommend(*_relaxed(jobs))
    return rounded(
        out.select("policy_id", "rank", "score", "accepted", "constraints_passed", joined("rejection_reasons")), 7
    )


@on_jobs
def recommend_gated(jobs):
    """A failing gate blocks every candidate."""
    ranked = decide.recommend(*_cands_and_base(jobs), gate=compare.gate_status(_gate(jobs)))
    status = decide.recommendation_status(ranked)
    return status.select(
        "status",
        "selected_policy_id",
        F.array_join(F.transform("failure_modes", lambda m: m["policy_id"]), ",").alias("blocked"),
        "best_policy_id",
        joined("likely_causes"),
    )


@on_jobs
def pareto_front(jobs):
    out = decide.pareto_front(*_relaxed(jobs))
    return out.select("policy_id", "pareto_frontier", "pareto_dominated")


@on_jobs
def regime(jobs):
    out = decide.regime(profile.trace_profile(jobs), *reversed(_cands_and_base(jobs)))
    return rounded(out, 7)


@on_jobs
def degrade(jobs):
    return rounded(decide.degrade(*_cands_and_base(jobs)), 5)


def _sweep(jobs):
    return jobs.selectExpr(
        "queue_id",
        "cast(job_id % 40 AS DOUBLE) / 8 AS guard_k",
        "cast(wait_sec % 2000 AS DOUBLE) - 900 AS delta_p95_bsld",
        "job_id % 3 = 0 AS constraints_passed",
        "CASE WHEN job_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status",
    )


@on_jobs
def sweep_report(jobs):
    return decide.sweep_report(_sweep(jobs), ["queue_id"])


@on_jobs
def best_trial(jobs):
    trials = jobs.selectExpr(
        "job_id AS trial", "cast(wait_sec % 977 AS DOUBLE) AS score", "IF(job_id % 4 = 0, 'error', 'ok') AS status"
    )
    return decide.best_trial(trials)


@query
def regression_gate(spark, sf_dir):
    runs = fx.bench_history(spark, sf_dir)
    current = runs.groupBy("profile_id").agg(F.min("rate").alias("rate"))
    return rounded(decide.regression_gate(runs, current))


@query
def latest_records(spark, sf_dir):
    return decide.latest(fx.bench_history(spark, sf_dir), 20, ["ts", "run_id"]).select("run_id", "profile_id", "rate")


@query
def bench_summary(spark, sf_dir):
    samples = fx.bench_history(spark, sf_dir).withColumn("duration_sec", F.col("run_id") % 977)
    return rounded(decide.bench_summary(samples, ["profile_id"]))


def _reports(jobs):
    return jobs.selectExpr(
        "job_id AS trace_id",
        "CASE WHEN job_id % 40 = 0 THEN NULL WHEN job_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS fidelity_status",
        "CASE WHEN job_id % 3 = 0 THEN 'accepted' WHEN job_id % 3 = 1 THEN 'blocked' END AS recommendation_status",
        "CASE WHEN job_id % 4 = 0 THEN array('fidelity_failed', concat('q', queue_id)) ELSE array('primary_kpi_not_improved') END AS failure_modes",
        "CASE WHEN job_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS status",
    )


@on_jobs
def dossier_summary(jobs):
    return decide.dossier_summary(_reports(jobs))


@on_jobs
def dossier_failure_modes(jobs):
    return decide.dossier_failure_modes(_reports(jobs))


@on_jobs
def suite_status(jobs):
    return decide.suite_status(_reports(jobs))


# --------------------------------------------------------------------------- accuracy and drift


def _scored(jobs, member: int = 1):
    return jobs.join(fx.predictions(jobs, member), "job_id").withColumn("actual", F.col("runtime_actual_sec").cast("double"))


def _cut(jobs):
    cut = features.training_cut(jobs)
    return cut.filter("in_train"), cut.filter("NOT in_train")


@on_jobs
def pinball_eval(jobs):
    return rounded(accuracy.quantile_losses(_scored(jobs)))


@on_jobs
def naive_baselines(jobs):
    return rounded(accuracy.naive_baselines(*_cut(jobs)))


@on_jobs
def user_median_baseline(jobs):
    out = accuracy.user_median_baseline(*_cut(jobs))
    return rounded(out.select("job_id", "user_history_median"))


@on_jobs
def evaluate_quantiles(jobs):
    train, test = _cut(jobs)
    return rounded(accuracy.evaluate_quantiles(test.join(fx.predictions(jobs), "job_id"), train), 5)


def _with_actual(jobs):
    actual = jobs.selectExpr("job_id", "runtime_actual_sec AS actual_sec", "end_ts AS ts")
    out = accuracy.score_predictions(fx.predictions(jobs), actual)
    return out.join(actual.select("job_id", "ts"), "job_id")


@on_jobs
def score_predictions(jobs):
    return rounded(_with_actual(jobs).drop("ts"))


@on_jobs
def feedback_report(jobs):
    return rounded(accuracy.feedback_report(_with_actual(jobs)))


@on_jobs
def feedback_last_n(jobs):
    return rounded(accuracy.feedback_report(_with_actual(jobs), last_n=500))


@on_jobs
def ensemble(jobs):
    members = fx.second_members(jobs)
    actual = jobs.selectExpr("job_id", "runtime_actual_sec AS actual_sec")
    return rounded(accuracy.ensemble(members, accuracy.member_losses(members, actual)), 4)


DRIFT_COLUMNS = ["requested_cpus", "runtime_requested_sec", "requested_mem", "wait_sec", "runtime_overrequest_ratio"]


def _drifted(jobs):
    train, test = _cut(jobs)
    return train, test.withColumn("wait_sec", F.expr("wait_sec * 3 DIV 2"))


@on_jobs
def psi(jobs):
    return rounded(accuracy.psi(*_drifted(jobs), DRIFT_COLUMNS), 7)


def _degraded(jobs):
    wide = accuracy.quantile_losses(_scored(jobs))
    base = wide.selectExpr("stack(3, 'p10', p10_pinball, 'p50', p50_pinball, 'p90', p90_pinball) AS (quantile, pinball_loss)")
    return accuracy.degradation(_scored(jobs, 2), base)


@on_jobs
def degradation(jobs):
    return rounded(_degraded(jobs))


@on_jobs
def drift_report(jobs):
    out = accuracy.drift_report(accuracy.psi(*_drifted(jobs), DRIFT_COLUMNS), _degraded(jobs))
    return out.withColumns({c: F.array_join(c, ",") for c in ("psi_features_flagged", "metrics_flagged")})


@on_jobs
def column_stats(jobs):
    return rounded(accuracy.column_stats(jobs, DRIFT_COLUMNS))


@on_jobs
def group_fairness(jobs):
    return rounded(accuracy.group_fairness(jobs, "user_id"), 5)


@on_jobs
def top_groups(jobs):
    return accuracy.top_groups(jobs, "user_id")


@on_jobs
def model_card(jobs):
    card = accuracy.model_card(accuracy.quantile_losses(_scored(jobs)), jobs, DRIFT_COLUMNS, ["user_id", "group_id"])
    return rounded(
        card.select(
            F.col("performance.p50_mae").alias("p50_mae"),
            F.size("dataset_columns").alias("columns"),
            F.col("fairness_user_id.unique_values").alias("users"),
            F.col("fairness_group_id.mean_max").alias("group_mean_max"),
        )
    )


# --------------------------------------------------------------------------- increments and generators


@on_jobs
def incremental_poll(jobs):
    """Rows above the watermark (the submit time at the 80 % row) and the next watermark."""
    from cairntrace.streaming.increments import increment, next_watermark

    cut = features.indexed(jobs).filter(F.col("row_idx") == F.floor(F.col("row_idx_rows") * 0.8))
    mark = cut.agg(F.max("submit_ts")).scalar()
    new = increment(swf.parse(fx.raw_swf(jobs)), mark)
    return next_watermark(new, mark)


@on_jobs
def incremental_rows(jobs):
    from cairntrace.streaming.increments import increment

    cut = features.indexed(jobs).filter(F.col("row_idx") == F.floor(F.col("row_idx_rows") * 0.8))
    return increment(swf.parse(fx.raw_swf(jobs)), cut.agg(F.max("submit_ts")).scalar()).select("job_id", "submit_ts")


@query
def incremental_poll_slurm(spark, sf_dir):
    """Jobs of the older half of the time are polled, then the others from files with their own header."""
    from cairntrace.streaming.increments import ingest_increment

    landed, out, state = (scratch(spark, n) for n in ("landed", "polled", "state"))
    jobs = fx.jobs(spark, sf_dir)
    middle = jobs.agg(F.expr("(min(submit_ts) + max(submit_ts)) DIV 2").alias("m")).first()["m"]
    fx.raw_sacct(jobs.where(F.col("submit_ts") < middle)).write.mode("append").text(landed)
    ingest_increment(spark, "slurm", landed, out, state)
    _headed_dump(fx.raw_sacct(jobs.where(F.col("submit_ts") >= middle)), landed)
    ingest_increment(spark, "slurm", landed, out, state)
    return spark.read.parquet(out).select("job_id", "submit_ts", "user_id", "poll")


def _ids(jobs):
    """Generator ids 1..n, one per job of the given table."""
    return jobs.select((F.col("job_id") + 1).alias("id"))


GEN = ["job_id", "submit_ts", "start_ts", "end_ts", "runtime_actual_sec", "runtime_requested_sec", "requested_cpus", "user_id"]


@on_jobs
def gen_base(jobs):
    return generate.gen_jobs(_ids(jobs)).select(*GEN, "wait_sec", "allocated_cpus", "group_id")


@on_jobs
def gen_heavy_tail(jobs):
    return generate.heavy_tail(generate.gen_jobs(_ids(jobs))).select(*GEN)


@on_jobs
def gen_low_congestion(jobs):
    return generate.low_congestion(generate.gen_jobs(_ids(jobs))).select(*GEN)


@on_jobs
def gen_user_skew(jobs):
    return generate.user_skew(generate.gen_jobs(_ids(jobs))).select(*GEN)


@on_jobs
def gen_burst(jobs):
    return generate.burst_shock(generate.gen_jobs(_ids(jobs))).select(*GEN)


# --------------------------------------------------------------------------- files, streams


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    import uuid

    from cairntrace.session import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def canonical_table(spark, sf_dir):
    """Written per dataset, read back with one partition selected."""
    from cairntrace.sources import tables

    folder = scratch(spark, "jobs")
    jobs = swf.parse(fx.raw_swf(fx.jobs(spark, sf_dir)))
    tables.write_jobs(jobs.withColumn("dataset_id", F.concat(F.lit("q"), F.coalesce("queue_id", F.lit("0")))), folder)
    back = tables.load_jobs(spark, folder, "q1")
    return back.select("job_id", "submit_ts", "requested_mem", "dataset_id")


@query
def jsonl_log(spark, sf_dir):
    """A prediction log as JSON lines with broken lines in it."""
    from cairntrace.sources import tables

    folder = scratch(spark, "log")
    preds = fx.predictions(fx.jobs(spark, sf_dir))
    text = F.when(F.col("job_id") % 33 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("job_id", "p10", "p50", "p90")))
    preds.select(text.alias("value")).write.text(folder)
    return tables.load_jsonl(spark, folder, "job_id bigint, p10 double, p50 double, p90 double")


@query
def json_reports(spark, sf_dir):
    """Report documents, one file each, some unreadable."""
    from cairntrace.sources import tables

    folder = scratch(spark, "reports")
    cands = metrics.objective_metrics(fx.candidates(fx.jobs(spark, sf_dir)), CAPACITY, by=["policy_id"])
    text = F.when(F.col("policy_id") == "cand_b", F.lit("{broken")).otherwise(
        F.to_json(F.struct("policy_id", F.struct("job_count", "starved_jobs").alias("objective_metrics")))
    )
    cands.select(text.alias("value"), F.col("policy_id").alias("f")).repartition("f").write.partitionBy("f").text(folder)
    docs = tables.load_reports(spark, f"{folder}/*", "policy_id string, objective_metrics struct<job_count:double,starved_jobs:double>")
    return docs.select("policy_id", "objective_metrics.*")


@query
def dataset_fingerprint(spark, sf_dir):
    return quality.dataset_fingerprint(spark, f"{sf_dir}/*.parquet")


@query
def stream_ingest(spark, sf_dir):
    """SWF files landing in a folder, with every job written twice; each comes out once."""
    from cairntrace.streaming import jobs as st

    landed, out, mark = (scratch(spark, n) for n in ("landed", "ingested", "mark"))
    lines = fx.raw_swf(fx.jobs(spark, sf_dir))
    lines.unionByName(lines).repartition(6).write.text(landed)
    st.write_stream(st.stream_jobs(spark, landed, "swf"), out, mark, poll_sec=None).awaitTermination()
    return rounded(spark.read.parquet(out))


@query
def stream_ingest_two_landings(spark, sf_dir):
    """The newer half of the jobs lands and is polled, then the older half with the same checkpoint."""
    from cairntrace.streaming import jobs as st

    landed, out, mark = (scratch(spark, n) for n in ("landed", "ingested", "mark"))
    jobs = fx.jobs(spark, sf_dir)
    middle = jobs.agg(F.percentile_approx("submit_ts", 0.5).alias("m")).first()["m"]
    for part in (jobs.where(F.col("submit_ts") >= middle), jobs.where(F.col("submit_ts") < middle)):
        fx.raw_swf(part).repartition(3).write.mode("append").text(landed)
        st.write_stream(st.stream_jobs(spark, landed, "swf"), out, mark, poll_sec=None).awaitTermination()
    return rounded(spark.read.parquet(out))


@query
def stream_slurm_two_landings(spark, sf_dir):
    """The newer half of the jobs lands under headers and is polled, then the older half without."""
    from cairntrace.streaming import jobs as st

    landed, out, mark = (scratch(spark, n) for n in ("landed", "ingested", "mark"))
    jobs = fx.jobs(spark, sf_dir)
    middle = jobs.agg(F.percentile_approx("submit_ts", 0.5).alias("m")).first()["m"]
    _headed_dump(fx.raw_sacct(jobs.where(F.col("submit_ts") >= middle)), landed)
    st.land_jobs(spark, landed, "slurm", out, mark).awaitTermination()
    fx.raw_sacct(jobs).write.mode("append").text(landed)
    st.land_jobs(spark, landed, "slurm", out, mark).awaitTermination()
    return spark.read.parquet(out).select("job_id", "submit_ts", "user_id")


@query
def stream_poll_totals(spark, sf_dir):
    """Statistics of a polled stream."""
    from cairntrace.streaming import jobs as st

    landed, out, stats, mark = (scratch(spark, n) for n in ("landed", "polled", "stats", "mark"))
    fx.raw_pbs(fx.jobs(spark, sf_dir)).write.text(landed)
    stream = st.stream_jobs(spark, landed, "pbs")
    st.poll_stats(stream, out, stats, mark, "pbs", poll_sec=None).awaitTermination()
    return st.poll_totals(spark.read.parquet(stats)).select("total_rows", "source")


def _feedback_tables(spark, sf_dir):
    jobs = fx.jobs(spark, sf_dir)
    preds = fx.predictions(jobs).join(jobs.select("job_id", F.timestamp_seconds("start_ts").alias("predicted_at")), "job_id")
    done = jobs.select(
        "job_id", F.timestamp_seconds("end_ts").alias("done_at"), F.col("runtime_actual_sec").cast("double").alias("actual_sec")
    )
    return preds, done.filter("job_id % 13 <> 0")


def _streamed(spark, df):
    folder = scratch(spark, "source")
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


@query
def stream_feedback(spark, sf_dir):
    """Predictions and outcomes joined as streams."""
    from cairntrace.streaming import jobs as st

    preds, done = (_streamed(spark, t) for t in _feedback_tables(spark, sf_dir))
    out = scratch(spark, "feedback")
    st.write_stream(st.stream_feedback(preds, done), out, scratch(spark, "mark"), poll_sec=None).awaitTermination()
    return rounded(spark.read.parquet(out).drop("done_at"))


@query
def stream_feedback_two_landings(spark, sf_dir):
    """Newer predictions and outcomes land first, older ones second, with the same checkpoint."""
    from cairntrace.streaming import jobs as st

    preds, done = _feedback_tables(spark, sf_dir)
    out, mark = scratch(spark, "feedback"), scratch(spark, "mark")
    folders = scratch(spark, "predicted"), scratch(spark, "done")
    middle = done.agg(F.percentile_approx(F.unix_seconds("done_at"), 0.5).alias("m")).first()["m"]
    for newer in (True, False):
        for table, folder, at in zip((preds, done), folders, ("predicted_at", "done_at")):
            late = F.unix_seconds(at) < middle
            table.where(~late if newer else late).write.mode("append").parquet(folder)
        sides = [spark.readStream.schema(t.schema).parquet(f) for t, f in zip((preds, done), folders)]
        st.write_stream(st.stream_feedback(*sides), out, mark, poll_sec=None).awaitTermination()
    return rounded(spark.read.parquet(out).drop("done_at"))


def _by_month(out: DataFrame) -> DataFrame:
    return out.select(F.unix_seconds("w.start").alias("start_ts"), *[c for c in out.columns if c != "w"])


@query
def rolling_accuracy(spark, sf_dir):
    """Accuracy per 30 days of outcomes."""
    from cairntrace.streaming import jobs as st

    preds, done = _feedback_tables(spark, sf_dir)
    scored = accuracy.score_predictions(preds, done).join(done.select("job_id", "done_at"), "job_id")
    return rounded(_by_month(st.rolling_accuracy(scored, "30 days")))


@query
def stream_rolling_accuracy(spark, sf_dir):
    """Accuracy per 30 days over a stream of two landings, as far as the watermark closed them; the sketched p95 as its rank
    among the errors, in steps of five percent."""
    from cairntrace.streaming import jobs as st

    preds, done = _feedback_tables(spark, sf_dir)
    scored = accuracy.score_predictions(preds, done).join(done.select("job_id", "done_at"), "job_id")
    landed, out, mark = (scratch(spark, n) for n in ("scored", "rolled", "mark"))
    for k in range(2):
        scored.where(F.col("job_id") % 2 == k).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(scored.schema).parquet(landed).withWatermark("done_at", "9000 days" if not k else "10 days")
        st.write_stream(st.rolling_accuracy(stream, "30 days"), out, mark, poll_sec=None).awaitTermination()
    rolled = _by_month(spark.read.parquet(out))
    month = F.unix_seconds(F.window("done_at", "30 days")["start"])
    errors = scored.select(month.alias("start_ts"), F.abs("error_sec").alias("e"))
    ranks = errors.join(rolled.select("start_ts", "p95_error"), "start_ts").groupBy("start_ts").agg(
        (F.round(F.avg((F.col("e") <= F.col("p95_error")).cast("double")) * 20) / 20).alias("p95_rank")
    )
    return rounded(rolled.drop("p95_error").join(ranks, "start_ts"))


def _landings(spark, events, parts, start):
    """Each part of `events` (a condition) lands and is streamed before the next; then one row far ahead lets all
    that waits pass."""
    landed = scratch(spark, "landed")
    for part in parts:
        part.write.mode("append").parquet(landed)
        start(spark.readStream.schema(events.schema).parquet(landed)).awaitTermination()


@query
def stream_queue(spark, sf_dir):
    """Queue depth per queue over three landings, each with changes that are older than those of the one before."""
    from cairntrace.streaming import jobs as st

    events = st.queue_events(fx.jobs(spark, sf_dir))
    out, mark = scratch(spark, "depth"), scratch(spark, "mark")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span.b - span.a) // 3 + 1
    # one change in seven comes a landing late
    turn = F.least(F.floor((F.col("ts") - span.a) / step) + F.when(F.col("ts") % 7 == 0, 1).otherwise(0), F.lit(2))
    last = spark.createDataFrame([("the end", span.b + 2 * step, 0, 0)], events.schema)
    parts = [events.filter(turn == k) for k in range(3)]
    _landings(spark, events, [*parts[:2], parts[2].unionByName(last)], lambda s: st.stream_queue(s, out, mark, f"{step} seconds"))
    return spark.read.parquet(out).filter("queue_id <> 'the end'")


@query
def stream_sliding_counts(spark, sf_dir):
    """Trailing counts over two landings, the second with the older requests of every other key."""
    from cairntrace.streaming import jobs as st

    log = fx.request_log(spark, sf_dir).select(F.col("key").cast("long").alias("key"), F.col("ts").cast("long").alias("ts"))
    out, mark = scratch(spark, "counts"), scratch(spark, "mark")
    span = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first = (F.col("ts") < (span.a + span.b) / 2) & (F.col("key") % 2 == 0)
    last = spark.createDataFrame([(-1, 2 * span.b - span.a + 7200)], log.schema)
    late = f"{span.b - span.a + 3600} seconds"
    _landings(
        spark, log, [log.filter(first), log.filter(~first).unionByName(last)],
        lambda s: st.stream_request_counts(s, out, mark, late, 3600, 2),
    )
    return spark.read.parquet(out).filter("key >= 0")


# --------------------------------------------------------------------------- models (rows-only)


def _learning_split(jobs):
    """Feature rows split 70/15/15 by submit time; look-backs see only completed jobs, and their
    fill values come from the training slice."""
    from cairntrace.session import settle

    first = features.time_split(coerce.coerce_features(jobs)).filter("segment = 'train'")
    table = settle(features.feature_table(jobs, causal=True, fills_from=first))
    rows = settle(features.time_split(coerce.training_frame(table)))
    return tuple(rows.filter(F.col("segment") == s) for s in ("train", "valid", "test"))


@on_jobs
def runtime_model(jobs):
    """Test losses of the quantile model next to the naive predictors."""
    from cairntrace.operators import learning

    train, valid, test = _learning_split(jobs)
    scored = learning.fit_runtime(train, valid).score(test)
    return accuracy.evaluate_quantiles(scored, train)


@on_jobs
def pipeline_ingest(jobs):
    """The quality report that the ingest job writes beside the jobs it parsed from files."""
    from cairntrace.plans import pipelines

    spark = jobs.sparkSession
    landed = scratch(spark, "swf")
    fx.raw_swf(jobs).write.text(landed)
    made = pipelines.run_ingest(spark, "swf", landed, scratch(spark, "ingested"), "t")
    return rounded(made["quality"].select(*[F.col(c).cast("double" if c.endswith("_rate") else "bigint").alias(c) for c in QUALITY]), 9)


QUALITY = (
    "row_count requested_mem_null_rows requested_mem_null_rate runtime_requested_null_rows requested_cpu_fallback_rows "
    "total_lines comment_lines blank_lines malformed_lines parsed_rows"
).split()


@on_jobs
def pipeline_features(jobs):
    """The folds that the feature job writes."""
    from cairntrace.plans import pipelines

    splits = pipelines.run_features(jobs, scratch(jobs.sparkSession, "features"), "t")["splits"]
    longs = ("start_idx", "end_idx_exclusive", "row_count", "submit_ts_min", "submit_ts_max")
    return splits.select(F.col("fold_id").cast("int").alias("fold_id"), "mode", "segment", *longs)


@on_jobs
def pipeline_stress_compare(jobs):
    """Change of every metric from the jobs to another schedule, as the stress comparison tells it."""
    from cairntrace.plans import pipelines

    other = fx.candidates(jobs).filter("policy_id = 'cand_a'")
    made = pipelines.run_stress_compare(jobs, other, CAPACITY)["degrade"]
    return rounded(made.withColumn("policy_id", F.lit("cand_a")), 5)


@on_jobs
def pipeline_suite(jobs):
    """Gate, metrics and ranking of two traces at once: the statuses tell which candidates are let through."""
    from cairntrace.plans import pipelines

    both = F.explode(F.array(F.lit("a"), F.lit("b")))
    plans = jobs.withColumn("policy_id", F.lit("fifo")).unionByName(fx.candidates(jobs), allowMissingColumns=True)
    made = pipelines.run_suite(jobs.withColumn("dataset_id", both), plans.withColumn("dataset_id", both), CAPACITY, "fifo")
    return made["metrics"].select("dataset_id", "policy_id", F.col("job_count").cast("bigint").alias("job_count")).join(
        made["gate"].groupBy("dataset_id").agg(F.count_if(F.col("policy_id") == "fifo").alias("gates_of_baseline")), "dataset_id"
    ).join(made["gate"].select("dataset_id", "policy_id", F.col("status").alias("gate")), ["dataset_id", "policy_id"])


@on_jobs
def pipeline_bench(jobs):
    """Two timed steps, whose first run passes for want of a history, and whose second has one run to look back to."""
    from cairntrace.plans import pipelines

    spark, history = jobs.sparkSession, scratch(jobs.sparkSession, "history")
    steps = {"users": (1000, lambda: jobs.groupBy("user_id").count()), "queues": (1000, lambda: jobs.groupBy("queue_id").count())}
    pipelines.run_bench(spark, steps, history, "p", samples=1)
    out = pipelines.run_bench(spark, steps, history, "p", samples=2)
    return out.select("profile_id", "samples", "prior_window_records", (F.col("baseline_median") > 0).alias("has_baseline"))


@on_jobs
def resource_model_checks(jobs):
    """What must hold of the resource models: risks and node sizes are among those that exist, and models that were saved
    and loaded score alike."""
    from cairntrace.operators import learning

    df = jobs.withColumn("requested_cpus", (1 + (F.col("job_id") * 31 + F.col("wait_sec")) % 130).cast("int"))
    model, report = learning.fit_resource(df)
    folder = scratch(jobs.sparkSession, "model")
    model.save(folder)
    names = ["fragmentation_risk", "predicted_label", "confidence", "recommended_node_cpus"]
    scored = model.score(df).select("job_id", *names)
    again = learning.ResourceModel.load(jobs.sparkSession, folder).score(df)
    both = scored.join(again.select("job_id", *[F.col(c).alias(f"{c}_loaded") for c in names]), "job_id")
    alike = [F.bool_and(F.col(c) == F.col(f"{c}_loaded")) for c in names]
    checked = both.agg(
        F.count("*").alias("rows"),
        F.bool_and(F.col("predicted_label").isin(0, 1, 2)).alias("risks_known"),
        F.bool_and(F.col("confidence").between(0, 1)).alias("probabilities"),
        F.bool_and(F.col("recommended_node_cpus") >= 1).alias("sizes_positive"),
        (alike[0] & alike[1] & alike[2] & alike[3]).alias("loads_alike"),
    )
    told = report.select("test_rows", F.col("accuracy").between(0.5, 1).alias("accuracy_ok"))
    return checked.join(told, F.lit(True))


@on_jobs
def runtime_model_checks(jobs):
    """What must hold of the quantile model on the test slice: its interval covers what it should, quantiles don't cross,
    and a model that was saved and loaded scores alike."""
    from cairntrace.operators import learning

    train, valid, test = _learning_split(jobs)
    model = learning.fit_runtime(train, valid)
    folder = scratch(jobs.sparkSession, "model")
    model.save(folder)
    again = learning.RuntimeModel.load(jobs.sparkSession, folder)
    names = list(accuracy.QUANTILES)
    two = model.score(test).join(
        again.score(test).select("job_id", *[F.col(q).alias(f"{q}_loaded") for q in names]), "job_id"
    )
    y, low, mid, high = (F.col(c) for c in (learning.TARGET, *names))
    coverage = F.avg(((low <= y) & (y <= high)).cast("double"))
    return two.agg(
        F.count("*").alias("test_rows"),
        coverage.between(0.75, 0.85).alias("coverage_ok"),
        F.bool_and((low >= 1) & (low <= mid) & (mid <= high)).alias("in_order"),
        F.bool_and((low == F.col("p10_loaded")) & (mid == F.col("p50_loaded")) & (high == F.col("p90_loaded"))).alias("loads_alike"),
    )


@on_jobs
def category_indicators(jobs):
    """Indicators of the model's categories: how many, and that no two values share one."""
    from cairntrace.operators import learning

    df = jobs.withColumns({"submit_hour": F.col("submit_ts") % 24, "submit_dow": F.col("submit_ts") % 7})
    encoder = learning.Encoder.fit(df, learning.NUMERIC[:1], learning.CATEGORICAL)
    return encoder.dictionary.groupBy(F.col("c").alias("category")).agg(
        F.count("*").alias("n_values"),
        F.count_distinct("id").alias("n_indicators"),
        F.max("id").alias("last"),
        F.min_by("v", "id").alias("first_value"),
    )


@on_jobs
def resource_model(jobs):
    from cairntrace.operators import learning

    df = jobs.withColumn("requested_cpus", (1 + (F.col("job_id") * 31 + F.col("wait_sec")) % 130).cast("int"))
    return learning.fit_resource(df)[1]


@on_jobs
def tuning(jobs):
    from cairntrace.operators import learning

    return learning.tune(coerce.training_frame(_settled_features(jobs)))


def _settled_features(jobs):
    from cairntrace.session import settle

    return settle(features.feature_table(jobs, causal=True))


@on_jobs
def importance(jobs):
    from cairntrace.operators import learning

    train, valid, test = _learning_split(jobs)
    model = learning.fit_runtime(train, valid)
    return learning.importance(model.score, test)
