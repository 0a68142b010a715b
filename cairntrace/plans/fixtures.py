"""Job tables derived from the order tables of the test data.

Integer arithmetic only, so that another SQL engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id",
        "unix_timestamp(o_orderdate) + (o_orderkey * 7919) % 86400 AS submit_ts",
        "(o_custkey * 131 + o_orderkey * 17) % 432000 AS wait_sec",
        "30 + CAST(FLOOR(o_totalprice) AS BIGINT) % 40000 AS runtime_actual_sec",
        "CAST(POWER(2, (o_orderkey * 31 + o_custkey) % 8) AS INT) AS requested_cpus",
        "o_orderstatus AS status",
        "CASE WHEN o_custkey % 61 = 0 THEN NULL ELSE o_custkey % 60 END AS user_id",
        "o_custkey % 7 AS group_id",
        "substring(o_orderpriority, 1, 1) AS queue_id",
        "o_custkey",
    )
    timed = base.selectExpr(
        "job_id",
        "submit_ts",
        "submit_ts + wait_sec AS start_ts",
        "submit_ts + wait_sec + runtime_actual_sec AS end_ts",
        "wait_sec",
        "runtime_actual_sec",
        "CASE WHEN job_id % 7 = 0 THEN NULL ELSE runtime_actual_sec * (1 + o_custkey % 9) DIV 4 END"
        " AS runtime_requested_sec",
        "requested_cpus AS allocated_cpus",
        "requested_cpus",
        "CASE WHEN job_id % 5 = 0 THEN NULL ELSE CAST(requested_cpus AS BIGINT) * 1000 END AS requested_mem",
        "status",
        "user_id",
        "group_id",
        "queue_id",
        "queue_id AS partition_id",
    )
    return timed.withColumn(
        "runtime_overrequest_ratio", F.expr("CAST(runtime_requested_sec AS DOUBLE) / runtime_actual_sec")
    )


def _schedule(df: DataFrame, wait: str) -> DataFrame:
    return df.withColumns({"wait_sec": F.expr(wait)}).withColumns(
        {
            "start_ts": F.expr("submit_ts + wait_sec"),
            "end_ts": F.expr("submit_ts + wait_sec + runtime_actual_sec"),
        }
    )


CANDIDATE_WAITS = {
    "cand_a": "wait_sec * 9 DIV 10",
    "cand_b": "wait_sec * 11 DIV 10",
    "cand_c": "CASE WHEN user_id % 2 = 0 THEN wait_sec DIV 2 ELSE wait_sec END",
}


def candidate(base: DataFrame, name: str) -> DataFrame:
    """A candidate schedule of the same jobs."""
    return _schedule(base, CANDIDATE_WAITS[name])


def candidates(base: DataFrame) -> DataFrame:
    """All candidate schedules keyed by `policy_id`."""
    out = None
    for name in CANDIDATE_WAITS:
        one = candidate(base, name).withColumn("policy_id", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def predictions(base: DataFrame, member: int = 1) -> DataFrame:
    """Deterministic quantile predictions per job, as one of two models would give."""
    factor = "(80 + job_id % 41)" if member == 1 else "(70 + job_id % 71)"
    p50 = base.selectExpr("job_id", f"runtime_actual_sec * {factor} DIV 100 AS p50")
    return p50.selectExpr(
        "job_id",
        "CAST(p50 * 6 DIV 10 AS DOUBLE) AS p10",
        "CAST(p50 AS DOUBLE) AS p50",
        "CAST(p50 * 15 DIV 10 AS DOUBLE) AS p90",
    )


def second_members(base: DataFrame) -> DataFrame:
    """Predictions of two models keyed by `model`."""
    one = predictions(base, 1).withColumn("model", F.lit("m1"))
    return one.unionByName(predictions(base, 2).withColumn("model", F.lit("m2")))


# --------------------------------------------------------------------------- log text of the jobs


#: Jobs that one task renders the lines of, about.
SPREAD_ROWS = 250_000


def spread(base: DataFrame) -> DataFrame:
    """A log is many files: render it on all cores, not in the one task a small table is read by, and a long
    one in more tasks than there are cores."""
    cores = base.sparkSession.sparkContext.defaultParallelism
    return base.repartition(max(cores, base.count() // SPREAD_ROWS + 1))


def _text(*parts) -> str:
    return "concat_ws('|', " + ", ".join(parts) + ")"


def _iso(ts: str) -> str:
    return f"date_format(timestamp_seconds({ts}), \"yyyy-MM-dd'T'HH:mm:ss\")"


def _clock(sec: str) -> str:
    return f"format_string('%02d:%02d:%02d', ({sec}) DIV 3600, ({sec}) DIV 60 % 60, ({sec}) % 60)"


def _dashed(sec: str) -> str:
    days = f"({sec}) DIV 86400"
    return f"CASE WHEN {days} > 0 THEN concat({days}, '-', {_clock(f'({sec}) % 86400')}) ELSE {_clock(sec)} END"


def raw_swf(base: DataFrame) -> DataFrame:
    """SWF lines; every 50th job is replaced by a comment, a blank or a short line."""
    missing = lambda c: f"coalesce(cast({c} AS STRING), '-1')"
    fields = [
        "job_id", "submit_ts", "wait_sec", "runtime_actual_sec", "allocated_cpus", "-1", "-1", "requested_cpus",
        missing("runtime_requested_sec"), missing("requested_mem"),
        "CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 5 END",
        missing("user_id"), "group_id", "-1", "queue_id", "partition_id", "-1", "-1",
    ]
    line = "concat_ws('  ', " + ", ".join(f"cast({f} AS STRING)" for f in fields) + ")"
    noise = "CASE job_id DIV 50 % 3 WHEN 0 THEN '; a comment' WHEN 1 THEN '   ' ELSE '1 2 3' END"
    return once(spread(base), {"value": F.expr(f"CASE WHEN job_id % 50 = 0 THEN {noise} ELSE {line} END")})


def sacct_elapsed(base: DataFrame) -> DataFrame:
    return base.withColumn("elapsed", F.expr("runtime_actual_sec + job_id % 3 * 86400"))


def raw_sacct(base: DataFrame) -> DataFrame:
    """sacct lines: arrays, steps, unknown starts and ends, memory in several units."""
    df = sacct_elapsed(base)
    job = "CASE WHEN job_id % 10 = 0 THEN concat(job_id, '_1') ELSE cast(job_id AS STRING) END"
    memory = (
        "CASE WHEN requested_mem IS NULL THEN '0' WHEN job_id % 3 = 0 THEN concat(requested_mem, 'Mc')"
        " WHEN job_id % 3 = 1 THEN concat(requested_mem DIV 1000, 'Gn') ELSE concat(requested_mem * 1024, 'K') END"
    )
    fields = [
        job,
        _iso("submit_ts"),
        f"CASE WHEN job_id % 11 = 0 THEN 'Unknown' ELSE {_iso('start_ts')} END",
        f"CASE WHEN job_id % 4 = 0 THEN 'Unknown' ELSE {_iso('end_ts')} END",
        f"CASE WHEN job_id % 13 = 0 THEN '' ELSE {_dashed('elapsed')} END",
        "cast(allocated_cpus AS STRING)",
        "CASE WHEN job_id % 17 = 0 THEN '' ELSE cast(requested_cpus + 1 AS STRING) END",
        memory,
        "coalesce(cast(user_id AS STRING), '')",
        "cast(group_id AS STRING)",
        "queue_id",
        "CASE status WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'cancelled by 10' ELSE '' END",
    ]
    lines = once(spread(df), {"value": F.expr(_text(*fields))}, keep=["job_id"])
    steps = lines.filter("job_id % 20 = 7").select(
        F.expr("concat(job_id, '.batch|', substring(value, instr(value, '|') + 1))").alias("value"), "job_id"
    )
    return lines.unionByName(steps).select("value")


def raw_pbs(base: DataFrame) -> DataFrame:
    """PBS accounting lines: an exit record per job, a queue record for every 10th."""
    attrs = [
        "'user=', coalesce(cast(user_id AS STRING), '')",
        "' group=', group_id",
        "' queue=', queue_id",
        "CASE WHEN job_id % 3 = 0 THEN '' ELSE concat(' ctime=', submit_ts) END",
        "CASE WHEN job_id % 3 = 1 THEN '' ELSE concat(' qtime=', submit_ts) END",
        "CASE WHEN job_id % 8 = 0 THEN '' ELSE concat(' start=', start_ts) END",
        "CASE WHEN job_id % 5 = 0 THEN '' ELSE concat(' end=', end_ts) END",
        "CASE WHEN job_id % 2 = 0 THEN concat(' Resource_List.nodes=1:ppn=', requested_cpus, '+2:ppn=3')"
        " ELSE concat(' Resource_List.ncpus=', requested_cpus) END",
        "CASE WHEN requested_mem IS NULL THEN '' ELSE concat(' Resource_List.mem=', requested_mem, 'mb') END",
        f"CASE WHEN runtime_requested_sec IS NULL THEN '' ELSE concat(' Resource_List.walltime=', {_clock('runtime_requested_sec')}) END",
        f"' resources_used.walltime=', {_clock('runtime_actual_sec')}",
        "' Exit_status=', job_id % 4",
    ]
    body = "concat(" + ", ".join(attrs) + ")"
    stamp = "date_format(timestamp_seconds(submit_ts), 'MM/dd/yyyy HH:mm:ss')"
    job = "CASE WHEN job_id % 9 = 0 THEN concat(job_id, '[2].srv') ELSE concat(job_id, '.srv') END"
    exits = once(spread(base), {"value": F.expr(f"concat_ws(';', {stamp}, 'E', {job}, {body})")})
    queued = once(
        spread(base.filter("job_id % 10 = 0")),
        {"value": F.expr(f"concat_ws(';', {stamp}, 'Q', {job}, concat('queue=', queue_id))")},
    )
    return exits.unionByName(queued)


def raw_extract(base: DataFrame) -> DataFrame:
    """Headerless 17-field extracts with step and array rows mixed in."""
    fields = [
        "CASE WHEN job_id % 10 = 0 THEN concat(job_id, '_3') WHEN job_id % 10 = 1 THEN concat(job_id, '.0') ELSE cast(job_id AS STRING) END",
        "concat('n', job_id)",
        "coalesce(cast(user_id AS STRING), '')",
        "cast(group_id AS STRING)",
        "queue_id",
        "'acct'",
        "CASE WHEN job_id % 6 = 0 THEN 'R' ELSE 'COMPLETED' END",
        _iso("submit_ts"),
        f"CASE WHEN job_id % 11 = 0 THEN 'Unknown' ELSE {_iso('start_ts')} END",
        f"CASE WHEN job_id % 4 = 0 THEN 'Unknown' ELSE {_iso('end_ts')} END",
        _dashed("runtime_actual_sec + 86400"),
        f"CASE WHEN runtime_requested_sec IS NULL THEN '' ELSE {_dashed('runtime_requested_sec')} END",
        "cast(requested_cpus AS STRING)",
        "'1'",
        "'4G'",
        "''",
        "'0:0'",
    ]
    return once(spread(base), {"value": F.expr(_text(*fields))})


def raw_qstat(base: DataFrame) -> DataFrame:
    """qstat documents, one per job; every 25th is cut off and so unreadable."""
    day = "date_format(timestamp_seconds({0}), 'E MMM d HH:mm:ss yyyy')"
    info = (
        "named_struct('Job_Name', concat('n', job_id), 'Job_Owner', concat('u', coalesce(user_id, -1), '@host'),"
        " 'queue', queue_id, 'job_state', CASE WHEN job_id % 6 = 0 THEN 'R' ELSE 'F' END,"
        f" 'Resource_List', named_struct('walltime', {_clock('coalesce(runtime_requested_sec, 0)')},"
        " 'ncpus', requested_cpus, 'select', concat(1 + job_id % 4, ':ncpus=2')),"
        f" 'resources_used', named_struct('walltime', {_clock('runtime_actual_sec')}),"
        f" 'ctime', {day.format('submit_ts')}, 'stime', {day.format('start_ts')},"
        f" 'mtime', {_iso('end_ts')}, 'Exit_status', job_id % 3)"
    )
    doc = f"to_json(named_struct('Jobs', map(concat(job_id, '.srv'), {info})))"
    return once(spread(base), {"value": F.expr(f"CASE WHEN job_id % 25 = 0 THEN substring({doc}, 1, 40) ELSE {doc} END")})


def replay_rows(base: DataFrame) -> DataFrame:
    """Rows of a replay tool's job CSV (text ids, fractional times)."""
    return base.selectExpr(
        "concat('w0!', job_id) AS job_id",
        "submit_ts + 0.25D AS submission_time",
        "start_ts + 0.75D AS starting_time",
        "CASE WHEN job_id % 9 = 0 THEN NULL ELSE cast(end_ts AS DOUBLE) END AS finish_time",
        "cast(runtime_actual_sec - job_id % 2 AS DOUBLE) AS execution_time",
        "CASE WHEN job_id % 12 = 0 THEN 0 ELSE requested_cpus END AS requested_number_of_resources",
        "cast(coalesce(runtime_requested_sec, -1) AS DOUBLE) AS requested_time",
    )


def replay_workload(base: DataFrame) -> DataFrame:
    """Workload metadata: JSON text per job, broken for every 30th."""
    extra = "to_json(named_struct('user_id', user_id, 'group_id', group_id, 'queue_id', queue_id, 'partition_id', partition_id))"
    return base.selectExpr(
        "cast(job_id AS STRING) AS id", f"CASE WHEN job_id % 30 = 0 THEN '{{broken' ELSE {extra} END AS extra_data"
    )


def snapshots(base: DataFrame) -> DataFrame:
    """Queued jobs grouped into snapshots (64 jobs each), with free CPUs."""
    return base.selectExpr(
        "job_id DIV 64 AS snapshot_id",
        "job_id",
        "submit_ts",
        "requested_cpus",
        "coalesce(runtime_requested_sec, runtime_actual_sec) AS runtime_estimate_sec",
        "CASE WHEN job_id % 6 = 0 THEN NULL ELSE -cast(wait_sec % 1000 AS DOUBLE) END AS priority_score",
        "100 + (job_id DIV 64) % 200 AS free_cpus",
    )


def snapshot_documents(base: DataFrame) -> DataFrame:
    """One snapshot document per job, some inconsistent (more free CPUs than exist)."""
    doc = (
        "to_json(named_struct('clock_ts', submit_ts, 'capacity_cpus', 64, 'free_cpus', job_id % 70,"
        " 'queued_jobs', array(named_struct('job_id', job_id, 'submit_ts', submit_ts, 'requested_cpus', requested_cpus,"
        " 'runtime_estimate_sec', runtime_actual_sec - 20000)),"
        " 'running_jobs', array(named_struct('job_id', job_id + 1, 'end_ts', end_ts, 'allocated_cpus', allocated_cpus))))"
    )
    return once(spread(base), {"value": F.expr(doc)})


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per key in whole seconds."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS key", "unix_timestamp(ts) AS ts")


def bench_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: one per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS profile_id",
        "event_id AS run_id",
        "unix_timestamp(ts) AS ts",
        "CASE WHEN event_id % 9 = 0 THEN 'fail' ELSE 'pass' END AS status",
        "value AS rate",
    )
