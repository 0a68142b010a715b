"""DuckDB SQL for the registered queries, written against the plain tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

JOBS = """
jobs0 AS (
  SELECT o_orderkey AS job_id,
         CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey * 7919) % 86400 AS submit_ts,
         (o_custkey * 131 + o_orderkey * 17) % 432000 AS wait_sec,
         30 + CAST(FLOOR(o_totalprice) AS BIGINT) % 40000 AS runtime_actual_sec,
         CAST(POWER(2, (o_orderkey * 31 + o_custkey) % 8) AS INT) AS requested_cpus,
         o_orderstatus AS status,
         CASE WHEN o_custkey % 61 = 0 THEN NULL ELSE o_custkey % 60 END AS user_id,
         o_custkey % 7 AS group_id,
         substring(o_orderpriority, 1, 1) AS queue_id,
         o_custkey
  FROM orders),
jobs AS (
  SELECT job_id, submit_ts, submit_ts + wait_sec AS start_ts,
         submit_ts + wait_sec + runtime_actual_sec AS end_ts, wait_sec, runtime_actual_sec,
         CASE WHEN job_id % 7 = 0 THEN NULL ELSE runtime_actual_sec * (1 + o_custkey % 9) // 4 END AS runtime_requested_sec,
         requested_cpus AS allocated_cpus, requested_cpus,
         CASE WHEN job_id % 5 = 0 THEN NULL ELSE CAST(requested_cpus AS BIGINT) * 1000 END AS requested_mem,
         status, user_id, group_id, queue_id, queue_id AS partition_id
  FROM jobs0),
jobs_r AS (SELECT *, CAST(runtime_requested_sec AS DOUBLE) / runtime_actual_sec AS runtime_overrequest_ratio FROM jobs)
"""


def _cands(src: str = "jobs", key: str = "'{0}'") -> str:
    waits = {
        "cand_a": "wait_sec * 9 // 10",
        "cand_b": "wait_sec * 11 // 10",
        "cand_c": "CASE WHEN user_id % 2 = 0 THEN wait_sec // 2 ELSE wait_sec END",
    }
    parts = [
        f"SELECT {key.format(n)} AS policy_id, job_id, submit_ts, w AS wait_sec, submit_ts + w AS start_ts,"
        f" submit_ts + w + runtime_actual_sec AS end_ts, runtime_actual_sec, requested_cpus, user_id, queue_id"
        f" FROM (SELECT *, {w} AS w FROM {src})"
        for n, w in waits.items()
    ]
    return "cands AS (" + " UNION ALL ".join(parts) + ")"


CANDS = _cands()


def put(name: str, sql: str, ctes: str = JOBS) -> None:
    ORACLES[name] = f"WITH {ctes}\n{sql}" if ctes else sql


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0e0 AS {alias or expr}"


W = "greatest(start_ts - submit_ts, 0)"
RUN = "greatest(end_ts - start_ts, 0)"
BSLD = f"(CAST({W} + {RUN} AS DOUBLE) / greatest({RUN}, 60))"


def objective(src: str, name: str, by: str = "", cap: int = 128) -> str:
    """CTEs ending in `name` with the objective metrics of `src`."""
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""
{name}_b AS (SELECT {k}count(*) AS n, avg({W}) AS mean_wait, quantile_cont(CAST({W} AS DOUBLE), 0.95) AS p95w,
    quantile_cont({BSLD}, 0.95) AS p95b, min(submit_ts) AS lo, max(end_ts) AS hi,
    sum(CAST(requested_cpus AS DOUBLE) * {RUN}) AS cpu,
    avg(CASE WHEN {W} > 172800 THEN 1.0e0 ELSE 0.0e0 END) AS starved_rate,
    sum(CASE WHEN {W} > 172800 THEN 1.0e0 ELSE 0.0e0 END) AS starved_jobs FROM {src} {g}),
{name}_u AS (SELECT {k}coalesce(user_id, -1) AS u, sum(CAST(requested_cpus AS DOUBLE) * {RUN}) AS c FROM {src} GROUP BY {k}u),
{name}_t AS (SELECT {k}sum(c) AS t, count(*) AS m FROM {name}_u {g}),
{name}_f AS (SELECT {k}0.5e0 * sum(abs(c / t - 1.0e0 / m)) AS fairness_dev,
    sum(c / t) * sum(c / t) / (max(m) * sum((c / t) * (c / t))) AS jain, CAST(max(m) AS DOUBLE) AS active_users
    FROM {name}_u JOIN {name}_t {join} {g}),
{name} AS (SELECT {k}CAST(n AS DOUBLE) AS job_count, mean_wait AS mean_wait_sec, p95w AS p95_wait_sec,
    n / CAST(hi - lo AS DOUBLE) AS throughput, CAST(hi - lo AS DOUBLE) AS makespan_sec,
    greatest(0.0e0, least(1.0e0, cpu / (CAST(hi - lo AS DOUBLE) * {cap}))) AS utilization_cpu, p95b AS p95_bsld,
    starved_rate, starved_jobs, CAST(n AS DOUBLE) AS total_jobs, fairness_dev, jain, active_users
    FROM {name}_b JOIN {name}_f {join})"""


METRICS = (
    "job_count mean_wait_sec p95_wait_sec throughput makespan_sec utilization_cpu p95_bsld starved_rate starved_jobs "
    "total_jobs fairness_dev jain active_users"
).split()

# --------------------------------------------------------------------------- metrics

put("objective_metrics", "SELECT " + ", ".join(r(m, 9) for m in METRICS) + " FROM o", JOBS + "," + objective("jobs", "o"))
put(
    "objective_by_policy",
    "SELECT policy_id, " + ", ".join(r(m, 8) for m in METRICS) + " FROM o",
    f"{JOBS}, {CANDS}, {objective('cands', 'o', 'policy_id')}",
)
NB = f"greatest(CAST({W} AS DOUBLE) / greatest({RUN}, 10), 1.0e0)"
put(
    "job_metrics_nearest",
    f"""SELECT n AS job_count, {r('mw', 8, 'mean_wait_sec')}, {r('w', 8, 'p95_wait_sec')}, {r('b', 8, 'p95_bsld')},
  {r('span', 8, 'makespan_sec')}, {r('greatest(0.0e0, least(1.0e0, cpu / (128 * span)))', 8, 'utilization_mean')}
  FROM (SELECT count(*) AS n, avg({W}) AS mw, CAST(max(end_ts) - min(submit_ts) AS DOUBLE) AS span,
          sum(CAST(requested_cpus AS DOUBLE) * {RUN}) AS cpu,
          list_sort(list({W}))[CAST(round((count(*) - 1) * 0.95e0) AS BIGINT) + 1] AS w,
          list_sort(list({NB}))[CAST(round((count(*) - 1) * 0.95e0) AS BIGINT) + 1] AS b FROM jobs)""",
)
put(
    "starvation",
    f"""SELECT queue_id, {r('avg(l)', 9, 'starved_rate')}, sum(l) AS starved_jobs, CAST(count(*) AS DOUBLE) AS total_jobs
  FROM (SELECT queue_id, CASE WHEN {W} > 172800 THEN 1.0e0 ELSE 0.0e0 END AS l FROM jobs) GROUP BY queue_id""",
)
put(
    "fairness_by_user",
    "SELECT CAST(u AS VARCHAR) AS user_key, c AS cpu_sec, round(c / t, 9) AS share FROM o_u JOIN o_t ON TRUE",
    JOBS + "," + objective("jobs", "o"),
)
put(
    "fairness",
    f"SELECT queue_id, {r('fairness_dev', 9)}, {r('jain', 9)}, active_users FROM o",
    JOBS + "," + objective("jobs", "o", "queue_id"),
)
put("infer_capacity", "SELECT CAST(max(greatest(requested_cpus, allocated_cpus)) AS BIGINT) AS capacity_cpus FROM jobs")

# --------------------------------------------------------------------------- sources

SWF_STATUS = "CASE status WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE '5' END"
put(
    "swf_parse",
    f"""SELECT CAST(job_id AS VARCHAR) AS job_id, submit_ts, start_ts, end_ts, wait_sec, runtime_actual_sec,
  runtime_requested_sec, allocated_cpus, requested_cpus, requested_mem, {SWF_STATUS} AS status,
  CAST(user_id AS VARCHAR) AS user_id, CAST(group_id AS VARCHAR) AS group_id, queue_id, partition_id,
  {r('runtime_overrequest_ratio')} FROM jobs_r WHERE job_id % 50 <> 0""",
)
put(
    "swf_line_stats",
    """SELECT count(*) AS total_lines, count(*) FILTER (job_id % 50 = 0 AND job_id // 50 % 3 = 0) AS comment_lines,
  count(*) FILTER (job_id % 50 = 0 AND job_id // 50 % 3 = 1) AS blank_lines,
  count(*) FILTER (job_id % 50 = 0 AND job_id // 50 % 3 = 2) AS malformed_lines,
  count(*) FILTER (job_id % 50 <> 0) AS parsed_rows FROM jobs""",
)
put(
    "sacct_parse",
    """SELECT CASE WHEN job_id % 10 = 0 THEN job_id || '_1' ELSE CAST(job_id AS VARCHAR) END AS job_id, submit_ts,
  s AS start_ts, coalesce(e, s + el, s) AS end_ts, s - submit_ts AS wait_sec,
  coalesce(el, greatest(coalesce(e, s) - s, 0)) AS runtime_actual_sec, allocated_cpus,
  CAST(CASE WHEN job_id % 17 = 0 THEN allocated_cpus ELSE requested_cpus + 1 END AS INT) AS requested_cpus,
  requested_mem * CASE WHEN job_id % 3 = 1 THEN 1024 ELSE 1000 END // 1000 AS requested_mem,
  CASE status WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'CANCELLED' ELSE 'UNKNOWN' END AS status,
  CAST(user_id AS VARCHAR) AS user_id, CAST(group_id AS VARCHAR) AS group_id, queue_id, partition_id,
  CASE WHEN job_id % 10 = 0 THEN '1' END AS array_index
  FROM (SELECT *, CASE WHEN job_id % 13 = 0 THEN NULL ELSE runtime_actual_sec + job_id % 3 * 86400 END AS el,
          CASE WHEN job_id % 11 = 0 THEN submit_ts ELSE start_ts END AS s,
          CASE WHEN job_id % 4 = 0 THEN NULL ELSE end_ts END AS e FROM jobs)""",
)
ORACLES["sacct_mixed_headers"] = ORACLES["sacct_parse"]
put(
    "sacct_line_stats",
    """SELECT count(*) + count(*) FILTER (job_id % 20 = 7) AS total_lines, CAST(0 AS BIGINT) AS header_lines,
  CAST(0 AS BIGINT) AS blank_lines, count(*) FILTER (job_id % 20 = 7) AS step_lines_skipped,
  CAST(0 AS BIGINT) AS malformed_lines, count(*) AS parsed_rows FROM jobs""",
)
put(
    "pbs_parse",
    f"""SELECT CASE WHEN job_id % 9 = 0 THEN job_id || '_2' ELSE CAST(job_id AS VARCHAR) END AS job_id, submit_ts,
  s AS start_ts, e AS end_ts, s - submit_ts AS wait_sec, runtime_actual_sec, runtime_requested_sec,
  c AS allocated_cpus, c AS requested_cpus, requested_mem, CAST(job_id % 4 AS VARCHAR) AS status,
  CAST(user_id AS VARCHAR) AS user_id, CAST(group_id AS VARCHAR) AS group_id, queue_id, partition_id,
  {r('CASE WHEN runtime_requested_sec > 0 THEN runtime_overrequest_ratio END', 6, 'runtime_overrequest_ratio')}
  FROM (SELECT *, CASE WHEN job_id % 8 = 0 THEN submit_ts ELSE start_ts END AS s,
    CASE WHEN job_id % 5 <> 0 THEN end_ts WHEN job_id % 8 = 0 THEN submit_ts + runtime_actual_sec
         ELSE start_ts + runtime_actual_sec END AS e,
    CAST(CASE WHEN job_id % 2 = 0 THEN requested_cpus + 6 ELSE requested_cpus END AS INT) AS c FROM jobs_r)""",
)
put(
    "pbs_line_stats",
    """SELECT count(*) + count(*) FILTER (job_id % 10 = 0) AS total_lines, CAST(0 AS BIGINT) AS blank_lines,
  count(*) FILTER (job_id % 10 = 0) AS non_exit_records, CAST(0 AS BIGINT) AS malformed_lines, count(*) AS parsed_rows
  FROM jobs""",
)
EXTRACT = """(SELECT *, CASE WHEN job_id % 6 = 0 THEN 'R' ELSE 'COMPLETED' END AS state,
  CASE WHEN job_id % 11 = 0 THEN NULL ELSE start_ts END AS s, CASE WHEN job_id % 4 = 0 THEN NULL ELSE end_ts END AS e,
  runtime_actual_sec + 86400 AS run, coalesce(runtime_requested_sec, 0) AS asked
  FROM jobs WHERE job_id % 10 NOT IN (0, 1))"""
put(
    "sacct_extract_parse",
    f"""SELECT job_id, 'n' || job_id AS job_name, coalesce(CAST(user_id AS VARCHAR), '') AS "user",
  CAST(group_id AS VARCHAR) AS "group", queue_id AS "partition", state, submit_ts, s AS start_ts, e AS end_ts,
  run AS runtime_actual_sec, asked AS runtime_requested_sec, CAST(requested_cpus AS BIGINT) AS requested_cpus,
  CAST(1 AS BIGINT) AS requested_nodes, '0:0' AS exit_code FROM {EXTRACT}""",
)
put(
    "live_to_canonical",
    f"""SELECT job_id, submit_ts, coalesce(s, 0) AS start_ts, coalesce(e, 0) AS end_ts, run AS runtime_actual_sec,
  asked AS runtime_requested_sec, CAST(requested_cpus AS BIGINT) AS requested_cpus,
  coalesce(CAST(user_id AS VARCHAR), '') AS user_id, CAST(group_id AS VARCHAR) AS group_id, queue_id, partition_id,
  CAST(0 AS BIGINT) AS requested_mem FROM {EXTRACT}""",
)
put(
    "sync_summary",
    f"""SELECT count(*) AS jobs_ingested, count(*) FILTER (state = 'R') AS jobs_running,
  count(*) FILTER (job_id % 3 <> 0) AS recommendations_generated, count(*) FILTER (job_id % 3 = 0) AS errors
  FROM {EXTRACT}""",
)
put(
    "qstat_json_parse",
    """SELECT CAST(job_id AS VARCHAR) AS job_id, 'n' || job_id AS job_name, 'u' || coalesce(user_id, -1) AS "user",
  queue_id AS queue, CASE WHEN job_id % 6 = 0 THEN 'R' ELSE 'F' END AS state, submit_ts, start_ts, end_ts,
  runtime_actual_sec, coalesce(runtime_requested_sec, 0) AS runtime_requested_sec,
  CAST(requested_cpus AS BIGINT) AS requested_cpus, 1 + job_id % 4 AS requested_nodes, job_id % 3 AS exit_status
  FROM jobs WHERE job_id % 25 <> 0""",
)
put(
    "replay_csv_import",
    """SELECT CAST(job_id AS VARCHAR) AS job_id, submit_ts, start_ts, start_ts + run AS end_ts, run AS runtime_actual_sec,
  CASE WHEN runtime_requested_sec > 0 THEN CAST(runtime_requested_sec AS DOUBLE) END AS runtime_requested_sec,
  CAST(CASE WHEN job_id % 12 = 0 THEN 1 ELSE requested_cpus END AS BIGINT) AS requested_cpus,
  CASE WHEN job_id % 30 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN job_id % 30 <> 0 THEN CAST(group_id AS VARCHAR) END AS group_id,
  CASE WHEN job_id % 30 <> 0 THEN queue_id END AS queue_id, CASE WHEN job_id % 30 <> 0 THEN partition_id END AS partition_id
  FROM (SELECT *, CASE WHEN job_id % 9 = 0 THEN runtime_actual_sec - job_id % 2 ELSE runtime_actual_sec END AS run FROM jobs)""",
)
put(
    "workload_export_jobs",
    """SELECT CAST(job_id AS VARCHAR) AS id, CAST(submit_ts AS DOUBLE) AS subtime,
  CAST(least(requested_cpus, 64) AS BIGINT) AS res, 'delay_ms_' || runtime_actual_sec * 1000 AS profile,
  CASE WHEN runtime_requested_sec > 0 THEN CAST(runtime_requested_sec AS DOUBLE) END AS walltime,
  CAST(json_object('group_id', group_id, 'partition_id', partition_id, 'queue_id', queue_id, 'user_id', user_id) AS VARCHAR) AS extra_data
  FROM jobs""",
)
put(
    "workload_export_profiles",
    """SELECT DISTINCT 'delay_ms_' || runtime_actual_sec * 1000 AS profile, 'DelayProfile' AS type,
  CAST(runtime_actual_sec AS DOUBLE) AS delay FROM jobs""",
)
put(
    "jobs_json_export",
    "SELECT job_id, submit_ts, runtime_actual_sec, CAST(requested_cpus AS BIGINT) AS requested_cpus FROM jobs",
)

# --------------------------------------------------------------------------- quality

put(
    "quality_report",
    f"""SELECT count(*) FILTER (k) AS row_count, count(*) FILTER (k AND requested_mem IS NULL) AS requested_mem_null_rows,
  {r("avg(CASE WHEN requested_mem IS NULL THEN 1.0e0 ELSE 0.0e0 END) FILTER (k)", 9, "requested_mem_null_rate")},
  count(*) FILTER (k AND runtime_requested_sec IS NULL) AS runtime_requested_null_rows,
  count(*) FILTER (k) AS requested_cpu_fallback_rows, count(*) AS total_lines,
  count(*) FILTER (NOT k AND job_id // 50 % 3 = 0) AS comment_lines,
  count(*) FILTER (NOT k AND job_id // 50 % 3 = 1) AS blank_lines,
  count(*) FILTER (NOT k AND job_id // 50 % 3 = 2) AS malformed_lines, count(*) FILTER (k) AS parsed_rows
  FROM (SELECT *, job_id % 50 <> 0 AS k FROM jobs)""",
)
JOB_COLUMNS = (
    "job_id submit_ts start_ts end_ts wait_sec runtime_actual_sec runtime_requested_sec allocated_cpus requested_cpus "
    "requested_mem status user_id group_id queue_id partition_id runtime_overrequest_ratio"
).split()
put(
    "null_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END)', 9, 'null_rate')} FROM jobs_r"
        for c in JOB_COLUMNS
    ),
)
put(
    "suite_verify",
    """SELECT filename, trace_id, sha256_expected, sha256_observed,
  CASE WHEN trace_id IS NULL THEN 'unlisted' WHEN sha256_observed IS NULL THEN 'missing'
       WHEN sha256_expected IS NULL THEN 'unlocked' WHEN sha256_expected <> sha256_observed THEN 'mismatch'
       ELSE 'locked' END AS status
  FROM (SELECT 't' || doc_id AS trace_id, 'doc' || doc_id AS filename,
          CASE WHEN doc_id % 4 = 0 THEN sha256('other') WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha256_expected
        FROM documents WHERE doc_id % 3 <> 0)
  FULL JOIN (SELECT 'doc' || doc_id AS filename, sha256(text) AS sha256_observed FROM documents WHERE doc_id % 5 <> 0)
  USING (filename)""",
    "",
)

# --------------------------------------------------------------------------- coercion, checks, estimates

put(
    "coerce_features",
    """SELECT job_id, submit_ts, start_ts, CASE WHEN job_id % 19 = 0 THEN 0 ELSE runtime_actual_sec END AS runtime_actual_sec,
  CAST(CASE WHEN job_id % 23 = 0 THEN 1 ELSE requested_cpus END AS INT) AS requested_cpus,
  CAST(NULL AS VARCHAR) AS partition_id FROM jobs WHERE job_id % 29 <> 0""",
)
put(
    "coerce_trace",
    """SELECT job_id, submit_ts, runtime_actual_sec, requested_cpus, q AS runtime_requested_sec,
  coalesce(q, runtime_actual_sec) AS runtime_estimate_sec
  FROM (SELECT *, CASE WHEN job_id % 6 <> 0 AND runtime_requested_sec > 0 THEN runtime_requested_sec END AS q FROM jobs)""",
)
put("observed_jobs", "SELECT job_id, submit_ts, start_ts, end_ts, requested_cpus FROM jobs WHERE job_id % 31 <> 0")
HOUR = "CAST((submit_ts // 3600) % 24 AS INT)"
DOW = "CAST((submit_ts // 86400 + 3) % 7 AS INT)"
put(
    "training_frame",
    f"""SELECT job_id, CAST(requested_cpus AS DOUBLE) AS requested_cpus,
  CAST(CASE WHEN runtime_requested_sec > 0 THEN runtime_requested_sec END AS DOUBLE) AS runtime_requested_sec,
  CAST(requested_mem AS DOUBLE) AS requested_mem, queue_id, partition_id, user_id, group_id,
  {HOUR} AS submit_hour, {DOW} AS submit_dow, 1.0e0 AS user_overrequest_mean_lookback,
  CASE WHEN job_id % 4 = 0 THEN (SELECT quantile_cont(CAST(runtime_actual_sec AS DOUBLE), 0.5) FROM jobs)
       ELSE CAST(wait_sec AS DOUBLE) END AS user_runtime_median_lookback,
  CAST(0 AS BIGINT) AS queue_congestion_at_submit_jobs, CAST(runtime_actual_sec AS DOUBLE) AS runtime_actual_sec FROM jobs""",
)
put(
    "eval_frame",
    f"SELECT job_id, {HOUR} AS submit_hour, {DOW} AS submit_dow, CAST(NULL AS DOUBLE) AS queue_id, requested_cpus FROM jobs",
)
BASE_EST = "CASE WHEN runtime_requested_sec > 0 THEN runtime_requested_sec ELSE runtime_actual_sec END"
FALLBACK = "CASE WHEN runtime_requested_sec > 0 THEN 'requested_fallback' ELSE 'actual_fallback' END"


def four(expr: str) -> str:
    names = ("runtime_p50_sec", "runtime_p90_sec", "runtime_guard_sec", "runtime_estimate_sec")
    return ", ".join(f"{expr} AS {n}" for n in names)


put("attach_estimates_default", f"SELECT job_id, {four(BASE_EST)}, {FALLBACK} AS estimate_source FROM jobs")


def preds(member: int) -> str:
    factor = "(80 + job_id % 41)" if member == 1 else "(70 + job_id % 71)"
    return f"""preds{member} AS (SELECT job_id, CAST(p * 6 // 10 AS DOUBLE) AS p10, CAST(p AS DOUBLE) AS p50,
  CAST(p * 15 // 10 AS DOUBLE) AS p90 FROM (SELECT job_id, runtime_actual_sec * {factor} // 100 AS p FROM jobs))"""


EST = f"""est AS (SELECT j.*, p10, {BASE_EST} AS base, {FALLBACK} AS fb,
  greatest(1, CAST(round_even(p50, 0) AS BIGINT)) AS q50,
  greatest(1, CAST(round_even(p10, 0) AS BIGINT)) AS q10,
  greatest(greatest(1, CAST(round_even(p50, 0) AS BIGINT)), CAST(round_even(p90, 0) AS BIGINT)) AS q90,
  p50 IS NOT NULL AS known FROM jobs j LEFT JOIN (SELECT * FROM preds1 WHERE job_id % 4 <> 0) USING (job_id))"""


def est(chosen: str, guard: str) -> str:
    return f"""SELECT job_id, CASE WHEN known THEN q50 ELSE base END AS runtime_p50_sec,
  CASE WHEN known THEN q90 ELSE base END AS runtime_p90_sec,
  greatest(1, CASE WHEN known THEN CAST(round_even({guard}, 0) AS BIGINT) ELSE base END) AS runtime_guard_sec,
  CASE WHEN known THEN {chosen} ELSE base END AS runtime_estimate_sec,
  CASE WHEN known THEN 'prediction' ELSE fb END AS estimate_source FROM est"""


put("attach_estimates", est("q50", "q50 + 0.5e0 * (q90 - q50)"), f"{JOBS}, {preds(1)}, {EST}")
put("attach_estimates_p10", est("q10", "q10 + 0.25e0 * (q50 - q10)"), f"{JOBS}, {preds(1)}, {EST}")
put(
    "estimate_accounting",
    f"""SELECT count(*) FILTER (s = 'prediction') AS prediction_used_count,
  count(*) FILTER (s = 'requested_fallback') AS requested_fallback_count,
  count(*) FILTER (s = 'actual_fallback') AS actual_fallback_count,
  CAST(0 AS BIGINT) AS tsafrir_history_count, CAST(0 AS BIGINT) AS tsafrir_cold_start_count,
  {r("count(*) FILTER (s = 'prediction') / CAST(count(*) AS DOUBLE)", 9, 'prediction_used_rate')},
  {r("count(*) FILTER (s = 'requested_fallback') / CAST(count(*) AS DOUBLE)", 9, 'requested_fallback_rate')},
  {r("count(*) FILTER (s = 'actual_fallback') / CAST(count(*) AS DOUBLE)", 9, 'actual_fallback_rate')},
  0.0e0 AS tsafrir_history_rate, 0.0e0 AS tsafrir_cold_start_rate, count(*) AS total_scheduled_jobs
  FROM (SELECT CASE WHEN known THEN 'prediction' ELSE fb END AS s FROM est)""",
    f"{JOBS}, {preds(1)}, {EST}",
)
put(
    "prediction_features",
    """SELECT job_id, submit_ts, requested_cpus, runtime_requested_sec, requested_mem, queue_id, partition_id, user_id,
  group_id, 1.0e0 AS user_overrequest_mean_lookback, runtime_requested_sec AS user_runtime_median_lookback,
  CAST(0 AS BIGINT) AS queue_congestion_at_submit_jobs FROM jobs""",
)
put(
    "heuristic_estimates",
    """SELECT job_id, p50 AS runtime_p50_sec, p90 AS runtime_p90_sec,
  CAST(trunc(p50 + 0.5e0 * (p90 - p50)) AS BIGINT) AS runtime_guard_sec
  FROM (SELECT job_id, p50, greatest(p50, CAST(trunc(base * 1.08e0 * f) AS BIGINT)) AS p90
    FROM (SELECT *, greatest(60, CAST(trunc(base * 0.72e0 * f) AS BIGINT)) AS p50
      FROM (SELECT job_id, CASE WHEN runtime_requested_sec <> 0 THEN CAST(runtime_requested_sec AS DOUBLE) ELSE 1800.0e0 END AS base,
              1.0e0 + least(wait_sec % 5000, 2000) / 10000.0e0 AS f FROM jobs)))""",
)
put(
    "job_violations",
    """SELECT * FROM (SELECT job_id, concat_ws(',', CASE WHEN s < submit_ts THEN 'job_start_before_submit' END,
    CASE WHEN e < s THEN 'job_end_before_start' END, CASE WHEN c <= 0 THEN 'job_nonpositive_cpu' END) AS failed_invariants,
    'error' AS severity
  FROM (SELECT job_id, submit_ts, CASE WHEN job_id % 17 = 0 THEN submit_ts - 1 ELSE start_ts END AS s,
          CASE WHEN job_id % 34 = 0 THEN submit_ts - 9 ELSE end_ts END AS e,
          CASE WHEN job_id % 51 = 0 THEN 0 ELSE requested_cpus END AS c FROM jobs)) WHERE failed_invariants <> ''""",
)
OCC = """occ AS (SELECT ts, CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS running_cpus
  FROM (SELECT ts, sum(d) AS d FROM (SELECT start_ts AS ts, requested_cpus AS d FROM jobs
        UNION ALL SELECT end_ts, -requested_cpus FROM jobs) GROUP BY ts))"""
put("occupancy", "SELECT ts, running_cpus, 128 - running_cpus AS free_cpus FROM occ", f"{JOBS}, {OCC}")
put(
    "capacity_violations",
    "SELECT ts, running_cpus, 128 - running_cpus AS free_cpus FROM occ WHERE running_cpus > 128",
    f"{JOBS}, {OCC}",
)
put(
    "free_at",
    """SELECT p.ts, CAST(coalesce(128 - running_cpus, 128) AS BIGINT) AS free_cpus
  FROM (SELECT DISTINCT submit_ts // 50000 * 50000 AS ts FROM jobs) p ASOF LEFT JOIN occ ON p.ts >= occ.ts""",
    f"{JOBS}, {OCC}",
)
put(
    "event_order",
    """SELECT event_id, row_number() OVER (ORDER BY ts, rank, id, event_id) - 1 AS pos
  FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) // 600 AS ts,
          CASE event_id % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS rank,
          CASE WHEN event_id % 8 = 0 THEN -1 ELSE user_id END AS id FROM events)""",
    "",
)
put(
    "snapshot_queued",
    """SELECT submit_ts AS clock_ts, job_id % 70 AS free_cpus, job_id, CAST(requested_cpus AS BIGINT) AS requested_cpus,
  greatest(runtime_actual_sec - 20000, 0) AS runtime_estimate_sec FROM jobs WHERE job_id % 70 <= 64""",
)
put(
    "snapshot_running",
    """SELECT submit_ts AS clock_ts, job_id % 70 AS free_cpus, job_id + 1 AS job_id, end_ts,
  CAST(allocated_cpus AS BIGINT) AS allocated_cpus FROM jobs WHERE job_id % 70 <= 64""",
)
put(
    "state_hash",
    """SELECT job_id, sha256(CAST(json_object('job_id', job_id, 'requested_cpus', requested_cpus, 'submit_ts', submit_ts) AS VARCHAR))
  AS state_hash FROM jobs""",
)

# --------------------------------------------------------------------------- scalar formats

put(
    "scalar_time_formats",
    f"""SELECT job_id, runtime_actual_sec + job_id % 3 * 86400 AS elapsed, runtime_actual_sec AS minutes,
  runtime_actual_sec AS seconds, submit_ts AS iso, submit_ts // 60 * 60 AS minute_stamp, submit_ts AS us,
  submit_ts AS qstat, runtime_actual_sec + (1 + job_id % 4) * 86400 AS walltime, CAST(NULL AS BIGINT) AS "none",
  CAST(hour(to_timestamp(submit_ts) AT TIME ZONE 'UTC') AS INT) AS hour,
  CAST(isodow(to_timestamp(submit_ts) AT TIME ZONE 'UTC') - 1 AS INT) AS dow,
  CAST({HOUR} BETWEEN 8 AND 18 AS INT) AS peak FROM jobs""",
)


def mb(factor: str) -> str:
    return f"CAST(trunc((1 + wait_sec) * ({factor})) AS BIGINT)"


put(
    "scalar_memory_formats",
    f"""SELECT job_id, {mb('1.0e0 / 1024')} AS k, {mb('1.0e0')} AS m, {mb('1024.0e0')} AS g, {mb('1048576.0e0')} AS t,
  {mb('1.0e0')} AS bare, {mb('1.0e0 / 1048576')} AS pb, {mb('1.0e0 / 1024')} AS pkb, {mb('1024.0e0')} AS pgb,
  {mb('1048576.0e0')} AS ptb, {mb('1.0e0 / 1024')} AS pbare FROM jobs""",
)
put(
    "job_id_classes",
    """SELECT job_id AS n, CASE job_id % 5 WHEN 1 THEN job_id || '_7' WHEN 3 THEN job_id || '_7' WHEN 4 THEN 'x' || job_id
    ELSE CAST(job_id AS VARCHAR) END AS id, CASE WHEN job_id % 5 IN (1, 3) THEN '7' END AS array_index,
  job_id % 5 IN (2, 3) AS is_step, CASE WHEN job_id % 2 = 0 THEN job_id || '_3' ELSE CAST(job_id AS VARCHAR) END AS pbs_id
  FROM jobs""",
)
put(
    "nodes_spec",
    """SELECT job_id, CAST(CASE job_id % 4 WHEN 0 THEN requested_cpus * 2 + 3 WHEN 3 THEN NULL ELSE requested_cpus END AS BIGINT) AS cpus
  FROM jobs""",
)
put(
    "attribute_map",
    """SELECT job_id, CASE WHEN user_id IS NULL THEN '0' ELSE CAST(wait_sec AS VARCHAR) END AS a,
  'x=' || user_id AS b FROM jobs""",
)
put(
    "scalar_classes",
    f"""SELECT job_id, CASE WHEN requested_cpus <= 4 THEN 0 WHEN requested_cpus <= 16 THEN 1 WHEN requested_cpus <= 64 THEN 2 ELSE 3 END AS size_class,
  CASE WHEN coalesce(runtime_overrequest_ratio, 1) > 1.3e0 THEN 2 WHEN coalesce(runtime_overrequest_ratio, 1) < 0.9e0 THEN 0 ELSE 1 END AS user_class,
  CASE WHEN job_id % 3 <> 0 THEN wait_sec END AS swf, CASE WHEN job_id % 3 = 0 THEN 'UNKNOWN' ELSE 'CANCELLED' END AS state,
  'delay_ms_' || greatest(1, CAST(round_even(wait_sec / 16.0e0 * 1000, 0) AS BIGINT)) AS profile,
  round(greatest((wait_sec - runtime_actual_sec) * 0.9e0, (wait_sec - runtime_actual_sec) * (0.9e0 - 1)), 6) AS pinball,
  CAST(greatest(wait_sec, 1) AS DOUBLE) AS seconds,
  round(CAST(abs(runtime_actual_sec - wait_sec) AS DOUBLE) / greatest(CASE WHEN wait_sec > 0 THEN wait_sec ELSE 1 END, 60), 6) AS divergence
  FROM jobs_r""",
)

# --------------------------------------------------------------------------- queues and order

EVENTS = """ev AS (SELECT submit_ts AS ts, 0 AS kind, job_id, 1 AS dj, requested_cpus AS dc FROM jobs
  UNION ALL SELECT start_ts, 1, job_id, -1, -requested_cpus FROM jobs),
run AS (SELECT *, sum(dj) OVER w AS sj, sum(dc) OVER w AS sc FROM ev WINDOW w AS (ORDER BY ts, kind, job_id)),
low AS (SELECT *, min(sj) OVER w AS mj, min(sc) OVER w AS mc FROM run WINDOW w AS (ORDER BY ts, kind, job_id))"""
put(
    "queue_at_submit",
    """SELECT job_id, CAST(sj - least(0, mj) - dj AS BIGINT) AS queue_congestion_at_submit_jobs,
  CAST(sc - least(0, mc) - dc AS BIGINT) AS queue_congestion_at_submit_cpu,
  CAST(coalesce(ts - lag(ts) OVER (ORDER BY ts, job_id), 0) AS BIGINT) AS time_since_prev_submit_sec FROM low WHERE kind = 0""",
    f"{JOBS}, {EVENTS}",
)


def obs_queue(src: str, name: str, by: str = "") -> str:
    k, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""{name}_n AS (SELECT {k}ts, sum(dj) AS dj, sum(dc) AS dc FROM (SELECT {k}submit_ts AS ts, 1 AS dj, requested_cpus AS dc FROM {src}
  UNION ALL SELECT {k}start_ts, -1, -requested_cpus FROM {src}) GROUP BY {k}ts),
{name}_s AS (SELECT *, sum(dj) OVER w AS sj, sum(dc) OVER w AS sc FROM {name}_n WINDOW w AS ({p}ORDER BY ts)),
{name}_m AS (SELECT *, min(sj) OVER w AS mj, min(sc) OVER w AS mc FROM {name}_s WINDOW w AS ({p}ORDER BY ts)),
{name} AS (SELECT {k}ts, CAST(dj AS BIGINT) AS delta, CAST(greatest(sj, 0) AS BIGINT) AS clipped,
  CAST(sj - least(0, mj) AS BIGINT) AS queue_len_jobs, CAST(sc - least(0, mc) AS BIGINT) AS queue_len_cpu_demand FROM {name}_m)"""


put("observed_queue", "SELECT ts, queue_len_jobs, queue_len_cpu_demand FROM q", f"{JOBS}, {obs_queue('jobs', 'q')}")
put("profile_queue", "SELECT ts, delta, clipped AS queue_len_jobs FROM q", f"{JOBS}, {obs_queue('jobs', 'q')}")
put(
    "queue_resampled",
    """SELECT g.ts, CAST(coalesce(queue_len_jobs, 0) AS DOUBLE) AS queue_len_jobs
  FROM (SELECT unnest(generate_series(min(ts), max(ts), 3600)) AS ts FROM q) g ASOF LEFT JOIN q ON g.ts >= q.ts""",
    f"{JOBS}, {obs_queue('jobs', 'q')}",
)
put(
    "submit_gaps",
    """SELECT job_id, coalesce(submit_ts - lag(submit_ts) OVER (ORDER BY submit_ts, job_id), 0) AS time_since_prev_submit_sec,
  coalesce(submit_ts - lag(submit_ts) OVER (PARTITION BY coalesce(user_id, -1) ORDER BY submit_ts, job_id), 0) AS user_submit_gap_sec_lookback
  FROM jobs""",
)
SNAP = """snap AS (SELECT job_id // 64 AS snapshot_id, job_id, submit_ts, requested_cpus,
  coalesce(runtime_requested_sec, runtime_actual_sec) AS est,
  CASE WHEN job_id % 6 = 0 THEN 0.0e0 ELSE -CAST(wait_sec % 1000 AS DOUBLE) END AS score, 100 + (job_id // 64) % 200 AS free FROM jobs)"""
_order = {
    "fifo": "submit_ts, job_id",
    "shortest_first": "est, submit_ts, job_id",
    "longest_first": "est DESC, submit_ts, job_id",
    "fairshare": "score DESC, submit_ts, job_id",
}
put(
    "queue_ranks",
    " UNION ALL ".join(
        f"SELECT '{p}' AS policy, snapshot_id, job_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY {o}) AS queue_rank FROM snap"
        for p, o in _order.items()
    ),
    f"{JOBS}, {SNAP}",
)
put(
    "fifo_prefix",
    """SELECT snapshot_id, job_id, CAST(c AS BIGINT) AS cpus_so_far FROM (SELECT *, sum(requested_cpus) OVER (PARTITION BY snapshot_id
  ORDER BY submit_ts, job_id ROWS UNBOUNDED PRECEDING) AS c FROM snap) WHERE c <= free""",
    f"{JOBS}, {SNAP}",
)
put(
    "sliding_counts",
    """SELECT DISTINCT key, ts, CAST(n AS BIGINT) AS in_window, n > 2 AS over_limit
  FROM (SELECT user_id AS key, s AS ts, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n
        FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))""",
    "",
)

# --------------------------------------------------------------------------- history, features, folds

LOOK = """lb AS (SELECT job_id, median(CAST(runtime_actual_sec AS DOUBLE)) OVER w AS med, var_pop(runtime_actual_sec) OVER w AS v,
    count(*) OVER w AS n, avg(runtime_overrequest_ratio) OVER w AS r,
    coalesce(submit_ts - lag(submit_ts) OVER (PARTITION BY coalesce(user_id, -1) ORDER BY submit_ts, job_id), 0) AS gap
  FROM jobs_r WINDOW w AS (PARTITION BY coalesce(user_id, -1) ORDER BY submit_ts, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill AS (SELECT median(CAST(runtime_actual_sec AS DOUBLE)) AS fm, var_pop(runtime_actual_sec) AS fv, median(runtime_overrequest_ratio) AS fr FROM jobs_r),
look AS (SELECT job_id, coalesce(med, fm) AS m, sqrt(coalesce(v, fv)) AS s, n, gap, coalesce(r, fr) AS o FROM lb, fill)"""
LOOK_COLS = f"""{r('m', 6, 'user_runtime_median_lookback')}, {r('s', 3, 'user_runtime_std_lookback')},
  n AS user_job_count_lookback, gap AS user_submit_gap_sec_lookback, {r('o', 6, 'user_overrequest_mean_lookback')}"""
put("user_lookbacks", f"SELECT job_id, {LOOK_COLS} FROM look", f"{JOBS}, {LOOK}")
put(
    "user_lookbacks_causal",
    f"SELECT job_id, {LOOK_COLS} FROM look",
    f"""{JOBS}, k AS (SELECT *, coalesce(user_id, -1) AS u, submit_ts + runtime_actual_sec AS done FROM jobs_r),
lb AS (SELECT a.job_id, median(CAST(b.runtime_actual_sec AS DOUBLE)) AS med, var_pop(b.runtime_actual_sec) AS v, count(b.job_id) AS n,
    avg(b.runtime_overrequest_ratio) AS r FROM k a LEFT JOIN k b ON a.u = b.u AND b.done <= a.submit_ts GROUP BY a.job_id),
g AS (SELECT job_id, coalesce(submit_ts - lag(submit_ts) OVER (PARTITION BY u ORDER BY submit_ts, job_id), 0) AS gap FROM k),
fill AS (SELECT median(CAST(runtime_actual_sec AS DOUBLE)) AS fm, var_pop(runtime_actual_sec) AS fv, median(runtime_overrequest_ratio) AS fr FROM jobs_r),
look AS (SELECT job_id, coalesce(med, fm) AS m, sqrt(coalesce(v, fv)) AS s, n, gap, coalesce(r, fr) AS o FROM lb JOIN g USING (job_id), fill)""",
)
put(
    "feature_table",
    f"""SELECT job_id, submit_ts, start_ts, end_ts, runtime_actual_sec, runtime_requested_sec, requested_cpus, requested_mem,
  user_id, group_id, queue_id, partition_id, {HOUR} AS submit_hour, {DOW} AS submit_dow,
  CAST({HOUR} BETWEEN 8 AND 18 AS INT) AS is_peak_hours,
  CASE WHEN requested_cpus <= 4 THEN 0 WHEN requested_cpus <= 16 THEN 1 WHEN requested_cpus <= 64 THEN 2 ELSE 3 END AS job_size_class,
  time_since_prev_submit_sec, queue_congestion_at_submit_jobs, queue_congestion_at_submit_cpu, {LOOK_COLS},
  CASE WHEN o > 1.3e0 THEN 2 WHEN o < 0.9e0 THEN 0 ELSE 1 END AS user_behavior_pattern
  FROM jobs JOIN qs USING (job_id) JOIN look USING (job_id)""",
    f"{JOBS}, {EVENTS}, qs AS ({ORACLES['queue_at_submit'].split(EVENTS)[1]}), {LOOK}",
)
ASOF = """k AS (SELECT *, coalesce(user_id, -1) AS u, submit_ts + runtime_actual_sec AS done FROM jobs),
pairs AS (SELECT u, done, runtime_actual_sec AS last_run, lag(runtime_actual_sec) OVER (PARTITION BY u ORDER BY done, submit_ts, job_id) AS prev_run,
    row_number() OVER (PARTITION BY u, done ORDER BY submit_ts DESC, job_id DESC) AS rn FROM k),
hist AS (SELECT k.job_id, last_run, prev_run FROM k ASOF LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) p ON k.u = p.u AND k.submit_ts >= p.done)"""
put("asof_history", "SELECT job_id, last_run, prev_run FROM hist", f"{JOBS}, {ASOF}")
TSAFRIR = f"""ts AS (SELECT job_id, asked, CASE WHEN prev_run IS NOT NULL THEN greatest(1, (last_run + prev_run) // 2)
    WHEN last_run IS NOT NULL THEN last_run ELSE asked END AS raw,
    CAST((last_run IS NOT NULL)::INT + (prev_run IS NOT NULL)::INT AS INT) AS h
  FROM hist JOIN (SELECT job_id, {BASE_EST} AS asked FROM jobs) USING (job_id))"""
put(
    "tsafrir",
    """SELECT job_id, greatest(1, least(raw, asked)) AS tsafrir_runtime_sec, h AS tsafrir_history_count, raw > asked AS tsafrir_clamped FROM ts""",
    f"{JOBS}, {ASOF}, {TSAFRIR}",
)
put(
    "attach_estimates_history",
    f"""SELECT job_id, {four('greatest(1, least(raw, asked))')},
  CASE h WHEN 2 THEN 'tsafrir_history_2' WHEN 1 THEN 'tsafrir_history_1' ELSE 'tsafrir_cold_start' END AS estimate_source FROM ts""",
    f"{JOBS}, {ASOF}, {TSAFRIR}",
)
put(
    "fairshare",
    """SELECT a.job_id, round(coalesce(sum(CAST(b.requested_cpus AS DOUBLE) * b.runtime_actual_sec * power(2.0e0, (b.done - a.submit_ts) / 604800.0e0)), 0.0e0), 0) + 0.0e0 AS decayed_usage
  FROM k a LEFT JOIN k b ON a.u = b.u AND b.done <= a.submit_ts GROUP BY a.job_id""",
    f"{JOBS}, {ASOF}",
)
FOLDS = f"""idx AS (SELECT *, row_number() OVER (ORDER BY submit_ts, job_id) - 1 AS row_idx FROM jobs),
c0 AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.7e0, 0) AS BIGINT)) AS t0,
    greatest(1, CAST(round_even(count(*) * 0.15e0, 0) AS BIGINT)) AS v0 FROM jobs),
c1 AS (SELECT *, greatest(1, greatest(1, n - t0 - v0) // 3) AS ts, unnest([0, 1, 2]) AS f FROM c0),
c2 AS (SELECT n, f, t0 + f * ts AS tr, least(n - 1, t0 + f * ts + v0) AS va,
    CASE WHEN f = 2 THEN n ELSE least(n, least(n - 1, t0 + f * ts + v0) + ts) END AS te FROM c1),
seg AS (SELECT f + 1 AS fold_id, 'train' AS segment, CAST(0 AS BIGINT) AS a, tr AS b FROM c2
  UNION ALL SELECT f + 1, 'validation', tr, va FROM c2 UNION ALL SELECT f + 1, 'test', va, te FROM c2),
folds AS (SELECT CAST(fold_id AS INT) AS fold_id, 'anchored_expanding' AS mode, segment, a AS start_idx, b AS end_idx_exclusive, count(*) AS row_count,
    min(submit_ts) AS submit_ts_min, max(submit_ts) AS submit_ts_max FROM seg JOIN idx ON row_idx >= a AND row_idx < b GROUP BY ALL)"""
put("chronological_folds", "SELECT * FROM folds", f"{JOBS}, {FOLDS}")
put(
    "fold_chronology",
    """SELECT fold_id, max(submit_ts_max) FILTER (segment = 'train') <= min(submit_ts_min) FILTER (segment = 'validation')
  AND max(submit_ts_max) FILTER (segment = 'validation') <= min(submit_ts_min) FILTER (segment = 'test') AS chronology_ok
  FROM folds GROUP BY fold_id""",
    f"{JOBS}, {FOLDS}",
)
put(
    "time_split",
    """SELECT job_id, CASE WHEN row_idx < trunc(n * 0.7e0) THEN 'train' WHEN row_idx < trunc(n * 0.85e0) THEN 'valid' ELSE 'test' END AS segment, row_idx
  FROM idx, (SELECT count(*) AS n FROM jobs)""",
    f"{JOBS}, {FOLDS}",
)
put(
    "cv_folds",
    """SELECT CAST(k AS INT) AS fold_id, segment, a AS start_idx, b AS end_idx_exclusive, count(*) AS row_count,
  min(submit_ts) AS submit_ts_min, max(submit_ts) AS submit_ts_max FROM (
    SELECT k, 'train' AS segment, CAST(0 AS BIGINT) AS a, n // 4 * k AS b FROM (SELECT count(*) AS n, unnest([1, 2, 3]) AS k FROM jobs)
    UNION ALL SELECT k, 'validation', n // 4 * k, least(n // 4 * (k + 1), n) FROM (SELECT count(*) AS n, unnest([1, 2, 3]) AS k FROM jobs))
  JOIN idx ON row_idx >= a AND row_idx < b GROUP BY ALL""",
    f"{JOBS}, {FOLDS}",
)
put("stable_order", "SELECT job_id, row_idx FROM idx", f"{JOBS}, {FOLDS}")

# --------------------------------------------------------------------------- profile


def qc(expr: str, p: float) -> str:
    return f"quantile_cont(CAST({expr} AS DOUBLE), {p})"


SIZES = ", ".join(
    [r(qc("requested_cpus", p), 6, f"requested_cpus_p{int(p * 100)}") for p in (0.5, 0.9, 0.99)]
    + ["CAST(max(requested_cpus) AS DOUBLE) AS requested_cpus_max"]
)


def tails(digits: int) -> str:
    cols = [r(qc("runtime_actual_sec", p), digits, f"runtime_p{int(p * 100)}_sec") for p in (0.5, 0.9, 0.95, 0.99)]
    ratio = f"{qc('runtime_actual_sec', 0.99)} / {qc('runtime_actual_sec', 0.5)}"
    return ", ".join([*cols, r(ratio, digits, "tail_ratio_p99_over_p50")])


def over(digits: int) -> str:
    cols = [r(qc("runtime_overrequest_ratio", p), digits, f"ratio_p{int(p * 100)}") for p in (0.5, 0.9, 0.95)]
    return ", ".join(["count(runtime_overrequest_ratio) AS sample_size", *cols])


def congestion(digits: int) -> str:
    return (
        f"{r('avg(clipped)', digits, 'queue_len_mean')}, {r(qc('clipped', 0.95), digits, 'queue_len_p95')}, "
        "CAST(max(clipped) AS DOUBLE) AS queue_len_max, count(*) AS event_count"
    )


def users(digits: int) -> str:
    return f"""SELECT count(*) AS unique_users, {r('max(n) / CAST(sum(n) AS DOUBLE)', digits, 'top_user_share')},
  {r('sum(n) FILTER (rk <= 5) / CAST(sum(n) AS DOUBLE)', digits, 'top_5_users_share')},
  {r('sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n))', digits, 'user_hhi')}
  FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS rk FROM (SELECT coalesce(user_id, -1) AS u, count(*) AS n FROM jobs GROUP BY u))"""


put("profile_sizes", f"SELECT {SIZES} FROM jobs")
put("profile_runtime", f"SELECT {tails(6)} FROM jobs")
put("profile_overrequest", f"SELECT {over(6)} FROM jobs_r")
put("profile_congestion", f"SELECT {congestion(6)} FROM q", f"{JOBS}, {obs_queue('jobs', 'q')}")
put("user_skew", users(9))
RANGE = "min(submit_ts) AS submit_min, max(submit_ts) AS submit_max, min(start_ts) AS start_min, max(end_ts) AS end_max"
put("profile_range", f"SELECT {RANGE} FROM jobs")
put(
    "trace_profile",
    f"""SELECT * FROM (SELECT count(*) AS row_count, {RANGE}, {SIZES}, {tails(8)}, {over(8)} FROM jobs_r),
  (SELECT {congestion(8)} FROM q), ({users(8)})""",
    f"{JOBS}, {obs_queue('jobs', 'q')}",
)
put(
    "workload_class",
    f"""SELECT {r('t', 6, 'tail_ratio')}, {r('w', 6, 'mean_wait_sec')},
  CASE WHEN t > 50 THEN 'heavy_tail' WHEN w < 10 THEN 'low_congestion' ELSE 'balanced' END AS workload_class
  FROM (SELECT {qc('runtime_actual_sec', 0.99)} / {qc('runtime_actual_sec', 0.5)} AS t, avg({W}) AS w FROM jobs)""",
)

# --------------------------------------------------------------------------- placement

FIT = """fit AS (SELECT *, (node - asked) / CAST(node AS DOUBLE) AS w0 FROM (SELECT job_id, asked,
    CASE WHEN asked <= 128 THEN CAST(power(2, ceil(log2(asked))) AS BIGINT) ELSE 128 END AS node
  FROM (SELECT job_id, 1 + (job_id * 31 + wait_sec) % 150 AS asked FROM jobs))),
fitted AS (SELECT job_id, node AS optimal_node_cpus, greatest(w0, 0.0e0) AS w,
    CASE WHEN w0 <= 0.15e0 THEN 0 WHEN w0 <= 0.35e0 THEN 1 ELSE 2 END AS frag_label,
    CASE WHEN w0 <= 0.15e0 THEN 'low' WHEN w0 <= 0.35e0 THEN 'medium' ELSE 'high' END AS fragmentation_risk FROM fit)"""
put(
    "best_fit_node",
    f"SELECT job_id, optimal_node_cpus, {r('w', 6, 'waste_ratio')}, frag_label, fragmentation_risk FROM fitted",
    f"{JOBS}, {FIT}",
)
put(
    "fragmentation_mix",
    f"SELECT fragmentation_risk, optimal_node_cpus, count(*) AS jobs, {r('avg(w)', 6, 'mean_waste')} FROM fitted GROUP BY ALL",
    f"{JOBS}, {FIT}",
)
put(
    "best_fit_size_table",
    f"""SELECT job_id, node AS optimal_node_cpus, {r('greatest(node - asked, 0) / CAST(node AS DOUBLE)', 6, 'waste_ratio')}
  FROM (SELECT job_id, asked, coalesce(min(s) FILTER (s >= asked), max(s)) AS node
        FROM (SELECT job_id, 1 + (job_id * 31 + wait_sec) % 60 AS asked FROM jobs),
             (SELECT DISTINCT CAST(p_size AS BIGINT) AS s FROM part) GROUP BY ALL)""",
)

# --------------------------------------------------------------------------- comparison

CORE = ("mean_wait_sec", "p95_wait_sec", "throughput", "makespan_sec")
FLOOR = dict(zip(CORE, ("60.0e0", "60.0e0", "0.05e0", "300.0e0")))
OBJ2 = f"{JOBS}, {CANDS}, {objective('cands', 'oc', 'policy_id')}, {objective('jobs', 'ob')}"


def div(m: str) -> str:
    return f"abs(oc.{m} - ob.{m}) / greatest(CASE WHEN abs(ob.{m}) > 1e-9 THEN abs(ob.{m}) ELSE 1 END, {FLOOR[m]})"


put("core_divergence", "SELECT policy_id, " + ", ".join(r(div(m), 8, m) for m in CORE) + " FROM oc, ob", OBJ2)


def kl(cands: str = "cands") -> str:
    return f"""kb AS (SELECT p.policy_id, b.bin, count(*) FILTER (x.o AND least(floor(x.w * 50 / top), 49) = b.bin) AS o,
    count(*) FILTER (NOT x.o AND least(floor(x.w * 50 / top), 49) = b.bin) AS c, count(*) FILTER (x.o) AS onn, count(*) FILTER (NOT x.o) AS cn
  FROM (SELECT policy_id, greatest(max({W}), (SELECT max({W}) FROM jobs), 1.0e0) AS top FROM {cands} GROUP BY policy_id) p
  JOIN (SELECT policy_id, false AS o, CAST({W} AS DOUBLE) AS w FROM {cands}
        UNION ALL SELECT policy_id, true, CAST({W} AS DOUBLE) FROM jobs, (SELECT DISTINCT policy_id FROM {cands})) x USING (policy_id),
  (SELECT unnest(range(50)) AS bin) b GROUP BY ALL),
kl AS (SELECT policy_id, sum((o + 1e-9) / (onn + 50e-9) * ln(((o + 1e-9) / (onn + 50e-9)) / ((c + 1e-9) / (cn + 50e-9)))) AS wait_kl_divergence
  FROM kb GROUP BY policy_id)"""


def ks(cands: str = "cands") -> str:
    return f"""kv AS (SELECT policy_id, v, sum(o) AS o, sum(c) AS c FROM (SELECT policy_id, {BSLD} AS v, 0 AS o, 1 AS c FROM {cands}
    UNION ALL SELECT policy_id, {BSLD}, 1, 0 FROM jobs, (SELECT DISTINCT policy_id FROM {cands})) GROUP BY policy_id, v),
ks AS (SELECT policy_id, max(abs(fo - fc)) AS slowdown_ks_statistic FROM (SELECT policy_id,
    sum(o) OVER (PARTITION BY policy_id ORDER BY v) / CAST(sum(o) OVER (PARTITION BY policy_id) AS DOUBLE) AS fo,
    sum(c) OVER (PARTITION BY policy_id ORDER BY v) / CAST(sum(c) OVER (PARTITION BY policy_id) AS DOUBLE) AS fc FROM kv) GROUP BY policy_id)"""


def qcorr(cands: str = "cands") -> str:
    return f"""{obs_queue('jobs', 'qo')}, {obs_queue(cands, 'qc', 'policy_id')},
grid AS (SELECT policy_id, unnest(generate_series(least(lo, l0), greatest(hi, h0), 60)) AS ts
  FROM (SELECT policy_id, min(submit_ts) AS lo, max(end_ts) AS hi FROM {cands} GROUP BY policy_id),
       (SELECT min(submit_ts) AS l0, max(end_ts) AS h0 FROM jobs)),
qu AS (SELECT policy_id, ts, 0 AS probe, queue_len_jobs AS o, NULL AS c FROM qo, (SELECT DISTINCT policy_id FROM {cands})
  UNION ALL SELECT policy_id, ts, 0, NULL, queue_len_jobs FROM qc UNION ALL SELECT policy_id, ts, 1, NULL, NULL FROM grid),
qh AS (SELECT policy_id, probe, last_value(o IGNORE NULLS) OVER w AS o, last_value(c IGNORE NULLS) OVER w AS c FROM qu
  WINDOW w AS (PARTITION BY policy_id ORDER BY ts, probe ROWS UNBOUNDED PRECEDING)),
qr AS (SELECT policy_id, corr(CAST(coalesce(o, 0) AS DOUBLE), CAST(coalesce(c, 0) AS DOUBLE)) AS queue_corr_pearson FROM qh WHERE probe = 1 GROUP BY policy_id)"""


put("wait_kl", f"SELECT policy_id, {r('wait_kl_divergence', 8)} FROM kl", f"{JOBS}, {CANDS}, {kl()}")
put("slowdown_ks", f"SELECT policy_id, {r('slowdown_ks_statistic', 9)} FROM ks", f"{JOBS}, {CANDS}, {ks()}")
put("queue_corr", f"SELECT policy_id, {r('queue_corr_pearson', 7)} FROM qr", f"{JOBS}, {CANDS}, {qcorr()}")
put(
    "self_distance",
    "SELECT 'same' AS policy_id, 0.0e0 AS wait_kl_divergence, 0.0e0 AS slowdown_ks_statistic, 1.0e0 AS queue_corr_pearson",
    "",
)
GATE = f"""{OBJ2}, {kl()}, {ks()}, {qcorr()},
d AS (SELECT oc.policy_id, {', '.join(f'{div(m)} AS div_{m}' for m in CORE)}, CAST(least(oc.job_count, ob.job_count) AS BIGINT) AS sample_size FROM oc, ob),
g0 AS (SELECT * FROM d JOIN kl USING (policy_id) JOIN ks USING (policy_id) JOIN qr USING (policy_id)),
gate AS (SELECT *, concat_ws(',',
  CASE WHEN greatest({', '.join(f'div_{m}' for m in CORE)}) > 0.2e0 THEN 'aggregate_single_metric_divergence_exceeded' END,
  CASE WHEN {' + '.join(f'(div_{m} > 0.15e0)::INT' for m in CORE)} >= 2 THEN 'aggregate_two_metric_divergence_exceeded' END,
  CASE WHEN wait_kl_divergence > 0.2e0 THEN 'wait_kl_exceeded' END,
  CASE WHEN slowdown_ks_statistic > 0.15e0 THEN 'slowdown_ks_exceeded' END,
  CASE WHEN queue_corr_pearson < 0.85e0 THEN 'queue_correlation_below_min' END) AS fail_reasons FROM g0)"""
put(
    "fidelity_gate",
    "SELECT policy_id, "
    + ", ".join(r(f"div_{m}", 7) for m in CORE)
    + f", sample_size, {r('wait_kl_divergence', 7)}, {r('slowdown_ks_statistic', 7)}, {r('queue_corr_pearson', 7)},"
    " sample_size < 30 AS skipped_small_sample, fail_reasons, CASE WHEN fail_reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM gate",
    GATE,
)
put(
    "fidelity_gate_all",
    "SELECT CASE WHEN bool_and(fail_reasons = '') THEN 'pass' ELSE 'fail' END AS status, count(*) AS policies FROM gate",
    GATE,
)

# --------------------------------------------------------------------------- decisions

VIOL = """concat_ws(',', CASE WHEN oc.starved_rate > 0.02e0 THEN 'starved_rate_exceeded' END,
  CASE WHEN oc.fairness_dev - ob.fairness_dev > 0.05e0 THEN 'fairness_dev_delta_exceeded' END,
  CASE WHEN ob.jain - oc.jain > 0.03e0 THEN 'jain_delta_exceeded' END)"""
SCORED = f"""sc AS (SELECT oc.policy_id, {VIOL} AS violations, ob.p95_bsld - oc.p95_bsld AS d1, oc.utilization_cpu - ob.utilization_cpu AS d2,
  greatest(0.0e0, oc.fairness_dev - ob.fairness_dev) + greatest(0.0e0, ob.jain - oc.jain) AS pen, -oc.fairness_dev AS d3 FROM oc, ob),
scored AS (SELECT *, d1 + 0.3e0 * d2 - 2.0e0 * pen AS score FROM sc)"""
put("constraints", "SELECT policy_id, violations, violations = '' AS constraints_passed FROM scored", f"{OBJ2}, {SCORED}")
put(
    "weighted_score",
    f"""SELECT policy_id, {r('d1', 7, 'delta_p95_bsld')}, {r('d2', 7, 'delta_utilization')}, {r('pen', 7, 'fairness_penalty')},
  {r('score', 7)} FROM scored""",
    f"{OBJ2}, {SCORED}",
)
CALM = f"""calm AS (SELECT job_id, submit_ts, w AS wait_sec, submit_ts + w AS start_ts, submit_ts + w + runtime_actual_sec AS end_ts,
  runtime_actual_sec, requested_cpus, user_id, queue_id FROM (SELECT *, wait_sec % 150000 AS w FROM jobs)),
{_cands('calm', "'{0}-' || queue_id")}"""
RELAXED = f"{JOBS}, {CALM}, {objective('cands', 'oc', 'policy_id')}, {objective('calm', 'ob')}, {SCORED}"
put(
    "recommend",
    f"""SELECT policy_id, CAST(row_number() OVER (ORDER BY accepted DESC, score DESC, policy_id) AS INT) AS rank, {r('score', 7)}, accepted,
  violations = '' AS constraints_passed,
  concat_ws(',', nullif(violations, ''), CASE WHEN NOT d1 > 0 THEN 'primary_kpi_not_improved' END) AS rejection_reasons
  FROM (SELECT *, violations = '' AND d1 > 0 AS accepted FROM scored)""",
    RELAXED,
)
put(
    "recommend_gated",
    """SELECT 'blocked' AS status, CAST(NULL AS VARCHAR) AS selected_policy_id, string_agg(policy_id, ',' ORDER BY rk) AS blocked,
  max(policy_id) FILTER (rk = 1) AS best_policy_id,
  max(concat_ws(',', 'fidelity_failed', nullif(violations, ''), CASE WHEN NOT d1 > 0 THEN 'primary_kpi_not_improved' END)) FILTER (rk = 1) AS likely_causes
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC, policy_id) AS rk FROM scored)""",
    f"{OBJ2}, {SCORED}",
)
put(
    "pareto_front",
    """SELECT policy_id, NOT dom AS pareto_frontier, dom AS pareto_dominated FROM (SELECT a.policy_id, EXISTS (SELECT 1 FROM scored b
  WHERE b.d1 >= a.d1 AND b.d2 >= a.d2 AND b.d3 >= a.d3 AND (b.d1 > a.d1 OR b.d2 > a.d2 OR b.d3 > a.d3)) AS dom FROM pts a)""".replace(
        "FROM scored b", "FROM pts b"
    ),
    RELAXED + ", pts AS (SELECT policy_id, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM scored)",
)
put(
    "regime",
    f"""SELECT policy_id, CASE WHEN t > 50 THEN 'heavy_tail' WHEN q < 2 THEN 'low_congestion' WHEN u > 0.5e0 THEN 'user_skew' ELSE 'balanced' END AS workload_regime,
  CASE WHEN t > 50 THEN 'tail_ratio' WHEN q < 2 THEN 'mean_queue' WHEN u > 0.5e0 THEN 'top_user_share' ELSE 'none' END AS regime_cause,
  CASE WHEN t > 50 THEN 'raise guard_k' WHEN q < 2 THEN 'test under more load' WHEN u > 0.5e0 THEN 'allow more deviation between users' ELSE 'vary guard_k' END AS regime_advice,
  {r('d1', 7, 'delta_p95_bsld')}, {r('d2', 7, 'delta_utilization')} FROM scored,
  (SELECT {qc('runtime_actual_sec', 0.99)} / {qc('runtime_actual_sec', 0.5)} AS t FROM jobs), (SELECT avg(clipped) AS q FROM q),
  (SELECT top_user_share AS u FROM ({users(9)}))""",
    f"{OBJ2}, {SCORED}, {obs_queue('jobs', 'q')}",
)
put(
    "degrade",
    " UNION ALL ".join(
        f"""SELECT policy_id, '{m}' AS metric, {r(f'oc.{m}', 5, 'candidate')}, {r(f'ob.{m}', 5, 'baseline')}, {r(f'oc.{m} - ob.{m}', 5, 'delta')},
  {r(f'round_even((oc.{m} - ob.{m}) / abs(ob.{m}), 6)', 5, 'ratio')} FROM oc, ob WHERE ob.{m} <> 0"""
        for m in METRICS
    ),
    OBJ2,
)
put(
    "sweep_report",
    """SELECT queue_id, count(*) AS k_values_tested, count(*) FILTER (p) AS k_values_passed_constraints,
  arg_max(k, d * 1000 - k) FILTER (p) AS optimal_k, max(d) FILTER (p) AS optimal_delta_p95_bsld,
  coalesce(min(d) FILTER (ok), 0) AS min_delta_p95_bsld, coalesce(max(d) FILTER (ok), 0) AS max_delta_p95_bsld
  FROM (SELECT *, ok AND c AS p FROM (SELECT queue_id, CAST(job_id % 40 AS DOUBLE) / 8 AS k, CAST(wait_sec % 2000 AS DOUBLE) - 900 AS d,
          job_id % 3 = 0 AS c, job_id % 5 <> 0 AS ok FROM jobs)) GROUP BY queue_id""",
)
put(
    "best_trial",
    """SELECT arg_min(job_id, (wait_sec % 977) * 1000000000 + job_id) FILTER (job_id % 4 <> 0) AS best_trial,
  CAST(min(wait_sec % 977) FILTER (job_id % 4 <> 0) AS DOUBLE) AS best_score, count(*) FILTER (job_id % 4 <> 0) AS trials_completed FROM jobs""",
)
HIST = """h AS (SELECT event_type AS profile_id, event_id AS run_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE WHEN event_id % 9 = 0 THEN 'fail' ELSE 'pass' END AS status, value AS rate FROM events)"""
put(
    "regression_gate",
    f"""SELECT profile_id, k AS prior_window_records, {r('m', 6, 'baseline_median')}, {r('c', 6, 'current_rate')},
  {r('m * (1 - 0.1e0)', 6, 'allowed_floor')}, c < m * (1 - 0.1e0) AS regression_fail, CASE WHEN c < m * (1 - 0.1e0) THEN 'fail' ELSE 'pass' END AS status
  FROM (SELECT profile_id, min(rate) AS c FROM h GROUP BY profile_id) JOIN (SELECT profile_id, count(*) AS k, median(rate) AS m FROM
    (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ts DESC, run_id DESC) AS rn FROM h WHERE status = 'pass') WHERE rn <= 5 GROUP BY profile_id)
  USING (profile_id)""",
    HIST,
)
put("latest_records", "SELECT run_id, profile_id, rate FROM h ORDER BY ts DESC, run_id DESC LIMIT 20", HIST)
put(
    "bench_summary",
    f"""SELECT profile_id, count(*) AS samples, {r(qc('run_id % 977', 0.5), 6, 'duration_median_sec')}, {r(qc('run_id % 977', 0.95), 6, 'duration_p95_sec')},
  {r(qc('rate', 0.5), 6, 'rate_median')}, {r(qc('rate', 0.95), 6, 'rate_p95')} FROM h GROUP BY profile_id""",
    HIST,
)
put(
    "dossier_summary",
    """SELECT count(*) AS traces, bool_and(job_id % 40 <> 0 AND job_id % 7 <> 0) AS all_pass, count(*) FILTER (job_id % 3 = 0) AS accepted_count,
  count(*) FILTER (job_id % 3 <> 0) AS blocked_count FROM jobs""",
)
put(
    "dossier_failure_modes",
    """SELECT reason, count(*) AS occurrences, count(DISTINCT job_id) AS traces FROM (SELECT job_id, unnest(CASE WHEN job_id % 4 = 0
  THEN ['fidelity_failed', 'q' || queue_id] ELSE ['primary_kpi_not_improved'] END) AS reason FROM jobs WHERE job_id % 3 <> 0) GROUP BY reason""",
)
put(
    "suite_status",
    """SELECT CASE WHEN bool_and(job_id % 7 <> 0) THEN 'pass' WHEN bool_or(job_id % 7 <> 0) THEN 'partial' ELSE 'fail' END AS suite_status,
  count(*) AS traces, count(*) FILTER (job_id % 7 <> 0) AS passed FROM jobs""",
)

# --------------------------------------------------------------------------- accuracy and drift

ALPHA = {"p10": "0.1e0", "p50": "0.5e0", "p90": "0.9e0"}


def pin(q: str, y: str = "y") -> str:
    return f"greatest({ALPHA[q]} * ({y} - {q}), ({ALPHA[q]} - 1) * ({y} - {q}))"


SCORE = f"""{preds(1)}, s AS (SELECT *, CAST(runtime_actual_sec AS DOUBLE) AS y FROM jobs JOIN preds1 USING (job_id))"""
LOSS = ", ".join([r(f"avg({pin(q)})", 6, f"{q}_pinball") for q in ALPHA] + [r(f"avg(abs(y - {q}))", 6, f"{q}_mae") for q in ALPHA])
put(
    "pinball_eval",
    f"""SELECT count(*) AS rows, {LOSS}, {r('avg(CASE WHEN y BETWEEN p10 AND p90 THEN 1.0e0 ELSE 0.0e0 END)', 6, 'interval_coverage_p10_p90')} FROM s""",
    f"{JOBS}, {SCORE}",
)
CUT = """cut AS (SELECT *, CAST(runtime_actual_sec AS DOUBLE) AS y, row_number() OVER (ORDER BY submit_ts, job_id) - 1 < floor((SELECT count(*) FROM jobs) * 0.7e0) AS tr FROM jobs_r),
um AS (SELECT coalesce(user_id, -1) AS u, median(y) AS m FROM cut WHERE tr GROUP BY u),
te AS (SELECT c.*, coalesce(m, (SELECT median(y) FROM cut WHERE tr)) AS um, (SELECT median(y) FROM cut WHERE tr) AS gm, (SELECT avg(y) FROM cut WHERE tr) AS ga
  FROM cut c LEFT JOIN um ON coalesce(c.user_id, -1) = um.u WHERE NOT tr),
nb AS (SELECT baseline, avg(abs(y - p)) AS mae, avg(abs(y - p) / greatest(abs(y), 1)) AS mape, avg(greatest(0.5e0 * (y - p), -0.5e0 * (y - p))) AS pl
  FROM (SELECT y, 'global_median' AS baseline, gm AS p FROM te UNION ALL SELECT y, 'global_mean', ga FROM te
        UNION ALL SELECT y, 'user_history_median', um FROM te) GROUP BY baseline)"""
put(
    "naive_baselines",
    f"SELECT baseline, {r('mae')}, {r('mape')}, {r('pl', 6, 'pinball_loss_p50')} FROM nb",
    f"{JOBS}, {CUT}",
)
put("user_median_baseline", f"SELECT job_id, {r('um', 6, 'user_history_median')} FROM te", f"{JOBS}, {CUT}")
put(
    "evaluate_quantiles",
    f"""SELECT baseline, {r('mae', 5)}, {r('mape', 5)}, {r('pl', 5, 'pinball_loss_p50')}, {r('mae - mm', 5, 'mae_improvement')}, {r('pl - mp', 5, 'pinball_p50_improvement')}
  FROM nb, (SELECT avg(abs(y - p50)) AS mm, avg({pin('p50')}) AS mp FROM te JOIN preds1 USING (job_id))""",
    f"{JOBS}, {preds(1)}, {CUT}",
)
FB = f"{preds(1)}, fb AS (SELECT job_id, p10, p50, p90, CAST(runtime_actual_sec AS DOUBLE) AS y, end_ts FROM jobs JOIN preds1 USING (job_id))"
put(
    "score_predictions",
    f"""SELECT job_id, p10, p50, p90, y AS actual_sec, y BETWEEN p10 AND p90 AS in_interval, {r('p50 - y', 6, 'error_sec')},
  {r('abs(p50 - y) / greatest(y, 1)', 6, 'abs_pct_error')} FROM fb""",
    f"{JOBS}, {FB}",
)


def feedback(src: str) -> str:
    return f"""SELECT count(*) AS total_predictions, {r('avg(i)', 6, 'interval_coverage')}, {r('avg(abs(e))', 6, 'mean_absolute_error')},
  {r(qc('abs(e)', 0.5), 6, 'median_absolute_error')}, {r('avg(abs(e) / greatest(y, 1))', 6, 'mape')}, {r(qc('abs(e)', 0.95), 6, 'p95_error')},
  {r('avg(CASE WHEN e > 0 THEN 1.0e0 ELSE 0.0e0 END)', 6, 'overestimate_rate')}, {r('avg(CASE WHEN e < 0 THEN 1.0e0 ELSE 0.0e0 END)', 6, 'underestimate_rate')},
  avg(i) < 0.7e0 AS drift_detected, CASE WHEN avg(i) < 0.5e0 THEN 'severe' WHEN avg(i) < 0.7e0 THEN 'mild' ELSE 'none' END AS drift_severity
  FROM (SELECT p50 - y AS e, y, CASE WHEN y BETWEEN p10 AND p90 THEN 1.0e0 ELSE 0.0e0 END AS i FROM {src})"""


put("feedback_report", feedback("fb"), f"{JOBS}, {FB}")
put("feedback_last_n", feedback("(SELECT * FROM fb ORDER BY end_ts DESC, job_id DESC LIMIT 500)"), f"{JOBS}, {FB}")
put(
    "ensemble",
    f"""SELECT job_id, {r('q[1]', 4, 'p10')}, {r('q[2]', 4, 'p50')}, {r('q[3]', 4, 'p90')} FROM (SELECT job_id,
    list_sort([greatest(sum(w * p10), 1), greatest(sum(w * p50), 1), greatest(sum(w * p90), 1)]) AS q FROM m JOIN wt USING (model) GROUP BY job_id)""",
    f"""{JOBS}, {preds(1)}, {preds(2)}, m AS (SELECT 'm1' AS model, * FROM preds1 UNION ALL SELECT 'm2', * FROM preds2),
l AS (SELECT model, avg(({pin('p10')} + {pin('p50')} + {pin('p90')}) / 3.0e0) AS p FROM m JOIN (SELECT job_id, CAST(runtime_actual_sec AS DOUBLE) AS y FROM jobs) USING (job_id) GROUP BY model),
wt AS (SELECT model, (1 / greatest(p, 1e-6)) / (SELECT sum(1 / greatest(p, 1e-6)) FROM l) AS w FROM l)""",
)
DRIFT = ["requested_cpus", "runtime_requested_sec", "requested_mem", "wait_sec", "runtime_overrequest_ratio"]


def _psi() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, tr, CAST({'CASE WHEN tr THEN wait_sec ELSE wait_sec * 3 // 2 END' if f == 'wait_sec' else f} AS DOUBLE) AS v FROM cut"
        for f in DRIFT
    )
    return f"""lng AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lng WHERE tr GROUP BY feature),
bn AS (SELECT feature, tr, CASE WHEN v < e[1] OR v > e[len(e)] THEN -1 ELSE least(len(list_filter(e, lambda x: x <= v)) - 1, len(e) - 2) END AS bin FROM lng JOIN ed USING (feature)),
ct AS (SELECT feature, bin, CAST(count(*) FILTER (tr) AS DOUBLE) AS t, CAST(count(*) FILTER (NOT tr) AS DOUBLE) AS x FROM bn GROUP BY feature, bin),
tot AS (SELECT feature, sum(t) FILTER (bin >= 0) AS tn, sum(x) FILTER (bin >= 0) AS xn, sum(t) AS ta, sum(x) AS xa FROM ct GROUP BY feature),
ps AS (SELECT feature, max(ta) AS ta, max(xa) AS xa, max(xn) AS xn, sum(CASE WHEN bin >= 0 THEN (greatest(x / xn, 1e-6) - greatest(t / tn, 1e-6)) * ln(greatest(x / xn, 1e-6) / greatest(t / tn, 1e-6)) ELSE 0 END) AS psi FROM ct JOIN tot USING (feature) GROUP BY feature)"""


put(
    "psi",
    f"""SELECT feature, {r('psi', 7, 'psi_value')}, psi > 0.2e0 AS flagged, CAST(ta AS BIGINT) AS train_rows, CAST(xa AS BIGINT) AS eval_rows,
  CAST(xa - xn AS BIGINT) AS out_of_range_count FROM ps""",
    f"{JOBS}, {CUT}, {_psi()}",
)
DEG = f"""{preds(1)}, {preds(2)}, jy AS (SELECT job_id, CAST(runtime_actual_sec AS DOUBLE) AS y FROM jobs),
deg AS ({' UNION ALL '.join(f"SELECT '{q}' AS quantile, {a} AS alpha, (SELECT avg({pin(q)}) FROM preds2 JOIN jy USING (job_id)) AS ev, (SELECT avg({pin(q)}) FROM preds1 JOIN jy USING (job_id)) AS ba" for q, a in ALPHA.items())})"""
put(
    "degradation",
    f"""SELECT quantile, alpha, {r('ev', 6, 'eval_pinball')}, {r('ba', 6, 'baseline_pinball')}, {r('ev / ba', 6, 'degradation_ratio')}, ev / ba > 1.5e0 AS flagged FROM deg""",
    f"{JOBS}, {DEG}",
)
put(
    "drift_report",
    """SELECT (SELECT bool_or(psi > 0.2e0) FROM ps) OR (SELECT bool_or(ev / ba > 1.5e0) FROM deg) AS overall_drift_detected,
  (SELECT coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi > 0.2e0), '') FROM ps) AS psi_features_flagged,
  (SELECT coalesce(string_agg(quantile, ',' ORDER BY quantile) FILTER (ev / ba > 1.5e0), '') FROM deg) AS metrics_flagged,
  (SELECT count(*) FROM ps) AS features_checked, (SELECT count(*) FROM deg) AS metrics_checked""",
    f"{JOBS}, {CUT}, {_psi()}, {DEG}",
)
put(
    "column_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'min({c})', 6, 'min')}, {r(f'max({c})', 6, 'max')}, {r(f'avg({c})', 6, 'mean')},
  {r(qc(c, 0.5), 6, 'median')}, {r(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE)', 6, 'null_pct')} FROM jobs_r"""
        for c in DRIFT
    ),
)
put(
    "group_fairness",
    f"""SELECT count(*) AS unique_values, {r('min(m) FILTER (n >= 10)', 5, 'mean_min')}, {r('max(m) FILTER (n >= 10)', 5, 'mean_max')},
  {r('stddev_samp(m) FILTER (n >= 10)', 5, 'std_across_groups')} FROM (SELECT user_id, avg(runtime_actual_sec) AS m, count(*) AS n FROM jobs
  WHERE user_id IS NOT NULL GROUP BY user_id)""",
)
put(
    "top_groups",
    """SELECT CAST(user_id AS VARCHAR) AS "group", count(*) AS rows FROM jobs WHERE user_id IS NOT NULL GROUP BY user_id
  ORDER BY rows DESC, "group" LIMIT 5""",
)
put(
    "model_card",
    f"""SELECT (SELECT {r('avg(abs(y - p50))', 6, 'p50_mae')} FROM s) AS p50_mae, CAST(5 AS INT) AS columns,
  (SELECT count(DISTINCT user_id) FROM jobs) AS users,
  (SELECT {r('max(m)', 6, 'x')} FROM (SELECT avg(runtime_actual_sec) AS m FROM jobs GROUP BY group_id)) AS group_mean_max""",
    f"{JOBS}, {SCORE}",
)

# --------------------------------------------------------------------------- increments and generators

MARK = """mark AS (SELECT max(submit_ts) AS m FROM (SELECT submit_ts, row_number() OVER (ORDER BY submit_ts, job_id) - 1 AS i FROM jobs)
  WHERE i = floor((SELECT count(*) FROM jobs) * 0.8e0)), fresh AS (SELECT jobs.* FROM jobs, mark WHERE job_id % 50 <> 0 AND submit_ts > m)"""
put(
    "incremental_poll",
    "SELECT count(*) AS new_rows, coalesce(greatest(max(submit_ts), max(m)), max(m)) AS watermark FROM fresh, mark",
    f"{JOBS}, {MARK}",
)
put("incremental_rows", "SELECT CAST(job_id AS VARCHAR) AS job_id, submit_ts FROM fresh", f"{JOBS}, {MARK}")


SLURM_JOBS = """SELECT CASE WHEN job_id % 10 = 0 THEN job_id || '_1' ELSE CAST(job_id AS VARCHAR) END AS job_id, submit_ts,
  CAST(user_id AS VARCHAR) AS user_id"""
put(
    "incremental_poll_slurm",
    f"""{SLURM_JOBS}, CASE WHEN submit_ts < (SELECT (min(submit_ts) + max(submit_ts)) // 2 FROM jobs) THEN 1 ELSE 2 END AS poll
  FROM jobs""",
)
put("stream_slurm_two_landings", f"{SLURM_JOBS} FROM jobs")


def draw(i: str, stream: int, seed: int = 42) -> str:
    x = f"(({i} * 48271 + {seed * 69621 + stream * 40692}) % 2147483647)"
    return f"(({x} * {x} % 2147483647 * 16807 + {x}) % 2147483647)"


def between(i: str, stream: int, low: int, high: int) -> str:
    return f"({low} + {draw(i, stream)} % {high - low + 1})"


GEN = f"""ids AS (SELECT o_orderkey + 1 AS id FROM orders),
g0 AS (SELECT id AS job_id, CAST(sum({between('id', 1, 1, 30)}) OVER (ORDER BY id) AS BIGINT) AS submit_ts, {between('id', 3, 0, 300)} AS wait_sec,
  {between('id', 2, 60, 3600)} AS runtime_actual_sec, [1, 2, 4, 8, 16][{between('id', 5, 1, 5)}] AS allocated_cpus,
  [1, 2, 4, 8, 16][{between('id', 6, 1, 5)}] AS requested_cpus, {between('id', 4, 1000, 2500)} AS th,
  {between('id', 7, 1, 40)} AS user_id, {between('id', 8, 1, 10)} AS group_id FROM ids),
gen AS (SELECT *, runtime_actual_sec * th // 1000 AS runtime_requested_sec FROM g0)"""


def gen_cols(src: str, extra: str = "") -> str:
    return f"""SELECT job_id, submit_ts, submit_ts + wait_sec AS start_ts, submit_ts + wait_sec + runtime_actual_sec AS end_ts, runtime_actual_sec,
  runtime_requested_sec, requested_cpus, user_id{extra} FROM {src}"""


put("gen_base", gen_cols("gen", ", wait_sec, allocated_cpus, group_id"), GEN)
put(
    "gen_heavy_tail",
    gen_cols(
        f"""(SELECT * EXCLUDE (runtime_requested_sec), runtime_actual_sec * 3 // 2 AS runtime_requested_sec FROM (SELECT * EXCLUDE (runtime_actual_sec),
  CAST(least(floor(60.0e0 * (1 + power(({draw('job_id', 9)} + 1) / 2147483647.0e0, -1.0e0 / 1.2e0))), 604800) AS BIGINT) AS runtime_actual_sec FROM gen))"""
    ),
    GEN,
)
put(
    "gen_low_congestion",
    gen_cols(
        """(SELECT * EXCLUDE (submit_ts, wait_sec), job_id * CAST(trunc(greatest(10, 1 / greatest(0.35e0, 0.05e0) * 30)) AS BIGINT) AS submit_ts,
  CAST(0 AS BIGINT) AS wait_sec FROM gen)"""
    ),
    GEN,
)
put(
    "gen_user_skew",
    gen_cols(
        """(SELECT * EXCLUDE (user_id), CASE WHEN job_id <= floor((SELECT count(*) FROM gen) * 0.65e0) THEN 1 ELSE user_id END AS user_id FROM gen)"""
    ),
    GEN,
)
put(
    "gen_burst",
    gen_cols(
        """(SELECT * EXCLUDE (job_id, submit_ts), row_number() OVER (ORDER BY s, job_id) AS job_id, s AS submit_ts
  FROM (SELECT *, CASE WHEN submit_ts >= b AND submit_ts < b + 1800 THEN b + (submit_ts - b) // 4 ELSE submit_ts END AS s
        FROM gen, (SELECT CAST(trunc(quantile_cont(CAST(submit_ts AS DOUBLE), 0.4)) AS BIGINT) AS b FROM gen)))"""
    ),
    GEN,
)

# --------------------------------------------------------------------------- files, streams

put(
    "canonical_table",
    "SELECT CAST(job_id AS VARCHAR) AS job_id, submit_ts, requested_mem, 'q1' AS dataset_id FROM jobs WHERE job_id % 50 <> 0 AND queue_id = '1'",
)
put("jsonl_log", "SELECT job_id, p10, p50, p90 FROM preds1 WHERE job_id % 33 <> 0", f"{JOBS}, {preds(1)}")
put(
    "json_reports",
    "SELECT policy_id, job_count, starved_jobs FROM oc WHERE policy_id <> 'cand_b'",
    f"{JOBS}, {CANDS}, {objective('cands', 'oc', 'policy_id')}",
)
ORACLES["stream_ingest"] = ORACLES["swf_parse"]
put("stream_poll_totals", "SELECT count(*) AS total_rows, 'pbs' AS source FROM jobs")
put(
    "stream_feedback",
    f"""SELECT job_id, p10, p50, p90, y AS actual_sec, y BETWEEN p10 AND p90 AS in_interval, {r('p50 - y', 6, 'error_sec')},
  {r('abs(p50 - y) / greatest(y, 1)', 6, 'abs_pct_error')} FROM fb WHERE job_id % 13 <> 0""",
    f"{JOBS}, {FB}",
)
ROLLED = f"""count(*) AS predictions, {r('avg(i)', 6, 'interval_coverage')}, {r('avg(abs(p50 - y))', 6, 'mean_absolute_error')},
  {r('avg(abs(p50 - y) / greatest(y, 1))', 6, 'mape')}, CASE WHEN avg(i) < 0.5e0 THEN 'severe' WHEN avg(i) < 0.7e0 THEN 'mild' ELSE 'none' END AS drift_severity"""
OUTCOMES = """(SELECT *, CASE WHEN y BETWEEN p10 AND p90 THEN 1.0e0 ELSE 0.0e0 END AS i FROM fb WHERE job_id % 13 <> 0)"""
put(
    "rolling_accuracy",
    f"""SELECT end_ts // 2592000 * 2592000 AS start_ts, {ROLLED}, {r('quantile_cont(abs(p50 - y), 0.95)', 6, 'p95_error')} FROM {OUTCOMES} GROUP BY 1""",
    f"{JOBS}, {FB}",
)
put(
    "stream_rolling_accuracy",
    f"""SELECT end_ts // 2592000 * 2592000 AS start_ts, {ROLLED}, 0.95e0 AS p95_rank FROM {OUTCOMES} GROUP BY 1
  HAVING end_ts // 2592000 * 2592000 + 2592000 <= (SELECT max(end_ts) - 864000 FROM {OUTCOMES})""",
    f"{JOBS}, {FB}",
)
put(
    "stream_queue",
    "SELECT queue_id, ts, queue_len_jobs, queue_len_cpu_demand FROM q",
    f"{JOBS}, {obs_queue('jobs', 'q', 'queue_id')}",
)

ORACLES["stream_ingest_two_landings"] = ORACLES["stream_ingest"]
ORACLES["stream_feedback_two_landings"] = ORACLES["stream_feedback"]
ORACLES["stream_sliding_counts"] = ORACLES["sliding_counts"]
put(
    "runtime_model_checks",
    """SELECT n - CAST(trunc(n * 0.85e0) AS BIGINT) AS test_rows, true AS coverage_ok, true AS in_order, true AS loads_alike
  FROM (SELECT count(*) AS n FROM jobs)""",
)
put(
    "category_indicators",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS category, count(*) AS n_values, count(*) AS n_indicators, count(*) - 1 AS last, min(v) AS first_value
  FROM (SELECT DISTINCT CAST({e} AS VARCHAR) AS v FROM jobs WHERE {e} IS NOT NULL)"""
        for c, e in (
            ("queue_id", "queue_id"), ("partition_id", "partition_id"), ("user_id", "user_id"), ("group_id", "group_id"),
            ("submit_hour", "submit_ts % 24"), ("submit_dow", "submit_ts % 7"),
        )
    ),
)
put(
    "snapshot_violations",
    """SELECT * FROM (
  SELECT job_id AS clock_ts, 'free_cpus_negative' AS violation, CAST(NULL AS BIGINT) AS job_id FROM jobs WHERE job_id % 70 < 3
  UNION ALL SELECT job_id, 'free_cpus_exceeds_capacity', NULL FROM jobs WHERE job_id % 70 - 3 > 64
  UNION ALL SELECT job_id, 'cpu_conservation_broken', NULL FROM jobs WHERE allocated_cpus + job_id % 70 - 3 <> 64
  UNION ALL SELECT job_id, 'job_exists_in_queue_and_running', job_id FROM jobs WHERE job_id % 3 = 0
  UNION ALL SELECT job_id, 'queued_job_submit_in_future', job_id FROM jobs WHERE job_id % 5 = 0)""",
)
put(
    "queued_while_running",
    "SELECT job_id, start_ts + runtime_actual_sec // 2 AS from_ts, end_ts AS to_ts FROM jobs WHERE job_id % 4 = 0",
)
put(
    "conservation",
    """SELECT ts, running_cpus, free_cpus, unnest(list_filter([CASE WHEN free_cpus < 0 THEN 'free_cpus_negative' END,
    CASE WHEN free_cpus > 128 THEN 'free_cpus_exceeds_capacity' END,
    CASE WHEN running_cpus + free_cpus <> 128 THEN 'cpu_conservation_broken' END], lambda x: x IS NOT NULL)) AS violation
  FROM (SELECT ts, running_cpus, CAST(128 - running_cpus + CASE WHEN ts // 50000 % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS free_cpus
    FROM (SELECT p.ts, CAST(coalesce(running_cpus, 0) AS BIGINT) AS running_cpus
      FROM (SELECT DISTINCT submit_ts // 50000 * 50000 AS ts FROM jobs) p ASOF LEFT JOIN occ ON p.ts >= occ.ts))""",
    f"{JOBS}, {OCC}",
)
ORACLES["pipeline_ingest"] = ORACLES["quality_report"]
put(
    "pipeline_features",
    "SELECT fold_id, mode, segment, start_idx, end_idx_exclusive, row_count, submit_ts_min, submit_ts_max FROM folds",
    f"{JOBS}, {FOLDS}",
)
ORACLES["pipeline_stress_compare"] = f"SELECT * FROM ({ORACLES['degrade']}) WHERE policy_id = 'cand_a'"
put(
    "resource_model_checks",
    """SELECT n AS rows, true AS risks_known, true AS probabilities, true AS sizes_positive, true AS loads_alike,
  n - CAST(floor(n * 0.8e0) AS BIGINT) AS test_rows, true AS accuracy_ok FROM (SELECT count(*) AS n FROM jobs)""",
)
put(
    "pipeline_bench",
    """SELECT 'p:' || unnest(['users', 'queues']) AS profile_id, 2 AS samples, 1 AS prior_window_records, true AS has_baseline""",
    "",
)
ORACLES["pipeline_suite"] = f"""SELECT dataset_id, policy_id, (SELECT count(*) FROM orders) AS job_count, 1 AS gates_of_baseline, gate
FROM (SELECT policy_id, status AS gate FROM ({ORACLES['fidelity_gate']}) UNION ALL SELECT 'fifo', 'pass'),
  (SELECT unnest(['a', 'b']) AS dataset_id)"""
