"""Named jobs made of the operators: ingest, features, suite run, stress compare, benchmark.

Each reads tables, writes tables and returns frames over what it wrote.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.operators import compare, decide, features, generate, metrics, quality
from cairntrace.operators.ordered import release
from cairntrace.schema import JOBS
from cairntrace.session import settle
from cairntrace.sources import pbs, sacct, swf, tables
from cairntrace.sources.lines import read_lines, refuse_empty

SOURCES = {"swf": swf, "slurm": sacct, "pbs": pbs}


def run_ingest(spark: SparkSession, fmt: str, path, out: str, dataset_id: str) -> dict[str, DataFrame]:
    """Parse logs into the canonical table, then report quality and file hashes.

    The jobs are parsed once and written; the report reads the written table and the line
    counters come from one more pass over the text.
    """
    if fmt not in SOURCES:
        raise ValueError(f"unsupported source {fmt!r}: use one of {sorted(SOURCES)}")
    lines = sacct.headed_lines(spark, path) if fmt == "slurm" else read_lines(spark, path)
    jobs = SOURCES[fmt].parse(lines)
    tables.write_jobs(jobs.select(*JOBS.names), f"{out}/jobs", dataset_id)
    written = refuse_empty(tables.load_jobs(spark, f"{out}/jobs", dataset_id), fmt)
    report = quality.quality_report(written, SOURCES[fmt].parse_stats(lines))
    report.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").json(f"{out}/quality/{dataset_id}")
    files = quality.dataset_fingerprint(spark, path).withColumns(
        {"dataset_id": F.lit(dataset_id), "source_format": F.lit(fmt)}
    )
    files.write.mode("overwrite").json(f"{out}/metadata/{dataset_id}")
    return {
        "jobs": written,
        "quality": spark.read.json(f"{out}/quality/{dataset_id}"),
        "metadata": spark.read.json(f"{out}/metadata/{dataset_id}"),
    }


def run_features(
    jobs: DataFrame, out: str, dataset_id: str, n_folds: int = 3, train: float = 0.70, validation: float = 0.15
) -> dict[str, DataFrame]:
    """Build the feature table, its folds and the null-rate report."""
    spark = jobs.sparkSession
    features.feature_table(jobs).write.mode("overwrite").parquet(f"{out}/features/{dataset_id}")
    release()
    table = spark.read.parquet(f"{out}/features/{dataset_id}")
    folds = features.split_summary(features.chronological_folds(table, n_folds, train, validation))
    folds.write.mode("overwrite").json(f"{out}/splits/{dataset_id}")
    quality.null_rates(table).write.mode("overwrite").json(f"{out}/feature_report/{dataset_id}")
    release()
    return {
        "features": table,
        "splits": spark.read.json(f"{out}/splits/{dataset_id}"),
        "report": spark.read.json(f"{out}/feature_report/{dataset_id}"),
    }


def run_suite(
    observed: DataFrame,
    candidates: DataFrame,
    capacity_cpus: int,
    baseline_policy: str,
    out: str | None = None,
    limits: compare.GateThresholds | None = None,
) -> dict[str, DataFrame]:
    """All traces at once (column `dataset_id`): gate, recommendation and suite status.

    `candidates` holds the job tables of every policy (`policy_id`), one of which is the
    baseline the others are scored against.
    """
    trace = ["dataset_id"]
    gate = settle(compare.fidelity_gate(observed, candidates, capacity_cpus, ["policy_id"], limits, within=trace))
    scores = settle(metrics.objective_metrics(candidates, capacity_cpus, by=[*trace, "policy_id"]))
    release()
    base = scores.filter(F.col("policy_id") == baseline_policy).drop("policy_id")
    others = scores.filter(F.col("policy_id") != baseline_policy)
    passed = gate.groupBy(*trace).agg(F.bool_and(F.col("status") == "pass").alias("gate_ok"))
    ranked = settle(decide.recommend_within(others, base, passed, trace))
    status = decide.trace_status(ranked, passed, trace)
    result = {"gate": gate, "metrics": scores, "ranked": ranked, "traces": status, "suite": decide.suite_status(status)}
    if out is not None:
        for name in ("gate", "metrics", "ranked", "traces"):
            result[name].write.mode("overwrite").parquet(f"{out}/{name}")
    return result


def run_stress_compare(baseline: DataFrame, candidate: DataFrame, capacity_cpus: int) -> dict[str, DataFrame]:
    """Two schedules of a stress scenario: contract check and change of every metric."""
    base = settle(metrics.objective_metrics(baseline, capacity_cpus))
    cand = settle(metrics.objective_metrics(candidate, capacity_cpus).withColumn("policy_id", F.lit("candidate")))
    release()
    checked = decide.constraints(cand, base)
    verdict = checked.select(
        F.when(F.col("constraints_passed"), "pass").otherwise("fail").alias("status"), "violations"
    )
    return {"status": verdict, "degrade": decide.degrade(cand, base)}


def run_stress(spark: SparkSession, scenario: str, n_jobs: int, out: str, seed: int = 42, params: Mapping | None = None) -> DataFrame:
    """Write a stress trace and return it."""
    base = generate.gen_trace(spark, n_jobs, seed)
    generate.scenario(base, scenario, **(params or {})).write.mode("overwrite").parquet(f"{out}/stress_{scenario}")
    release()
    return spark.read.parquet(f"{out}/stress_{scenario}")


def run_bench(
    spark: SparkSession,
    steps: Mapping[str, Sequence],
    history: str,
    profile_id: str,
    samples: int = 3,
    workload: str = "default",
) -> DataFrame:
    """Time steps (name -> (rows, function returning a frame)), append to the history, gate the rates.

    The gate compares the median rate with the median of the last passing runs of the
    same profile and step; the drop allowed depends on the workload class.
    """
    runs = []
    for name, (rows, step) in steps.items():
        for k in range(samples):
            start = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            release()
            runs.append((f"{profile_id}:{name}", int(time.time()), k, float(spent), rows / spent))
    now = spark.createDataFrame(runs, "profile_id string, ts bigint, run_id bigint, duration_sec double, rate double")
    current = now.groupBy("profile_id").agg(F.percentile("rate", F.lit(0.5)).alias("rate"), F.max("ts").alias("ts"))
    schema = "profile_id string, ts bigint, run_id bigint, status string, rate double"
    past = _history(spark, history, schema)
    gate = settle(decide.regression_gate(past, current, drop=decide.REGRESSION_DROP[workload]))
    entry = current.join(gate.select("profile_id", "status"), "profile_id").select(
        "profile_id", "ts", F.lit(0).cast("bigint").alias("run_id"), "status", "rate"
    )
    entry.write.mode("append").json(history)
    summary = decide.bench_summary(now, ["profile_id"])
    return gate.join(summary, "profile_id")


def _history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.sql.utils import AnalysisException

    try:
        return settle(tables.load_jsonl(spark, path, schema))
    except AnalysisException:
        return spark.createDataFrame([], schema)
