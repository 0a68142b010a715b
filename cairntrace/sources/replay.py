"""Exchange with external replay tools: importing their job CSV, exporting workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.scalars import floor_ts, positive_int_or, positive_or, profile_id, replay_job_id
from cairntrace.schema import require, with_optional

CSV_REQUIRED = {
    "job_id",
    "submission_time",
    "starting_time",
    "finish_time",
    "execution_time",
    "requested_number_of_resources",
}
EXTRA_SCHEMA = "user_id string, group_id string, queue_id string, partition_id string"


def import_replay(rows: DataFrame, workload: DataFrame | None = None) -> DataFrame:
    """Jobs of a replay result; `workload` (id, extra_data JSON text) adds user, group and queue."""
    require(rows, CSV_REQUIRED, "replay CSV")
    if "requested_time" not in rows.columns:
        rows = rows.withColumn("requested_time", F.lit(None).cast("double"))
    zero = F.lit(0).cast("bigint")
    submit = floor_ts(F.col("submission_time"), zero)
    df = rows.withColumns(
        {"_key": F.substring_index(F.col("job_id").cast("string"), "!", -1), "submit_ts": submit}
    ).withColumn("start_ts", floor_ts(F.col("starting_time"), F.col("submit_ts")))
    finish = F.greatest(floor_ts(F.col("finish_time"), F.col("start_ts")), F.col("start_ts"))
    df = df.withColumn(
        "runtime_actual_sec", F.greatest(finish - F.col("start_ts"), floor_ts(F.col("execution_time"), zero))
    )
    asked = F.col("requested_time").try_cast("double")
    if workload is None:
        df = df.withColumn("extra", F.lit(None).cast(f"struct<{EXTRA_SCHEMA.replace(' string', ':string')}>"))
    else:
        # Both sides have one row per job id: a plain equi join, whichever way its size suggests.
        meta = workload.select(
            F.col("id").cast("string").alias("_key"), F.from_json("extra_data", EXTRA_SCHEMA).alias("extra")
        ).dropDuplicates(["_key"])
        df = df.join(meta, "_key", "left")
    return df.select(
        replay_job_id(F.col("job_id")).alias("job_id"),
        "submit_ts",
        "start_ts",
        (F.col("start_ts") + F.col("runtime_actual_sec")).alias("end_ts"),
        "runtime_actual_sec",
        F.when(asked > 0, asked).alias("runtime_requested_sec"),
        positive_int_or(F.col("requested_number_of_resources"), F.lit(1)).alias("requested_cpus"),
        "extra.user_id",
        "extra.group_id",
        "extra.queue_id",
        "extra.partition_id",
    )


def read_replay_csv(spark: SparkSession, csv_path, workload_path=None) -> DataFrame:
    """Job CSV with header; the workload is a JSON document with a `jobs` array."""
    rows = spark.read.csv(csv_path, header=True)
    workload = None
    if workload_path is not None:
        doc = spark.read.schema("jobs array<struct<id:string,extra_data:string>>").json(workload_path, multiLine=True)
        workload = doc.select(F.explode("jobs").alias("j")).select("j.id", "j.extra_data")
    return import_replay(rows, workload)


def export_workload(jobs: DataFrame, capacity_cpus: int) -> tuple[DataFrame, DataFrame]:
    """Workload tables (jobs, run-time profiles).  Run time: actual, else requested, else 1 s;
    CPUs within 1..capacity."""
    require(jobs, {"job_id", "submit_ts", "runtime_actual_sec", "requested_cpus"}, "workload export")
    df = with_optional(jobs)
    zero = F.lit(0.0)
    delay = positive_or(
        F.col("runtime_actual_sec"), positive_or(F.col("runtime_requested_sec"), F.lit(1.0))
    ).cast("double")
    fallback = F.col("allocated_cpus") if "allocated_cpus" in df.columns else F.lit(1)
    cpus = positive_int_or(F.col("requested_cpus"), positive_int_or(fallback, F.lit(1)))
    extra = F.struct("group_id", "partition_id", "queue_id", "user_id")
    walltime = positive_or(F.col("runtime_requested_sec"), F.lit(None).cast("double"))
    out = df.select(
        F.col("job_id").cast("string").alias("id"),
        positive_or(F.col("submit_ts"), zero).alias("subtime"),
        F.greatest(F.lit(1), F.least(cpus, F.lit(capacity_cpus))).cast("bigint").alias("res"),
        profile_id(delay).alias("profile"),
        walltime.alias("walltime"),
        F.to_json(extra, {"ignoreNullFields": "false"}).alias("extra_data"),
        delay.alias("_delay"),
    )
    profiles = out.groupBy("profile").agg(F.min("_delay").alias("delay")).select(
        "profile", F.lit("DelayProfile").alias("type"), "delay"
    )
    return out.drop("_delay"), profiles


def export_jobs_json(jobs: DataFrame, path: str | None = None) -> DataFrame:
    """Four integer columns per job, optionally written as JSON records."""
    out = jobs.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("job_id", "submit_ts", "runtime_actual_sec", "requested_cpus")]
    )
    if path is not None:
        out.write.mode("overwrite").json(path)
    return out
