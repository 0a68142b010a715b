"""Output of live scheduler queries: headerless sacct extracts and qstat JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.functions.scalars import (
    leading_int,
    live_datetime,
    live_time_sec,
    qstat_datetime,
    qstat_walltime_sec,
)
from cairntrace.sources.lines import read_lines

# Field order of the extract.
EXTRACT_FIELDS = (
    "JobID", "JobName", "User", "Group", "Partition", "Account", "State", "Submit", "Start", "End", "Elapsed",
    "Timelimit", "NCPUS", "NNodes", "ReqMem", "MaxRSS", "ExitCode",
)

_RESOURCES = "struct<walltime:string,ncpus:string,select:string,mem:string>"
QSTAT_SCHEMA = (
    "Jobs map<string, struct<Job_Name:string,Job_Owner:string,group_list:string,queue:string,job_state:string,"
    f"Resource_List:{_RESOURCES},resources_used:{_RESOURCES},ctime:string,stime:string,mtime:string,"
    "Exit_status:string>>"
)


def parse_sacct_extract(lines: DataFrame) -> DataFrame:
    """One row per whole job; ids with '.' (steps) or '_' (array members) are skipped."""
    schema = ", ".join(f"{f} string" for f in EXTRACT_FIELDS)
    rows = once(lines, {"r": F.from_csv("value", schema, {"sep": "|"})}).select("r.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    job_id = F.col("JobID").try_cast("bigint")
    keep = job_id.isNotNull() & ~F.col("JobID").rlike(r"[._]")
    return rows.filter(keep).select(
        job_id.alias("job_id"),
        text("JobName").alias("job_name"),
        text("User").alias("user"),
        text("Group").alias("group"),
        text("Partition").alias("partition"),
        text("State").alias("state"),
        F.coalesce(live_datetime(F.col("Submit")), F.lit(0)).alias("submit_ts"),
        live_datetime(F.col("Start")).alias("start_ts"),
        live_datetime(F.col("End")).alias("end_ts"),
        live_time_sec(F.col("Elapsed")).alias("runtime_actual_sec"),
        live_time_sec(F.col("Timelimit")).alias("runtime_requested_sec"),
        F.coalesce(F.col("NCPUS").try_cast("bigint"), F.lit(1)).alias("requested_cpus"),
        F.coalesce(F.col("NNodes").try_cast("bigint"), F.lit(1)).alias("requested_nodes"),
        F.coalesce(F.col("ExitCode"), F.lit("0:0")).alias("exit_code"),
    )


def read_sacct_extract(spark: SparkSession, path) -> DataFrame:
    return parse_sacct_extract(read_lines(spark, path))


def parse_qstat_json(documents: DataFrame) -> DataFrame:
    """One row per job of qstat documents (column `value`); bad JSON gives no rows."""
    jobs = documents.select(F.explode(F.from_json("value", QSTAT_SCHEMA)["Jobs"]).alias("key", "j"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cpus = F.col("j.Resource_List.ncpus")
    return jobs.select(
        F.substring_index("key", ".", 1).alias("job_id"),
        text("j.Job_Name").alias("job_name"),
        F.substring_index(text("j.Job_Owner"), "@", 1).alias("user"),
        text("j.group_list").alias("group"),
        text("j.queue").alias("queue"),
        text("j.job_state").alias("state"),
        F.coalesce(qstat_datetime(F.col("j.ctime")), F.lit(0)).alias("submit_ts"),
        qstat_datetime(F.col("j.stime")).alias("start_ts"),
        qstat_datetime(F.col("j.mtime")).alias("end_ts"),
        qstat_walltime_sec(F.col("j.resources_used.walltime")).alias("runtime_actual_sec"),
        qstat_walltime_sec(F.col("j.Resource_List.walltime")).alias("runtime_requested_sec"),
        F.when(cpus.rlike(r"^\d+$"), cpus.try_cast("bigint")).otherwise(1).alias("requested_cpus"),
        leading_int(F.col("j.Resource_List.select"), 1).alias("requested_nodes"),
        F.coalesce(F.col("j.Exit_status").try_cast("bigint"), F.lit(0)).alias("exit_status"),
    )


def read_qstat_json(spark: SparkSession, path) -> DataFrame:
    """Each file is one JSON document."""
    return parse_qstat_json(spark.read.text(path, wholetext=True))


def live_to_canonical(rows: DataFrame) -> DataFrame:
    """Live rows as job columns: missing start and end 0, memory 0, partition = queue."""
    queue = F.col("partition") if "partition" in rows.columns else F.col("queue")
    return rows.select(
        "job_id",
        "submit_ts",
        F.coalesce("start_ts", F.lit(0)).alias("start_ts"),
        F.coalesce("end_ts", F.lit(0)).alias("end_ts"),
        "runtime_actual_sec",
        "runtime_requested_sec",
        "requested_cpus",
        F.col("user").alias("user_id"),
        F.col("group").alias("group_id"),
        queue.alias("queue_id"),
        queue.alias("partition_id"),
        F.lit(0).cast("bigint").alias("requested_mem"),
    )


def sync_summary(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Jobs read, jobs running (state R or E), jobs with a prediction, jobs without one."""
    scored = predictions.select("job_id", F.lit(True).alias("_scored")).dropDuplicates(["job_id"])
    return rows.join(scored, "job_id", "left").agg(
        F.count("*").alias("jobs_ingested"),
        F.count_if(F.col("state").isin("R", "E")).alias("jobs_running"),
        F.count_if(F.col("_scored")).alias("recommendations_generated"),
        F.count_if(F.col("_scored").isNull()).alias("errors"),
    )
