"""Standard Workload Format: 18 blank-separated fields per job, `;` or `#` comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.functions.scalars import overrequest_ratio, strip, swf_int
from cairntrace.schema import conform
from cairntrace.sources.lines import class_counts, read_lines, refuse_empty, too_long

# Field order of the format.
FIELDS = (
    "job_number", "submit_time", "wait_time", "run_time", "allocated_processors", "avg_cpu_time_used",
    "used_memory", "requested_processors", "requested_time", "requested_memory", "status", "user_id",
    "group_id", "executable_number", "queue_number", "partition_number", "preceding_job_number", "think_time",
)

REQUIRED = ("job_number", "submit_time", "wait_time", "run_time", "allocated_processors")

COUNTERS = {
    "comment": "comment_lines",
    "blank": "blank_lines",
    "malformed": "malformed_lines",
    "job": "parsed_rows",
}


# Fields of the format the canonical table uses.
USED = {
    "job_number": "job_id",
    "submit_time": "submit_ts",
    "wait_time": "wait_sec",
    "run_time": "runtime_actual_sec",
    "allocated_processors": "allocated_cpus",
    "requested_processors": "requested_cpus",
    "requested_time": "runtime_requested_sec",
    "requested_memory": "requested_mem",
    "status": "status",
    "user_id": "user_id",
    "group_id": "group_id",
    "queue_number": "queue_id",
    "partition_number": "partition_id",
}


def _tokens(lines: DataFrame) -> DataFrame:
    """First character and fields of each line, and whether it is too long."""
    text = strip(F.col("value"))
    first = {"first": F.substring(text, 1, 1), "long": too_long(), "tokens": F.split(text, r"\s+")}
    return once(lines, first)


def _class(job: Column) -> Column:
    return (
        F.when(F.col("long"), "malformed")
        .when(F.col("first") == "", "blank")
        .when(F.col("first").isin(";", "#"), "comment")
        .when(job, "job")
        .otherwise("malformed")
    )


def _whole() -> Column:
    return F.size("tokens") == len(FIELDS)


def classify(lines: DataFrame) -> DataFrame:
    """Fields of each line and its `line_class`: comment, blank, malformed or job."""
    fields = {name: swf_int(F.get("tokens", F.lit(FIELDS.index(field)))) for field, name in USED.items()}
    df = once(_tokens(lines), {**fields, "whole": _whole()}, keep=["first", "long"])
    complete = F.col("whole")
    for field in REQUIRED:
        complete = complete & F.col(USED[field]).isNotNull()
    return df.withColumn("line_class", _class(complete))


def line_stats(lines: DataFrame) -> DataFrame:
    """Counters by shape only: a line of 18 fields counts as a job whatever they hold."""
    return class_counts(_tokens(lines).withColumn("line_class", _class(_whole())), COUNTERS)


def parse_stats(lines: DataFrame) -> DataFrame:
    """Counters of what `parse` keeps and drops."""
    return class_counts(classify(lines), COUNTERS)


def parse(lines: DataFrame) -> DataFrame:
    """Canonical jobs of SWF lines (column `value`)."""
    zero = F.lit(0)
    jobs = classify(lines).filter(F.col("line_class") == "job").withColumns(
        {
            "wait_sec": F.greatest("wait_sec", zero),
            "runtime_actual_sec": F.greatest("runtime_actual_sec", zero),
            "requested_cpus": F.coalesce("requested_cpus", "allocated_cpus"),
        }
    )
    start = F.col("submit_ts") + F.col("wait_sec")
    ratio = overrequest_ratio(F.col("runtime_requested_sec"), F.col("runtime_actual_sec"))
    return conform(
        jobs.withColumns(
            {"start_ts": start, "end_ts": start + F.col("runtime_actual_sec"), "runtime_overrequest_ratio": ratio}
        )
    )


def read_swf(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Canonical jobs of SWF files, plain or gzip; raises when there are none."""
    return refuse_empty(parse(read_lines(spark, path, partitions)), "SWF")
