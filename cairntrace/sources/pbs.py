"""PBS/Torque accounting logs: `timestamp;type;job id;key=value ...`, exit records only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.functions.scalars import (
    attribute,
    nodes_spec_cpus,
    overrequest_ratio,
    pbs_job_id,
    pbs_memory_mb,
    pbs_timestamp,
    pbs_walltime_sec,
    spaced,
    strip,
)
from cairntrace.schema import JOBS
from cairntrace.sources.lines import class_counts, read_lines, refuse_empty, too_long

RECORD = "^[^;]+;[A-Z];[^;]+;"

# Attribute names of the log, by the names used here.
ATTRIBUTES = {
    "ctime": "ctime",
    "qtime": "qtime",
    "start": "start",
    "end": "end",
    "used": "resources_used.walltime",
    "asked": "Resource_List.walltime",
    "ncpus": "Resource_List.ncpus",
    "nodes": "Resource_List.nodes",
    "mem": "Resource_List.mem",
    "status": "Exit_status",
    "user": "user",
    "group": "group",
    "queue": "queue",
}

COUNTERS = {
    "blank": "blank_lines",
    "other": "non_exit_records",
    "malformed": "malformed_lines",
    "job": "parsed_rows",
}


def classify(lines: DataFrame) -> DataFrame:
    """Lines with extracted fields and their `line_class`: blank, other record, malformed or job."""
    text = strip(F.col("value"))
    parts = F.split(text, ";", 4)
    df = once(lines, {"long": too_long(), "text": text, "parts": parts})
    df = once(
        df,
        {
            "skip": (F.col("text") == "") | F.startswith("text", F.lit("#")),
            "record": F.when(F.col("text").rlike(RECORD), F.get("parts", F.lit(1))),
            "time": F.get("parts", F.lit(0)),
            "raw_id": F.get("parts", F.lit(2)),
            "attributes": spaced(F.coalesce(F.get("parts", F.lit(3)), F.lit(""))),
        },
        keep=["long"],
    )
    exits = F.col("record") == "E"

    def attr(key: str) -> Column:
        # Attributes matter for exit records only.
        return F.when(exits, attribute(F.col("attributes"), key))

    texts = {short: attr(key) for short, key in ATTRIBUTES.items()}
    df = once(df, {**texts, "stamp": F.when(exits, F.col("time"))}, keep=["long", "skip", "record", "raw_id"])
    times = {c: pbs_timestamp(F.col(c)) for c in ("start", "end")}
    df = once(
        df,
        {
            # a time that is not needed is not parsed
            "submit": F.coalesce(*[pbs_timestamp(F.col(c)) for c in ("ctime", "qtime", "stamp")]),
            **times,
            "used": pbs_walltime_sec(F.col("used")),
            "asked": pbs_walltime_sec(F.col("asked")),
            "cpus": F.coalesce(F.col("ncpus").try_cast("bigint"), nodes_spec_cpus(F.col("nodes")), F.lit(1)),
            "mem": pbs_memory_mb(F.col("mem")),
        },
        keep=["long", "skip", "record", "raw_id", "status", "user", "group", "queue"],
    )
    return df.withColumn(
        "line_class",
        F.when(F.col("long"), "malformed")
        .when(F.col("skip"), "blank")
        .when(F.col("record").isNull(), "malformed")
        .when(F.col("record") != "E", "other")
        .when(F.col("submit").isNull(), "malformed")
        .otherwise("job"),
    )


def parse_stats(lines: DataFrame) -> DataFrame:
    return class_counts(classify(lines), COUNTERS)


def parse(lines: DataFrame) -> DataFrame:
    """Canonical jobs of PBS accounting lines."""
    jobs = classify(lines).filter(F.col("line_class") == "job")
    jobs = jobs.withColumn("end", F.coalesce("end", F.col("start") + F.col("used")))
    jobs = jobs.withColumn("start", F.coalesce("start", "submit"))
    jobs = jobs.withColumn("end", F.coalesce("end", F.col("start") + F.col("used"), "start"))
    jobs = jobs.withColumn("run", F.coalesce("used", F.greatest(F.col("end") - F.col("start"), F.lit(0))))
    values = {
        "job_id": pbs_job_id(F.col("raw_id")),
        "submit_ts": F.col("submit"),
        "start_ts": F.col("start"),
        "end_ts": F.col("end"),
        "wait_sec": F.greatest(F.col("start") - F.col("submit"), F.lit(0)),
        "runtime_actual_sec": F.col("run"),
        "runtime_requested_sec": F.col("asked"),
        "allocated_cpus": F.col("cpus"),
        "requested_cpus": F.col("cpus"),
        "requested_mem": F.col("mem"),
        "status": F.col("status"),
        "user_id": F.col("user"),
        "group_id": F.col("group"),
        "queue_id": F.col("queue"),
        "partition_id": F.col("queue"),
        "runtime_overrequest_ratio": overrequest_ratio(F.nullif(F.col("asked"), F.lit(0)), F.col("run")),
    }
    return jobs.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in JOBS])


def read_pbs(spark: SparkSession, path) -> DataFrame:
    """Canonical jobs of PBS accounting files; raises when there are none."""
    return refuse_empty(parse(read_lines(spark, path)), "PBS")
