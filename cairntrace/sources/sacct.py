"""Slurm accounting dumps: `sacct --parsable2` with or without a header line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.functions.scalars import elapsed_sec, slurm_datetime, slurm_job_id, slurm_memory_mb, slurm_state, strip
from cairntrace.schema import JOBS
from cairntrace.sources.lines import class_counts, read_lines, refuse_empty, too_long

# Column order assumed for files without a header.
DEFAULT_COLUMNS = (
    "JobID", "Submit", "Start", "End", "Elapsed", "AllocCPUS", "ReqCPUS", "ReqMem", "User", "Group",
    "Partition", "State",
)

COUNTERS = {
    "header": "header_lines",
    "blank": "blank_lines",
    "step": "step_lines_skipped",
    "malformed": "malformed_lines",
    "job": "parsed_rows",
}


def _is_header(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.lower(t) == "jobid")


def _fields(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    at = {c.strip().lower(): i for i, c in enumerate(columns)}
    text = strip(F.col("value"))
    # Lines may carry the names of their own file's header, see `with_layouts`.
    own = F.col("layout") if "layout" in lines.columns else F.lit(None).cast("array<string>")
    split = once(lines.withColumn("layout", own), {"blank": text == "", "long": too_long(), "tokens": F.split(text, r"\|")}, ["layout"])
    headed = F.col("layout").isNotNull()

    def field(name: str) -> Column:
        from_end = F.array_position("layout", name.lower())
        named = F.when(from_end > 0, F.size("layout") - from_end)
        place = F.when(headed, named).otherwise(F.lit(at.get(name.lower())))
        return F.nullif(strip(F.get("tokens", place.cast("int"))), F.lit(""))

    return once(
        split,
        {
            # a second header of a file is a malformed line
            "header": ~headed & _is_header(F.col("tokens")),
            "short": F.size("tokens") < F.when(headed, F.size("layout")).otherwise(F.lit(len(columns))),
            "raw_id": field("JobID"),
            "id": slurm_job_id(field("JobID")),
            "submit": slurm_datetime(field("Submit")),
            "start": slurm_datetime(field("Start")),
            "end": slurm_datetime(field("End")),
            "elapsed": elapsed_sec(field("Elapsed")),
            "alloc": field("AllocCPUS").try_cast("bigint"),
            "req": field("ReqCPUS").try_cast("bigint"),
            "mem": slurm_memory_mb(field("ReqMem")),
            "user": field("User"),
            "group": field("Group"),
            "partition": field("Partition"),
            "state": slurm_state(field("State")),
        },
        keep=["blank", "long"],
    )


def classify(lines: DataFrame, columns: Sequence[str] = DEFAULT_COLUMNS, skip_job_steps: bool = True) -> DataFrame:
    """Lines with extracted fields and their `line_class`: header, blank, step, malformed or job."""
    step = F.col("id.is_step") if skip_job_steps else F.lit(False)
    return _fields(lines, columns).withColumn(
        "line_class",
        F.when(F.col("long"), "malformed")
        .when(F.col("blank"), "blank")
        .when(F.col("header"), "header")
        .when(F.col("short") | F.col("raw_id").isNull(), "malformed")
        .when(step, "step")
        .when(F.col("submit").isNull(), "malformed")
        .otherwise("job"),
    )


def parse_stats(lines: DataFrame, columns: Sequence[str] = DEFAULT_COLUMNS) -> DataFrame:
    return class_counts(classify(lines, columns), COUNTERS)


def parse(lines: DataFrame, columns: Sequence[str] = DEFAULT_COLUMNS, skip_job_steps: bool = True) -> DataFrame:
    """Canonical jobs (plus `array_index`) of sacct lines that share one column order."""
    jobs = classify(lines, columns, skip_job_steps).filter(F.col("line_class") == "job")
    zero = F.lit(0)
    jobs = jobs.withColumn("end", F.coalesce("end", F.col("start") + F.col("elapsed")))
    run = F.when(F.col("elapsed").isNotNull(), F.greatest("elapsed", zero))
    run = run.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.greatest(F.col("end") - F.col("start"), zero))
    jobs = jobs.withColumn("run", run)
    jobs = jobs.withColumn("start", F.coalesce("start", "submit"))
    jobs = jobs.withColumn("end", F.coalesce("end", F.col("start") + F.col("run"), "start"))
    cpus = F.coalesce("req", "alloc", F.lit(1))
    values = {
        "job_id": F.col("id.id"),
        "submit_ts": F.col("submit"),
        "start_ts": F.col("start"),
        "end_ts": F.col("end"),
        "wait_sec": F.greatest(F.col("start") - F.col("submit"), zero),
        "runtime_actual_sec": F.coalesce("run", F.greatest(F.col("end") - F.col("start"), zero)),
        "runtime_requested_sec": F.lit(None),
        "allocated_cpus": F.coalesce("alloc", cpus),
        "requested_cpus": cpus,
        "requested_mem": F.col("mem"),
        "status": F.col("state"),
        "user_id": F.col("user"),
        "group_id": F.col("group"),
        "queue_id": F.col("partition"),
        "partition_id": F.col("partition"),
        "runtime_overrequest_ratio": F.lit(None),
    }
    return jobs.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in JOBS], F.col("id.array_index").alias("array_index")
    )


def with_origin(lines: DataFrame) -> DataFrame:
    """Lines of a text scan with their file and the place where their split begins."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def with_layouts(lines: DataFrame) -> DataFrame:
    """Lines `with_origin` and their `layout`: lower-cased column names, last one first, of the
    file's first header line; null up to that line and in files without one.

    A line's place is (start of its split, running number); both scans cut the files alike, so
    places agree.  Headers, one row per file that has one, are joined to the lines."""
    placed = lines.select("value", "file", F.struct("at", F.monotonically_increasing_id().alias("n")).alias("place"))
    headers = placed.filter(_is_header(F.split(strip(F.col("value")), r"\|"))).groupBy("file").agg(
        F.min("place").alias("first"), F.min_by("value", "place").alias("names")
    )
    names = F.reverse(F.transform(F.split(strip(F.col("names")), r"\|"), lambda t: F.lower(strip(t))))
    both = placed.join(headers, "file", "left")
    return both.select("value", F.when(F.col("place") > F.col("first"), names).alias("layout"))


def headed_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of sacct dumps, each with the column order that holds where it stands."""
    return with_layouts(with_origin(read_lines(spark, path)))


def read_sacct(
    spark: SparkSession, path, skip_job_steps: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """Canonical jobs of sacct dumps.  Lines after a file's header have its column order, lines
    before it and files without one the default order; give `columns` to skip the header pass.
    Column names match in any case."""
    jobs = parse(read_lines(spark, path), columns, skip_job_steps) if columns else parse(
        headed_lines(spark, path), skip_job_steps=skip_job_steps
    )
    return refuse_empty(jobs, "sacct")
