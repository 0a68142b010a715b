"""Reading log files as lines, and the counters every text source reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# No line is refused for its length; Spark holds none longer than this.
MAX_LINE_CHARS = 2**31 - 1


def read_lines(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """Lines of text files.  Compressed files are one task each: pass `partitions` to spread them."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def too_long():
    return F.length("value") > MAX_LINE_CHARS


def class_counts(classified: DataFrame, classes: dict[str, str]) -> DataFrame:
    """One row: total lines and a counter per line class."""
    return classified.agg(
        F.count("*").alias("total_lines"),
        *[F.count_if(F.col("line_class") == c).alias(name) for c, name in classes.items()],
    )


def refuse_empty(jobs: DataFrame, what: str) -> DataFrame:
    """Raise when a source produced no rows (looks at one row)."""
    if jobs.isEmpty():
        raise ValueError(f"no parsable {what} rows were produced")
    return jobs
