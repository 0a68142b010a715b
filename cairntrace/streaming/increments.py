"""Batch polling of a growing dump: keep what is newer than the last watermark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cairntrace.schema import JOBS
from cairntrace.sources import pbs, sacct, swf
from cairntrace.sources.lines import read_lines

PARSERS = {"swf": swf.parse, "slurm": sacct.parse, "pbs": pbs.parse}
#: How files are read where lines alone don't tell their meaning.
LINES = {"slurm": sacct.headed_lines}
STATE = "last_submit_ts bigint, total_rows bigint, poll_count bigint, last_poll string, source string"


def increment(jobs: DataFrame, watermark: Column | int | None) -> DataFrame:
    """Rows submitted strictly after the watermark (all rows when there is none)."""
    if watermark is None:
        return jobs
    mark = F.lit(watermark) if isinstance(watermark, int) else watermark
    return jobs.filter(mark.isNull() | (F.col("submit_ts") > mark))


def next_watermark(new: DataFrame, watermark: Column | int | None) -> DataFrame:
    """New rows and the watermark to keep: the latest submit time seen so far."""
    mark = F.lit(None).cast("bigint") if watermark is None else (
        F.lit(watermark) if isinstance(watermark, int) else watermark
    )
    return new.agg(F.count("*").alias("new_rows"), F.max("submit_ts").alias("latest")).select(
        "new_rows", F.coalesce(F.greatest("latest", mark), mark).cast("bigint").alias("watermark")
    )


def read_state(spark: SparkSession, path: str) -> dict:
    """Last polling state; a missing or unreadable one starts afresh."""
    fresh = {"last_submit_ts": None, "total_rows": 0, "poll_count": 0, "last_poll": None, "source": None}
    try:
        rows = spark.read.schema(STATE).json(path).filter(F.col("poll_count").isNotNull()).orderBy(F.desc("poll_count")).take(1)
    except AnalysisException:
        return fresh
    return rows[0].asDict() if rows else fresh


def ingest_increment(spark: SparkSession, fmt: str, source: str, out: str, state_path: str) -> dict:
    """One poll: parse the source, append the new jobs as parquet, advance the state."""
    if fmt not in PARSERS:
        raise ValueError(f"unsupported source {fmt!r}: use one of {sorted(PARSERS)}")
    state = read_state(spark, state_path)
    jobs = PARSERS[fmt](LINES.get(fmt, read_lines)(spark, source)).select(*JOBS.names)
    new = increment(jobs, state["last_submit_ts"])
    batch = f"{out}/poll={state['poll_count'] + 1}"
    new.write.mode("overwrite").parquet(batch)
    # The written rows decide the next watermark, so a re-read of the source cannot disagree.
    summary = next_watermark(spark.read.schema(JOBS).parquet(batch), state["last_submit_ts"]).first()
    state = {
        "last_submit_ts": summary.watermark,
        "total_rows": state["total_rows"] + summary.new_rows,
        "poll_count": state["poll_count"] + 1,
        "last_poll": dt.datetime.now(dt.UTC).isoformat(),
        "source": fmt,
    }
    spark.createDataFrame([state], STATE).coalesce(1).write.mode("append").json(state_path)
    return {**state, "new_rows": summary.new_rows}
