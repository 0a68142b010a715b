"""Structured Streaming: job ingestion, prediction feedback, rolling accuracy, queue depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairntrace.operators.accuracy import outcome_columns, severity
from cairntrace.operators.quantiles import quantiles
from cairntrace.schema import JOBS
from cairntrace.sources import sacct
from cairntrace.streaming.increments import PARSERS
from cairntrace.streaming.state import keep_state_on_disk, live_counts, live_queue

POLL_SEC = 300
#: Size of the sketches of a stream's errors: the larger, the closer their quantiles.
SKETCH_SIZE = 800


def stream_jobs(spark: SparkSession, folder: str, fmt: str, lateness: str | None = None) -> DataFrame:
    """Jobs of log files landing in a folder, each job id once.

    Files are read once, when they appear, in whatever order; no job is lost for being old.
    """
    if fmt not in PARSERS:
        raise ValueError(f"unsupported source {fmt!r}: use one of {sorted(PARSERS)}")
    return each_job_once(PARSERS[fmt](spark.readStream.text(folder)).select(*JOBS.names), lateness)


def each_job_once(jobs: DataFrame, lateness: str | None = None) -> DataFrame:
    """The first row of each job id of a stream.

    The ids seen are state on disk, spread by id: a batch looks up its own ids, however many there are.
    A `lateness` bounds them, but then Spark drops rows whose submit time lies further than
    that behind the latest one.
    """
    keep_state_on_disk(jobs.sparkSession)
    if lateness is None:
        return jobs.dropDuplicates(["job_id"])
    timed = jobs.withColumn("submit_time", F.timestamp_seconds("submit_ts")).withWatermark("submit_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["job_id"]).drop("submit_time")


class Landing:
    """The two streams of `land_jobs`, to be awaited and stopped as one."""

    def __init__(self, parsing: StreamingQuery, start_ids: Callable[[], StreamingQuery], forever: bool) -> None:
        self.parsing, self._start_ids, self._forever = parsing, start_ids, forever
        self.ids = start_ids() if forever else None

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        """Until both are done; of those that run forever, until the ids' one ends."""
        if self._forever:
            return self.ids.awaitTermination(timeout)
        self.parsing.awaitTermination()
        self.ids = self._start_ids()
        return self.ids.awaitTermination(timeout)

    def stop(self) -> None:
        for running in filter(None, (self.parsing, self.ids)):
            running.stop()


def land_jobs(
    spark: SparkSession, folder: str, fmt: str, out: str, checkpoint: str, poll_sec: int | None = None, files: int = 1000
) -> Landing:
    """Write the jobs of log files landing in a folder to `out`, each job id once.

    Unlike `stream_jobs`, Slurm files may have headers of their own, which need a batch's files as tables.  So
    one stream parses each batch into `checkpoint/parsed`, where a repeated batch overwrites itself, and a second one
    reads those jobs and lets each id pass once; neither reads again what earlier batches wrote.
    """
    if fmt not in PARSERS:
        raise ValueError(f"unsupported source {fmt!r}: use one of {sorted(PARSERS)}")
    lines = sacct.with_origin(spark.readStream.option("maxFilesPerTrigger", files).text(folder))
    parsed_jobs = f"{checkpoint}/parsed"

    def one(batch: DataFrame, batch_id: int) -> None:
        parsed = PARSERS[fmt](sacct.with_layouts(batch) if fmt == "slurm" else batch.select("value"))
        parsed.select(*JOBS.names).write.mode("overwrite").parquet(f"{parsed_jobs}/batch={batch_id}")

    def ids() -> StreamingQuery:
        # the folder is there before the first batch is
        spark.createDataFrame([], JOBS).write.mode("ignore").parquet(f"{parsed_jobs}/batch=-1")
        jobs = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files).parquet(f"{parsed_jobs}/batch=*")
        return write_stream(each_job_once(jobs.select(*JOBS.names)), out, f"{checkpoint}/ids", poll_sec)

    trigger = {"processingTime": f"{poll_sec} seconds"} if poll_sec else {"availableNow": True}
    parsing = lines.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/lines").trigger(**trigger).start()
    return Landing(parsing, ids, bool(poll_sec))


def write_stream(df: DataFrame, out: str, checkpoint: str, poll_sec: int | None = POLL_SEC) -> StreamingQuery:
    """Append to parquet, exactly once; without an interval, process what is there and stop."""
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": f"{poll_sec} seconds"} if poll_sec else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start()


def poll_stats(
    df: DataFrame, out: str, stats: str, checkpoint: str, source: str, poll_sec: int | None = POLL_SEC
) -> StreamingQuery:
    """Write each batch with its number, and one statistics row per batch (rewritten on retry)."""

    def one(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/poll={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(batch.schema).parquet(target)
        summary = written.agg(
            F.count("*").alias("rows"),
            F.max("submit_ts").alias("last_submit_ts"),
            F.lit(source).alias("source"),
            F.current_timestamp().alias("polled_at"),
        )
        summary.write.mode("overwrite").parquet(f"{stats}/poll={batch_id}")

    trigger = {"processingTime": f"{poll_sec} seconds"} if poll_sec else {"availableNow": True}
    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def poll_totals(stats: DataFrame) -> DataFrame:
    """Rows and polls so far, latest poll and source."""
    return stats.agg(
        F.sum("rows").alias("total_rows"),
        F.count("*").alias("poll_count"),
        F.max("polled_at").alias("last_poll"),
        F.max("source").alias("source"),
    )


def stream_feedback(predictions: DataFrame, actuals: DataFrame, within: str | None = None) -> DataFrame:
    """Predictions (job_id, predicted_at, p10, p50, p90) joined with the run time reported for the
    job (job_id, done_at, actual_sec) at or after the prediction, with errors.

    Rows wait in the state for the other side, however late it comes.  With `within`, outcomes
    must follow in that time and watermarks bound the state, but Spark then drops rows further
    behind the latest ones."""
    p, a = predictions, actuals
    same = "p.job_id = a.job_id AND a.done_at >= p.predicted_at"
    if within is not None:
        p, a = p.withWatermark("predicted_at", within), a.withWatermark("done_at", within)
        same += f" AND a.done_at <= p.predicted_at + INTERVAL {within}"
    p, a, same = p.alias("p"), a.alias("a"), F.expr(same)
    both = p.join(a, same, "inner").select("p.job_id", "p.p10", "p.p50", "p.p90", "a.actual_sec", "a.done_at")
    return both.withColumns(outcome_columns(F.col("actual_sec")))


def rolling_accuracy(scored: DataFrame, window: str = "1 day", slide: str | None = None, at: str = "done_at") -> DataFrame:
    """Coverage, error and severity per event-time window.

    Of a table, `p95_error` is exact.  Of a stream it is read from a mergeable sketch of the errors, whose rank is
    within a fraction of a percent of the 95th; the stream's `at` needs a watermark."""
    span = F.window(at, window, slide) if slide else F.window(at, window)
    size = F.abs("error_sec").cast("double")
    coverage = F.avg(F.col("in_interval").cast("double"))
    rows = scored.withColumns({"_size": size, "_w": span})
    sketch = F.kll_sketch_agg_double("_size", F.lit(SKETCH_SIZE))
    out = rows.groupBy("_w").agg(
        F.count("*").alias("predictions"),
        coverage.alias("interval_coverage"),
        F.avg("_size").alias("mean_absolute_error"),
        F.avg("abs_pct_error").alias("mape"),
        *([F.kll_sketch_get_quantile_double(sketch, F.lit(0.95)).alias("p95_error")] if scored.isStreaming else []),
        severity(coverage).alias("drift_severity"),
    )
    if not scored.isStreaming:
        tails = quantiles(rows, {"size": F.col("_size")}, [0.95], ["_w"])
        out = out.join(tails.select("_w", F.col("size_p95").alias("p95_error")), "_w")
    return out.select(
        F.col("_w").alias("w"), "predictions", "interval_coverage", "mean_absolute_error", "mape", "p95_error", "drift_severity"
    )


# --------------------------------------------------------------------------- queue depth


def queue_events(jobs: DataFrame) -> DataFrame:
    """Submit and start events (ts, queue_id, net jobs, net CPUs) of a job table."""
    cpus = F.col("requested_cpus").cast("bigint")
    moves = [("submit_ts", 1), ("start_ts", -1)]
    rows = [
        F.struct(F.col(t).alias("ts"), F.lit(s).cast("bigint").alias("dj"), (cpus * s).alias("dc")) for t, s in moves
    ]
    return jobs.select(F.coalesce(F.col("queue_id").cast("string"), F.lit("")).alias("queue_id"), F.inline(F.array(*rows)))


def stream_queue(
    events: DataFrame, out: str, checkpoint: str, lateness: str = "1 hour", poll_sec: int | None = None
) -> StreamingQuery:
    """Live queue depth (`state.live_queue`) appended to parquet, exactly once.

    The depths and the changes that wait are state of the checkpoint: a restart goes on from them, and fails if they are gone.
    """
    return write_stream(live_queue(events, lateness), out, checkpoint, poll_sec)


def stream_request_counts(
    log: DataFrame, out: str, checkpoint: str, lateness: str = "1 minute", window_sec: int = 60, limit: int = 10,
    poll_sec: int | None = None,
) -> StreamingQuery:
    """Requests of the trailing window per (key, second) (`state.live_counts`) appended to parquet, exactly once."""
    return write_stream(live_counts(log, lateness, window_sec, limit), out, checkpoint, poll_sec)
