"""Data quality of ingested tables and integrity of their source files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.operators.facts import side_by_side


def quality_report(jobs: DataFrame, line_counts: DataFrame | None = None) -> DataFrame:
    """One row: line counters (from a source's `parse_stats`) and null counts of the parsed jobs."""
    rows = jobs.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("requested_mem").isNull()).alias("requested_mem_null_rows"),
        F.avg(F.col("requested_mem").isNull().cast("double")).alias("requested_mem_null_rate"),
        F.count_if(F.col("runtime_requested_sec").isNull()).alias("runtime_requested_null_rows"),
        F.count_if(F.col("requested_cpus") == F.col("allocated_cpus")).alias("requested_cpu_fallback_rows"),
    )
    return rows if line_counts is None else side_by_side([rows, line_counts], [])


def null_rates(df: DataFrame) -> DataFrame:
    """Share of nulls per column, one row per column."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in df.columns]
    return rates.select(F.inline(F.array(*rows)))


#: Stores that tasks read block by block, and the bytes of a block.
STREAMED = ("file", "hdfs", "s3", "gs")
BLOCK_BYTES = 8 << 20


def _opened(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, length in zip(frame["path"], frame["length"], strict=True):
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            yield pd.DataFrame({"path": [path], "length": [length], "sha256": [digest.hexdigest()]})


def dataset_fingerprint(spark: SparkSession, path) -> DataFrame:
    """SHA-256 and length per file, each file read block by block by one task, however large; empty
    files, which Spark's readers leave out, have no row.

    Files of stores that only Spark opens (see STREAMED for the others) are read as one value, up to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    # without the contents this lists the files only
    stores = files.groupBy(F.substring_index("path", ":", 1).alias("store")).agg(F.count("*").alias("n")).collect()
    if all(r.store in STREAMED for r in stores):
        tasks = max(1, min(sum(r.n for r in stores), 8 * spark.sparkContext.defaultParallelism))
        listed = files.select("path", "length").repartition(tasks, "path")
        read = listed.mapInPandas(_digests, "path string, length bigint, sha256 string")
    else:
        read = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return read.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "sha256")


def verify_suite(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected against found hashes: missing, unlocked, mismatch, locked or unlisted."""
    found = files.select("filename", F.col("sha256").alias("sha256_observed"))
    listed = manifest.select("trace_id", "filename", F.col("sha256").alias("sha256_expected"))
    both = listed.join(found, "filename", "full")
    return both.withColumn(
        "status",
        F.when(F.col("trace_id").isNull(), "unlisted")
        .when(F.col("sha256_observed").isNull(), "missing")
        .when(F.col("sha256_expected").isNull(), "unlocked")
        .when(F.col("sha256_expected") != F.col("sha256_observed"), "mismatch")
        .otherwise("locked"),
    )
