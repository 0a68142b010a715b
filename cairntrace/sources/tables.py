"""Canonical job tables, JSON reports and append-only JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairntrace.schema import JOBS


def load_jobs(spark: SparkSession, path, dataset_id: str | None = None) -> DataFrame:
    """Canonical parquet; a dataset id prunes to its partition."""
    jobs = spark.read.schema(T.StructType([*JOBS, T.StructField("dataset_id", T.StringType())])).parquet(path)
    return jobs if dataset_id is None else jobs.filter(F.col("dataset_id") == dataset_id)


def write_jobs(jobs: DataFrame, path: str, dataset_id: str | None = None, mode: str = "overwrite") -> None:
    """Canonical parquet, one partition directory per dataset."""
    if dataset_id is not None:
        jobs = jobs.withColumn("dataset_id", F.lit(dataset_id))
    writer = jobs.write.mode(mode)
    if "dataset_id" in jobs.columns:
        writer = writer.partitionBy("dataset_id").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def load_reports(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """JSON documents, one per file, with their file name; unreadable ones are left out."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*declared.fields, T.StructField("_corrupt_record", T.StringType())])
    docs = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    named = docs.withColumn("report_file", F.col("_metadata.file_path"))
    return named.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def load_jsonl(spark: SparkSession, path, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
