"""Canonical job table and the argument checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOBS = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("submit_ts", T.LongType(), False),
        T.StructField("start_ts", T.LongType(), False),
        T.StructField("end_ts", T.LongType(), False),
        T.StructField("wait_sec", T.LongType(), False),
        T.StructField("runtime_actual_sec", T.LongType(), False),
        T.StructField("runtime_requested_sec", T.LongType(), True),
        T.StructField("allocated_cpus", T.IntegerType(), False),
        T.StructField("requested_cpus", T.IntegerType(), False),
        T.StructField("requested_mem", T.LongType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("group_id", T.StringType(), True),
        T.StructField("queue_id", T.StringType(), True),
        T.StructField("partition_id", T.StringType(), True),
        T.StructField("runtime_overrequest_ratio", T.DoubleType(), True),
    ]
)

OPTIONAL = ("runtime_requested_sec", "requested_mem", "user_id", "group_id", "queue_id", "partition_id")


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raise naming every column `what` needs and `df` lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")


def with_optional(df: DataFrame, columns: Iterable[str] = OPTIONAL) -> DataFrame:
    """Add absent optional columns as nulls of their canonical type."""
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(JOBS[c].dataType) for c in absent}) if absent else df


def user_key(column: str | Column = "user_id") -> Column:
    """User id as a string, jobs without one pooled under '-1'."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("-1"))


def id_order(df: DataFrame, column: str = "job_id") -> list[Column]:
    """Sort keys of an id column: text ids by numeric value where they have one (others first)."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return [F.col(column).try_cast("bigint"), F.col(column)]
    return [F.col(column)]


def conform(df: DataFrame) -> DataFrame:
    """Select and cast to the canonical columns."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOBS])
