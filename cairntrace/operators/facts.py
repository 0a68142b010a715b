"""One-row frames as scalar subqueries, and side-by-side aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.session import keep_subqueries_apart


def fact(one_row: DataFrame) -> Column:
    """The only row of a frame as a struct-valued scalar subquery."""
    keep_subqueries_apart(one_row.sparkSession)
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("fact")).scalar()


def with_fact(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Rows with a one-row frame as struct column `name`, planned once however often it is read."""
    return df.withColumn(name, fact(one_row))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Rows with the columns of a one-row frame appended."""
    held = with_fact(df, one_row, "_beside")
    return held.select(*df.columns, *[F.col(f"_beside.{c}").alias(c) for c in one_row.columns])


def side_by_side(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates of the same groups in one row each (single rows when there are no groups)."""
    if by:
        return reduce(lambda a, b: a.join(b, list(by), "left"), frames)
    return reduce(beside, frames)


def with_group_totals(rows: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of an aggregate next to the totals of their group (one row per group)."""
    return rows.join(totals, list(by)) if by else beside(rows, totals)
