"""Row-wise helpers on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Select `keep` plus computed columns that are evaluated exactly once per row.

    Catalyst pushes a filter below a projection by copying the projected expressions into
    it, so a field that is split out of text and then both filtered on and used in several
    columns is parsed that many times.  A one-element `inline` is a step filters do not cross.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
