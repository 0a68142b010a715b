"""Exact quantiles of any number of columns, per group, for any number of distinct values.

Spark's `percentile` keeps every distinct value of a group in one task.  Here a histogram of
BUCKETS buckets per group, whose rows are counted where they lie, tells which buckets hold a
wanted rank.  The values of those alone are counted, range-sliced and ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairntrace.operators.ordered import running_sums, slice_by_range
from cairntrace.session import settle

#: Buckets of a histogram; each group has its own.
BUCKETS = 4096
#: Groups up to which their histograms are made: more groups are smaller, and would take more buckets than rows.
HISTOGRAMS = 1000


def _tag(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def bucket(value: Column, low: Column, high: Column) -> Column:
    """Place of a value among BUCKETS from `low` to `high`, by its logarithm: never smaller for a larger value.
    All values have one bucket if those ends are equal or not finite; a null has the bucket -1."""

    def log(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x))

    span = log(high) - log(low)
    at = F.floor((log(value) - log(low)) / span * BUCKETS)
    spread = F.when((span > 0) & (span < 1e300), at).otherwise(F.lit(0).cast("bigint"))
    return F.when(value.isNull(), F.lit(-1).cast("bigint")).otherwise(spread)


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Mapping[str, Sequence[float]] | Sequence[float],
    by: Sequence[str] = (),
    nearest: bool = False,
) -> DataFrame:
    """One row per `by` group with `<column>_p<percent>` and `<column>_n` (non-null count).

    Linear interpolation between order statistics, or with `nearest` the element at
    round((n - 1) * p).  Columns are doubles; an all-null column gives nulls and 0.
    """
    wanted = probs if isinstance(probs, Mapping) else {c: list(probs) for c in columns}
    pairs = F.array(*[F.struct(F.lit(n).alias("m"), e.cast("double").alias("v")) for n, e in columns.items()])
    rows = settle(
        df.select(*by, F.explode(pairs).alias("mv"))
        .select(*by, F.col("mv.m").alias("_m"), F.col("mv.v").alias("_v"))
        .filter(F.col("_v").isNotNull())
    )
    groups = [*by, "_m"]
    ends = settle(rows.groupBy(*groups).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_to_all")))
    if ends.count() <= HISTOGRAMS:
        # a null group has no quantiles: it meets no row of its own in a join
        placed = rows.join(ends, groups).withColumn("_b", bucket(F.col("_v"), F.col("_low"), F.col("_high")))
        bins = placed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"), F.first("_to_all").alias("_to_all"))
        below = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b"))
        bins = bins.withColumn("_below", below - F.col("_n"))

        def inside(name: str, p: float) -> Column:
            at = (F.col("_to_all") - 1) * F.lit(float(p))
            low, high = (F.round(at), F.round(at)) if nearest else (F.floor(at), F.ceil(at))
            holding = (F.col("_below") <= high) & (low < F.col("_below") + F.col("_n"))
            return (F.col("_m") == name) & holding

        hit = [inside(name, p) for name in columns for p in wanted[name]]
        kept = bins.filter(F.col("_below") == 0 if not hit else reduce(or_, hit, F.col("_below") < 0))
        kept = settle(kept.select(*groups, "_b", "_below", "_to_all"))
        groups = [*groups, "_b", "_below", "_to_all"]
        rows = placed.drop("_to_all").join(kept, [*by, "_m", "_b"])
    else:
        groups = [*groups, "_below", "_to_all"]
        rows = rows.join(ends.withColumn("_below", F.lit(0).cast("bigint")), [*by, "_m"])
    counts = rows.groupBy(*groups, "_v").agg(F.count("*").alias("_n"))
    sliced = slice_by_range(counts, [*groups, "_v"])
    ranked = running_sums(sliced, [F.col("_v")], {"_to": F.col("_n")}, groups)
    ranked = ranked.withColumn("_to", F.col("_to") + F.col("_below")).withColumn("_from", F.col("_to") - F.col("_n"))

    def holds(index: Column) -> Column:
        return (F.col("_from") <= index) & (index < F.col("_to"))

    hits: dict[str, Column] = {}
    for name in columns:
        mine = F.col("_m") == name
        hits[f"{name}_n"] = F.max(F.when(mine, F.col("_to_all")))
        for p in wanted[name]:
            at = (F.col("_to_all") - 1) * F.lit(float(p))
            low = F.round(at) if nearest else F.floor(at)
            hits[f"_lo_{name}_{_tag(p)}"] = F.max(F.when(mine & holds(low), F.col("_v")))
            hits[f"_hi_{name}_{_tag(p)}"] = F.max(F.when(mine & holds(F.ceil(at)), F.col("_v")))
    found = ranked.groupBy(*by).agg(*[e.alias(n) for n, e in hits.items()])

    out: list[Column] = [F.col(b) for b in by]
    for name in columns:
        n = F.coalesce(F.col(f"{name}_n"), F.lit(0)).cast("bigint")
        out.append(n.alias(f"{name}_n"))
        for p in wanted[name]:
            lo, hi = F.col(f"_lo_{name}_{_tag(p)}"), F.col(f"_hi_{name}_{_tag(p)}")
            at = (n - 1) * F.lit(float(p))
            value = lo if nearest else lo + (hi - lo) * (at - F.floor(at))
            out.append(value.alias(f"{name}_{_tag(p)}"))
    return found.select(*out)
