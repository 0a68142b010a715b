"""Requests per key within a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.operators.ordered import TICK_WIDTH, running, slice_by_time


def sliding_counts(log: DataFrame, window_sec: int = 60, limit: int = 10, key: str = "key") -> DataFrame:
    """Per (key, second): requests in the last `window_sec` seconds and whether the limit is reached.

    A request counts while it is younger than the window.  Requests are first counted per
    second; each second then also leaves the window once, so the windowed count is one
    running sum over arrivals and departures, however many requests a key has.
    """
    per_second = log.groupBy(key, "ts").agg(F.count("*").alias("n"))
    moves = per_second.select(
        key,
        F.inline(
            F.array(
                F.struct("ts", F.col("n").alias("d"), F.lit(True).alias("arrival")),
                F.struct((F.col("ts") + window_sec).alias("ts"), (-F.col("n")).alias("d"), F.lit(False).alias("arrival")),
            )
        ),
    )
    ticks = moves.groupBy(key, "ts").agg(F.sum("d").alias("d"), F.bool_or("arrival").alias("arrival"))
    # One row per (key, second): a slice of a key holds at most TICK_WIDTH rows.
    out = running(slice_by_time(ticks, width=TICK_WIDTH), [F.col("ts")], [key], sums={"in_window": F.col("d")})
    return out.filter("arrival").select(key, "ts", "in_window", (F.col("in_window") > limit).alias("over_limit"))
