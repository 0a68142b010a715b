"""Per-user history: prefix statistics, recent completions, decayed usage."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairntrace.operators.facts import fact
from cairntrace.operators.ordered import SLICE, running, running_sums, slice_by_range
from cairntrace.operators.quantiles import quantiles
from cairntrace.schema import id_order, require, user_key

HALF_LIFE_SEC = 7 * 24 * 3600
# Exponents stay below 2^512 inside one epoch of this many half-lives.
EPOCH_HALF_LIVES = 512


# --------------------------------------------------------------------------- prefix statistics


def user_lookbacks(jobs: DataFrame, causal: bool = False, fills_from: DataFrame | None = None) -> DataFrame:
    """Median, variance and mean over-request of each user's earlier jobs, their number, and the
    gap to the user's previous submission.  Jobs without such history take whole-table values.

    "Earlier" means submitted before, finished or not; with `causal` it means completed
    (submit + run time) by the submission.  `fills_from` restricts the whole-table values
    to another set of jobs, such as a training slice.
    """
    require(jobs, {"job_id", "submit_ts", "runtime_actual_sec", "runtime_requested_sec", "user_id"}, "user lookbacks")

    def slim(df: DataFrame) -> DataFrame:
        run = F.col("runtime_actual_sec").cast("bigint")
        ratio = F.col("runtime_requested_sec").cast("double") / F.nullif(run.cast("double"), F.lit(0.0))
        return df.select("job_id", "submit_ts", user_key().alias("user_key"), run.alias("run"), ratio.alias("ratio"))

    base = slim(jobs)
    whole = slim(fills_from) if fills_from is not None else base
    # The mean also serves as centre, which keeps the sums of squares well conditioned.
    spread = fact(whole.agg(F.var_pop(F.col("run").cast("double")).alias("var"), F.avg("run").alias("centre")))
    middle = fact(quantiles(whole, {"run": F.col("run"), "ratio": F.col("ratio")}, [0.5]))

    if causal:
        done = base.withColumns({"ts": F.col("submit_ts") + F.col("run"), "kind": F.lit(0)})
        asks = base.withColumns({"ts": F.col("submit_ts"), "kind": F.lit(1)})
        events = done.unionByName(asks).withColumns({"adds": F.col("kind") == 0, "asks": F.col("kind") == 1})
    else:
        events = base.withColumns({"ts": F.col("submit_ts"), "kind": F.lit(0), "adds": F.lit(True), "asks": F.lit(True)})
    events = events.withColumns(
        {
            "v": F.when(F.col("adds"), F.col("run")),
            "dev": F.when(F.col("adds"), F.col("run") - spread.getField("centre")),
            "ratio": F.when(F.col("adds"), F.col("ratio")),
        }
    )
    order = [F.col("ts"), F.col("kind"), F.col("submit_ts"), *id_order(jobs)]
    sliced = slice_by_range(events, [F.col("user_key"), *order])

    def own(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    added = {
        "n": F.col("adds").cast("bigint"),
        "s1": F.col("dev"),
        "s2": F.col("dev") * F.col("dev"),
        "rn": F.col("ratio").isNotNull().cast("bigint"),
        "rs": F.col("ratio"),
    }
    asked_ts = F.when(F.col("asks"), F.col("submit_ts"))
    rows = running(sliced, order, ["user_key"], sums=added, previous={"prev_ts": asked_ts})
    rows = rows.select(
        SLICE, "user_key", "ts", "kind", "submit_ts", "job_id", "v", "asks", "prev_ts",
        *[(F.col(name) - own(value)).alias(name) for name, value in added.items()],
    )
    rows = with_prefix_medians(rows, sliced).filter("asks")
    mean = F.col("s1") / F.col("n")
    return rows.select(
        "job_id",
        F.coalesce("prefix_median", middle.getField("run_p50")).alias("user_runtime_median_lookback"),
        F.when(F.col("n") > 0, F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
        .otherwise(spread.getField("var"))
        .alias("user_runtime_var_lookback"),
        F.col("n").alias("user_job_count_lookback"),
        F.greatest(F.coalesce(F.col("submit_ts") - F.col("prev_ts"), F.lit(0)), F.lit(0)).alias(
            "user_submit_gap_sec_lookback"
        ),
        F.when(F.col("rn") > 0, F.col("rs") / F.col("rn"))
        .otherwise(F.coalesce(middle.getField("ratio_p50"), F.lit(1.0)))
        .alias("user_overrequest_mean_lookback"),
    )


def with_prefix_medians(rows: DataFrame, sliced: DataFrame) -> DataFrame:
    """Add `prefix_median`: the exact median of the values `v` a user has before each row.

    `rows` and `sliced` hold the same events, sliced by (user_key, ts, kind, submit_ts, job_id);
    a null `v` adds nothing.  A slice needs of its user's earlier slices only the middle of
    their values: with m values of its own the median moves by at most m/2 ranks.  Those
    bands come from per-slice value counts: running counts per (user, value) over the
    user's slices, then ranks per (user, slice).  Both are windows over counted values, and
    a band holds at most as many values as the slice adds.  Whole-second run times keep
    the distinct values of a user far below its number of jobs.
    """
    counted = sliced.filter("v IS NOT NULL").groupBy(SLICE, "user_key", "v").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("user_key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = sliced.groupBy(SLICE, "user_key").agg(F.count("v").alias("m"))
    continued = spans.withColumn("earlier", F.sum("m").over(earlier)).filter(F.col("earlier") > 0)
    lasting = continued.groupBy("user_key").agg(F.max(SLICE).alias("to_slice"))
    # Value counts of users that cross a slice boundary, carried to every later slice of the user.
    per_value = counted.join(lasting, "user_key").groupBy("user_key", "v", "to_slice").agg(
        F.map_from_entries(F.collect_list(F.struct(SLICE, "c"))).alias("by_slice"), F.min(SLICE).alias("first")
    )
    dense = per_value.select("user_key", "v", "by_slice", F.explode(F.sequence("first", "to_slice")).alias(SLICE))
    over_slices = Window.partitionBy("user_key", "v").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.try_element_at("by_slice", SLICE), F.lit(0))
    before = dense.select("user_key", "v", SLICE, F.sum(here).over(over_slices).alias("c")).filter(F.col("c") > 0)
    ranked = before.join(continued, [SLICE, "user_key"]).withColumn(
        "to", F.sum("c").over(Window.partitionBy(SLICE, "user_key").orderBy("v"))
    )
    low = F.greatest(F.lit(0), F.floor(F.col("earlier") / 2) - F.col("m") - 1)
    high = F.least(F.col("earlier"), F.floor(F.col("earlier") / 2) + F.col("m") + 2)
    keep = F.least("to", high) - F.greatest(F.col("to") - F.col("c"), low)
    bands = ranked.withColumns({"low": low, "high": high, "keep": keep}).filter(F.col("keep") > 0)
    bands = bands.select(
        F.col(SLICE).alias("band_slice"),
        F.col("user_key").alias("band_user"),
        F.col("v").alias("band_v"),
        "keep",
        "low",
        (F.col("earlier") - F.col("high")).alias("above"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("prefix_median", T.DoubleType())])
    return rows.groupBy(SLICE).cogroup(bands.groupBy("band_slice")).applyInPandas(_slice_medians, schema)


def _slice_medians(rows: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
    rows = _in_order(rows)
    prior = {k: g.sort_values("band_v") for k, g in bands.groupby("band_user")} if len(bands) else {}
    out = np.full(len(rows), np.nan)
    users, values = rows["user_key"].to_numpy(), rows["v"].to_numpy(dtype=float, na_value=np.nan)
    starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]]) if len(rows) else np.array([], dtype=int)
    for at, end in zip(starts, np.r_[starts[1:], len(rows)]):
        band = prior.get(users[at])
        before, below, above = [], 0, 0
        if band is not None:
            before = np.repeat(band["band_v"].to_numpy(dtype=float), band["keep"].to_numpy()).tolist()
            below, above = int(band["low"].iloc[0]), int(band["above"].iloc[0])
        out[at:end] = _medians_before(values[at:end].tolist(), before, below, above)
    return rows.assign(prefix_median=pd.array(np.where(np.isnan(out), None, out), dtype="Float64"))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    if rows["job_id"].dtype == object:
        number = pd.to_numeric(rows["job_id"], errors="coerce")
        rows = rows.assign(_number=number)
        keys = ["user_key", "ts", "kind", "submit_ts", "_number", "job_id"]
        return rows.sort_values(keys, na_position="first").drop(columns="_number")
    return rows.sort_values(["user_key", "ts", "kind", "submit_ts", "job_id"])


def _medians_before(values: Iterable[float], before: list, below: int, above: int) -> list[float]:
    """Median of everything before each value (NaN adds nothing); `before` is the sorted middle
    of the earlier values, with `below` smaller and `above` larger ones left out."""
    total = below + len(before) + above
    cut = max(0, (total + 1) // 2 - below)
    lows, highs = [-v for v in before[:cut]], list(before[cut:])
    heapq.heapify(lows)
    n_low, n_high = below + len(lows), above + len(highs)
    out = []
    for v in values:
        if n_low + n_high == 0:
            out.append(float("nan"))
        elif n_low > n_high:
            out.append(float(-lows[0]))
        else:
            out.append((-lows[0] + highs[0]) / 2.0)
        if v != v:
            continue
        if not lows or v <= -lows[0]:
            heapq.heappush(lows, -v)
            n_low += 1
        else:
            heapq.heappush(highs, v)
            n_high += 1
        if n_low > n_high + 1:
            heapq.heappush(highs, -heapq.heappop(lows))
            n_low, n_high = n_low - 1, n_high + 1
        elif n_high > n_low:
            heapq.heappush(lows, -heapq.heappop(highs))
            n_low, n_high = n_low + 1, n_high - 1
    return out


# --------------------------------------------------------------------------- completions before submit


def completion_events(jobs: DataFrame) -> DataFrame:
    """Completions (kind 0, at submit + run time) and submissions (kind 1), completions first at a tie."""
    require(jobs, {"job_id", "submit_ts", "runtime_actual_sec", "requested_cpus", "user_id"}, "user history")
    base = jobs.select(
        "job_id",
        "submit_ts",
        user_key().alias("user_key"),
        F.greatest(F.coalesce(F.col("runtime_actual_sec").cast("bigint"), F.lit(0)), F.lit(0)).alias("run"),
        F.coalesce(F.col("requested_cpus").cast("bigint"), F.lit(1)).alias("cpus"),
    )
    done = base.withColumns({"ts": F.col("submit_ts") + F.col("run"), "kind": F.lit(0)})
    asked = base.withColumns({"ts": F.col("submit_ts"), "kind": F.lit(1)})
    return done.unionByName(asked)


def asof_history(jobs: DataFrame) -> DataFrame:
    """The two latest run times a user completed by each submission (`last_run`, `prev_run`)."""
    events = completion_events(jobs)
    order = [F.col("ts"), F.col("kind"), F.col("submit_ts"), *id_order(jobs)]
    sliced = slice_by_range(events, [F.col("user_key"), *order])
    finished = F.when((F.col("kind") == 0) & (F.col("run") > 0), F.col("run"))
    seen = running(sliced, order, ["user_key"], previous={"older": finished})
    # Every completion now knows the one before it; submissions read the latest such pair.
    pair = F.when(finished.isNotNull(), F.struct(F.col("run").alias("last"), F.col("older").alias("prev")))
    out = running(seen, order, ["user_key"], lasts={"pair": pair})
    return out.filter(F.col("kind") == 1).select(
        "job_id", F.col("pair.last").alias("last_run"), F.col("pair.prev").alias("prev_run")
    )


def tsafrir(jobs: DataFrame) -> DataFrame:
    """Predict a job's run time as the mean of its user's two latest completed run times,
    never above the requested time (`runtime_estimate_sec`, which also serves cold starts)."""
    require(jobs, {"runtime_estimate_sec"}, "two-completions predictor")
    estimate = F.col("runtime_estimate_sec").cast("bigint")
    asked = F.when(estimate > 0, estimate).otherwise(F.greatest(F.lit(1), F.col("runtime_actual_sec").cast("bigint")))
    out = jobs.withColumn("_asked", asked).join(asof_history(jobs), "job_id")
    history = F.col("last_run").isNotNull().cast("int") + F.col("prev_run").isNotNull().cast("int")
    raw = (
        F.when(F.col("prev_run").isNotNull(), F.greatest(F.lit(1), F.expr("(last_run + prev_run) DIV 2")))
        .when(F.col("last_run").isNotNull(), F.col("last_run"))
        .otherwise(F.col("_asked"))
    )
    return out.withColumns(
        {
            "tsafrir_runtime_sec": F.greatest(F.lit(1), F.least(raw, F.col("_asked"))).cast("bigint"),
            "tsafrir_history_count": history,
            "tsafrir_clamped": raw > F.col("_asked"),
        }
    ).drop("_asked", "last_run", "prev_run")


def fairshare(jobs: DataFrame, half_life_sec: float = HALF_LIFE_SEC) -> DataFrame:
    """Minus each user's CPU-seconds completed by the submission, halved every half-life.

    Within an epoch of 512 half-lives usage is a running sum of cpu_sec * 2^((c - t0) / H),
    scaled back at the submission; earlier epochs enter as one carried amount.
    """
    length = int(EPOCH_HALF_LIVES * half_life_sec)
    events = completion_events(jobs).withColumn("epoch", F.floor(F.col("ts") / F.lit(length)).cast("bigint"))
    events = events.withColumn("age", (F.col("ts") - F.col("epoch") * length) / F.lit(float(half_life_sec)))
    order = [F.col("ts"), F.col("kind"), F.col("submit_ts"), *id_order(jobs)]
    sliced = slice_by_range(events, [F.col("user_key"), F.col("epoch"), *order])
    work = F.when(F.col("kind") == 0, F.col("cpus").cast("double") * F.col("run") * F.pow(F.lit(2.0), F.col("age")))
    groups = ["user_key", "epoch"]
    rows = running_sums(sliced, order, {"usage": F.coalesce(work, F.lit(0.0))}, groups)
    # Earlier epochs of a user (a handful: one per 512 half-lives) decayed to the start of this one.
    totals = sliced.groupBy(*groups).agg(F.sum(work).alias("total"))
    past = F.collect_list(F.struct("epoch", "total")).over(
        Window.partitionBy("user_key").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.withColumn("past", past).select(
        *groups,
        F.aggregate(
            "past",
            F.lit(0.0),
            lambda acc, e: acc
            + F.coalesce(e["total"], F.lit(0.0)) * F.pow(F.lit(2.0), (e["epoch"] - F.col("epoch")) * EPOCH_HALF_LIVES),
        ).alias("carried"),
    )
    presence = sliced.select(SLICE, *groups).distinct().join(carried, groups)
    rows = rows.join(presence, [SLICE, *groups])
    return rows.filter(F.col("kind") == 1).select(
        "job_id",
        (-(F.col("usage") + F.col("carried")) * F.pow(F.lit(2.0), -F.col("age"))).alias("priority_score"),
    )


def decayed_usage(jobs: DataFrame, at_ts: Column, half_life_sec: float = HALF_LIFE_SEC) -> DataFrame:
    """Decayed CPU-seconds per user at one time: a plain aggregate."""
    done = F.col("submit_ts") + F.col("runtime_actual_sec")
    used = F.col("requested_cpus").cast("double") * F.col("runtime_actual_sec")
    return (
        jobs.filter(done <= at_ts)
        .groupBy(user_key().alias("user_key"))
        .agg(F.sum(used * F.pow(F.lit(2.0), (done - at_ts) / F.lit(float(half_life_sec)))).alias("decayed_usage"))
    )
