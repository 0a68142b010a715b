"""How good predictions are, whether data drifted, and how models combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.functions.scalars import abs_pct_error, in_order, pinball
from cairntrace.operators.facts import fact, side_by_side, with_fact
from cairntrace.operators.quantiles import quantiles
from cairntrace.schema import require, user_key

QUANTILES = {"p10": 0.10, "p50": 0.50, "p90": 0.90}

# Drift and coverage limits.
PSI_THRESHOLD, DEGRADATION_FACTOR, PSI_BINS = 0.20, 1.5, 10
PSI_EPSILON = 1e-6
COVERAGE_WARNING, COVERAGE_CRITICAL = 0.70, 0.50

NUMERIC_FEATURES = [
    "requested_cpus",
    "runtime_requested_sec",
    "requested_mem",
    "user_overrequest_mean_lookback",
    "user_runtime_median_lookback",
    "queue_congestion_at_submit_jobs",
]


def quantile_losses(scored: DataFrame, actual: str = "actual") -> DataFrame:
    """Pinball loss and MAE per quantile, and the share of actuals within p10..p90, in one pass."""
    y = F.col(actual).cast("double")
    return scored.agg(
        F.count("*").alias("rows"),
        *[F.avg(pinball(y, F.col(q), a)).alias(f"{q}_pinball") for q, a in QUANTILES.items()],
        *[F.avg(F.abs(y - F.col(q))).alias(f"{q}_mae") for q in QUANTILES],
        F.avg(((y >= F.col("p10")) & (y <= F.col("p90"))).cast("double")).alias("interval_coverage_p10_p90"),
    )


def user_median_baseline(train: DataFrame, test: DataFrame, target: str = "runtime_actual_sec") -> DataFrame:
    """Test rows with the median of the user's training rows, else of all training rows."""
    t = F.col(target)
    per_user = quantiles(train.withColumn("user_key", user_key()), {"t": t}, [0.5], ["user_key"])
    per_user = per_user.select("user_key", F.col("t_p50").alias("_median"))
    overall = fact(quantiles(train, {"t": t}, [0.5])).getField("t_p50")
    out = test.withColumn("user_key", user_key()).join(per_user, "user_key", "left")
    return out.withColumn("user_history_median", F.coalesce("_median", overall)).drop("_median", "user_key")


def naive_baselines(train: DataFrame, test: DataFrame, target: str = "runtime_actual_sec") -> DataFrame:
    """MAE, MAPE and pinball loss of three predictors that need no model."""
    t = F.col(target)
    middle = fact(quantiles(train, {"t": t}, [0.5])).getField("t_p50")
    mean = fact(train.agg(F.avg(t).alias("m"))).getField("m")
    scored = user_median_baseline(train, test, target).withColumns({"global_median": middle, "global_mean": mean})
    y = t.cast("double")
    names = ["global_median", "global_mean", "user_history_median"]
    long = scored.select(
        y.alias("y"), F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("pred")) for n in names]))
    )
    return long.groupBy("baseline").agg(
        F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"),
        F.avg(abs_pct_error(F.col("y"), F.col("pred"))).alias("mape"),
        F.avg(pinball(F.col("y"), F.col("pred"), 0.5)).alias("pinball_loss_p50"),
    )


def evaluate_quantiles(scored: DataFrame, train: DataFrame, target: str = "runtime_actual_sec") -> DataFrame:
    """Improvement of the model's p50 over each naive predictor on the scored rows."""
    losses = F.col("_losses")
    base = with_fact(naive_baselines(train, scored, target), quantile_losses(scored, target), "_losses")
    return base.select(
        "baseline",
        "mae",
        "mape",
        "pinball_loss_p50",
        (F.col("mae") - losses.getField("p50_mae")).alias("mae_improvement"),
        (F.col("pinball_loss_p50") - losses.getField("p50_pinball")).alias("pinball_p50_improvement"),
    )


# --------------------------------------------------------------------------- feedback


def outcome_columns(actual: Column) -> dict[str, Column]:
    error = F.col("p50") - actual
    return {
        "in_interval": (F.col("p10") <= actual) & (actual <= F.col("p90")),
        "error_sec": error,
        "abs_pct_error": F.abs(error) / F.greatest(actual, F.lit(1.0)),
    }


def score_predictions(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with the actual run time of the same job and their errors."""
    both = predictions.join(actuals.select("job_id", F.col("actual_sec").cast("double").alias("actual_sec")), "job_id")
    return both.withColumns(outcome_columns(F.col("actual_sec")))


def severity(coverage: Column) -> Column:
    return F.when(coverage < COVERAGE_CRITICAL, "severe").when(coverage < COVERAGE_WARNING, "mild").otherwise("none")


def feedback_report(scored: DataFrame, last_n: int | None = None, order: Sequence[str] = ("ts", "job_id")) -> DataFrame:
    """Accuracy over all scored predictions, or the most recent `last_n`."""
    rows = scored if last_n is None else scored.orderBy(*[F.desc(c) for c in order]).limit(last_n)
    size = F.abs("error_sec")
    base = rows.agg(
        F.count("*").alias("total_predictions"),
        F.avg(F.col("in_interval").cast("double")).alias("interval_coverage"),
        F.avg(size).alias("mean_absolute_error"),
        F.avg("abs_pct_error").alias("mape"),
        F.avg((F.col("error_sec") > 0).cast("double")).alias("overestimate_rate"),
        F.avg((F.col("error_sec") < 0).cast("double")).alias("underestimate_rate"),
    )
    tails = quantiles(rows, {"e": size}, [0.5, 0.95])
    both = side_by_side([base, tails], [])
    zero = F.lit(0.0)
    some = F.col("total_predictions") > 0
    coverage = F.coalesce("interval_coverage", zero)
    level = F.when(some, severity(coverage)).otherwise("none")
    return both.select(
        "total_predictions",
        coverage.alias("interval_coverage"),
        F.coalesce("mean_absolute_error", zero).alias("mean_absolute_error"),
        F.coalesce("e_p50", zero).alias("median_absolute_error"),
        F.coalesce("mape", zero).alias("mape"),
        F.coalesce("e_p95", zero).alias("p95_error"),
        F.coalesce("overestimate_rate", zero).alias("overestimate_rate"),
        F.coalesce("underestimate_rate", zero).alias("underestimate_rate"),
        (level != "none").alias("drift_detected"),
        level.alias("drift_severity"),
    )


# --------------------------------------------------------------------------- drift


def psi(
    train: DataFrame,
    evaluated: DataFrame,
    features: Sequence[str] = NUMERIC_FEATURES,
    bins: int = PSI_BINS,
    threshold: float = PSI_THRESHOLD,
) -> DataFrame:
    """Population stability index per numeric feature.

    Bin edges are the distinct training quantiles; evaluated values outside them are not
    binned (`out_of_range_count`).  A feature with fewer than `bins` values on either side
    is left out; one distinct edge gives 0.
    """
    features = [f for f in features if f in train.columns and f in evaluated.columns]
    if not features:
        raise ValueError("no common numeric features")
    probs = [i / bins for i in range(bins + 1)]
    spread = quantiles(train, {f: F.col(f).try_cast("double") for f in features}, probs)
    tags = [f"p{p * 100:g}".replace(".", "_") for p in probs]
    edges = spread.select(*[F.array_distinct(F.array(*[f"{f}_{t}" for t in tags])).alias(f) for f in features])

    sides = [df.select(*features, F.lit(name).alias("side")) for df, name in ((train, "train"), (evaluated, "eval"))]
    rows = [
        F.struct(F.lit(f).alias("feature"), F.col(f).try_cast("double").alias("v"), F.col(f"_edges.{f}").alias("e"))
        for f in features
    ]
    both = with_fact(sides[0].unionByName(sides[1]), edges, "_edges").select("side", F.inline(F.array(*rows)))
    both = both.filter(F.col("v").isNotNull())
    last = F.size("e") - 1
    at = F.size(F.filter("e", lambda x: x <= F.col("v"))) - 1
    inside = (F.col("v") >= F.element_at("e", 1)) & (F.col("v") <= F.element_at("e", -1)) & (last >= 1)
    bin_of = F.when(inside, F.least(at, last - 1)).otherwise(-1)
    counts = both.groupBy("feature", F.size("e").alias("n_edges"), bin_of.alias("bin")).agg(
        F.count_if(F.col("side") == "train").alias("t"), F.count_if(F.col("side") == "eval").alias("v")
    )
    rows = counts.groupBy("feature", "n_edges").agg(
        F.collect_list(F.when(F.col("bin") >= 0, F.struct("t", "v"))).alias("bins"),
        F.sum("t").alias("train_rows"),
        F.sum("v").alias("eval_rows"),
        F.sum(F.when(F.col("bin") >= 0, F.col("t"))).alias("tn"),
        F.sum(F.when(F.col("bin") >= 0, F.col("v"))).alias("vn"),
    )
    # Bins nobody falls into contribute epsilon against epsilon: nothing.
    def term(b: Column) -> Column:
        p = F.greatest(b["t"] / F.greatest(F.col("tn"), F.lit(1)), F.lit(PSI_EPSILON))
        q = F.greatest(b["v"] / F.greatest(F.col("vn"), F.lit(1)), F.lit(PSI_EPSILON))
        return (q - p) * F.log(q / p)

    value = F.when(F.col("n_edges") < 2, 0.0).otherwise(
        F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + term(b))
    )
    rows = rows.filter((F.col("train_rows") >= bins) & (F.col("eval_rows") >= bins))
    return rows.select(
        "feature",
        value.alias("psi_value"),
        (value > threshold).alias("flagged"),
        "train_rows",
        "eval_rows",
        F.when(F.col("n_edges") < 2, 0)
        .otherwise(F.col("eval_rows") - F.coalesce("vn", F.lit(0)))
        .cast("bigint")
        .alias("out_of_range_count"),
    )


def degradation(scored: DataFrame, baseline: DataFrame, actual: str = "actual", factor: float = DEGRADATION_FACTOR) -> DataFrame:
    """Pinball loss per quantile against a baseline table (quantile, pinball_loss)."""
    losses = quantile_losses(scored, actual)
    rows = losses.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(q).alias("quantile"), F.lit(a).alias("alpha"), F.col(f"{q}_pinball").alias("eval_pinball"))
                    for q, a in QUANTILES.items()
                ]
            )
        )
    )
    out = rows.join(baseline.select("quantile", F.col("pinball_loss").alias("baseline_pinball")), "quantile", "left")
    ratio = F.when(F.col("baseline_pinball") > 0, F.col("eval_pinball") / F.col("baseline_pinball"))
    return out.withColumns(
        {"degradation_ratio": ratio, "flagged": F.coalesce(ratio > F.lit(float(factor)), F.lit(False))}
    )


def drift_report(psi_rows: DataFrame, degradations: DataFrame) -> DataFrame:
    """One row: flagged features and quantiles, and whether anything drifted."""
    flags = psi_rows.select(F.lit("psi").alias("kind"), F.col("feature").alias("name"), "flagged").unionByName(
        degradations.select(F.lit("metric").alias("kind"), F.col("quantile").alias("name"), "flagged")
    )

    def flagged(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & F.col("flagged"), F.col("name"))))

    return flags.agg(
        F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("overall_drift_detected"),
        flagged("psi").alias("psi_features_flagged"),
        flagged("metric").alias("metrics_flagged"),
        F.count_if(F.col("kind") == "psi").alias("features_checked"),
        F.count_if(F.col("kind") == "metric").alias("metrics_checked"),
    )


# --------------------------------------------------------------------------- ensembles


def member_losses(members: DataFrame, actuals: DataFrame) -> DataFrame:
    """Mean pinball loss per member (model, job_id, p10, p50, p90) over its three quantiles."""
    both = members.join(actuals.select("job_id", F.col("actual_sec").cast("double").alias("y")), "job_id")
    total = sum(
        (pinball(F.col("y"), F.col(q), a) for q, a in list(QUANTILES.items())[1:]), pinball(F.col("y"), F.col("p10"), 0.1)
    )
    return both.groupBy("model").agg(F.avg(total / F.lit(float(len(QUANTILES)))).alias("pinball_loss"))


def ensemble(members: DataFrame, losses: DataFrame, floor_sec: float = 1.0) -> DataFrame:
    """Predictions of several models combined with inverse-loss weights, floored and sorted."""
    inverse = losses.select("model", (1.0 / F.greatest("pinball_loss", F.lit(1e-6))).alias("w"))
    # Models are few: their weights travel as one map, not as a join on a two-valued key.
    weights = inverse.agg(F.map_from_entries(F.collect_list(F.struct("model", "w"))).alias("m")).select("m").scalar()
    total = inverse.agg(F.sum("w").alias("t")).scalar()
    weighted = members.withColumn("_w", F.element_at(weights, F.col("model")) / total)
    summed = weighted.groupBy("job_id").agg(*[F.sum(F.col("_w") * F.col(q)).alias(q) for q in QUANTILES])
    ordered = in_order(*[F.greatest(F.col(q), F.lit(floor_sec)) for q in QUANTILES])
    return summed.select("job_id", ordered.alias("_q")).select(
        "job_id", *[F.col("_q")[i].alias(q) for i, q in enumerate(QUANTILES)]
    )


# --------------------------------------------------------------------------- model documentation


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean, median and null share per column, one row per column."""
    cols = {c: F.col(c).try_cast("double") for c in columns}
    base = df.agg(
        F.count("*").alias("_rows"),
        *[f(e).alias(f"{n}_{k}") for k, e in cols.items() for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        *[F.count(e).alias(f"n_{k}") for k, e in cols.items()],
    )
    both = side_by_side([base, quantiles(df, cols, [0.5])], [])
    rows = [
        F.struct(
            F.lit(k).alias("column"),
            F.col(f"min_{k}").alias("min"),
            F.col(f"max_{k}").alias("max"),
            F.col(f"mean_{k}").alias("mean"),
            F.col(f"{k}_p50").alias("median"),
            ((F.col("_rows") - F.col(f"n_{k}")) / F.col("_rows")).alias("null_pct"),
        )
        for k in cols
    ]
    return both.select(F.inline(F.array(*rows))).filter(F.col("mean").isNotNull())


def group_fairness(df: DataFrame, key: str, target: str = "runtime_actual_sec", min_rows: int = 10) -> DataFrame:
    """Spread of the mean target over groups of at least `min_rows`, and the number of groups."""
    require(df, {key, target}, "group fairness")
    groups = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("group")).agg(
        F.avg(F.col(target).cast("double")).alias("mean"), F.count(target).alias("rows")
    )
    big = F.when(F.col("rows") >= min_rows, F.col("mean"))
    return groups.agg(
        F.count("*").alias("unique_values"),
        F.min(big).alias("mean_min"),
        F.max(big).alias("mean_max"),
        F.stddev_samp(big).alias("std_across_groups"),
    )


def top_groups(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The `n` most frequent values of a column; ties by value."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("group")).agg(
        F.count("*").alias("rows")
    )
    return counts.orderBy(F.desc("rows"), "group").limit(n)


def model_card(
    losses: DataFrame, dataset: DataFrame, columns: Sequence[str], group_columns: Sequence[str], target: str = "runtime_actual_sec"
) -> DataFrame:
    """Losses, column statistics and group spreads as one nested row."""
    stats = column_stats(dataset, columns)
    packed = stats.agg(F.sort_array(F.collect_list(F.struct(*stats.columns))).alias("s")).select("s").scalar()
    groups = [fact(group_fairness(dataset, g, target)).alias(f"fairness_{g}") for g in group_columns]
    return losses.select(F.struct("*").alias("performance"), packed.alias("dataset_columns"), *groups)
