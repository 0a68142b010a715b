"""Sparse rule ensembles: tree paths as conjunctions, lasso weights, one Spark expression."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Conjunction = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    features: tuple[str, ...]
    rules: tuple[tuple[Conjunction, float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(conjunction(rule, self.features), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def texts(self) -> list[str]:
        return [
            " and ".join(f"{self.features[f]} {'<=' if low else '>'} {cut:.6g}" for f, low, cut in rule) + f": {w:+.4f}"
            for rule, w in self.rules
        ]


def conjunction(rule: Conjunction, features: Sequence[str]) -> Column:
    out = F.lit(True)
    for f, low, cut in rule:
        value = F.col(features[f])
        out = out & (value <= F.lit(cut) if low else value > F.lit(cut))
    return out


def _simplified(path: Sequence[tuple[int, bool, float]]) -> Conjunction:
    """One bound per feature and side: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for f, low, cut in path:
        old = tight.get((f, low))
        tight[f, low] = cut if old is None else (min if low else max)(old, cut)
    return tuple(sorted((f, low, cut) for (f, low), cut in tight.items()))


def tree_paths(described: str) -> list[Conjunction]:
    """The conjunctions on the ways from the root to every inner node's branches and leaves.

    `described` is a tree model's `toDebugString`, whose depth is its indentation."""
    out: list[Conjunction] = []
    stack: list[tuple[int, tuple[int, bool, float]]] = []
    for line in described.splitlines():
        found = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (int(found[3]), found[4] == "<=", float(found[5]))))
        out.append(_simplified([c for _, c in stack]))
    return out


def fit(
    rows: DataFrame,
    features: Sequence[str],
    trees: int = 24,
    depth: int = 3,
    most_rules: int = 160,
    penalty: float = 0.004,
    seed: int = 7,
) -> RuleEnsemble:
    """Fit on a bounded table (columns `features`, y in 0/1); y = 1 gets the higher scores.

    Trees are grown by a random forest; rules that few rows or nearly all rows satisfy carry
    the least, so of the distinct conjunctions the `most_rules` most balanced ones enter the
    lasso, which zeroes most weights.  Rows with a null take no part.  With rows of one class
    only, or none, the ensemble is a constant: the share of y = 1 (one half without rows).
    """
    table = rows.select(*features, F.col("y").cast("double").alias("y")).dropna()
    counts = {r["y"]: r["count"] for r in table.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = {0.0: 0.001, 1.0: 0.999}.get(next(iter(counts), None), 0.5)
        return RuleEnsemble(tuple(features), (), math.log(share / (1 - share)))
    # Few documents are of low quality: both classes weigh the same when trees are grown.
    total = sum(counts.values())
    weight = F.when(F.col("y") == 0, total / counts[0.0]).otherwise(total / counts[1.0])
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(table.withColumn("w", weight))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, maxBins=48, seed=seed,
        minInstancesPerNode=10, subsamplingRate=0.7, featureSubsetStrategy="onethird",
    ).fit(data)
    found = sorted({path for tree in forest.trees for path in tree_paths(tree.toDebugString)})
    if not found:
        share = counts[1.0] / total
        return RuleEnsemble(tuple(features), (), math.log(share / (1 - share)))
    held = table.agg(*[F.avg(conjunction(r, features).cast("double")).alias(f"r{i}") for i, r in enumerate(found)]).first()
    chosen = sorted(range(len(found)), key=lambda i: (abs(held[i] - 0.5), i))[:most_rules]
    rules = [found[i] for i in sorted(chosen)]
    matrix = table.select(
        "y", array_to_vector(F.array(*[conjunction(r, features).cast("double") for r in rules])).alias("x")
    )
    model = LogisticRegression(
        featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60
    ).fit(matrix)
    weights = model.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6)
    return RuleEnsemble(tuple(features), kept, float(model.intercept))
