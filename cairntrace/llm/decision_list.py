"""Decision lists by sequential covering: threshold conjunctions learned with Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the labelled rows that rules are grown on; the rest prunes them.
GROW_SHARE = 2 / 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def column(self) -> Column:
        return _all(self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" ({self.right} right, {self.wrong} wrong when pruned)"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: tuple[Rule, ...]

    def kept(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.column(), F.lit(False)).otherwise(out)
        return out

    def rule_number(self) -> Column:
        """Place of the first rule that covers a row, from 1; 0 if none does."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(i)).otherwise(out)
        return out


def _all(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _cuts(rows: DataFrame, features: Sequence[str], cuts: int) -> dict[str, list[float]]:
    shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
    # Quantiles within each class, so that a class with few rows has its own cut points.
    found = rows.groupBy("y").agg(*[F.percentile_approx(f, shares, 10000).alias(f) for f in features]).collect()
    return {f: sorted({float(v) for r in found for v in (r[f] or [])}) for f in features}


def _gains(rows: DataFrame, features: Sequence[str], cuts: dict[str, list[float]]) -> list[tuple[str, int, int, int]]:
    """(feature, number of cuts below the value, rows to reject, rows to keep) of the rows given."""

    def bin_of(feature: str) -> Column:
        points = F.array(*[F.lit(c) for c in cuts[feature]])
        return F.size(F.filter(points, lambda c: F.col(feature) > c))

    places = [F.struct(F.lit(i).alias("f"), bin_of(f).alias("b")) for i, f in enumerate(features) if cuts[f]]
    if not places:
        return []
    long = rows.select("y", F.explode(F.array(*places)).alias("x"))
    counts = long.groupBy("x.f", "x.b").agg(
        F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, 0).otherwise(1)).alias("n")
    )
    return [(features[r["f"]], r["b"], r["p"], r["n"]) for r in counts.collect()]


def _best(counts, cuts: dict[str, list[float]], least: int) -> tuple[Condition, int, int] | None:
    """The condition with the largest information gain; ties go to the first in (feature, cut, side)."""
    total_p = total_n = 0
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for f, b, p, n in counts:
        by.setdefault(f, {})[b] = (p, n)
    if not by:
        return None
    total_p, total_n = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
    if not total_p:
        return None
    before = math.log2(total_p / (total_p + total_n))
    best = None
    for f in sorted(by):
        low_p = low_n = 0
        for i, cut in enumerate(cuts[f]):
            # a row of bin b has exactly the first b cuts below its value
            p, n = by[f].get(i, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, (cp, cn) in ((False, (low_p, low_n)), (True, (total_p - low_p, total_n - low_n))):
                if cp < least or cp + cn == total_p + total_n:
                    continue
                gain = cp * (math.log2(cp / (cp + cn)) - before)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(f, above, cut), cp, cn)
    return best and best[1:]


def learn(
    rows: DataFrame,
    features: Sequence[str],
    key: str = "doc_id",
    cuts: int = 24,
    most_rules: int = 10,
    most_conditions: int = 4,
    precision: float = 0.95,
    least: int = 8,
) -> DecisionList:
    """Learn rules for y = 0 from a bounded table of labelled statistics (columns `features`, y, key).

    Each rule is grown, condition by condition, by information gain on two thirds of the rows
    that earlier rules leave, then cut back to the prefix that does best on the other third;
    it is accepted while its precision there is at least `precision`.  Every count is one
    Spark aggregate; the driver sees counts per (feature, bin) only.  Rows with a null
    statistic or label take no part; without rows of both classes the list is empty.
    """
    table = rows.select(
        *features, F.col("y"), (F.pmod(F.xxhash64(F.lit("grow"), F.col(key)), F.lit(3)) < round(3 * GROW_SHARE)).alias("grow")
    ).dropna()
    points = _cuts(table, features, cuts)
    rules: list[Rule] = []
    left = table
    while len(rules) < most_rules:
        conditions: list[Condition] = []
        while len(conditions) < most_conditions:
            found = _best(_gains(left.where(F.col("grow") & _all(conditions)), features, points), points, least)
            if not found:
                break
            condition, p, n = found
            conditions.append(condition)
            if n == 0:
                break
        if not conditions:
            break
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        sums = [
            F.sum(F.when(_all(c) & (F.col("y") == 0 if wanted else F.col("y") != 0), 1).otherwise(0)).alias(f"{name}{i}")
            for i, c in enumerate(prefixes)
            for name, wanted in (("p", True), ("n", False))
        ]
        seen = left.where(~F.col("grow")).agg(*sums).first()
        scored = [((seen[f"p{i}"] or 0), (seen[f"n{i}"] or 0), i) for i in range(len(prefixes))]
        p, n, i = max(scored, key=lambda s: ((s[0] - s[1]) / max(1, s[0] + s[1]), s[0], -s[2]))
        if p < max(1, least // 4) or p < precision * (p + n):
            break
        rule = Rule(tuple(prefixes[i]), p, n)
        rules.append(rule)
        left = left.where(~rule.column())
    return DecisionList(tuple(rules))
