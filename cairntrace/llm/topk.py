"""Exact top-k by integer inner product: score histograms locate each k-th score, then a filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairntrace.llm.common import written

#: Rows of a block of candidates and of queries: what a task scores at once.
CANDIDATE_ROWS, QUERY_ROWS = 8192, 256
#: A round divides the range that holds a query's k-th score into 2^BIN_BITS bins.
BIN_BITS = 12
#: Larger scaled components and larger scores count as this: the difference of two scores must be a long.
LARGEST = 2**62 - 1


def quantised(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, x as double; null where the vector is null or empty or
    holds a null or non-finite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    most = F.lit(LARGEST).cast("long")

    def whole(c: Column) -> Column:
        scaled = c * F.lit(float(factor))
        return F.when(scaled >= float(LARGEST), most).when(scaled <= -float(LARGEST), -most).otherwise(F.floor(scaled).cast("long"))

    return F.when((F.size(vector) > 0) & ~bad, F.transform(x, whole))


def _blocks(rows: DataFrame, each: int, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (part, id, v, extra longs...) packed into blocks of at most `each` rows of one part and length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple]] = {}

        def block(key: tuple[int, int]) -> pd.DataFrame:
            columns = list(zip(*held.pop(key), strict=True))
            out = {"part": [key[0]], f"{prefix}dim": [key[1]]}
            v = np.stack(columns[0])
            small = np.abs(v).max() < 2**31
            out[f"{prefix}v"] = [v.astype("<i4" if small else "<i8").tobytes()]
            for name, values in zip(("id", *extra), columns[1:], strict=True):
                out[prefix + name] = [np.array(values, "<i8").tobytes()]
            return pd.DataFrame(out)

        for frame in frames:
            for part, v, *longs in frame[["part", "v", "id", *extra]].itertuples(index=False):
                key = (part, len(v))
                held.setdefault(key, []).append((v, *longs))
                if len(held[key]) == each:
                    yield block(key)
        for key in list(held):
            yield block(key)

    longs = "".join(f", {prefix}{name} binary" for name in ("id", *extra))
    return rows.mapInPandas(run, f"part long, {prefix}dim long, {prefix}v binary{longs}")


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _rows(raw: bytes, ids: bytes, dim: int) -> np.ndarray:
    """A block's vectors, which have four bytes a component, or eight if one needs them."""
    kind = "<i4" if len(raw) == len(ids) // 8 * dim * 4 else "<i8"
    return np.frombuffer(raw, kind).reshape(-1, dim)


def _scores(row) -> np.ndarray:
    """The exact scores of a block of queries (rows) and one of candidates (columns), up to LARGEST either way."""
    q, c = _rows(row.q_v, row.q_id, row.q_dim), _rows(row.c_v, row.c_id, row.q_dim)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * row.q_dim
    # Sums of products of doubles are exact while they stay below 2^53.
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    # Wide ones: in whole numbers of any size, for the rows and columns that need it.
    wide_q, wide_c = (np.abs(x).max(axis=1).astype(np.float64) for x in (q, c))
    exact = np.outer(wide_q, wide_c) * row.q_dim < 2.0**62
    with np.errstate(over="ignore"):
        out = q.astype(np.int64) @ c.astype(np.int64).T
    objects_q, objects_c = q.astype(object), c.astype(object)
    for i, j in zip(*np.nonzero(~exact), strict=True):
        out[i, j] = max(-LARGEST, min(LARGEST, int(np.dot(objects_q[i], objects_c[j]))))
    return out


def _histogram(pairs: DataFrame, shift: int, bits: int) -> DataFrame:
    """(query_id, lo, need, bin, n): how many scores of each query fall into each of the 2^bits bins
    of width 2^shift from `lo` on.

    Of a block only the top bins count, down to the one in which `need` scores are reached:
    the wanted score of all blocks together cannot lie lower."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                score, c_id = _scores(row), _longs(row.c_id)
                out = []
                for q, lo, need, s in zip(_longs(row.q_id), _longs(row.q_lo), _longs(row.q_need), score, strict=True):
                    bins = (s - lo) >> shift
                    bins = bins[(bins >= 0) & (bins < 1 << bits) & (c_id != q)]
                    n = np.bincount(bins)
                    some = np.flatnonzero(n)[::-1]
                    counts = n[some]
                    top = np.cumsum(counts) - counts < need
                    out += [(q, lo, need, b, m) for b, m in zip(some[top].tolist(), counts[top].tolist(), strict=True)]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "lo", "need", "bin", "n"])

    counts = pairs.mapInPandas(run, "query_id long, lo long, need long, bin long, n long")
    return counts.groupBy("query_id", "lo", "need", "bin").agg(F.sum("n").alias("n"))


def _narrowed(histogram: DataFrame, shift: int) -> DataFrame:
    """(id, lo, need): the bin that holds each query's wanted score, and its rank among the scores of that bin."""
    one = Window.partitionBy("query_id")
    down = one.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.select(
        "*", F.sum("n").over(down).alias("sum"), F.least("need", F.sum("n").over(one)).alias("wanted")
    )
    return running.where("sum >= wanted AND sum - n < wanted").select(
        F.col("query_id").alias("id"),
        (F.col("lo") + F.shiftleft("bin", shift)).alias("lo"),
        (F.col("wanted") - F.col("sum") + F.col("n")).alias("need"),
    )


def _selected(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of the scores above each query's `lo`, and of those equal to it the
    `need` smallest ids of each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                score, c_id = _scores(row), _longs(row.c_id)
                for q, lo, need, s in zip(_longs(row.q_id), _longs(row.q_lo), _longs(row.q_need), score, strict=True):
                    others = c_id != q
                    above = np.flatnonzero((s > lo) & others)
                    ties = np.flatnonzero((s == lo) & others)
                    ties = ties[np.argsort(c_id[ties], kind="stable")][:need]
                    at = np.concatenate([above, ties])
                    if len(at):
                        yield pd.DataFrame({"query_id": np.full(len(at), q), "vec_id": c_id[at], "score": s[at]})

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    k: int = 10,
    factor: int = 1024,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest scores of each query.

    Queries are the ids divisible by `every`; candidates are all rows but those with the
    query's own id.  Scores are inner products of floor(factor * x); ties go to the smaller
    id.  Rows with a null id, a null or empty vector, or a null or non-finite component take no part.
    Scaled components and scores beyond 2^62 - 1 either way count as that.  Candidates of another length than the query's
    are not compared with it.  Each repeated row is a candidate; rows that repeat a query's
    id are one query, its smallest vector.  A query without candidates gives no rows.

    Candidates are written once as blocks; each round joins the query blocks with the
    candidate blocks of every part, so neither side is held whole anywhere.
    """
    v = quantised(F.col(vector_col), factor)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = written(rows.where("v IS NOT NULL"), "vectors")
    facts = rows.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"),
    ).first()
    parts = max(1, -(-facts["n"] // candidate_rows))
    # By Cauchy-Schwarz no score exceeds the largest squared norm, which is rounded up.
    bound = min(LARGEST, int((facts["norm"] or 0) * (1 + 1e-9)) + 1)
    shift = max(0, (2 * bound + 1).bit_length() - BIN_BITS)

    salted = rows.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)))
    candidates = written(_blocks(salted.repartition(min(parts, 4096), "part"), candidate_rows, "c_"), "blocks")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    state = queries.select("id", F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))

    def pairs(state: DataFrame) -> DataFrame:
        asked = queries.join(state, "id").withColumn("part", F.lit(0).cast("long"))
        blocks = _blocks(asked, QUERY_ROWS, "q_", ("lo", "need")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
        )
        same = F.col("q_dim") == F.col("c_dim")
        return blocks.join(candidates, "part").where(same)

    bits = (2 * bound + 1).bit_length() - shift
    while True:
        state = written(_narrowed(_histogram(pairs(state), shift, bits), shift), "ranges")
        if not shift:
            break
        bits = min(shift, BIN_BITS)
        shift -= bits
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = _selected(pairs(state)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
