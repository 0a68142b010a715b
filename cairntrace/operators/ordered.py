"""Running values over long orders, without sending an order to one task.

Every operator here works on *slices*: disjoint, contiguous pieces of a total
order, labelled `_slice` in increasing order.  Each slice is scanned by its own
window; one summary row per (slice, group) carries the state of all earlier
slices into it.  A group (a user, a snapshot, a whole trace) may span any number
of slices, so no group has to fit into one task.

Slices come from two places:

* `slice_by_range` for rows: Spark's range partitioner on a unique sort key, so
  slices are balanced whatever the key distribution.  The labelled rows are
  persisted because the partitioner samples: summary and scan must see the same
  boundaries.  `persist` keeps the lineage, and a lost block is rebuilt from the
  same shuffle with the same boundaries.
* `slice_by_time` for rows already aggregated to one per second: a fixed-width
  bucket holds at most `width` of them, and the label is a plain expression.

Order keys are plain ascending columns (negate a number to descend), nulls first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairntrace.session import settle

SLICE = "_slice"
TICK_WIDTH = 1 << 18
#: Rows that a slice of a range holds, about.
SLICE_ROWS = 1_000_000

_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist on executors and remember it for `release`."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


def release() -> None:
    """Drop every frame persisted by this module (call once results are written)."""
    while _held:
        _held.pop().unpersist()


def slice_by_range(df: DataFrame, keys: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """Label rows with contiguous, balanced slices of the order `keys` (which must be unique).

    The range partitioner samples, so a second run may cut elsewhere.  The rows are written before they are cut, since
    the partitioner reads them twice and their number tells how many slices they need: more than asked for if
    those would hold more than about SLICE_ROWS rows, for a task scans a slice at once.  The labelled rows are written
    once; every reader then sees the same slices, also after `release` or when executors are lost.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df)
    n = max(n, rows.count() // SLICE_ROWS + 1)
    return settle(rows.repartitionByRange(n, *keys).withColumn(SLICE, F.spark_partition_id().cast("bigint")))


def slice_by_time(ticks: DataFrame, ts: str = "ts", width: int = TICK_WIDTH) -> DataFrame:
    """Label one-row-per-second rows with their fixed-width time bucket (persisted: read twice)."""
    return hold(ticks.withColumn(SLICE, F.floor(F.col(ts) / F.lit(width)).cast("bigint")))


def _scan(groups: Sequence[str], order: Sequence[Column | str], upto: int = 0):
    return Window.partitionBy(SLICE, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)


def _earlier(groups: Sequence[str]):
    # One row per slice: at most the number of slices per group.
    keys = groups or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _whole(groups: Sequence[str]):
    return Window.partitionBy(*(groups or [F.lit(0)]))


def carry_in(rows: DataFrame, carry: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join per-(slice, group) state back; rows are already clustered by those keys after a scan."""
    return rows.join(carry, [SLICE, *groups])


def running(
    sliced: DataFrame,
    order: Sequence[Column | str],
    groups: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    grand: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running values of each group's order, across slices, with one carry join.

    sums      inclusive running totals (with `grand`, also the group total `<name>_all`)
    lasts     latest non-null value at or before the row
    previous  latest non-null value strictly before the row
    source    frame to summarise instead of `sliced` when that one is costlier to recompute
    """
    sums, lasts, previous = dict(sums or {}), dict(lasts or {}), dict(previous or {})
    latest = {**lasts, **previous}
    here, strictly = _scan(groups, order), _scan(groups, order, -1)
    key = F.struct(*[_plain(o).alias(f"k{i}") for i, o in enumerate(order)])
    summary = (source or sliced).groupBy(SLICE, *groups).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        # Latest value of the slice: the one at the greatest sort key.
        *[F.max_by(e, F.when(e.isNotNull(), key)).alias(n) for n, e in latest.items()],
    )
    carried = [F.coalesce(F.sum(n).over(_earlier(groups)), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carried += [F.last(n, ignorenulls=True).over(_earlier(groups)).alias(f"_c_{n}") for n in latest]
    if grand:
        carried += [F.sum(n).over(_whole(groups)).alias(f"{n}_all") for n in sums]
    carry = summary.select(SLICE, *groups, *carried)
    out = sliced.withColumns(
        {
            **{f"_r_{n}": F.coalesce(F.sum(e).over(here), F.lit(0)) for n, e in sums.items()},
            **{f"_r_{n}": F.last(e, ignorenulls=True).over(here) for n, e in lasts.items()},
            **{f"_r_{n}": F.last(e, ignorenulls=True).over(strictly) for n, e in previous.items()},
        }
    )
    out = carry_in(out, carry, groups)
    out = out.withColumns(
        {
            **{n: F.col(f"_r_{n}") + F.col(f"_c_{n}") for n in sums},
            **{n: F.coalesce(F.col(f"_r_{n}"), F.col(f"_c_{n}")) for n in latest},
        }
    )
    return out.drop(*[f"_{k}_{n}" for k in "rc" for n in [*sums, *latest]])


def running_sums(
    sliced: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column], groups: Sequence[str] = (), **kw
) -> DataFrame:
    """Inclusive running totals only; see `running`."""
    return running(sliced, order, groups, sums=sums, **kw)


def clamped_sums(
    sliced: DataFrame,
    order: Sequence[Column | str],
    deltas: Mapping[str, Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Running sums floored at zero after every row (a queue that cannot go negative).

    With S the plain running sum and M its running minimum, the floored state is
    S - min(0, M).  A slice is summarised by (total, lowest prefix) and those
    pairs compose, so earlier slices enter as one offset and one minimum.
    """
    here = _scan(groups, order)
    rows = sliced.withColumns({f"_s_{n}": F.sum(d).over(here) for n, d in deltas.items()})
    rows = rows.withColumns({f"_m_{n}": F.min(f"_s_{n}").over(here) for n in deltas})
    summary = rows.groupBy(SLICE, *groups).agg(
        *[F.sum(d).alias(f"_t_{n}") for n, d in deltas.items()],
        *[F.min(f"_s_{n}").alias(f"_l_{n}") for n in deltas],
    )
    before = summary.withColumns(
        {f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(_earlier(groups)), F.lit(0)) for n in deltas}
    )
    carry = before.select(
        SLICE,
        *groups,
        *[f"_o_{n}" for n in deltas],
        *[
            F.coalesce(F.min(F.col(f"_o_{n}") + F.col(f"_l_{n}")).over(_earlier(groups)), F.lit(0)).alias(f"_f_{n}")
            for n in deltas
        ],
    )
    out = carry_in(rows, carry, groups)
    state = {
        n: F.col(f"_o_{n}")
        + F.col(f"_s_{n}")
        - F.least(F.lit(0), F.col(f"_f_{n}"), F.col(f"_o_{n}") + F.col(f"_m_{n}"))
        for n in deltas
    }
    scratch = [f"_{k}_{n}" for n in deltas for k in ("s", "m", "o", "f")]
    return out.withColumns(state).drop(*scratch)


def _plain(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def row_index(sliced: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "row_idx") -> DataFrame:
    """Zero-based position of each row in its group's order."""
    out = running_sums(sliced, order, {name: F.lit(1).cast("bigint")}, groups, grand=True)
    return out.withColumn(name, F.col(name) - 1).withColumnRenamed(f"{name}_all", f"{name}_rows")
