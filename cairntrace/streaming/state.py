"""Stream operators with a state of their own, which timers on the event time advance.

Rows wait until the watermark has passed them, so that rows which arrive out of order, but within the
lateness, count where they belong.  States live in RocksDB beside the checkpoint: they may be larger
than memory, a batch reads only the keys it touches, and a stream whose state is gone fails to start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets that the keys of trailing counts are dealt to.
BUCKETS = 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """States of streams started from now on live in RocksDB."""
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


def timed(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    """`events` whose second `ts` advances the watermark.

    The watermark's own column is left out again: Spark would drop late rows by it, while the
    processors here count them."""
    marked = events.withColumn("_at", F.timestamp_seconds(ts)).withWatermark("_at", lateness)
    return marked.select(*events.columns)


class Waiting:
    """Sums per second that wait for the watermark: a state of sorted seconds with their values."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, values: int) -> None:
        self.state = handle.getValueState(name, ", ".join(["ts binary", *[f"v{i} binary" for i in range(values)]]))
        self.values = values

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Seconds, and per second a row of values."""
        if not self.state.exists():
            return np.zeros(0, np.int64), np.zeros((0, self.values), np.int64)
        ts, *columns = (np.frombuffer(bytes(raw), np.int64) for raw in self.state.get())
        return ts, np.stack(columns, 1)

    def write(self, ts: np.ndarray, values: np.ndarray) -> None:
        if len(ts):
            self.state.update((ts.tobytes(), *[np.ascontiguousarray(c).tobytes() for c in values.T]))
        else:
            self.state.clear()

    def add(self, ts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Add values at these seconds; returns all that wait."""
        old_ts, old = self.read()
        all_ts, which = np.unique(np.concatenate([old_ts, ts]), return_inverse=True)
        total = np.zeros((len(all_ts), self.values), np.int64)
        np.add.at(total, which, np.concatenate([old, values]))
        self.write(all_ts, total)
        return all_ts


def _stacked(rows: Iterable[pd.DataFrame], names: list[str]) -> np.ndarray:
    parts = [frame[names].to_numpy(dtype=np.int64) for frame in rows]
    return np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int64)


def summed(events: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Values summed per key and second inside each batch of a task, before they are shuffled: a busy key
    costs at most a row per second of a task's batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([*keys, ts], as_index=False, dropna=False)[values].sum()[[*keys, ts, *values]]

    slim = events.select(*keys, ts, *values)
    return slim.mapInPandas(run, slim.schema)


class QueueDepth(StatefulProcessor):
    """Depth of one queue: the changes of each second wait for the watermark, then move the carried depth."""

    OUTPUT = "queue_id string, ts long, queue_len_jobs long, queue_len_cpu_demand long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", "ts long, jobs long, cpus long")
        self.waiting = Waiting(handle, "waiting", 2)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        moves = _stacked(rows, ["ts", "dj", "dc"])
        ts = moves[:, 0]
        if self.carry.exists():
            # that second has been told: what comes later for it, or before it, counts from the next one on
            ts = np.maximum(ts, self.carry.get()[0] + 1)
        waiting = self.waiting.add(ts, moves[:, 1:])
        if len(waiting):
            self.handle.registerTimer(int(waiting[0]) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // 1000
        ts, moves = self.waiting.read()
        n = int(np.searchsorted(ts, upto, side="right"))
        if n:
            start = np.array(self.carry.get()[1:] if self.carry.exists() else (0, 0), np.int64)
            sums = start + np.cumsum(moves[:n], axis=0)
            # a depth never goes below zero: what would have been missing so far is added
            depth = sums - np.minimum(np.minimum.accumulate(sums, axis=0), 0)
            self.carry.update((int(ts[n - 1]), int(depth[-1, 0]), int(depth[-1, 1])))
            self.waiting.write(ts[n:], moves[n:])
            yield pd.DataFrame(
                {"queue_id": key[0], "ts": ts[:n], "queue_len_jobs": depth[:, 0], "queue_len_cpu_demand": depth[:, 1]}
            )
        if n < len(ts):
            self.handle.registerTimer(int(ts[n]) * 1000)

    def close(self) -> None:
        pass


def live_queue(events: DataFrame, lateness: str) -> DataFrame:
    """Depth per (queue, second with a change), of a stream of changes (queue_id, ts, dj, dc).

    A second is told once, when the watermark (the latest second less `lateness`) has passed it.  Changes
    that come later still are not lost: they count from the second after the one last told."""
    keep_state_on_disk(events.sparkSession)
    moves = summed(timed(events, "ts", lateness), ["queue_id"], "ts", ["dj", "dc"])
    return moves.groupBy("queue_id").transformWithStateInPandas(QueueDepth(), QueueDepth.OUTPUT, "Append", "EventTime")


class TrailingCounts(StatefulProcessor):
    """Requests of one bucket of keys in one stretch of time as long as the window, and those of the stretch before it.

    The state is a list of chunks, one per batch and bucket: a batch appends to it and reads nothing."""

    def __init__(self, window_sec: int, limit: int) -> None:
        self.window, self.limit = window_sec, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["name", "ts", "n", "own"]] for f in rows], ignore_index=True)
        batch = pa.RecordBatch.from_pandas(frame, REQUESTS, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, REQUESTS) as out:
            out.write_batch(batch)
        self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(key[1]) + 1) * self.window * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunks = [pa.ipc.open_stream(bytes(raw)).read_all() for (raw,) in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if chunks:
            told = trailing(pa.concat_tables(chunks), self.window)
            yield told.assign(over_limit=told["in_window"] > self.limit)

    def close(self) -> None:
        pass


#: Requests of a second that wait: the key as text, the second, how many there are, and how many of them count here.
REQUESTS = pa.schema([("name", pa.string()), ("ts", pa.int64()), ("n", pa.int64()), ("own", pa.int64())])


def trailing(requests: pa.Table, window: int) -> pd.DataFrame:
    """Per key and second with requests of its own: the requests of the key in the last `window` seconds."""
    code, names = pd.factorize(requests["name"].to_pandas().astype(object), use_na_sentinel=False)
    ts, n, own = (requests[c].to_numpy() for c in ("ts", "n", "own"))
    # one number per key and second; keys lie further apart than the window is long
    first = ts.min()
    span = int(ts.max() - first) + window + 1
    at, which = np.unique(code * span + (ts - first), return_inverse=True)
    counts = np.zeros((len(at), 2), np.int64)
    np.add.at(counts, which, np.stack([n, own], 1))
    upto = np.concatenate([[0], np.cumsum(counts[:, 0])])
    told = np.flatnonzero(counts[:, 1])
    whose = at[told] // span
    low = np.searchsorted(at, np.maximum(at[told] - window, whose * span - 1), side="right")
    return pd.DataFrame(
        {"name": names[whose], "ts": at[told] - whose * span + first, "in_window": upto[told + 1] - upto[low]}
    )


def live_counts(log: DataFrame, lateness: str, window_sec: int = 60, limit: int = 10, key: str = "key") -> DataFrame:
    """`sliding.sliding_counts` of a stream of requests (key, ts): per (key, second) the requests of the last
    `window_sec` seconds, whether they arrived in order or not.

    Time is cut into stretches as long as the window.  A request goes to its own stretch, where it is counted, and to
    the next one, whose requests still see it; so a key's requests are spread over the stretches, and a state lasts until the
    watermark has passed its stretch.  Keys share the states of BUCKETS buckets: there are as many states as buckets and
    stretches, however many keys.  Requests of a stretch that is over by more than `lateness` are counted among
    themselves only."""
    keep_state_on_disk(log.sparkSession)
    stretch = F.floor(F.col("ts") / F.lit(window_sec)).cast("long")
    kind = dict(log.dtypes)[key]
    binary = kind == "binary"

    def to(k: int, own: int):
        return F.struct((stretch + k).alias("stretch"), F.lit(1).cast("long").alias("n"), F.lit(own).cast("long").alias("own"))

    # keys travel as text, which keeps a null apart and long numbers whole
    name = F.hex(F.col(key)) if binary else F.col(key).cast("string")
    requests = timed(log.select(name.alias("name"), F.col("ts").cast("long").alias("ts")), "ts", lateness)
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).alias("bucket")
    dealt = requests.select("name", bucket, "ts", F.inline(F.array(to(0, 1), to(1, 0))))
    counted = summed(dealt, ["name", "bucket", "stretch"], "ts", ["n", "own"])
    told = counted.groupBy("bucket", "stretch").transformWithStateInPandas(
        TrailingCounts(window_sec, limit), "name string, ts long, in_window long, over_limit boolean", "Append", "EventTime"
    )
    back = F.unhex("name") if binary else F.col("name").cast(kind)
    return told.select(back.alias("key"), "ts", "in_window", "over_limit")
