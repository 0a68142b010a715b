"""Periodic runs of words: recursive splitting by frequency, then a scan of lags in what survives.

A qualifying run of period q has at least LEAST_TIMES periods and LEAST_WORDS words, so each of its
words occurs at least LEAST_TIMES times inside any stretch that holds the run.  A word that occurs
less often inside its segment can't belong to one and splits the segment; the parts are counted
anew, until no word is too rare in its segment.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import steps

#: Periods and words that a run has at least.
LEAST_TIMES, LEAST_WORDS = 4, 6

Run = tuple[int, int, int]


def _parts(segment: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, as places in `at`, of the stretches of neighbouring words of one segment."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero((np.diff(at) > 1) | (np.diff(segment) != 0)) + 1
    return np.concatenate([[0], new]), np.concatenate([new, [len(at)]])


def surviving(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Segments [start, end) of `words` (numbers from 0 on) that no too rare word splits further.

    `bounds` are the starts of the documents, and the end.  Only segments that lost a word are
    counted again."""
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    done: list[tuple[int, int]] = []
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(at):
        starts, ends = _parts(segment, at)
        long = ends - starts >= LEAST_WORDS
        sizes = (ends - starts)[long]
        kept = np.repeat(long, ends - starts)
        at = at[kept]
        segment = np.repeat(np.arange(len(sizes)), sizes)
        key = segment * kinds + words[at]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        rare = times[which] < LEAST_TIMES
        lost = np.bincount(segment[rare], minlength=len(sizes)) > 0
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        for i in np.flatnonzero(~lost).tolist():
            start = int(at[first[i]])
            done.append((start, start + int(sizes[i])))
        again = lost[segment] & ~rare
        at, segment = at[again], segment[again]
    return sorted(done)


def _reach(words: np.ndarray, i: int, lag: int) -> int:
    """The first place from `i` on whose word differs from the one `lag` later (or where that ends)."""
    end, size = len(words) - lag, 64
    while i < end:
        stop = min(end, i + size)
        differs = np.flatnonzero(words[i:stop] != words[i + lag : stop + lag])
        if len(differs):
            return i + int(differs[0])
        i, size = stop, size * 2
    return end


def _back(words: np.ndarray, i: int, lag: int) -> int:
    """The first place of the stretch before `i` in which words equal those `lag` later."""
    size = 64
    while i > 0:
        start = max(0, i - size)
        differs = np.flatnonzero(words[start:i] != words[start + lag : i + lag])
        if len(differs):
            return start + int(differs[-1]) + 1
        i, size = start, size * 2
    return 0


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the words, and its powers, modulo 2^64.

    Equal stretches have equal sums; whether stretches of equal sums are equal is looked up."""
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(len(words) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(x * powers[:-1])])
    return sums, powers


def scan(words: np.ndarray) -> list[Run]:
    """All qualifying runs (start, length, period) of one segment.

    A run of period q has 3q words or more that equal those q later, and so three multiples of q
    among their places.  Per lag only the multiples are compared, n/q of them; where three in a row
    agree, and the two stretches from the first to the last of them have equal sums, the run's
    ends are found word by word.  Lags ascend, and a stretch that lies in a run of a divisor of the lag is
    that run again.
    """
    n = len(words)
    found: list[Run] = []
    known: list[tuple[int, int, int]] = []  # (length, start, period) of runs long enough for later lags
    sums, powers = _sums(words)
    for q in range(1, n // LEAST_TIMES + 1):
        least = max(LEAST_WORDS, LEAST_TIMES * q)
        while known and known[0][0] < least:
            heapq.heappop(known)
        multiples = words[::q]
        equal = multiples[1:] == multiples[:-1]
        three = equal[:-2] & equal[1:-1] & equal[2:]
        k = np.flatnonzero(three)
        if not len(k):
            continue
        a = k * q
        size = 2 * q + 1
        same = (sums[a + size] - sums[a]) * powers[q] == sums[a + q + size] - sums[a + q]
        a = a[same]
        for length, start, period in known:
            if len(a) and q % period == 0:
                a = a[(a < start) | (a + q > start + length)]
        after = -1
        for i in a.tolist():
            if i < after:
                continue
            end = _reach(words, i, q)
            start = _back(words, i, q)
            after = max(after, end)
            length = end + q - start
            if end > i and length >= least:
                found.append((start, length, q))
                heapq.heappush(known, (length, start, q))
    return found


def _extended(words: np.ndarray, h: int) -> np.ndarray:
    """The words of a document whose id has the hash `h`: of one in ten, the end repeats itself."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _dropped(runs: list[Run], n: int) -> np.ndarray:
    """Whether each of n words lies in a run after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def _report(pieces: list[bytes], words: np.ndarray, names: list[bytes], runs: list[Run]) -> tuple:
    runs.sort(key=lambda r: (r[0], r[2]))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    if not runs:
        kept = pieces
    else:
        kept = [names[w] for w in words[~_dropped(runs, len(words))].tolist()]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
        [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],
    )


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
_KINDS = (*[pa.int64()] * 5, pa.string(), pa.string(), _RUNS)


def reports(texts: list[bytes], hashes: list[int] | None = None) -> list[tuple]:
    """The reported values (COLUMNS) of each text; with `hashes`, of its words after their extension."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for w in chain.from_iterable(split)]
    names = list(number)
    sizes = np.array([len(s) for s in split], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = np.array(flat, np.int64)
    changed = np.zeros(len(texts), bool)
    for i, h in enumerate(hashes or ()):
        if h % 10 == 0 and sizes[i]:
            words[bounds[i] : bounds[i + 1]] = _extended(words[bounds[i] : bounds[i + 1]], h)
            changed[i] = True
    runs: dict[int, list[Run]] = {}
    for start, end in surviving(words, bounds):
        doc = int(np.searchsorted(bounds, start, side="right")) - 1
        shift = start - int(bounds[doc])
        runs.setdefault(doc, []).extend((shift + s, length, q) for s, length, q in scan(words[start:end]))
    out = []
    for i, pieces in enumerate(split):
        own = words[bounds[i] : bounds[i + 1]]
        if changed[i]:
            pieces = [names[w] for w in own.tolist()]
        out.append(_report(pieces, own, names, runs.get(i, [])))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extend: bool = False) -> DataFrame:
    """One row per row of `docs`: the id and COLUMNS, `runs` holding every run by start, then period.

    Words are separated by ASCII white space; null and empty texts have none and no run.  Repeated
    rows are reported alike; other columns, whatever their names, are not read.  With `extend`, the
    words of documents whose id's crc32 is a multiple of ten go on periodically from a place told by
    it (a null id counts as the empty text).  Texts are read whole; a task holds the texts of a step,
    and a longer one alone.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            found = reports(texts, batch.column(2).to_pylist() if extend else None)
            values = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_KINDS)]
            yield pa.record_batch([batch.column(0), *values], ["id", *COLUMNS])

    longs = ", ".join(f"{c} long" for c in COLUMNS[:5])
    schema = f"id {id_type}, {longs}, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
