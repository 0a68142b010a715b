"""Near-duplicate documents: an exact set-similarity join of word shingles, and its components.

Documents with equal sets are one class.  Four steps find the links between classes:

1. Classes with too many shingles of their own (in a fixed share of the hash range, counted over
   all documents) can link to nothing and leave.
2. The shingles of the remaining classes are counted exactly; each class keeps the rarest of its
   shingles, as many as a linked class must meet one of.
3. Each shingle's list is ordered by set size and cut into blocks that know their sizes, places
   and components; pairs of blocks that sizes or places rule out are skipped.
4. Lists first ask only for pairs with a leader.  What links to the same leader already has one
   component, so the answers of its similar sets are not asked for again; the last round
   asks for every pair that is still between components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import held, mixed, steps
from cairntrace.llm.common import NO_ID, written
from cairntrace.llm.repeats import _dealt

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Share of the hash range whose shingles are counted over all documents, in 256ths.
COUNTED = 96
#: Shingles of a shard.
SHARD = 1_000_000
#: Entries of a block of a list.
BLOCK = 64
#: Bits of a set's parities.
BITS = 1024
#: Rounds that ask for pairs with leaders only.
LEADERS = 2
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


class _Words:
    """Hashes of words, remembered by a worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = np.empty(0, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > REMEMBERED:
            self.__init__()
        which = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            found = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(found))
            made = b"".join([xxhash.xxh3_64_digest(w) for w in new])
            self.known.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            self.hashes = np.concatenate([self.hashes, np.frombuffer(made, ">u8").astype(np.uint64)])
            which[missing] = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        return self.hashes[which]


def shingles(texts: list[bytes], words_each: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other; and where each
    text's begin (with the end).  A text of fewer words is one shingle, one without words none."""
    split = [t.translate(_LOWER).split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    hashes = held("words", _Words).of(list(chain.from_iterable(split)))
    first = np.cumsum(counts) - counts
    total = len(hashes)
    rolled = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(words_each, np.uint64)])
    # Words beyond a short text's end do not enter its one shingle.
    owner = np.repeat(np.arange(len(texts)), counts)
    left = (first + counts)[owner] - np.arange(total) if total else np.empty(0, np.int64)
    for j in range(words_each):
        word = padded[j : j + total]
        rolled = np.where(left > j, rolled * _STEP[0] + (word ^ (word >> np.uint64(31))) * _STEP[1] + _STEP[2], rolled)
    rolled = mixed(rolled)
    place = np.arange(total) - first[owner] if total else left
    whole = (left >= words_each) | (place == 0)
    owner, rolled = owner[whole], rolled[whole]
    by = np.lexsort((rolled, owner))
    owner, rolled = owner[by], rolled[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (rolled[1:] != rolled[:-1])
    owner, rolled = owner[new], rolled[new]
    return rolled, np.searchsorted(owner, np.arange(len(texts) + 1))


def _signatures(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: mixed sums of its members, with its size."""
    out = np.zeros(len(ends) - 1, np.uint64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        starts = ends[:-1][some]
        sums = [np.add.reduceat(mixed(values ^ s), starts) for s in _STEP[:2]]
        out[some] = mixed(sums[0] + mixed(sums[1]) * _STEP[2] + np.diff(ends)[some].astype(np.uint64))
    return out


def _uid(step: int) -> int:
    """A number for a step of a task, the same if the task runs again."""
    return TaskContext.get().partitionId() << 24 | step


def _counted(rows: DataFrame, shards: int, words_each: int) -> DataFrame:
    """Per step of a task and shard: hashes in the counted range with the number of their document
    within the step; and once per step the documents (id, text hash, signature, size, counted shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, (batch, texts) in enumerate(steps(batches)):
            uid = _uid(step)
            values, ends = shingles(texts, words_each)
            names = _signatures(values, ends)
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(texts)), sizes)
            inside = (values >> np.uint64(56)) < np.uint64(COUNTED)
            per = np.bincount(owner[inside], minlength=len(texts))
            named = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th")]
            docs = np.stack([*named, names.view(np.int64), sizes, per])
            # copies within the step count once
            lead = np.zeros(len(texts), bool)
            lead[np.unique(names, return_index=True)[1]] = True
            use = inside & lead[owner]
            v, o = values[use], owner[use].astype("<u4")
            shard = ((v >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            out = []
            for k, at in _dealt(np.arange(len(v)), shard):
                out.append((k, uid, v[at].astype("<u4").tobytes(), o[at].tobytes(), None))
            out.append((step % shards, uid, b"", b"", docs.astype("<i8").tobytes()))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)],
                ["shard", "uid", "v", "o", "docs"],
            )

    return rows.mapInArrow(run, "shard long, uid long, v binary, o binary, docs binary")


_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _shared(packed: DataFrame) -> DataFrame:
    """Per step: (number of a document, how many of its hashes in a shard occur in another document)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(x, "<u4") for x in frame["v"]])
        o = [np.frombuffer(x, "<u4") for x in frame["o"]]
        row = np.repeat(np.arange(len(o)), [len(x) for x in o])
        o = np.concatenate(o)
        by = np.argsort(v, kind="stable")
        same = v[by][1:] == v[by][:-1]
        common = np.zeros(len(v), bool)
        common[by[1:][same]] = True
        common[by[:-1][same]] = True
        counts, uids = [], []
        for r, at in _dealt(np.flatnonzero(common), row[common]):
            number, n = np.unique(o[at], return_counts=True)
            uids.append(frame["uid"].iat[r])
            counts.append(np.stack([number, n]).astype("<u4").tobytes())
        docs = frame[frame["docs"].notna()]
        return pd.DataFrame(
            {
                "uid": [*uids, *docs["uid"]],
                "counts": [*counts, *[None] * len(docs)],
                "docs": [*[None] * len(counts), *docs["docs"]],
            }
        ).astype({"uid": "int64"})

    return packed.groupBy("shard").applyInPandas(run, "uid long, counts binary, docs binary")


def _classified(shared: DataFrame, percent: int) -> DataFrame:
    """(doc_id, th, sig, n, open): one row per document; `open` if it may link to another class."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs = np.concatenate([np.frombuffer(x, "<i8").reshape(5, -1) for x in frame["docs"].dropna()], axis=1)
        common = np.zeros(docs.shape[1], np.int64)
        for x in frame["counts"].dropna():
            number, n = np.frombuffer(x, "<u4").reshape(2, -1)
            common[number] += n
        ids, hashes, names, sizes, per = docs
        # what only this document holds cannot be more than a link leaves out
        may = (sizes > 0) & (100 * (per - common) <= (100 - percent) * sizes)
        return pd.DataFrame({"doc_id": ids, "th": hashes, "sig": names, "n": sizes, "open": may})

    return shared.groupBy("uid").applyInPandas(run, "doc_id long, th long, sig long, n long, open boolean")


def _sets_of(texts: DataFrame, words_each: int) -> DataFrame:
    """(sig, n, v): the sets of those texts that have the expected name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            values, ends = shingles(texts, words_each)
            names = _signatures(values, ends).view(np.int64)
            right = np.flatnonzero(names == batch.column(0).to_numpy(zero_copy_only=False))
            raw = [values[a:b].tobytes() for a, b in zip(ends[right].tolist(), ends[right + 1].tolist(), strict=True)]
            columns = [pa.array(names[right]), pa.array(np.diff(ends)[right]), pa.array(raw, pa.binary())]
            yield pa.record_batch(columns, ["sig", "n", "v"])

    return texts.mapInArrow(run, "sig long, n long, v binary")


def _frequencies(sets: DataFrame, shards: int) -> DataFrame:
    """(sig, ranked binary): each set's hashes that several sets hold, rarest first, with their places.

    Hashes travel to their shard, which counts them, and come back with their counts."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [np.frombuffer(x, "<u8") for x in frame["v"]]
            owner = np.repeat(frame["sig"].to_numpy(np.int64), [len(x) for x in values])
            v = np.concatenate(values) if values else np.empty(0, np.uint64)
            out = [
                (k, v[at].tobytes(), owner[at].tobytes())
                for k, at in _dealt(np.arange(len(v)), ((v >> np.uint64(20)) % np.uint64(shards)).astype(np.int64))
            ]
            yield pd.DataFrame(out, columns=["shard", "v", "sig"]).astype({"shard": "int64"})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.frombuffer(x, "<u8") for x in frame["v"]])
        sig = np.concatenate([np.frombuffer(x, "<i8") for x in frame["sig"]])
        _, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
        n = n[inverse]
        several = n > 1
        v, sig, n = v[several], sig[several], n[several]
        out = []
        for k, at in _dealt(np.arange(len(v)), (sig.view(np.uint64) % np.uint64(shards)).astype(np.int64)):
            out.append((k, v[at].tobytes(), sig[at].tobytes(), n[at].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["home", "v", "sig", "f"]).astype({"home": "int64"})

    dealt = sets.select("sig", "v").mapInPandas(deal, "shard long, v binary, sig binary")
    return dealt.groupBy("shard").applyInPandas(count, "home long, v binary, sig binary, f binary")


#: A class in a shingle's list: its size, how many of its shingles are its own alone, and the place of the
#: listed one among its shingles, rarest first.
ENTRY = np.dtype([("v", "<u8"), ("sig", "<i8"), ("n", "<u4"), ("own", "<u4"), ("at", "<u4")])


def _prefixes(sets: DataFrame, counts: DataFrame, shards: int, percent: int) -> DataFrame:
    """Entries (hash, class, size, place) of the shingles of each class of which a linked class has one
    at least: the n - ceil(percent * n / 100) + 1 rarest.  Hashes of one class alone are rarest of
    all and lead nowhere; they take up places and are left out."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"shard": [], "entries": []}).astype({"shard": "int64"})
        size_of = dict(zip(left["sig"].tolist(), left["n"].tolist(), strict=True))
        v = np.concatenate([np.frombuffer(x, "<u8") for x in right["v"]])
        sig = np.concatenate([np.frombuffer(x, "<i8") for x in right["sig"]])
        f = np.concatenate([np.frombuffer(x, "<u4") for x in right["f"]])
        by = np.lexsort((v, f, sig))
        v, sig = v[by], sig[by]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        start = np.flatnonzero(new)
        held = np.diff(np.append(start, len(sig)))
        n = np.array([size_of[s] for s in sig[start].tolist()], np.int64)
        within = np.arange(len(sig)) - np.repeat(start, held)
        place = within + np.repeat(n - held, held)
        own = np.repeat(n - held, held)
        n = np.repeat(n, held)
        use = place < n - (-(-percent * n // 100)) + 1
        out = np.zeros(int(use.sum()), ENTRY)
        out["v"], out["sig"], out["n"], out["own"], out["at"] = v[use], sig[use], n[use], own[use], place[use]
        dealt = _dealt(out, ((out["v"] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64))
        return pd.DataFrame({"shard": [k for k, _ in dealt], "entries": [x.tobytes() for _, x in dealt]}).astype(
            {"shard": "int64"}
        )

    homes = sets.select(F.expr(_home(shards)).alias("home"), "sig", "n")
    return homes.groupBy("home").cogroup(counts.groupBy("home")).applyInPandas(run, "shard long, entries binary")


def _home(shards: int) -> str:
    """`sig`, unsigned, modulo `shards`: as numpy has it."""
    return f"cast(pmod(cast(sig AS decimal(20, 0)) + if(sig < 0, 18446744073709551616BD, 0BD), {shards}BD) AS long)"


def _possible(a: tuple, b: tuple, percent: int):
    """Whether sets (size, own shingles, place of the one they share) may link: the larger must not be
    too large, and before and after the place there must be enough to share, of which the
    shingles that are a set's own are no part."""
    (na, ua, pa_), (nb, ub, pb) = a, b
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    most = 1 + np.minimum(pa_ - ua, pb - ub) + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * lo >= percent * hi) & ((100 + percent) * most >= percent * (na + nb))


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(sig, bits): the parities of each set's hashes in BITS buckets.  Sets differ in at least as many
    hashes as their parities differ in bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = [
                np.packbits(np.bincount((np.frombuffer(x, "<u8") % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1)
                for x in frame["v"]
            ]
            yield pd.DataFrame({"sig": frame["sig"], "bits": [b.tobytes() for b in bits]})

    return sets.select("sig", "v").mapInPandas(run, "sig long, bits binary")


def _list_pairs(e: np.ndarray, comp: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one shingle's entries that lie in different components and may link, blocks that
    can hold none being skipped whole."""
    by = np.lexsort((e["at"], e["n"]))
    e, comp, bits = e[by], comp[by], bits[by]
    facts = [e[name].astype(np.int64) for name in ("n", "own", "at")]
    n, sig = facts[0], e["sig"]
    out = []
    starts = list(range(0, len(e), BLOCK))
    one = [comp[s] if (comp[s : s + BLOCK] == comp[s]).all() else None for s in starts]
    for x, s in enumerate(starts):
        top = n[min(s + BLOCK, len(e)) - 1]
        for y in range(x, len(starts)):
            t = starts[y]
            if percent * n[t] > 100 * top:
                break  # sizes only grow from here
            if one[x] is not None and one[x] == one[y]:
                continue  # one component already
            a, b = slice(s, s + BLOCK), slice(t, t + BLOCK)
            ok = _possible([x[a, None] for x in facts], [x[None, b] for x in facts], percent)
            ok &= comp[a, None] != comp[None, b]
            i, j = np.nonzero(ok)
            if x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                differ = np.bitwise_count(bits[a][i] ^ bits[b][j]).sum(1, dtype=np.int64)
                both = n[a][i] + n[b][j]
                near = (100 + percent) * (both - differ) >= 2 * percent * both
                out.append((sig[a][i[near]], sig[b][j[near]]))
    return out


def _spread(entries: DataFrame, labels: DataFrame, bitmaps: DataFrame | None) -> DataFrame:
    """(shard, sig, comp, bits): the labels, and in the last turn the bits, of the classes that have entries in a shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, raw in zip(frame["shard"], frame["entries"], strict=True):
                yield pd.DataFrame({"shard": shard, "sig": np.unique(np.frombuffer(raw, ENTRY)["sig"])})

    held_ = entries.mapInPandas(run, "shard long, sig long").distinct()
    if bitmaps is None:
        return held_.join(labels, "sig").select("shard", "sig", "comp", F.lit(b"").alias("bits"))
    known = bitmaps.join(labels, "sig", "left").select("sig", F.coalesce("comp", "sig").alias("comp"), "bits")
    return held_.join(known, "sig").select("shard", "sig", "comp", "bits")


def _pairs(entries: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes to be compared.  In the first turn each list's entries are
    compared with its leader, the class with the fewest rarer shingles, which is nearest to
    the others; in the next ones with the leader of those outside the first one's component; in
    the last turn all that are left between components."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(x, ENTRY) for x in left["entries"]]
        e = np.concatenate(raw) if raw else np.empty(0, ENTRY)
        comp = e["sig"].copy()
        last = turn == LEADERS
        if len(right):
            known = right.sort_values("sig")
            names, labels = known["sig"].to_numpy(), known["comp"].to_numpy()
            at = np.minimum(np.searchsorted(names, comp), len(names) - 1)
            comp = np.where(names[at] == comp, labels[at], comp)
            if last:
                bits = np.frombuffer(b"".join(known["bits"]), np.uint64).reshape(len(names), -1)[at]
        by = np.argsort(e["v"], kind="stable")
        e, comp = e[by], comp[by]
        bits = bits[by] if last and len(right) else None
        new = np.ones(len(e), bool)
        new[1:] = e["v"][1:] != e["v"][:-1]
        starts = np.flatnonzero(new)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not last:
            group = np.cumsum(new) - 1
            facts = [e[name].astype(np.int64) for name in ("n", "own", "at")]
            middle = facts[2] / facts[0]
            lead = np.lexsort((e["sig"], middle, group))[starts][group]
            if turn:
                lead = np.lexsort((e["sig"], middle, comp == comp[lead], group))[starts][group]
            ok = (comp != comp[lead]) & _possible(facts, [x[lead] for x in facts], percent)
            found.append((e["sig"][ok], e["sig"][lead[ok]]))
        else:
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(e)).tolist(), strict=True):
                if b - a > 1 and (comp[a:b] != comp[a]).any():
                    found += _list_pairs(e[a:b], comp[a:b], bits[a:b], percent)
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
        # the leader stays on one side, so that its set travels once
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    none = entries.select("shard", *[F.col("shard").alias(c) for c in ("sig", "comp", "bits")]).limit(0)
    sides = entries.groupBy("shard").cogroup((none if labels is None else labels).groupBy("shard"))
    return sides.applyInPandas(run, "a long, b long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, compared element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u = np.frombuffer(x.as_buffer(), "<u8")
                w = np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(w, u)
                both = int((w[np.minimum(at, len(w) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(w) - both))
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("sig").alias("a"), F.col("v").alias("va"))
    y = sets.select(F.col("sig").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "va", "vb")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(sig, comp): the smallest name reachable by links, of every name in a link.

    Each turn every name takes the smallest label among its neighbours and itself, then the
    label of that label; labels halve their distance to the smallest, so turns are few.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("sig")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("sig", "b"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "sig").select("sig", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("sig").alias("new"), F.col("comp").alias("far"))
        after = written(
            stepped.join(jump, "new", "left").select("sig", F.col("comp").alias("old"), F.least("new", "far").alias("comp")),
            "labels",
        )
        changed = after.where("old <> comp").limit(1).count()
        labels = after.select("sig", "comp")
        if not changed:
            return labels


def _grouped(docs: DataFrame, words_each: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (its text's hash), n, and the smallest (doc_id, th) that links reach, `first`, of every
    row; a null id is NO_ID.  Ids may be null or repeated, so a document is told by both."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # a word and its space are some six bytes
    shards = int(size / 6 * COUNTED / 256 / SHARD) + 1
    known = written(_classified(_shared(_counted(rows, shards, words_each)), percent), "documents")
    classes = known.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.max("open").alias("open"), F.first("n").alias("n"))
    open_classes = written(classes.where("open").select("sig", "rep", "n"), "classes")
    total = open_classes.agg(F.sum("n")).first()[0] or 0
    shards = int(total / SHARD) + 1
    # one text per class: the set of a class must be counted once
    one = open_classes.select("rep.doc_id", "rep.th", "sig")
    texts = rows.join(one, ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "sig"]).select("sig", "text")
    sets = written(_sets_of(texts, words_each), "sets")
    entries = written(_prefixes(sets, _frequencies(sets, shards), shards, percent), "entries")
    links = labels = None
    for turn in range(LEADERS + 1):
        spread = None if labels is None else _spread(entries, labels, _bitmaps(sets) if turn == LEADERS else None)
        found = written(_links(_pairs(entries, spread, turn, percent), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    names = known.join(labels, "sig", "left").select("doc_id", "th", "n", F.coalesce("comp", "sig").alias("comp"))
    smallest = (
        classes.join(labels, "sig", "left").groupBy(F.coalesce("comp", "sig").alias("comp")).agg(F.min("rep").alias("first"))
    )
    none = F.col("n") == 0
    linked = names.where(~none).join(smallest, "comp").select("doc_id", "th", "n", "first")
    alone = names.where(none).select("doc_id", "th", "n", F.struct("doc_id", "th").alias("first"))
    return linked.unionByName(alone)


def representatives(
    docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, th: id and text hash (xxhash64) of the one document that stands for each component of
    `near_duplicates`, that of the smallest id and then hash; each text without shingles stands for itself."""
    found = _grouped(docs, words_each, percent, id_col, text_col)
    kept = found.where(F.struct("doc_id", "th") == F.col("first")).select("doc_id", "th").distinct()
    return kept.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "th")


def near_duplicates(
    docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row.

    Words are the runs of characters other than ASCII white space, A-Z in lower case; a set
    holds the distinct shingles of `words_each` words, or the whole sequence if it is shorter.
    Null and empty texts have no shingles and link to nothing; their component is their own id.
    A null id counts as the smallest.  Repeated rows are documents of one class.  Further
    columns are not read.
    """
    found = _grouped(docs, words_each, percent, id_col, text_col)

    def back(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    return found.select(
        back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("first.doc_id").alias("component_id")
    )
