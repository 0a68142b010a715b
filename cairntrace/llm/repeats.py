"""Repeated passages, byte for byte: content-defined phrases and run-length suffix indexes over them.

A string of `length` bytes owns one anchor, the leftmost k-gram of smallest hash inside it, and
equal strings own equal anchors at equal places.  The strings of a text that own the same
anchor are consecutive; the bytes they span are a phrase.  So strings can only recur between
phrases of one anchor, and texts are parsed into phrases before anything is indexed
(prefix-free parsing): equal phrases are one dictionary entry, and only the entries of anchors
that have several go into the run-length indexes, which are sharded by anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import mixed, steps
from cairntrace.llm.common import NO_ID, written

#: Bytes of a string that must recur, and of the k-grams among which anchors are chosen.
LENGTH, ANCHOR = 100, 24
#: Bytes of text for one shard of phrases, and for one group of documents.
SHARD_BYTES, GROUP_BYTES = 12_000_000, 8_000_000
#: Bytes of text that are parsed at once, and bytes of phrases of one index.
PHRASE_BYTES, INDEX_BYTES = 500_000, 1_500_000
#: Phrases of one anchor from which on their strings are compared in smaller blocks.
CROWDED = 8_192

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))

#: One phrase occurrence: anchor hash, phrase hash, document (number in its batch), first string, strings before
#: the anchor, strings less one.
OCCURRENCE = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<u4"), ("s", "<u4"), ("left", "u1"), ("span", "u1")])
#: A run of strings of a document (named by its key), that recur: first string, strings less one.
RUN = np.dtype([("doc", "<u8"), ("s", "<u4"), ("span", "u1")])
#: A phrase to be compared: like an occurrence, and how many strings are compared together.
OPEN = np.dtype([("doc", "<u8"), ("s", "<u4"), ("left", "u1"), ("span", "u1"), ("h", "<u8"), ("block", "u1")])
#: The bytes of a block: the order and key of its document, where it begins, its size.
HEAD = np.dtype([("id", "<i8"), ("th", "<i8"), ("doc", "<u8"), ("s", "<u4"), ("size", "<u2")])


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    out = x * _A
    out += y
    out ^= out >> np.uint64(32)
    out *= _B
    return out


class Hashes:
    """Hashes of all substrings of given lengths, by doubling."""

    def __init__(self, text: np.ndarray) -> None:
        self.n = len(text)
        self.powers = [_BYTE[text]]

    def of(self, length: int) -> np.ndarray:
        """Hash of the `length` bytes from each place on (as many places as fit)."""
        if length > self.n:
            return np.empty(0, np.uint64)
        while len(self.powers) < length.bit_length():
            x, half = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(_joined(x[:-half], x[half:]) if len(x) > half else x[:0])
        places = self.n - length + 1
        out, at = None, 0
        for bit in reversed(range(length.bit_length())):
            if length >> bit & 1:
                part = self.powers[bit][at : at + places]
                out = part if out is None else _joined(out, part)
                at += 1 << bit
        return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each place on."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def phrases(text: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The phrase occurrences of joined documents that end at `ends`, in order."""
    width = length - anchor + 1
    hashes = Hashes(text)
    if len(text) < length:
        return np.empty(0, OCCURRENCE)
    grams = hashes.of(anchor)
    key = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    at = (_window_min(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = hashes.of(length)
    # strings that lie in one document
    sizes = np.diff(ends, prepend=0)
    inside = np.ones(len(at), bool)
    for_end = ends[:-1]
    if len(for_end):
        stop = np.zeros(len(text) + 1, np.int32)
        np.add.at(stop, np.maximum(for_end - length + 1, ends[:-1] - sizes[:-1]), 1)
        np.add.at(stop, for_end, -1)
        inside = np.cumsum(stop[: len(at)]) == 0
    places = np.flatnonzero(inside)
    if not len(places):
        return np.empty(0, OCCURRENCE)
    a = at[places]
    new = np.flatnonzero((a[1:] != a[:-1]) | (places[1:] != places[:-1] + 1)) + 1
    first = places[np.concatenate([[0], new])]
    last = places[np.concatenate([new - 1, [len(places) - 1]])]
    a = at[first]
    document = np.searchsorted(ends, first, side="right")
    out = np.empty(len(first), OCCURRENCE)
    out["h"] = grams[a]
    out["left"], out["span"] = a - first, last - first
    # first and last string overlap, so their hashes and places tell the whole phrase
    shape = (out["left"].astype(np.uint64) << np.uint64(8)) | out["span"]
    out["c"] = _joined(_joined(whole[first], whole[last]), mixed(shape))
    out["d"] = document
    out["s"] = first - (ends - sizes)[document]
    return out


def _packed(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _dealt(values: np.ndarray, to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The values for each number in `to`."""
    if not len(to):
        return []
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by])) + 1
    return [(int(to[part[0]]), values[part]) for part in np.split(by, cuts)]


def _occurrences(rows: DataFrame, shards: int, length: int, anchor: int) -> DataFrame:
    """Phrase occurrences of (id, th, key, text), packed by shard of the anchor.

    Of phrases that a batch holds several times only the first goes on with its hashes, for
    the others are known to recur already (`known`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = pa.binary()
        for batch, texts in steps(batches, "__text", PHRASE_BYTES):
            ids, hashes, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((hashes, ids))
            ids, hashes, keys = ids[order], hashes[order], keys[order]
            texts = [texts[i] for i in order.tolist()]
            ends = np.cumsum([len(t) for t in texts])
            found = phrases(np.frombuffer(b"".join(texts), np.uint8), ends, length, anchor)
            if not len(found):
                continue
            f = found[np.lexsort((found["c"], found["h"]))]
            again = np.zeros(len(f), bool)
            again[1:] = (f["h"][1:] == f["h"][:-1]) & (f["c"][1:] == f["c"][:-1])
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(f))))
            # a repeated row is the same document: it does not recur in itself
            itself = (keys[f["d"]] == keys[f["d"][lead]]) & (f["s"] == f["s"][lead])
            recurs = f[again & ~itself]
            runs = np.zeros(len(recurs), RUN)
            runs["doc"], runs["s"], runs["span"] = keys[recurs["d"]].view(np.uint64), recurs["s"], recurs["span"]
            f = f[~again]
            out = []
            for shard, part in _dealt(f, (f["h"] % np.uint64(shards)).astype(np.int64)):
                used, part["d"] = np.unique(part["d"], return_inverse=True)
                table = np.stack([ids[used], hashes[used], keys[used]])
                out.append((shard, table.tobytes(), part.tobytes(), b""))
            out.append((int(f["h"][0] % np.uint64(shards)), b"", b"", runs.tobytes()))
            yield _packed(out, [pa.int64(), binary, binary, binary], ["shard", "docs", "rows", "known"])

    return rows.mapInArrow(run, "shard long, docs binary, rows binary, known binary")


def _block_of(entries: int, widest: int) -> int:
    """Strings of one anchor that are indexed together: all, or fewer the more phrases the anchor
    has, so that what meets in a shard has more bytes in common."""
    block = widest
    while entries > CROWDED and block > 1:
        entries, block = entries // 2, block // 2
    return block


def _resolved(packed: DataFrame, groups: int, length: int, anchor: int) -> DataFrame:
    """Per shard of anchors and group of documents: runs known to recur, and the first occurrences of
    phrases whose anchor has several phrases (`open`), which the indexes have to compare."""
    widest = length - anchor + 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tables, parts, base = [], [], 0
        known = [np.frombuffer(raw, RUN) for raw in frame["known"]]
        for docs, rows in zip(frame["docs"], frame["rows"], strict=True):
            table, part = np.frombuffer(docs, np.int64).reshape(3, -1), np.frombuffer(rows, OCCURRENCE).copy()
            part["d"] += base
            base += table.shape[1]
            tables.append(table)
            parts.append(part)
        ids, hashes, keys = np.concatenate(tables, axis=1)
        f = np.concatenate(parts)
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((hashes, ids))] = np.arange(len(ids))
        f = f[np.lexsort((f["s"], place[f["d"]], f["c"], f["h"]))]
        new_h = np.ones(len(f), bool)
        new_h[1:] = f["h"][1:] != f["h"][:-1]
        new_c = new_h.copy()
        new_c[1:] |= f["c"][1:] != f["c"][:-1]
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(f)), 0))
        itself = (keys[f["d"]] == keys[f["d"][lead]]) & (f["s"] == f["s"][lead])
        later = f[~new_c & ~itself]
        runs = np.zeros(len(later), RUN)
        runs["doc"], runs["s"], runs["span"] = keys[later["d"]].view(np.uint64), later["s"], later["span"]
        runs = np.concatenate([*known, runs])
        anchors = np.cumsum(new_h) - 1
        entries = np.bincount(anchors, weights=new_c).astype(np.int64) if len(f) else np.zeros(0, np.int64)
        several = new_c & (entries[anchors] > 1)
        first = f[several]
        unsure = np.zeros(len(first), OPEN)
        for name in ("s", "left", "span", "h"):
            unsure[name] = first[name]
        unsure["doc"] = keys[first["d"]].view(np.uint64)
        sizes, inverse = np.unique(entries[anchors[several]], return_inverse=True)
        blocks = np.array([_block_of(int(n), widest) for n in sizes], np.uint8)
        unsure["block"] = blocks[inverse] if len(sizes) else 0
        out: dict[int, list[bytes]] = {}
        for at, rows in ((0, runs), (1, unsure)):
            for group, part in _dealt(rows, (rows["doc"] % np.uint64(groups)).astype(np.int64)):
                out.setdefault(group, [b"", b""])[at] = part.tobytes()
        return pd.DataFrame(
            {"grp": list(out), "runs": [x[0] for x in out.values()], "open": [x[1] for x in out.values()]}
        ).astype({"grp": "int64"})

    return packed.groupBy("shard").applyInPandas(run, "grp long, runs binary, open binary")


def _fetched(texts: DataFrame, unsure: DataFrame, shards: int, length: int) -> DataFrame:
    """The bytes of open phrases, cut into blocks and packed by shard of their common bytes.

    A block is the strings that begin between two multiples of its size before the anchor; its
    shard is a hash of the bytes that all of them share.  Equal blocks of one group of
    documents are sent once; the strings of the later ones are known to recur."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = np.concatenate([np.frombuffer(raw, OPEN) for raw in right["open"]]) if len(right) else np.zeros(0, OPEN)
        left = left.drop_duplicates("key").sort_values(["id", "th"], kind="stable")
        keys = left["key"].to_numpy().view(np.uint64)
        by_key = np.argsort(keys)
        document = by_key[np.searchsorted(keys[by_key], wanted["doc"])] if len(wanted) else wanted["doc"].astype(int)
        order = np.lexsort((wanted["s"], document))
        ids, hashes = left["id"].tolist(), left["th"].tolist()
        texts = [t or b"" for t in left["__text"]]
        seen: set[bytes] = set()
        heads, pieces, shard, known = [], [], [], []
        rows = zip(wanted[order].tolist(), document[order].tolist(), strict=True)
        for (key, s, before, span, _, block), d in rows:
            text, a = texts[d], s + before
            # strings begin j bytes before the anchor, from before - span to before
            for q in range((before - span) // block, before // block + 1):
                high, low = min(before, (q + 1) * block - 1), max(before - span, q * block)
                piece = text[a - high : a - low + length]
                if piece in seen:
                    known.append((key, a - high, high - low))
                    continue
                seen.add(piece)
                core = text[a - q * block : a - (q + 1) * block + 1 + length]
                shard.append(int.from_bytes(hashlib.blake2b(core, digest_size=7).digest(), "little") % shards)
                heads.append((ids[d], hashes[d], key, a - high, len(piece)))
                pieces.append(piece)
        out = []
        for k, part in _dealt(np.arange(len(heads)), np.array(shard, np.int64)):
            raw = np.array([heads[i] for i in part.tolist()], HEAD).tobytes()
            out.append((k, raw, b"".join([pieces[i] for i in part.tolist()]), b""))
        if known:
            out.append((shard[0], b"", b"", np.array(known, RUN).tobytes()))
        return pd.DataFrame(out, columns=["shard", "heads", "bytes", "known"]).astype({"shard": "int64"})

    return (
        texts.select("grp", "id", "th", "key", "__text")
        .groupBy("grp")
        .cogroup(unsure.groupBy("grp"))
        .applyInPandas(run, "shard long, heads binary, bytes binary, known binary")
    )


class RunLengthIndex:
    """The run-length compressed Burrows-Wheeler transform of phrases, each ended by its own terminator.

    `head` and `tail` sample the suffix array at the first and last row of each run; at the heads,
    `lcp` samples the length that a suffix shares with the one before it.  A suffix whose row is
    no head follows, in text order, from the sample before it: its neighbour moves on by one
    and the shared length shrinks by one.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        ends = self.starts + sizes
        raw[ends] = 0
        self.n = len(raw)
        self.rest = np.repeat(ends, sizes + 1) - np.arange(self.n)
        self.symbols = np.concatenate([raw, np.zeros(32, np.uint16)])
        order = self._suffixes(int(sizes.max()))
        left = np.where(order > 0, raw[order - 1], 0)
        first = np.ones(self.n, bool)
        # terminators differ from one another, so each is a run
        first[1:] = (left[1:] != left[:-1]) | (left[1:] == 0)
        rows = np.flatnonzero(first)
        self.runs = left[rows]
        self.head, self.tail = order[rows], order[np.append(rows[1:], self.n) - 1]
        self.before = np.where(rows > 0, order[rows - 1], -1)
        self.lcp = self._shared(self.head, self.before)

    def _suffixes(self, longest: int) -> np.ndarray:
        """The suffix array, by doubling from seven symbols; suffixes that are told apart rest."""
        n = self.n
        key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(7):
            symbol = np.where(alive, self.symbols[j : j + n], 0)
            key = key << np.uint64(9) | symbol.astype(np.uint64)
            alive &= symbol != 0
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = 7
        at = np.arange(n)
        while depth <= longest:
            alone = new[at] & np.append(new, True)[at + 1]
            at = at[~alone & (self.rest[order[at]] >= depth)]
            if not len(at):
                break
            suffix = order[at]
            pair = rank[suffix] << 32 | rank[suffix + depth]
            by = np.argsort(pair, kind="stable")
            order[at] = suffix = suffix[by]
            pair = pair[by]
            new[at[1:]] = pair[1:] != pair[:-1]
            rank[suffix] = np.maximum.accumulate(np.where(new[at], at, 0))
            depth *= 2
        return order

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, short of their terminators; 0 where b is none."""
        out = np.zeros(len(a), np.int64)
        active = np.flatnonzero(b >= 0)
        step = np.arange(16)
        while len(active):
            x = self.symbols[a[active][:, None] + out[active][:, None] + step]
            y = self.symbols[b[active][:, None] + out[active][:, None] + step]
            differ = (x != y) | (x == 0)
            any_ = differ.any(1)
            out[active] += np.where(any_, differ.argmax(1), 16)
            active = active[~any_]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place, in text order: how long a string it shares with another place, and that
        place; streamed from the samples of the runs."""
        by = np.argsort(self.head)
        head, before, lcp = self.head[by], self.before[by], self.lcp[by]
        is_head = np.zeros(self.n, np.int64)
        is_head[head] = 1
        sample = np.cumsum(is_head) - 1
        on = np.arange(self.n) - head[sample]
        return lcp[sample] - on, before[sample] + on

    def later(self, length: int) -> np.ndarray:
        """Places from which the next `length` bytes also begin at an earlier place."""
        shared, other = self.matching_statistics()
        linked = (shared >= length) & (self.rest >= length)
        parent = np.where(linked, other, np.arange(self.n))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        place = np.flatnonzero(linked)
        first = np.arange(self.n)
        np.minimum.at(first, parent[place], place)
        member = linked.copy()
        member[parent[place]] = True
        member = np.flatnonzero(member)
        return member[member > first[parent[member]]]


def _indexed(packed: DataFrame, groups: int, length: int) -> DataFrame:
    """Per shard: builds the index of its blocks and finds the runs of strings that recur."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads = np.concatenate([np.frombuffer(raw, HEAD) for raw in frame["heads"]])
        runs = [np.frombuffer(raw, RUN) for raw in frame["known"]]
        raw = b"".join(frame["bytes"])
        cut = np.cumsum(heads["size"], dtype=np.int64)
        pieces = [raw[b - n : b] for b, n in zip(cut.tolist(), heads["size"].tolist(), strict=True)]
        order = np.lexsort((heads["s"], heads["th"], heads["id"]))
        seen: set[bytes] = set()
        kept, again = [], []
        for i in order.tolist():
            if pieces[i] in seen:
                again.append(i)
            else:
                seen.add(pieces[i])
                kept.append(i)

        def as_runs(which: np.ndarray, s: np.ndarray, span: np.ndarray) -> np.ndarray:
            out = np.zeros(len(which), RUN)
            out["doc"], out["s"], out["span"] = heads["doc"][which], s, span
            return out

        again = np.array(again, np.int64)
        runs.append(as_runs(again, heads["s"][again], heads["size"][again] - length))
        if len(kept) > 1:
            kept = np.array(kept)
            index = RunLengthIndex([pieces[i] for i in kept.tolist()])
            place = index.later(length)
            if len(place):
                piece = np.searchsorted(index.starts, place, side="right") - 1
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1] + 1) | (piece[1:] != piece[:-1])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(place)) - 1
                of = kept[piece[begin]]
                runs.append(as_runs(of, heads["s"][of] + place[begin] - index.starts[piece[begin]], place[last] - place[begin]))
        found = np.concatenate(runs)
        dealt = _dealt(found, (found["doc"] % np.uint64(groups)).astype(np.int64))
        return pd.DataFrame({"grp": [g for g, _ in dealt], "runs": [part.tobytes() for _, part in dealt]}).astype(
            {"grp": "int64"}
        )

    return packed.groupBy("shard").applyInPandas(run, "grp long, runs binary")


def _covered(runs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes of one document's runs of strings."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(runs["s"].tolist(), (runs["s"] + runs["span"] + length).tolist(), strict=True)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _whole_characters(t: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, but with each character of which a byte is outside them."""
    out, at = [], 0
    for begin, end in spans:
        while begin < end and t[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(t) and t[end] & 0xC0 == 0x80:
            end -= 1
        out.append(t[at:begin])
        at = end
    return b"".join([*out, t[at:]]).decode()


def mark_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "removed",
    kept_col: str = "kept",
    kept_text_col: str = "kept_text",
) -> DataFrame:
    """`docs` with `removed_col`, the maximal byte ranges (begin, end) that strings of `length`
    bytes cover which also begin earlier, `kept_col`, the other bytes (binary), and
    `kept_text_col`, the text without the characters that are removed whole.

    Earlier is a smaller id, or the same document at a smaller place; strings never cross
    documents and are judged on the whole input.  A null text is empty.  A null id counts as
    the smallest; rows that share an id but not a text are ordered by a hash of the text; equal
    rows are one document, and both keep the same bytes.  Columns of `docs` with the
    result names are replaced, other columns are returned as they are.

    Texts are dealt once by document; phrases and blocks, not texts, are dealt by content.
    """
    columns = [c for c in docs.columns if c not in (removed_col, kept_col, kept_text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    th = F.xxhash64(text)
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    named = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
        number.alias("id"),
        th.alias("th"),
        F.xxhash64(number, th).alias("key"),
        text.cast("binary").alias("__text"),
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, groups = int(size / SHARD_BYTES) + 1, int(size / GROUP_BYTES) + 1
    # the group of a document, as unsigned remainder of its key
    grouped = named.withColumn("grp", F.expr(f"cast(pmod(cast(key AS decimal(20, 0)) + if(key < 0, 18446744073709551616BD, 0BD), {groups}BD) AS long)"))
    plain = named.where(F.length("__text") >= length).select("id", "th", "key", "__text")
    made = written(_resolved(_occurrences(plain, shards, length, anchor), groups, length, anchor), "phrases")
    blocks = made.where(F.length("open") > 0).agg(F.sum(F.length("open"))).first()[0] or 0
    index_shards = int(blocks / OPEN.itemsize * (length + 40) / INDEX_BYTES) + 1
    fetched = _fetched(grouped, made.where(F.length("open") > 0).select("grp", "open"), index_shards, length)
    runs = made.where(F.length("runs") > 0).select("grp", "runs").unionByName(_indexed(fetched, groups, length))

    names = [f"c{i}" for i in range(len(columns))]

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.concatenate([np.frombuffer(raw, RUN) for raw in right["runs"]]) if len(right) else np.zeros(0, RUN)
        of = {int(part[0]["doc"]): part for _, part in _dealt(found, found["doc"].view(np.int64))}
        removed, kept, texts = [], [], []
        for key, t in zip(left["key"].to_numpy().view(np.uint64).tolist(), left["__text"], strict=True):
            spans = _covered(of[key], length) if key in of else []
            removed.append([{"begin": a, "end": b} for a, b in spans])
            texts.append(_whole_characters(t, spans))
            if spans:
                edges = [0, *[x for span in spans for x in span], len(t)]
                t = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            kept.append(t)
        out = left[names].copy()
        out["removed"], out["kept"], out["kept_text"] = removed, kept, texts
        return out

    kinds = dict(named.dtypes)
    schema = "".join(f"{n} {kinds[n]}, " for n in names) + "removed array<struct<begin: long, end: long>>, kept binary, kept_text string"
    done = grouped.groupBy("grp").cogroup(runs.groupBy("grp")).applyInPandas(finish, schema)
    return done.select(
        *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)],
        F.col("removed").alias(removed_col),
        F.col("kept").alias(kept_col),
        F.col("kept_text").alias(kept_text_col),
    )
