"""Lexical retrieval packing: token windows filled with the BM25 neighbours of a seed document."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import IdStore, done_with_held, give_back, held, mixed, word_steps
from cairntrace.llm.common import NO_ID, written

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Tokens of a shard: what one inverted index holds.
SHARD_TOKENS = 2_000_000
#: Distinct pieces of text whose ids a worker remembers.
REMEMBERED = 200_000
#: Terms in more than this share of a shard's documents are scored for many seeds at once, and so many numbers
#: such a block of scores may hold.
COMMON, BLOCK = 1 / 4, 1 << 21
#: Neighbours put in order first; the others only if a window takes more.
HEAD = 64
K1, B = 1.2, 0.75
#: Distinct sketches (about so many, chosen by a hash) that the topics start from, and rounds on them.
START, ROUNDS = 4096, 12
#: Rounds over all documents that then move the topics.
WHOLE_ROUNDS = 3
#: Components of a document's sketch; one is a whole number, 1 being UNIT.  Products of such numbers
#: are exact in 64-bit floats, in whatever order a matrix library adds.
SKETCH, UNIT = 256, 1 << 14
#: Documents whose sketches are made or read at once.
SKETCHED = 1000
#: A topic has 2^BITS cells; at most TOPICS * 2^BITS = 65,536 cells are counted, the bound of what
#: the driver sees of them.
TOPICS, BITS = 1024, 6

# Byte-level vocabularies write each byte as a character: printable ones as themselves, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {
    chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)
}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids by a `tokenizers` file whose pre-tokens never hold white space.

    Such a tokenizer gives a text the ids of its white-space-separated pieces, one after the
    other, so ids are made once per distinct piece and remembered.  A piece of letters, but for
    punctuation at its end, is two pre-tokens.  Merging by rank gives letters the same ids as
    merging by the file's list, for a token can only come about by its own merge; that is
    quick with `tiktoken`, a byte that texts cannot hold standing for the mark of a word's
    end.  All other pieces go through `tokenizers` whole.
    """

    TAIL = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    END = "\0"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        suffix = self.model.model.end_of_word_suffix
        ranks = {}
        last = []
        for token, i in self.model.get_vocab().items():
            if not token.startswith("<|"):
                ended = token.endswith(suffix)
                raw = bytes(map(_BYTE_OF.__getitem__, token[: -len(suffix)] if ended else token))
                ranks[raw + self.END.encode() * ended] = i
                last += [i] * ended
        ranks.setdefault(self.END.encode(), len(ranks) + (1 << 20))  # alone it is never left over
        own = tiktoken.Encoding("word", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.letters = own._core_bpe.encode_ordinary
        self.last = np.zeros(max(last) + 1, bool)
        self.last[last] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tails: dict[bytes, int] = {b"": 0}
        self.tail_ids = IdStore()
        self.tail_ids.add([])
        self.store = IdStore()

    def _learn(self, new: list[bytes]) -> None:
        cores = [piece.rstrip(self.TAIL) for piece in new]
        text = b"\n".join(cores).decode()
        low = text.lower()
        words = low.split("\n")
        easy = np.fromiter(map(str.isalpha, words), bool, len(words))
        if len(low) != len(text) or "\u03a3" in text or not is_normalized("NFC", text):
            for i, (was, now) in enumerate(zip(text.split("\n"), words, strict=True)):
                easy[i] &= len(was) == len(now) and "\u03a3" not in was and is_normalized("NFC", was)
        at = np.flatnonzero(easy).tolist()
        flat = np.zeros(0, np.int64)
        if at:
            flat = np.array(self.letters((self.END + " ").join([words[i] for i in at]) + self.END), np.int64)
        core_ends = np.flatnonzero(self.last[flat]) + 1
        tails = [new[i][len(cores[i]) :] for i in at]
        for tail in dict.fromkeys(tails):
            if tail not in self.tails:
                self.tails[tail] = self.tail_ids.add(self.model.encode(tail.decode(), add_special_tokens=False).ids)
        more, more_ends = self.tail_ids.gather(np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails)))
        ends = core_ends + more_ends[1:]
        both = np.empty(len(flat) + len(more), np.int64)
        both[np.arange(len(flat)) + np.repeat(more_ends[:-1], np.diff(core_ends, prepend=0))] = flat
        both[np.arange(len(more)) + np.repeat(core_ends, np.diff(more_ends))] = more
        first = self.store.n
        self.store.add_all(both, ends)
        hard = [new[i] for i in np.flatnonzero(~easy).tolist()]
        lists = [e.ids for e in self.model.encode_batch_fast([p.decode() for p in hard], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.store.add_all(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), np.cumsum(sizes))
        self.known.update(zip(chain([new[i] for i in at], hard), range(first, self.store.n), strict=True))

    def encode(self, pieces: list[bytes], which: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (with the end); texts are
        given by distinct pieces, the places of all pieces among them, and their number per text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = [i for i in np.flatnonzero(numbers < 0).tolist() if pieces[i]]
        if missing:
            found = [pieces[i] for i in missing]
            self._learn(found)
            numbers[missing] = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        ids, ends = self.store.gather(numbers[which])
        first = np.zeros(len(per_text) + 1, np.int64)
        np.cumsum(per_text, out=first[1:])
        return ids, ends[first]


@dataclass(frozen=True)
class Topics:
    """Where a document belongs: its nearest topic, and a cell of it.

    A document's sketch adds the weights of its tokens, each with a sign, to SKETCH components by
    the token's hash; roots damp repetition.  Copies fall into one cell, near copies mostly.
    """

    weight: np.ndarray
    centres: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Topic of each sketch."""
        return np.argmax(x.astype(np.float64) @ self.centres.T.astype(np.float64), 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """topic * 2^BITS + cell of each sketch."""
        topic = self.nearest(x)
        planes = np.round(np.random.default_rng(1).standard_normal((SKETCH, BITS)) * UNIT)
        above = (x.astype(np.float64) - self.centres[topic]) @ planes > 0
        return (topic << BITS) + above @ (1 << np.arange(BITS))


def sketches_of(ids: np.ndarray, owner: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    """One sketch per document (0 for one without tokens), of ids with these weights."""
    drawn = mixed(np.arange(len(weight), dtype=np.uint64) + np.uint64(1))
    signed = weight * np.where(drawn >> np.uint64(63), 1.0, -1.0)
    at = (drawn % np.uint64(SKETCH)).astype(np.int64)
    x = np.bincount(owner * SKETCH + at[ids], signed[ids], minlength=n * SKETCH).reshape(n, SKETCH)
    return np.round(_unit(np.sign(x) * np.sqrt(np.abs(x))) * UNIT).astype("<i2")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _centre(sums: np.ndarray) -> np.ndarray:
    return np.round(_unit(sums.astype(np.float64)) * UNIT).astype(np.int64)


def centres_of(x: np.ndarray, topics: int) -> np.ndarray:
    """At most `topics` centres of the sketches by spherical k-means, like ones next to each other."""
    rng = np.random.default_rng(0)
    if not len(x):
        return np.zeros((1, SKETCH), np.int64)
    centres = x[rng.permutation(len(x))[:topics]].astype(np.int64)
    for _ in range(ROUNDS):
        near = Topics(np.zeros(1), centres).nearest(x)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        met = np.bincount(near, minlength=len(centres)) > 0
        centres[met] = _centre(sums[met])
    return _in_line(centres)


def _in_line(centres: np.ndarray) -> np.ndarray:
    """The centres, like ones next to each other."""
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ axis, kind="stable")]


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit or, for vocabularies that allow it, 16-bit, with the
    end id), n, again (how many rows of its id came before it in the task);
    and one row per partition with a null `ids` and the numbers of documents in
    which each id occurs (`counts`, unsigned 32-bit)."""

    names = ["doc_id", "ids", "n", "again", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held(("word ids", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        size = tokenizer.model.get_vocab_size()
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        counts = np.zeros(size, np.int64)
        met: Counter = Counter()
        for batch, per_text, which, kinds in word_steps(batches, lower=False):
            again = []
            for i in batch.column(0).to_pylist():
                again.append(met[i])
                met[i] += 1
            ids, ends = tokenizer.encode(kinds.words(), which, per_text)
            n = len(per_text)
            sizes = np.diff(ends)
            whole = np.full(len(ids) + n, END_ID, kind)
            owner = np.repeat(np.arange(n), sizes)
            whole[np.arange(len(ids)) + owner] = ids
            # 32 bits sort in half the time
            wide = np.int32 if n * size < 1 << 31 else np.int64
            pairs = np.sort(owner.astype(wide) * wide(size) + ids.astype(wide))
            counts += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % size, minlength=size)
            cuts = ((ends + np.arange(n + 1)) * kind.itemsize).tolist()
            raw = whole.tobytes()
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(again, pa.int64()),
                    pa.nulls(n, pa.binary()),
                ],
                names,
            )
        batch = per_text = which = kinds = ids = ends = whole = owner = pairs = raw = None
        give_back()
        yield pa.record_batch(
            [
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.binary()),
                pa.array([0], pa.int64()),
                pa.nulls(1, pa.int64()),
                pa.array([counts.astype("<u4").tobytes()], pa.binary()),
            ],
            names,
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long, again long, counts binary")


def _summed(counts: DataFrame) -> DataFrame:
    """Adds the count arrays of each partition's rows; a few rows remain."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for raw in frame["counts"]:
                one = np.frombuffer(raw, "<u4").astype(np.int64)
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"counts": [total.astype("<i8").tobytes()]})

    return counts.mapInPandas(run, "counts binary")


def inverse_frequencies(made: DataFrame) -> np.ndarray:
    """BM25's weight of each id over all documents of a table that `tokenised` made."""
    arrays = _summed(made.where("counts IS NOT NULL").select("counts").repartition(8)).collect()
    frequency = sum((np.frombuffer(r["counts"], "<i8") for r in arrays), np.zeros(1, np.int64))
    total = made.where("ids IS NOT NULL").agg(F.count("*").alias("n")).first()["n"]
    return np.log1p((total - frequency + 0.5) / (frequency + 0.5))


def _sketched(batch: pa.RecordBatch, weight: np.ndarray) -> np.ndarray:
    """Sketches of a batch's column `ids`, the end ids left out."""
    kind = np.dtype("<u2" if len(weight) <= 1 << 16 else "<u4")
    lists = [np.frombuffer(raw, kind)[:-1] for raw in batch.column("ids").to_pylist()]
    n = len(lists)
    owner = np.repeat(np.arange(n), np.fromiter(map(len, lists), np.int64, n))
    return sketches_of(np.concatenate([np.zeros(0, kind), *lists]), owner, n, weight)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SKETCHED rows, for tasks that need no tokenizer."""
    done_with_held()
    for batch in batches:
        for first in range(0, len(batch), SKETCHED):
            yield batch.slice(first, SKETCHED)


def _read_sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<i2").reshape(-1, SKETCH)


def _moved(sketches: DataFrame, topics: Topics) -> Topics:
    """The topics after one round of spherical k-means over all sketches: tasks add up what is nearest to each
    topic, in whole numbers, and Spark adds up the tasks' sums; one row per topic reaches the driver."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(topics.centres), SKETCH), np.int64)
        met = np.zeros(len(sums), bool)
        for batch in _parts(batches):
            x = _read_sketches(batch)
            near = topics.nearest(x)
            order = np.argsort(near, kind="stable")
            found, first = np.unique(near[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(x[order], first, dtype=np.int64)
                met[found] = True
        found = np.flatnonzero(met)
        rows = pa.array([s.astype("<i8").tobytes() for s in sums[found]], pa.binary())
        yield pa.record_batch([pa.array(found, pa.int32()), rows], ["topic", "total"])

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for frame in frames:
            for topic, raw in zip(frame["topic"], frame["total"], strict=True):
                totals[topic] = totals.get(topic, 0) + np.frombuffer(raw, "<i8")
        rows = [t.astype("<i8").tobytes() for t in totals.values()]
        yield pd.DataFrame({"topic": list(totals), "total": rows}).astype({"topic": "int32"})

    kind = "topic int, total binary"
    sums = sketches.select("sketch").mapInArrow(nearest, kind).repartition(8, "topic").mapInPandas(added, kind).collect()
    centres = topics.centres.copy()
    for r in sums:
        centres[r["topic"]] = _centre(np.frombuffer(r["total"], "<i8"))
    return Topics(topics.weight, centres)


def fit_topics(made: DataFrame, idf: np.ndarray, shard_tokens: int) -> tuple[Topics, dict[int, int]]:
    """Topics of all documents of a table that `tokenised` made, one per shard that they need, at most TOPICS;
    and the tokens of each cell.

    The rounds over all documents begin at the centres of about START of them."""
    rows = made.where("ids IS NOT NULL")
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    wanted = min(TOPICS, 1 + total // shard_tokens)
    if wanted == 1:
        return Topics(idf, np.zeros((1, SKETCH), np.int64)), {0: total}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x = _sketched(batch, idf)
            raw = pa.array([one.tobytes() for one in x], pa.binary())
            yield pa.record_batch([batch.column("n"), raw], ["n", "sketch"])

    sketches = written(rows.select("ids", "n").mapInArrow(sketch, "n long, sketch binary"), "sketches")
    few = sketches.select("sketch").where("n > 1")
    documents = few.count()
    if documents > START:
        few = few.where(F.xxhash64("sketch") < int(-(2**63) + 2**64 / documents * START))
    start = sorted(bytes(r["sketch"]) for r in few.distinct().collect())
    x = np.frombuffer(b"".join(start), "<i2").reshape(-1, SKETCH)
    topics = Topics(idf, centres_of(x, wanted))
    for _ in range(WHOLE_ROUNDS):
        topics = _moved(sketches, topics)
    topics = Topics(idf, _in_line(topics.centres))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            cell = pa.array(topics.cells(_read_sketches(batch)), pa.int32())
            yield pa.record_batch([batch.column("n"), cell], ["n", "cell"])

    placed = sketches.mapInArrow(cells, "n long, cell int").groupBy("cell").agg(F.sum("n").alias("n"))
    return topics, {r["cell"]: r["n"] for r in placed.collect()}


def shards_of_cells(tokens: dict[int, int], shard_tokens: int) -> dict[int, tuple[int, int]]:
    """First shard and number of shards of each cell: neighbouring cells share a shard of about
    `shard_tokens` tokens, a cell with more is split."""
    out: dict[int, tuple[int, int]] = {}
    shard = filled = 0
    for cell in sorted(tokens):
        n = tokens[cell]
        if filled and filled + n > 1.25 * shard_tokens:
            shard, filled = shard + 1, 0
        parts = max(1, round(n / shard_tokens))
        out[cell] = shard, parts
        shard += parts - 1
        filled = shard_tokens * 2 if parts > 1 else filled + n
    return out


class Shard:
    """A BM25 index over the remainders of one shard's documents."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray) -> None:
        n, size = len(texts), len(idf)
        lengths = np.array([len(t) for t in texts], np.float64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lengths.astype(np.int64))
        pairs, tf = np.unique(owner * size + np.concatenate(texts), return_counts=True)
        doc, term = pairs // size, pairs % size
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(size + 1))
        # Common terms: a matrix (at most pairs / COMMON numbers).  All others: postings.
        common = np.flatnonzero(np.diff(first) > max(1.0, COMMON * n))
        row = np.full(size, -1, np.int64)
        row[common] = np.arange(len(common))
        self.matrix = np.zeros((n, len(common)), np.float32)
        often = row[term] >= 0
        self.matrix[doc[often], row[term[often]]] = weight[often]
        self.doc, self.weight, self.first = doc[by_term], weight[by_term], first
        begin = np.searchsorted(doc, np.arange(n + 1))
        self.terms = [term[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        self.row, self.n = row, n

    def common_scores(self, seeds: list[int], unused: np.ndarray) -> dict[int, np.ndarray]:
        """What the common terms of each seed add to the unused documents."""
        has = np.zeros((len(seeds), self.matrix.shape[1]), np.float32)
        for i, seed in enumerate(seeds):
            rows = self.row[self.terms[seed]]
            has[i, rows[rows >= 0]] = 1
        out = np.zeros((len(seeds), self.n), np.float32)
        out[:, unused] = np.einsum("bt,nt->bn", has, self.matrix[unused])
        return dict(zip(seeds, out, strict=True))

    def neighbours(self, seed: int, unused: np.ndarray, common: np.ndarray | None = None) -> Iterator[int]:
        """Unused documents by descending score over all terms; those that share no term come last, in order."""
        terms = self.terms[seed]
        rare = terms[self.row[terms] < 0]
        score = (self.common_scores([seed], unused)[seed] if common is None else common).astype(np.float64)
        if len(rare):
            spans = [slice(a, b) for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist(), strict=True)]
            score += np.bincount(
                np.concatenate([self.doc[s] for s in spans]),
                np.concatenate([self.weight[s] for s in spans]),
                minlength=self.n,
            )
        left = np.flatnonzero(unused)
        # rounded, so that the order does not hang on how a machine adds
        worst = -np.round(score[left], 3)
        if len(left) <= 2 * HEAD:
            return chain(left[np.argsort(worst, kind="stable")].tolist())
        head = worst <= np.partition(worst, HEAD)[HEAD]
        return chain.from_iterable(self._ordered(left, worst, part) for part in (head, ~head))

    @staticmethod
    def _ordered(left: np.ndarray, worst: np.ndarray, part: np.ndarray) -> Iterator[int]:
        yield from left[part][np.argsort(worst[part], kind="stable")].tolist()


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of one shard.

    Whole windows are cut from long documents first.  Then the unused document with the
    longest remainder is the seed of a window, and its neighbours fill it in order of their
    scores over all its terms; the one that doesn't fit is cut there, and its rest remains unused.  What is
    left at the end is dealt into sequences of power-of-two lengths, which need no padding.
    """
    out: list[tuple[int, int, int, int, int]] = []
    done = np.zeros(len(ids), np.int64)
    size = np.array([len(x) for x in ids], np.int64)
    sequence = 0
    for d in range(len(ids)):
        while size[d] - done[d] >= window:
            out.append((d, int(done[d]), window, sequence, 0))
            done[d] += window
            sequence += 1
    unused = size > done
    items = np.flatnonzero(unused)
    if not len(items):
        return out
    place = {int(d): i for i, d in enumerate(items)}
    index = Shard([ids[d][done[d] :] for d in items], idf)
    free = np.ones(len(items), bool)
    tail: list[tuple[int, int, int]] = []
    left = int((size - done).sum())
    seeds = sorted((int(d) for d in items), key=lambda d: (done[d] - size[d], d))
    ahead: dict[int, np.ndarray] = {}
    block = max(1, min(64, BLOCK // len(items)))
    for turn, seed in enumerate(seeds):
        if not free[place[seed]]:
            continue
        if place[seed] not in ahead:
            waiting = (place[d] for d in seeds[turn:] if free[place[d]])
            ahead = index.common_scores(list(islice(waiting, block)), free)
        last = left < window
        room = left if last else window
        filled: list[tuple[int, int, int]] = []

        def take(d: int) -> None:
            nonlocal room
            n = int(min(room, size[d] - done[d]))
            filled.append((d, int(done[d]), n))
            done[d] += n
            room -= n
            free[place[d]] = size[d] > done[d]

        take(seed)
        if room:
            for i in index.neighbours(place[seed], free, ahead[place[seed]]):
                take(int(items[i]))
                if not room:
                    break
        if last:
            tail = filled
            break
        offset = 0
        for d, start, n in filled:
            out.append((d, start, n, sequence, offset))
            offset += n
        sequence += 1
        left -= window
    else:
        # Documents cut after their turn as a seed are what remains.
        tail = [(int(items[i]), int(done[items[i]]), int(size[items[i]] - done[items[i]])) for i in np.flatnonzero(free)]
    room = offset = 0
    rest = sum(n for _, _, n in tail)
    for d, start, n in tail:
        while n:
            if not room:
                room = window if rest >= window else 1 << (rest.bit_length() - 1)
                rest -= room
                sequence += bool(offset)
                offset = 0
            cut = min(room, n)
            out.append((d, start, cut, sequence, offset))
            start, n, room, offset = start + cut, n - cut, room - cut, offset + cut
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """All documents packed into sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: one piece with the end id alone.  Null ids and repeated rows are
    packed like other rows, each row by itself.  Document frequencies are those of all
    documents; each shard holds about `shard_tokens` tokens of documents of like content and
    is one inverted index.  An empty table gives no pieces.  Further columns are not read.
    """
    rows, idf = dealt(docs, tokenizer_path, id_col, text_col, shard_tokens)
    kind = "<u2" if len(idf) <= 1 << 16 else "<u4"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done_with_held()
        order = sorted(range(len(frame)), key=lambda i: (frame["k"].iat[i], frame["ids"].iat[i]))
        ids = [np.frombuffer(frame["ids"].iat[i], kind).astype(np.int64) for i in order]
        named, shard = frame["doc_id"].array, int(frame["shard"].iat[0])
        got = pack_shard(ids, idf, window)
        return pd.DataFrame(
            {
                "doc_id": pd.array([named[order[d]] for d, *_ in got], "Int64"),
                "start": [s for _, s, *_ in got],
                "length": [n for _, _, n, *_ in got],
                "ids_crc32": [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, *_ in got],
                "doc_tokens": [len(ids[d]) for d, *_ in got],
                "sequence_id": [(shard << 32) + q for *_, q, _ in got],
                "offset": [o for *_, o in got],
            }
        )

    return rows.groupBy("shard").applyInPandas(run, PIECES)


def dealt(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, k, ids, shard) of every row, and the weight of each id.

    Shards follow content, so that a document's neighbours are mostly in its own.  Repeated
    rows of one id are spread over the shards of their cell."""
    made = written(tokenised(docs, tokenizer_path, id_col, text_col), "token-ids")
    idf = inverse_frequencies(made)
    topics, sizes = fit_topics(made, idf, shard_tokens)
    rows = made.where("ids IS NOT NULL").select("doc_id", "ids", "again")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            cell = pa.array(topics.cells(_sketched(batch, idf)), pa.int32())
            yield pa.record_batch([*batch.columns, cell], ["doc_id", "ids", "again", "cell"])

    if len(topics.centres) > 1:
        rows = rows.mapInArrow(place, "doc_id long, ids binary, again long, cell int")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    places = [(cell, *at) for cell, at in shards_of_cells(sizes, shard_tokens).items()]
    table = docs.sparkSession.createDataFrame(places, "cell int, first long, parts long")
    spread = F.pmod(F.xxhash64("doc_id", F.crc32("ids"), "again"), F.col("parts"))
    # at most 2^BITS cells of at most TOPICS topics
    joined = rows.join(F.broadcast(table), "cell")
    return (
        joined.select(
            "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "ids", (F.col("first") + spread).alias("shard")
        ),
        idf,
    )
