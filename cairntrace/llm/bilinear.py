"""A log-bilinear neural language model, trained by noise-contrastive estimation.

The model's items are the end of a text, the most frequent words, and buckets that share out all
other words by their last bytes.  The vectors of the two items before a place, each through a matrix of
its own, add up to a prediction; an item's score is the product of the prediction with its output
vector, plus its bias.  Every pair of items is normalised once, over all items, by matrix products,
so that a token's probability costs three look-ups.  A word inside its bucket has the probability of
its count, plus one, among those of the bucket's words and of one unseen word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import Kinds, held, word_steps
from cairntrace.llm.common import NO_ID, held_out, written

#: Words with an item of their own, and buckets of all others.
WORDS, BUCKETS = 1151, 384
ITEMS = 1 + WORDS + BUCKETS
#: Words whose counts every task knows, and bytes of such a word at most; all others meet their counts in a join.
FREQUENT, FREQUENT_BYTES = 65_536, 256
#: Length of a vector, noise items and tokens of a training step, rounds after which tasks' models are averaged.
WIDTH, NOISE, BATCH, ROUNDS = 24, 128, 4096, 2
RATE = 0.1
#: Tokens that are held against the noise at once.
PIECE = 512
#: Distinct words that a task counts at once.
REMEMBERED = 300_000
#: Sums of many tasks are taken in these fractions, so that they don't depend on an order.
FRACTION = 4096
#: Logarithms of counts are summed in these fractions.
FINE = float(2**40)

END = b""


def bucket_of(word: bytes) -> int:
    """Told by the last three bytes."""
    last = int.from_bytes(word[-3:], "big")
    return (last * 2654435761 & 0xFFFFFFFF) % BUCKETS


def buckets_of(kinds: Kinds) -> np.ndarray:
    """`bucket_of` of each word."""
    last = np.zeros(len(kinds.sizes), np.uint64)
    for back in (3, 2, 1):
        at = kinds.ends - back
        byte = kinds.raw[np.maximum(at, 0)] if len(kinds.raw) else np.zeros(len(at), np.uint8)
        last = last * np.uint64(256) + np.where(kinds.sizes >= back, byte, 0).astype(np.uint64)
    return ((last * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) % np.uint64(BUCKETS)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, bucket, c): how often each lower-cased word occurs, and the end as the empty word; counted
    in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = list(counts)
            buckets = [bucket_of(w) if w else -1 for w in words]
            made = [pa.array(words, pa.binary()), pa.array(buckets, pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.record_batch(made, ["word", "bucket", "n"])

        for _, sizes, which, kinds in word_steps(batches):
            met = np.bincount(which, minlength=len(kinds.sizes)).tolist()
            counts.update({w: n for w, n in zip(kinds.words(), met, strict=True) if n})
            counts[END] += len(sizes)
            if len(counts) > REMEMBERED:
                yield rows()
        if counts:
            yield rows()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    made = texts.mapInArrow(count, "word binary, bucket int, n long")
    return made.groupBy("word", "bucket").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """The frequent words by falling count, and what the counts come to."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    types: int
    bucket_tokens: np.ndarray
    bucket_types: np.ndarray
    #: Shorter words with this count or more are in `words`.
    least: int
    told_by: tuple[int, int, int]

    def known_here(self, word: Column, c: Column) -> Column:
        return (c >= self.least) & (F.octet_length(word) <= FREQUENT_BYTES)


def _size_class(c: Column) -> Column:
    """A number that grows with a count, exact up to 1024, and takes some thousand values at most."""
    return F.when(c <= 1024, c).otherwise(F.floor(F.log2(c) * 64) + (1024 - 640)).cast("long")


def lexicon(counts: DataFrame) -> Lexicon:
    """The words of the largest counts, FREQUENT at most, words of one count together; and the totals."""
    short = (F.octet_length("word") <= FREQUENT_BYTES) & (F.col("bucket") >= 0)
    sizes = (
        counts.groupBy(_size_class(F.col("c")).alias("k"))
        .agg(F.count_if(short).alias("n"), F.min("c").alias("c"), F.sum("c").alias("t"), F.count(F.lit(1)).alias("v"))
        .orderBy(F.col("k").desc())
        .collect()
    )
    held_words, least = 0, (max((r["c"] for r in sizes), default=0)) + 1
    for r in sizes:
        held_words += r["n"]
        if held_words > FREQUENT:
            break
        least = r["c"]
    by_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).collect()
    tokens, types, ends = np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    for r in by_bucket:
        if r["bucket"] < 0:
            ends = r["t"]
        else:
            tokens[r["bucket"]], types[r["bucket"]] = r["t"], r["v"]
    rows = counts.where(short & (F.col("c") >= least)).select("word", "c").collect()
    rows.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in rows]
    for r in rows[:WORDS]:
        b = bucket_of(bytes(r["word"]))
        tokens[b] -= r["c"]
        types[b] -= 1
    totals = sum(r["t"] for r in sizes), sum(r["v"] for r in sizes)
    known = np.array([r["c"] for r in rows], np.int64)
    told_by = (zlib.crc32(b" ".join(words)), zlib.crc32(known.tobytes()), zlib.crc32(tokens.tobytes() + types.tobytes()))
    return Lexicon(words, known, ends, *totals, tokens, types, least, told_by)


def unigrams(lex: Lexicon) -> np.ndarray:
    """Share of each item among the tokens, each with one more."""
    counts = np.zeros(ITEMS)
    counts[0] = lex.ends
    own = lex.counts[:WORDS]
    counts[1 : 1 + len(own)] = own
    counts[1 + WORDS :] = lex.bucket_tokens
    return (counts + 1) / (counts.sum() + ITEMS)


@dataclass
class Bilinear:
    """Input vectors, output vectors, biases, and the matrices of the item before and of the one before that."""

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    PARTS = ("inputs", "outputs", "bias", "near", "far")

    @staticmethod
    def fresh(shares: np.ndarray, seed: int = 1) -> Bilinear:
        rng = np.random.default_rng(seed)
        vectors = [rng.normal(0, 0.1, (ITEMS, WIDTH)).astype(np.float32) for _ in range(2)]
        eye = np.eye(WIDTH, dtype=np.float32)
        return Bilinear(*vectors, np.log(shares).astype(np.float32), eye.copy(), 0.5 * eye)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS]).astype(np.float64)

    @staticmethod
    def of(flat: np.ndarray) -> Bilinear:
        shapes = [(ITEMS, WIDTH), (ITEMS, WIDTH), (ITEMS,), (WIDTH, WIDTH), (WIDTH, WIDTH)]
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        parts = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, cuts), shapes, strict=True)]
        return Bilinear(*parts)

    def predicted(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return self.inputs[near] @ self.near + self.inputs[far] @ self.far

    def normaliser(self, far: int) -> np.ndarray:
        """Per item before: the logarithm of the summed exponentials of all items' scores."""
        s = self.inputs @ self.near + self.inputs[far] @ self.far
        s = s @ self.outputs.T + self.bias
        top = s.max(axis=1, keepdims=True)
        return (top[:, 0] + np.log(np.exp(s - top).sum(axis=1))).astype(np.float32)


def _rows_summed(which: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per item the sum of its rows."""
    columns = [np.bincount(which, rows[:, i], minlength=ITEMS) for i in range(rows.shape[1])]
    return np.stack(columns, 1).astype(np.float32)


class Trainer:
    """Noise-contrastive steps from a model on, each parameter at its own falling rate."""

    def __init__(self, model: Bilinear, shares: np.ndarray) -> None:
        self.model = Bilinear(*[getattr(model, p).copy() for p in Bilinear.PARTS])
        self.shares = shares
        self.offset = np.log(NOISE * shares).astype(np.float32)
        self.seen = {p: np.full_like(getattr(self.model, p), 1.0) for p in Bilinear.PARTS}
        # small and written again and again: fresh memory for a whole batch costs more than its products
        self.by_noise = np.empty((PIECE, NOISE), np.float32)

    def step(self, target: np.ndarray, near: np.ndarray, far: np.ndarray, noise: np.ndarray) -> None:
        """One batch: each target is told apart from the batch's noise items, drawn by their shares."""
        m = self.model
        q, qn = m.outputs.take(target, axis=0), m.outputs[noise]
        r = (m.inputs @ m.near).take(near, axis=0) + (m.inputs @ m.far).take(far, axis=0)
        s = np.einsum("ij,ij->i", r, q) + (m.bias - self.offset).take(target)
        g = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        dr = g[:, None] * q
        # a column of ones lets the products take in the biases, and sum up their slopes
        ones = np.concatenate([r, np.ones((len(r), 1), np.float32)], 1)
        negative = -np.concatenate([qn, (m.bias - self.offset)[noise][:, None]], 1).T
        of_noise = np.zeros((NOISE, WIDTH + 1), np.float32)
        for i in range(0, len(r), PIECE):
            part = ones[i : i + PIECE]
            gn = self.by_noise[: len(part)]
            np.matmul(part, negative, out=gn)
            with np.errstate(over="ignore"):
                np.exp(gn, out=gn)
            gn += 1
            np.divide(np.float32(-1), gn, out=gn)
            dr[i : i + PIECE] += gn @ qn
            of_noise += gn.T @ part
        outputs = _rows_summed(target, g[:, None] * r)
        np.add.at(outputs, noise, of_noise[:, :-1])
        bias = np.bincount(target, g, minlength=ITEMS) + np.bincount(noise, of_noise[:, -1], minlength=ITEMS)
        by_near, by_far = _rows_summed(near, dr), _rows_summed(far, dr)
        inputs = by_near @ m.near.T + by_far @ m.far.T
        for part, slope in (
            ("inputs", inputs), ("outputs", outputs), ("bias", bias.astype(np.float32)), ("near", m.inputs.T @ by_near), ("far", m.inputs.T @ by_far),
        ):
            seen = self.seen[part]
            seen += slope * slope
            getattr(m, part)[...] += RATE * slope / np.sqrt(seen)


@dataclass
class Tokens:
    """Per worker: the frequent words' numbers, and what belongs to each number."""

    lex: Lexicon

    def __post_init__(self) -> None:
        n = len(self.lex.words)
        self.frequent = {w: i for i, w in enumerate(self.lex.words)}
        self.n = n
        items = np.arange(n + BUCKETS) + 1
        items[WORDS:n] = [1 + WORDS + bucket_of(w) for w in self.lex.words[WORDS:]]
        items[n:] = 1 + WORDS + np.arange(BUCKETS)
        self.items = items
        unseen = np.log10(self.lex.bucket_tokens + self.lex.bucket_types + 1)
        #: what a token's number adds to its text's scores besides the probability of its item
        self.log_c = np.concatenate([np.log10(self.lex.counts + 1.0), np.zeros(BUCKETS)])
        self.inside = np.where(items > WORDS, self.log_c - unseen[np.maximum(items - 1 - WORDS, 0)], 0.0)

    def numbers(self, kinds: Kinds) -> np.ndarray:
        """Numbers of words: of a frequent one its rank, of another its bucket after those."""
        found = np.fromiter(map(self.frequent.get, kinds.words(), repeat(-1)), np.int64, len(kinds.sizes))
        return np.where(found < 0, self.n + buckets_of(kinds), found)


def _contexts(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, near, far, starts) of texts whose words' items lie one after the other: each text ends in
    item 0, and before it lie two of them."""
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    target = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    inner = np.ones(len(target), bool)
    inner[ends - 1] = False
    target[inner] = items
    near = np.concatenate([[0], target[:-1]])[: len(target)]
    far = np.concatenate([[0], near[:-1]])[: len(target)]
    far[starts] = 0
    return target, near, far, starts


def _tokens(lex: Lexicon) -> Tokens:
    return held(("bilinear", lex.told_by), lambda: Tokens(lex))


def _round(docs: DataFrame, lex: Lexicon, model: Bilinear, shares: np.ndarray, seed: int) -> Bilinear:
    """The model after every task trained it on its texts: the mean over the tasks, weighted by tokens."""
    begin = model.flat()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = Trainer(Bilinear.of(begin), shares), 0
        for _, sizes, which, kinds in word_steps(batches):
            reader = _tokens(lex)
            target, near, far, _ = _contexts(reader.items[reader.numbers(kinds)][which], sizes)
            rng = np.random.default_rng([seed, len(target), int(target.sum())])
            order = rng.permutation(len(target))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                trainer.step(target[at], near[at], far[at], rng.choice(ITEMS, NOISE, p=shares))
            n += len(target)
        if n:
            moved = np.rint((trainer.model.flat() - begin) * (n * FRACTION)).astype(np.int64)
            yield pa.record_batch([pa.array([moved.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["moved", "n"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(begin), np.int64), 0
        for frame in frames:
            for raw in frame["moved"]:
                total += np.frombuffer(raw, np.int64)
            n += int(frame["n"].sum())
        yield pd.DataFrame({"moved": [total.tobytes()], "n": [n]})

    kind = "moved binary, n long"
    sums = docs.select("text").mapInArrow(train, kind).repartition(8).mapInPandas(add, kind).collect()
    n = sum(r["n"] for r in sums)
    moved = sum((np.frombuffer(r["moved"], np.int64) for r in sums), np.zeros(len(begin), np.int64))
    return Bilinear.of(begin + moved / (n * FRACTION)) if n else model


def _normalisers(spark, model: Bilinear) -> np.ndarray:
    """[far, near]: the normaliser of each pair of items; ITEMS squared numbers, whatever the corpus."""
    flat = model.flat().astype(np.float32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Bilinear.of(flat)
        for frame in frames:
            yield pd.DataFrame({"far": frame["id"], "z": [m.normaliser(int(i)).tobytes() for i in frame["id"]]})

    rows = spark.range(0, ITEMS, 1, 48).mapInPandas(run, "far long, z binary").collect()
    out = np.zeros((ITEMS, ITEMS), np.float32)
    for r in rows:
        out[r["far"]] = np.frombuffer(r["z"], np.float32)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """A trained model with its counts: `counts` is a written table of all training words."""

    counts: DataFrame
    lex: Lexicon
    model: Bilinear
    normalisers: np.ndarray


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Learn from every text of `docs`, each in one of ROUNDS rounds, told by a hash of its id."""
    counts = written(word_counts(docs, text_col), "word-counts")
    lex = lexicon(counts)
    shares = unigrams(lex)
    model = Bilinear.fresh(shares)
    turn = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), F.lit(ROUNDS))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), turn.alias("turn"))
    for k in range(ROUNDS):
        model = _round(texts.where(F.col("turn") == k), lex, model, shares, k)
    return LanguageModel(counts, lex, model, _normalisers(docs.sparkSession, model))


class Looked:
    """Per worker: the products of all items with all predictions' parts."""

    def __init__(self, lm_model: Bilinear, normalisers: np.ndarray) -> None:
        m = lm_model
        self.near = (m.inputs @ m.near) @ m.outputs.T + m.bias
        self.far = (m.inputs @ m.far) @ m.outputs.T
        self.normalisers = normalisers

    def log_p(self, target: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        s = self.near[near, target].astype(np.float64) + self.far[far, target] - self.normalisers[far, near]
        return s / math.log(10)


def score(docs: DataFrame, lm: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out (a training row of crc32 modulo 7 isn't), n_tokens, n_known,
    train_tokens, base_score, score.

    Null texts count as empty: the end alone.  A null id counts as the empty text's.  Repeated rows are
    scored alike; further columns, whatever their names, are not read.  Without training texts all counts
    are 0, each token's base is log10(1), and all items are alike.  Words that aren't frequent meet
    their counts in a join by the word.
    """
    lex, id_type = lm.lex, docs.schema[id_col].dataType.simpleString()
    flat, z = lm.model.flat().astype(np.float32), lm.normalisers
    end_log = math.log10(lex.ends + 1)
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = Looked(Bilinear.of(flat), z)
        for batch, sizes, which, kinds in word_steps(batches):
            reader = _tokens(lex)
            numbers = reader.numbers(kinds)[which]
            target, near, far, starts = _contexts(reader.items[numbers], sizes)
            model = np.add.reduceat(looked.log_p(target, near, far), starts)
            bounds = np.concatenate([[0], np.cumsum(sizes)])

            def per_text(values: np.ndarray, bounds: np.ndarray = bounds) -> np.ndarray:
                sums = np.add.reduceat(np.concatenate([values, [0.0]]), bounds[:-1])
                return np.where(bounds[1:] > bounds[:-1], sums, 0.0)

            rare = np.flatnonzero(numbers >= reader.n)
            begins = np.searchsorted(rare, bounds)
            words = pa.ListArray.from_arrays(
                pa.array(begins, pa.int32()), kinds.column.take(pa.array(which[rare]))
            )
            values = [
                pa.array(sizes + 1, pa.int64()),
                pa.array(sizes - np.diff(begins) + (lex.ends > 0), pa.int64()),
                pa.array(per_text(reader.log_c[numbers]) + end_log, pa.float64()),
                pa.array(model + per_text(reader.inside[numbers]), pa.float64()),
                words,
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *values], ["key", "id", "n_tokens", "known", "log_c", "model", "rare"]
            )

    schema = f"key long, id {id_type}, n_tokens long, known long, log_c double, model double, rare array<binary>"
    made = written(rows.mapInArrow(run, schema), "lm-texts")
    counted = lm.counts.where((F.col("bucket") >= 0) & ~lex.known_here(F.col("word"), F.col("c"))).select("word", "c")
    rare = (
        made.select("key", F.explode("rare").alias("word"))
        .join(counted, "word")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("more"), F.sum(F.rint(F.log10(F.col("c") + 1) * FINE).cast("long")).alias("log_more"))
    )
    log_more = F.coalesce(F.col("log_more") / FINE, F.lit(0.0))
    return made.drop("rare").join(rare, "key", "left").select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), 7, 2).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more"), F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + log_more - F.col("n_tokens") * math.log10(lex.tokens + lex.types + 1)).alias("base_score"),
        (F.col("model") + log_more).alias("score"),
    )
