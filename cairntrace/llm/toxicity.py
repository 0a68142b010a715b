"""Toxicity of texts: a noisy-channel decoder undoes disguises of words, then the words are scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairntrace.llm.batches import Kinds, forget, held, steps, word_steps
from cairntrace.llm.common import written

#: Symbols of the character model: a blank for what is no letter, a to z, and a byte of any other letter.
SYMBOLS = 28
STATES = SYMBOLS**3
#: Words whose features a worker remembers.
REMEMBERED = 120_000
#: Rows of the labelled sample that calibrate the score; the others find the words.
CALIBRATE = 3
#: Labelled toxic documents in which a word or prefix must occur, and in how many of them at least
#: written together: only such words are looked for in letters written apart.
SUPPORT = 6
TOGETHER = 3

# What characters are written for which letters.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "+": "t", "|": "li", "€": "e", "£": "l", "(": "c", "*": "aeiou",
}
#: Characters that may stand between the letters of a disguised word.
GAPS = ".-_*~'`·,/"
#: Log probabilities of writing a letter as a look-alike, of a gap, and of a lengthened letter.
WRITE_AS, WRITE_GAP, WRITE_LONG = -1.5, -0.7, -0.5

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = SYMBOLS - 1
_SYMBOL_OF = _SYMBOL.tolist()
_EDGE = re.compile(r"^[^\w@$!+|€£(*]+|[\W_]+$")
_BEFORE = re.compile(r"^[\W_]+")
#: What follows a word and may be part of it.
_TAIL = re.compile("[" + re.escape("".join(dict.fromkeys([*LOOKS, *GAPS]))) + "]*")
#: Characters that stand for no letter and no gap: they part words.
_NONE = re.compile(r"(?:[\W\d_](?<![" + re.escape("".join(dict.fromkeys([*LOOKS, *GAPS]))) + "]))+")
_GAPS_ONLY = "".join(c for c in GAPS if c not in LOOKS)
_ODD = re.compile(r"[^\W\d_]")
_LONG = re.compile(r"(.)\1\1")
#: Punctuation that after a word neither stands for a letter nor is part of one: ASCII without look-alikes.
_PLAIN_TAIL = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in LOOKS).encode()


@dataclass(frozen=True)
class CharModel:
    """Exact counts of every four symbols in a row, by their number in base SYMBOLS: each has a place of its own."""

    fours: np.ndarray

    def __reduce__(self) -> tuple:
        return CharModel, (self.fours,)

    @cached_property
    def logs(self) -> memoryview:
        """Log probability of the fourth symbol after the three before it; unseen ones fall back on the symbol's share."""
        fours = self.fours.reshape(STATES, SYMBOLS).astype(np.float64)
        ones = fours.sum(0)
        prior = (ones + 1) / (ones.sum() + SYMBOLS)
        return memoryview(np.log((fours + 4 * prior) / (fours.sum(1, keepdims=True) + 4)).ravel())


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts over every text of `docs`: tasks sum their own, Spark adds them up by symbols.

    At most SYMBOLS^4 = 614,656 counts, the proven bound of what reaches the driver and the workers."""
    size = SYMBOLS**4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(size, np.int64)
        for _, texts in steps(batches):
            raw = b"\n" + b"\n".join(texts) + b"\n"
            x = np.frombuffer(raw.translate(_SYMBOL.tobytes()), np.uint8)
            if len(x) >= 4:
                pairs = x[:-1] * np.int16(SYMBOLS) + x[1:]
                total += np.bincount(pairs[:-2] * np.int64(SYMBOLS**2) + pairs[2:], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["four", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(count, "four int, n long").groupBy("four").agg(F.sum("n").alias("n")).toArrow()
    fours = np.zeros(size, np.int64)
    fours[counts["four"].to_numpy()] = counts["n"].to_numpy()
    return CharModel(fours)


def _lattice(token: str) -> tuple[list[list[tuple[str, float]]], list[int]] | None:
    """Per written character or run of one letter: what may have been meant, with log probabilities;
    and where each begins (with the end)."""
    out: list[list[tuple[str, float]]] = []
    begins = [0]
    i, n = 0, len(token)
    while i < n:
        c = token[i]
        j = i + 1
        while j < n and token[j] == c:
            j += 1
        if c.isalpha():
            out.append([(c, WRITE_LONG), (c * 2, WRITE_LONG)] if j - i > 2 else [(c * (j - i), 0.0)])
            i = j
            begins.append(i)
            continue
        long = j - i > 2
        j = j if long else i + 1
        meant = [(x, WRITE_AS - math.log(len(LOOKS[c]))) for x in LOOKS.get(c, "")]
        if long:
            meant = [(x * n, p + WRITE_LONG) for x, p in meant for n in (1, 2)]
        if c in GAPS and 0 < i and j < n:
            meant.append(("", WRITE_GAP))
        if not meant:
            return None
        out.append(meant)
        i = j
        begins.append(i)
    return out, begins


def _text(node: tuple | None, until: tuple | None = None) -> str:
    """The letters noted from `until` (or the beginning) to `node`."""
    parts = []
    while node is not until:
        node, letters = node
        parts.append(letters)
    return "".join(reversed(parts))


def _earlier(a: tuple, b: tuple) -> bool:
    """Whether the text of `a` comes before that of `b`; both have as many nodes."""
    x, y = a, b
    while x is not y:
        x, y = x[0], y[0]
    return _text(a, x) < _text(b, x)


def _step(best: dict, meant: list[tuple[str, float]], model: CharModel) -> dict:
    """The best ways to each state, (score, (way before, letters)), after one more place of the lattice."""
    reached: dict[int, tuple[float, tuple]] = {}
    logs = model.logs
    options = [(letters, cost, [_SYMBOL_OF[b] for b in letters.encode()]) for letters, cost in meant]
    for state, (score, before) in best.items():
        for letters, cost, symbols in options:
            s, total = state, score + cost
            for x in symbols:
                four = s * SYMBOLS + x
                total += logs[four]
                s = four % STATES
            old = reached.get(s)
            # ties go to the word that comes first
            if old is None or total > old[0] or (total == old[0] and _earlier((before, letters), old[1])):
                reached[s] = (total, (before, letters))
    return reached


def _decoded(token: str, model: CharModel, least: int) -> list[str]:
    """The likeliest words behind a written token that ends at each of its places from `least` on:
    Viterbi over its lattice, the last three symbols being the state.  Its time grows with the length;
    there are no words if a character can stand for no letter."""
    lattice = _lattice(token)
    if lattice is None:
        return []
    words: list[str] = []
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for meant, end in zip(lattice[0], lattice[1][1:], strict=True):
        best = _step(best, meant, model)
        if end >= least:
            ways = list(_step(best, [(" ", 0.0)], model).values())
            top = max(score for score, _ in ways)
            words.append(max(_text(way) for score, way in ways if score == top).strip())
    return words


def restore(token: str, model: CharModel) -> str | None:
    """The likeliest word behind a written token; None if a character can stand for no letter."""
    words = _decoded(token, model, len(token))
    return words[-1] if words else None


def disguised(token: str) -> bool:
    """Letters mixed with look-alikes or gaps, or a letter three times in a row."""
    if not _ODD.search(token) or token.count("@") and "." in token.rpartition("@")[2]:
        return False
    if token.isalpha():
        return bool(_LONG.search(token))
    return any(c in LOOKS or c in GAPS for c in token) or bool(_LONG.search(token))


def plain_word(piece: str, model: CharModel) -> str:
    """The word a white-space-separated piece stands for, in lower case and without its punctuation."""
    token = _EDGE.sub("", piece.lower())
    if token and disguised(token):
        return restore(token, model) or token
    return token


def words_of(piece: str, model: CharModel) -> list[str]:
    """The words a piece may stand for: `plain_word`, and those in which look-alikes before it are no
    letters, or ones after it are."""
    low = piece.lower()
    token = _EDGE.sub("", low)
    words = [plain_word(piece, model)]
    if not token:
        return words
    tail = _TAIL.match(low, low.index(token) + len(token)).group().rstrip(_GAPS_ONLY)
    bare = _BEFORE.sub("", token)
    if bare != token:
        words.append(plain_word(bare, model))
    for start in dict.fromkeys((token, bare)):
        if tail and disguised(start + tail):
            words += _decoded(start + tail, model, len(start) + 1)
    return list(dict.fromkeys(words))


def words_of_raw(piece: bytes, model: CharModel) -> list[str]:
    """`words_of` the UTF-8 of a piece; letters or digits alone, before plain punctuation, stand for themselves."""
    core = piece.rstrip(_PLAIN_TAIL)
    if core.isdigit():
        return [core.decode()]
    low = core.decode().lower()
    if low.isalpha() and not _LONG.search(low):
        return [low]
    return words_of(piece.decode(), model)


class Finder:
    """Finds features in letters written apart, where one word ends and the next begins not being told:
    one pass of an Aho-Corasick automaton over a run, in memory of the features' size whatever the run's."""

    def __init__(self, features: Collection[str]) -> None:
        words: dict[str, list[str | None]] = {}
        for f in features:
            prefix = f.endswith("-")
            words.setdefault(f.removesuffix("-"), [None, None])[prefix] = f
        self.automaton = ahocorasick.Automaton() if words else None
        for word, found in words.items():
            self.automaton.add_word(word, found)
        if words:
            self.automaton.make_automaton()

    def features(self, runs: list[str]) -> set[str]:
        """Words in the runs, and prefixes that one more letter follows."""
        out: set[str | None] = set()
        for run in runs if self.automaton is not None else []:
            for end, (word, prefix) in self.automaton.iter(run):
                out.add(word)
                if end + 1 < len(run):
                    out.add(prefix)
        out.discard(None)
        return out


def features_of(word: str) -> list[str]:
    """A word and its prefixes of four and five letters."""
    if len(word) < 3:
        return []
    return list(dict.fromkeys([word, *(word[:n] + "-" for n in (4, 5) if len(word) > n)]))


@dataclass
class Reader:
    """Per worker: remembered pieces and their feature numbers."""

    model: CharModel
    known: dict[bytes, int] = field(default_factory=dict)
    words: list[list[str]] = field(default_factory=list)

    def read(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Per text: numbers of its pieces' words, and the runs of letters behind those written apart."""
        batch = pa.record_batch([pa.array(texts, pa.binary()).cast(pa.string())], ["text"])
        for _, per_text, which, kinds in word_steps(iter([batch]), lower=False):
            numbers, apart = self.read_step(per_text, which, kinds)
            for at, some in enumerate(np.split(numbers, np.cumsum(per_text)[:-1])):
                yield some, apart.get(at, [])

    def read_step(self, per_text: np.ndarray, which: np.ndarray, kinds: Kinds) -> tuple[np.ndarray, dict[int, list[str]]]:
        """Of a step as `word_steps` gives it: numbers of the words of all pieces, one text after the other; and
        for the texts that have any, by their places, the runs of letters behind those written apart."""
        if len(self.words) > REMEMBERED:
            self.known, self.words = {}, []
        known = self.known
        pieces = kinds.words()
        numbers = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = [i for i in np.flatnonzero(numbers < 0).tolist() if pieces[i]]
        first = len(self.words)
        self.words += [words_of_raw(pieces[i], self.model) for i in missing]
        known.update(zip([pieces[i] for i in missing], range(first, len(self.words)), strict=True))
        numbers[missing] = np.arange(first, len(self.words))
        # "i d i o t": three single characters in a row, at least
        single = np.flatnonzero(kinds.sizes[which] == 1)
        owner = np.searchsorted(np.cumsum(per_text), single, side="right")
        apart: dict[int, list[str]] = {}
        cuts = np.flatnonzero((np.diff(single) > 1) | (np.diff(owner) > 0)) + 1
        ends = [0, *cuts.tolist(), len(single)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a < 3:
                continue
            token = "".join([pieces[i].decode() for i in which[single[a:b]].tolist()]).lower()
            for part in _NONE.split(token):
                part = part.strip(_GAPS_ONLY)
                word = restore(part, self.model) if len(part) > 2 and _ODD.search(part) else None
                if word:
                    apart.setdefault(int(owner[a]), []).append(word)
        return numbers[which], apart


@dataclass(frozen=True)
class Scorer:
    """Evidence per word or prefix, and the curve from summed evidence to a probability."""

    model: CharModel
    evidence: dict[str, float]
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, evidence: float) -> float:
        z = max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.offset))
        return 1 / (1 + math.exp(-z))


def lower_bound(right: float, total: float, z: float = 2.5) -> float:
    """Wilson's lower bound of a share."""
    if not total:
        return 0.0
    p = right / total
    return max(0.0, (p + z * z / (2 * total) - z * math.sqrt(p * (1 - p) / total + z * z / (4 * total**2))) / (1 + z * z / total))


def _reader(model: CharModel) -> Reader:
    """One per worker process and model; a model is told by its counts."""
    return held(("reader", hash(model.fours.tobytes())), lambda: Reader(model))


def _frequencies(sample: DataFrame, model: CharModel) -> DataFrame:
    """(feature, toxic, clean): documents of the sample in which each feature occurs.

    Equal texts count once, or a much-copied document would make evidence of all its words.
    First the words written together are counted; those in TOGETHER toxic texts or more are
    then looked for in the texts that hold letters written apart."""
    columns = ["feature", "toxic", "clean", "y", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = [names, [counts[1][n] for n in names], [counts[0][n] for n in names], *[[None] * len(names)] * 2]
        for c in counts:
            c.clear()
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], columns)

    def together(reader: Reader, numbers: np.ndarray) -> set[str]:
        return {f for w in {w for i in set(numbers.tolist()) for w in reader.words[i]} for f in features_of(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, per_text, which, pieces in word_steps(batches, lower=False):
            labels = batch.column(1).to_pylist()
            numbers, apart = reader.read_step(per_text, which, pieces)
            for y, some in zip(labels, np.split(numbers, np.cumsum(per_text)[:-1]), strict=True):
                counts[y].update(together(reader, some))
            spaced = sorted(apart)
            none = [[None] * len(spaced)] * 3
            again = [*none, [labels[i] for i in spaced], [batch.column(0)[i].as_py() for i in spaced]]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(again, kinds, strict=True)], columns)
            if len(counts[0]) + len(counts[1]) > REMEMBERED:
                yield counted(counts)
        yield counted(counts)

    distinct = sample.groupBy("text").agg(F.max("y").alias("y"))
    schema = "feature string, toxic long, clean long, y int, text string"
    made = written(distinct.mapInArrow(run, schema), "words-together")
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    whole = made.where("feature IS NOT NULL").groupBy("feature").agg(*sums)
    # bounded by the sample: each was met in TOGETHER of its toxic texts
    known = [r["feature"] for r in whole.where(F.col("toxic") >= TOGETHER).select("feature").collect()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, finder = _reader(model), Finder(known)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, per_text, which, pieces in word_steps(batches, lower=False):
            labels = batch.column(0).to_pylist()
            numbers, apart = reader.read_step(per_text, which, pieces)
            for at, some in enumerate(np.split(numbers, np.cumsum(per_text)[:-1])):
                if at in apart:
                    counts[labels[at]].update(finder.features(apart[at]) - together(reader, some))
        yield counted(counts).select(columns[:3])

    spaced = made.where("text IS NOT NULL").select("y", "text").mapInArrow(look, "feature string, toxic long, clean long")
    return whole.unionByName(spaced).groupBy("feature").agg(*sums)


def _evidence(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """`rows` and their column `evidence`: summed over the distinct features of each `text` that carry any."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(scorer.model)
        known = scorer.evidence
        finder = Finder(known)
        prefixes = {f for f in known if f.endswith("-")}
        carry = np.zeros(0, bool)
        before = reader.words

        def carrying(word: str) -> list[str]:
            return [f for f in features_of(word) if f in known]

        def carries(words: list[str]) -> bool:
            return any(w in known or w[:4] + "-" in prefixes or w[:5] + "-" in prefixes for w in words)

        for batch, per_text, which, pieces in word_steps(batches, lower=False):
            numbers, apart = reader.read_step(per_text, which, pieces)
            if reader.words is not before:
                before, carry = reader.words, carry[:0]
            new = [carries(words) for words in reader.words[len(carry) :]]
            carry = np.concatenate([carry, np.array(new, bool)])
            ends = np.cumsum(per_text)
            hits = np.flatnonzero(carry[numbers])
            out = np.zeros(len(per_text))
            found: dict[int, set[str]] = {at: finder.features(runs) for at, runs in apart.items()}
            for at, i in zip(np.searchsorted(ends, hits, side="right").tolist(), numbers[hits].tolist(), strict=True):
                found.setdefault(at, set()).update(f for w in reader.words[i] for f in carrying(w))
            for at, features in found.items():
                out[at] = math.fsum(sorted(known[f] for f in features))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], [*names, "evidence"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("evidence", DoubleType())]))


def fit(sample: DataFrame, model: CharModel) -> Scorer:
    """Learn from a bounded sample (doc_id, text, y in 0/1).

    Two thirds of it, by a hash of the id, tell which words and prefixes are evidence: those in
    at least SUPPORT toxic texts (TOGETHER of them with it written together) with a lower bound of their toxic share above one half.  The
    evidence of one is -log(1 - bound).  The last third fits the logistic curve of the score.
    Without labels of both kinds every score is the share of toxic rows (0 without rows).
    """
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE))
    counts = _frequencies(sample.where(part != 0), model).where(F.col("toxic") >= SUPPORT)
    evidence = {}
    for r in counts.where("toxic > clean").collect():
        bound = lower_bound(r["toxic"], r["toxic"] + r["clean"])
        if bound > 0.5:
            evidence[r["feature"]] = -math.log(1 - bound)
    scorer = Scorer(model, evidence)
    curve = sample.where(part == 0)
    seen = _evidence(curve.select("text", "y"), scorer).select("evidence", "y").collect()
    x = np.array([math.log1p(r["evidence"]) for r in seen])
    y = np.array([r["y"] for r in seen], float)
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.001
        return Scorer(model, evidence, 0.0, math.log(share / (1 - share)))
    # Penalised logistic regression with one input, by Newton's steps.
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * w * np.array([1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Scorer(model, evidence, float(w[0]), float(w[1]))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` and the column `score_col` (0 to 1; replaced if there is one), row by row.

    Null texts count as empty: no evidence, the lowest score.  Words written with look-alikes,
    with gaps, letter by letter or with lengthened letters count as the words they stand for.
    Texts are read whole; repeated rows are scored alike.
    """
    columns = [c for c in docs.columns if c != score_col]
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    plain = [F.col(c).alias(names[c]) for c in columns]
    text = F.col(text_col).cast("string").alias("text")
    if dict(docs.dtypes).get(text_col) == "string" and text_col in names:
        # a text that is kept goes to the workers and back once
        names[text_col] = "text"
        plain = [F.col(c).alias(names[c]) for c in columns if c != text_col]
    z = F.lit(scorer.slope) * F.log1p("evidence") + F.lit(scorer.offset)
    scored = _evidence(docs.select(*plain, text), scorer)
    return scored.select(*[F.col(names[c]).alias(c) for c in columns], (1 / (1 + F.exp(-z))).alias(score_col))


def train(docs: DataFrame, sample: DataFrame, text_col: str = "text") -> Scorer:
    """The character model of all `docs`, and the word evidence of a labelled sample."""
    model = char_model(docs, text_col)
    return fit(written(sample, "labelled"), model)
