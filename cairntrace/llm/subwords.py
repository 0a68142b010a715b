"""Subword pieces by seeded merge-dropout over a SentencePiece merge model, and their decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairntrace.llm.batches import IdStore, held, mixed, mixed_int, steps
from cairntrace.llm.common import NO_ID

SPACE = "▁"
#: Words that a worker remembers.
REMEMBERED = 120_000
#: Words that a task works on at once.
AT_ONCE = 1 << 16
#: Longest word whose agenda is a plain list.
SHORT = 48
#: Words of up to so many characters are merged side by side, each width by itself; fewer than FEW go one by one.
WIDTHS, FEW = (5, 7, 9, 12, 16, 24, SHORT), 32
#: An agenda's number of no candidate; others are rank * 2^AGENDA_BITS + place.
NO_CANDIDATE, AGENDA_BITS = np.iinfo(np.int32).max, 6
#: Bits of the buckets of pairs, and of the rank beside a pair.
BUCKET_BITS, RANK_BITS = 16, 20

_PIECE, _PLACE, _STIR, _ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, (1 << 64) - 1


def chance(key: int, piece: int, place: int) -> int:
    """A keyed 64-bit hash of a candidate merge."""
    x = key ^ (piece * _PIECE + place * _PLACE & _ALL)
    x = (x ^ (x >> 32)) * _STIR & _ALL
    x = (x ^ (x >> 29)) * _STIR & _ALL
    return x ^ (x >> 32)


def spots(piece: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What `chance` takes of a candidate."""
    return piece.astype(np.uint64) * np.uint64(_PIECE) + place.astype(np.uint64) * np.uint64(_PLACE)


def chances(key: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """`chance` of many candidates."""
    x = key ^ spot
    for shift in (32, 29):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(_STIR)
    x ^= x >> np.uint64(32)
    return x


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The lists of `n` words, one after the other, and where each ends, of parts (words, their lists, sizes)."""
    sizes = np.zeros(n, np.int64)
    for members, _, own in parts:
        sizes[members] = own
    ends = np.cumsum(sizes)
    flat = np.empty(int(sizes.sum()), kind)
    for members, values, own in parts:
        begins = ends[members] - own
        flat[np.repeat(begins - np.cumsum(own) + own, own) + np.arange(len(values))] = values
    return flat, ends


class MergeModel:
    """The merges, byte pieces and word boundaries of a SentencePiece file of merge type."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.text: list[str] = []
        self.bytes = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.by_rank = sorted(self.ids.values(), key=lambda i: (-sp.get_score(i), i))
        self.none = len(self.by_rank)
        place = {i: r for r, i in enumerate(self.by_rank)}
        self.rank = {piece: place[i] for piece, i in self.ids.items()}
        # Where no piece joins a letter to another character, no merge does, and texts may be cut there.
        letter = regex.compile(r"\p{L}")
        glue = set()
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                if SPACE not in (a, b) and bool(letter.match(a)) != bool(letter.match(b)):
                    glue.add(b if letter.match(a) else a)
        inner = r"\p{L}" + "".join(regex.escape(c, special_only=False) for c in sorted(glue))
        self.spaces_lead = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        self.cut = regex.compile(rf" *[{inner}]+| *[^{inner} ]+| +" if self.spaces_lead else r"(?s).+")

    def symbols(self, word: str) -> list[str]:
        """Characters; a space is the mark, a mark in the text itself is no vocabulary character."""
        return [SPACE if c == " " else ("\0" + c if c == SPACE else c) for c in word]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            got = self.ids.get(s)
            if got is not None:
                out.append(got)
            else:
                out.extend(self.bytes[b] for b in s.lstrip("\0").encode() or b"\0")
        return out

    def merge(
        self,
        word: str,
        key: int | None,
        below: int,
        made: list[tuple[int, int]] | None = None,
        skipped: frozenset[int] = frozenset(),
    ) -> list[int]:
        """Ids of a word.

        The agenda holds the candidate merges; the best piece comes up first, then the leftmost.
        With a key, a candidate whose keyed hash is below `below` is skipped for good, as
        are those in `skipped`, as id * 2^32 + place.  Merges made are noted as (place, id).
        """
        if len(word) > SHORT:
            return self._merge_long(word, key, below, made, skipped)
        symbols = self.symbols(word)
        rank, none = self.rank, self.none
        places = list(range(len(symbols)))
        agenda = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            got = self.by_rank[best]
            if (skipped and got << 32 | places[i] in skipped) or (key is not None and chance(key, got, places[i]) < below):
                agenda[i] = none
                continue
            if made is not None:
                made.append((places[i], got))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i], places[i + 1]
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
        return self.ids_of(symbols)

    def _merge_long(
        self,
        word: str,
        key: int | None,
        below: int,
        made: list[tuple[int, int]] | None,
        skipped: frozenset[int] = frozenset(),
    ) -> list[int]:
        """The same with a heap and linked neighbours: near-linear for texts without cuts."""
        rank, by_rank = self.rank, self.by_rank
        symbols: list[str | None] = list(self.symbols(word))
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            got = rank.get(symbols[i] + symbols[i + 1])
            if got is not None:
                agenda.append((got, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            best, i, merged = heapq.heappop(agenda)
            if symbols[i] is None or after[i] >= n or symbols[i] + symbols[after[i]] != merged:
                continue
            got = by_rank[best]
            if (skipped and got << 32 | i in skipped) or (key is not None and chance(key, got, i) < below):
                continue
            if made is not None:
                made.append((i, got))
            j = after[i]
            symbols[i], symbols[j] = merged, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((i, k), (before[i], i)):
                if left >= 0 and right < n:
                    both = symbols[left] + symbols[right]
                    got = rank.get(both)
                    if got is not None:
                        heapq.heappush(agenda, (got, left, both))
        return self.ids_of([s for s in symbols if s is not None])

    @cached_property
    def pairs(self) -> PairRanks:
        """The rank of the piece that two pieces join to."""
        found = {}
        for text, piece in self.ids.items():
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    found[left * len(self.text) + right] = self.rank[text]
        return PairRanks(found, len(self.text))

    @cached_property
    def pieces_by_rank(self) -> np.ndarray:
        return np.array(self.by_rank, np.int64)

    @cached_property
    def characters(self) -> np.ndarray:
        """The piece of each code point, -1 without one; a space is the mark, a mark has none."""
        out = np.full(0x110000, -1, np.int32)
        for text, piece in self.ids.items():
            if len(text) == 1 and text != SPACE:
                out[ord(text)] = piece
        out[ord(" ")] = self.ids.get(SPACE, -1)
        return out

    def merge_many(self, words: list[str], skipped: list[frozenset[int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What `merge` gives for many words that skip these candidates: ids, and merges as id * 2^32 + place."""
        # as (word * 2^32 + place) * pieces + piece, in order
        total = len(self.text)
        barred = np.array(sorted((i << 32 | c & 0xFFFFFFFF) * total + (c >> 32) for i, own in enumerate(skipped) for c in own), np.int64)

        def bars(word: np.ndarray, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
            mine = (word << 32 | place) * total + piece
            return barred[np.minimum(np.searchsorted(barred, mine), len(barred) - 1)] == mine

        def alone(i: int, made: list[tuple[int, int]]) -> list[int]:
            return self.merge(words[i], None, 0, made, skipped[i])

        ids, ends, merges, merge_ends = self.merged(words, alone, bars if len(barred) else None)
        return np.split(ids, ends[:-1]), np.split(merges, merge_ends[:-1])

    def drawn(self, words: list[str], keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """What `merge` gives for many words with a key each: ids, one word's after the other's, and where each word's end."""

        def bars(word: np.ndarray, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
            return chances(keys[word], spots(piece, place)) < np.uint64(below)

        def alone(i: int, made: list[tuple[int, int]]) -> list[int]:
            return self.merge(words[i], int(keys[i]), below)

        return self.merged(words, alone, bars, False)[:2]

    def merged(
        self,
        words: list[str],
        alone: Callable[[int, list[tuple[int, int]]], list[int]],
        bars: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
        noted: bool = True,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words and (if `noted`) their merges as id * 2^32 + place, each with where a word's end.

        `bars(words, pieces, places)` tells which candidates are skipped; `alone` merges one word by itself: one with
        characters that have no piece, a long one, or one of few of its width.
        """
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        begins = np.cumsum(sizes) - sizes
        flat = self.characters[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        strange = np.zeros(n, bool)
        strange[np.searchsorted(begins, np.flatnonzero(flat < 0), side="right") - 1] = True
        width_of = np.searchsorted(WIDTHS, sizes)
        width_of[strange | (sizes > SHORT) | (sizes == 0)] = len(WIDTHS)
        ids, merges, rest = [], [], [np.flatnonzero(width_of == len(WIDTHS))]
        for w, width in enumerate(WIDTHS):
            members = np.flatnonzero(width_of == w)
            if len(members) < FEW:
                rest.append(members)
                continue
            lines = np.arange(width)[:, None]
            at = np.minimum(begins[members] + lines, len(flat) - 1)
            symbols = np.where(lines < sizes[members], flat[at], -1)
            got, made = self._side_by_side(symbols, members, bars, noted)
            ids.append((members, *got))
            merges.append((members, *made))
        one = np.concatenate(rest)
        made_one: list[list[tuple[int, int]]] = [[] for _ in range(len(one))]
        lists = [alone(i, made) for i, made in zip(one.tolist(), made_one, strict=True)]
        for parts, own in ((ids, lists), (merges, [[m << 32 | at for at, m in made] for made in made_one])):
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            parts.append((one, np.fromiter(chain.from_iterable(own), np.int64, int(lengths.sum())), lengths))
        return *_joined(ids, n, np.int32), *_joined(merges, n, np.int64)

    def _side_by_side(
        self,
        symbols: np.ndarray,
        members: np.ndarray,
        bars: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None,
        noted: bool,
    ) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and merges, each with their numbers per word, of words given by columns of character pieces, -1 past
        the end.  A piece stands in the line of its first character.  Every turn makes the best merge of each word."""
        width, n = symbols.shape
        by_rank, pairs = self.pieces_by_rank, self.pairs

        def candidates(word: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
            rank = pairs.of(left, right)
            out = np.full(len(rank), NO_CANDIDATE, np.int32)
            known = np.flatnonzero(rank >= 0)
            rank, place = rank[known], place[known]
            if bars is not None:
                free = np.flatnonzero(~bars(members[word[known]], by_rank[rank], place))
                known, rank, place = known[free], rank[free], place[free]
            out[known] = rank << AGENDA_BITS | place
            return out

        # the last line stands for what lies before and after a word
        final = np.full((width, n), -1, np.int64)
        word = np.arange(n)
        symbol = np.concatenate([symbols.astype(np.int64), np.full((1, n), -1)])
        after = np.repeat(np.minimum(np.arange(1, width + 2), width), n)
        before = np.repeat(np.arange(-1, width) % (width + 1), n)
        agenda = np.full((width + 1) * n, NO_CANDIDATE, np.int32)
        pair = np.flatnonzero(symbol[1:] >= 0)
        symbol = symbol.ravel()
        agenda[pair] = candidates(pair % n, symbol[pair], symbol[pair + n], pair // n)
        made_words, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            best = agenda.reshape(width + 1, -1).min(0)
            live = np.flatnonzero(best != NO_CANDIDATE)
            if 2 * len(live) <= len(word):
                final[:, word] = symbol.reshape(width + 1, -1)[:width]
                if not len(live):
                    break
                symbol, after, before, agenda = (
                    np.take(x.reshape(width + 1, -1), live, 1).ravel() for x in (symbol, after, before, agenda)
                )
                word, best = word[live], best[live]
                live = np.arange(len(live))
            n, best = len(word), best[live].astype(np.int64)
            place, got = best & (1 << AGENDA_BITS) - 1, by_rank[best >> AGENDA_BITS]
            at = place * n + live
            gone = after[at] * n + live
            follows = after[gone]
            next_at = follows * n + live
            leads = before[at]
            lead_at = leads * n + live
            after[at], before[next_at] = follows, place
            symbol[at], symbol[gone], agenda[gone] = got, -1, NO_CANDIDATE
            found = candidates(
                np.tile(word[live], 2),
                np.concatenate([got, symbol[lead_at]]),
                np.concatenate([symbol[next_at], got]),
                np.concatenate([place, leads]),
            )
            agenda[at], agenda[lead_at] = found[: len(at)], found[len(at) :]
            if noted:
                made_words.append(word[live])
                made.append(got << 32 | place)
        rows = final.T
        left = rows >= 0
        whose = np.concatenate(made_words)
        order = np.argsort(whose, kind="stable")
        return (rows[left], left.sum(1)), (np.concatenate(made)[order], np.bincount(whose, minlength=len(members)))


class PairRanks:
    """Ranks of pairs of pieces, found at one place of a table each: pairs hash to buckets, and each bucket is
    moved by a step at which all its pairs fall on places of their own."""

    def __init__(self, found: dict[int, int], pieces: int) -> None:
        self.pieces = np.int64(pieces)
        keys = np.fromiter(found, np.int64, len(found))
        ranks = np.fromiter(found.values(), np.int64, len(found))
        self.mask = np.int64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        drawn = np.random.default_rng(0)
        while not self._placed(keys, ranks, np.uint64(drawn.integers(1 << 62) * 2 + 1)):
            pass

    def _hashed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed_ = keys.astype(np.uint64) * self.odd
        return (mixed_ >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (mixed_ >> np.uint64(20)).astype(np.int64)

    def _placed(self, keys: np.ndarray, ranks: np.ndarray, odd: np.uint64) -> bool:
        self.odd, size = odd, int(self.mask) + 1
        buckets, places = self._hashed(keys)
        self.moves = np.zeros(1 << BUCKET_BITS, np.int64)
        taken = bytearray(size)
        members: dict[int, list[int]] = {}
        for bucket, place in zip(buckets.tolist(), (places & self.mask).tolist(), strict=True):
            members.setdefault(bucket, []).append(place)
        for bucket, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(set(own)) < len(own):
                return False
            move = 0
            while any(taken[p + move & size - 1] for p in own):
                move += 1
                if move == size:
                    return False
            for p in own:
                taken[p + move & size - 1] = 1
            self.moves[bucket] = move
        self.table = np.full(size, -1, np.int64)
        self.table[places + self.moves[buckets] & self.mask] = keys << RANK_BITS | ranks
        return True

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of these pairs; -1 if they don't join, or one of them is -1."""
        key = left * self.pieces + right
        bucket, place = self._hashed(key)
        got = self.table[place + self.moves[bucket] & self.mask]
        return np.where((got >> RANK_BITS == key) & (left >= 0) & (right >= 0), got & (1 << RANK_BITS) - 1, -1)


class Encoder:
    """Encodes many texts.  Each occurrence of a word draws for its own candidate merges.  What is remembered of a
    word is what it gives without dropout: an occurrence that skips none of those merges gives the same, all others
    are merged anew."""

    def __init__(self, model: MergeModel, dropout: float, seed: int) -> None:
        self.model = model
        self.below = min(int(dropout * 2.0**64), 2**64 - 1)
        self.seed = np.uint64(mixed_int(seed))
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.store = IdStore()
        # what `chance` takes of each word's merges
        self.spots = IdStore(np.uint64)

    def _number(self, words: list[str]) -> None:
        """Gives new words their numbers."""
        merge = self.model.merge
        ids, ends, merges, merge_ends = self.model.merged(words, lambda i, made: merge(words[i], None, 0, made))
        first = self.store.n
        self.store.add_all(ids, ends)
        self.spots.add_all(spots(merges >> 32, merges & 0xFFFFFFFF), merge_ends)
        self.words.update(zip(words, range(first, self.store.n), strict=True))

    def _skipping(self, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Occurrences of these words, with these keys, that skip a merge of their word."""
        made, ends = self.spots.gather(which)
        hit = np.flatnonzero(chances(np.repeat(keys, np.diff(ends)), made) < np.uint64(self.below))
        found = np.searchsorted(ends, hit, side="right") - 1
        return found[np.flatnonzero(np.diff(found, prepend=-1))]

    def encode(self, texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (with the end)."""
        cut = self.model.cut.findall
        split = [cut(" " + t.decode()) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        sizes = np.array([len(s) for s in split], np.int64)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=first[1:])
        place = np.arange(len(words)) - np.repeat(first[:-1], sizes)
        owner = mixed(ids.astype(np.int64).view(np.uint64) ^ self.seed)
        keys = mixed(np.repeat(owner, sizes) + place.astype(np.uint64))
        lists, list_sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for a in range(0, len(words), AT_ONCE):
            some = words[a : a + AT_ONCE]
            if len(self.words) > REMEMBERED:
                self.forget()
            which = np.fromiter(map(self.words.get, some, repeat(-1)), np.int64, len(some))
            missing = np.flatnonzero(which < 0)
            if len(missing):
                found = [some[i] for i in missing.tolist()]
                self._number(list(dict.fromkeys(found)))
                which[missing] = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            n, used = self.store.n, self.store.used
            if self.below:
                own = keys[a : a + AT_ONCE]
                skip = self._skipping(which, own)
                # their ids take the next numbers for this step only
                which[skip] = np.arange(n, n + len(skip))
                self.store.add_all(*self.model.drawn([some[i] for i in skip.tolist()], own[skip], self.below))
            flat, ends = self.store.gather(which)
            self.store.n, self.store.used = n, used
            lists.append(flat)
            list_sizes.append(np.diff(ends))
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.concatenate(list_sizes), out=ends[1:])
        return np.concatenate(lists), ends[first]


_MODELS: dict[str, MergeModel] = {}


def _model(path: str) -> MergeModel:
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode(
    docs: DataFrame,
    model_path: str,
    dropout: float = 0.1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text, ids array<int>: each text in pieces of the model, some merges left out.

    Each candidate merge of each word occurrence is skipped with probability `dropout` by a hash
    of (seed, doc_id, place of the word) and of the merge's place and piece.  The same row, seed and
    settings always give the same ids, wherever it is computed.  Dropout 0 gives the
    model's own segmentation.  Characters outside the vocabulary become byte pieces.

    A null text gives null ids; an empty one no ids; a null doc_id counts as the smallest
    number.  Repeated rows give repeated results; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings = (dropout, seed)
        encoder = held(("pieces", model_path, *settings), lambda: Encoder(_model(model_path), *settings))
        for batch, texts in steps(batches):
            numbers = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            flat, ends = encoder.encode(texts, numbers)
            nulls = pa.array(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()), mask=nulls)
            yield pa.record_batch([batch.column(0), batch.column(1), lists], ["doc_id", "text", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `decoded`: the text that a list of piece ids stands for.

    Byte pieces join to UTF-8 characters (what is no UTF-8 becomes the replacement character),
    the leading space that encoding adds is dropped.  Null ids give a null text, as does a
    list that holds an id outside the vocabulary; control pieces stand for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _model(model_path).raw
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            texts = []
            for a, b, known in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True):
                ids = values[a:b]
                if not known or (b > a and not (ids.min() >= 0 and ids.max() < len(raw))):
                    texts.append(None)
                    continue
                text = b"".join(map(raw.__getitem__, ids.astype(np.int64).tolist())).decode(errors="replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "decoded string"])
    return rows.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, schema)
