"""Each operator against a brute-force version, and the defined results of odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairntrace.llm import chat, decision_list, packing, pii, repeats, rule_ensemble, setjoin, subwords, topk, toxicity
from cairntrace.llm.queries import piece_model, word_vocabulary
from cairntrace.llm.textstats import RATES, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, bits string"


def prose(rng: random.Random, words: int) -> str:
    parts = ["th", "an", "ou", "er", "ñe", "ß", "ing", "re"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd texts; null ids and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [prose(rng, 5) + " " + passage + " " + prose(rng, 9) for _ in range(6)]
    texts += [texts[3], texts[3].upper(), texts[4] + " end", "aaaa" * 90, "ab" * 150, "é" * 130, "", None, " \n\t ", "x"]
    words = texts[5].split() if len(texts[5].split()) > 40 else prose(rng, 90).split()
    for i in range(8):
        changed = list(words)
        changed[(7 * i) % len(words)] = f"edit{i}"
        texts.append(" ".join(changed))
    texts.append(prose(rng, 9000))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[7])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "r", "b") for i, t in rows], DOCS)


def test_chat_round_trip_and_automaton(spark):
    rows = [
        (1, 0, "user", "a ### b \\h </turn> \\"), (1, 1, "assistant", "### Assistant: </turn> #### é"), (2, 1, "user", None),
        (2, 0, "system", "s"), (3, 0, "assistant", "x"), (4, 0, None, "odd: role"), (4, None, "user", "first"),
        (None, 0, "a: b", "t"), (5, 0, "user", "q"), (5, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_chats(df)
    got = {
        r["conv_id"]: r
        for r in made.select(
            "conv_id", "valid", "bad_turn", "n_turns", "formatted", chat.read_turns(made["formatted"]).alias("turns"),
            chat.read_learned(made["segments"]).alias("learned"),
        ).collect()
    }
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [t[2:] for t in turns]
        assert got[c]["learned"] == "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c]["formatted"].count("</turn>") == got[c]["n_turns"] == len(turns)
    assert {c: got[c]["bad_turn"] for c in got} == {1: None, 2: None, 3: 0, 4: 1, None: 0, 5: 1}
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_text_statistics(spark, corpus):
    extra = [(900, "a b c\na b c\n\n \na b c d a b"), (901, "x x x x x"), (902, "#$ |<\n#$ |<"), (903, "\x85\xa0 \x1c b")]
    rows = corpus + extra
    got = text_stats(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *brute_stats(t))) for i, t in rows)
    assert text_stats(frame(spark, [])).count() == 0


def labelled(spark, n=600):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        rates = {f: rng.random() for f in RATES}
        rates["symbol_rate"] = 0.8 + rng.random() if bad and i % 2 else rng.random() * 0.4
        rates["repeat_rate"] = 0.7 + rng.random() if bad and not i % 2 else rng.random() * 0.5
        rows.append((i, int(not bad), *[rates[f] for f in RATES]))
    return spark.createDataFrame(rows, "doc_id long, y int, " + ", ".join(f"{f} double" for f in RATES))


def test_decision_list_learns_thresholds(spark):
    rows = labelled(spark)
    learned = decision_list.learn(rows, RATES)
    assert 1 <= len(learned.rules) <= 4
    judged = rows.select("y", learned.kept().cast("int").alias("k"), learned.rule_number().alias("r")).collect()
    assert sum(r["y"] == r["k"] for r in judged) >= 0.98 * len(judged)
    assert all((r["r"] == 0) == (r["k"] == 1) for r in judged)
    assert decision_list.learn(rows.limit(0), RATES).rules == ()
    assert decision_list.learn(rows.where("y = 1"), RATES).rules == ()


def test_rule_ensemble_scores(spark):
    rows = labelled(spark)
    model = rule_ensemble.fit(rows.where("doc_id % 5 <> 0"), RATES)
    assert model.rules and len(model.texts()) == len(model.rules)
    out = rows.where("doc_id % 5 = 0").select("y", model.score().alias("s")).collect()
    assert sum((r["s"] >= 0.3) == (r["y"] == 1) for r in out) >= 0.9 * len(out)
    assert all(0 <= r["s"] <= 1 for r in out)
    assert rule_ensemble.fit(rows.limit(0), RATES).rules == ()
    assert rule_ensemble.fit(rows.where("y = 1"), RATES).intercept > 0


def test_tree_paths_are_simplified():
    text = "Tree\n  If (feature 1 <= 2.0)\n   If (feature 1 <= 1.0)\n    Predict: 0\n   Else (feature 1 > 1.0)\n    Predict: 1\n  Else (feature 1 > 2.0)\n   Predict: 1\n"
    assert rule_ensemble.tree_paths(text) == [
        ((1, True, 2.0),), ((1, True, 1.0),), ((1, False, 1.0), (1, True, 2.0)), ((1, False, 2.0),),
    ]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    values = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "378282246310005"], "ip": ["10.0.0.1", "255.1.2.3"],
        "date": ["2024-02-29", "29.02.2024", "02/29/2024", "1850-12-31"], "ssn": ["123-45-6789", "899-99-9999"],
        "phone": ["+1 (212) 555-0199", "212-555-0199"], "email": ["ab.c1@mail.example.com"],
    }
    wrong = ["4111111111111112", "256.1.1.1", "2023-02-29", "000-12-3456", "12:30", "a@b", "123456", "1.2.3.4.5"]
    rows = [(i, f"see {v}, and {v}.") for i, v in enumerate(x for vs in values.values() for x in vs)]
    rows += [(100 + i, f"no {v} here") for i, v in enumerate(wrong)] + [(200, None), (201, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, pii_kinds string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "k").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "other").collect()}
    kinds = [k for k, vs in values.items() for _ in vs]
    new = {}
    for (i, text), kind in zip(rows, kinds, strict=False):
        old = text[4 : text.index(", and")]
        found = re.fullmatch(r"see (.+), and (.+)\.", got[i]["text"])
        assert found[1] == found[2] != old and again[i] == got[i]["text"] != other[i] and got[i]["pii_kinds"] == [kind] * 2
        new[old] = found[1]
        if kind not in ("ip",):
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", old)) == re.sub(r"\d", "9", re.sub("[a-z]", "a", found[1]))
        assert kind != "card" or luhn(found[1])
        assert kind != "ip" or all(0 <= int(x) <= 255 for x in found[1].split("."))
    assert new["4111 1111 1111 1111"].replace(" ", "") == new["4111111111111111"]
    y, m, d = new["2024-02-29"].split("-")
    assert new["29.02.2024"] == f"{d}.{m}.{y}" and new["02/29/2024"] == f"{m}/{d}/{y}"
    assert new["1850-12-31"].startswith("1850-") and new["ab.c1@mail.example.com"].endswith("@mail.example.com")
    assert all(got[100 + i]["text"] == f"no {v} here" for i, v in enumerate(wrong))
    assert got[200]["text"] is None and got[201]["text"] == "" and got[200]["pii_kinds"] == []


def test_addresses_of_single_digits_are_seen(spark):
    texts = ["ask 8.8.8.8", "8.8.8.8 and 42", "1.2.3.4", "v 1.2.3", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    assert [got[i]["pii_kinds"] for i in range(5)] == [["ip"], ["ip"], ["ip"], [], []]
    assert got[0]["text"].split()[1] == got[1]["text"].split()[0] != "8.8.8.8" and got[2]["text"] != "1.2.3.4"
    assert got[3]["text"] == texts[3] and got[4]["text"] == texts[4]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    for a, b in ((17, 43), (6, 61)):
        pair = pii.feistel("key", "kind", F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b))
        rows = spark.range(a * b).select(pair.alias("p")).select("p.l", "p.r").distinct().collect()
        assert len(rows) == a * b and all(0 <= r["l"] < a and 0 <= r["r"] < b for r in rows)


def test_subwords_are_lossless_and_plain_without_dropout(spark, corpus):
    import sentencepiece

    rows = corpus + [(950, "▁ mark ▁▁x  y"), (951, "日本語 हिन्दी 🙂\n\t\x00 12,345"), (952, "don't l'été")]
    df = frame(spark, rows)
    path = piece_model()
    plain = subwords.encode(df, path, dropout=0.0)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in plain.collect():
        assert r["ids"] is None if r["text"] is None else ("▁" in r["text"] or r["ids"] == sp.encode(r["text"]))
    a = subwords.encode(df, path, dropout=0.3, seed=1)
    first = sorted(map(repr, a.select("doc_id", "ids").collect()))
    assert first == sorted(map(repr, subwords.encode(df.repartition(3), path, dropout=0.3, seed=1).select("doc_id", "ids").collect()))
    assert first != sorted(map(repr, subwords.encode(df, path, dropout=0.3, seed=2).select("doc_id", "ids").collect()))
    for part in (plain, a):
        assert subwords.decode(part, path, keep=("doc_id", "text")).where("NOT decoded <=> text").count() == 0
    assert subwords.encode(df.limit(0), path).count() == 0


def test_each_occurrence_draws_its_own_merges():
    model = subwords.MergeModel(piece_model())
    dropout, seed = 0.2, 3
    encoder = subwords.Encoder(model, dropout, seed)
    texts = [b"unbelievable " * 400, prose(random.Random(9), 200).encode(), b"thousandfold" * 40, b""]
    ids = np.array([7, -3, 8, 9])
    flat, ends = encoder.encode(texts, ids)
    assert len({tuple(model.merge(" unbelievable", int(k), encoder.below)) for k in range(400)}) > 8
    owner = subwords.mixed(ids.view(np.uint64) ^ encoder.seed)
    for d, t in enumerate(texts):
        words = model.cut.findall(" " + t.decode()) if t else []
        keys = subwords.mixed(owner[d] + np.arange(len(words), dtype=np.uint64)).tolist()
        want = [model.merge(w, k, encoder.below) for w, k in zip(words, keys, strict=True)]
        assert flat[ends[d] : ends[d + 1]].tolist() == [i for x in want for i in x]
        if not d:
            assert len({tuple(x) for x in want}) > 8


def test_agendas_agree():
    model = subwords.MergeModel(piece_model())
    rng = random.Random(2)
    for _ in range(200):
        word = " " + "".join(rng.choices("theranigo", k=rng.randint(1, 14)))
        for key in (None, rng.getrandbits(64)):
            made, made_long = [], []
            short = model.merge(word, key, 1 << 62, made)
            assert short == model._merge_long(word, key, 1 << 62, made_long) and made == made_long
    word = "thousandfold" * 40
    assert model.merge(" " + word, None, 0) == model.sp.encode(word)


def test_packing_covers_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(word_vocabulary())
    rows = corpus + [(960, "İstanbul ΣΑΣ é <|endoftext|>. don't x\x1cy"), (961, "İ")]
    got = packing.pack(frame(spark, rows), word_vocabulary(), window=64, shard_tokens=4000).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(model.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, lists in ids.items():
        expected = sorted(len(x) for x in lists)
        assert sum(r["length"] for r in pieces[i]) == sum(expected)
        if len(lists) == 1 and i is not None:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                raw = np.array(lists[0][at : at + r["length"]], "<u4").tobytes()
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(lists[0]), zlib.crc32(raw))
                at += r["length"]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        padding += 64 - at if at & (at - 1) else 0
    assert padding == 0
    assert packing.pack(frame(spark, []), word_vocabulary()).count() == 0


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t + 10, 1000 * t + 40, 30) for t in (1, 2, 3) for _ in range(2)]
    got = packing.pack_shard(topics, np.ones(5000), window=60)
    by = defaultdict(set)
    for d, _, _, sequence, _ in got:
        by[sequence].add(d // 2)
    assert all(len(x) == 1 for x in by.values())


def brute_scores(texts, idf, seed):
    """BM25 of every document for all distinct terms of the seed."""
    mean = sum(map(len, texts)) / len(texts)
    out = []
    for t in texts:
        norm = packing.K1 * (1 - packing.B + packing.B * len(t) / mean)
        tf = Counter(t.tolist())
        out.append(sum(idf[x] * tf[x] * (packing.K1 + 1) / (tf[x] + norm) for x in set(texts[seed].tolist()) if tf[x]))
    return out


@pytest.mark.parametrize("head", [64, 5])
def test_neighbours_are_those_of_brute_force(monkeypatch, head):
    monkeypatch.setattr(packing, "HEAD", head)
    rng = np.random.default_rng(2)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 299).astype(np.int64) for _ in range(70)]
    idf = rng.random(300) + 0.1
    shard = packing.Shard(texts, idf)
    assert 0 < shard.matrix.shape[1] < 100
    unused = rng.random(70) < 0.8
    for seed in range(70):
        want = brute_scores(texts, idf, seed)
        got = list(shard.neighbours(seed, unused))
        assert sorted(got) == np.flatnonzero(unused).tolist()
        order = [want[i] for i in got]
        assert all(a > b - 0.002 for a, b in itertools.pairwise(order)), seed


def test_shards_follow_content(spark):
    """Topics of words of their own, copies, repeated rows: like documents meet, shards stay bounded."""
    rng = random.Random(6)
    vocabularies = [[prose(rng, 1) + prose(rng, 1) for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(rng.choices(vocabularies[i % 4], k=80))) for i in range(240)]
    rows += [(500 + i, rows[8][1]) for i in range(40)] + [rows[5]] * 300 + [(None, rows[6][1])] * 60 + [(900, None), (901, "")]
    rng.shuffle(rows)
    docs = frame(spark, rows).repartition(3)
    each = 12_000
    dealt, _ = packing.dealt(docs, word_vocabulary(), shard_tokens=each)
    got = [(r["k"], r["shard"], len(r["ids"]) // 2) for r in dealt.collect()]
    assert Counter(k for k, *_ in got) == Counter(-(2**63) if i is None else i for i, _ in rows)
    tokens, met = Counter(), defaultdict(Counter)
    for k, shard, n in got:
        tokens[shard] += n
        if 0 <= k < 240 and k != 5:
            met[k % 4][shard] += 1
    assert len(tokens) > 4 and max(tokens.values()) < 2.5 * each
    # two documents of a topic are in one shard more often than by chance
    together = sum(n * n for c in met.values() for n in c.values()) / sum(sum(c.values()) ** 2 for c in met.values())
    chance = sum((n / sum(tokens.values())) ** 2 for n in tokens.values())
    assert together > 1.5 * chance, (together, chance)
    assert len({shard for k, shard, _ in got if k == 5}) > 1
    pieces = packing.pack(docs, word_vocabulary(), shard_tokens=each).collect()
    assert sum(p["length"] for p in pieces) == sum(tokens.values())


def test_cells_fill_shards():
    got = packing.shards_of_cells({1: 50, 2: 40, 7: 900, 8: 30, 9: 30, 12: 100}, 100)
    assert got == {1: (0, 1), 2: (0, 1), 7: (1, 9), 8: (10, 1), 9: (10, 1), 12: (11, 1)}
    assert packing.shards_of_cells({}, 100) == {}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(50)] + [(0, [9.0] * 6), (400, [1.0, 2.0]), (401, [3.0, 1.0])]
    # components that take more than 32, and scores that take more than 64 bits
    vectors += [(500, [20000.0] + [1.0] * 5), (501, [-3e7, 2.5, 1e6, -1.0, 0.0, 7.25]), (600, [4e5, -4e5, 3e5, 2e5, 1e5, 0.1])]
    vectors += [(700, [1e300, -1.0, 2.0, 0.0, -1e12, 1.0]), (701, [-1e17, 1e11, -5e9, 3e8, 1.0, 2.0])]
    odd = [(2, None), (3, []), (4, [float("nan")] * 6), (None, [1.0] * 6), (5, [float("inf")] * 6), (6, [None] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors + odd], "vec_id long, embedding array<double>, score int, rank int")
    most = 2**62 - 1

    def within(x):
        return max(-most, min(most, x))

    good = [(i, tuple(within(math.floor(1024 * x)) for x in v)) for i, v in vectors]
    queries = {i: min(v for j, v in good if j == i) for i, _ in good if i % 100 == 0}
    expected = []
    for q, v in queries.items():
        scores = [(-within(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v)]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10])]
    for rows in (64, 8192):
        assert sorted(map(tuple, topk.top_k(df, candidate_rows=rows).collect())) == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0


def brute_repeats(rows, length):
    """Per (id, text): maximal byte ranges covered by strings that begin earlier."""
    seen, out = set(), {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        covered = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                covered[s : s + length] = True
            seen.add(b[s : s + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out[i, t] = [(int(a), int(e)) for a, e in zip(edges[::2], edges[1::2], strict=True)]
    return out


@pytest.mark.parametrize("length,anchor,crowded", [(100, 24, 8192), (30, 8, 8192), (30, 8, 2)])
def test_repeats_are_exact(spark, corpus, monkeypatch, length, anchor, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 5_000)
    expected = brute_repeats(corpus, length)
    got = repeats.mark_repeats(frame(spark, corpus), length, anchor).collect()
    assert len(got) == len(corpus)
    for r in got:
        spans = [(s["begin"], s["end"]) for s in r["removed"]]
        assert spans == expected[r["doc_id"], r["text"]], r["doc_id"]
        b = (r["text"] or "").encode()
        edges = [0, *[x for s in spans for x in s], len(b)]
        assert bytes(r["kept"]) == b"".join(b[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
        r["kept_text"].encode()
        assert (r["lang"], r["score"], r["bits"]) == ("en", 0.5, "b")
    assert repeats.mark_repeats(frame(spark, [])).count() == 0


def test_run_length_index_on_repetitive_text():
    rng = random.Random(9)
    base = bytes(rng.choices(b"ab\x00\xff", k=150))
    pieces = list({base[i % 7 :] + bytes([i]) + base[: 80 + i] for i in range(40)})
    index = repeats.RunLengthIndex(pieces)
    joined = [(p, s) for p, piece in enumerate(pieces) for s in range(len(piece))]
    first = {}
    later = [
        int(index.starts[p]) + s
        for p, s in joined
        if len(pieces[p]) - s >= 40 and first.setdefault(pieces[p][s : s + 40], (p, s)) != (p, s)
    ]
    assert index.later(40).tolist() == later
    assert len(index.runs) < index.n and index.head[0] in index.tail or len(index.head) == len(index.tail)


def brute_components(rows, words_each=5, percent=75):
    lower = {i: i + 32 for i in range(65, 91)}

    def shingles(t):
        w = WORD.findall((t or "").translate(lower))
        return frozenset(tuple(w[k : k + words_each]) for k in range(max(1, len(w) - words_each + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    label = [-(2**63) if i is None else i for i, _ in sets]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(x)] = find(y)
    least = defaultdict(lambda: 2**63)
    for x, i in enumerate(label):
        least[find(x)] = min(least[find(x)], i)
    return sorted(repr((i, len(s), None if least[find(x)] == -(2**63) else least[find(x)])) for x, (i, s) in enumerate(sets))


def test_near_duplicates_are_exact(spark, corpus):
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = list(corpus)
    for k in range(60):  # near copies of which only some link
        w = list(base)
        for j in rng.sample(range(len(w)), rng.randint(0, 6)):
            w[j] = f"z{k}-{j}"
        rows.append((2000 + k, " ".join(w)))
    got = setjoin.near_duplicates(frame(spark, rows))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_components(rows)
    assert setjoin.near_duplicates(frame(spark, [])).count() == 0


def test_classes_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words, other, third, fourth = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (120, 90, 70, 60))
    near = " ".join([*words[:119], "changed"])
    other, third = " ".join(other), " ".join(third)
    rows = [(1, " ".join(words)), (1, " ".join(words).upper()), (2, near), (None, other), (None, other.upper()),
            (3, other + " end"), (None, third), (None, third + " end"), (None, ""), (4, " ".join(fourth)), (4, near + " end"),
            (5, "")]
    got = setjoin.near_duplicates(frame(spark, rows))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_components(rows)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()]
    assert len(kept) == 6 and {i for i, _ in kept} == {1, None, 4, 5}
    assert sum(i is None and t.startswith(other) for i, t in kept) == 1
    assert sum(i is None and t.startswith(third) for i, t in kept) == 1
    assert (4, near + " end") not in kept


def toxic_rows():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 8 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "loser", "worthless"])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    return rows


def test_toxicity_sees_through_disguises(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert {"idiot", "loser", "worthless"} <= set(scorer.evidence)
    for written, meant in (("1d10t", "idiot"), ("l00000ser", "loser"), ("i.d.i.o.t", "idiot"), ("w0rthl3ss", "worthless"),
                           ("lo$er", "loser"), ("iiiidiot", "idiot")):
        assert toxicity.plain_word(written, scorer.model) == meant
    clean = prose(random.Random(77), 80)
    tests = [(1, clean), (2, clean + " 1d10t w0rthl3ss!"), (3, clean + " i d i o t l o s e r"), (4, None), (5, ""), (None, clean),
             (7, clean + " LOOOSER, idiooot."), (8, "1" * 5000 + "a"), (9, clean)]
    df = spark.createDataFrame([(*r, 7) for r in tests], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, scorer).collect()}
    assert min(got[i] for i in (2, 3, 7)) >= 0.3 > max(got[i] for i in (1, 4, 5, None, 8, 9)), (got, scorer.slope, scorer.offset)
    empty = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, text string, y int"))
    assert toxicity.score(df, empty).where("score < 0.3").count() == len(tests)


def test_toxicity_of_long_runs_and_word_ends(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 8 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "worthless", "scoundrelishness"])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert {"idiot", "worthless", "scoundrelishness"} <= set(scorer.evidence)
    for piece, meant in (("idio+", "idiot"), ("worthle$$", "worthless"), ("idiot!!", "idiot"), ("(idiot)", "idiot"),
                         ("*1dio+*", "idiot"), ("i" + "d" * 100 + "iot", "idiot"), ("i.." + "." * 80 + "diot", "idiot")):
        assert meant in toxicity.words_of(piece, scorer.model), piece
    letters = "theandouringerth" * 6 + "idiot" + "rethaninger" * 9
    assert len(letters) >= 200
    clean = prose(random.Random(77), 80)
    tests = [(1, clean), (2, " ".join(letters)), (3, " ".join("then ? idiot , worthless".replace(" ", ""))), (4, " ".join("anscoundrelishnesser")),
             (5, " ".join(letters.replace("idiot", "")))]
    df = spark.createDataFrame(tests, "doc_id long, text string")
    got = {r["doc_id"]: r["evidence"] for r in toxicity._evidence(df, scorer).collect()}
    assert got[1] == got[5] == 0 and got[2] >= scorer.evidence["idiot"]
    assert got[3] >= scorer.evidence["idiot"] + scorer.evidence["worthless"] and got[4] >= scorer.evidence["scoundrelishness"]


def symbols(raw):
    return [0 if not chr(b).isalpha() and b < 128 else 27 if b >= 128 else ord(chr(b).lower()) - 96 for b in raw]


def test_character_model_counts_every_four(spark):
    rng = random.Random(4)
    texts = ["Ab1 çé", None, "", "x", *[prose(rng, 30) for _ in range(9)]]
    seen = symbols(b"\n" + b"\n".join((t or "").encode() for t in texts) + b"\n")
    want = Counter(zip(seen, seen[1:], seen[2:], seen[3:], strict=False))
    model = toxicity.char_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    got = {(f // 28**3, f // 28**2 % 28, f // 28 % 28, f % 28): int(model.fours[f]) for f in np.flatnonzero(model.fours).tolist()}
    assert got == want
    state = 28 * 28 * 20 + 28 * 8 + 5  # "the" ends a word or goes on
    assert math.isclose(sum(math.exp(x) for x in model.logs[state * 28 : state * 28 + 28]), 1)
    twice = spark.createDataFrame([(1, "abcdé" * 9)] * 6, "doc_id long, text string").repartition(3)
    assert toxicity.char_model(twice).fours[(28 * 28 * 28 * 1) + 28 * 28 * 2 + 28 * 3 + 4] == 54


def test_viterbi_finds_the_best_of_all_readings():
    rng = random.Random(12)
    text = symbols(prose(rng, 3000).encode())
    fours = np.zeros(28**4, np.int64)
    for a, b, c, d in zip(text, text[1:], text[2:], text[3:], strict=False):
        fours[((a * 28 + b) * 28 + c) * 28 + d] += 1
    model = toxicity.CharModel(fours)

    def worth(reading, costs):
        run, total = [0, 0, 0, *symbols(reading.encode()), 0], sum(costs)
        for a, b, c, d in zip(run, run[1:], run[2:], run[3:], strict=False):
            total += model.logs[((a * 28 + b) * 28 + c) * 28 + d]
        return total

    tokens = ["1d10t", "l0$er", "w.0.r*d", "*|1*", "aaa+|1", "th3.*", "é1*a", "s!!!t"]
    tokens += ["".join(rng.choice("aelnrt013!|*.") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    for token in tokens:
        lattice = toxicity._lattice(token)
        if lattice is None:
            assert toxicity.restore(token, model) is None
            continue
        ways = [("".join(x for x, _ in way), [p for _, p in way]) for way in itertools.product(*lattice[0])]
        best = max(worth(*way) for way in ways)
        top = {reading for reading, costs in ways if worth(reading, costs) > best - 1e-9}
        assert toxicity.restore(token, model) in top, token


def test_finder_against_every_substring():
    rng = random.Random(3)
    features = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) + rng.choice(["", "-"]) for _ in range(40)}
    finder = toxicity.Finder(features)
    for _ in range(30):
        runs = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(2)]
        want = {f for f in features for r in runs
                if (f in r if not f.endswith("-") else any(r.startswith(f[:-1], i) for i in range(len(r) - len(f) + 1)))}
        assert finder.features(runs) == want
    assert toxicity.Finder([]).features(["abc"]) == set()


def test_long_runs_need_little_memory(spark):
    """A passage of 10,000 single letters and a word of 5,000 characters in the labelled sample."""
    rng = random.Random(9)
    letters = [rng.choice("etaoinshrdlu") for _ in range(10_000)]
    junk = "".join(rng.choice("etaoinshrdlu") for _ in range(5_000))
    rows = toxic_rows() + [(9001, " ".join(letters), 1), (9002, junk + " end", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert {"idiot", "loser", "worthless"} <= set(scorer.evidence) and max(map(len, scorer.evidence)) < 50
    reader = toxicity.Reader(scorer.model)
    tracemalloc.start()
    try:
        apart = [a for _, a in reader.read([r[1].encode() for r in rows[-2:]])]
        found = toxicity.Finder([*scorer.evidence, "eta", "nshr-"]).features(apart[0])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(a) for a in apart] == [1, 0] and "eta" in found
    assert peak < 200_000_000, peak


def test_sha_of_kept_bytes_matches_query(spark):
    from cairntrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute_repeats(rows, 100)
    for r in QUERIES["op2_suffix_dedup"](spark, sf).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        b = (text or "").encode()
        spans = expected[r["doc_id"], text]
        edges = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
        )


def test_subword_states_are_bounded(monkeypatch):
    """A worker forgets its words and states at a bound, and encodes alike after it."""
    import numpy as np

    from cairntrace.llm import subwords
    from cairntrace.llm.queries import piece_model

    assert subwords.REMEMBERED <= 120_000
    model = subwords.MergeModel(piece_model())
    texts = [f"unlikely wordings number {i} {i * 7919}".encode() for i in range(300)]
    whole = subwords.Encoder(model, 0.2, 3).encode(texts, np.arange(300))
    monkeypatch.setattr(subwords, "REMEMBERED", 50)
    encoder = subwords.Encoder(model, 0.2, 3)
    parts = [encoder.encode([t], np.array([i]))[0] for i, t in enumerate(texts)]
    assert np.array_equal(whole[0], np.concatenate(parts)) and len(encoder.words) < 100


def test_topics_are_fitted_on_all_documents(spark, monkeypatch):
    """The centres are those of brute-force rounds over every document, wherever the rounds begin."""
    monkeypatch.setattr(packing, "START", 12)
    rng = random.Random(8)
    vocabularies = [[prose(rng, 1) + prose(rng, 1) for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(rng.choices(vocabularies[i % 4], k=60))) for i in range(160)] + [(None, None), (7, ""), (7, "a")]
    docs = frame(spark, rows).repartition(4)
    made = packing.written(packing.tokenised(docs, word_vocabulary(), "doc_id", "text"), "all-ids")
    idf = packing.inverse_frequencies(made)
    starts = []
    centres_of = packing.centres_of
    monkeypatch.setattr(packing, "centres_of", lambda x, n: starts.append(centres_of(x, n)) or starts[-1])
    topics, sizes = packing.fit_topics(made, idf, 4000)
    kept = made.where("ids IS NOT NULL").select("ids", "n").collect()
    lists = [np.frombuffer(r["ids"], "<u2")[:-1] for r in kept]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    x = packing.sketches_of(np.concatenate(lists), owner, len(lists), idf)
    assert len(x) == len(rows)
    centres = starts[0]
    for _ in range(packing.WHOLE_ROUNDS):
        near = np.argmax(x.astype(float) @ centres.T, 1)
        sums = [x[near == t].sum(0, dtype=np.int64) if (near == t).any() else c for t, c in enumerate(centres)]
        centres = packing._centre(np.array(sums))
    assert np.array_equal(topics.centres, packing._in_line(centres))
    assert not np.array_equal(sorted(map(tuple, centres)), sorted(map(tuple, starts[0])))
    want = Counter()
    for cell, r in zip(topics.cells(x).tolist(), kept, strict=True):
        want[cell] += r["n"]
    assert sizes == want


def test_plain_words_are_read_without_decoding():
    """Letters or digits alone stand for themselves, as the whole rule says, and need no decoder."""
    model = toxicity.CharModel(np.random.default_rng(0).integers(0, 50, toxicity.SYMBOLS**4))
    rng = random.Random(3)
    letters = "abcABC125eéİΣσßﬁ²٣日#%&'),-./:;<=>?[\\]^_`{}~!$+|(*@€·aaa"
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(4000)}
    for piece in pieces | {"word", "Word###", "42,", "Éa&&&", "so-so", "aaa", "w0rd", "word!", "word***", "ΟΔΟΣ."}:
        assert toxicity.words_of_raw(piece.encode(), model) == toxicity.words_of(piece, model), piece
    for piece in (b"word", b"Word###", b"42,", "Éa&&&".encode()):
        assert toxicity.words_of_raw(piece, None)


def test_workers_forget_between_operators():
    from cairntrace.llm import batches

    batches.held("one", lambda: [1])
    batches.forget()
    assert not batches._HELD
    assert batches.held("two", lambda: [2]) == [2]
    assert list(batches._HELD) == ["two"]
    batches.forget()


def test_words_merged_side_by_side_are_those_merged_alone():
    model = subwords.MergeModel(piece_model())
    rng = random.Random(5)
    words = [" " + prose(rng, 1).strip() + prose(rng, 1).strip()[: rng.randint(0, 30)] for _ in range(300)]
    words += [" ", " x", "日本", " a▁b", "\x00", "é" * 60, " naïveté"]
    for share in (0, 0.3, 0.8):
        skipped = []
        for word in words:
            made = []
            model.merge(word, None, 0, made)
            skipped.append(frozenset(piece << 32 | place for place, piece in made if rng.random() < share))
        ids, merges = model.merge_many(words, skipped)
        for word, skip, got, steps in zip(words, skipped, ids, merges, strict=True):
            made = []
            assert got.tolist() == model.merge(word, None, 0, made, skip), word
            assert steps.tolist() == [piece << 32 | place for place, piece in made], word


def test_drawn_words_are_those_merged_alone_with_their_keys():
    """Occurrences that skip merges are merged at once, each once, whatever their candidates."""
    model = subwords.MergeModel(piece_model())
    rng = random.Random(6)
    words = [" " + prose(rng, 1).strip() + prose(rng, 1).strip()[: rng.randint(0, 30)] for _ in range(400)]
    words += [" ", " x", "x", "日本", " a▁b", "\x00", "é" * 60, " naïveté", "thousandfold" * 5]
    keys = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    for share in (0.1, 0.5, 0.9):
        below = int(share * 2**64)
        ids, ends = model.drawn(words, keys, below)
        for word, key, got in zip(words, keys.tolist(), np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == model.merge(word, key, below), word
    pieces = list(model.ids)
    for left, right in [*zip(pieces, rng.sample(pieces, len(pieces)), strict=True), ("t", "h"), ("th", "e")]:
        a, b = model.ids[left], model.ids[right]
        want = model.rank.get(left + right, -1)
        assert model.pairs.of(np.array([a, -1]), np.array([b, b])).tolist() == [want, -1]


def test_an_encoder_merges_an_occurrence_once(monkeypatch):
    """No occurrence is merged by itself, or again from another state, where its characters have pieces."""
    model = subwords.MergeModel(piece_model())
    text = ("unbelievable thousandfold wordings reconsidered " * 500).encode()
    done = []
    own = subwords.MergeModel._side_by_side
    monkeypatch.setattr(subwords.MergeModel, "merge", lambda *_: done.append(1) or [])
    monkeypatch.setattr(subwords, "FEW", 0)
    monkeypatch.setattr(
        subwords.MergeModel, "_side_by_side", lambda self, symbols, *a: done.extend(symbols[0]) or own(self, symbols, *a)
    )
    subwords.Encoder(model, 0.3, 1).encode([text], np.array([1]))
    words = len(model.cut.findall(" " + text.decode()))
    assert 0.5 * words < len(done) <= words + 6


def test_packing_workers_keep_no_memory_that_is_free(monkeypatch):
    """A task that made ids gives free memory back at its end; the tasks after it drop the tokenizer."""
    from unittest.mock import MagicMock

    import pyarrow as pa

    from cairntrace.llm import batches

    given = []
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    monkeypatch.setattr(packing, "F", MagicMock())
    docs = MagicMock()
    docs.select.return_value.mapInArrow = lambda run, _: run
    run = packing.tokenised(docs, word_vocabulary(), "doc_id", "text")
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["two words", None])], ["doc_id", "text"])
    out = list(run(iter([batch])))
    assert [b["n"].to_pylist() for b in out] == [[3, 1], [0]] and given == [1]
    assert batches._HELD
    assert [len(p) for p in packing._parts(iter([batch]))] == [2] and not batches._HELD
