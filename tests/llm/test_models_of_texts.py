"""Language model, periodic runs and manifest against brute-force versions, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairntrace.llm import bilinear, merkle, runs, toxicity
from cairntrace.llm.batches import Kinds, steps, word_steps
from cairntrace.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tree string, h string, path string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, n, 0.5, "r", "b", "p", "q") for i, t, s, n in rows], DOCS)


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


# --- manifest ---------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(i, text, source, n):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, "en", n, text)])


def climb(level):
    """Root, and per leaf the siblings of each level as (before, after)."""
    ways = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for leaf, j in enumerate(at):
            first = j // 3 * 3
            ways[leaf].append(("".join(level[first:j]), "".join(level[j + 1 : first + 3])))
        level = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)]
        at = [j // 3 for j in at]
    return level[0], ways


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    trees = {}
    for source, own in by.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        trees[source] = own, *climb([brute_leaf(*r) for r in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for source, up in zip(order, above, strict=True):
        own, subroot, ways = trees[source]
        for r, way in zip(own, ways, strict=True):
            i, text, s, n = r
            seen = text.replace("\n", "") if text is not None and crc(i) % 2 == 0 else text
            folded = brute_leaf(i, seen, s, n)
            for before, after in way + up:
                folded = sha(before, folded, after)
            proof = sha(*[a + b for a, b in way + up])
            out.append((i, brute_leaf(*r), subroot, root, proof, folded, folded == root))
    return out


def manifest_rows():
    rng = random.Random(8)
    rows = [(i, f"text {i}\nline é" if i % 3 else f"plain {i}", "hot", 10 + i) for i in range(760)]
    rows += [(1000 + i, "a\nb", f"s{i}", None) for i in range(31)]
    rows += [(2000 + i, None if i % 2 else "", None, 0) for i in range(28)]
    rows += [(3000 + i, "x\n" * i, "nine", i) for i in range(9)] + [(3100 + i, "y", "ten", i) for i in range(10)]
    rows += [(None, "no id\n", "hot", 3), (None, "no id\n", "hot", 3), (5, "other text of 5", "hot", 1), rows[7]]
    rows += [(4000, "one\n", "ä", 4), (4001, "one", "Z", 4), (4002, "", "", 0)]
    rng.shuffle(rows)
    return rows


def test_manifest(spark):
    rows = manifest_rows()
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 27, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"t\n{i}", "s", i) for i in range(n)]
    got = sorted(map(tuple, merkle.manifest(frame(spark, rows)).collect()))
    assert got == sorted(brute_manifest(rows))


def test_manifest_without_rows(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0


# --- periodic runs ----------------------------------------------------------------------------


def brute_runs(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[:-p])
            if length >= max(6, 4 * q) and smallest == q:
                found.add((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_report(i, text, extend=True):
    words = WORD.findall(text or "")
    n, h = len(words), crc(i)
    if extend and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute_runs(words)
    drop = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def periodic_texts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "x a b a b a b a b y", "\x85 \xa0 \x85"]
    for _ in range(150):
        kinds = rng.choice([1, 2, 2, 3, 5, 40])
        words = [str(rng.randrange(kinds)) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            unit = [str(rng.randrange(kinds + 1)) for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(3, 8))[: rng.randint(4, 40)]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 12:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    unit = " ".join(f"u{k}" for k in range(150))
    return texts + [fibonacci[-1], "z " * 3000, f"lead {unit} {unit} {unit} {unit} u0 end", ("a a b " * 30 + "c ") * 6]


def test_runs(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(periodic_texts())] + [(None, "a b " * 9, "s", 1), (3, "a", "s", 1)]
    made = runs.periodic_runs(frame(spark, rows), extend=True)
    got = [tuple(r) for r in made.drop("runs").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((brute_report(i, t) for i, t, _, _ in rows), key=key)
    assert sum(r[1] for r in got) > 100
    plain = {r["doc_id"]: r for r in runs.periodic_runs(frame(spark, rows)).collect()}
    for i, t, _, _ in rows[:60]:
        if i != 3:
            assert [(r["start"], r["length"], r["period"]) for r in plain[i]["runs"]] == brute_runs(WORD.findall(t or ""))
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def test_rare_words_split_until_stable():
    # c is rare once d is gone: both must be found rare by counting again
    words = "a b a b a b a b d c c a c d c x x x x x x".split()
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    got = runs.surviving(np.array([number[w] for w in words]), np.array([0, len(words)]))
    assert got == [(0, 8), (15, 21)]


def test_runs_of_a_long_text():
    rng = random.Random(1)
    words = [rng.choice("abcde") for _ in range(60_000)]
    unit = [rng.choice("abcde") for _ in range(4000)]
    words[9000:9000] = unit * 5
    found = runs.scan(np.array([ord(w) - 97 for w in words]))
    assert any(q == 4000 and 20_000 <= length < 20_100 for _, length, q in found)
    assert len(set(found)) == len(found)


# --- language model ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus():
    """Two languages, so that the words before tell the next ones' language."""
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(400)] for c in "xy"]
    rows = []
    for i in range(400):
        words = kinds[i % 2]
        text = " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randint(1, 200)))
        rows.append((i, text.upper() if i % 5 == 0 else text, "s", 1))
    return rows + [(700, "never seen words \x85 only", "s", 1), (701, "", "s", 1), (702, None, "s", 1), (None, "x1 x2", "s", 1), rows[3]]


def brute_base(rows):
    counts = Counter()
    for i, t, _, _ in rows:
        if crc(i) % 7 != 2:
            counts.update([w.lower() if w.isascii() else w for w in WORD.findall(t or "")] + [""])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t, _, _ in rows:
        tokens = [w.lower() if w.isascii() else w for w in WORD.findall(t or "")] + [""]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        out.append((i, crc(i) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return out


def test_language_model(spark, corpus, monkeypatch):
    monkeypatch.setattr(bilinear, "FREQUENT", 500)  # so that words meet their counts in the join too
    docs = frame(spark, corpus)
    lm = bilinear.train(docs.where(~held_out(docs["doc_id"], 7, 2)))
    rows = [tuple(r) for r in bilinear.score(docs, lm).collect()]
    key = lambda r: tuple(map(str, r[:5]))
    for got, want in zip(sorted(rows, key=key), sorted(brute_base(corpus), key=key), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], abs=1e-6)
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert len(lm.lex.words) <= 500 < lm.lex.types


def test_words_of_steps():
    rng = random.Random(3)
    texts = [None, "", " ", "\n a\tB \x0b c\x0c\r", "É \x85x y\xa0z", "ab abc"] + [
        " ".join(rng.choice(["ä", "Abc", "x", "", "q1"]) for _ in range(rng.randrange(40))) for _ in range(200)
    ]
    for each in (1, 50, 10**6):
        batch = pa.record_batch([pa.array(texts)], ["text"]).slice(0)
        got = []
        for part, sizes, which, kinds in word_steps(iter([batch.slice(0, 77), batch.slice(77)]), each=each):
            words, ends = kinds.words(), np.cumsum(sizes)
            assert bilinear.buckets_of(kinds).tolist() == [bilinear.bucket_of(w) for w in words]
            got += [[words[i] for i in which[e - n : e]] for n, e in zip(sizes, ends, strict=True)]
            assert part.num_rows == len(sizes)
        assert got == [t.lower().split() for _, ts in steps(iter([batch])) for t in ts]


def test_probabilities_add_up_to_one(spark, corpus):
    docs = frame(spark, corpus)
    lm = bilinear.train(docs)
    looked = bilinear.Looked(lm.model, lm.normalisers)
    everything = np.arange(bilinear.ITEMS)
    for near, far in ((0, 0), (5, 9), (1300, 2)):
        p = 10 ** looked.log_p(everything, np.full(bilinear.ITEMS, near), np.full(bilinear.ITEMS, far))
        direct = lm.model.predicted(np.array([near]), np.array([far]))[0] @ lm.model.outputs.T + lm.model.bias
        assert p.sum() == pytest.approx(1, abs=1e-4)
        assert p == pytest.approx(np.exp(direct) / np.exp(direct).sum(), rel=1e-3)
    # inside a bucket: the words of the bucket, and one unseen, have all of its probability
    counts = {bytes(r["word"]): r["c"] for r in lm.counts.collect()}
    reader = bilinear.Tokens(lm.lex)
    for b in range(0, bilinear.BUCKETS, 97):
        inside = [w for w in counts if w and bilinear.bucket_of(w) == b and w not in lm.lex.words[: bilinear.WORDS]]
        shares = [10 ** reader.inside[n] for n in reader.numbers(Kinds(pa.array(inside, pa.binary()))).tolist()] + [10 ** reader.inside[reader.n + b]]
        assert sum(shares) == pytest.approx(1)


def test_language_model_without_texts(spark, corpus):
    docs = frame(spark, corpus)
    lm = bilinear.train(docs.limit(0))
    rows = bilinear.score(docs, lm).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert bilinear.score(docs.limit(0), lm).count() == 0


def test_toxicity_passes_a_kept_text_once(spark, monkeypatch):
    seen = []
    evidence = toxicity._evidence
    monkeypatch.setattr(toxicity, "_evidence", lambda rows, scorer: (seen.append(rows.columns), evidence(rows, scorer))[1])
    docs = spark.createDataFrame([(1, "an idiot", "a"), (2, None, "b")], "doc_id long, text string, source string")
    scorer = toxicity.Scorer(toxicity.char_model(docs), {"idiot": 2.0})
    got = toxicity.score(docs, scorer)
    assert len(seen[0]) == 3 and got.columns == ["doc_id", "text", "source", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].text, rows[1].source, rows[2].text) == ("an idiot", "a", None) and rows[1].score > rows[2].score
    bare = toxicity.score(docs.select("doc_id", F.col("text").cast("binary").alias("text")), scorer)
    assert dict(bare.dtypes)["text"] == "binary" and {r.doc_id: r.score for r in bare.collect()} == {k: r.score for k, r in rows.items()}
