"""Statistics of texts as Spark expressions: words, symbols, repeated lines and repeated phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.llm.common import WHITE

SYMBOLS = "[#*$%&|<>]"

#: Rates that rules may test, over the counts of `text_stats`.
RATES = (
    "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "bang_rate", "pipe_rate", "comma_rate",
    "words_per_line",
)


def _count_of(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


def _windows(words: Column, n: Column) -> Column:
    """A 64-bit hash of the three words that start at each place; none with fewer words."""
    places = F.when(n >= 3, F.sequence(F.lit(0), (n - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _words_in_repeats(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Sorting (hash, place) puts equal windows side by side; the marked places, in order, each
    cover three words less what the next one covers too."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.when((x["h"] == before) | (x["h"] == after), x["i"])

        return F.sort_array(F.filter(F.transform(s, place), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    # One-element arrays bind the sorted pairs and the places to a name, so each is made once.
    places = F.transform(F.array(pairs), marked)
    return F.get(F.transform(places, covered), F.lit(0))


def text_stats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document: the id, the columns `keep`, exact counts and the rates named in `RATES`.

    A null text counts as empty: all counts and rates 0.  Repeated rows give repeated rows;
    further columns of `docs`, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("t"))
    carried = ["doc_id", *keep]
    words = F.filter(F.split("t", WHITE, -1), lambda w: w != "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = once(step, {"words": words, "lines": lines, "t": F.col("t")}, carried)
    n = F.size("words").cast("long")
    step = once(
        step,
        {
            "n_words": n,
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_bang": _count_of(F.col("t"), "!"),
            "n_pipe": _count_of(F.col("t"), "|"),
            "n_comma": _count_of(F.col("t"), ","),
            "hashes": _windows(F.col("words"), n),
        },
        carried,
    )
    repeats = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"), _words_in_repeats(F.col("hashes"))
    ).otherwise(F.lit(0).cast("long"))
    step = once(step, {"n_repeat_words": repeats}, [c for c in step.columns if c != "hashes"])

    def rate(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    return step.select(
        "*",
        rate("word_chars", "n_words").alias("mean_word"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_bang", "n_words").alias("bang_rate"),
        rate("n_pipe", "n_words").alias("pipe_rate"),
        rate("n_comma", "n_words").alias("comma_rate"),
        rate("n_words", "n_lines").alias("words_per_line"),
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, at_most: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, y) of at most `at_most` labelled documents, those with the smallest id hashes.

    Labels that are null, or that contradict each other for one id, and null ids take no part.
    The sample's ids are bounded by `at_most` (16 bytes each), so they are broadcast.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("k"))
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi")
        .select("k", F.col("lo").cast("int").alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(at_most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("k")).select("doc_id", "text", "y")
