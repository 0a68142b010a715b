"""Chat formatting: a role automaton and a declarative template, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.functions.rows import once


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles may follow which, and whose text is learned.

    A turn is `opener + role + divider + text + closer`.  `escapes` maps each control string
    to what stands for it inside texts; every stand-in starts with a backslash, and backslashes
    themselves are written `\\b`, so control strings occur nowhere but as marks.
    """

    opener: str = "### "
    divider: str = ": "
    closer: str = " </turn>\n"
    end_mark: str = "</turn>"
    follows: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    learned: Sequence[str] = ("assistant",)

    @property
    def escapes(self) -> tuple[tuple[str, str], ...]:
        return (
            ("\\", "\\b"),
            (self.end_mark, "\\l" + self.end_mark[1:]),
            (self.opener, "\\h" + self.opener[1:]),
        )

    def escape(self, text: Column) -> Column:
        for plain, coded in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(coded))
        return text

    def unescape(self, text: Column) -> Column:
        """Each backslash begins a code until the last step, which alone makes backslashes."""
        for coded, plain in (("\\l", self.end_mark[0]), ("\\h", self.opener[0]), ("\\c", ":"), ("\\b", "\\")):
            text = F.replace(text, F.lit(coded), F.lit(plain))
        return text

    def role_name(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit(":"), F.lit("\\c"))


def format_chats(
    rows: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments array<(text, loss)>, formatted,
    valid, bad_turn (place of the first turn that the automaton refuses, from 0; null if none).

    Turns are ordered by (turn, role, text), null turns first; repeated rows are repeated turns.
    Null texts and roles are empty strings (no automaton step allows an empty role), a null
    conversation id is a conversation of its own.  An empty table gives no rows.  All turns of
    one conversation meet in one row, because its formatted text is one value.
    """
    t = template or Template()
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    steps = F.array(*[F.lit(f"{a}>{b}") for a, then in t.follows.items() for b in then])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        allowed = F.array_contains(steps, F.concat(s["state"], F.lit(">"), x["role"]))
        return F.struct(
            x["role"].alias("state"),
            (s["n"] + 1).alias("n"),
            F.when(s["bad"].isNotNull() | allowed, s["bad"]).otherwise(s["n"]).alias("bad"),
        )

    def pieces(x: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        return F.array(
            piece(F.concat(F.lit(t.opener), t.role_name(x["role"]), F.lit(t.divider)), no),
            piece(t.escape(x["text"]), x["role"].isin(*t.learned)),
            piece(F.lit(t.closer), no),
        )

    made = once(
        grouped,
        {
            "n_turns": F.size("turns").cast("long"),
            "segments": F.flatten(F.transform("turns", pieces)),
            "bad_turn": F.aggregate("turns", start, step, lambda s: s["bad"]),
        },
        ["conv_id"],
    )
    return made.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("bad_turn").isNull().alias("valid"),
        "bad_turn",
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    t = template or Template()
    parts = F.split(formatted, "\\Q" + t.closer + "\\E", -1)

    def turn(part: Column) -> Column:
        cut = F.instr(part, t.divider)
        first = len(t.opener) + 1
        role = F.substr(part, F.lit(first), cut - first)
        text = F.substr(part, cut + len(t.divider))
        return F.struct(t.unescape(role).alias("role"), t.unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_learned(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, as it was before escaping."""
    t = template or Template()
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), ""
    )
