"""Format-preserving pseudonyms: keyed Feistel permutations of validated numbers, dates and addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairntrace.functions.rows import once
from cairntrace.llm.common import free_name

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")

# The written forms that are looked for, in order of precedence.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\d])",
}
PATTERN = "|".join(FORMS[k] for k in KINDS)

#: Dates from 1900-01-01 to 2099-12-31 are 17 x 4297 days; other years are permuted within themselves.
FIRST_DAY, LAST_DAY, DAY_RADIX = "1900-01-01", "2099-12-31", (17, 4297)


def _noise(key: str, kind: str, i: Column, value: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b): halves are shifted in turn by a
    keyed function of the other half, modulo their own size, which is undone step by step."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _noise(key, kind, i, s["r"]), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _noise(key, kind, i, s["l"]), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _pad(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def luhn_sum(digits: Column) -> Column:
    """Digit sum in which each second digit from the right is doubled."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refill(form: Column, digits: Column) -> Column:
    """The digits of `form` replaced by `digits`, in order; other characters stay."""

    def at(i: Column) -> Column:
        c = F.substr(form, i, F.lit(1))
        k = F.length(_digits(F.substr(form, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, k, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def _permuted_digits(key: str, kind: str, digits: Column) -> Column:
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1)
    pair = feistel(key, kind, left, right, _ten_to(half), _ten_to(rest))
    return _bound(pair, lambda p: F.concat(_pad(p["l"], half), _pad(p["r"], rest)))


def _card(key: str, m: Column) -> Column:
    body = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 1)

    def whole(new: Column) -> Column:
        check = (10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
        return F.concat(new, check.cast("string"))

    return _refill(m, _bound(_permuted_digits(key, "card", body), whole))


def _phone(key: str, m: Column) -> Column:
    d = _digits(m)
    return _refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _permuted_digits(key, "phone", F.right(d, F.lit(10)))))


def _ssn(key: str, m: Column) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999: 898 x 99 by 9999."""
    area, group, serial = (F.substring(m, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    place = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    pair = feistel(key, "ssn", place, serial - 1, F.lit(898 * 99), F.lit(9999))

    def shown(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.concat_ws("-", _pad(a, F.lit(3)), _pad(p["l"] % 99 + 1, F.lit(2)), _pad(p["r"] + 1, F.lit(4)))

    return _bound(pair, shown)


def _ip(key: str, m: Column) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    pair = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))

    def shown(p: Column) -> Column:
        return F.concat_ws(".", *[x.cast("long").cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)])

    return _bound(pair, shown)


def _as_date(m: Column) -> Column:
    """The date that a written form names, null if there is none."""
    iso = F.when(m.rlike("^[0-9]{4}-"), m)
    iso = iso.when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    iso = iso.otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.when(F.substring(iso, 1, 4) != "0000", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def _date(key: str, m: Column) -> Column:
    day = _as_date(m)
    first = F.lit(FIRST_DAY).cast("date")
    inside = day.between(first, F.lit(LAST_DAY).cast("date"))
    base = F.when(inside, first).otherwise(F.make_date(F.year(day), F.lit(1), F.lit(1)))
    length = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    b = F.when(inside, F.lit(DAY_RADIX[1])).otherwise(F.when(length == 366, F.lit(61)).otherwise(F.lit(73)))
    a = F.when(inside, F.lit(DAY_RADIX[0])).otherwise(F.when(length == 366, F.lit(6)).otherwise(F.lit(5)))

    def moved(x: Column) -> Column:
        pair = feistel(key, "date", F.floor(x["n"] / x["b"]), x["n"] % x["b"], x["a"], x["b"])
        return _bound(pair, lambda p: F.date_add(x["base"], (p["l"] * x["b"] + p["r"]).cast("int")))

    def shown(d: Column) -> Column:
        return (
            F.when(m.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd"))
            .when(m.contains("/"), F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.date_format(d, "dd.MM.yyyy"))
        )

    parts = F.struct(F.datediff(day, base).alias("n"), a.alias("a"), b.alias("b"), base.alias("base"))
    return _bound(_bound(parts, moved), shown)


def _shifted(text: Column, noise: Column) -> Column:
    """Each ASCII letter or digit moved within its class by the noise byte of its place."""

    def one(c: Column, j: Column) -> Column:
        by = F.conv(F.substr(noise, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(first: str, size: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(size)) + ord(first))

        return (
            F.when(c.rlike("^[0-9]$"), within("0", 10))
            .when(c.rlike("^[a-z]$"), within("a", 26))
            .when(c.rlike("^[A-Z]$"), within("A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _email(key: str, m: Column) -> Column:
    """The local part is permuted among the names of the same pattern; the domain stays."""
    local = F.substring_index(m, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        def noise(value: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), value), 256)

        even = i % 2 == 0
        return F.struct(
            F.when(even, _shifted(s["l"], noise(s["r"]))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_shifted(s["r"], noise(s["l"]))).alias("r"),
        )

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1).alias("r"))
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _bound(pair, lambda p: F.concat(p["l"], p["r"], F.substr(m, F.length(local) + 1)))


def kind_of(m: Column) -> Column:
    """Which validated kind a match is, or null: what fails its validation is left alone."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    d = _digits(m)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(m.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit("ip")))
        .when(
            m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4})$"),
            F.when(_as_date(m).isNotNull(), F.lit("date")),
        )
        .when(
            m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            F.when(~m.rlike(r"^(000|666|9..)|-00-|-0000$"), F.lit("ssn")),
        )
        .when(m.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"),
              F.when(luhn_sum(d) % 10 == 0, F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """The keyed stand-in of a match of this kind, in the same format; unvalidated matches stay."""
    out = F.when(kind == "email", _email(key, m))
    for name, make in (("ip", _ip), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card)):
        out = out.when(kind == name, make(key, m))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the values in `text_col` replaced, and the array column `pii_kinds` of what
    was found (an existing column of that name is replaced).

    Card numbers must pass the Luhn test, addresses, dates and social security numbers must
    be possible ones; equal values become equal pseudonyms in every document, whatever
    separators they are written with, and different values of one format different ones.
    Null texts stay null, with no kinds.  Every row is returned once.
    """
    others = [c for c in docs.columns if c not in (text_col, "pii_kinds")]
    text = F.col(text_col)
    # Each form has one of these: addresses like 8.8.8.8 have no two digits side by side.
    worth = text.rlike(r"[0-9]{2}|[0-9]\.[0-9]|@")
    own = free_name(docs, "__m")
    found = once(
        docs,
        {
            text_col: text,
            own: F.when(worth, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))),
        },
        others,
    )
    named = once(
        found,
        {
            text_col: F.col(text_col),
            own: F.transform(own, lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))),
        },
        others,
    )
    swapped = F.zip_with(
        F.split(text_col, PATTERN, -1),
        own,
        lambda gap, m: F.concat(gap, F.coalesce(pseudonym(key, m["k"], m["m"]), F.lit(""))),
    )
    hits = F.coalesce(F.size(F.filter(own, lambda m: m["k"].isNotNull())), F.lit(0)) > 0
    kinds = F.filter(F.transform(own, lambda m: m["k"]), lambda k: k.isNotNull())
    return named.select(
        *others,
        F.when(hits, F.array_join(swapped, "")).otherwise(F.col(text_col)).alias(text_col),
        F.when(hits, kinds).otherwise(F.array().cast("array<string>")).alias("pii_kinds"),
    ).select(*[c for c in docs.columns if c != "pii_kinds"], "pii_kinds")
