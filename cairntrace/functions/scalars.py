"""Column expressions for the text formats of scheduler logs and for derived job attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400

# Date formats, as the log writers print them (fields may lack leading zeros).
SLURM_DATE = "yyyy-M-d H:m[:s]"  # with 'T' or a blank between date and time
LIVE_DATE = "yyyy-M-d'T'H:m:s"
PBS_SLASHED_DATE, PBS_DASHED_DATE = "M/d/yyyy H:m[:s]", "yyyy-M-d H:m:s"
QSTAT_DATE = "MMM d H:m:s yyyy"

WHITESPACE = " \t\n\r\x0b\x0c"

# Words that stand for a missing field.
MISSING_WORDS = ("", "unknown", "none", "n/a")

# Job size classes by CPU count, user classes by mean over-request.
SIZE_CLASS_MAX_CPUS = (4, 16, 64)
OVERREQUEST_LOW, OVERREQUEST_HIGH = 0.90, 1.30

# Waste ratio up to which node fit is a low or a medium risk.
WASTE_LOW, WASTE_MEDIUM = 0.15, 0.35


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def present(c: Column) -> Column:
    """Trimmed text, null for blanks and words meaning 'missing'."""
    return let(strip(c), lambda t: F.when(~F.lower(t).isin(*MISSING_WORDS), t))


def _epoch(text: Column, fmt: str) -> Column:
    # An explicit offset makes the result independent of the session time zone.
    return F.unix_seconds(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{fmt} Z")))


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _trunc(c: Column) -> Column:
    return c.try_cast("bigint")


# --------------------------------------------------------------------------- SWF


def swf_number(token: Column) -> Column:
    """SWF field as a double; '-1', blank and non-numbers are null."""
    return F.nullif(strip(token), F.lit("-1")).try_cast("double")


def swf_int(token: Column) -> Column:
    return _trunc(swf_number(token))


# --------------------------------------------------------------------------- Slurm


def slurm_datetime(c: Column) -> Column:
    """UTC epoch seconds of a sacct date, null for sentinels and unparsable text."""
    return _epoch(F.translate(present(c), "T", " "), SLURM_DATE)


def _clock_sec(clock: Column, fewest: int, most: int) -> Column:
    """Seconds of `[[D:]H:]M:S` text having between `fewest` and `most` whole-number parts."""
    weights = F.array(*[F.lit(w).cast("bigint") for w in (1, 60, 3600, DAY)])

    def total(parts: Column) -> Column:
        terms = F.zip_with(F.reverse(parts), F.slice(weights, F.lit(1), F.size(parts)), lambda p, w: _int(p) * w)
        summed = F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return F.when(F.size(parts).between(fewest, most), summed)

    return let(F.split(clock, ":"), total)


def elapsed_sec(c: Column) -> Column:
    """`[D-]H:M:S`, `M:S` or `S` in seconds."""

    def parse(text: Column) -> Column:
        clock = _clock_sec(F.regexp_replace(text, "^[^-]*-", ""), 1, 3)
        days = F.when(F.contains(text, F.lit("-")), _int(F.substring_index(text, "-", 1))).otherwise(0)
        return clock + days * DAY

    return let(present(c), parse)


def slurm_memory_mb(c: Column) -> Column:
    """ReqMem in MB: per-CPU/per-node suffix dropped, units K/M/G/T, MB without one, '0' is null."""

    def parse(bare: Column) -> Column:
        unit = F.lower(F.regexp_extract(bare, "([KkMmGgTt])$", 1))
        factor = F.when(unit == "k", 1.0 / 1024).when(unit == "g", 1024.0).when(unit == "t", 1024.0 * 1024)
        return _trunc(F.rtrim(bare, F.lit("KkMmGgTt")).try_cast("double") * factor.otherwise(1.0))

    return let(F.regexp_replace(F.nullif(present(c), F.lit("0")), "[cn]$", ""), parse)


def slurm_job_id(c: Column) -> Column:
    """struct(id, array_index, is_step) of `123`, `123_4`, `123.batch`, `123_4.0`; other text as is."""

    def parse(text: Column) -> Column:
        base = F.substring_index(text, ".", 1)
        known = text.rlike(r"^\d+(_\d+)?(\..+)?$")
        index = F.when(known & F.contains(base, F.lit("_")), F.substring_index(base, "_", -1))
        return F.struct(
            F.when(known, base).otherwise(text).alias("id"),
            index.alias("array_index"),
            (known & F.contains(text, F.lit("."))).alias("is_step"),
        )

    return let(strip(c), parse)


def slurm_state(c: Column) -> Column:
    """First word of the state, upper case; blank is UNKNOWN."""
    text = F.upper(strip(c))
    return F.when(F.coalesce(text, F.lit("")) == "", "UNKNOWN").otherwise(F.get(F.split(text, r"\s+"), F.lit(0)))


def live_time_sec(c: Column) -> Column:
    return F.coalesce(elapsed_sec(c), F.lit(0))


def live_datetime(c: Column) -> Column:
    return _epoch(c, LIVE_DATE)


# --------------------------------------------------------------------------- PBS


def pbs_timestamp(c: Column) -> Column:
    """Positive epoch integer, or a date in one of the log's formats."""

    def parse(text: Column) -> Column:
        return (
            F.when(_int(text) > 0, _int(text))
            .when(F.contains(text, F.lit("/")), _epoch(text, PBS_SLASHED_DATE))
            .when(F.contains(text, F.lit("-")), _epoch(text, PBS_DASHED_DATE))
        )

    return let(strip(c), parse)


def pbs_walltime_sec(c: Column) -> Column:
    """`D:H:M:S`, `H:M:S` or `M:S` in seconds."""
    return _clock_sec(strip(c), 2, 4)


def pbs_memory_mb(c: Column) -> Column:
    """Memory with b/kb/mb/gb/tb suffix in MB; a bare number counts as KB."""

    def parse(text: Column) -> Column:
        unit = F.regexp_extract(text, "([kmgt]?b)$", 1)
        factor = (
            F.when(unit == "mb", 1.0)
            .when(unit == "gb", 1024.0)
            .when(unit == "tb", 1024.0 * 1024)
            .when(unit == "b", 1.0 / (1024 * 1024))
            .otherwise(1.0 / 1024)
        )
        return _trunc(F.regexp_replace(text, "[kmgt]?b$", "").try_cast("double") * factor)

    return let(F.lower(strip(c)), parse)


def nodes_spec_cpus(c: Column) -> Column:
    """CPUs of a nodes spec such as `2:ppn=4+1:ppn=8`; null when it names none."""
    spec = F.regexp_replace(F.nullif(strip(c), F.lit("")), "(?i)^nodes=", "")

    def latest(numbers: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(numbers, lambda n: n.isNotNull()), F.lit(-1)), F.lit(1))

    def chunk_cpus(chunk: Column) -> Column:
        parts = F.transform(F.split(chunk, ":"), lambda p: F.lower(F.trim(p)))
        is_ppn = lambda p: F.startswith(p, F.lit("ppn="))
        ppn = latest(F.transform(F.filter(parts, is_ppn), lambda p: _int(F.substr(p, F.lit(5)))))
        nodes = latest(F.transform(F.filter(parts, lambda p: ~is_ppn(p)), _int))
        return nodes * ppn

    total = F.aggregate(
        F.transform(F.split(spec, r"\+"), chunk_cpus), F.lit(0).cast("bigint"), lambda acc, x: acc + x
    )
    return F.when(total > 0, total)


def spaced(text: Column) -> Column:
    """Text for `attribute`: blank at both ends, all white space a blank."""
    blank = F.lit(" ")
    return F.concat(blank, F.translate(text, "\t\n\x0b\f\r", " " * 5), blank)


def attribute(text: Column, key: str) -> Column:
    """Last value of `key` among the `key=value` tokens of a `spaced` text, null when absent or empty; values may hold '='."""
    lead = F.lit(f" {key}=")
    value = F.substring_index(F.substring_index(text, f" {key}=", -1), " ", 1)
    return F.when(F.contains(text, lead), F.nullif(value, F.lit("")))


def attribute_map(text: Column) -> Column:
    """All `key=value` tokens as a map; a repeated key keeps its last value."""
    pairs = F.filter(F.split(text, r"\s+"), lambda t: F.contains(t, F.lit("=")))
    keys = F.array_distinct(F.transform(pairs, lambda t: F.substring_index(t, "=", 1)))

    def value(key: Column) -> Column:
        hit = F.element_at(F.filter(pairs, lambda t: F.substring_index(t, "=", 1) == key), -1)
        return F.substr(hit, F.length(key) + 2)

    return F.map_from_arrays(keys, F.transform(keys, value))


def pbs_job_id(c: Column) -> Column:
    """Server suffix cut, `123[4]` written `123_4`."""
    return F.trim(F.translate(F.replace(F.substring_index(c, ".", 1), F.lit("["), F.lit("_")), "]", ""))


def qstat_walltime_sec(c: Column) -> Column:
    return F.coalesce(_clock_sec(c, 2, 3), F.lit(0))


def qstat_datetime(c: Column) -> Column:
    """`Mon Jan  5 10:00:00 2026` or ISO; the weekday is ignored, padding blanks collapse."""

    def parse(text: Column) -> Column:
        named = _epoch(F.regexp_replace(text, "^[A-Za-z]{3} (?=[A-Za-z])", ""), QSTAT_DATE)
        return F.when(F.contains(text, F.lit(" ")), named).otherwise(_epoch(text, LIVE_DATE))

    return let(F.regexp_replace(strip(c), r"\s+", " "), parse)


def leading_int(c: Column, default: int) -> Column:
    return F.coalesce(_int(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d+)", 1)), F.lit(default))


# --------------------------------------------------------------------------- replay logs


def replay_job_id(c: Column) -> Column:
    """Text after the last '!'; whole numbers lose a decimal part."""
    text = F.substring_index(c.cast("string"), "!", -1)
    return F.coalesce(_trunc(text.try_cast("double")).cast("string"), text)


def floor_ts(c: Column, fallback: Column) -> Column:
    """Whole seconds, never negative; unusable values take the fallback."""
    number = c.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0), F.floor(F.when(_finite(number), number)).cast("bigint")), fallback)


def positive_or(c: Column, fallback: Column) -> Column:
    number = c.try_cast("double")
    return F.when(_finite(number) & (number > 0), number).otherwise(fallback)


def positive_int_or(c: Column, fallback: Column) -> Column:
    number = c.try_cast("bigint")
    return F.when(number > 0, number).otherwise(fallback)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def profile_id(delay_sec: Column) -> Column:
    """`delay_ms_<milliseconds>`, at least 1."""
    ms = F.greatest(F.lit(1), F.bround(delay_sec * 1000.0).cast("bigint"))
    return F.concat(F.lit("delay_ms_"), ms.cast("string"))


# --------------------------------------------------------------------------- derived attributes


def overrequest_ratio(requested: Column, actual: Column) -> Column:
    return F.when(requested.isNotNull() & (actual > 0), requested.cast("double") / actual)


def hour_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(ts / F.lit(3600)), F.lit(24)).cast("int")


def day_of_week(ts: Column) -> Column:
    """Monday = 0 (the epoch was a Thursday)."""
    return F.pmod(F.floor(ts / F.lit(DAY)) + 3, F.lit(7)).cast("int")


def is_peak_hour(ts: Column) -> Column:
    return hour_of_day(ts).between(8, 18).cast("int")


def job_size_class(cpus: Column) -> Column:
    small, medium, large = SIZE_CLASS_MAX_CPUS
    return F.when(cpus <= small, 0).when(cpus <= medium, 1).when(cpus <= large, 2).otherwise(3)


def user_class(overrequest: Column) -> Column:
    return F.when(overrequest > OVERREQUEST_HIGH, 2).when(overrequest < OVERREQUEST_LOW, 0).otherwise(1)


def pinball(actual: Column, predicted: Column, alpha: float) -> Column:
    delta = actual - predicted
    return F.greatest(delta * F.lit(alpha), delta * F.lit(alpha - 1.0))


def abs_pct_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(1.0))


def from_log(c: Column, floor_sec: float = 1.0) -> Column:
    """Seconds of a log1p-scale prediction, floored."""
    return F.greatest(F.expm1(F.greatest(c, F.lit(0.0))), F.lit(floor_sec))


def in_order(*cols: Column) -> Column:
    """Values sorted ascending, so that quantile predictions never cross."""
    return F.array_sort(F.array(*cols))


def relative_divergence(observed: Column, candidate: Column, floor: float | None = None) -> Column:
    base = F.when(F.abs(observed) > 1e-9, F.abs(observed)).otherwise(F.lit(1.0))
    if floor is not None and floor > 0:
        base = F.greatest(base, F.lit(float(floor)))
    return F.abs(candidate - observed) / base


def waste_ratio(requested: Column, node: Column) -> Column:
    return F.when(node > 0, F.greatest(node - requested, F.lit(0)).cast("double") / node).otherwise(F.lit(0.0))


def waste_class(ratio: Column) -> Column:
    return F.when(ratio <= WASTE_LOW, 0).when(ratio <= WASTE_MEDIUM, 1).otherwise(2)


def risk_name(code: Column) -> Column:
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (code + 1).cast("int"))
