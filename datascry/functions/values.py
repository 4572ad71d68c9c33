"""Blank, number and date semantics of spreadsheet cells, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell patterns of the type system.
CURRENCY = r"^\s*[-(]?\s*[$€£¥₹]\s?-?[\d,]+(\.\d+)?\s*\)?\s*$"
PERCENT = r"^\s*-?[\d,]+(\.\d+)?\s*%\s*$"
NUMBER = r"^\s*-?[\d,]*\.?\d+([eE][-+]?\d+)?\s*$"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f")
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
DAY_MONTH_DATE = r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$"
MONTH_DAY_DATE = r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$"
ORDINAL = (
    "none", "very low", "low", "poor", "fair", "medium", "moderate", "average", "good", "high", "very high", "very good", "excellent",
)

BLANK = "(blank)"


def trimmed(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def blank_key(c: Column) -> Column:
    """The trimmed cell, or ``(blank)``: one group for all missing keys."""
    return F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit(BLANK))


def finite(c: Column) -> Column:
    """The number, or null where it is missing, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def parse_number(c: Column) -> Column:
    """Number in a text cell: sign or brackets for negative, currency signs,
    separators, percent signs and spaces dropped.

    A cell without any digit is missing; so is a hexadecimal one.
    """
    s = trimmed(c)
    bracketed = s.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    inner = F.regexp_replace(inner, r"[$€£¥₹,%\s]", "")
    minus = inner.startswith("-")
    body = F.when(minus, F.substr(inner, F.lit(2))).otherwise(inner)
    plain = F.when(body.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), body.try_cast("double"))
    return finite(F.when(bracketed | minus, -plain).otherwise(plain))


def _full_year(y: Column) -> Column:
    """Two-digit years: below 50 in the 2000s, others in the 1900s."""
    n = y.try_cast("int")
    return F.when(F.length(y) > 2, n).when(n < 50, n + 2000).otherwise(n + 1900)


def _day(y: Column, m: Column, d: Column) -> Column:
    """Midnight of a day that exists, else null."""
    said = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_timestamp(said, F.lit("yyyy-MM-dd"))


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.lower(F.substring(name, 1, 3)))
    return F.when(at % 4 == 1, F.floor((at - 1) / 4) + 1).cast("int")


def parse_date(c: Column) -> Column:
    """Timestamp in a text cell, or null.

    ISO days (with an optional time and offset) and month/day/year are checked
    against the calendar; in textual dates a day up to 31 may run over into
    the next month.
    """
    s = trimmed(c)

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))

    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?(Z|[+-]\d{2}:?\d{2})?)?$"
    hour, minute = part(iso, 4).try_cast("int"), part(iso, 5).try_cast("int")
    second = F.coalesce(part(iso, 6).try_cast("double"), F.lit(0.0))
    offset = part(iso, 7)
    shift = F.when(
        offset.rlike(r"^[+-]"),
        F.when(offset.startswith("-"), -1).otherwise(1)
        * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.regexp_extract(offset, r"(\d{2})$", 1).try_cast("int")),
    ).otherwise(0)
    seconds = (F.coalesce(hour, F.lit(0)) * 60 + F.coalesce(minute, F.lit(0)) - shift) * 60 + second
    in_day = (F.coalesce(hour, F.lit(0)) < 24) & (F.coalesce(minute, F.lit(0)) < 60) & (second < 60)
    iso_at = F.when(
        in_day,
        F.timestamp_micros(
            F.unix_micros(_day(part(iso, 1), part(iso, 2), part(iso, 3)).cast("timestamp")) + F.round(seconds * 1e6).cast("long")
        ),
    )
    slash = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    slash_at = _day(_full_year(part(slash, 3)), part(slash, 1), part(slash, 2))

    def textual(pattern: str, day: int, month: int, year: int) -> Column:
        d = part(pattern, day).try_cast("int")
        first = _day(_full_year(part(pattern, year)), _month_number(part(pattern, month)), F.lit(1))
        return F.when((d >= 1) & (d <= 31), F.timestamp_micros(F.unix_micros(first.cast("timestamp")) + (d - 1).cast("long") * 86_400_000_000))

    return (
        F.when(s.rlike(ISO_DATE), iso_at)
        .when(s.rlike(SLASH_DATE), slash_at.cast("timestamp"))
        .when(s.rlike(DAY_MONTH_DATE), textual(r"^(\d{1,2})-([A-Za-z]{3})-(\d{2,4})$", 1, 2, 3))
        .when(s.rlike(MONTH_DAY_DATE), textual(r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$", 2, 1, 3))
    )


def fmt_num(v: Column, currency: bool = False) -> Column:
    """Short display of a number: B, M and K from 1e9, 1e6 and 1e4; what shows as zero has no sign."""
    a = F.abs(v)
    sign = F.lit("$" if currency else "")

    def scaled(by: float, decimals: int, suffix: str) -> Column:
        return F.concat(sign, F.format_string(f"%.{decimals}f", v / F.lit(by)), F.lit(suffix))

    said = F.regexp_replace(F.regexp_replace(F.format_number(v, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.concat(sign, F.when(said == "-0", "0").otherwise(said))
    out = F.when(v.isNull() | F.isnan(v) | (a == F.lit(float("inf"))), F.lit("—"))
    out = out.when(a >= 1e9, scaled(1e9, 2, "B")).when(a >= 1e6, scaled(1e6, 2, "M")).when(a >= 1e4, scaled(1e3, 1, "K"))
    if not currency:
        out = out.when((a < 0.01) & (a > 0), F.regexp_replace(F.format_string("%.2e", v), r"e([+-])0?(\d)", "e$1$2"))
    return out.otherwise(plain)


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible")
    )


def overlap_label(v: Column) -> Column:
    return F.when(v >= 0.7, "near-duplicate").when(v >= 0.4, "strong").when(v >= 0.25, "substantive").otherwise("weak")


def ordinal_rank(c: Column) -> Column:
    """First number in a label, else its place among the ordinal words, else null."""
    s = trimmed(c)
    number = F.regexp_extract(F.regexp_replace(s, ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    words = F.array(*[F.lit(w) for w in ORDINAL])
    at = F.array_position(words, F.lower(s)) - 1
    return F.coalesce(number, F.when(at >= 0, at.cast("double")))
