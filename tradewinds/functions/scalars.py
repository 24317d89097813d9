"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed of all white space; empty is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def description(name: Column, n_words: int = 4) -> Column:
    """The first words of a product's name in capitals.

    Parts are divided by ~. Where the first part looks like a code (no blank, but a digit or a dash), the second one counts.
    """
    parts = F.split(F.upper(name), "~")
    first = F.trim(F.try_element_at(parts, F.lit(1)))
    text = F.when(~F.contains(first, F.lit(" ")) & first.rlike("[0-9-]"), F.try_element_at(parts, F.lit(2))).otherwise(first)
    words = F.filter(F.split(F.regexp_replace(text, "[^A-ZÁÉÍÓÚÑ ]", " "), " "), lambda w: w != "")
    return F.nullif(F.array_join(F.slice(words, 1, n_words), " "), F.lit(""))


def normalize_code(c: Column) -> Column:
    """Leading digits without leading zeros; all zeros give '0', anything else null."""
    digits = F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit(""))
    return F.when(digits.isNotNull(), F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))


def prefixes(code: Column) -> list[Column]:
    """hs6 (six zeros where there is no code), chapter and hs4 of a customs code."""
    hs6 = F.coalesce(F.substring(code, 1, 6), F.lit("000000"))
    return [hs6.alias("hs6"), F.substring(hs6, 1, 2).alias("chapter"), F.substring(hs6, 1, 4).alias("hs4")]


def starts_with(c: Column, *prefixes_: str) -> Column:
    """Whether a text begins with one of the prefixes; null does not."""
    out = F.lit(False)
    for p in prefixes_:
        out = out | F.startswith(c, F.lit(p))
    return F.coalesce(out, F.lit(False))


def scaled(c: Column, unit: float = 1e6) -> Column:
    return c / unit


def title(c: Column, small: tuple[str, ...] = ("of", "and", "the")) -> Column:
    """Words with a capital first letter, but for small words after the first."""
    return F.array_join(F.transform(F.split(F.lower(c), " "), lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.initcap(w))), " ")


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where either is not above 0."""
    return F.when((a > 0) & (b > 0), a / b)


def parse_date(c: Column) -> Column:
    return F.try_to_date(F.nullif(c, F.lit("00000000")), "ddMMyyyy")


def parse_amount(c: Column) -> Column:
    """A number with decimal comma; what a number's letters would spell (nan, 1d) is none."""
    return F.when(c.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"), F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))


def month_index(period: Column) -> Column:
    """Months since year 0 of 'yyyy-MM'."""
    return (F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int")).cast("int")


def months_between(a: Column, b: Column) -> Column:
    return month_index(a) - month_index(b)


def quantile_bucket(rank: Column, n: Column, q: int) -> Column:
    """The bucket of a rank among n when ranks are cut at their quantiles: edges at 1 + (n - 1) k / q, right-closed."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * q / F.greatest(F.lit(1), n - 1))).cast("int")
