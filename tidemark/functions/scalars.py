"""Scalar expressions. All of them are JVM-side Column expressions.

A value that cannot be read is NULL, never an error and never a default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for "nothing here".
ABSENT_WORDS = ("", "nan", "none", "null", "<na>", "nat")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """True unless NULL or a word standing for blank. Never NULL."""
    return F.coalesce(~F.lower(F.trim(col(c).cast("string"))).isin(*ABSENT_WORDS), F.lit(False))


def parse_day(c: Column | str) -> Column:
    """A day string in ISO, slashed or compact form, with or without a time part -> DATE."""
    s = F.trim(col(c))
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})([T ].*)?$", 1)
    other = F.regexp_replace(
        F.regexp_extract(s, r"^(\d{4}/\d{2}/\d{2}|\d{8})([T ].*)?$", 1), r"^(\d{4})/?(\d{2})/?(\d{2})$", "$1-$2-$3"
    )
    return F.when(iso != "", iso.try_cast("date")).when(other != "", other.try_cast("date"))


def day_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def canon_cik(c: Column | str) -> Column:
    """Digits without leading zeros; '933136.0' is read as 933136; blank words give ''.

    Only whole, non-negative numbers are identifiers; anything else is ''.
    """
    s = F.trim(col(c).cast("string"))
    digits = F.regexp_extract(s, r"^(\d+)(\.0*)?$", 1)
    return F.coalesce(F.regexp_replace(digits, r"^0+(?=\d)", ""), F.lit(""))


def cik_from_url(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(?i)cik=0*(\d+)", 1), F.lit(""))


def acceptance_date(c: Column | str) -> Column:
    """Day of an ISO time stamp kept as text; NULL where the first ten characters are no date."""
    head = F.substring(col(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def no_nan(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(c: Column | str) -> Column:
    """Text to a finite double, else NULL."""
    return no_nan(col(c).try_cast("double"))


def clip(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bounds both-sided or one-sided; NULL stays NULL (greatest/least would skip it)."""
    x = c
    if low is not None:
        x = F.greatest(x, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        x = F.least(x, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), x)


def ratio(a: Column, b: Column) -> Column:
    """a/b, NULL where b is 0 or NULL (ANSI division would raise)."""
    return a / F.nullif(b, F.lit(0.0))


def blend(*signals: Column) -> Column:
    """Mean of signs; NULL if any is missing."""
    total = F.signum(signals[0])
    for s in signals[1:]:
        total = total + F.signum(s)
    return total / F.lit(float(len(signals)))


def known(c: Column) -> Column:
    """A predicate whose NULL counts as False."""
    return F.coalesce(c, F.lit(False))
