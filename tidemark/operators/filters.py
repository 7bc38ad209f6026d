"""Row filters and summaries that several pipelines share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import known


def overlapping(windows: DataFrame, start: date, end: date, first: str = "first", last: str = "last") -> DataFrame:
    """Windows that touch [start, end]; an unreadable end touches nothing."""
    return windows.where(known((F.col(first) <= F.lit(end)) & (F.col(last) >= F.lit(start))))


def known_by(df: DataFrame, day: str, end: date) -> DataFrame:
    """Rows that were known by ``end``; a row without a day was not."""
    return df.where(known(F.col(day) <= F.lit(end)))


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """``n`` rows in the order of the MD5 of their keys and the seed: the same rows whatever the partitioning or the engine."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *keys).limit(n)


def head_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total order (a top-k, not a sort of everything)."""
    return df.orderBy(*order).limit(n)


class HoldOutRefused(ValueError):
    """A span reaches into the hold-out period without confirmation."""


def guard_span(start: date, end: date, hold_out_from: date, confirmed: bool = False) -> tuple[date, date]:
    if end >= hold_out_from and not confirmed:
        raise HoldOutRefused(f"{start}..{end} reaches into the hold-out from {hold_out_from}")
    return start, end


def group_summary(df: DataFrame, by: list[str], day: str, tie: str, columns: list[str]) -> DataFrame:
    """Per group: n, first and last day, and ``columns`` of the first and of the last row (``tie`` decides within a day)."""
    row = F.struct(F.col(day), F.col(tie), *[F.col(c) for c in columns])
    out = df.where(F.col(day).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("__a"), F.max(row).alias("__z"))
    pick = [F.col(f"__{k}.{c}").alias(f"{name}_{c}") for k, name in (("a", "first"), ("z", "last")) for c in [day, *columns]]
    return out.select(*by, "n", *pick)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def median_lag(df: DataFrame, by: list[str], early: str, late: str) -> DataFrame:
    """Median number of days from ``early`` to ``late`` per group, over rows that have both."""
    return df.where(F.col(early).isNotNull() & F.col(late).isNotNull()).groupBy(*by).agg(F.median(F.datediff(late, early)).alias("median_lag"), F.count(F.lit(1)).alias("n"))


def corpus_funnel(sections: DataFrame, filing: str, section: str, text: str, names: tuple[str, ...]) -> DataFrame:
    """One row: filings, and how many have each section and none at all."""
    has = lambda n: F.max(known((F.col(section) == n) & (F.length(F.trim(F.col(text))) > 0)).cast("int"))
    each = sections.groupBy(filing).agg(*[has(n).alias(n) for n in names])
    some = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    c = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return each.agg(F.count(F.lit(1)).alias("filings"), *[c(F.col(n)).alias(f"with_{n}") for n in names], c((some == 0).cast("int")).alias("without_any"))


def walk_forward(days: DataFrame, day: str, folds: int, purge_days: int, embargo_days: int) -> DataFrame:
    """Expanding folds over a calendar: fold, train_to, test_from, test_to.

    The calendar is cut into ``folds`` + 1 stretches of equal length; fold k tests on stretch k + 1 and trains on what lies
    ``purge_days`` before it; ``embargo_days`` after each test stretch are left out of later training by moving its start.
    """
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("z")).where("a is not null")
    length = (F.datediff("z", "a") + 1) / (folds + 1)
    k = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    f = span.select("a", "z", length.alias("len"), k)
    edge = lambda n: F.date_add("a", F.floor(F.col("len") * n).cast("int"))
    start = F.when(F.col("fold") > 1, F.date_add(edge(F.col("fold")), embargo_days)).otherwise(edge(F.col("fold")))
    return f.select("fold", F.date_sub(start, purge_days + 1).alias("train_to"), start.alias("test_from"), F.date_sub(edge(F.col("fold") + 1), 1).alias("test_to"))
