"""Whose row is it? Ticker windows, identities of a ticker on a day, and bars.

A ticker is reused by later identities, and windows overlap by mistake. A day that
two identities claim belongs to none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import no_nan, parse_day


def usable_windows(df: DataFrame, keys: list[str], first: str = "firstpricedate", last: str = "lastpricedate") -> DataFrame:
    """Distinct windows whose first and last day are readable and in order (columns ``first``, ``last``)."""
    return (
        df.select(*keys, parse_day(first).alias("first"), parse_day(last).alias("last"))
        .where(F.col("first") <= F.col("last"))
        .distinct()
    )


def sole_owner_segments(windows: DataFrame, key: str = "ticker", owner: str = "permaticker") -> DataFrame:
    """Split each key's time line where ownership changes; keep stretches with one owner.

    An owner's own overlapping windows are fused first, so they count once. Then a
    sweep adds +1/+owner where a window opens and takes them off the day after it
    closes: where the running count is 1, the running sum *is* the owner. Linear in
    the windows, no pairwise comparison. Output: key, owner, seg_first, seg_last.

    Rows with a NULL key or owner own nothing. Empty input gives no rows.
    """
    w = windows.where(F.col(key).isNotNull() & F.col(owner).isNotNull()).select(key, owner, "first", "last")
    own = Window.partitionBy(key, owner).orderBy("first", "last")
    seen = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fused = (
        w.withColumn("opens", F.when(F.col("first") > F.date_add(seen, 1), 1).otherwise(0))
        .withColumn("isle", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, owner, "isle")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    big = F.col(owner).cast("long")
    edges = fused.select(
        key,
        F.explode(
            F.array(
                F.struct(F.col("first").alias("day"), F.lit(1).alias("n"), big.alias("who")),
                F.struct(F.date_add("last", 1).alias("day"), F.lit(-1).alias("n"), (-big).alias("who")),
            )
        ).alias("e"),
    )
    steps = edges.groupBy(key, F.col("e.day").alias("day")).agg(F.sum("e.n").alias("n"), F.sum("e.who").alias("who"))
    line = Window.partitionBy(key).orderBy("day")
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.select(
            key,
            F.col("day").alias("seg_first"),
            F.date_sub(F.lead("day").over(line), 1).alias("seg_last"),
            F.sum("n").over(run).alias("owners"),
            F.sum("who").over(run).alias(owner),
        )
        .where("owners = 1")
        .select(key, F.col(owner).cast("long").alias(owner), "seg_first", "seg_last")
    )


def attribute(facts: DataFrame, segments: DataFrame, key: str, day: str, owner: str = "permaticker") -> DataFrame:
    """Inner interval join: each fact gets the sole owner of its key on its day.

    An equality on ``key`` with the range as residual. Segments of a key are disjoint,
    so a fact matches at most once and the output is never larger than ``facts``.
    Which side is hashed or broadcast is left to the measured sizes.
    """
    s = segments.select(
        F.col(key).alias("__key"), F.col(owner).alias("__owner"), F.col("seg_first").alias("__a"), F.col("seg_last").alias("__b")
    )
    joined = facts.join(s, (F.col(key) == F.col("__key")) & F.col(day).between(F.col("__a"), F.col("__b")))
    return joined.withColumn(owner, F.col("__owner")).drop("__key", "__owner", "__a", "__b")


def _version(*content: Column) -> Column:
    """Sort code of a bar's version: day of the update, then a fixed order among equals."""
    age = F.coalesce(F.unix_date("lastupdated"), F.lit(-1_000_000)).cast("long")
    return F.shiftleft(age, 32) + F.xxhash64(*content).bitwiseAND(F.lit(0x7FFFFFFF))


def current_bars(prices: DataFrame, tickers: DataFrame, columns: tuple[str, ...] = ("closeadj", "volume", "ret")) -> DataFrame:
    """Per identity and day the row with the greatest ``lastupdated``, if its ``closeadj`` is not NULL.

    Only fixed-width aggregate buffers are used, so both passes stay hash aggregates.
    NaN counts as NULL. Rows without ticker, day or sole owner are ignored; rows equal in
    ``lastupdated`` are told apart by a fixed content code, so the choice is repeatable.
    """
    seg = sole_owner_segments(usable_windows(tickers, ["ticker", "permaticker"]))
    need = [*dict.fromkeys(["closeadj", *columns])]
    p = prices.select("ticker", F.col("date").alias("day"), "lastupdated", *[no_nan(c).alias(c) for c in need])
    p = attribute(p.where("ticker is not null and day is not null"), seg, "ticker", "day").select(
        "permaticker", "day", *need, _version(*[F.col(c) for c in need]).alias("__v")
    )
    return (
        p.groupBy("permaticker", "day")
        .agg(*[F.max_by(c, "__v").alias(c) for c in need])
        .where("closeadj is not null")
        .select("permaticker", "day", *columns)
    )
