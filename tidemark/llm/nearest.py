"""Pair records of two tables with the nearest record in time of the same entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_day: str,
    right_day: str,
    tolerance: int,
    *,
    payload: list[str] | None = None,
    block_days: int = 64,
) -> DataFrame:
    """Each left row with the right row nearest in days, at most ``tolerance`` away; inner.

    Both tables are united and sorted per entity and time; the last and the next right row
    are carried onto each left row and the nearer is kept, the earlier one when both are equally
    near. Adds ``match_day`` and a struct ``match`` of ``payload``.

    Scale: a tolerance bounds how far a partner can be, so the line of an entity is cut into blocks
    of ``block_days`` and a right row is repeated only into a block whose edge it is near to. A
    hot entity is so spread over the calendar. Before the shuffle left rows are reduced to
    distinct (key, day) probes and right rows to one per (key, day) - the greatest
    ``payload`` when several share a day - so a partition holds at most a block of days.

    Rows with a NULL key or day never match. Repeated left rows stay repeated. Columns of ``right``
    may share names with ``left``: only ``match`` and ``match_day`` are added (and replaced if there).
    """
    payload = payload or []
    right_key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    known = lambda day: F.expr(" and ".join(f"{n} is not null" for n in [*names, day]))
    day = F.unix_date(right_day).alias("__d")
    body = F.struct(F.lit(1).alias("__one"), *[F.col(c) for c in payload])
    facts = right.select(*right_key, day, body.alias("__p")).where(known("__d"))
    if payload:
        facts = facts.groupBy(*names, "__d").agg(F.max("__p").alias("__p"))
    block = lambda d: F.floor(d / block_days)
    d = F.col("__d")
    facts = facts.withColumn("__b", F.explode(F.sequence(block(d - tolerance), block(d + tolerance))))
    probes = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.unix_date(left_day).alias("__d")).where(known("__d")).distinct()
    both = facts.withColumn("__side", F.lit(0)).unionByName(
        probes.withColumns({"__b": block(d), "__side": F.lit(1)}), allowMissingColumns=True
    )
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__d").alias("d"), F.col("__p").alias("p")))
    carry = lambda order: F.last(seen, ignorenulls=True).over(
        Window.partitionBy(*names, "__b").orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    )
    near = both.select(*names, "__d", "__side", carry(d.asc()).alias("__last"), carry(d.desc()).alias("__next")).where("__side = 1")
    before, after = d - F.col("__last.d"), F.col("__next.d") - d
    take_last = F.col("__last").isNotNull() & (before <= tolerance) & (F.col("__next").isNull() | (before <= after))
    pick = F.when(take_last, F.col("__last")).when(F.col("__next").isNotNull() & (after <= tolerance), F.col("__next"))
    near = near.select(*names, d, pick.alias("__m")).where("__m is not null")
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]
    hit = left.withColumn("__left_day", F.unix_date(left_day)).join(near, [*on, F.col("__left_day") == d])
    match = F.struct(*[F.col(f"__m.p.{c}").alias(c) for c in payload]) if payload else None
    out = [*[F.col(c) for c in left.columns if c not in ("match", "match_day")], F.date_from_unix_date("__m.d").alias("match_day")]
    return hit.select(*out, *([match.alias("match")] if match is not None else []))
