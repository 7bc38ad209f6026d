"""As-of joins: the latest fact known at a probe's time.

One construction serves every variant: probes and facts are laid on one line per key, the last fact
is carried forward, and only the order of a probe and a fact of the same day tells "up to
and with" from "strictly before". The fact travels as one struct, so a NULL member of
the latest fact is never replaced by an older value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import require_columns


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str,
    columns: list[str],
    *,
    strict: bool = False,
    tie_break: list[Column] | None = None,
    how: str = "inner",
    as_of: str | None = None,
) -> DataFrame:
    """Backward as-of join. Adds ``columns`` of ``right`` (and its time as ``as_of`` if named) to ``left``.

    Of facts sharing key and time the one with the greatest ``tie_break`` (else the greatest
    ``columns``) stands. That choice is a partial aggregate before the shuffle, so a key holds one
    fact per distinct time however often rows repeat. Probes are reduced to distinct times too and
    joined back by key and time, so the sorted line of a hot key is as long as its calendar, not as
    its rows. Facts with a NULL key or time are left out; probes with one match nothing: they are
    dropped (inner) or kept with NULLs (left). An empty ``right`` gives no rows (inner) or NULLs. Left
    columns named like an added one are replaced. Without ``keys`` there is one line, of all distinct
    times, for facts of one quantity such as a rate series.
    """
    require_columns(left, [*keys, left_on], "left side")
    require_columns(right, [*keys, right_on, *columns], "right side")
    names = [f"__k{i}" for i in range(len(keys))]
    fact = F.struct(F.col(right_on).alias("__t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    order = F.struct(*(tie_break or []), *[F.col(c) for c in columns]) if (tie_break or columns) else F.lit(1)
    facts = (
        right.where(" and ".join(f"`{c}` is not null" for c in [*keys, right_on]))
        .select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(right_on).alias("__ts"), fact.alias("__f"), order.alias("__o"))
        .groupBy(*names, "__ts")
        .agg(F.max_by("__f", "__o").alias("__f"))
    )
    out = [*[F.col(f"__f.c{i}").alias(c) for i, c in enumerate(columns)], *([F.col("__f.__t").alias(as_of)] if as_of else [])]
    probes = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(left_on).alias("__ts"))
    probes = probes.where(" and ".join(f"{n} is not null" for n in [*names, "__ts"])).distinct()
    both = facts.withColumn("__side", F.lit(1 if strict else 0)).unionByName(probes.withColumn("__side", F.lit(0 if strict else 1)), allowMissingColumns=True)
    line = Window.partitionBy(*names).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    probe_side = F.lit(0 if strict else 1)
    near = both.select(*names, "__ts", "__side", F.last("__f", ignorenulls=True).over(line).alias("__f")).where((F.col("__side") == probe_side) & F.col("__f").isNotNull())
    on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]
    own = [c for c in left.columns if c not in columns and c != as_of]
    return left.join(near, [*on, F.col(left_on) == F.col("__ts")], how).select(*own, *out)


def asof_line(probes: DataFrame, facts: dict[str, DataFrame], key: str, at: str) -> DataFrame:
    """Several backward as-of joins on one line per key, one shuffle for all of them.

    ``facts`` are tables of ``key``, ``at`` and values, unique in (key, at); NULL keys and times are left out. Adds to each
    probe a struct per name: the newest row up to and with the probe's time (its values and, as ``at``, its own
    time), NULL where there is none. Probes stay as they are; those with a NULL key or time are dropped.
    """
    known = f"`{key}` is not null and `{at}` is not null"
    both = probes.where(known).withColumn("__probe", F.lit(1))
    for name, df in facts.items():
        row = F.struct(*[F.col(c) for c in df.columns if c != key])
        both = both.unionByName(df.where(known).select(key, at, row.alias(name), F.lit(0).alias("__probe")), allowMissingColumns=True)
    line = Window.partitionBy(key).orderBy(at, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({n: F.last(n, ignorenulls=True).over(line) for n in facts}).where("__probe = 1").drop("__probe")


def with_age_limit(joined: DataFrame, at: str, as_of: str, columns: list[str], max_days: int, status: str = "status") -> DataFrame:
    """After a left as-of join: facts older than ``max_days`` are blanked, with their day, and a status says why.

    ``status`` is 'ok', 'stale' (blanked for age) or 'no_filing' (nothing known). A probe without a
    time is 'no_filing'.
    """
    age = F.datediff(at, as_of)
    state = F.when(F.col(as_of).isNull() | F.col(at).isNull(), "no_filing").when(age > max_days, "stale").otherwise("ok")
    keep = lambda c: F.when(F.col(status) == "ok", F.col(c))
    return joined.withColumn(status, state).withColumns({c: keep(c) for c in [*columns, as_of]})


def forward_fill_series(calendar: DataFrame, series: DataFrame, day: str, value: str) -> DataFrame:
    """A dated series on every calendar day, last value carried; a calendar that begins before the series raises.

    Never fills backwards. ``series`` holds one number per day of one quantity.
    """
    first_day = calendar.agg(F.min(day)).first()[0]
    known = series.where(F.col(value).isNotNull())
    first_known = known.agg(F.min(day)).first()[0]
    if first_day is not None and (first_known is None or first_known > first_day):
        raise ValueError(f"the series begins on {first_known}, the calendar on {first_day}")
    return asof_join(calendar, known, [], day, day, [value])


def exact_cover(calendar: DataFrame, series: DataFrame, day: str, value: str) -> DataFrame:
    """Join a series that must have a value on every calendar day; a hole raises."""
    out = calendar.join(series.select(day, value), day, "left")
    holes = out.where(F.col(value).isNull()).limit(3).collect()
    if holes:
        raise ValueError(f"no value on {', '.join(str(r[day]) for r in holes)}")
    return out


def period_returns(points: DataFrame, levels: DataFrame, day: str, level: str) -> DataFrame:
    """As-of level at each point and the return to the next point: day, level, ret (NULL at the last)."""
    at = asof_join(points.select(day).distinct(), levels, [], day, day, [level])
    nxt = F.lead(level).over(Window.orderBy(day))
    return at.withColumn("ret", nxt / F.nullif(F.col(level), F.lit(0.0)) - 1)
