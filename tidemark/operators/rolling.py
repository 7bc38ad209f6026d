"""Rolling totals over trailing periods, days without activity included.

Rows are first summed per entity and day. That bounds an entity to one row per calendar
day, so the window's partition cannot grow with repeated or hot rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, entity: str, day: str, **totals: Column) -> DataFrame:
    """Sums per entity and day, partial sums before the shuffle. A NULL value adds nothing; NULL keys are left out."""
    return (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity), F.col(day).alias("day"))
        .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in totals.items()])
    )


def densify(active: DataFrame, entity: str, values: list[str]) -> DataFrame:
    """The entity-calendar product from each entity's first to last active day; new days hold 0.

    Each active day is unfolded up to the day before the next one. That yields exactly the rows
    of (entity x calendar) within the entity's span, without joining a calendar, and leaves the
    data in the partitioning the trailing windows need.
    """
    line = Window.partitionBy(entity).orderBy("day")
    reach = F.coalesce(F.date_sub(F.lead("day").over(line), 1), F.col("day"))
    return (
        active.select(entity, "day", reach.alias("__to"), *values)
        .select(entity, F.col("day").alias("__day"), F.explode(F.sequence("day", "__to")).alias("day"), *values)
        .select(entity, "day", *[F.when(F.col("day") == F.col("__day"), F.col(v)).otherwise(0.0).alias(v) for v in values])
    )


def trailing(dense: DataFrame, entity: str, value: str, spans: tuple[int, ...], prefix: str = "sum") -> DataFrame:
    """``{prefix}_{n}`` and ``avg_{n}`` over the last n calendar days, plus ``span_day`` (1 on the first day).

    On dense rows n days are n rows. Averages divide by n, days without activity included, and are
    NULL before n days have passed.
    """
    line = Window.partitionBy(entity).orderBy("day")
    out = dense.withColumn("span_day", F.row_number().over(line))
    for n in spans:
        out = out.withColumn(f"{prefix}_{n}", F.sum(value).over(line.rowsBetween(-(n - 1), 0)))
    return out.withColumns({f"avg_{n}": F.when(F.col("span_day") >= n, F.col(f"{prefix}_{n}") / n) for n in spans})


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals and averages per entity and calendar day: entity, day, total, span_day, sum_n, avg_n."""
    return trailing(densify(daily(df, entity, day, total=F.col(value)), entity, ["total"]), entity, "total", spans)


def median_of_list(values: Column) -> Column:
    """Interpolated median of an array without NULLs; NULL if it is empty."""
    x, k = F.sort_array(values), F.size(values)
    mid = (F.element_at(x, F.floor((k + 1) / 2).cast("int")) + F.element_at(x, F.floor(k / 2).cast("int") + 1)) / 2
    return F.when(k > 0, mid)


def trailing_figures(probes: DataFrame, numbered: DataFrame, keys: list[str], std_of: str, std_rows: int, median_of: str, median_rows: int) -> DataFrame:
    """Sample deviation and median over the last rows up to each probe: ``keys``, trail_std, trail_median.

    ``probes`` is unique in ``keys`` (the first is the entity) and has ``h``, the number of the last row it sees;
    ``numbered`` has the entity, ``seq`` (1, 2, ... within it) and the values. An entity's rows become one sorted array, of
    which each probe takes its slices: work is done for the probes' own rows only, and nothing is shuffled but by entity. An
    entity has a row per day, so the calendar bounds its array. NULL values are left out; a probe without
    rows gives no row.
    """
    e = keys[0]
    lines = numbered.groupBy(e).agg(F.sort_array(F.collect_list(F.struct("seq", F.col(std_of).alias("s"), F.col(median_of).alias("m")))).alias("__x"))
    part = lambda rows: F.slice("__x", F.greatest(F.col("h") - (rows - 1), F.lit(1)).cast("int"), F.least(F.col("h"), F.lit(rows)).cast("int"))
    near = probes.where("h > 0").join(lines, e)
    # the median is a column of its own before the unfolding, else it would be made again for every unfolded value
    near = near.select(*keys, median_of_list(F.array_compact(part(median_rows)["m"])).alias("__mid"), part(std_rows)["s"].alias("__list"))
    return near.select(*keys, "__mid", F.explode_outer("__list").alias("__s")).groupBy(*keys).agg(F.stddev_samp("__s").alias("trail_std"), F.max("__mid").alias("trail_median"))


def trailing_at(
    probes: DataFrame,
    bars: DataFrame,
    entity: str,
    probe_day: str,
    *,
    std_of: str,
    std_rows: int,
    median_of: Column,
    median_rows: int,
) -> DataFrame:
    """Sample deviation and median over the last rows up to each probe's day (inclusive).

    ``bars`` must hold one row per entity and ``day``. Bars and distinct probe days are laid on one line per
    entity, where a running count numbers the bars and tells each probe the last one it sees; figures are then
    made at the probes only. NULL values inside the rows are left out; the deviation needs two values, the
    median one, else NULL. Probes without an earlier bar get NULLs; probes with a NULL key or day are dropped.
    Adds ``trail_std``, ``trail_median``.
    """
    left = probes.select(F.col(entity).cast("long").alias("__e"), F.col(probe_day).alias("__d")).where("__e is not null and __d is not null").distinct()
    right = bars.select(F.col(entity).cast("long").alias("__e"), F.col("day").alias("__d"), F.col(std_of).alias("__std"), median_of.alias("__med"), F.lit(1).alias("__n"))
    line = Window.partitionBy("__e").orderBy("__d", F.col("__n").asc_nulls_last())
    both = right.unionByName(left, allowMissingColumns=True).withColumn("seq", F.count("__n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    asked = both.where("__n is null and seq > 0").select("__e", "__d", F.col("seq").alias("h"))
    figures = trailing_figures(asked, both.where("__n is not null"), ["__e", "__d"], "__std", std_rows, "__med", median_rows)
    own = [c for c in probes.columns if c not in ("trail_std", "trail_median")]
    on = [F.col(entity).cast("long") == F.col("__e"), F.col(probe_day) == F.col("__d")]
    return probes.where(F.col(entity).isNotNull() & F.col(probe_day).isNotNull()).select(*own).join(figures, on, "left").drop("__e", "__d")
