"""Checks of tables before use: one-pass summaries, multiplicity, runs and gaps, and the quarantine sink."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import known, present, ratio

# Fixed values of the bar check.
MAX_GAP, MAX_MOVE, MAX_STALE = 5, 0.40, 4


def integrity_summary(df: DataFrame, keys: list[str], day: str, entity: str) -> DataFrame:
    """One row: rows, NULLs per key, first and last day, distinct entities. A single pass."""
    nulls = [F.sum(F.col(k).isNull().cast("int")).cast("long").alias(f"null_{k}") for k in keys]
    return df.agg(F.count(F.lit(1)).alias("n"), *nulls, F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(entity).alias("entities"))


def multiplicity(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys, keys with several values, most values of a key."""
    each = df.where(F.col(key).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count(value).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("k") > 1).cast("int")).cast("long").alias("multiple"), F.max("k").alias("most"))


def coverage(df: DataFrame, value: str, subset: Column) -> DataFrame:
    """Share of rows with a value, overall and within ``subset``."""
    has = present(value).cast("double")
    return df.agg(F.avg(has).alias("overall"), F.avg(F.when(known(subset), has)).alias("in_subset"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stale_runs(bars: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """Longest run of equal consecutive values per entity: entity, longest."""
    line = Window.partitionBy(entity).orderBy(day)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(line)) & F.col(value).isNotNull(), 0).otherwise(1)
    isle = F.sum("__c").over(line.rowsBetween(Window.unboundedPreceding, 0))
    runs = bars.withColumn("__c", change).withColumn("__i", isle).groupBy(entity, "__i").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(entity).agg(F.max("run").alias("longest"))


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), by arithmetic: whole weeks, then what the weekday numbers say of the rest."""
    upto = lambda d: F.floor((F.unix_date(d) + 3) / 7) * 5 + F.least(F.pmod(F.unix_date(d) + 3, F.lit(7)), F.lit(5))
    return (upto(b) - upto(a)).cast("int")


def gap_check(bars: DataFrame, entity: str, day: str, worst: int = 3) -> DataFrame:
    """The ``worst`` longest gaps per entity in weekdays between consecutive bars: entity, day, gap, place."""
    line = Window.partitionBy(entity).orderBy(day)
    gaps = bars.select(entity, day, business_days(F.lag(day).over(line), F.col(day)).alias("gap")).where("gap is not null")
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("gap"), day))
    return gaps.withColumn("place", place).where(F.col("place") <= worst)


def bar_check(bars: DataFrame, entity: str, day: str, price: str) -> DataFrame:
    """Per entity: bars, bad_prices, gaps, big_moves, longest_stale, and hard and soft verdicts."""
    line = Window.partitionBy(entity).orderBy(day)
    df = bars.withColumns({"__gap": business_days(F.lag(day).over(line), F.col(day)), "__move": ratio(F.col(price), F.lag(price).over(line)) - 1})
    c = lambda cond: F.sum(known(cond).cast("int")).cast("long")
    out = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("bars"),
        c(F.col(price).isNull() | (F.col(price) <= 0)).alias("bad_prices"),
        c(F.col("__gap") > MAX_GAP).alias("gaps"),
        c(F.abs("__move") > MAX_MOVE).alias("big_moves"),
    )
    out = out.join(stale_runs(bars, entity, day, price).withColumnRenamed("longest", "longest_stale"), entity)
    return out.withColumns({"hard_fail": F.col("bad_prices") > 0, "soft_fail": (F.col("gaps") > 0) | (F.col("big_moves") > 0) | (F.col("longest_stale") > MAX_STALE)})


class IntegrityError(ValueError):
    """A table failed its checks and was put into quarantine."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _move(spark: SparkSession, a: str, b: str) -> None:
    src, fs = _fs(spark, a)
    dst, _ = _fs(spark, b)
    if fs.exists(dst):
        fs.delete(dst, True)
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {a} to {b}")


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], meta: dict | None = None) -> dict:
    """Write, check what was written, then move it into place - or beside it as ``*_SUSPECT`` and raise.

    ``checks`` are aggregate conditions that must be true. Rows, day range and settings go into a JSON
    side file. Nothing half-written or unchecked ever stands under ``path``.
    """
    spark = df.sparkSession
    temp, stem = f"{path.removesuffix('.parquet')}_TEMP.parquet", path.removesuffix(".parquet")
    df.write.mode("overwrite").option("compression", "zstd").parquet(temp)
    back = spark.read.parquet(temp)
    row = back.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in checks.items()]).first().asDict()
    failed = [k for k in checks if row[k] is not True]
    target = f"{stem}_SUSPECT.parquet" if failed else path
    _move(spark, temp, target)
    report = {"rows": row["rows"], "failed": failed, "path": target, **(meta or {})}
    write_sidecar(spark, f"{target.removesuffix('.parquet')}.json", report)
    if failed:
        raise IntegrityError(f"{target}: {', '.join(failed)}")
    return report


def promote(spark: SparkSession, path: str, checks: dict[str, Column]) -> None:
    """Move a quarantined table into place once its checks hold."""
    suspect = f"{path.removesuffix('.parquet')}_SUSPECT.parquet"
    row = spark.read.parquet(suspect).agg(*[c.alias(k) for k, c in checks.items()]).first()
    failed = [k for k in checks if row[k] is not True]
    if failed:
        raise IntegrityError(f"{suspect}: {', '.join(failed)}")
    _move(spark, suspect, path)


def write_sidecar(spark: SparkSession, path: str, report: dict) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(report, default=str, sort_keys=True).encode()))
    finally:
        out.close()


def pull_coverage(bars: DataFrame, expected: DataFrame, key: str = "ticker") -> DataFrame:
    """Which of the expected keys arrived: key, rows, first_day, last_day, missing."""
    got = bars.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return expected.select(key).distinct().join(got, key, "left").withColumn("missing", F.col("n").isNull()).withColumn("n", F.coalesce("n", F.lit(0)))


def require_coverage(report: DataFrame, key: str = "ticker") -> DataFrame:
    """The report of pull_coverage(), or IntegrityError naming keys that did not arrive."""
    gone = [str(r[0]) for r in report.where("missing").select(key).orderBy(key).limit(20).collect()]
    if gone:
        raise IntegrityError(f"nothing arrived for {', '.join(gone)}")
    return report


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Files in the order of ``keys``, rows in order within them: a read of the files by name gives one fixed order."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
