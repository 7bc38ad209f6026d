"""Statistics that decide whether a text feature may be used."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udf
from pyspark.sql.types import DoubleType

from ..functions.scalars import no_nan
from .harness import spearman_by

# Thresholds of the audit.
AGREE_GOOD, AGREE_WEAK, MANY_WEAK = 0.70, 0.50, 3
SHIFT_RHO, SHIFT_P, SHIFT_SD, IC_CEILING, AGREE_FLOOR, LEAST = 0.05, 0.01, 0.5, 0.08, 0.40, 20


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation under the t distribution with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    t2 = rho * rho * (n - 2) / (1.0 - rho * rho)
    return incomplete_beta((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))


p_value = udf(correlation_p, DoubleType())  # one call per feature, never per row


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(no_nan(x).isNotNull() & no_nan(y).isNotNull())


def masked_probe(df: DataFrame, by: list[str], shift: str, ret: str) -> DataFrame:
    """Does the change that masking causes know the future? by, rho, n, p, rejected.

    Fewer than twenty pairs or a constant side are not rejected.
    """
    r = spearman_by(df, by, shift, ret, least=LEAST, out="rho").drop("n_missing")
    r = r.withColumn("p", p_value("rho", F.col("n").cast("int")))
    return r.withColumn("rejected", F.coalesce((F.abs("rho") >= SHIFT_RHO) & (F.col("p") < SHIFT_P), F.lit(False)))


def identity_sensitivity(df: DataFrame, by: list[str], shift: str, value: str) -> DataFrame:
    """Mean absolute shift against the feature's spread: by, mean_shift, sd, sensitive."""
    out = df.groupBy(*by).agg(F.avg(F.abs(no_nan(shift))).alias("mean_shift"), F.stddev_pop(no_nan(value)).alias("sd"))
    return out.withColumn("sensitive", F.coalesce(F.col("mean_shift") > SHIFT_SD * F.col("sd"), F.lit(False)))


def within_date_ic(df: DataFrame, by: list[str], day: str, value: str, ret: str) -> DataFrame:
    """Mean rank correlation over the dates that have one: by, mean_ic, dates, quarantined (above the ceiling)."""
    ic = spearman_by(df, [*by, day], value, ret)
    out = ic.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("dates"))
    return out.withColumn("quarantined", F.coalesce(F.abs("mean_ic") > IC_CEILING, F.lit(False)))


def agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    r = spearman_by(df, by, a, b, least=LEAST, out="rho").drop("n_missing")
    return r.withColumn("agrees", F.coalesce(F.col("rho") >= AGREE_FLOOR, F.lit(False)))


def compare_extractors(a: DataFrame, b: DataFrame, key: str, features: list[str]) -> DataFrame:
    """feature, n, spearman, pearson, mean_a, mean_b, mean_abs_diff over the keys both have."""
    both = a.select(key, *[F.col(f).alias(f"{f}_a") for f in features]).join(b.select(key, *[F.col(f).alias(f"{f}_b") for f in features]), key)
    each = [F.struct(F.lit(f).alias("feature"), no_nan(f"{f}_a").alias("a"), no_nan(f"{f}_b").alias("b")) for f in features]
    long = both.select(F.explode(F.array(*each)).alias("s")).select("s.*").where("a is not null and b is not null")
    sd = F.stddev_pop("a") * F.stddev_pop("b")
    plain = long.groupBy("feature").agg(
        F.when(sd > 0, F.covar_pop("a", "b") / F.nullif(sd, F.lit(0.0))).alias("pearson"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff")
    )
    return spearman_by(long, ["feature"], "a", "b", least=3, out="spearman").drop("n_missing").join(plain, "feature")


def extractor_verdict(compared: DataFrame) -> DataFrame:
    """One row over compare_extractors(): features, median_spearman, good, weak and verdict.

    'tracks' if the median is good and no feature weak; 'diverges' if the median or MANY_WEAK features are weak; else 'mixed'. NULL
    without any correlation.
    """
    r = F.col("spearman")
    c = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0)).cast("long")
    out = compared.agg(F.count(r).alias("features"), F.median(r).alias("median_spearman"), c(r >= AGREE_GOOD).alias("good"), c(r < AGREE_WEAK).alias("weak"))
    m, weak = F.col("median_spearman"), F.col("weak")
    verdict = F.when(m.isNull(), F.lit(None)).when((m >= AGREE_GOOD) & (weak == 0), "tracks").when((weak >= MANY_WEAK) | (m < AGREE_WEAK), "diverges").otherwise("mixed")
    return out.withColumn("verdict", verdict)
