"""Ranking diagnostics: rank correlation, its significance, decile tables, portfolios and leak controls.

A panel here has the columns ``by`` (one or more), an item, a score, a decile, a return and a status. The
per-group results (one row per date) are small; nothing before them is.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import no_nan
from ..session import staged
from .factors import Band, factor_scores, screen_grid

# Fixed values of the evaluation.
COST_GRID_BPS = (5.0, 10.0, 20.0)
NULL_SEED = 20260810
NULL_REPS = 25
MONTHS = 12.0


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman_by(df: DataFrame, by: list[str], x: str, y: str, *, least: int = 5, out: str = "ic") -> DataFrame:
    """Rank correlation per group over the rows where both are finite: by, ``out``, n, n_missing.

    NULL below ``least`` pairs or where a side is constant. The correlation is put together from
    moments, so a constant side never divides by zero (ANSI would raise).
    """
    df = df.select(*by, no_nan(x).alias("__x"), no_nan(y).alias("__y"))
    ok = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    ranked = df.withColumn("__ok", ok)
    part = [*by, "__ok"]
    ranked = ranked.withColumns({"__rx": F.when(ok, average_rank("__x", part)), "__ry": F.when(ok, average_rank("__y", part))})
    n = F.sum(ok.cast("int")).cast("long")
    sd = F.stddev_pop("__rx") * F.stddev_pop("__ry")
    varied = (F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry"))
    ic = F.when((n >= least) & varied, F.covar_pop("__rx", "__ry") / F.nullif(sd, F.lit(0.0)))
    return ranked.groupBy(*by).agg(ic.alias(out), n.alias("n"), (F.count(F.lit(1)) - n).alias("n_missing"))


def newey_west(series: DataFrame, order: str, value: str, lags: int | None = None, scenario: list[str] | None = None) -> DataFrame:
    """Mean of a dated series, its t-statistic with Bartlett weights, n and lags: one row, or one per ``scenario``.

    ``lags`` defaults to floor(n ** 0.25) + 1. Below three values t is NULL, as it is for a constant
    series. Autocovariances come from a join of the numbered series with itself on the lag, so
    rows are n times lags.
    """
    s = scenario or []
    part = Window.partitionBy(*s)
    df = series.where(F.col(value).isNotNull()).select(*s, F.row_number().over(part.orderBy(order)).alias("i"), F.col(value).alias("v"))
    df = df.withColumns({"n": F.count(F.lit(1)).over(part), "m": F.avg("v").over(part)})
    df = df.withColumns({"e": F.col("v") - F.col("m"), "lags": F.lit(lags) if lags is not None else (F.floor(F.pow("n", F.lit(0.25))) + 1).cast("int")})
    lagged = df.select(*s, F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("l"), (F.col("i") + F.col("l")).alias("i"), F.col("e").alias("e0"), "lags")
    pair = df.select(*s, "i", "e", "n", "m").join(lagged, [*s, "i"])
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("l") / (F.col("lags") + 1.0)))
    total = pair.groupBy(*s).agg(F.max("m").alias("mean"), F.max("n").alias("n"), F.max("lags").alias("lags"), F.sum(weight * F.col("e") * F.col("e0")).alias("__s"))
    se = F.sqrt(F.when(F.col("__s") > 0, F.col("__s"))) / F.col("n")
    return total.select(*s, "mean", F.when(F.col("n") >= 3, F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t_stat"), F.col("n").cast("long").alias("n"), F.col("lags").cast("int").alias("lags"))


def ic_summary(ic: DataFrame, value: str = "ic", scenario: list[str] | None = None) -> DataFrame:
    """One row (per ``scenario``): periods, mean, median and deviation of the correlation, and the share above 0 (rounding noise is 0)."""
    v = F.col(value)
    return ic.groupBy(*(scenario or [])).agg(
        F.count(v).alias("periods"), F.avg(v).alias("mean_ic"), F.median(v).alias("median_ic"), F.stddev_samp(v).alias("sd_ic"), F.avg(F.when(v.isNotNull(), (F.round(v, 12) > 0).cast("double"))).alias("share_positive")
    )


def bucket_returns(panel: DataFrame, by: list[str], decile: str, ret: str) -> DataFrame:
    """Equal-weight mean return per group and decile over the rows that have both."""
    return panel.where(F.col(decile).isNotNull() & no_nan(ret).isNotNull()).groupBy(*by, F.col(decile).alias("decile")).agg(F.avg(no_nan(ret)).alias("ret"))


def decile_table(panel: DataFrame, by: list[str], decile: str, ret: str, per_year: float = MONTHS, buckets: int = 10, scenario: list[str] | None = None) -> DataFrame:
    """decile 1..``buckets`` (per ``scenario``, which is among ``by``): mean, annualised Sharpe ratio, periods. A decile without rows stays, with 0 periods."""
    s = scenario or []
    monthly = bucket_returns(panel, by, decile, ret)
    sd = F.stddev_samp("ret")
    stats = monthly.groupBy(*s, F.col("decile").cast("int").alias("decile")).agg(
        F.avg("ret").alias("mean_ret"), (F.avg("ret") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(per_year))).alias("sharpe"), F.count(F.lit(1)).alias("periods")
    )
    number = F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("decile")
    every = panel.select(*s).distinct().select(*s, number) if s else panel.sparkSession.range(1).select(number)
    return every.join(stats, [*s, "decile"], "left").withColumn("periods", F.coalesce("periods", F.lit(0)).cast("long"))


def monotonicity(table: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """One row (per ``scenario``): rank correlation of decile with mean and with Sharpe, rising steps, top minus bottom."""
    s = scenario or []
    step = F.col("mean_ret") - F.lag("mean_ret").over(Window.partitionBy(*s).orderBy("decile"))
    full = table.withColumns({"step": step, "__k": F.lit(1)})
    k = [*s, "__k"]
    m = spearman_by(full, k, "decile", "mean_ret", least=3, out="spearman_ret").select(*k, "spearman_ret")
    r = spearman_by(full, k, "decile", "sharpe", least=3, out="spearman_sharpe").select(*k, "spearman_sharpe")
    has = F.when(F.col("mean_ret").isNotNull(), F.col("decile"))
    rest = full.groupBy(*k).agg(
        F.sum((F.col("step") > 0).cast("int")).cast("long").alias("rising"), (F.max_by("mean_ret", has) - F.min_by("mean_ret", has)).alias("top_minus_bottom")
    )
    return m.join(r, k).join(rest, k).drop("__k")


def portfolio_periods(panel: DataFrame, scenario: list[str], day: str, item: str, ret: str, pick: Column) -> DataFrame:
    """Equal-weight book of the picked rows per period: scenario, day, gross, turnover, members, dropped.

    Weights are 1/members; gross is the mean return of members that have one. Turnover compares the
    intended weights with those of the scenario's previous listed period; a name in one of them only
    counts with its whole weight, and the first period turns over everything.
    """
    held = panel.where(F.coalesce(pick, F.lit(False))).select(*scenario, day, item, no_nan(ret).alias("__r"))
    held = held.withColumn("__w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*scenario, day)))
    gross = held.groupBy(*scenario, day).agg(
        F.avg("__r").alias("gross"), F.count(F.lit(1)).alias("members"), F.sum(F.col("__r").isNull().cast("int")).cast("long").alias("dropped")
    )
    line = Window.partitionBy(*scenario).orderBy(day) if scenario else Window.orderBy(day)
    order = gross.select(*scenario, day).withColumn("__i", F.row_number().over(line))
    now = held.select(*scenario, day, item, "__w").join(order, [*scenario, day]).select(*scenario, "__i", item, F.col("__w").alias("w"), F.lit(0.0).alias("v"))
    # full outer join of neighbouring periods as a sum: a weight counts now and, negated, one period on
    both = now.unionByName(now.select(*scenario, (F.col("__i") + 1).alias("__i"), item, F.lit(0.0).alias("w"), F.col("w").alias("v")))
    moved = both.groupBy(*scenario, "__i", item).agg((F.sum("w") - F.sum("v")).alias("d")).groupBy(*scenario, "__i").agg(F.sum(F.abs("d")).alias("turnover"))
    return gross.join(order, [*scenario, day]).join(moved, [*scenario, "__i"]).drop("__i")


def curve_metrics(periods: DataFrame, scenario: list[str], day: str, net: Column, per_year: float = MONTHS) -> DataFrame:
    """Per scenario: periods, mean, annualised mean, Sharpe, compounded growth per year, maximum drawdown.

    Fewer than two periods, or no variation, give NULL figures. The drawdown's peak starts at the
    first equity value, not at 1.
    """
    by = Window.partitionBy(*scenario).orderBy(day).rowsBetween(Window.unboundedPreceding, 0) if scenario else Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    eq = periods.where(net.isNotNull()).withColumn("__n", net).withColumn("__eq", F.product(1 + F.col("__n")).over(by))
    eq = eq.withColumn("__dd", F.col("__eq") / F.nullif(F.max("__eq").over(by), F.lit(0.0)) - 1)
    n, sd = F.count(F.lit(1)), F.stddev_samp("__n")
    ok = (n >= 2) & (sd > 0)
    final = F.max_by("__eq", day)
    return eq.groupBy(*scenario).agg(
        n.alias("periods"),
        F.when(ok, F.avg("__n")).alias("mean"),
        F.when(ok, F.avg("__n") * per_year).alias("ann_return"),
        F.when(ok, F.avg("__n") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(per_year))).alias("sharpe"),
        F.when(ok & (final > 0), F.pow(F.when(final > 0, final), per_year / n) - 1).alias("cagr"),
        F.when(ok, F.min("__dd")).alias("max_drawdown"),
    )


def net_of_cost(periods: DataFrame, grid: tuple[float, ...] = COST_GRID_BPS) -> DataFrame:
    """Each period under each cost per side in basis points: + bps, net."""
    return periods.withColumn("bps", F.explode(F.array(*[F.lit(float(b)) for b in grid]))).withColumn("net", F.col("gross") - F.col("turnover") * F.col("bps") / 1e4)


def long_short(panel: DataFrame, scenario: list[str], day: str, item: str, ret: str, decile: str, top: int = 10, bottom: int = 1) -> DataFrame:
    """Top minus bottom decile: gross NULL where either is missing, turnovers added."""
    hi = portfolio_periods(panel, scenario, day, item, ret, F.col(decile) == top)
    lo = portfolio_periods(panel, scenario, day, item, ret, F.col(decile) == bottom)
    keys = [*scenario, day]
    lo = lo.select(*keys, F.col("gross").alias("g2"), F.col("turnover").alias("t2"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return hi.join(lo, keys, "full").select(*keys, (F.col("gross") - F.col("g2")).alias("gross"), (z(F.col("turnover")) + z(F.col("t2"))).alias("turnover"))


def benchmark(panel: DataFrame, by: list[str], ret: str) -> DataFrame:
    return panel.where(no_nan(ret).isNotNull()).groupBy(*by).agg(F.avg(no_nan(ret)).alias("ret"), F.count(F.lit(1)).alias("n"))


#: Modulus and multiplier of a public multiplicative generator (a primitive root of a prime).
MINSTD = (2**31 - 1, 48271)


def permutation_null(panel: DataFrame, by: list[str], item: str, score: str, ret: str, reps: int = NULL_REPS, seed: int = NULL_SEED) -> DataFrame:
    """Mean rank correlation of scores that know nothing, one row per repetition: rep, mean_ic, periods.

    Shuffling a group's n scores gives a correlation with mean 0 and variance 1 / (n - 1), whatever the scores
    are: that follows from the symmetry of the draw alone. So none is moved. Each item draws a number of its own - its place in
    a public generator started from the MD5 of group, item and seed, a step per repetition - and the numbers' correlation with
    the ranks of the returns has the same mean and variance. The ranks are made once; all repetitions are partial
    aggregates of one pass. Rows need both a score and a return; groups in which either is constant, or with fewer
    than five rows, have no correlation.
    """
    p, root = MINSTD
    base = panel.select(*by, item, no_nan(score).alias("__s"), no_nan(ret).alias("__r")).where("__s is not null and __r is not null")
    text = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, item]], F.lit(str(seed))))
    start = F.conv(F.substring(text, 1, 15), 16, 10).cast("long") % (p - 1) + 1
    ranked = base.select(*by, "__s", average_rank("__r", by).alias("__b"), start.alias("__x"))
    step = lambda k: ((F.col("__x") * F.lit(pow(root, k + 1, p))) % p / float(p)).alias(f"__u{k}")
    drawn = ranked.select(*by, "__s", "__b", *[step(k) for k in range(reps)])
    ok = (F.count(F.lit(1)) >= 5) & (F.min("__s") < F.max("__s")) & (F.min("__b") < F.max("__b"))
    sd = F.stddev_pop("__b")
    ic = lambda k: F.when(ok, F.covar_pop(f"__u{k}", "__b") / F.nullif(F.stddev_pop(f"__u{k}") * sd, F.lit(0.0)))
    each = drawn.groupBy(*by).agg(F.array(*[ic(k) for k in range(reps)]).alias("__ic"))
    return each.select(F.posexplode("__ic").alias("rep", "ic")).groupBy("rep").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("periods"))


def leak_audit(panel: DataFrame, by: list[str], item: str, score: str, ret: str, reps: int = NULL_REPS) -> DataFrame:
    """One row: mean correlation of the score, of a cheating score (the return itself), the null's mean and deviation, and z."""
    mean = lambda s, name: spearman_by(panel, by, s, ret).agg(F.avg("ic").alias(name))
    null = permutation_null(panel, by, item, score, ret, reps).agg(F.avg("mean_ic").alias("null_mean"), F.stddev_samp("mean_ic").alias("null_sd"))
    out = mean(score, "real_ic").crossJoin(F.broadcast(mean(ret, "cheat_ic"))).crossJoin(F.broadcast(null))  # a row each
    return out.withColumn("z", (F.col("real_ic") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))


def evaluate(panel: DataFrame, by: list[str], day: str, item: str, score: str, decile: str, ret: str, scenario: list[str] | None = None) -> dict[str, DataFrame]:
    """The whole reading of a ranked panel, lazily: correlation series and summary, decile table and monotonicity,
    the long-only curve under the cost grid and the long-short spread."""
    ic = spearman_by(panel, by, score, ret)
    table = decile_table(panel, by, decile, ret)
    s = scenario or []
    best = portfolio_periods(panel, s, day, item, ret, F.col(decile) == 10).where("gross is not null")
    return {
        "ic": ic,
        "ic_summary": ic_summary(ic),
        "deciles": table,
        "monotonicity": monotonicity(table),
        "long_only": curve_metrics(net_of_cost(best), [*s, "bps"], day, F.col("net")),
        "long_short": long_short(panel, s, day, item, ret, decile),
    }


def score_bands(built: DataFrame, bands: list[Band], by: str = "day", item: str = "permaticker") -> DataFrame:
    """Screen, score and label a built panel under several bands at once: the eligible rows with band, factors, composite, ranked, decile.

    Scores are made among a band's eligible rows of a date; labels stay on their rows, so nothing is joined back.
    """
    return factor_scores(screen_grid(built, bands).where("eligible").drop("eligible"), ["band", by], item)


def band_summary(built: DataFrame, bands: list[Band], by: str = "day", item: str = "permaticker", ret: str = "fwd_ret") -> DataFrame:
    """Screen, score, label and evaluate: one row per band.

    n_eligible, median_eligible (per date, floored; dates without any count 0), delisting_rate of the eligible rows, ranked,
    correlation figures with the Newey-West t, and the two monotonicity correlations.
    """
    grid = screen_grid(built, bands)
    ok = F.col("eligible").cast("int")
    per_date = grid.groupBy("band", by).agg(F.sum(ok).alias("n"), F.sum(ok * F.coalesce(F.col("fwd_status") == "delisted_partial", F.lit(False)).cast("int")).alias("gone"))
    counts = per_date.groupBy("band").agg(
        F.sum("n").cast("long").alias("n_eligible"), F.floor(F.median("n")).cast("long").alias("median_eligible"), (F.sum("gone") / F.nullif(F.sum("n"), F.lit(0))).alias("delisting_rate")
    )
    scored = staged(score_bands(built, bands, by, item))  # read for the correlations, the deciles and the counts
    ic = spearman_by(scored, ["band", by], "composite", ret)
    table = decile_table(scored, ["band", by], "decile", ret, scenario=["band"])
    parts = [
        scored.groupBy("band").agg(F.sum(F.col("ranked").cast("int")).cast("long").alias("ranked")),
        ic_summary(ic, scenario=["band"]),
        newey_west(ic, by, "ic", scenario=["band"]).select("band", "t_stat"),
        monotonicity(table, ["band"]).select("band", "spearman_ret", "spearman_sharpe"),
    ]
    for p in parts:
        counts = counts.join(p, "band", "left")
    return counts


def attach_labels(scores: DataFrame, built: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Scores kept elsewhere with the labels of the panel they were made from; a score without a panel row has NULL labels."""
    one = built.groupBy(*keys).agg(F.max(F.struct(*labels)).alias("__l")).select(*keys, "__l.*")
    return scores.drop(*labels).join(one, keys, "left")


def decision(grid: DataFrame, summary: DataFrame, candidate: str, baseline: str, margin: float = 0.20, least_monotone: float = 0.5) -> DataFrame:
    """Does the candidate qualify? One row of the figures and the verdict.

    ``grid`` has name, aum, cost_scale, sharpe; Sharpe ratios are averaged over sizes. The candidate must beat the baseline
    at cost scale 1 by ``margin`` both at scale 1 and at scale 2, have a positive mean correlation and
    rank Sharpe by decile above ``least_monotone`` (``summary``: band, mean_ic, spearman_sharpe). What is NULL is not met.
    """
    pick = lambda n, scale: F.avg(F.when((F.col("name") == n) & (F.col("cost_scale") == scale), F.col("sharpe")))
    out = grid.agg(pick(candidate, 1.0).alias("candidate_1x"), pick(candidate, 2.0).alias("candidate_2x"), pick(baseline, 1.0).alias("baseline_1x"))
    of = lambda c: F.max(F.when(F.col("band") == candidate, F.col(c)))
    out = out.crossJoin(F.broadcast(summary.agg(of("mean_ic").alias("mean_ic"), of("spearman_sharpe").alias("spearman_sharpe"))))  # one row
    out = out.withColumns({"margin_1x": F.col("candidate_1x") - F.col("baseline_1x"), "margin_2x": F.col("candidate_2x") - F.col("baseline_1x")})
    met = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"ic_ok": met(F.col("mean_ic") > 0), "monotone_ok": met(F.col("spearman_sharpe") > least_monotone), "margin_ok": met((F.col("margin_1x") >= margin) & (F.col("margin_2x") >= margin))})
    return out.withColumn("qualifies", F.col("ic_ok") & F.col("monotone_ok") & F.col("margin_ok"))


def default_lags(n: int) -> int:
    return floor(n**0.25) + 1


def newey_west_exact(values: np.ndarray | pd.Series, lags: int | None = None) -> float:
    """The same statistic for a handful of numbers on the driver; the yardstick of the tests."""
    x = np.asarray(values, float)
    n, e = len(x), x - x.mean()
    k = default_lags(n) if lags is None else lags
    s = e @ e + 2 * sum((1 - j / (k + 1)) * (e[j:] @ e[:-j]) for j in range(1, k + 1) if j < n)
    return float(x.mean() / (np.sqrt(s) / n))
