"""Trend signals, weights, costs and backtests on long tables (day, ticker, value).

Shifts are by calendar row: the grid is completed first, so a missing bar is a missing value on
its day, not a shorter series. Per-day sums over tickers are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blend, clip, ratio
from ..session import staged
from .asof import exact_cover

# Fixed values of the research design.
LOOKBACKS = (63, 126, 252)
VOL_WINDOW, VOL_FLOOR, YEAR = 60, 0.05, 252.0
TARGET_VOL, LEVERAGE_CAP = 0.15, 2.5
LEG_VOL, LEG_MAX = 0.10, 1.5
TURNOVER_BPS, PASS_BAR, HEADLINE_RATE = 2.0, 0.40, 0.04


def by_ticker():
    return Window.partitionBy("ticker").orderBy("day")


def dense_grid(prices: DataFrame) -> DataFrame:
    """Every calendar day for every ticker; a missing bar has a NULL price.

    Days and tickers are both short dimension lists; each ticker receives the day list and
    unfolds it, so no row pairs are compared.
    """
    days = prices.select("day").distinct().agg(F.sort_array(F.collect_list("day")).alias("__d"))
    tickers = prices.select("ticker").distinct().crossJoin(F.broadcast(days))  # one row on the right
    return tickers.select("ticker", F.explode("__d").alias("day")).join(prices, ["ticker", "day"], "left")


def grid_returns(grid: DataFrame) -> DataFrame:
    """+ ret: change against the calendar row before; NULL if either side is missing."""
    return grid.withColumn("ret", ratio(F.col("price"), F.lag("price", 1).over(by_ticker())) - 1)


def full_window_vol(value: str, by: Window | None = None, window: int = VOL_WINDOW) -> Column:
    """Annualised deviation of the last ``window`` rows; NULL unless all of them are there."""
    w = (by or by_ticker()).rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(w) == window, F.stddev_samp(value).over(w) * F.sqrt(F.lit(YEAR)))


def signals(grid: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, window: int = VOL_WINDOW) -> DataFrame:
    """+ ret, vol (floored), score: the mean sign of the price change over each look-back."""
    df = grid_returns(grid)
    moves = [ratio(F.col("price"), F.lag("price", n).over(by_ticker())) - 1 for n in lookbacks]
    return df.withColumns({"vol": clip(full_window_vol("ret", window=window), VOL_FLOOR), "score": blend(*moves)})


def weekly_hold(df: DataFrame, value: str) -> DataFrame:
    """Daily weights held from the newest finished week: day d uses the last row of the week ending on the Friday at or before d.

    Weeks are labelled by their Friday. An empty week holds nothing (0), it does not carry an older one.
    A week's last row is the one before the label changes, so one line per ticker tells it and nothing is joined.
    """
    line = by_ticker()
    label = F.next_day(F.date_sub("day", 1), "FRI")
    ends = F.coalesce(F.lead("__fri").over(line) != F.col("__fri"), F.lit(True))
    df = df.withColumn("__fri", label).withColumn("__end", F.when(ends, F.struct(F.col("__fri").alias("fri"), F.col(value).alias("v"))))
    past = F.last("__end", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    newest = F.when(F.col("__past.fri") == F.date_sub("__fri", 7), F.col("__past.v"))
    # on a Friday the week ends with the row itself
    held = F.when(F.col("day") == F.col("__fri"), F.col(value)).otherwise(newest)
    return df.withColumn("__past", past).withColumn(value, F.coalesce(held, F.lit(0.0))).drop("__fri", "__end", "__past")


def lagged(df: DataFrame, value: str, lag: int) -> DataFrame:
    """Weights applied ``lag`` days later, missing as 0; 0 leaves them (the leak test)."""
    if lag == 0:
        return df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    return df.withColumn(value, F.coalesce(F.lag(value, lag).over(by_ticker()), F.lit(0.0)))


def per_day(df: DataFrame, **sums: Column) -> DataFrame:
    return df.groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()])


def unit_gross_weights(sig: DataFrame, lag: int = 1) -> DataFrame:
    """score x (target / vol), each leg bounded, scaled to gross 1, held weekly, lagged. A day without exposure is all 0."""
    raw = sig.withColumn("w", clip(F.col("score") * LEG_VOL / F.col("vol"), -LEG_MAX, LEG_MAX))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("day"))
    return lagged(weekly_hold(raw.withColumn("w", F.coalesce(ratio(F.col("w"), gross), F.lit(0.0))), "w"), "w", lag)


def risk_parity_weights(sig: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """Inverse-volatility weights, equal risk per class: + w. ``classes`` (ticker, class) is a setting table."""
    df = sig.join(classes, "ticker")
    denom = F.sum(F.abs("score")).over(Window.partitionBy("day", "class"))
    w = ratio(F.col("score") / F.col("vol"), denom) / float(n_classes)
    return df.withColumn("w", F.coalesce(w, F.lit(0.0)))


def leverage(risk: Column, target: float, cap: float) -> Column:
    """target / risk, at most ``cap``; 0 where the risk is 0 or not known yet."""
    return F.when(risk > 0, F.least(ratio(F.lit(target), risk), F.lit(cap))).otherwise(0.0)


def vol_target_ex_ante(weights: DataFrame, lag: int = 1, target: float = TARGET_VOL, cap: float = LEVERAGE_CAP) -> DataFrame:
    """Scale each day to the target from the legs' own volatilities, then hold weekly and lag."""
    risk = F.sqrt(F.sum(F.pow(F.col("w") * F.col("vol"), F.lit(2.0))).over(Window.partitionBy("day")))
    lev = leverage(risk, target, cap)
    return lagged(weekly_hold(weights.withColumn("w", F.col("w") * lev), "w"), "w", lag)


def vol_target_realized(weights: DataFrame, lag: int = 1, target: float = TARGET_VOL, cap: float = LEVERAGE_CAP, window: int = VOL_WINDOW) -> DataFrame:
    """Hold weekly and lag first; then scale by the book's own trailing volatility, one day old. 0 before it exists."""
    held = lagged(weekly_hold(weights, "w"), "w", lag)
    book = per_day(held, r=F.col("w") * F.col("ret"))
    line = Window.orderBy("day")  # one row per trading day
    vol = full_window_vol("r", line, window)
    lev = leverage(F.lag("__v", 1).over(line), target, cap)
    lever = book.withColumn("__v", vol).select("day", lev.alias("lev"))
    return held.join(lever, "day").withColumn("w", F.col("w") * F.col("lev")).drop("lev")


def cap_gross(weights: DataFrame, cap: float) -> DataFrame:
    """Shrink a day whose gross exposure exceeds ``cap``; a cap that is not positive raises."""
    if cap <= 0:
        raise ValueError("the gross cap must be positive")
    gross = F.sum(F.abs("w")).over(Window.partitionBy("day"))
    return weights.withColumn("w", F.col("w") * F.coalesce(F.least(ratio(F.lit(float(cap)), gross), F.lit(1.0)), F.lit(1.0)))


def first_active(weights: DataFrame) -> DataFrame:
    """First day with exposure, else the first day: one row, ``day``."""
    g = per_day(weights, gross=F.abs(F.col("w")))
    return g.agg(F.coalesce(F.min(F.when(F.col("gross") > 0, F.col("day"))), F.min("day")).alias("day"))


def net_cash(weights: DataFrame) -> DataFrame:
    """Per day long and short notional, gross, and cash 1 + short - long."""
    w = F.col("w")
    out = per_day(weights, long=F.greatest(w, F.lit(0.0)), short=F.greatest(-w, F.lit(0.0)))
    return out.withColumns({"gross": F.col("long") + F.col("short"), "cash": 1.0 + F.col("short") - F.col("long")})


def borrow_cost(weights: DataFrame, rates: DataFrame, stress: float = 1.0) -> DataFrame:
    """Daily cost of the short legs: day, borrow. ``rates`` (ticker, bps) is a setting table; a ticker without rate raises."""
    unknown = weights.where("w < 0").select("ticker").distinct().join(rates, "ticker", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"no borrow rate for {', '.join(str(r[0]) for r in unknown)}")
    short = F.greatest(-F.col("w"), F.lit(0.0))
    return per_day(weights.join(rates, "ticker", "left"), borrow=F.coalesce(F.col("bps"), F.lit(0.0)) * short * stress / 1e4 / YEAR)


def financing_cost(cash: DataFrame, legs: DataFrame) -> DataFrame:
    """Debit on borrowed cash less credit on idle cash: day, financing. ``legs`` (day, debit, credit) must cover every day."""
    df = exact_cover(cash.select("day", "cash"), legs, "day", "debit").join(legs.select("day", "credit"), "day")
    owed, idle = F.greatest(-F.col("cash"), F.lit(0.0)), F.greatest(F.col("cash"), F.lit(0.0))
    return df.select("day", ((owed * F.col("debit") - idle * F.col("credit")) / YEAR).alias("financing"))


def rate_legs(rate: DataFrame, debit_spread: float = 0.01, credit_spread: float = 0.0025) -> DataFrame:
    """day, debit, credit from a short rate."""
    return rate.select("day", (F.col("rate") + debit_spread).alias("debit"), F.greatest(F.col("rate") - credit_spread, F.lit(0.0)).alias("credit"))


def daily_book(weights: DataFrame, extra: DataFrame | None = None, cost_bps: float = TURNOVER_BPS, scenario: list[str] | None = None) -> DataFrame:
    """Per day gross return, turnover, cost, net, equity, exposure. ``extra`` (day, extra) adds daily costs.

    Weights are those in force on the day (already lagged). The first day turns over its whole exposure.
    """
    s = scenario or []
    line = Window.partitionBy(*s, "ticker").orderBy("day")
    moved = F.abs(F.col("w") - F.coalesce(F.lag("w").over(line), F.lit(0.0)))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = (
        weights.withColumn("__m", moved)
        .groupBy(*s, "day")
        .agg(z(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"), z("__m").alias("turnover"), z(F.abs("w")).alias("exposure"))
    )
    more = F.lit(0.0)
    if extra is not None:
        out, more = out.join(extra, "day", "left"), F.coalesce(F.col("extra"), F.lit(0.0))
    out = out.withColumn("cost", F.col("turnover") * cost_bps / 1e4 + more).withColumn("net", F.col("gross") - F.col("cost"))
    run = (Window.partitionBy(*s) if s else Window.partitionBy()).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity", F.product(1 + F.col("net")).over(run)).select(*s, "day", "gross", "turnover", "exposure", "cost", "net", "equity")


def live_days(book: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """The book from its first day with exposure on (all of it, if there is none)."""
    part = Window.partitionBy(*(scenario or []))
    start = F.coalesce(F.min(F.when(F.col("exposure") > 0, F.col("day"))).over(part), F.min("day").over(part))
    return book.withColumn("__from", start).where("day >= __from").drop("__from")


def rolling_sharpe(book: DataFrame, scenario: list[str] | None = None, year_rows: int = 252) -> DataFrame:
    """+ rolling_sharpe: annualised, over the last ``year_rows`` live days; NULL before that and where nothing varies."""
    year = Window.partitionBy(*(scenario or [])).orderBy("day").rowsBetween(-(year_rows - 1), 0)
    sd = F.stddev_samp("net").over(year)
    value = F.when((F.count("net").over(year) == year_rows) & (sd > 0), F.avg("net").over(year) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(YEAR)))
    return live_days(book, scenario).withColumn("rolling_sharpe", value)


def book_metrics(book: DataFrame, scenario: list[str] | None = None, year_rows: int = 252) -> DataFrame:
    """Metrics from the first active day on, per scenario: days, years, ann_return, ann_vol, sharpe, gross_sharpe, max_drawdown,
    turnover, exposure, rolling_positive."""
    s = scenario or []
    run = Window.partitionBy(*s).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    live = rolling_sharpe(book, s, year_rows).withColumn("__eq", F.product(1 + F.col("net")).over(run))
    live = live.withColumn("__dd", F.col("__eq") / F.nullif(F.max("__eq").over(run), F.lit(0.0)) - 1)
    mean, dev, n = F.avg("net"), F.stddev_samp("net"), F.count(F.lit(1))
    yearly = lambda m, d: m / F.nullif(d, F.lit(0.0)) * F.sqrt(F.lit(YEAR))
    return live.groupBy(*s).agg(
        n.alias("days"),
        F.round(n / YEAR, 1).alias("years"),
        (mean * YEAR).alias("ann_return"),
        (dev * F.sqrt(F.lit(YEAR))).alias("ann_vol"),
        yearly(mean, dev).alias("sharpe"),
        yearly(F.avg("gross"), F.stddev_samp("gross")).alias("gross_sharpe"),
        F.min("__dd").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"),
        F.avg("exposure").alias("exposure"),
        F.avg(F.when(F.col("rolling_sharpe").isNotNull(), (F.col("rolling_sharpe") > 0).cast("double"))).alias("rolling_positive"),
    )


def by_year(book: DataFrame) -> DataFrame:
    return book.groupBy(F.year("day").alias("year")).agg((F.product(1 + F.col("net")) - 1).alias("ret"))


def exposure_summary(book: DataFrame, over: float = 1.0) -> DataFrame:
    e = F.col("exposure")
    return book.agg(F.avg(e).alias("mean"), F.percentile(e, F.lit(0.95)).alias("p95"), F.max(e).alias("max"), F.avg((e > over).cast("double")).alias("share_over"))


def total_extra_cost(weights: DataFrame, rates: DataFrame | None = None, stress: float = 1.0, legs: DataFrame | None = None) -> DataFrame:
    """Borrow and financing together: day, extra. Without ``rates`` there is no borrow cost, without ``legs`` no financing."""
    parts = [borrow_cost(weights, rates, stress).withColumnRenamed("borrow", "extra")] if rates is not None else []
    parts += [financing_cost(net_cash(weights), legs).withColumnRenamed("financing", "extra")] if legs is not None else []
    both = weights.select("day", F.lit(0.0).alias("extra")).distinct()
    for p in parts:
        both = both.unionByName(p)
    return both.groupBy("day").agg(F.sum("extra").alias("extra"))


def scenario_grid(book: DataFrame, borrow: DataFrame, financing: DataFrame, borrow_x: tuple[float, ...], financing_x: tuple[float, ...], bps: tuple[float, ...]) -> DataFrame:
    """Metrics under every combination of cost settings. Net return is affine in them, so the daily basis is made once."""
    basis = book.select("day", "gross", "turnover", "exposure").join(borrow, "day", "left").join(financing, "day", "left")
    grid = basis.sparkSession.createDataFrame([(a, b, c) for a in borrow_x for b in financing_x for c in bps], "borrow_x double, financing_x double, bps double")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    runs = basis.crossJoin(F.broadcast(grid))  # a fixed list of settings
    net = F.col("gross") - F.col("turnover") * F.col("bps") / 1e4 - z("borrow") * F.col("borrow_x") - z("financing") * F.col("financing_x")
    return book_metrics(runs.withColumn("net", net), ["borrow_x", "financing_x", "bps"])


def break_even(book: DataFrame, high: float, bars: tuple[float, ...] = (PASS_BAR,), steps: int = 60) -> DataFrame:
    """The price of a cost at which the annualised Sharpe ratio falls to a bar: bar, cost.

    ``book`` has day, exposure, ``net`` before that cost and ``unit``, the day's cost at a price of 1. The ratio at
    a price x needs five moments of the two series, so one aggregate over the live days serves every bar; the bracket
    [0, ``high``] is then halved ``steps`` times. 0 where the ratio is below the bar without the cost,
    infinite where it is still above it at ``high``; NULL where nothing varies.
    """
    m = live_days(book).agg(
        F.avg("net").alias("a"), F.avg("unit").alias("b"), F.var_samp("net").alias("aa"), F.var_samp("unit").alias("bb"), F.covar_samp("net", "unit").alias("ab")
    )
    m = m.withColumn("bar", F.explode(F.array(*[F.lit(float(b)) for b in bars])))

    def above(x: Column) -> Column:
        var = F.col("aa") - 2.0 * x * F.col("ab") + x * x * F.col("bb")
        return (F.col("a") - x * F.col("b")) * F.sqrt(F.lit(YEAR)) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)) - F.col("bar")

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = above(mid) > 0
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    zero, top = F.lit(0.0), F.lit(float(high))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(zero.alias("lo"), top.alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)
    cost = F.when(above(zero) < 0, zero).when(above(top) > 0, F.lit(float("inf"))).when(above(zero).isNotNull(), found)
    return m.select("bar", cost.alias("cost"))


def financing_break_even(book: DataFrame, borrow: DataFrame, cash: DataFrame, bars: tuple[float, ...] = (PASS_BAR,), bps: float = TURNOVER_BPS) -> DataFrame:
    """Flat rate on borrowed cash at which the book, turnover and borrow paid, falls to the bar (idle cash earns nothing)."""
    df = book.join(borrow, "day").join(cash.select("day", "cash"), "day")
    net = F.col("gross") - F.col("turnover") * bps / 1e4 - F.col("borrow")
    return break_even(df.select("day", "exposure", net.alias("net"), (F.greatest(-F.col("cash"), F.lit(0.0)) / YEAR).alias("unit")), 1.0, bars)


def turnover_break_even(book: DataFrame, borrow: DataFrame, cash: DataFrame, bars: tuple[float, ...] = (PASS_BAR,), rate: float = HEADLINE_RATE) -> DataFrame:
    """Basis points a side at which the book, borrow and a flat financing rate paid, falls to the bar."""
    df = book.join(borrow, "day").join(cash.select("day", "cash"), "day")
    net = F.col("gross") - F.col("borrow") - F.greatest(-F.col("cash"), F.lit(0.0)) * rate / YEAR
    return break_even(df.select("day", "exposure", net.alias("net"), (F.col("turnover") / 1e4).alias("unit")), 500.0, bars)


def leak_check(weights_at, lags: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Sharpe at several lags; ``weights_at(lag)`` builds the book's weights. A leak shows as a drop from lag 0 to 1."""
    out = None
    for k in lags:
        row = book_metrics(daily_book(weights_at(k))).select(F.lit(k).alias("lag"), "sharpe")
        out = row if out is None else out.unionByName(row)
    return out


def verdict(metrics: DataFrame, pass_bar: float = PASS_BAR) -> DataFrame:
    """+ passes: the ratio reaches the bar and most rolling years are positive."""
    return metrics.withColumn("passes", F.coalesce((F.col("sharpe") >= pass_bar) & (F.col("rolling_positive") > 0.5), F.lit(False)))


# Cost bases a capped book must survive: spread of the debit over the short rate (None: no financing), credit paid.
CONDITIONS = {"borrow_complete": (None, False), "measured_financing": (0.01, True), "wide_spread": (0.02, True), "zero_credit": (0.01, False)}


def capped_verdict(
    weights: DataFrame, rates: DataFrame, rate: DataFrame, cap: float, bars: tuple[float, ...] = (PASS_BAR,), stress: float = 1.0, bps: float = TURNOVER_BPS, credit_spread: float = 0.0025
) -> DataFrame:
    """Five conditions of a capped book and their conjunction, per bar: bar, condition, sharpe, rolling_positive, breaches, passes.

    Four cost bases (see CONDITIONS) must each reach the bar with most rolling years positive, and gross exposure must
    never exceed ``cap`` from the first active day on (``gross_breach``; only it has ``breaches``). ``overall`` is all
    five. ``rate`` (day, rate) must cover every day. The daily basis is made once; net is affine in each setting.
    """
    basis = daily_book(weights).select("day", "gross", "turnover", "exposure").join(borrow_cost(weights, rates, stress), "day").join(net_cash(weights).select("day", "cash"), "day")
    basis = staged(exact_cover(basis, rate, "day", "rate"))
    rows = [(name, debit is not None, debit or 0.0, credit) for name, (debit, credit) in CONDITIONS.items()]
    runs = basis.crossJoin(F.broadcast(basis.sparkSession.createDataFrame(rows, "condition string, financed boolean, spread double, credited boolean")))  # four settings
    owed, idle = F.greatest(-F.col("cash"), F.lit(0.0)), F.greatest(F.col("cash"), F.lit(0.0))
    earned = F.when(F.col("credited"), idle * F.greatest(F.col("rate") - credit_spread, F.lit(0.0))).otherwise(0.0)
    financing = F.when(F.col("financed"), (owed * (F.col("rate") + F.col("spread")) - earned) / YEAR).otherwise(0.0)
    net = F.col("gross") - F.col("turnover") * bps / 1e4 - F.col("borrow") - financing
    none = F.lit(None).cast("double")
    judged = book_metrics(runs.withColumn("net", net), ["condition"]).select("condition", "sharpe", "rolling_positive", F.lit(None).cast("long").alias("breaches"))
    over = F.coalesce(F.sum((F.col("exposure") > cap + 1e-9).cast("int")), F.lit(0)).cast("long")
    breach = live_days(basis).agg(over.alias("breaches")).select(F.lit("gross_breach").alias("condition"), none.alias("sharpe"), none.alias("rolling_positive"), "breaches")
    five = judged.unionByName(breach).select(F.explode(F.array(*[F.lit(float(b)) for b in bars])).alias("bar"), "*")
    reached = F.coalesce((F.col("sharpe") >= F.col("bar")) & (F.col("rolling_positive") > 0.5), F.lit(False))
    five = five.withColumn("passes", F.when(F.col("condition") == "gross_breach", F.col("breaches") == 0).otherwise(reached))
    every = five.groupBy("bar").agg(F.min("passes").alias("passes"))
    return five.unionByName(every.select("bar", F.lit("overall").alias("condition"), none.alias("sharpe"), none.alias("rolling_positive"), F.lit(None).cast("long").alias("breaches"), "passes"))
