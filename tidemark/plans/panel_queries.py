"""Point-in-time panel, factors and ranking diagnostics as registered queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import no_nan, parse_day
from ..operators import factors, harness, panel
from ..operators.asof import asof_join, period_returns, with_age_limit
from ..operators.book import BookParams, book_diagnostics, buffered_book, half_spread, side_cost_bps, size_tier, water_fill
from ..operators.filters import guard_span
from ..operators.identity import attribute, current_bars, sole_owner_segments, usable_windows
from ..operators.rolling import trailing_figures
from ..session import staged, table
from .common import out, sql_out
from .pit_queries import SQL_BARS, SQL_OWNERS, STALE_DAYS, sql_day


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return current_bars(table(spark, d, "sep_prices"), table(spark, d, "tickers"), ("closeadj", "volume"))


def _fund_rows(spark: SparkSession, d: str) -> DataFrame:
    nums = [no_nan(c).alias(c) for c in ("eps", "bvps", "gp", "assets")]
    return table(spark, d, "fundamentals").where("dimension = 'ART'").select("fund_id", "ticker", parse_day("datekey").alias("day"), *nums)


def _fund(spark: SparkSession, d: str) -> DataFrame:
    seg = sole_owner_segments(usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    return attribute(_fund_rows(spark, d).where("day is not null"), seg, "ticker", "day").drop("ticker").distinct()


def _meta(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "tickers").select(
        F.col("permaticker").cast("long").alias("permaticker"), parse_day("firstpricedate").alias("first"), parse_day("lastpricedate").alias("last"), "category", "exchange"
    )
    return panel.identity_meta(w.where("first <= last"))


def _valuation(spark: SparkSession, d: str) -> DataFrame:
    """Daily market value in $M by ticker, standing in for a valuation feed that the inputs lack: price times a number of
    shares that the ticker's name tells, in ticks of 5 days and missing for every seventh ticker."""
    shares = F.length("ticker") * 7 + F.ascii("ticker") % 60
    p = table(spark, d, "sep_prices").where("ticker is not null and closeadj is not null").groupBy("ticker", "date").agg(F.max("closeadj").alias("c"))
    return p.where((F.ascii(F.right("ticker", F.lit(1))) % 7 != 0) & (F.dayofmonth("date") % 5 == 0)).select("ticker", "date", (F.col("c") * shares).alias("marketcap"))


def _built(spark: SparkSession, d: str, start: date | None = None, end: date | None = None) -> DataFrame:
    return panel.panel_from_tables(table(spark, d, "sep_prices"), table(spark, d, "tickers"), _valuation(spark, d), _fund_rows(spark, d), ambiguous="drop", start=start, end=end)


def _rank_panel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "panel").select(
        "scenario_id", F.col("date").alias("day"), "permaticker", no_nan("composite").alias("composite"), "decile", no_nan("fwd_ret_21").alias("ret"), "fwd_status"
    ).distinct()


def _feats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feat_t").select("feat_id", "t", F.col("permaticker").cast("long").alias("permaticker")).distinct()


def attribute_interval_join(spark, d):
    seg = sole_owner_segments(usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    p = table(spark, d, "sep_prices").select("ticker", "date", "closeadj", "volume", "ret", "lastupdated").distinct()
    got = attribute(p, seg, "ticker", "date")
    return out(got.groupBy("permaticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.sum("volume").alias("volume")))


def attribution_ambiguity(spark, d):
    bad = panel.ambiguous_days(table(spark, d, "sep_prices"), usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    return out(bad.select("ticker", F.col("date").alias("day"), "matches"))


def panel_returns_vol(spark, d):
    own = Window.partitionBy("permaticker").orderBy("day")
    df = panel.numbered_returns(_bars(spark, d))
    return out(df.withColumn("vol", F.stddev_samp("ret").over(own.rowsBetween(-251, 0))).select("permaticker", "day", "seq", "ret", "vol"))


def trailing_median_dollarvol(spark, d):
    """Median dollar volume of the last 60 bars at each rebalance day of an identity, as far as its bars reach."""
    bars = staged(panel.numbered_returns(_bars(spark, d)).withColumn("dv", F.col("closeadj") * F.col("volume")))
    spans = bars.groupBy("permaticker").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = panel.probe_grid(panel.rebalance_days(panel.calendar_of(bars)), spans)
    at = asof_join(grid, bars.withColumnRenamed("day", "bar_day"), ["permaticker"], "day", "bar_day", ["seq"]).withColumnRenamed("seq", "h")
    got = trailing_figures(at, bars, ["permaticker", "day"], "ret", 252, "dv", 60)
    return out(got.where("trail_median is not null").select("permaticker", "day", F.col("trail_median").alias("dollarvol")))


def calendar_anchors(spark, d):
    cal = panel.calendar_of(_bars(spark, d))
    return out(panel.rebalance_days(cal).join(panel.with_anchors(cal), "day"))


def asof_price(spark, d):
    bars = _bars(spark, d).withColumnRenamed("day", "bar_day")
    return out(asof_join(_feats(spark, d), bars, ["permaticker"], "t", "bar_day", ["closeadj"], as_of="bar_seen").select("feat_id", "bar_seen", "closeadj"))


def asof_fundamentals(spark, d):
    f = _fund(spark, d).withColumnRenamed("day", "known")
    got = asof_join(_feats(spark, d), f, ["permaticker"], "t", "known", ["fund_id", "eps", "bvps"], tie_break=[F.col("fund_id")], how="left")
    return out(got.select("feat_id", "fund_id", "eps", "bvps"))


def asof_strict_filing(spark, d):
    g = table(spark, d, "filings").where("not is_amendment").select(F.col("permaticker").cast("long").alias("permaticker"), "acceptance_date", "filing_id")
    got = asof_join(_feats(spark, d), g, ["permaticker"], "t", "acceptance_date", ["filing_id"], strict=True, how="left", as_of="filed")
    return out(with_age_limit(got, "t", "filed", ["filing_id"], STALE_DAYS).select("feat_id", "filing_id", "filed", "status"))


def anchor_momentum(spark, d):
    return out(_built(spark, d).select("day", "permaticker", "mom"))


def forward_label_status(spark, d):
    return out(_built(spark, d).select("day", "permaticker", "fwd_ret", "fwd_status"))


def built_panel(spark, d):
    return out(_built(spark, d))


def span_panel(spark, d):
    """Rebalance days of two years only; prices before and after them are still read."""
    return out(_built(spark, d, *guard_span(date(2013, 1, 1), date(2014, 12, 31), date(2021, 1, 1))))


def daily_valuation(spark, d):
    """Market values attributed to the identity that owned the ticker on the day."""
    seg = sole_owner_segments(usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    return out(attribute(_valuation(spark, d), seg, "ticker", "date").select("permaticker", "ticker", F.col("date").alias("day"), "marketcap"))


BAND = factors.Band("core", {"dollarvol_60": (200_000.0, None), "close_t": (5.0, 400.0), "hist_days": (60, None)})
WIDE = BAND.with_floors(dollarvol_60=50_000.0, close_t=1.0)


def _screened(spark, d):
    return table(spark, d, "feat_t").select("feat_id", "t", "dollarvol_60", "close_t", "hist_days").distinct()


def universe_screen(spark, d):
    return out(factors.screen(_screened(spark, d), BAND).drop("dollarvol_60", "close_t", "hist_days"))


def universe_funnel(spark, d):
    return out(factors.funnel(factors.screen(_screened(spark, d), BAND), "t"))


def band_screen_grid(spark, d):
    got = factors.screen_grid(_screened(spark, d), [BAND, factors.Band("wide", WIDE.ranges)])
    return out(got.groupBy("band", "t").agg(F.sum(F.col("eligible").cast("int")).alias("eligible")))


def winsor_z(spark, d):
    z = factors.winsor_z({"z": F.col("composite")}, Window.partitionBy("scenario_id", "day"))(_rank_panel(spark, d))
    return out(z.select("scenario_id", "day", "permaticker", "z"))


def factor_scores(spark, d):
    got = factors.factor_scores(_built(spark, d))
    return out(got.select("day", "permaticker", *factors.FACTORS, "ranked", "composite", "decile"))


def ranking_coverage(spark, d):
    return out(factors.ranking_coverage(factors.factor_scores(_built(spark, d)), "day"))


def deciles(spark, d):
    return out(factors.deciles(_rank_panel(spark, d).drop("decile"), ["scenario_id", "day"], "composite", "permaticker").select("scenario_id", "day", "permaticker", "decile"))


KEYS = ["scenario_id", "day"]


def rank_ic_by_date(spark, d):
    return out(harness.spearman_by(_rank_panel(spark, d), KEYS, "composite", "ret"))


def ic_summary(spark, d):
    return out(harness.ic_summary(harness.spearman_by(_rank_panel(spark, d), KEYS, "composite", "ret")))


def newey_west(spark, d):
    ic = harness.spearman_by(_rank_panel(spark, d), KEYS, "composite", "ret")
    return out(harness.newey_west(ic, "day", "ic", scenario=["scenario_id"]))


def decile_table(spark, d):
    return out(harness.decile_table(_rank_panel(spark, d), KEYS, "decile", "ret"))


def monotonicity(spark, d):
    return out(harness.monotonicity(harness.decile_table(_rank_panel(spark, d), KEYS, "decile", "ret")))


def _best(spark, d):
    return harness.portfolio_periods(_rank_panel(spark, d), ["scenario_id"], "day", "permaticker", "ret", F.col("decile") == 10)


def long_only_monthly(spark, d):
    return out(_best(spark, d))


def long_short_spread(spark, d):
    return out(harness.long_short(_rank_panel(spark, d), ["scenario_id"], "day", "permaticker", "ret", "decile"))


def cost_curve(spark, d):
    net = harness.net_of_cost(_best(spark, d).where("gross is not null"))
    return out(harness.curve_metrics(net, ["scenario_id", "bps"], "day", F.col("net")))


def cheat_control(spark, d):
    return out(harness.spearman_by(_rank_panel(spark, d).withColumn("cheat", F.col("ret")), KEYS, "cheat", "ret"))


def permutation_null(spark, d):
    return out(harness.permutation_null(_rank_panel(spark, d), KEYS, "permaticker", "composite", "ret"))


def leak_audit(spark, d):
    return out(harness.leak_audit(_rank_panel(spark, d), KEYS, "permaticker", "composite", "ret"))


def ew_universe_benchmark(spark, d):
    return out(harness.benchmark(_rank_panel(spark, d), KEYS, "ret"))


def status_counts(spark, d):
    p = _rank_panel(spark, d)
    gone = F.avg((F.col("fwd_status") == "delisted_partial").cast("double"))
    return out(p.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), gone.alias("delisting_rate")))


def benchmark_period_returns(spark, d):
    bars = _bars(spark, d)
    level = bars.groupBy("day").agg(F.avg("closeadj").alias("level"))
    return out(period_returns(panel.rebalance_days(panel.calendar_of(bars)), level, "day", "level"))


def _sized(spark, d):
    f = table(spark, d, "feat_t").select("t", "permaticker", no_nan("close_t").alias("close_t"), "dollarvol_60").distinct()
    f = f.groupBy("t", "permaticker").agg(F.max("close_t").alias("close_t"), F.max("dollarvol_60").alias("dollarvol_60"))
    return f.withColumn("cap", F.col("close_t") * (F.col("permaticker") % 200 + 10))


def water_fill_weights(spark, d):
    got = water_fill(_sized(spark, d), ["t"], "permaticker", "dollarvol_60", F.lit(5e7))
    return out(got.select("t", "permaticker", "weight"))


def impact_cost(spark, d):
    f = _sized(spark, d).withColumn("tier", size_tier(F.col("cap")))
    part = F.coalesce(F.lit(1e4) / F.nullif(F.col("dollarvol_60"), F.lit(0.0)), F.lit(0.0))
    return out(f.select("t", "permaticker", "tier", side_cost_bps(part, half_spread(F.col("tier")), 1.0).alias("bps")))


def _holdings(spark, d):
    return table(spark, d, "panel").select(
        "scenario_id", F.col("date").alias("day"), F.col("permaticker").cast("long").alias("item"), F.col("decile").cast("double").alias("decile"), no_nan("composite").alias("composite"),
        no_nan("fwd_ret_21").alias("ret"), (F.col("permaticker") % 97 * 1e4).cast("double").alias("dollarvol"), (F.col("permaticker") % 400).cast("double").alias("marketcap"), "fwd_status",
    )


TIGHT = BookParams(target_n=3, max_weight=0.4)  # a book that is full and weights that meet their caps


def buffered_book_query(spark, d):
    return out(buffered_book(_holdings(spark, d), (1e5, 2e6), (1.0, 2.0), BookParams(), "scenario_id"))


def tight_book(spark, d):
    return out(buffered_book(_holdings(spark, d), (1e4, 2e6), (0.5, 2.0), TIGHT, "scenario_id"))


def book_summary(spark, d):
    return out(book_diagnostics(buffered_book(_holdings(spark, d), (1e5, 2e6), (1.0, 2.0), BookParams(), "scenario_id")))


FLOORS = {"dollarvol": (50_000.0, None), "close": (2.0, None)}
SMALL = factors.Band("small", {"marketcap": (None, 1500.0), **FLOORS})
LARGE = factors.Band("large", {"marketcap": (600.0, None), **FLOORS})
BANDS = [SMALL, LARGE, *[replace(SMALL.with_floors(dollarvol=v, close=c), name=f"small|{v:.0f}|{c:.0f}") for v in (20_000.0, 200_000.0) for c in (1.0, 10.0)]]


def _pooled(spark, d):
    """The built panel with its days pooled into years, as a day of the small tables has too few names for ten deciles; an
    item is a name in a month of the year."""
    built = staged(_built(spark, d))
    return built.withColumns({"item": F.col("permaticker") * 1000 + F.month("day"), "day": F.trunc("day", "year")})


def pooled_scores(spark, d):
    got = factors.factor_scores(_pooled(spark, d), "day", "item")
    return out(got.select("day", "item", *factors.FACTORS, "ranked", "composite", "decile"))


def band_scores(spark, d):
    got = harness.score_bands(_pooled(spark, d), BANDS, "day", "item")
    return out(got.select("band", "day", "item", "composite", "decile", "ranked", "fwd_ret", "fwd_status"))


def band_summary(spark, d):
    return out(harness.band_summary(_pooled(spark, d), BANDS, "day", "item"))


def labels_attached(spark, d):
    """Composites without their labels, given back by the panel they came from."""
    pooled = _pooled(spark, d)
    scores = factors.factor_scores(pooled, "day", "item").select("day", "item", "composite").where("composite is not null")
    return out(harness.attach_labels(scores, pooled, ["day", "item"], ["fwd_ret", "fwd_status"]))


def _band_book(pooled):
    scored = harness.score_bands(pooled, BANDS, "day", "item")
    p = scored.select("band", "day", "item", F.col("decile").cast("double").alias("decile"), "composite", F.col("fwd_ret").alias("ret"), "dollarvol", "marketcap", "fwd_status")
    return buffered_book(p, (5e5, 2e6), (0.5, 1.0, 2.0), BookParams(every=1), "band")


def _band_grid(pooled):
    """Curve and diagnostics of every band, size and cost scale."""
    book = staged(_band_book(pooled))
    return harness.curve_metrics(book, ["scenario"], "day", F.col("net")).join(book_diagnostics(book), "scenario")


def band_book_grid(spark, d):
    return out(_band_grid(_pooled(spark, d)).select("scenario", "periods", "ann_return", "sharpe", "cagr", "max_drawdown", "median_held", "mean_invested", "mean_turnover_rebalanced", "mean_participation"))


def decision_readout(spark, d):
    """Both ways round, so that a case that qualifies and one that does not can come out."""
    pooled = _pooled(spark, d)
    parts = F.split("scenario", r"\|")
    grid = _band_grid(pooled).where("size(split(scenario, '[|]')) = 3").select(parts[0].alias("name"), parts[1].cast("double").alias("aum"), parts[2].cast("double").alias("cost_scale"), "sharpe")
    grid, summary = staged(grid), staged(harness.band_summary(pooled, [SMALL, LARGE], "day", "item"))
    got = None
    for a, b, margin in (("small", "large", 0.2), ("large", "small", 0.2), ("small", "small", -9.0), ("large", "large", -9.0)):
        row = harness.decision(grid, summary, a, b, margin, -1.0 if margin < 0 else 0.5).select(F.lit(a).alias("candidate"), F.lit(b).alias("baseline"), F.lit(margin).alias("margin"), "*")
        got = row if got is None else got.unionByName(row)
    return out(got)


QUERIES = {f.__name__: f for f in (
    attribute_interval_join, attribution_ambiguity, panel_returns_vol, trailing_median_dollarvol, calendar_anchors, asof_price, asof_fundamentals,
    asof_strict_filing, anchor_momentum, forward_label_status, built_panel, span_panel, daily_valuation, universe_screen, universe_funnel, band_screen_grid, winsor_z, factor_scores,
    ranking_coverage, deciles, rank_ic_by_date, ic_summary, newey_west, decile_table, monotonicity, long_only_monthly, long_short_spread, cost_curve,
    cheat_control, permutation_null, leak_audit, ew_universe_benchmark, status_counts, benchmark_period_returns, water_fill_weights, impact_cost, tight_book, book_summary, pooled_scores, band_scores, band_summary, labels_attached, band_book_grid, decision_readout,
)} | {"buffered_book": buffered_book_query}

_FT = "ft as (select distinct feat_id, cast(t as date) t, permaticker from feat_t)"
_FD = f"""
fd0 as (
  select f.*, min(o.permaticker) permaticker
  from (select distinct fund_id, ticker, {sql_day("datekey")} k, eps, bvps, gp, assets from fundamentals where dimension = 'ART') f
  join ok o on o.ticker = f.ticker and f.k between o.a and o.b group by all having count(distinct o.permaticker) = 1),
fd as (select * from fd0 qualify row_number() over (partition by permaticker, k order by fund_id desc) = 1)"""

_CAP = """
cap0 as (select ticker, cast(date as date) d, max(closeadj) * (length(ticker) * 7 + ascii(ticker) % 60) marketcap from sep_prices
  where ticker is not null and not isnan(closeadj) and ascii(right(ticker, 1)) % 7 <> 0 and day(date) % 5 = 0 group by ticker, date),
cap as (select c.ticker, c.d, c.marketcap, min(o.permaticker) permaticker from cap0 c join ok o on o.ticker = c.ticker and c.d between o.a and o.b
  group by all having count(distinct o.permaticker) = 1)"""

_PANEL = f"""{SQL_BARS},{_FD},{_CAP},
px as (select permaticker, d, closeadj, volume, row_number() over w seq, closeadj / nullif(lag(closeadj) over w, 0) - 1 r
  from bar window w as (partition by permaticker order by d)),
fx as (select *, stddev_samp(r) over (w rows 251 preceding) vol, median(closeadj * volume) over (w rows 59 preceding) dollarvol
  from px window w as (partition by permaticker order by d)),
cal as (select distinct d from bar),
anc as (select d, lag(d, 21) over o dskip, lag(d, 252) over o dback, lead(d, 21) over o dfwd from cal window o as (order by d)),
reb as (select * from anc where d in (select max(d) from cal group by date_trunc('month', d))),
meta as (
  select permaticker, b, category, exchange
  from (select permaticker, {sql_day("firstpricedate")} a, {sql_day("lastpricedate")} b, category, exchange from tickers) where a <= b
  qualify row_number() over (partition by permaticker order by b desc, category desc nulls last, exchange desc nulls last) = 1),
grid as (
  select m.permaticker, m.b, m.category, m.exchange, r.* from reb r
  join (select permaticker, min(d) a from bar group by 1) s on r.d >= s.a join meta m on m.permaticker = s.permaticker where r.d <= m.b),
p0 as (select g.*, x.closeadj, x.seq, x.vol, x.dollarvol from grid g asof join fx x on g.permaticker = x.permaticker and g.d >= x.d),
p1 as (select p0.*, c.marketcap from p0 asof left join (select permaticker, d, max(marketcap) marketcap from cap group by all) c on p0.permaticker = c.permaticker and p0.d >= c.d),
p2 as (select p1.*, f.eps, f.bvps, f.gp, f.assets from p1 asof left join fd f on p1.permaticker = f.permaticker and p1.d >= f.k),
p3 as (select p2.*, x.closeadj c_skip from p2 asof left join bar x on p2.permaticker = x.permaticker and p2.dskip >= x.d),
p4 as (select p3.*, x.closeadj c_back from p3 asof left join bar x on p3.permaticker = x.permaticker and p3.dback >= x.d),
p5 as (select p4.*, x.closeadj c_fwd, x.d d_fwd from p4 asof left join bar x on p4.permaticker = x.permaticker and p4.dfwd >= x.d),
p6 as (select *, case when dfwd is null then 'incomplete_window' when d_fwd = d and not b < dfwd then 'no_forward_price'
  when b < dfwd then 'delisted_partial' else 'ok' end fwd_status from p5),
built as (select d as day, permaticker, closeadj as close, marketcap, dollarvol, seq hist_days, c_skip / nullif(c_back, 0) - 1 mom, vol, eps, bvps, gp, assets,
  category, exchange, case when fwd_status in ('ok', 'delisted_partial') then c_fwd / nullif(closeadj, 0) - 1 end fwd_ret, fwd_status from p6)"""

_RP = """rp as (select distinct scenario_id, cast(date as date) as day, permaticker, case when not isnan(composite) then composite end composite, decile,
  case when not isnan(fwd_ret_21) then fwd_ret_21 end ret, fwd_status from panel)"""


def _winsor(src: str, by: str, name: str, expr: str, dst: str) -> str:
    """CTEs that add ``name`` = winsorised z of ``expr`` within ``by`` to ``src`` as ``dst``."""
    return f"""
{dst}_a as (select *, {expr} as x_ from {src}),
{dst}_b as (select *, avg(x_) over (partition by {by}) m_, stddev_pop(x_) over (partition by {by}) s_ from {dst}_a),
{dst}_c as (select *, case when x_ is not null then greatest(m_ - 3 * s_, least(m_ + 3 * s_, x_)) end c_ from {dst}_b),
{dst}_d as (select *, avg(c_) over (partition by {by}) n_, stddev_pop(c_) over (partition by {by}) t_ from {dst}_c),
{dst} as (select * exclude (x_, m_, s_, c_, n_, t_), case when c_ is not null then
  case when t_ <= 1e-14 * greatest(abs(n_), 1) then 0.0 else (c_ - n_) / nullif(t_, 0) end end as {name} from {dst}_d)"""


def _scores(src: str, by: str, item: str, dst: str) -> str:
    """CTEs that score ``src`` within ``by`` as ``dst``."""
    parts = [("momentum", "mom"), ("ep_z", "eps / nullif(close, 0)"), ("bp_z", "bvps / nullif(close, 0)"), ("quality", "gp / nullif(assets, 0)"), ("lowvol", "-vol"), ("size", "-ln(case when marketcap > 0 then marketcap end)"), ("value", "(ep_z + bp_z) / 2")]
    steps = ",".join(_winsor(f"{dst}{k}" if k else src, by, name, expr, f"{dst}{k + 1}") for k, (name, expr) in enumerate(parts))
    return f"""{steps},
{dst}8 as (select *, momentum is not null and value is not null and quality is not null and lowvol is not null and size is not null as ranked from {dst}7),
{dst}9 as (select *, case when ranked then (momentum + value + quality + lowvol + size) / 5 end composite from {dst}8),
{dst} as (select *, case when ranked and count(*) over (partition by {by}, ranked) >= 10 then greatest(1,
  ceil(10.0 * (row_number() over (partition by {by}, ranked order by round(composite, 12), {item}) - 1) / (count(*) over (partition by {by}, ranked) - 1))) end decile from {dst}9)"""


_SCORES = f"{_PANEL},{_scores('built', 'day', 'permaticker', 'sc')}"
_POOLED = f"{_PANEL}, pool as (select * replace (cast(date_trunc('year', day) as date) as day), permaticker * 1000 + month(day) item from built)"
_BANDS = f"""{_POOLED},
bn as (select * from (values ('small', null, 1500.0, 50000.0, 2.0), ('large', 600.0, null, 50000.0, 2.0), ('small|20000|1', null, 1500.0, 20000.0, 1.0), ('small|20000|10', null, 1500.0, 20000.0, 10.0),
  ('small|200000|1', null, 1500.0, 200000.0, 1.0), ('small|200000|10', null, 1500.0, 200000.0, 10.0)) t(band, lo, hi, dv, px)),
sg as (select bn.band, pool.*, coalesce(marketcap >= coalesce(lo, marketcap) and marketcap <= coalesce(hi, marketcap), false) and coalesce(dollarvol >= dv, false) and coalesce(close >= px, false) eligible from pool, bn),
el as (select * exclude (eligible) from sg where eligible),{_scores('el', 'band, day', 'item', 'bs')}"""


def _book_sql(src: str, target: int, max_weight: float, aums: str, scales: str, every: int = 3) -> str:
    """CTEs of the buffered book over ``src`` (g, day, item, decile, composite, ret, dv, cap, gone), ending in ``book``.

    Which names are held does not depend on size or cost, so the recursion walks lists of names; weights, turnover and
    costs follow from them.
    """
    return f"""
bo1 as (select * from {src} where day is not null and item is not null qualify row_number() over (partition by g, day, item order by decile desc nulls last, composite desc nulls last, ret desc nulls last, dv desc nulls last, cap desc nulls last, gone desc) = 1),
bod as (select g, day, row_number() over (partition by g order by day) - 1 i from (select distinct g, day from bo1)),
bo as (select bo1.*, i from bo1 join bod using (g, day)),
per as (select g, i // {every} r, coalesce(list(item) filter (decile >= 8), []) h, coalesce(list(item order by coalesce(composite, '-inf'::double) desc, item) filter (decile >= 10), []) c, coalesce(list(item) filter (dv > 0), []) v
  from bo where i % {every} = 0 group by all),
rec as (
  select g, r, list_filter(c[1:{target}], lambda x: list_contains(v, x)) held from per where r = 0
  union all
  select g, r, list_filter(list_concat(k, list_filter(c, lambda x: not list_contains(k, x))[1:greatest(0, {target} - len(k))]), lambda x: list_contains(v, x))
  from (select p.*, list_filter(rec.held, lambda x: list_contains(p.h, x)) k from rec join per p on p.g = rec.g and p.r = rec.r + 1)),
se1 as (select aum, scale from unnest({aums}) a(aum), unnest({scales}) s(scale)),
hw as (select g, r, item, aum, least({max_weight}, 10 * dv / aum) c from (select g, r, unnest(held) item from rec) join bo using (g, item), unnest({aums}) a(aum) where bo.i = r * {every}),
hn as (select *, count(*) over (partition by g, r, aum) n, row_number() over (partition by g, r, aum order by c, item) k, sum(c) over (partition by g, r, aum order by c, item rows unbounded preceding) - c below, sum(c) over (partition by g, r, aum) al from hw),
hl as (select *, max(case when c >= (1 - below) / (n - k + 1) then (1 - below) / (n - k + 1) end) over (partition by g, r, aum) lv from hn),
wt as (select g, r, item, aum, case when al <= 1 then c else least(c, coalesce(lv, c)) end w from hl),
mvd as (select g, r, item, aum, sum(w) w, sum(v) v from (select g, r, item, aum, w, 0.0 v from wt union all select g, r + 1, item, aum, 0.0, w from wt) group by all),
tn as (select g, r, aum, sum(abs(w - v)) turnover from mvd group by all),
pt as (select mvd.*, abs(w - v) d, cap, case when dv > 0 and cap is not null then greatest(w, v) * mvd.aum / dv else 0 end part from mvd join bo on bo.g = mvd.g and bo.item = mvd.item and bo.i = r * {every}),
co as (select g, r, aum, scale, sum(d * (case when coalesce(cap, 0) < 50 then 150.0 when cap < 300 then 50.0 else 10.0 end + 100 * sqrt(part) + 1) * scale) / 1e4 as cost,
  avg(part) filter (d > 0) part_mean, max(part) filter (d > 0) part_max from pt join se1 using (aum) group by all),
mo as (select bod.g, bod.day, wt.aum, count(*) held, sum(w) invested, sum(w * coalesce(ret, 0)) gross, count(ret) valid, count(*) filter (ret is not null and gone) delisted
  from bod join wt on wt.g = bod.g and wt.r = bod.i // {every} left join bo on bo.g = bod.g and bo.i = bod.i and bo.item = wt.item group by all),
book as (select bod.g || '|' || cast(cast(se1.aum as bigint) as varchar) || '|' || cast(cast(se1.scale as decimal(9, 1)) as varchar) scenario, bod.day, i % {every} = 0 rebalanced, coalesce(held, 0) held, coalesce(invested, 0.0) invested, coalesce(gross, 0.0) gross,
  case when i % {every} = 0 then coalesce(turnover, 0.0) else 0.0 end turnover, case when i % {every} = 0 then coalesce(cost, 0.0) else 0.0 end as cost, coalesce(gross, 0.0) - case when i % {every} = 0 then coalesce(cost, 0.0) else 0.0 end net,
  case when i % {every} = 0 then part_mean end part_mean, case when i % {every} = 0 then part_max end part_max, coalesce(valid, 0) valid, coalesce(held, 0) - coalesce(valid, 0) missing, coalesce(delisted, 0) delisted
  from bod cross join se1 left join mo on mo.g = bod.g and mo.day = bod.day and mo.aum = se1.aum left join tn on tn.g = bod.g and tn.r = i // {every} and tn.aum = se1.aum left join co on co.g = bod.g and co.r = i // {every} and co.aum = se1.aum and co.scale = se1.scale)"""


_HOLDINGS = """
bsrc as (select cast(scenario_id as varchar) g, cast(date as date) as day, cast(permaticker as bigint) item, decile, case when not isnan(composite) then composite end composite, case when not isnan(fwd_ret_21) then fwd_ret_21 end ret,
  permaticker % 97 * 1e4 dv, cast(permaticker % 400 as double) cap, coalesce(fwd_status = 'delisted_partial', false) gone from panel)"""
_BOOK_OUT = ("invested gross turnover cost net part_mean part_max", "held valid missing delisted")
_DIAG = """
dg as (select scenario, count(*) as months, sum(rebalanced::int) rebalances, avg(turnover) mean_turnover, avg(turnover) filter (rebalanced) mean_turnover_rebalanced, cast(floor(median(held)) as bigint) median_held, avg(invested) mean_invested,
  avg(part_mean) mean_participation, max(part_max) max_participation, max(cost) max_cost, sum(delisted) delisted, sum(missing) missing from book group by 1)"""
_DIAG_OUT = ("mean_turnover mean_turnover_rebalanced mean_invested mean_participation max_participation max_cost", "rebalances delisted missing")
_BAND_BOOK = f"""{_BANDS}, bsrc as (select band g, day, item, decile, composite, fwd_ret ret, dollarvol dv, marketcap cap, coalesce(fwd_status = 'delisted_partial', false) gone from bs),
{_book_sql('bsrc', 75, 0.03, '[500000.0, 2000000.0]', '[0.5, 1.0, 2.0]', 1)},{_DIAG},
be as (select *, product(1 + net) over (partition by scenario order by day) eq, count(*) over (partition by scenario) n, stddev_samp(net) over (partition by scenario) sd from book),
bf as (select *, eq / max(eq) over (partition by scenario order by day) - 1 dd, n >= 2 and sd > 0 k from be),
bg as (select scenario, count(*) periods, case when k then avg(net) * 12 end ann_return, case when k then avg(net) / nullif(stddev_samp(net), 0) * sqrt(12) end sharpe,
  case when k and arg_max(eq, day) > 0 then pow(arg_max(eq, day), 12.0 / count(*)) - 1 end cagr, case when k then min(dd) end max_drawdown from bf group by scenario, k)"""
_BAND_SUM = """
pd as (select band, day, sum(eligible::int) n, sum((eligible and coalesce(fwd_status = 'delisted_partial', false))::int) gone from sg group by all),
cn as (select band, sum(n) n_eligible, cast(floor(median(n)) as bigint) median_eligible, sum(gone) / nullif(sum(n), 0) delisting_rate from pd group by 1),
rp as (select band, day, item permaticker, composite, fwd_ret ret, decile, ranked from bs)"""


_NW = """
ns as (select {s}, row_number() over (partition by {s} order by day) i, ic v, count(*) over (partition by {s}) n, avg(ic) over (partition by {s}) m from ics where ic is not null),
ne as (select {s}, i, v - m e, n, m, cast(floor(pow(n, 0.25)) + 1 as int) l from ns),
nc as (select a.{s}, k, sum(a.e * b.e) g from ne a join range(0, 50) t(k) on k <= a.l join ne b on b.{s} = a.{s} and b.i = a.i - k group by all),
nf as (select {s}, any_value(m) mean, any_value(n) n, any_value(l) lags from ne group by 1),
nw as (select {s}, mean, case when n >= 3 then mean / nullif(sqrt(case when sum(case when k = 0 then g else 2 * (1 - k / (lags + 1.0)) * g end) > 0 then sum(case when k = 0 then g else 2 * (1 - k / (lags + 1.0)) * g end) end) / n, 0) end t_stat, n, lags from nf join nc using ({s}) group by {s}, mean, n, lags)"""

_IC = """
fin as (select {by}, permaticker, {x} x, {y} y from rp where {x} is not null and {y} is not null),
rk as (select {by}, rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0 a,
  rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0 b from fin),
one as (select {by}, count(*) n, case when count(*) >= 5 and min(a) < max(a) and min(b) < max(b)
  then covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) end ic from rk group by all),
al as (select {by}, count(*) c from rp group by all),
ics as (select al.*, one.ic, coalesce(one.n, 0) n, al.c - coalesce(one.n, 0) n_missing from al left join one using ({by}))"""


def _null_sql() -> str:
    """CTE nul (rep, mean_ic, periods) over rp."""
    p, root = harness.MINSTD
    steps = ", ".join(f"({k}, {pow(root, k + 1, p)})" for k in range(harness.NULL_REPS))
    return f"""
nb as (select scenario_id, day, composite s, rank() over (partition by scenario_id, day order by ret) + (count(*) over (partition by scenario_id, day, ret) - 1) / 2.0 b,
  ('0x' || substr(md5(scenario_id || '|' || day || '|' || permaticker || '|{harness.NULL_SEED}'), 1, 15))::bigint % {p - 1} + 1 x from rp where composite is not null and ret is not null),
nd as (select rep, scenario_id, day, s, b, (x * m) % {p} / {float(p)} u from nb, (values {steps}) t(rep, m)),
ni as (select rep, scenario_id, day, case when count(*) >= 5 and min(s) < max(s) and min(b) < max(b) then covar_pop(u, b) / nullif(stddev_pop(u) * stddev_pop(b), 0) end ic from nd group by all),
nul as (select rep, avg(ic) mean_ic, count(ic) periods from ni group by 1)"""


def _ic(x: str = "composite", y: str = "ret", by: str = "scenario_id, day") -> str:
    return f"{_RP},{_IC.format(x=x, y=y, by=by)}"


_BUCKET = f"""{_RP},
mon as (select scenario_id, day, decile, avg(ret) r from rp where decile is not null and ret is not null group by all),
dt as (select k decile, avg(r) mean_ret, avg(r) / nullif(stddev_samp(r), 0) * sqrt(12) sharpe, count(r) periods
  from range(1, 11) t(k) left join mon on mon.decile = k group by 1)"""


def _held(decile: int, name: str) -> str:
    return f"""
{name}h as (select scenario_id, day, permaticker, ret, 1.0 / count(*) over (partition by scenario_id, day) w from rp where decile = {decile}),
{name}g as (select scenario_id, day, avg(ret) gross, count(*) members, sum(case when ret is null then 1 else 0 end) dropped,
  row_number() over (partition by scenario_id order by day) i from {name}h group by 1, 2),
{name}n as (select h.scenario_id, i, permaticker, w from {name}h h join {name}g using (scenario_id, day)),
{name}u as (select scenario_id, i, permaticker, w, 0.0 v from {name}n union all select scenario_id, i + 1, permaticker, 0.0, w from {name}n),
{name}t as (select scenario_id, i, sum(abs(x)) turnover from (select scenario_id, i, permaticker, sum(w) - sum(v) x from {name}u group by all) group by all),
{name} as (select g.*, t.turnover from {name}g g join {name}t t using (scenario_id, i))"""


_SCREEN = f"""
f as (select distinct feat_id, cast(t as date) t, dollarvol_60, close_t, hist_days from feat_t),
s as (select feat_id, t, coalesce(dollarvol_60 >= 200000, false) dollarvol_60_ok, coalesce(close_t between 5 and 400, false) close_t_ok,
  coalesce(hist_days >= 60, false) hist_days_ok, coalesce(dollarvol_60 >= 50000, false) and coalesce(close_t between 1 and 400, false) and coalesce(hist_days >= 60, false) wide from f),
e as (select *, dollarvol_60_ok and close_t_ok and hist_days_ok eligible from s)"""

_SIZED = """
z as (select cast(t as date) t, permaticker, max(close_t) close_t, max(dollarvol_60) dv from feat_t group by all),
zz as (select *, close_t * (permaticker % 200 + 10) cap from z)"""

SQL = {
    "attribute_interval_join": sql_out(f"with {SQL_BARS} select permaticker, count(*) n, cast(min(date) as date) first_day, cast(max(date) as date) last_day, sum(volume) volume from owned group by 1", "volume", "permaticker n"),
    "attribution_ambiguity": sql_out(f"with {SQL_OWNERS} select p.ticker, cast(p.date as date) as day, count(*) matches from sep_prices p join ok o on o.ticker = p.ticker and p.date between o.a and o.b group by all having count(*) > 1"),
    "panel_returns_vol": sql_out(f"with {SQL_BARS}, px as (select permaticker, d as day, row_number() over w seq, closeadj / nullif(lag(closeadj) over w, 0) - 1 r from bar window w as (partition by permaticker order by d)) select permaticker, day, seq, r ret, stddev_samp(r) over (partition by permaticker order by day rows 251 preceding) vol from px", "ret vol", "permaticker"),
    "trailing_median_dollarvol": sql_out(f"with {SQL_BARS}, n as (select *, row_number() over (partition by permaticker order by d) i from bar), r as (select max(d) r from (select distinct d from bar) group by date_trunc('month', d)), h as (select permaticker, r, max(i) filter (where d <= r) h from n, r group by 1, 2 having min(d) <= r and max(d) >= r) select h.permaticker, h.r as day, median(closeadj * volume) dollarvol from h join n on n.permaticker = h.permaticker and n.i between h.h - 59 and h.h group by all having count(closeadj * volume) > 0", "dollarvol", "permaticker"),
    "calendar_anchors": f"with {SQL_BARS}, cal as (select distinct d from bar), anc as (select d as day, row_number() over o idx, lag(d, 21) over o day_skip, lag(d, 252) over o day_back, lead(d, 21) over o day_fwd from cal window o as (order by d)) select * from anc where day in (select max(d) from cal group by date_trunc('month', d))",
    "asof_price": sql_out(f"with {SQL_BARS}, {_FT} select ft.feat_id, bar.d bar_seen, bar.closeadj from ft asof join bar on ft.permaticker = bar.permaticker and ft.t >= bar.d", "closeadj"),
    "asof_fundamentals": sql_out(f"with {SQL_OWNERS}, {_FD}, {_FT} select ft.feat_id, fd.fund_id, fd.eps, fd.bvps from ft asof left join fd on ft.permaticker = fd.permaticker and ft.t >= fd.k", "eps bvps"),
    "asof_strict_filing": f"with {_FT}, g as (select permaticker, cast(acceptance_date as date) a, max(filing_id) filing_id from filings where not is_amendment and permaticker is not null and acceptance_date is not null group by all), j as (select ft.*, g.a, g.filing_id from ft asof left join g on ft.permaticker = g.permaticker and ft.t > g.a) select feat_id, case when t - a <= 548 then filing_id end filing_id, case when t - a <= 548 then a end filed, case when a is null then 'no_filing' when t - a > 548 then 'stale' else 'ok' end status from j",
    "anchor_momentum": sql_out(f"with {_PANEL} select day, permaticker, mom from built", "mom", "permaticker"),
    "forward_label_status": sql_out(f"with {_PANEL} select day, permaticker, fwd_ret, fwd_status from built", "fwd_ret", "permaticker"),
    "built_panel": sql_out(f"with {_PANEL} select * from built", "close marketcap dollarvol mom vol eps bvps gp assets fwd_ret", "permaticker"),
    "span_panel": sql_out(f"with {_PANEL} select * from built where day between date '2013-01-01' and date '2014-12-31'", "close marketcap dollarvol mom vol eps bvps gp assets fwd_ret", "permaticker"),
    "daily_valuation": sql_out(f"with {SQL_OWNERS},{_CAP} select permaticker, ticker, d as day, marketcap from cap", "marketcap", "permaticker"),
    "universe_screen": f"with {_SCREEN} select * exclude (wide) from e",
    "universe_funnel": sql_out(f"with {_SCREEN} select t, count(*) candidates, sum(dollarvol_60_ok::int) n_dollarvol_60_ok, sum(close_t_ok::int) n_close_t_ok, sum(hist_days_ok::int) n_hist_days_ok, sum(eligible::int) n_eligible from e group by t", "", "n_dollarvol_60_ok n_close_t_ok n_hist_days_ok n_eligible"),
    "band_screen_grid": sql_out(f"with {_SCREEN} select 'core' band, t, sum(eligible::int) eligible from e group by t union all select 'wide', t, sum(wide::int) from e group by t", "", "eligible"),
    "winsor_z": sql_out(f"with {_RP},{_winsor('rp', 'scenario_id, day', 'z', 'composite', 'w')} select scenario_id, day, permaticker, z from w", "z", "permaticker"),
    "factor_scores": sql_out(f"with {_SCORES} select day, permaticker, momentum, value, quality, lowvol, size, ranked, composite, decile from sc", "momentum value quality lowvol size composite", "permaticker decile"),
    "ranking_coverage": sql_out(f"with {_SCORES} select day, count(*) eligible, sum(ranked::int) ranked, count(*) - sum(ranked::int) dropped from sc group by day", "", "ranked dropped"),
    "deciles": sql_out(f"with {_RP} select scenario_id, day, permaticker, case when composite is not null and count(*) over p >= 10 then greatest(1, ceil(10.0 * (row_number() over (p order by composite, permaticker) - 1) / (count(*) over p - 1))) end decile from rp window p as (partition by scenario_id, day, composite is not null)", "", "permaticker decile"),
    "rank_ic_by_date": sql_out(f"with {_ic()} select scenario_id, day, ic, n, n_missing from ics", "ic"),
    "ic_summary": sql_out(f"with {_ic()} select count(ic) periods, avg(ic) mean_ic, median(ic) median_ic, stddev_samp(ic) sd_ic, avg(case when ic is not null then (round(ic, 12) > 0)::int end) share_positive from ics", "mean_ic median_ic sd_ic share_positive"),
    "newey_west": sql_out(f"with {_ic()},{_NW.format(s='scenario_id')} select scenario_id, mean, t_stat, n, lags from nw", "mean t_stat", "lags"),
    "buffered_book": sql_out(f"with recursive {_HOLDINGS},{_book_sql('bsrc', 75, 0.03, '[100000.0, 2000000.0]', '[1.0, 2.0]')} select * from book", *_BOOK_OUT),
    "tight_book": sql_out(f"with recursive {_HOLDINGS},{_book_sql('bsrc', 3, 0.4, '[10000.0, 2000000.0]', '[0.5, 2.0]')} select * from book", *_BOOK_OUT),
    "book_summary": sql_out(f"with recursive {_HOLDINGS},{_book_sql('bsrc', 75, 0.03, '[100000.0, 2000000.0]', '[1.0, 2.0]')},{_DIAG} select * from dg", *_DIAG_OUT),
    "pooled_scores": sql_out(f"with {_POOLED},{_scores('pool', 'day', 'item', 'ps')} select day, item, momentum, value, quality, lowvol, size, ranked, composite, decile from ps", "momentum value quality lowvol size composite", "item decile"),
    "band_scores": sql_out(f"with {_BANDS} select band, day, item, composite, decile, ranked, fwd_ret, fwd_status from bs", "composite fwd_ret", "item decile"),
    "labels_attached": sql_out(f"with {_POOLED},{_scores('pool', 'day', 'item', 'ps')} select day, item, composite, fwd_ret, fwd_status from ps where composite is not null", "composite fwd_ret", "item"),
    "band_summary": sql_out(
        f"""with {_BANDS},{_BAND_SUM},{_IC.format(x='composite', y='ret', by='band, day')},{_NW.format(s='band')},
rk1 as (select band, sum(ranked::int) ranked from bs group by 1),
sm as (select band, count(ic) periods, avg(ic) mean_ic, median(ic) median_ic, stddev_samp(ic) sd_ic, avg(case when ic is not null then (round(ic, 12) > 0)::int end) share_positive from ics group by 1),
mon as (select band, day, decile, avg(ret) r from rp where decile is not null and ret is not null group by all),
dt as (select band, decile, avg(r) mean_ret, avg(r) / nullif(stddev_samp(r), 0) * sqrt(12) sharpe from mon group by all),
dr as (select *, rank() over (partition by band order by mean_ret) + (count(*) over (partition by band, mean_ret) - 1) / 2.0 a, case when sharpe is not null then rank() over (partition by band, sharpe is null order by sharpe) end b from dt),
ms as (select band, case when count(*) >= 3 then corr(decile, a) end spearman_ret from dr group by 1),
mt as (select band, case when count(*) >= 3 then corr(k, b) end spearman_sharpe from (select band, b, row_number() over (partition by band order by decile) k from dr where b is not null) group by 1)
select cn.*, ranked, periods, mean_ic, median_ic, sd_ic, share_positive, t_stat, spearman_ret, spearman_sharpe from cn left join rk1 using (band) left join sm using (band) left join nw using (band) left join ms using (band) left join mt using (band)""",
        "delisting_rate mean_ic median_ic sd_ic share_positive t_stat spearman_ret spearman_sharpe",
        "n_eligible ranked periods",
    ),
    "band_book_grid": sql_out(f"with recursive {_BAND_BOOK} select scenario, periods, ann_return, sharpe, cagr, max_drawdown, median_held, mean_invested, mean_turnover_rebalanced, mean_participation from bg join dg using (scenario)", "ann_return sharpe cagr max_drawdown mean_invested mean_turnover_rebalanced mean_participation"),
    "decision_readout": sql_out(
        f"""with recursive {_BAND_BOOK},{_BAND_SUM},{_IC.format(x='composite', y='ret', by='band, day')},
mon as (select band, day, decile, avg(ret) r from rp where decile is not null and ret is not null group by all),
dt as (select band, decile, avg(r) / nullif(stddev_samp(r), 0) sharpe from mon group by all),
mt as (select band, case when count(*) >= 3 then corr(k, b) end ss from (select band, rank() over (partition by band order by sharpe) b, row_number() over (partition by band order by decile) k from dt where sharpe is not null) group by 1),
sm as (select band, avg(ic) mean_ic from ics group by 1),
gr as (select split_part(scenario, '|', 1) name, cast(split_part(scenario, '|', 3) as double) sc, avg(sharpe) s from bg where len(string_split(scenario, '|')) = 3 group by all),
cs as (select * from (values ('small', 'large', 0.2, 0.5), ('large', 'small', 0.2, 0.5), ('small', 'small', -9.0, -1.0), ('large', 'large', -9.0, -1.0)) t(candidate, baseline, margin, least)),
fg as (select candidate, baseline, margin, least, (select s from gr where name = candidate and sc = 1) candidate_1x, (select s from gr where name = candidate and sc = 2) candidate_2x, (select s from gr where name = baseline and sc = 1) baseline_1x,
  (select mean_ic from sm where band = candidate) mean_ic, (select ss from mt where band = candidate) spearman_sharpe from cs),
fh as (select * exclude (least), candidate_1x - baseline_1x margin_1x, candidate_2x - baseline_1x margin_2x, coalesce(mean_ic > 0, false) ic_ok, coalesce(spearman_sharpe > least, false) monotone_ok from fg),
fi as (select *, coalesce(margin_1x >= margin and margin_2x >= margin, false) margin_ok from fh)
select *, ic_ok and monotone_ok and margin_ok qualifies from fi""",
        "margin candidate_1x candidate_2x baseline_1x mean_ic spearman_sharpe margin_1x margin_2x",
    ),
    "decile_table": sql_out(f"with {_BUCKET} select * from dt", "mean_ret sharpe", "decile periods"),
    "monotonicity": sql_out(f"with {_BUCKET}, r as (select *, rank() over (order by mean_ret) a, rank() over (order by sharpe) b, mean_ret - lag(mean_ret) over (order by decile) step from dt where periods > 0) select corr(decile, a) spearman_ret, corr(decile, b) spearman_sharpe, sum((step > 0)::int) rising, arg_max(mean_ret, decile) - arg_min(mean_ret, decile) top_minus_bottom from r", "spearman_ret spearman_sharpe top_minus_bottom", "rising"),
    "long_only_monthly": sql_out(f"with {_RP},{_held(10, 'x')} select scenario_id, day, gross, members, dropped, turnover from x", "gross turnover", "dropped"),
    "long_short_spread": sql_out(f"with {_RP},{_held(10, 'x')},{_held(1, 'y')} select scenario_id, day, x.gross - y.gross gross, coalesce(x.turnover, 0) + coalesce(y.turnover, 0) turnover from x full join y using (scenario_id, day)", "gross turnover"),
    "cost_curve": sql_out(f"with {_RP},{_held(10, 'x')}, c as (select scenario_id, cast(b as double) bps, day, gross - turnover * b / 1e4 net from x, unnest([5.0, 10.0, 20.0]) u(b) where gross is not null), e as (select *, product(1 + net) over (partition by scenario_id, bps order by day) eq from c), f as (select *, eq / max(eq) over (partition by scenario_id, bps order by day) - 1 dd from e) select scenario_id, bps, count(*) periods, case when k then avg(net) end mean, case when k then avg(net) * 12 end ann_return, case when k then avg(net) / nullif(stddev_samp(net), 0) * sqrt(12) end sharpe, case when k and arg_max(eq, day) > 0 then pow(arg_max(eq, day), 12.0 / count(*)) - 1 end cagr, case when k then min(dd) end max_drawdown from (select *, count(*) over (partition by scenario_id, bps) >= 2 and stddev_samp(net) over (partition by scenario_id, bps) > 0 k from f) group by scenario_id, bps, k", "bps mean ann_return sharpe cagr max_drawdown"),
    "cheat_control": sql_out(f"with {_ic('ret', 'ret')} select scenario_id, day, ic, n, n_missing from ics", "ic"),
    "permutation_null": sql_out(f"with {_RP},{_null_sql()} select * from nul", "mean_ic", "rep"),
    "leak_audit": sql_out(
        f"with {_ic()},{_null_sql()}, ch as (with {_ic('ret', 'ret')} select avg(ic) c from ics), nu as (select avg(mean_ic) null_mean, stddev_samp(mean_ic) null_sd from nul) select (select avg(ic) from ics) real_ic, (select c from ch) cheat_ic, null_mean, null_sd, ((select avg(ic) from ics) - null_mean) / nullif(null_sd, 0) z from nu",
        "real_ic cheat_ic null_mean null_sd z",
    ),
    "ew_universe_benchmark": sql_out(f"with {_RP} select scenario_id, day, avg(ret) ret, count(*) n from rp where ret is not null group by all", "ret"),
    "status_counts": sql_out(f"with {_RP} select scenario_id, count(*) n, avg((fwd_status = 'delisted_partial')::int) delisting_rate from rp group by all", "delisting_rate"),
    "benchmark_period_returns": sql_out(f"with {SQL_BARS}, lv as (select d, avg(closeadj) l from bar group by d), r as (select * from lv where d in (select max(d) from lv group by date_trunc('month', d))) select d as day, l as level, lead(l) over (order by d) / nullif(l, 0) - 1 ret from r", "level ret"),
    "water_fill_weights": sql_out(f"with {_SIZED}, c as (select t, permaticker, greatest(0, least(0.03, 10 * coalesce(dv, 0) / 5e7)) cap from z), n as (select *, count(*) over (partition by t) n, row_number() over (partition by t order by cap, permaticker) r, sum(cap) over (partition by t order by cap, permaticker rows unbounded preceding) - cap below, sum(cap) over (partition by t) al from c), l as (select *, max(case when cap >= (1 - below) / (n - r + 1) then (1 - below) / (n - r + 1) end) over (partition by t) lv from n) select t, permaticker, case when al <= 1 then cap else least(cap, coalesce(lv, cap)) end weight from l", "weight", "permaticker"),
    "impact_cost": sql_out(f"with {_SIZED}, w as (select t, permaticker, case when cap < 50 then 'nano' when cap < 300 then 'micro' else 'liquid' end tier, dv from zz) select t, permaticker, tier, case tier when 'nano' then 150.0 when 'micro' then 50.0 else 10.0 end + 100 * sqrt(coalesce(1e4 / nullif(dv, 0), 0)) + 1 bps from w", "bps", "permaticker"),
}
