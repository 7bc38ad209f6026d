"""Trend weights, costs and backtests as registered queries.

The price grid: a ticker is a supplier's nation, its price the mean unit price of the nation's last SMOOTH days with line
items, carried forward - except ticker 0, left sparse so that missing bars stay in play.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import trend
from ..operators.asof import forward_fill_series
from ..operators.integrity import bar_check
from ..session import staged, table
from .common import out, sql_out
from .text_queries import bar_check_sql

N_CLASSES = 5
SMOOTH = 120  # rows; gives the moves of a traded price rather than those of single sales
CAP = 2.0
BARS = (-1.0, -0.26, -0.24, 0.4)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice", "l_quantity")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ticker"))
    sales = li.join(s, "l_suppkey").groupBy("ticker", "day").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit"))
    return sales.select("ticker", "day", F.avg("unit").over(trend.by_ticker().rowsBetween(-(SMOOTH - 1), 0)).alias("price"))


def _grid(spark, d):
    grid = trend.dense_grid(_raw(spark, d))
    carried = F.last("price", ignorenulls=True).over(trend.by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("price", F.when(F.col("ticker") == 0, F.col("price")).otherwise(carried))


def _signals(spark, d):
    return trend.signals(_grid(spark, d))


def _classes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("ticker"), F.col("n_regionkey").alias("class"))


def _parity(spark, d):
    return trend.risk_parity_weights(_signals(spark, d), _classes(spark, d), N_CLASSES)


def _weights(spark, d, lag=1):
    return trend.vol_target_ex_ante(_parity(spark, d), lag)


def _book(spark, d):
    return trend.daily_book(_weights(spark, d))


def _rates(spark, d):
    return _classes(spark, d).select("ticker", (F.lit(30.0) + F.col("class") * 25.0).alias("bps"))


def _rate(spark, d):
    """A monthly short rate: the mean discount, on the first ship day of its month."""
    li = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_discount")
    return li.groupBy(F.trunc("day", "month").alias("m")).agg(F.min("day").alias("day"), F.avg("l_discount").alias("rate")).select("day", "rate")


def _calendar(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()


def trend_score(spark, d):
    return out(_signals(spark, d).select("ticker", "day", "score"))


def rolling_vol(spark, d):
    return out(_signals(spark, d).select("ticker", "day", "ret", "vol"))


def unit_gross_weights(spark, d):
    return out(trend.unit_gross_weights(_signals(spark, d)).select("ticker", "day", "w"))


def riskparity_weights(spark, d):
    return out(_parity(spark, d).select("ticker", "day", "w"))


def weekly_hold(spark, d):
    return out(trend.weekly_hold(_parity(spark, d), "w").select("ticker", "day", "w"))


def voltarget_ex_ante(spark, d):
    return out(_weights(spark, d).select("ticker", "day", "w"))


def voltarget_realized(spark, d):
    return out(trend.vol_target_realized(_parity(spark, d)).select("ticker", "day", "w"))


def gross_cap(spark, d):
    return out(trend.cap_gross(_weights(spark, d), CAP).select("ticker", "day", "w"))


def backtest_daily(spark, d):
    return out(_book(spark, d))


def backtest_metrics(spark, d):
    return out(trend.book_metrics(_book(spark, d)))


def by_year(spark, d):
    return out(trend.by_year(_book(spark, d)))


def net_cash(spark, d):
    return out(trend.net_cash(_weights(spark, d)))


def borrow_cost(spark, d):
    return out(trend.borrow_cost(staged(_weights(spark, d)), _rates(spark, d)))


def rate_ffill(spark, d):
    return out(forward_fill_series(_calendar(spark, d), _rate(spark, d), "day", "rate"))


def _financing(spark, d, weights):
    legs = trend.rate_legs(forward_fill_series(_calendar(spark, d), _rate(spark, d), "day", "rate"))
    return trend.financing_cost(trend.net_cash(weights), legs)


def financing_cost(spark, d):
    return out(_financing(spark, d, staged(_weights(spark, d))))


def scenario_grid(spark, d):
    w = staged(_weights(spark, d))  # one set of weights serves every scenario
    got = trend.scenario_grid(trend.daily_book(w), trend.borrow_cost(w, _rates(spark, d)), _financing(spark, d, w), (1.0, 10.0), (0.0, 1.0, 10.0), (2.0, 200.0))
    return out(trend.verdict(got))


def total_extra_cost(spark, d):
    w = staged(_weights(spark, d))
    legs = trend.rate_legs(forward_fill_series(_calendar(spark, d), _rate(spark, d), "day", "rate"))
    return out(trend.total_extra_cost(w, _rates(spark, d), 3.0, legs))


def exposure_summary(spark, d):
    return out(trend.exposure_summary(_book(spark, d), CAP))


def rolling_sharpe(spark, d):
    return out(trend.rolling_sharpe(_book(spark, d)).select("day", "rolling_sharpe"))


def break_even_cost(spark, d):
    w = staged(_weights(spark, d))
    parts = staged(trend.daily_book(w)), staged(trend.borrow_cost(w, _rates(spark, d))), staged(trend.net_cash(w))
    got = trend.financing_break_even(*parts, BARS).withColumn("kind", F.lit("financing"))
    return out(got.unionByName(trend.turnover_break_even(*parts, BARS).withColumn("kind", F.lit("turnover_bps"))))


def capped_verdict(spark, d):
    """The five conditions for the book as it is, capped, and capped with its signs turned, at a lenient and the usual bar."""
    w, got = staged(_weights(spark, d)), None
    rate = forward_fill_series(_calendar(spark, d), _rate(spark, d), "day", "rate")
    capped = staged(trend.cap_gross(w, CAP))
    for book, held in (("open", w), ("capped", capped), ("turned", capped.withColumn("w", -F.col("w")))):
        row = trend.capped_verdict(held, _rates(spark, d), rate, CAP, (0.4, -0.2)).select(F.lit(book).alias("book"), "*")
        got = row if got is None else got.unionByName(row)
    return out(got)


def lag_leak_check(spark, d):
    parity = staged(_parity(spark, d))  # the weights before the lag, made once
    return out(trend.leak_check(lambda lag: trend.vol_target_ex_ante(parity, lag)))


def etf_integrity(spark, d):
    """The grid with a month a year missing for a fifth of the tickers."""
    holes = (F.col("ticker") % 5 == 1) & (F.month("day") == 3)
    return out(bar_check(_grid(spark, d).where(~holes), "ticker", "day", "price"))


QUERIES = {f.__name__: f for f in (
    trend_score, rolling_vol, unit_gross_weights, riskparity_weights, weekly_hold, voltarget_ex_ante, voltarget_realized, gross_cap, backtest_daily,
    backtest_metrics, by_year, net_cash, borrow_cost, rate_ffill, financing_cost, total_extra_cost, scenario_grid, exposure_summary, rolling_sharpe, break_even_cost, capped_verdict, lag_leak_check, etf_integrity,
)}

_RAW = """
sale as (select s_nationkey ticker, cast(l_shipdate as date) as day, sum(l_extendedprice) / sum(l_quantity) unit
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2),
raw as (select ticker, day, avg(unit) over (partition by ticker order by day rows 119 preceding) price from sale)"""
_SIG = f"""{_RAW},
cal as (select distinct day from raw), tk as (select distinct ticker from raw),
g0 as (select tk.ticker, cal.day, raw.price from tk cross join cal left join raw on raw.ticker = tk.ticker and raw.day = cal.day),
g as (select ticker, day, case when ticker = 0 then price else last_value(price ignore nulls) over (partition by ticker order by day rows unbounded preceding) end price from g0),
r as (select *, price / nullif(lag(price) over w, 0) - 1 ret, (sign(price / nullif(lag(price, 63) over w, 0) - 1) + sign(price / nullif(lag(price, 126) over w, 0) - 1)
  + sign(price / nullif(lag(price, 252) over w, 0) - 1)) / 3.0 score from g window w as (partition by ticker order by day)),
sg as (select *, case when count(ret) over w = 60 then greatest(0.05, stddev_samp(ret) over w * sqrt(252)) end vol
  from r window w as (partition by ticker order by day rows 59 preceding))"""
_PAR = f"""{_SIG},
pw as (select sg.*, n.n_regionkey c from sg join nation n on n.n_nationkey = sg.ticker),
par as (select ticker, day, ret, vol, coalesce(score / vol / nullif(sum(abs(score)) over (partition by day, c), 0) / 5.0, 0) w from pw)"""


def _weekly(src: str, dst: str, extra: str = "ret, vol") -> str:
    return f"""
{dst}_k as (select ticker, day + cast((12 - isodow(day)) % 7 as int) fri, arg_max(w, day) w from {src} group by 1, 2),
{dst} as (select s.ticker, s.day, {", ".join("s." + x.strip() for x in extra.split(","))}, coalesce(k.w, 0) w from {src} s
  left join {dst}_k k on k.ticker = s.ticker and k.fri = s.day - cast((isodow(s.day) + 2) % 7 as int))"""


def _lag(src: str, dst: str, k: int = 1) -> str:
    return f"{dst} as (select * replace (coalesce(lag(w, {k}) over (partition by ticker order by day), 0) as w) from {src})"


def _ex_ante(k: int = 1) -> str:
    return f"""{_PAR},
xr as (select *, sqrt(sum(pow(w * vol, 2)) over (partition by day)) risk from par),
xl as (select ticker, day, ret, vol, w * case when risk > 0 then least(0.15 / risk, 2.5) else 0 end w from xr),
{_weekly("xl", "xh")}, {_lag("xh", "xw", k)}"""


_EXA = _ex_ante()
_REAL = f"""{_PAR}, {_weekly("par", "rh")}, {_lag("rh", "rw")},
bk as (select day, sum(coalesce(w * ret, 0)) r from rw group by day),
bv as (select day, case when count(r) over w = 60 then stddev_samp(r) over w * sqrt(252) end v from bk window w as (order by day rows 59 preceding)),
bl as (select day, lag(v) over (order by day) v from bv),
rz as (select rw.ticker, rw.day, rw.w * case when v > 0 then least(0.15 / v, 2.5) else 0 end w from rw join bl on bl.day = rw.day)"""
_DAILY = """
mv as (select *, abs(w - coalesce(lag(w) over (partition by ticker order by day), 0)) m from xw),
b0 as (select day, sum(w * coalesce(ret, 0)) gross, sum(m) turnover, sum(abs(w)) exposure from mv group by day),
b1 as (select *, turnover * 2 / 1e4 cost, gross - turnover * 2 / 1e4 net from b0),
bo as (select *, product(1 + net) over (order by day rows unbounded preceding) equity from b1)"""
_BOOK = f"{_EXA},{_DAILY}"
_CASH = f"""{_EXA},
ca as (select day, sum(greatest(w, 0)) long, sum(greatest(-w, 0)) short from xw group by day),
cash as (select *, long + short gross, 1 + short - long cash from ca)"""
_BORROW = f"""bor as (select day, sum((30 + n_regionkey * 25.0) * greatest(-w, 0) / 1e4 / 252) borrow from xw join nation on n_nationkey = ticker group by day)"""
_RATE = """
rt as (select min(cast(l_shipdate as date)) as day, avg(l_discount) rate from lineitem group by date_trunc('month', l_shipdate)),
cl as (select distinct cast(l_shipdate as date) as day from lineitem),
rf as (select cl.day, rt.rate from cl asof join rt on cl.day >= rt.day)"""
_FIN = "fin as (select cash.day, (greatest(-cash, 0) * (rate + 0.01) - greatest(cash, 0) * greatest(rate - 0.0025, 0)) / 252 financing from cash join rf on rf.day = cash.day)"

_BASIS = f"{_BOOK}, {_BORROW}, ca as (select day, sum(greatest(w, 0)) long, sum(greatest(-w, 0)) short from xw group by day), cash as (select *, 1 + short - long cash from ca), {_RATE}, {_FIN}"


def _metrics(src: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    return f"""
m0 as (select *, coalesce(min(case when exposure > 0 then day end) over ({part}), min(day) over ({part})) f0 from {src}),
m1 as (select * , product(1 + net) over ({part} order by day rows unbounded preceding) eq,
  case when count(net) over y = 252 and stddev_samp(net) over y > 0 then avg(net) over y / stddev_samp(net) over y * sqrt(252) end roll
  from m0 where day >= f0 window y as ({part} order by day rows 251 preceding)),
m2 as (select *, eq / nullif(max(eq) over ({part} order by day rows unbounded preceding), 0) - 1 dd from m1),
met as (select {by + "," if by else ""} count(*) as days, round(count(*) / 252.0, 1) as years, avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(252) gross_sharpe, avg(net) * 252 ann_return, stddev_samp(net) * sqrt(252) ann_vol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) sharpe,
  min(dd) max_drawdown, avg(turnover) turnover, avg(exposure) exposure, avg(case when roll is not null then (roll > 0)::int end) rolling_positive from m2 {"group by " + by if by else ""})"""


SQL = {
    "trend_score": sql_out(f"with {_SIG} select ticker, day, score from sg", "score", "ticker"),
    "rolling_vol": sql_out(f"with {_SIG} select ticker, day, ret, vol from sg", "ret vol", "ticker"),
    "unit_gross_weights": sql_out(
        f"with {_SIG}, u0 as (select ticker, day, ret, vol, case when score * 0.1 / vol is not null then greatest(-1.5, least(1.5, score * 0.1 / vol)) end w from sg), u1 as (select ticker, day, ret, vol, coalesce(w / nullif(sum(abs(w)) over (partition by day), 0), 0) w from u0), {_weekly('u1', 'u2')}, {_lag('u2', 'u3')} select ticker, day, w from u3",
        "w",
        "ticker",
    ),
    "riskparity_weights": sql_out(f"with {_PAR} select ticker, day, w from par", "w", "ticker"),
    "weekly_hold": sql_out(f"with {_PAR}, {_weekly('par', 'h')} select ticker, day, w from h", "w", "ticker"),
    "voltarget_ex_ante": sql_out(f"with {_EXA} select ticker, day, w from xw", "w", "ticker"),
    "voltarget_realized": sql_out(f"with {_REAL} select ticker, day, w from rz", "w", "ticker"),
    "gross_cap": sql_out(f"with {_EXA} select ticker, day, w * case when sum(abs(w)) over (partition by day) > 2.0 then 2.0 / sum(abs(w)) over (partition by day) else 1 end w from xw", "w", "ticker"),
    "backtest_daily": sql_out(f"with {_BOOK} select day, gross, turnover, exposure, cost, net, equity from bo", "gross turnover exposure cost net equity"),
    "backtest_metrics": sql_out(f"with {_BOOK}, {_metrics('b1')} select * from met", "years ann_return ann_vol sharpe gross_sharpe max_drawdown turnover exposure rolling_positive"),
    "by_year": sql_out(f"with {_BOOK} select year(day) as year, product(1 + net) - 1 ret from b1 group by 1", "ret"),
    "net_cash": sql_out(f"with {_CASH} select * from cash", "long short gross cash"),
    "borrow_cost": sql_out(f"with {_EXA}, {_BORROW} select * from bor", "borrow"),
    "rate_ffill": sql_out(f"with {_RATE} select * from rf", "rate"),
    "financing_cost": sql_out(f"with {_CASH}, {_RATE}, {_FIN} select * from fin", "financing"),
    "scenario_grid": sql_out(
        f"with {_BASIS}, sc as (select b.day, b.gross, b.turnover, b.exposure, bx borrow_x, fx financing_x, bp bps, gross - turnover * bp / 1e4 - coalesce(borrow, 0) * bx - coalesce(financing, 0) * fx net from b0 b left join bor using (day) left join fin using (day), unnest([1.0, 10.0]) x(bx), unnest([0.0, 1.0, 10.0]) y(fx), unnest([2.0, 200.0]) z(bp)), {_metrics('sc', 'borrow_x, financing_x, bps')} select *, coalesce(sharpe >= 0.4 and rolling_positive > 0.5, false) passes from met",
        "borrow_x financing_x bps years ann_return ann_vol sharpe gross_sharpe max_drawdown turnover exposure rolling_positive",
    ),
    "total_extra_cost": sql_out(f"with {_BASIS} select fin.day, financing + 3 * borrow extra from fin join bor using (day)", "extra"),
    "rolling_sharpe": sql_out(f"with {_BOOK}, {_metrics('b1')} select day, roll rolling_sharpe from m1", "rolling_sharpe"),
    "break_even_cost": sql_out(
        f"""with {_BASIS}, fa as (select coalesce(min(case when exposure > 0 then day end), min(day)) f from b0),
k as (select b0.day, 'financing' kind, 1.0 top, gross - turnover * 2 / 1e4 - borrow a, greatest(-cash, 0) / 252 u from b0 join bor using (day) join cash using (day)
  union all select b0.day, 'turnover_bps', 500.0, gross - borrow - greatest(-cash, 0) * 0.04 / 252, turnover / 1e4 from b0 join bor using (day) join cash using (day)),
mo as (select kind, top, bar, bar / sqrt(252) q, avg(a) ma, avg(u) mu, var_samp(a) va, var_samp(u) vu, covar_samp(a, u) vc
  from k, fa, unnest([-1.0, -0.26, -0.24, 0.4]) t(bar) where day >= f group by all),
qu as (select *, mu * mu - q * q * vu qa, ma * mu - q * q * vc qb, ma * ma - q * q * va qc from mo),
ro as (select *, unnest([(qb - sqrt(greatest(qb * qb - qa * qc, 0))) / nullif(qa, 0), (qb + sqrt(greatest(qb * qb - qa * qc, 0))) / nullif(qa, 0)]) x from qu),
ok as (select kind, bar, min(x) x from ro where x between 0 and top and sign(ma - x * mu) = sign(q) group by all)
select mo.kind, mo.bar, case when ma / sqrt(va) < q then 0.0 when (ma - top * mu) / sqrt(va - 2 * top * vc + top * top * vu) > q then 'inf'::double else x end as cost from mo left join ok using (kind, bar)""",
        "bar cost",
    ),
    "capped_verdict": sql_out(
        f"""with {_EXA}, {_RATE}, cw as (select * replace (w * case when sum(abs(w)) over (partition by day) > 2.0 then 2.0 / sum(abs(w)) over (partition by day) else 1 end as w) from xw), tw as (select 'open' book, * from xw union all select 'capped', * from cw union all select 'turned', * replace (-w as w) from cw),
mv as (select *, abs(w - coalesce(lag(w) over (partition by book, ticker order by day), 0)) m from tw),
b0 as (select book, day, sum(w * coalesce(ret, 0)) gross, sum(m) turnover, sum(abs(w)) exposure, sum((30 + n_regionkey * 25.0) * greatest(-w, 0) / 1e4 / 252) borrow, 1 + sum(greatest(-w, 0)) - sum(greatest(w, 0)) cash
  from mv join nation on n_nationkey = ticker group by book, day),
sc as (select b0.*, c.condition, gross - turnover * 2 / 1e4 - borrow - case when c.sp is null then 0 else (greatest(-cash, 0) * (rate + c.sp) - case when c.cr then greatest(cash, 0) * greatest(rate - 0.0025, 0) else 0 end) / 252 end net
  from b0 join rf using (day), (values ('borrow_complete', null, false), ('measured_financing', 0.01, true), ('wide_spread', 0.02, true), ('zero_credit', 0.01, false)) c(condition, sp, cr)),
{_metrics('sc', 'book, condition')},
br as (select book, count(*) filter (where exposure > 2.0 + 1e-9) breaches from (select *, coalesce(min(case when exposure > 0 then day end) over (partition by book), min(day) over (partition by book)) f0 from b0) where day >= f0 group by book),
five as (select book, bar, condition, sharpe, rolling_positive, cast(null as bigint) breaches, coalesce(sharpe >= bar and rolling_positive > 0.5, false) passes from met, unnest([0.4, -0.2]) t(bar)
  union all select book, bar, 'gross_breach', null, null, breaches, breaches = 0 from br, unnest([0.4, -0.2]) t(bar))
select * from five union all select book, bar, 'overall', null, null, null, bool_and(passes) from five group by book, bar""",
        "bar sharpe rolling_positive",
    ),
    "exposure_summary": sql_out(f"with {_BOOK} select avg(exposure) mean, quantile_cont(exposure, 0.95) p95, max(exposure) max, avg((exposure > 2.0)::int) share_over from b1", "mean p95 max share_over"),
    "lag_leak_check": sql_out(" union all ".join(f"(with {_ex_ante(k)},{_DAILY}, {_metrics('b1')} select {k} lag, sharpe from met)" for k in (0, 1, 2)), "sharpe", "lag"),
    "etf_integrity": bar_check_sql(f"{_RAW}, cal as (select distinct day from raw), tk as (select distinct ticker from raw), g0 as (select tk.ticker, cal.day, raw.price from tk cross join cal left join raw on raw.ticker = tk.ticker and raw.day = cal.day), dy as (select ticker, day, case when ticker = 0 then price else last_value(price ignore nulls) over (partition by ticker order by day rows unbounded preceding) end price from g0 qualify not (ticker % 5 = 1 and month(day) = 3))", "ticker bad_prices gaps big_moves"),
}
