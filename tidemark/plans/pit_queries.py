"""Queries of the point-in-time problems that are general (1, 4 and 5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canon_cik, day_text, no_nan, parse_day
from ..operators.bitemporal import locate
from ..operators.identity import attribute, current_bars, sole_owner_segments, usable_windows
from ..operators.periods import periods_and_gaps
from ..operators.rolling import rolling_totals, trailing_at
from ..session import staged, table

STALE_DAYS = 548  # fixed value: eighteen months


def known_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """ART rows with a readable datekey and an identity on that day: fund_id, permaticker, day, eps."""
    seg = sole_owner_segments(usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    f = (
        table(spark, d, "fundamentals")
        .where("dimension = 'ART' and fund_id is not null")
        .select("fund_id", "ticker", parse_day("datekey").alias("day"), no_nan("eps").alias("eps"))
    )
    return attribute(f.where("day is not null"), seg, "ticker", "day").distinct()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fund_t").select("event_id", "t", F.col("permaticker").cast("long").alias("permaticker"), no_nan("eps").alias("stored")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ev = staged(_events(spark, d))  # located twice, and measured before
    by_fund = locate(
        ev, known_fundamentals(spark, d), entity="permaticker", event_valid=F.col("t"), event_recorded=F.col("t"), valid="day", recorded="day", record="fund_id", carry=("eps",), how="left"
    )
    case = lambda cond, kind, rec: F.when(cond, F.struct(F.lit(kind).alias("kind"), rec.alias("record_id")))
    rec = F.col("record")
    cases = F.array_compact(F.array(case(rec.isNotNull(), "fundamentals", rec), case(~F.col("stored").eqNullSafe(F.col("eps")), "eps_wrong", F.coalesce(rec, F.lit(0)))))
    found = by_fund.where("event_id is not null").select("event_id", F.explode(cases).alias("c")).select("event_id", "c.*")
    filed = table(spark, d, "filings").where("not coalesce(is_amendment, false) and acceptance_date is not null and permaticker is not null")
    eve = F.date_sub("t", 1)
    by_filing = locate(
        ev.select("event_id", "permaticker", "t"),
        filed.select("filing_id", "permaticker", "acceptance_date"),
        entity="permaticker",
        event_valid=eve,
        event_recorded=eve,
        valid="acceptance_date",
        recorded="acceptance_date",
        record="filing_id",
        max_age=STALE_DAYS - 1,  # the point is the day before t
    )
    return found.unionByName(by_filing.select("event_id", F.lit("filings").alias("kind"), F.col("record").alias("record_id"))).distinct()


LOOK_BACK = 120


def p1_two_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of time: a row of fundamentals describes the world from its report period on and is known from its datekey on.

    Per event the row in force at t as known at t, the row in force LOOK_BACK days before as known at t (a restatement may
    have come since), and as known then. Late reports and restatements make the three differ, and differ from p1_found.
    """
    seg = sole_owner_segments(usable_windows(table(spark, d, "tickers"), ["ticker", "permaticker"]))
    f = table(spark, d, "fundamentals").where("dimension = 'ART' and fund_id is not null and reportperiod is not null")
    f = staged(attribute(f.select("fund_id", "ticker", "reportperiod", parse_day("datekey").alias("day")).where("day is not null"), seg, "ticker", "day").select("permaticker", "fund_id", "reportperiod", "day").distinct())
    ev = staged(_events(spark, d).where("event_id is not null").select("event_id", "permaticker", "t").distinct())
    now, then = F.col("t"), F.date_sub("t", LOOK_BACK)
    got = None
    for kind, v, r in (("now", now, now), ("then_known_now", then, now), ("then_known_then", then, then)):
        one = locate(ev, f, entity="permaticker", event_valid=v, event_recorded=r, valid="reportperiod", recorded="day", record="fund_id")
        one = one.select("event_id", F.lit(kind).alias("kind"), F.col("record").alias("record_id"), day_text("record_valid").alias("period"))
        got = one if got is None else got.unionByName(one)
    return got.distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # written once: both branches read it, and a lost executor does not bring back the price shuffle
    bars = staged(current_bars(table(spark, d, "sep_prices"), table(spark, d, "tickers")))
    roll = rolling_totals(bars, "permaticker", "day", "volume", (7, 30)).where("span_day >= 30 and sum_30 > 0")
    kind = F.when(F.col("sum_7") * 5 >= F.col("sum_30") * 4, "burst").when(F.col("sum_7") == 0, "dry")
    striking = roll.select("permaticker", "day", kind.alias("kind")).where("kind is not null")
    feats = table(spark, d, "feat_t").select("permaticker", "t", no_nan("vol_252").alias("vol_252"), no_nan("dollarvol_60").alias("dollarvol_60")).distinct()
    figures = trailing_at(
        feats, bars, "permaticker", "t", std_of="ret", std_rows=252, median_of=F.col("closeadj") * F.col("volume"), median_rows=60
    )
    off = lambda stored, true: F.when(F.abs(F.col(stored) - F.col(true)) > 0.01 * F.abs(F.col(true)), F.lit(stored))
    wrong = figures.select(
        F.col("permaticker").cast("long").alias("permaticker"),
        F.col("t").alias("day"),
        F.explode(F.array_compact(F.array(off("vol_252", "trail_std"), off("dollarvol_60", "trail_median")))).alias("kind"),
    )
    # striking days are unique by construction; only the figures can repeat
    return striking.unionByName(wrong.distinct()).select("permaticker", day_text("day").alias("cal_day"), "kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    span = lambda df, kind, entity: df.select(
        F.lit(kind).alias("entity_kind"), entity.alias("entity"), parse_day("firstpricedate").alias("first"), parse_day("lastpricedate").alias("last")
    )
    both = span(table(spark, d, "tickers"), "ticker", F.col("ticker")).unionByName(
        span(table(spark, d, "bridge"), "cik", F.nullif(canon_cik("cik"), F.lit("")))
    )
    out = periods_and_gaps(both, ["entity_kind", "entity"])
    return out.select("entity_kind", "entity", "piece", day_text("first_day").alias("first_day"), day_text("last_day").alias("last_day"))


QUERIES = {"p1_found": p1_found, "p1_two_axes": p1_two_axes, "p4_found": p4_found, "p5_found": p5_found}

_DAY = "try_cast(regexp_extract(trim({c}), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})([T ].*)?$', 1) as date)"


def sql_day(c: str) -> str:
    return _DAY.format(c=c)


SQL_OWNERS = f"""
win as (select distinct ticker, permaticker, {sql_day("firstpricedate")} a, {sql_day("lastpricedate")} b from tickers),
ok as (select * from win where a <= b and ticker is not null and permaticker is not null)"""

SQL_BARS = f"""{SQL_OWNERS},
owned as (
  select p.ticker, p.date, p.closeadj, p.volume, p.ret, p.lastupdated, min(o.permaticker) permaticker
  from (select distinct ticker, date, closeadj, volume, ret, lastupdated from sep_prices) p
  join ok o on o.ticker = p.ticker and p.date between o.a and o.b
  group by all having count(distinct o.permaticker) = 1),
bars as (
  select permaticker, cast(date as date) d, closeadj, volume, ret from owned
  qualify row_number() over (partition by permaticker, date order by lastupdated desc) = 1),
bar as (select * from bars where closeadj is not null)"""

P1_SQL = f"""
with {SQL_OWNERS},
ev as (select distinct event_id, cast(t as date) t, permaticker, eps from fund_t),
fd as (
  select f.fund_id, f.k, f.eps, min(o.permaticker) permaticker
  from (select distinct fund_id, ticker, {sql_day("datekey")} k, eps from fundamentals where dimension = 'ART') f
  join ok o on o.ticker = f.ticker and f.k between o.a and o.b
  group by all having count(distinct o.permaticker) = 1),
vf as (
  select ev.event_id, fd.fund_id, fd.eps from ev join fd on fd.permaticker = ev.permaticker and fd.k <= ev.t
  qualify row_number() over (partition by ev.event_id order by fd.k desc, fd.fund_id desc) = 1),
vg as (
  select ev.event_id, g.filing_id from ev
  join (select distinct filing_id, permaticker, cast(acceptance_date as date) a from filings where not is_amendment) g
    on g.permaticker = ev.permaticker and g.a < ev.t and g.a >= ev.t - 548
  qualify row_number() over (partition by ev.event_id order by g.a desc, g.filing_id desc) = 1)
select cast(event_id as bigint) event_id, 'fundamentals' kind, cast(fund_id as bigint) record_id from vf
union all select event_id, 'filings', filing_id from vg
union all select ev.event_id, 'eps_wrong', coalesce(vf.fund_id, 0) from ev left join vf using (event_id)
  where ev.eps is distinct from vf.eps
"""

P1_AXES_SQL = f"""
with {SQL_OWNERS},
ev as (select distinct event_id, cast(t as date) t, permaticker from fund_t),
fd as (
  select f.fund_id, f.k, f.v, min(o.permaticker) permaticker
  from (select distinct fund_id, ticker, {sql_day("datekey")} k, cast(reportperiod as date) v from fundamentals where dimension = 'ART' and reportperiod is not null) f
  join ok o on o.ticker = f.ticker and f.k between o.a and o.b
  group by all having count(distinct o.permaticker) = 1),
pt as (select event_id, permaticker, 'now' kind, t v, t r from ev union all select event_id, permaticker, 'then_known_now', t - 120, t from ev union all select event_id, permaticker, 'then_known_then', t - 120, t - 120 from ev)
select cast(event_id as bigint) event_id, kind, cast(fund_id as bigint) record_id, strftime(fd.v, '%Y-%m-%d') period from pt join fd on fd.permaticker = pt.permaticker and fd.k <= pt.r and fd.v <= pt.v
qualify row_number() over (partition by event_id, kind, pt.v, pt.r order by fd.v desc, fd.k desc, fd.fund_id desc) = 1
"""

P4_SQL = f"""
with {SQL_BARS},
span as (select permaticker, min(d) a, max(d) b from bar group by 1),
cal as (select permaticker, cast(unnest(generate_series(a, b, interval 1 day)) as date) d from span),
dense as (select c.permaticker, c.d, coalesce(b.volume, 0) v from cal c left join bar b on b.permaticker = c.permaticker and b.d = c.d),
roll as (
  select permaticker, d, row_number() over w n,
    sum(v) over (w rows 6 preceding) s7, sum(v) over (w rows 29 preceding) s30
  from dense window w as (partition by permaticker order by d)),
num as (select *, row_number() over (partition by permaticker order by d) n from bar),
ft as (select distinct permaticker, cast(t as date) t, vol_252, dollarvol_60 from feat_t),
seen as (
  select f.permaticker, f.t, f.vol_252, f.dollarvol_60, max(x.n) h from ft f
  join num x on x.permaticker = f.permaticker and x.d <= f.t group by all),
fig as (
  select a.permaticker, a.t, a.vol_252, a.dollarvol_60, stddev_samp(x.ret) sd,
    median(x.closeadj * x.volume) filter (where x.n > a.h - 60) md
  from seen a join num x on x.permaticker = a.permaticker and x.n between a.h - 251 and a.h group by all)
select cast(permaticker as bigint) permaticker, strftime(d, '%Y-%m-%d') cal_day, 'burst' kind from roll
  where n >= 30 and s30 > 0 and s7 * 5 >= s30 * 4
union all select permaticker, strftime(d, '%Y-%m-%d'), 'dry' from roll where n >= 30 and s30 > 0 and s7 = 0
union select permaticker, strftime(t, '%Y-%m-%d'), 'vol_252' from fig where abs(vol_252 - sd) > 0.01 * abs(sd)
union select permaticker, strftime(t, '%Y-%m-%d'), 'dollarvol_60' from fig where abs(dollarvol_60 - md) > 0.01 * abs(md)
"""

P5_SQL = f"""
with w as (
  select distinct 'ticker' k, ticker e, {sql_day("firstpricedate")} a, {sql_day("lastpricedate")} b from tickers
  union select distinct 'cik', regexp_replace(regexp_extract(trim(cik), '^(\\d+)(\\.0*)?$', 1), '^0+([0-9])', '\\1'),
    {sql_day("firstpricedate")}, {sql_day("lastpricedate")} from bridge),
u as (select * from w where a <= b and e is not null and e <> ''),
m as (select *, max(b) over (partition by k, e order by a, b rows between unbounded preceding and 1 preceding) r from u),
i as (select *, sum(case when r is null or a > r + 1 then 1 else 0 end) over (partition by k, e order by a, b rows unbounded preceding) g from m),
p as (select k, e, g, min(a) a, max(b) b from i group by all),
q as (select *, lead(a) over (partition by k, e order by a) nx from p)
select k entity_kind, e entity, 'period' piece, strftime(a, '%Y-%m-%d') first_day, strftime(b, '%Y-%m-%d') last_day from q
union all select k, e, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nx - 1, '%Y-%m-%d') from q where nx is not null
"""

SQL = {"p1_found": P1_SQL, "p1_two_axes": P1_AXES_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
