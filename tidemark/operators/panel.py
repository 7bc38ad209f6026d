"""Point-in-time cross-sections: one row per rebalance day and identity.

Trailing features are numbered by an identity's own bars; horizons (momentum anchors, forward
return) by the market calendar. The two numberings are never mixed. Only rebalance days are
restricted to a span; prices before and after it are still read.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_day, ratio
from ..session import staged
from .asof import asof_line
from .identity import attribute, current_bars, sole_owner_segments, usable_windows
from .rolling import trailing_figures


@dataclass(frozen=True)
class PanelParams:
    """Look-backs in rows or calendar positions (fixed values of the research design)."""

    skip: int = 21
    lookback: int = 252
    vol_rows: int = 252
    dollar_rows: int = 60
    horizon: int = 21


class AmbiguousIdentity(ValueError):
    """A key and day belong to more than one identity."""


def ambiguous_days(prices: DataFrame, windows: DataFrame, key: str = "ticker", day: str = "date") -> DataFrame:
    """Rows of ``prices`` per (key, day) that match more than one window row: key, day, matches (> 1)."""
    w = windows.select(F.col(key).alias("__k"), "first", "last")
    return (
        prices.join(w, (F.col(key) == F.col("__k")) & F.col(day).between(F.col("first"), F.col("last")))
        .groupBy(key, day)
        .agg(F.count(F.lit(1)).alias("matches"))
        .where("matches > 1")
    )


def assert_unambiguous(prices: DataFrame, windows: DataFrame, key: str = "ticker", day: str = "date") -> None:
    """Fails at once, not lazily, if any day is claimed twice."""
    bad = ambiguous_days(prices, windows, key, day).limit(3).collect()
    if bad:
        raise AmbiguousIdentity("; ".join(f"{r[key]} on {r[day]}: {r['matches']} matches" for r in bad))


def numbered_returns(bars: DataFrame) -> DataFrame:
    """Own-row number and daily simple return: + seq, ret. A zero previous close gives NULL."""
    own = Window.partitionBy("permaticker").orderBy("day")
    before = F.lag("closeadj").over(own)
    return bars.withColumns({"seq": F.row_number().over(own), "ret": ratio(F.col("closeadj"), before) - 1})


def calendar_of(bars: DataFrame) -> DataFrame:
    """Trade days with a dense number: day, idx. One row per day of the market, so one partition holds it."""
    return bars.select("day").distinct().withColumn("idx", F.row_number().over(Window.orderBy("day")))


def rebalance_days(cal: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Last trade day of each month, with the days ``skip``/``lookback`` before and ``horizon`` after it.

    A month that the data end in counts its last day too. Offsets are taken over the whole
    calendar before any day is left out.
    """
    last = cal.groupBy(F.trunc("day", "month").alias("month")).agg(F.max("day").alias("day"))
    if start:
        last = last.where(F.col("day") >= F.lit(start))
    if end:
        last = last.where(F.col("day") <= F.lit(end))
    return last.select("day")


def with_anchors(cal: DataFrame, p: PanelParams = PanelParams()) -> DataFrame:
    w = Window.orderBy("day")
    return cal.withColumns(
        {"day_skip": F.lag("day", p.skip).over(w), "day_back": F.lag("day", p.lookback).over(w), "day_fwd": F.lead("day", p.horizon).over(w)}
    )


def probe_grid(rebal: DataFrame, spans: DataFrame) -> DataFrame:
    """Rebalance days x identities alive: only days from an identity's first to its last bar are made.

    ``rebal`` holds one row per month, so it is small whatever the data; the product is cut to each
    identity's own span while it is made.
    """
    days = rebal.agg(F.sort_array(F.collect_list("day")).alias("__all"))
    grid = spans.crossJoin(F.broadcast(days))  # one row on the right
    alive = F.filter("__all", lambda d: (d >= F.col("first")) & (d <= F.col("last")))
    return grid.select("permaticker", F.explode(alive).alias("day"))


def momentum(c_skip: str = "c_skip", c_back: str = "c_back"):
    return ratio(F.col(c_skip), F.col(c_back)) - 1


def forward_label(df: DataFrame) -> DataFrame:
    """+ fwd_ret, fwd_status. Later rules win: ok, delisted_partial, incomplete_window, no_forward_price.

    Needs day, last (the identity's last day), day_fwd, close, c_fwd, d_fwd.
    """
    gone = F.coalesce(F.col("last") < F.col("day_fwd"), F.lit(False))
    status = (
        F.when(F.col("day_fwd").isNull(), "incomplete_window")
        .when(F.coalesce(F.col("d_fwd") == F.col("day"), F.lit(False)) & ~gone, "no_forward_price")
        .when(gone, "delisted_partial")
        .otherwise("ok")
    )
    ret = ratio(F.col("c_fwd"), F.col("close")) - 1
    return df.withColumn("fwd_status", status).withColumn("fwd_ret", F.when(F.col("fwd_status").isin("ok", "delisted_partial"), ret))


def build_panel(
    bars: DataFrame,
    caps: DataFrame,
    fund: DataFrame,
    meta: DataFrame,
    *,
    params: PanelParams = PanelParams(),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """The cross-section. ``bars`` (permaticker, day, closeadj, volume), ``caps`` (permaticker, day, marketcap),
    ``fund`` (permaticker, day, fund_id, eps, bvps, gp, assets), ``meta`` (permaticker, last, category, exchange).

    One row per rebalance day and identity that has a bar by then and is not past its last day.
    Facts are the latest known by the day, a whole row at a time. Bars and caps are unique in (permaticker, day); of
    several fundamentals known on a day the greatest fund_id stands.

    Bars, market values, fundamentals and the probes of all anchors are laid on one line per identity and carried
    forward together: one shuffle serves the eight look-ups. Trailing volatility and median dollar volume are made at
    the probes only.
    """
    bars = staged(numbered_returns(bars.where("closeadj is not null")).withColumn("dv", F.col("closeadj") * F.col("volume")))  # read for the line and for both figures
    cal = calendar_of(bars)
    rebal = rebalance_days(cal, start, end).join(F.broadcast(with_anchors(cal, params)), "day")  # a calendar: one row per trade day
    spans = bars.groupBy("permaticker").agg(F.min("day").alias("first")).join(meta.select("permaticker", "last"), "permaticker")
    stops = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("at")) for k, c in (("now", "day"), ("skip", "day_skip"), ("back", "day_back"), ("fwd", "day_fwd"))])
    probes = probe_grid(rebal.select("day"), spans).join(F.broadcast(rebal.select("day", "day_skip", "day_back", "day_fwd")), "day")
    probes = probes.select("permaticker", "day", "day_fwd", F.explode(stops).alias("s")).select("permaticker", "day", "day_fwd", "s.kind", "s.at")
    figures = ["eps", "bvps", "gp", "assets"]
    newest = fund.groupBy("permaticker", F.col("day").alias("at")).agg(F.max_by(F.struct(*figures), "fund_id").alias("f")).select("permaticker", "at", "f.*")
    facts = {
        "bar": bars.select("permaticker", F.col("day").alias("at"), "closeadj", "seq"),
        "cap": caps.where("marketcap is not null").select("permaticker", F.col("day").alias("at"), "marketcap"),
        "fund": newest,
    }
    seen = asof_line(probes, facts, "permaticker", "at")
    when = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    at = seen.groupBy("permaticker", "day").agg(
        when("now", "bar.closeadj").alias("close"), when("now", "bar.seq").alias("hist_days"), when("now", "cap.marketcap").alias("marketcap"),
        *[when("now", f"fund.{c}").alias(c) for c in figures],
        *[when(k, "bar.closeadj").alias(f"c_{k}") for k in ("skip", "back", "fwd")], when("fwd", "bar.at").alias("d_fwd"), F.max("day_fwd").alias("day_fwd"),
    )
    at = staged(at.where("close is not null"))  # the cross-section, far smaller than the bars; it is read twice below
    trail = trailing_figures(at.select("permaticker", "day", F.col("hist_days").alias("h")), bars.select("permaticker", "seq", "ret", "dv"), ["permaticker", "day"], "ret", params.vol_rows, "dv", params.dollar_rows)
    at = at.join(trail.withColumnsRenamed({"trail_std": "vol", "trail_median": "dollarvol"}), ["permaticker", "day"], "left").join(meta, "permaticker")
    out = forward_label(at.withColumn("mom", momentum()))
    keep = ["day", "permaticker", "close", "marketcap", "dollarvol", "hist_days", "mom", "vol", *figures, "category", "exchange", "fwd_ret", "fwd_status"]
    return out.select(*keep)


def panel_from_tables(prices: DataFrame, tickers: DataFrame, caps: DataFrame, fund: DataFrame, *, ambiguous: str = "raise", params: PanelParams = PanelParams(), start: date | None = None, end: date | None = None) -> DataFrame:
    """The cross-section from raw tables: ``prices`` (ticker, date, closeadj, volume, lastupdated), ``tickers`` (the
    master), ``caps`` (ticker, date, marketcap), ``fund`` (ticker, day, fund_id and figures of one dimension).

    A day that two windows of a ticker claim fails at once (``ambiguous='raise'``) or belongs to nobody ('drop').
    """
    windows = usable_windows(tickers, ["ticker", "permaticker"])
    if ambiguous == "raise":
        assert_unambiguous(prices, windows)
    seg = sole_owner_segments(windows)
    bars = current_bars(prices, tickers, ("closeadj", "volume"))
    valued = attribute(caps.where("marketcap is not null"), seg, "ticker", "date").groupBy("permaticker", F.col("date").alias("day")).agg(F.max("marketcap").alias("marketcap"))
    known = attribute(fund.where("day is not null"), seg, "ticker", "day").drop("ticker").distinct()
    master = tickers.select(F.col("permaticker").cast("long").alias("permaticker"), parse_day("firstpricedate").alias("first"), parse_day("lastpricedate").alias("last"), "category", "exchange")
    return build_panel(bars, valued, known, identity_meta(master.where("first <= last")), params=params, start=start, end=end)


def identity_meta(windows: DataFrame) -> DataFrame:
    """Latest master row per identity, chosen by its last day then by content: permaticker, last, category, exchange.

    ``windows`` must hold the readable last day as ``last`` beside permaticker, category, exchange.
    """
    best = F.struct("last", "category", "exchange")
    return windows.groupBy("permaticker").agg(F.max(best).alias("m")).select("permaticker", "m.*")
