"""Factors, harness, trend, book, filings and audit: small cases worked by hand and independent second versions."""

from __future__ import annotations

import hashlib
import html
import random
import re
from datetime import date
from math import lgamma

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.scalars import acceptance_date, cik_from_url, clip, number, present
from tidemark.operators import audit, book, factors, filings, filters, harness, integrity, panel, trend
from tidemark.plans import more_queries, panel_queries, text_queries
from tidemark.schemas import MissingColumns

from .conftest import day


def test_scalars(spark):
    df = spark.createDataFrame([("0.5", 1.0), ("<UNKNOWN>", None), ("nan", float("nan")), ("inf", 9.0), (None, -9.0)], "s string, x double")
    got = df.select(number("s").alias("n"), clip(F.col("x"), -1, 1).alias("c"), present("s").alias("p")).collect()
    assert [r.n for r in got] == [0.5, None, None, None, None]
    assert [r.c for r in got][:2] == [1.0, None] and [r.p for r in got] == [True, True, False, True, False]
    u = spark.createDataFrame([("x?CIK=0000123&a",), ("none",)], "u string").select(cik_from_url("u")).collect()
    assert [r[0] for r in u] == ["123", None]
    a = spark.createDataFrame([("2013-08-02T08:56:55.000Z",), ("2013-99-02",), ("x",), (None,)], "t string").select(acceptance_date("t")).collect()
    assert [r[0] for r in a] == [date(2013, 8, 2), None, None, None]


BANDS = [(1, 150, 1_000_000, 10), (2, 40, 800_000, 8), (3, 500, 6_000_000, 20), (4, 150, 100_000, 10), (5, 150, 1_000_000, 3), (6, 8, 900_000, 12), (7, 20000, 50_000_000, 100), (8, 250, 400_000, 6)]


def test_bands(spark):
    df = spark.createDataFrame([(i, float(m), float(v), float(p), 300) for i, m, v, p in BANDS] + [(9, None, 1e6, 10.0, 300)], "id int, mktcap double, dollarvol double, price double, hist int")
    micro = factors.Band("micro", {"mktcap": (50.0, 300.0), "dollarvol": (250e3, None), "price": (5.0, None)})
    ok = lambda b: {r.id for r in factors.screen(df, b).where("eligible").collect()}
    assert ok(micro) == {1, 8} and ok(micro.with_floors(dollarvol=100e3, price=2.0)) == {1, 4, 5, 8}
    grid = factors.screen_grid(df, [micro, factors.Band("nano", {"mktcap": (10.0, 50.0), "dollarvol": (250e3, None), "price": (5.0, None)})])
    assert {(r.band, r.id) for r in grid.where("eligible").collect()} == {("micro", 1), ("micro", 8), ("nano", 2)}
    assert factors.screen(df, micro).where("eligible is null").count() == 0
    with pytest.raises(MissingColumns):
        factors.screen(df.drop("price"), micro)


def test_winsor_z_equals_pandas(spark):
    rng = np.random.default_rng(3)
    x = np.append(rng.normal(size=40), [30.0, np.nan])
    rows = [("a", float(v) if v == v else None) for v in x] + [("flat", 0.1)] * 7 + [("none", None)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    got = factors.winsor_z({"z": F.col("x")}, Window.partitionBy("g"))(df).toPandas()
    v = x[:-1]
    m, s = v.mean(), v.std()
    c = np.clip(v, m - 3 * s, m + 3 * s)
    want = (c - c.mean()) / c.std()
    a = got[got.g == "a"].sort_values("x")["z"].to_numpy()
    assert np.allclose(a[:-1], np.sort(want)) and np.isnan(a[-1])
    assert (got[got.g == "flat"]["z"] == 0).all() and got[got.g == "none"]["z"].isna().all()


def test_deciles_equal_rank_quantiles(spark):
    rows = [(n, i, float(i)) for n in (5, 10, 11, 23, 37, 60) for i in range(n)]
    got = factors.deciles(spark.createDataFrame(rows, "n int, i int, s double"), ["n"], "s", "i").toPandas()
    for n, g in got.groupby("n"):
        g = g.sort_values("i")
        if n < 10:
            assert g["decile"].isna().all()
        else:
            want = pd.qcut(g["s"].rank(method="first"), 10, labels=False) + 1
            assert (g["decile"].to_numpy() == want.to_numpy()).all()


def test_rank_correlation_and_significance(spark):
    rng = np.random.default_rng(5)
    rows = [("t", float(rng.integers(6)), float(rng.integers(6))) for _ in range(50)] + [("t", None, 1.0), ("t", float("nan"), 1.0)]
    rows += [("flat", 1.0, float(i)) for i in range(9)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)]
    got = {r.g: r for r in harness.spearman_by(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    f = pd.DataFrame([r for r in rows if r[0] == "t"], columns=list("gxy")).dropna()
    assert got["t"].ic == pytest.approx(f["x"].rank().corr(f["y"].rank())) and got["t"].n == 50 and got["t"].n_missing == 2
    assert got["flat"].ic is None and got["few"].ic is None
    x = rng.normal(0.3, 1, 66)
    nw = harness.newey_west(spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "d date, v double"), "d", "v").first()
    assert nw.t_stat == pytest.approx(harness.newey_west_exact(x)) and nw.lags == harness.default_lags(66) == 3
    for rho, n in ((0.5, 20), (-0.03, 800), (0.9, 5)):
        t = np.linspace(0, abs(rho) * np.sqrt((n - 2) / (1 - rho**2)), 200_001)
        density = (1 + t**2 / (n - 2)) ** (-(n - 1) / 2)
        scale = np.exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / np.sqrt((n - 2) * np.pi)
        assert audit.correlation_p(rho, n) == pytest.approx(1 - 2 * scale * np.trapezoid(density, t), abs=1e-9)


def test_portfolio_turnover_and_drawdown(spark):
    rows = [(day(0), 1, 10, 0.1), (day(0), 2, 10, None), (day(30), 2, 10, 0.2), (day(30), 3, 10, -0.4), (day(60), 9, 1, 0.5), (day(90), 2, 10, 0.3)]
    got = harness.portfolio_periods(spark.createDataFrame(rows, "d date, i int, decile int, r double"), [], "d", "i", "r", F.col("decile") == 10).orderBy("d").collect()
    assert [(r.members, r.dropped, round(r.turnover, 9)) for r in got] == [(2, 1, 1.0), (2, 0, 1.0), (1, 0, 1.0)]
    assert [round(r.gross, 9) for r in got] == [0.1, -0.1, 0.3]
    p = spark.createDataFrame([(day(i), v) for i, v in enumerate([-0.5, 0.2, -0.1])], "d date, net double")
    m = harness.curve_metrics(p, [], "d", F.col("net")).first()
    assert m.max_drawdown == pytest.approx(-0.1) and m.cagr == pytest.approx((0.5 * 1.2 * 0.9) ** 4 - 1)


def test_planted_signal_cheat_and_null(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(12):
        s = rng.normal(size=60)
        rows += [(day(30 * d), i, float(s[i]), float(0.4 * s[i] + rng.normal())) for i in range(60)]
    a = harness.leak_audit(spark.createDataFrame(rows, "d date, i int, s double, r double"), ["d"], "i", "s", "r", reps=8).first()
    assert a.cheat_ic == pytest.approx(1.0) and a.real_ic > 0.2 and abs(a.null_mean) < 0.05 and a.z > 4


def test_null_has_the_spread_of_shuffled_scores(spark):
    """Mean 0 and variance 1 / (n - 1) a group, as for shuffles of any scores; here against shuffles themselves."""
    rng = np.random.default_rng(3)
    rows = [(g, i, float(rng.integers(4)), float(rng.normal())) for g in range(20) for i in range(15)]
    null = harness.permutation_null(spark.createDataFrame(rows, "g int, i int, s double, r double"), ["g"], "i", "s", "r", reps=150).toPandas()["mean_ic"]
    frame = pd.DataFrame(rows, columns=["g", "i", "s", "r"])
    shuffled = [np.mean([np.corrcoef(rng.permutation(x["s"].rank()), x["r"].rank())[0, 1] for _, x in frame.groupby("g")]) for _ in range(150)]
    assert abs(null.mean()) < 0.02 and 0.8 < null.std() / np.std(shuffled, ddof=1) < 1.25
    assert abs(np.corrcoef(null[1:], null[:-1])[0, 1]) < 0.25  # repetitions do not follow one another


def test_verdicts(spark):
    c = lambda *r: audit.extractor_verdict(spark.createDataFrame([(x,) for x in r], "spearman double")).first()
    assert [c(0.9, 0.8).verdict, c(0.9, 0.4, 0.9).verdict, c(0.4, 0.3).verdict, c(0.9, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1).verdict, c(None).verdict] == ["tracks", "mixed", "diverges", "diverges", None]
    grid = spark.createDataFrame([("a", 1e6, 1.0, 0.9), ("a", 2e6, 1.0, 0.7), ("a", 1e6, 2.0, 0.6), ("b", 1e6, 1.0, 0.3), ("b", 1e6, 2.0, -5.0)], "name string, aum double, cost_scale double, sharpe double")
    s = spark.createDataFrame([("a", 0.02, 0.9), ("b", None, None)], "band string, mean_ic double, spearman_sharpe double")
    won = harness.decision(grid, s, "a", "b").first()
    assert won.qualifies and won.margin_1x == pytest.approx(0.5) and won.margin_2x == pytest.approx(0.3)
    lost = harness.decision(grid, s, "b", "a").first()
    assert not (lost.qualifies or lost.ic_ok or lost.monotone_ok or lost.margin_ok)


def test_hold_out_and_ambiguous_tables_are_refused(spark):
    with pytest.raises(filters.HoldOutRefused):
        filters.guard_span(date(2020, 1, 1), date(2021, 6, 1), date(2021, 1, 1))
    assert filters.guard_span(date(2020, 1, 1), date(2021, 6, 1), date(2021, 1, 1), confirmed=True)[0] == date(2020, 1, 1)
    t = spark.createDataFrame([(1, "DUP", "2019-01-01", "2021-12-31", "c", "x"), (2, "DUP", "2020-01-05", "2020-12-31", "c", "x")], "permaticker int, ticker string, firstpricedate string, lastpricedate string, category string, exchange string")
    p = spark.createDataFrame([("DUP", day(k), 10.0 + k, 5.0, day(k)) for k in range(40)], "ticker string, date date, closeadj double, volume double, lastupdated date")
    caps = p.select("ticker", "date", F.col("closeadj").alias("marketcap"))
    fund = spark.createDataFrame([], "fund_id long, ticker string, day date, eps double, bvps double, gp double, assets double")
    with pytest.raises(panel.AmbiguousIdentity, match="DUP"):
        panel.panel_from_tables(p, t, caps, fund)
    got = panel.panel_from_tables(p, t, caps, fund, ambiguous="drop").collect()
    assert {r.permaticker for r in got} == {1} and [(r.hist_days, r.close, r.marketcap, r.eps) for r in got][0] == (4, 13.0, 13.0, None)


def test_registered_null_draws_in_full(spark):
    rng = np.random.default_rng(5)
    rows = [(1, day(30 * d), i, float(s), 5.0, float(0.3 * s + rng.normal()), "ok") for d in range(3) for i, s in enumerate(rng.normal(size=30))]
    p = spark.createDataFrame(rows, "scenario_id int, day date, permaticker int, composite double, decile double, ret double, fwd_status string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(panel_queries, "_rank_panel", lambda spark, d: p)
        null = panel_queries.permutation_null(spark, "").toPandas()
        a = panel_queries.leak_audit(spark, "").first()
    assert sorted(null["rep"]) == list(range(25)) and null["mean_ic"].nunique() == 25
    assert (a.null_mean, a.null_sd) == (pytest.approx(null["mean_ic"].mean(), abs=2e-6), pytest.approx(null["mean_ic"].std(), abs=2e-6))


def test_label_rules(spark):
    t = day(0)
    rows = [(1, t, date(2021, 1, 1), None, 10.0, None, None), (2, t, date(2021, 1, 1), day(30), 10.0, 11.0, day(29)), (3, t, day(20), day(30), 10.0, 4.0, day(20)), (4, t, date(2021, 1, 1), day(30), 10.0, 10.0, t), (5, t, t, day(30), 10.0, 10.0, t)]
    got = {r.i: (r.fwd_status, r.fwd_ret) for r in panel.forward_label(spark.createDataFrame(rows, "i int, day date, last date, day_fwd date, close double, c_fwd double, d_fwd date")).collect()}
    assert got[1] == ("incomplete_window", None) and got[4] == ("no_forward_price", None)
    assert got[2] == ("ok", pytest.approx(0.1)) and got[3] == ("delisted_partial", pytest.approx(-0.6)) and got[5] == ("delisted_partial", 0.0)


def test_ambiguous_identity_fails_at_once(spark):
    w = spark.createDataFrame([("DUP", 1, day(0), day(300)), ("DUP", 2, day(150), day(300))], "ticker string, permaticker int, first date, last date")
    p = spark.createDataFrame([("DUP", day(10)), ("DUP", day(200))], "ticker string, date date")
    with pytest.raises(panel.AmbiguousIdentity, match="DUP"):
        panel.assert_unambiguous(p, w)
    panel.assert_unambiguous(p.where(F.col("date") == day(10)), w)


def grid_of(spark, prices):
    days = pd.bdate_range("2020-01-01", periods=len(next(iter(prices.values()))))
    rows = [(t, d.date(), float(p)) for t, ps in prices.items() for d, p in zip(days, ps, strict=True) if p is not None]
    return trend.dense_grid(spark.createDataFrame(rows, "ticker string, day date, price double")), days


def test_trend_block_equals_wide_form(spark):
    rng = np.random.default_rng(8)
    wide = {t: list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))) for t in "ABC"}
    wide["C"][20] = None
    grid, days = grid_of(spark, wide)
    look, win = (3, 5, 8), 10
    w = trend.unit_gross_weights(trend.signals(grid, look, win))
    got = trend.daily_book(w).orderBy("day").toPandas()
    px = pd.DataFrame(wide, index=days).astype(float)
    ret = px.pct_change(fill_method=None)
    score = sum(np.sign(px / px.shift(n) - 1) for n in look) / 3
    vol = (ret.rolling(win).std() * np.sqrt(252)).clip(lower=0.05)
    raw = (score * 0.10 / vol).clip(-1.5, 1.5)
    raw = raw.div(raw.abs().sum(axis=1).replace(0, np.nan), axis=0).fillna(0)
    held = raw.resample("W-FRI").last().reindex(days, method="ffill").shift(1).fillna(0)
    gross = (held * ret.fillna(0)).sum(axis=1)
    turn = held.diff().abs().sum(axis=1)
    turn.iloc[0] = held.iloc[0].abs().sum()
    assert np.allclose(got["gross"], gross) and np.allclose(got["turnover"], turn) and got["exposure"].max() == pytest.approx(1.0)
    assert np.allclose(got["equity"], (1 + gross - turn * 2 / 1e4).cumprod())


def test_costs_by_hand(spark):
    w = spark.createDataFrame([("A", day(0), 1.5, 0.01), ("B", day(0), -0.5, 0.02), ("A", day(1), 0.5, 0.0), ("B", day(1), 0.0, 0.0)], "ticker string, day date, w double, ret double")
    cash = {r.day: r for r in trend.net_cash(w).collect()}
    assert cash[day(0)].cash == 0.0 and cash[day(1)].cash == 0.5 and cash[day(0)].gross == 2.0
    rates = spark.createDataFrame([("A", 30.0), ("B", 50.0)], "ticker string, bps double")
    assert {r.day: r.borrow for r in trend.borrow_cost(w, rates, 2.0).collect()}[day(0)] == pytest.approx(0.5 * 50 * 2 / 1e4 / 252)
    with pytest.raises(ValueError, match="B"):
        trend.borrow_cost(w, rates.where("ticker = 'A'"))
    legs = trend.rate_legs(spark.createDataFrame([(day(0), 0.05), (day(1), 0.001)], "day date, rate double"))
    fin = {r.day: r.financing for r in trend.financing_cost(trend.net_cash(w), legs).collect()}
    assert fin[day(0)] == 0.0 and fin[day(1)] == 0.0
    with pytest.raises(ValueError):
        trend.financing_cost(trend.net_cash(w), legs.limit(1))
    capped = {(r.ticker, r.day): r.w for r in trend.cap_gross(w, 1.0).collect()}
    assert capped[("A", day(0))] == pytest.approx(0.75) and capped[("A", day(1))] == 0.5
    with pytest.raises(ValueError):
        trend.cap_gross(w, 0)
    assert trend.first_active(w).first().day == day(0)
    total = {r.day: r.extra for r in trend.total_extra_cost(w, rates, 2.0, legs).collect()}
    assert total[day(0)] == pytest.approx(0.5 * 50 * 2 / 1e4 / 252) and total[day(1)] == 0.0
    assert {r.extra for r in trend.total_extra_cost(w).collect()} == {0.0}


def test_break_even_is_where_the_ratio_meets_the_bar(spark):
    rng = np.random.default_rng(5)
    net, unit = rng.normal(0.002, 0.01, 400), rng.uniform(0, 1 / 252, 400)
    df = spark.createDataFrame([(day(i), 1.0, float(a), float(b)) for i, (a, b) in enumerate(zip(net, unit))], "day date, exposure double, net double, unit double")
    ratio = lambda x: (net - x * unit).mean() / (net - x * unit).std(ddof=1) * np.sqrt(252)
    got = {r.bar: r.cost for r in trend.break_even(df, 5.0, (0.4, 1.0, 50.0, -90.0)).collect()}
    assert ratio(got[0.4]) == pytest.approx(0.4) and ratio(got[1.0]) == pytest.approx(1.0)
    assert got[50.0] == 0.0 and got[-90.0] == float("inf")
    assert trend.break_even(df.withColumn("net", F.lit(0.0)).withColumn("unit", F.lit(0.0)), 1.0).first().cost is None
    assert trend.break_even(df.limit(0), 1.0).first().cost is None


@pytest.mark.parametrize(("vols", "want"), [([5e6] * 50, 0.02), ([5e6] * 20, 0.03), ([2000.0] * 20, 0.02), ([1e12], 0.03)])
def test_water_fill_of_equal_names(spark, vols, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vols)], "g int, i int, v double")
    got = [r.weight for r in book.water_fill(df, ["g"], "i", "v", F.lit(1e6)).collect()]
    assert got == pytest.approx([want] * len(vols))


def iterative(caps):
    w, free = np.zeros(len(caps)), np.ones(len(caps), bool)
    left = min(1.0, caps.sum())
    while left > 1e-15 and free.any():
        add = np.minimum(left / free.sum(), caps - w) * free
        w, left = w + add, left - add.sum()
        free &= w < caps - 1e-15
    return w


def test_water_fill_equals_pouring(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v)) for g in range(12) for i, v in enumerate(rng.choice([0.0, 1e3, 2e3, 5e3, 1e7], rng.integers(3, 120)))] + [(0, 500, None)]
    got = book.water_fill(spark.createDataFrame(rows, "g int, i int, v double"), ["g"], "i", "v", F.lit(1e6)).toPandas()
    for _, g in got.groupby("g"):
        caps = np.clip(10 * g["v"].fillna(0).to_numpy() / 1e6, 0, 0.03)
        assert np.allclose(g["weight"], iterative(caps)) and np.allclose(book.fill_exact(caps), iterative(caps))


def test_book_fold(spark):
    schema = "day date, item long, decile double, composite double, ret double, dollarvol double, marketcap double"
    rows = []
    for k in range(3):
        rows += [(day(30 * k), i, 10.0 if i < 11 else 5.0, float(i), (-0.9 if i == 0 else 0.0) if k == 0 else 0.0, 1e9, 1000.0) for i in range(12) if not (i == 0 and k)]
    got = book.buffered_book(spark.createDataFrame(rows, schema), p=book.BookParams(max_weight=1.0)).orderBy("day").collect()
    assert got[0].gross == pytest.approx(-0.9 / 11) and got[0].held == 11 and [r.rebalanced for r in got] == [True, False, False]
    assert got[1].gross == 0.0 and got[1].missing == 1 and got[0].turnover == pytest.approx(1.0)
    assert book.book_diagnostics(book.buffered_book(spark.createDataFrame(rows, schema))).first().months == 3


def test_cost_tiers(spark):
    df = spark.createDataFrame([(30.0,), (150.0,), (1000.0,), (None,)], "m double").withColumn("t", book.size_tier(F.col("m")))
    assert [r.t for r in df.collect()] == ["nano", "micro", "liquid", "liquid"]
    bps = df.select(book.side_cost_bps(F.lit(0.04), book.half_spread(F.col("t")), 2.0)).collect()
    assert [r[0] for r in bps] == [342.0, 142.0, 62.0, 62.0]


def test_manifest_to_rows(spark):
    rows = [("7", ["10-K", "10-K/A", "8-K", "10-Q", "4"], ["a-1", "a-2", "a-3", "a-4", "a-5"], ["2010-01-02T00:00:00Z", "2010-01-02T00:00:00Z"])]
    m = spark.createDataFrame(rows, "cik string, form array<string>, accessionNumber array<string>, acceptanceDateTime array<string>")
    flat = filings.flatten_manifest(m, "cik", {"form": "form", "accessionNumber": "accession", "acceptanceDateTime": "acceptance_datetime"})
    assert flat.count() == 5 and flat.where("acceptance_datetime is null").count() == 3
    kept = filings.assemble([flat, flat.withColumn("form", F.lit("10-Q"))])
    assert {r.accession: r.form for r in kept.collect()} == {"a-1": "10-K", "a-4": "10-Q"}
    plan = filings.fetch_plan(spark.createDataFrame([("7", "0-1-2", "x.HTM"), ("7", "0-1-3", None)], "cik string, accession string, primary_document string")).collect()
    assert [len(r.urls) for r in plan] == [2, 1] and plan[0].urls[0].endswith("/012/x.HTM")


def test_attribution_by_window(spark):
    ddl = "permaticker string, cik string, firstpricedate string, lastpricedate string"
    b = filings.prepared_bridge(spark.createDataFrame([("A", "0042", "2000-01-01", "2008-10-15"), ("B", "42.0", "2018-06-01", "2025-01-01"), ("C", "nan", "2000-01-01", "2025-01-01")], ddl))
    f = spark.createDataFrame([("42", "x", date(2005, 1, 1)), ("42", "y", date(2020, 1, 1)), ("42", "z", date(2012, 1, 1)), ("99", "w", date(2012, 1, 1))], "cik string, accession string, acceptance_date date")
    got = filings.attribute_filings(f, b)
    assert {r.accession: r.owner for r in got.collect()} == {"x": "A", "y": "B"}
    assert tuple(filings.attribution_stats(f, b, got).first()) == (4, 1, 2, 1)
    two = filings.prepared_bridge(spark.createDataFrame([("A", "42", "2000-01-01", "2010-01-01"), ("B", "42", "2005-01-01", "2015-01-01")], ddl))
    clash = f.withColumn("acceptance_date", F.lit(date(2007, 1, 1)))
    with pytest.raises(filings.AmbiguousFiling):
        filings.attribute_filings(clash, two)
    assert filings.attribute_filings(clash, two, policy="drop").count() == 0 and filings.attribute_filings(clash, two, policy="all").count() == 6


LONG = "Sales grew because demand was firm. " * 12


def found(spark, raw, form, is_html):
    df = spark.createDataFrame([(raw, form, is_html)], "raw string, form string, h boolean").select("form", tx.rendered("raw", F.col("form"), F.col("h")).alias("plain"))
    return df.select(*[c.alias(k) for k, c in tx.sections(F.col("plain"), F.col("form")).items()]).first().asDict()


def test_sections_of_a_page_with_contents(spark):
    toc = "".join(f"<p>Item {n}</p>" for n in ("1A. Risk Factors", "1B.", "7. Management&#8217;s Discussion", "7A.", "8."))
    raw = f"<script>x=1</script>{toc}<p>Item 1A. Risk Factors</p><p>{LONG} risk, see Item 8 there.</p><p>Item 1B.</p><p>none</p><p>Item 7. Management&#8217;s Discussion</p><p>{LONG}</p><p>Item 8. Tables</p><p>numbers</p>"
    got = found(spark, raw, "10-K", True)
    assert got["mdna"].count("Sales grew") == 12 and "numbers" not in got["mdna"] and "see Item 8 there" in got["risk_factors"]
    sgml = f"<DOCUMENT><TYPE>EX-1<TEXT>{'z ' * 5000}</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K\n<TEXT>\nItem 7. Management's view\n{LONG}\nItem 8.\nno\n</TEXT></DOCUMENT>"
    got = found(spark, sgml, "10-K/A", False)
    assert got["mdna"] and "zz" not in got["mdna"] and got["risk_factors"] is None
    assert found(spark, sgml.replace("<TYPE>10-K", "<TYPE>10-K/A"), "10-K", False)["mdna"] == got["mdna"]
    assert found(spark, "Item 7. Management's short\nItem 8.", "10-K", False)["mdna"] is None
    assert found(spark, None, None, None) == {"mdna": None, "risk_factors": None} and found(spark, "", "10-Q", True)["mdna"] is None


def test_rendering_equals_a_second_version(spark):
    """Against Python's own white space and references, on texts made of awkward pieces; and very long ones end."""
    pieces = ["a", " ", "\t", "\n", "\r", "&amp;", "&#8217;", "\u00a0", "\u2014", "<b>", "</p>", "&nbsp;", "x < y", "\x0b", "\u00e9"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(300)]
    long = ["\n" * 300_000 + "end", " \n\t" * 200_000 + "<p>z", "<" * 2_000, "word " * 200_000]

    def second(t: str) -> str:
        t = html.unescape(re.sub(r"<[^>]+>", "\n", t)).translate(tx.PLAIN).replace("\r", "\n")
        lines = [re.sub("[ \t]+", " ", x).lstrip(" ") if k else re.sub("[ \t]+", " ", x) for k, x in enumerate(t.split("\n"))]
        out = "\n".join(lines)
        while "\n\n\n" in out:
            out = out.replace("\n\n\n", "\n\n")
        return out.strip()

    df = spark.createDataFrame(list(enumerate(texts + long)), "i int, t string").select("i", tx.html_to_text("t").alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert all(got[i] == second(t) for i, t in enumerate(texts))
    assert got[300] == "end" and got[301] == "z" and len(got[303]) == 999_999


QUARTER = f"Item 1A. Risk Factors\n{LONG}quarter risk\nItem 2. Management's Discussion\n{LONG}quarter view\nItem 3. Market risk\nno"
ANNUAL = f"Item 1A. Risk Factors\n{LONG}annual risk\nItem 1B.\nno\nItem 7. Management's Discussion\n{LONG}annual view\nItem 8. Tables\nno"


@pytest.fixture(scope="module")
def both_forms(spark, tmp_path_factory):
    """A documents table with 10-Qs and 10-Ks under several spellings of their sources."""
    at = tmp_path_factory.mktemp("forms")
    sources = [("filing_10q", QUARTER), ("filing-10q", QUARTER), ("Filing_10Q", QUARTER), (" FILING_10-Q", QUARTER), ("filing_10k", ANNUAL), ("filing-10k", ANNUAL), (None, ANNUAL), ("press_wire", "No items here."), ("filing_10k", None)]
    rows = [(k, text, source, "7", day(k)) for k, (source, text) in enumerate(sources)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, cik string, published date").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_sections_follow_the_form_of_the_source(spark, both_forms):
    got = {r.doc_id: ((r.mdna or "")[-12:], (r.risk_factors or "")[-12:]) for r in text_queries.section_extract(spark, both_forms).collect()}
    assert all(got[k] == ("quarter view", "quarter risk") for k in range(4))
    assert all(got[k][0].endswith("annual view") and got[k][1].endswith("annual risk") for k in (4, 5, 6))
    assert got[7] == got[8] == ("", "")


def test_found_sections_in_funnel_pivot_and_prompts(spark, both_forms):
    assert tuple(more_queries.corpus_funnel(spark, both_forms).first()) == (9, 7, 7, 2)
    found = {r.doc_id: (r.mdna, r.risk_factors) for r in text_queries.section_extract(spark, both_forms).collect() if r.mdna or r.risk_factors}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {r.doc_id: (r.mdna, r.risk_factors) for r in more_queries.pivot_sections(spark, both_forms).collect()} == {k: (md5(m), md5(r)) for k, (m, r) in found.items()}
    assert {r.doc_id: r.digest for r in more_queries.section_prompts(spark, both_forms).collect()} == {k: md5(f"MD&A: {m}\nRisk factors: {r}") for k, (m, r) in found.items()}


def test_features_of_found_sections(spark, both_forms):
    got = {r.doc_id: r for r in text_queries.stub_features(spark, both_forms).collect()}
    assert got[0].rf_severity == 0.0 and got[0].rf_specificity == 1.0 and got[0].rf_litigation == 0.0 and got[0].rf_change is None
    assert got[1].rf_change == got[1].mdna_change == 0.0 and 0 < got[4].rf_change < 1 and got[6].mdna_change == 0.0
    assert got[7].mdna_tone is None and got[7].rf_severity is None


def test_masking_and_truncation(spark):
    text = "Acme Widgets Inc. (ACM, CIK 0000123) of Acme said on January 5, 2019 and 1/2/2018 that 2017 sales of $45 were firm. acm stays."
    rows = [(text, "Acme Widgets Inc", "ACM", "123", None), ("  ", "A", None, None, None), (None, None, None, None, None), ("Old (Name) Ltd. of Acme", None, " ", "nan", ["(Name)", "Old (Name) Ltd.", "Old", "", None])]
    df = spark.createDataFrame(rows, "text string, name string, ticker string, cik string, other array<string>")
    got, blank, none, alias = [r[0] for r in df.select(tx.mask("text", "name", "ticker", "cik", F.col("other"))).collect()]
    for gone in ("Acme", "Widgets", "ACM", "123", "2019", "2018", "2017"):
        assert gone not in got
    assert "acm stays" in got and "$45" in got and "[CIK]" in got and "[DATE]" in got
    assert blank is None and none is None and "Old" not in alias and "Acme" in alias
    made = df.select(*[c.alias(k) for k, c in zip(("x", "cut"), tx.prepared("text", "name", "ticker", "cik"), strict=True)]).collect()
    assert made[0].x == got and [r.cut for r in made] == [False] * 4 and made[1].x is None
    r = spark.createDataFrame([("a" * 12_000 + "m" * 9_000 + "z" * 4_000,), ("short",), (None,)], "t string").select(tx.truncate_middle("t").alias("x"), tx.is_truncated("t").alias("y")).collect()
    assert r[0].x == "a" * 12_000 + tx.CUT_MARK + "z" * 4_000 and [x.y for x in r] == [True, False, False] and r[2].x is None


def test_scores_and_clamps(spark):
    ddl = "mdna string, risk_factors string, prior_mdna string, prior_risk_factors string"
    r = filings.stub_features(spark.createDataFrame([("may maybe other " * 10, None, "other words", None), ("a b", "risk risky x y", None, "risk")], ddl)).collect()
    assert r[0].mdna_uncertainty == 1.0 and r[0].rf_severity is None and r[0].mdna_change == pytest.approx(1 - 1 / 4) and r[1].mdna_change is None and r[1].rf_change == pytest.approx(0.75)
    assert r[1].rf_severity == 1.0 and r[1].rf_specificity == 1.0
    raw = spark.createDataFrame([("x", "y", None, None, *["0.6"] * 9, "<UNKNOWN>"), ("x", None, "p", "p", *["7"] * 10)], f"{ddl}, {', '.join(f'{k} string' for k in tx.FEATURES)}")
    a, b = filings.enforce_absent(raw).collect()
    assert a.mdna_tone == 0.6 and a.rf_change is None and a.mdna_change is None and b.mdna_tone == 1.0 and b.rf_severity is None and b.mdna_change == 1.0
    t = spark.createDataFrame([("Gain, (gain) loss.",), ("nothing",), ("",), (None,)], "t string").select(tx.lexicon_tone("t", ["GAIN"], ["LOSS"])).collect()
    assert [x[0] for x in t] == [pytest.approx(1 / 3), 0.0, None, None]


def test_pivot_prior_and_cache(spark):
    rows = [("1", "A", date(2020, 1, 1), "mdna", "one"), ("1", "A", date(2020, 1, 1), "risk_factors", None), ("2", "A", date(2020, 2, 1), "mdna", " "), ("3", "A", date(2020, 3, 1), "mdna", "three"), ("4", "B", date(2020, 1, 1), "mdna", None)]
    p = filings.pivot_sections(spark.createDataFrame(rows, "accession string, p string, d date, section string, text string"), ["accession", "p", "d"])
    got = {r.accession: r.prior_mdna for r in filings.with_prior(p, "p", ["d", "accession"], ["mdna"], "accession").collect()}
    assert got == {"1": None, "2": "one", "3": "one"}
    cols = ", ".join(f"{k} double" for k in tx.FEATURES)
    cache = spark.createDataFrame([("a", *[0.5] * 10)], f"key string, {cols}")
    texts = spark.createDataFrame([("a",), ("b",)], "key string")
    out = filings.cached_features(texts, cache, lambda df: df.select("key", *[F.lit(0.1).alias(k) for k in tx.FEATURES]))
    assert {r.key: r.mdna_tone for r in out.collect()} == {"a": 0.5, "b": 0.1}


def test_audit_thresholds(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=800)
    rows = [("planted", float(0.4 * v + rng.normal()), float(v)) for v in y] + [("free", float(rng.normal()), float(v)) for v in y] + [("few", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, s double, r double")
    got = {r.g: r.rejected for r in audit.masked_probe(df, ["g"], "s", "r").collect()}
    assert got == {"planted": True, "free": False, "few": False}
    assert {r.g: r.agrees for r in audit.agreement(df, ["g"], "s", "r").collect()}["free"] is False


def test_runs_gaps_and_business_days(spark):
    bars = spark.createDataFrame([("A", date(2020, 1, 1 + k), p) for k, p in [(0, 1.0), (1, 1.0), (2, 1.0), (5, 2.0), (12, 2.0), (30, None)]], "t string, d date, p double")
    assert integrity.stale_runs(bars, "t", "d", "p").first().longest == 3
    assert [(r.gap, r.place) for r in integrity.gap_check(bars, "t", "d").orderBy("place").collect()] == [(14, 1), (5, 2), (1, 3)]
    rng = random.Random(1)
    pairs = [(day(a), day(a + rng.randrange(40))) for a in (rng.randrange(-9000, 900) for _ in range(60))]
    got = [r[0] for r in spark.createDataFrame(pairs, "a date, b date").select(integrity.business_days(F.col("a"), F.col("b"))).collect()]
    assert got == [int(np.busday_count(a, b)) for a, b in pairs]
