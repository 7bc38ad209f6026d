"""Problems 1, 4 and 5 and their parts, against brute force and at the edges."""

from __future__ import annotations

import random
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.scalars import canon_cik, parse_day
from tidemark.operators.asof import asof_join, exact_cover, forward_fill_series, with_age_limit
from tidemark.operators.bitemporal import locate, rectangles
from tidemark.operators.identity import attribute, current_bars, sole_owner_segments, usable_windows
from tidemark.operators.periods import fuse, periods_and_gaps
from tidemark.operators.rolling import rolling_totals, trailing_at

from .conftest import day

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
REC = "e long, v date, r date, id long"
EV = "n long, e long, v date, r date, record string"


def current(records, e, v, r):
    """The rule, said plainly: among those recorded by r and valid by v the greatest valid day, then the latest recorded, then the greatest id."""
    ok = [(x[1], x[2], x[3]) for x in records if None not in x and x[0] == e and x[1] <= v and x[2] <= r]
    return max(ok)[2] if ok else None


@QUICK
@given(st.integers(0, 10**6))
def test_bitemporal_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 60)
    recs = [(rng.choice([1, 2, None]), day(rng.randrange(40)), day(rng.randrange(40)), i) for i in ids]
    recs += rng.choices(recs, k=10) + [(1, None, day(3), 5001), (1, day(3), None, 5002), (1, day(3), day(3), None)]
    evs = [(n, rng.choice([1, 2, 3, None]), day(rng.randrange(-5, 60)), day(rng.randrange(-5, 60)), "x") for n in range(80)]
    got = locate(
        spark.createDataFrame(evs, EV), spark.createDataFrame(recs, REC), entity="e", event_valid=F.col("v"), event_recorded=F.col("r"), valid="v", recorded="r", record="id", cell_days=7
    )
    want = {n: current(recs, e, v, r) for n, e, v, r, _ in evs}
    assert {x["n"]: x["record"] for x in got.collect()} == {n: i for n, i in want.items() if i is not None}


def test_rectangles_are_disjoint_and_few(spark):
    rng = random.Random(7)
    recs = [(1, day(rng.randrange(30)), day(rng.randrange(30)), i) for i in range(40)]
    out = rectangles(spark.createDataFrame(recs, REC), "e", "v", "r", "id").collect()
    assert len(out) <= 80
    for i, a in enumerate(out):
        for b in out[:i]:
            assert not (a.v_from < b.v_to and b.v_from < a.v_to and a.r_from < b.r_to and b.r_from < a.r_to)


def test_bitemporal_age_empty_and_repeated(spark):
    ev = spark.createDataFrame([(1, 1, day(10), day(10), "x"), (1, 1, day(10), day(10), "x"), (2, 1, day(20), day(20), "x")], EV)
    rec = spark.createDataFrame([(1, day(5), day(5), 9)], REC)
    how = {"entity": "e", "event_valid": F.col("v"), "event_recorded": F.col("r"), "valid": "v", "recorded": "r", "record": "id"}
    assert sorted(x["n"] for x in locate(ev, rec, max_age=5, **how).collect()) == [1, 1]
    assert locate(ev, rec.limit(0), **how).count() == 0
    assert locate(ev.limit(0), rec, **how).count() == 0


def test_days_and_ciks_in_every_spelling(spark):
    rows = ["2010-03-30", "2010-03-30 00:00:00", " 2010-03-30T00:00:00", "2010/03/30", "20100330", "2010-13-30", "None", "", None, "30.3."]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(parse_day("s")).collect()]
    assert got == [date(2010, 3, 30)] * 5 + [None] * 5
    ciks = ["0005000346", "5000028.0", " 42 ", "nan", "None", "", None, "0", "12a", "000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ciks], "s string").select(canon_cik("s")).collect()]
    assert got == ["5000346", "5000028", "42", "", "", "", "", "0", "", "0"]


@QUICK
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(1, 3), st.integers(0, 30), st.integers(0, 12)), max_size=14))
def test_sole_owner_equals_brute_force(spark, wins):
    rows = [(t, p, day(a), day(a + n)) for t, p, a, n in wins] + [("A", 1, day(9), day(3)), (None, 1, day(1), day(2)), ("A", None, day(1), day(2))]
    w = spark.createDataFrame(rows, "ticker string, permaticker int, first date, last date").where("first <= last")
    facts = spark.createDataFrame([(t, day(k)) for t in "AB" for k in range(45)] + [(None, day(1)), ("A", None)], "ticker string, d date")
    got = {(r["ticker"], r["d"]): r["permaticker"] for r in attribute(facts, sole_owner_segments(w), "ticker", "d").collect()}
    want = {}
    for t in "AB":
        for k in range(45):
            own = {p for tt, p, a, n in wins if tt == t and a <= k <= a + n}
            if len(own) == 1:
                want[(t, day(k))] = own.pop()
    assert got == want


PRICES = "ticker string, date date, closeadj double, volume double, ret double, lastupdated date"
TICKERS = "permaticker int, ticker string, firstpricedate string, lastpricedate string, day string"


def test_bars_take_the_latest_version_or_none(spark):
    t = spark.createDataFrame([(1, "A", "2020-01-01", "2020-12-31", "x"), (1, "A", "2020-01-01", "2020-12-31", "x"), (2, "A", "2020-06-01", "2020-06-02", "x")], TICKERS)
    p = spark.createDataFrame(
        [
            ("A", day(1), 1.0, 5.0, 0.1, day(1)), ("A", day(1), 2.0, 6.0, 0.2, day(3)), ("A", day(1), 2.0, 6.0, 0.2, day(3)),
            ("A", day(2), 1.0, 5.0, 0.1, day(2)), ("A", day(2), None, 5.0, 0.1, day(9)), ("A", day(3), float("nan"), 1.0, None, day(3)),
            ("A", date(2020, 6, 1), 1.0, 1.0, None, day(3)), ("B", day(1), 1.0, 1.0, None, day(3)), (None, day(1), 1.0, 1.0, None, day(3)), ("A", day(4), 7.0, None, None, None),
        ],
        PRICES,
    )
    got = sorted(tuple(r) for r in current_bars(p, t).collect())
    assert got == [(1, day(1), 2.0, 6.0, 0.2), (1, day(4), 7.0, None, None)]
    assert current_bars(p.limit(0), t).count() == 0 and current_bars(p, t.limit(0)).count() == 0
    assert usable_windows(t, ["ticker"]).count() == 2


def days_of(iv):
    return {k for a, b in iv for k in range(a, b + 1)}


@QUICK
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(0, 60), st.integers(-2, 9)), max_size=25))
def test_periods_and_gaps_equal_brute_force(spark, wins):
    rows = [(k, day(a), day(a + n), "clash") for k, a, n in wins] + [(None, day(1), day(2), ""), ("x", None, day(2), ""), ("z", day(5), None, "")]
    got = periods_and_gaps(spark.createDataFrame(rows + rows[:5], "k string, first date, last date, keys string"), ["k"], fan=3).collect()
    for key in ("x", "y", "z"):
        on = days_of([(a, a + n) for k, a, n in wins if k == key and n >= 0])
        piece = lambda kind: [((r.first_day - day(0)).days, (r.last_day - day(0)).days) for r in got if r.k == key and r.piece == kind]  # noqa: B023, E731
        periods, gaps = sorted(piece("period")), sorted(piece("gap"))
        assert days_of(periods) == on and sum(b - a + 1 for a, b in periods) == len(on)
        if on:
            assert days_of(gaps) == set(range(min(on), max(on) + 1)) - on and len(gaps) == len(periods) - 1
        else:
            assert not periods and not gaps


def test_fuse_touching_intervals():
    import numpy as np

    owner, s, e = fuse(np.array([1, 1, 0, 1, 1]), np.array([5, 1, 3, 3, 9]), np.array([6, 2, 90, 4, 9]))
    assert owner.tolist() == [0, 1, 1] and s.tolist() == [3, 1, 9] and e.tolist() == [90, 6, 9]
    assert len(fuse(*[np.zeros(0, int)] * 3)[0]) == 0


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def test_entities_that_span_batches(spark, small_batches):
    """States, rectangles and cells come out the same when an entity's rows arrive in many Arrow batches."""
    rng = random.Random(9)
    wins = [(rng.choice("abcd"), day(a), day(a + rng.randrange(4))) for a in (rng.randrange(900) for _ in range(300))]
    df = spark.createDataFrame(wins, "k string, first date, last date").repartition(5)
    got = periods_and_gaps(df, ["k"], fan=2).where("piece = 'period'").collect()
    for key in "abcd":
        on = {x for k, a, b in wins if k == key for x in range(a.toordinal(), b.toordinal() + 1)}
        mine = [(r.first_day.toordinal(), r.last_day.toordinal()) for r in got if r.k == key]
        assert days_of(mine) == on and len(mine) == sum(x - 1 not in on for x in on)
    rec = [(e, day(v), day(v + d), i) for i, (e, v, d) in enumerate((rng.choice([1, 1, 1, 2, 3]), rng.randrange(200), rng.choice([0, 0, 0, 5, 90])) for _ in range(250))]
    rec += [(4, day(k), day(k), 1000 + k) for k in range(0, 200, 7)]  # in order throughout
    ev = [(i, rng.choice([1, 2, 3, 4, 5]), day(v), day(v + rng.randrange(-3, 60))) for i, v in enumerate(rng.randrange(220) for _ in range(200))]
    kw = {"entity": "e", "event_valid": F.col("v"), "event_recorded": F.col("r"), "valid": "a", "recorded": "b", "record": "i"}
    events, records = spark.createDataFrame(ev, "id int, e int, v date, r date"), spark.createDataFrame([(*x, x[3] * 2.0) for x in rec], "e int, a date, b date, i int, more double")
    got = {r.id: (r.record, r.record_valid, r.more) for r in locate(events, records, carry=("more",), how="left", cell_days=16, **kw).collect()}
    for i, e, v, r in ev:
        known = [(a, b, k) for x, a, b, k in rec if x == e and b <= r and a <= v]
        best = max(known) if known else None
        assert got[i] == ((best[2], best[0], best[2] * 2.0) if best else (None, None, None))


def test_rolling_totals_with_idle_days(spark):
    rng = random.Random(3)
    rows = [(1, day(rng.randrange(60)), float(rng.randrange(9)), "x") for _ in range(25)]
    rows += [(1, day(70), None, "x"), (2, day(5), 4.0, "x"), (None, day(1), 1.0, "x"), (1, None, 1.0, "x")]
    got = rolling_totals(spark.createDataFrame(rows, "e int, d date, v double, total string"), "e", "d", "v", (7, 30)).collect()
    by = {k: sum(v or 0 for e, d, v, _ in rows if e == 1 and d == day(k)) for k in range(80)}
    seen = [k for k in range(80) if any(e == 1 and d == day(k) for e, d, *_ in rows)]
    mine = {(r.day - day(0)).days: r for r in got if r.e == 1}
    assert sorted(mine) == list(range(seen[0], seen[-1] + 1))
    for k, r in mine.items():
        assert r.sum_7 == sum(by[j] for j in range(max(seen[0], k - 6), k + 1)) and r.sum_30 == sum(by[j] for j in range(max(seen[0], k - 29), k + 1))
        assert (r.avg_30 is None) == (k - seen[0] < 29)
    assert [(r.e, r.total) for r in got if r.e == 2] == [(2, 4.0)]
    assert rolling_totals(spark.createDataFrame([], "e int, d date, v double"), "e", "d", "v").count() == 0


def test_trailing_figures_skip_nulls_and_probes(spark):
    bars = spark.createDataFrame([(1, day(k), float(k), None if k == 3 else 2.0 * k) for k in range(8)], "e int, day date, x double, y double")
    probes = spark.createDataFrame([(1, day(5), "a"), (1, day(5), "a"), (1, day(50), "b"), (1, day(-1), "c"), (2, day(5), "d"), (None, day(5), "e"), (1, None, "f")], "e int, t date, trail_std string")
    got = trailing_at(probes.withColumnRenamed("trail_std", "k"), bars, "e", "t", std_of="x", std_rows=3, median_of=F.col("y"), median_rows=3).collect()
    m = {r.k: (r.trail_std, r.trail_median) for r in got}
    assert m["a"] == (1.0, 9.0) and m["b"] == (1.0, 12.0) and m["c"] == (None, None) and m["d"] == (None, None) and len(got) == 5


def test_asof_is_inclusive_or_strict_and_takes_whole_rows(spark):
    left = spark.createDataFrame([(1, day(10)), (1, day(9)), (2, day(1)), (None, day(5)), (1, None)], "k int, t date")
    right = spark.createDataFrame([(1, day(5), 1.0, 1.0), (1, day(10), None, 2.0), (1, day(10), None, 2.0), (None, day(1), 7.0, 7.0), (1, None, 8.0, 8.0)], "k int, u date, a double, b double")
    at = lambda **kw: {(r.k, r.t): (r.a, r.b) for r in asof_join(left, right, ["k"], "t", "u", ["a", "b"], **kw).collect()}
    assert at() == {(1, day(10)): (None, 2.0), (1, day(9)): (1.0, 1.0)}
    assert at(strict=True) == {(1, day(10)): (1.0, 1.0), (1, day(9)): (1.0, 1.0)}
    assert len(at(how="left")) == 5
    assert asof_join(left, right.limit(0), ["k"], "t", "u", ["a"], how="left").where("a is null").count() == 5


@pytest.mark.parametrize(
    ("t", "filed", "want"),
    [
        (date(2010, 1, 31), [date(2010, 2, 10), date(2010, 5, 12)], ("no_filing", None)),
        (date(2010, 3, 31), [date(2010, 2, 10), date(2010, 5, 12)], ("ok", 0)),
        (date(2010, 3, 31), [date(2010, 3, 31)], ("no_filing", None)),
        (date(2010, 4, 30), [date(2010, 3, 31)], ("ok", 0)),
        (date(2009, 3, 31), [date(2008, 1, 15)], ("ok", 0)),
        (date(2010, 6, 30), [date(2008, 1, 15)], ("stale", None)),
    ],
)
def test_filing_age(spark, t, filed, want):
    left = spark.createDataFrame([(1, t)], "k int, t date")
    right = spark.createDataFrame([(1, f, i) for i, f in enumerate(filed)], "k int, f date, i int")
    j = asof_join(left, right, ["k"], "t", "f", ["i"], strict=True, how="left", as_of="seen")
    r = with_age_limit(j, "t", "seen", ["i"], 548).first()
    assert (r.status, r.i) == want


def test_series_never_fill_backwards_and_holes_raise(spark):
    cal = spark.createDataFrame([(day(k),) for k in range(4)], "day date")
    late = spark.createDataFrame([(day(1), 0.5)], "day date, rate double")
    with pytest.raises(ValueError):
        forward_fill_series(cal, late, "day", "rate")
    ok = spark.createDataFrame([(day(0), 0.1), (day(2), 0.2)], "day date, rate double")
    assert [r.rate for r in forward_fill_series(cal, ok, "day", "rate").orderBy("day").collect()] == [0.1, 0.1, 0.2, 0.2]
    with pytest.raises(ValueError):
        exact_cover(cal, ok, "day", "rate")
