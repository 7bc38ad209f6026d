"""Nearest-time join and top N against brute force and at the edges."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import day
from tidemark.llm.nearest import nearest_join
from tidemark.llm.topn import top_n

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.integers(0, 10**6))
def test_nearest_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    d = lambda: None if rng.random() < 0.1 else day(rng.randrange(90))
    left = [(i, rng.choice([1, 1, 1, 2, None]), d(), "m") for i in range(60)]
    right = [(rng.choice([1, 1, 2, None]), d(), rng.choice([None, 1.0, 2.0])) for _ in range(25)]
    right += right[:5]
    a = spark.createDataFrame(left, "i int, k int, t date, match string")
    b = spark.createDataFrame(right, "k int, t date, px double")
    got = {r.i: (r.match_day, r.match.px) for r in nearest_join(a, b, ["k"], "t", "t", 4, payload=["px"], block_days=7).collect()}
    want = {}
    for i, k, t, _ in left:
        near = [(abs((u - t).days), u) for kk, u, _ in right if kk == k is not None and t and u and abs((u - t).days) <= 4]
        if near:
            u = min(near)[1]
            px = [p for kk, uu, p in right if kk == k and uu == u]
            want[i] = (u, max([p for p in px if p is not None], default=None))
    assert got == want


def test_nearest_keeps_repeated_rows_and_takes_empty_tables(spark):
    a = spark.createDataFrame([(1, day(3)), (1, day(3))], "k int, t date")
    b = spark.createDataFrame([(1, day(2)), (1, day(4))], "k int, u date")
    assert [r.match_day for r in nearest_join(a, b, ["k"], "t", "u", 1).collect()] == [day(2)] * 2
    assert nearest_join(a, b.limit(0), ["k"], "t", "u", 1).count() == 0
    assert nearest_join(a.limit(0), b, ["k"], "t", "u", 1).count() == 0


def test_nearest_with_one_hot_key(spark):
    a = spark.range(5000).selectExpr("cast(1 as int) k", "date_add(date'2020-01-01', cast(id % 700 as int)) t", "id")
    b = spark.createDataFrame([(1, day(7 * j)) for j in range(101)], "k int, u date")
    got = nearest_join(a, b, ["k"], "t", "u", 3)
    assert got.count() == 5000 and got.where("abs(datediff(t, match_day)) > 3").count() == 0


def brute(rows, n):
    best: dict = {}
    for g, h, item, s in rows:
        if s is None or s != s or item is None:
            continue
        at = best.setdefault((g, h), {})
        at[item] = max(s + 0.0, at.get(item, float("-inf")))
    return {k: sorted(v.items(), key=lambda x: (-x[1], x[0]))[:n] for k, v in best.items()}


@QUICK
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_top_n_equals_brute_force(spark, seed, n):
    rng = random.Random(seed)
    score = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5, float(rng.randrange(5))])
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, None, float("nan")]), rng.choice([None, *range(30)]), score()) for _ in range(300)]
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, h double, item int, s double, score string, position int")
    key = lambda g, h: (g, "nan" if h is not None and h != h else h)
    want = {}
    for g, h, item, s in rows:
        want.setdefault(key(g, h), []).append((0, 0, item, s))
    want = {k: v for k, w in want.items() for v in brute(w, n).values()}
    got: dict = {}
    for r in sorted(top_n(df, ["g", "h"], "s", "item", n).collect(), key=lambda r: r.position):
        got.setdefault(key(r.g, r.h), []).append((r.item, r.score))
    assert got == want


def test_top_n_of_one_group_over_many_partitions(spark):
    df = spark.range(20000).selectExpr("1 g", "id item", "cast(id % 997 as double) s")
    got = [(r.item, r.score, r.position) for r in top_n(df, ["g"], "s", "item", 50).orderBy("position").collect()]
    rows = sorted(((-(i % 997), i) for i in range(20000)))[:50]
    assert got == [(i, -s + 0.0, p + 1) for p, (s, i) in enumerate(rows)]
    assert top_n(df.limit(0), ["g"], "s", "item", 5).count() == 0
