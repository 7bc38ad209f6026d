"""Leaks, mixing and shared spans against brute force and at the edges."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.llm import leaks
from tidemark.llm.hashing import Roller, scramble, sliding_min
from tidemark.llm.leaks import Index, find_leaks
from tidemark.llm import mixing
from tidemark.llm.mixing import mix, slices, source_name, token_counts
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.spans import CHUNK, copies, shared_lengths, shared_passages, shared_portions, shared_span_pairs

DOCS = "doc_id long, text string, item_id string, k string"
WORDS = ["alpha", "beta", "gamma", "delta", "rho", "pi", "net", "of", "tax", "19"]


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def grams(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_leaks(docs, items, n):
    return {(d, i) for d, t in docs for i, u in items if d is not None and i is not None and grams(t, n) & grams(u, n)}


def run_leaks(spark, docs, items, n):
    d = spark.createDataFrame([(*x, "c", "c") for x in docs], DOCS)
    e = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, e, span=n).collect()}


def test_hash_tools():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, 500).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(494)]
    r = Roller()
    codes = scramble(rng.integers(0, 3, 400).astype(np.uint64))
    h = r.windows(r.prefix(codes), 4)
    for i in range(60):
        for j in range(60):
            assert (h[i] == h[j]) == (codes[i : i + 4] == codes[j : j + 4]).all()


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    items = [(i, say(rng.choice([3, 8, 14, 30]))) for i in range(12)] + [(90, None), (91, ""), (None, say(20))]
    items += [(50, items[3][1]), items[3]]
    docs = []
    for i in range(40):
        body = say(rng.randrange(30))
        if rng.random() < 0.6:
            w = words(rng.choice([u for _, u in items if u]))
            a = rng.randrange(len(w))
            mid = rng.choice([" ", ", ", "\r\n", "—", "<b>"]).join(w[a : a + rng.randrange(6, 16)])
            body = f"{body} {mid.upper() if rng.random() < 0.5 else mid} {say(5)}"
        docs.append((i, body))
    docs += [(100, None), (101, ""), (None, items[3][1]), docs[0], (102, "é" * 50 + items[4][1] + "İ" + items[5][1])]
    assert run_leaks(spark, docs, items, 8) == brute_leaks(docs, items, 8)


def test_leak_bounds_and_empty_tables(spark):
    item = " ".join(f"w{i}" for i in range(20))
    w = words(item)
    cut = lambda a, z: " ".join(w[a:z])
    docs = [(1, cut(0, 12)), (2, cut(8, 20)), (3, cut(0, 11)), (4, cut(0, 6) + " x " + cut(6, 12)), (5, "zz " + cut(4, 16) + " yy"), (6, cut(0, 11) + " w11x")]
    assert run_leaks(spark, docs, [(7, item)], 12) == {(1, 7), (2, 7), (5, 7)}
    assert run_leaks(spark, [], [(7, item)], 12) == set() and run_leaks(spark, docs, [], 12) == set()
    with pytest.raises(ValueError):
        run_leaks(spark, docs, [(7, item)], 3)


def test_very_long_text_is_read_in_slices(monkeypatch):
    rng = random.Random(5)
    item = " ".join(f"q{i}" for i in range(40))
    w = words(item)
    index = Index([7], [item], 12)
    index.order(np.zeros(len(index.shingles), np.int64))
    monkeypatch.setattr(leaks, "SLICE", 200)
    for _ in range(150):
        a = rng.randrange(29)
        n = rng.choice([11, 12, 13])
        before = " ".join("f" * rng.randrange(1, 9) for _ in range(rng.randrange(5, 90)))
        text = f"{before} {' '.join(w[a : a + n])} " + "tail " * 60
        got = list(leaks._search(iter([pa.RecordBatch.from_pydict({"doc": [1], "text": [text]})]), index))
        assert bool(got) == (n >= 12 and len(w[a : a + n]) >= 12), (a, n, len(before))
    giant = "g" * 900
    for text in (f"{giant} {' '.join(w[:12])}", f"{' '.join(w[:12])} {giant}", f"x {giant} {giant} {' '.join(w[5:17])} {giant}"):
        assert list(leaks._search(iter([pa.RecordBatch.from_pydict({"doc": [1], "text": [text]})]), index))


def test_items_that_share_a_window_are_listed_together(spark):
    w = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:30])), (3, "x " + " ".join(w[5:20])), (4, " ".join(w[25:40])), (5, " ".join(w[:20]))]
    index = Index([i for i, _ in items], [t for _, t in items], 12)
    index.order(np.zeros(len(index.shingles), np.int64))
    assert len(index.row) == len({tuple(t.split()[k : k + 12]) for _, t in items for k in range(len(t.split()) - 11)}) < len(index.first)
    got = list(leaks._search(iter([pa.RecordBatch.from_pydict({"doc": [7], "text": ["no " + " ".join(w[6:18])]})]), index))
    assert got[0].column("item").to_pylist() == [1, 2, 3, 5]


def brute_pairs(docs, n):
    wins = {}
    for d, t in docs:
        if d is not None and t:
            wins.setdefault(d, set()).update(t[i : i + n] for i in range(len(t) - n + 1))
    return {(a, b) for a in wins for b in wins if a < b and wins[a] & wins[b]}


def brute_cover(docs, n):
    out = {}
    for d, t in docs:
        if d is None:
            continue
        others = {u[i : i + n] for e, u in docs if e not in (d, None) and u for i in range(len(u) - n + 1)}
        on = set()
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in others:
                on.update(range(i, i + n))
        out[d] = len(on)
    return out


def brute_passages(docs, n):
    """Windows that stand in two records or more and behind different characters, by their digest."""
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1) if d is not None else ():
            seen.setdefault(t[i : i + n], []).append((d, i, t[i - 1] if i else ("start", d)))
    real = {w: rows for w, rows in seen.items() if len({d for d, *_ in rows}) > 1 and len({b for *_, b in rows}) > 1}
    out = {}
    for w, rows in real.items():
        for d, i, _ in rows:
            key = (hashlib.sha256(w.encode()).hexdigest(), d)
            out[key] = (min(i, out.get(key, (i,))[0]), len({x for x, *_ in rows}))
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 20), (2, 21), (3, 20), (4, 9)])
def test_spans_equal_brute_force(spark, seed, n):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abé漢🙂 \n") for _ in range(k))
    pool = [say(rng.randrange(n - 3, 4 * n)) for _ in range(8)] + ["a" * 3 * n, "ab" * 2 * n]
    docs = []
    for i in range(45):
        t = say(rng.randrange(2 * n))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += p[a:] + say(rng.randrange(n)) if rng.random() < 0.5 else p + say(3)
        docs.append((i, t))
    docs += [(60, docs[3][1]), (61, docs[3][1]), (70, None), (71, ""), (None, docs[4][1]), docs[5]]
    df = spark.createDataFrame([(*x, "c", "c") for x in docs], DOCS)
    got = [(r.doc_a, r.doc_b) for r in shared_span_pairs(df, n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(docs, n)
    cover = {r.doc_id: r.shared_chars for r in shared_portions(df, n).collect()}
    assert cover == brute_cover(docs, n)
    held = {(r.passage, r.doc_id): (r.start, r.records) for r in shared_passages(df, n).collect()}
    assert held == brute_passages(docs, n)
    if seed < 3:
        lengths = {(r.doc_id, r.length): r.shared_chars for r in shared_lengths(df, n).collect()}
        want, k = {}, n
        while any(more := brute_cover(docs, k).values()):
            want |= {(d, k): c for d, c in brute_cover(docs, k).items() if c}
            k *= 2
        assert lengths == want and k > n


def test_large_groups_of_copies_are_linked_through_one_member(spark):
    a, b, c = "a1" * 40 + "!" * 30, "b2" * 40 + "!" * 30, "c3" * 40 + "?" * 30
    docs = [(i, a) for i in range(10)] + [(20 + i, b) for i in range(9)] + [(40, c), (41, c), (42, "!" * 30)]
    df = spark.createDataFrame([(*x, "", "") for x in docs], DOCS)
    got = {(r.doc_a, r.doc_b) for r in shared_span_pairs(df, 30, full_pairs=20).collect()}
    member = {r.doc_id: r.representative for r in copies(df, 30).collect()}
    assert member == {**{i: 0 for i in range(10)}, **{20 + i: 20 for i in range(9)}, 40: 40, 41: 40}
    rep = lambda d: member.get(d, d)
    linked = {(min(x, y), max(x, y)) for x, y in ((rep(a), rep(b)) for a, b in got)}
    full = {(a, b) for a, b in brute_pairs(docs, 30)}
    assert {(x, y) for x in range(43) for y in range(x + 1, 43) if (rep(x) == rep(y) and x in member) or (min(rep(x), rep(y)), max(rep(x), rep(y))) in linked} >= full  # membership spells every pair out
    stars = {(0, i) for i in range(1, 10)} | {(20, 20 + i) for i in range(1, 9)} | {(40, 41)}
    across = {(i, 20) for i in range(10)} | {(0, 20 + i) for i in range(9)}
    assert got == stars | across | {(i, 42) for i in range(10)} | {(20 + i, 42) for i in range(9)}


def test_an_id_with_several_texts_is_in_no_group(spark):
    x, y, z = "x" * 40 + "1", "y" * 40 + "2", "z" + "y" * 40
    docs = [(1, x), (1, y), (2, x), (3, y), (4, z)]
    got = {(r.doc_a, r.doc_b) for r in shared_span_pairs(spark.createDataFrame([(*d, "", "") for d in docs], DOCS), 40).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (3, 4)}


def test_spans_across_slices_of_a_long_text(spark):
    rng = random.Random(9)
    say = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    base = say(3 * CHUNK)
    docs = [(1, base)]
    for i, at in enumerate(range(CHUNK - 500, CHUNK + 200, 100)):
        docs.append((10 + i, f"{say(40)}|{base[at : at + 450]}#"))
        docs.append((40 + i, f"{say(40)}|{base[at : at + 449]}#"))
    got = {(r.doc_a, r.doc_b) for r in shared_span_pairs(spark.createDataFrame([(*x, "", "") for x in docs], DOCS), 450).collect()}
    assert {p for p in got if p[0] == 1} == {(1, d) for d, _ in docs if 10 <= d < 40}
    assert {p for p in got if p[0] > 1} == brute_pairs(docs[1:], 450)


def test_a_passage_in_very_many_texts_stays_linear(spark):
    """10,000 different texts with one passage: a row each, and the pairs are not needed."""
    licence = "".join(random.Random(1).choices("abcdefgh ", k=500))
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(licence), F.sha2((-F.col("id")).cast("string"), 512)).alias("text"))
    got = shared_passages(df, 450).groupBy("passage").agg(F.count("*").alias("n"), F.max("records").alias("m")).where("n > 5000").collect()
    assert [(r.n, r.m) for r in got] == [(10_000, 10_000)]
    assert shared_portions(df, 450).where("shared_chars >= 500").count() == 10_000


def test_spans_of_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert shared_span_pairs(df, 450).count() == 0 and shared_portions(df, 450).count() == 0
    assert shared_passages(df, 450).count() == 0 and shared_lengths(df, 450).count() == 0 and copies(df, 450).count() == 0
    one = spark.createDataFrame([(1, "x" * 2000, "", ""), (1, "x" * 2000, "", "")], DOCS)
    assert shared_span_pairs(one, 450).count() == 0
    assert [tuple(r) for r in shared_portions(one, 450).collect()] == [(1, 2000, 0, 0.0)]


SIZED = "doc_id long, source string, tokens long, hash string"
GOALS = "source string, target_share double, max_repeats int"


def drawn(spark, docs, goals, **kw):
    a, b = mix(spark.createDataFrame(docs, SIZED), spark.createDataFrame(goals, GOALS), **kw)
    return {r.doc_id: r.copies for r in a.collect()}, {r.source: r for r in b.collect()}


def test_mix_meets_budgets_from_below(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["Big", " big ", "big", "small-one", "tiny"]), rng.randrange(0, 400), "c") for i in range(3000)]
    docs += [(9001, None, 5, ""), (9002, "big", None, ""), (None, "big", 5, ""), (9003, "other", 50, "")]
    goals = [("big", 0.5, 1), ("small_one", 0.3, 3), ("tiny", 0.1, 1), ("absent", 0.1, 2), (None, 0.1, 1), ("null", None, 1)]
    got, rep = drawn(spark, docs, goals, total=300_000.0)
    size = {d: n for d, _, n, _ in docs}
    for s, share, reps in goals[:4]:
        ids = [d for d, src, n, _ in docs if d is not None and n is not None and src and src.strip().lower().replace("-", "_") == s]
        took = sum(size[d] * got.get(d, 0) for d in ids)
        assert rep[s].drawn == took and all(got.get(d, 0) <= reps for d in ids)
        assert took <= share * 300_000 + 1e-6
        if ids and reps * sum(size[d] for d in ids) > share * 300_000:
            assert share * 300_000 - took < max(size[d] for d in ids)  # short by less than one record
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9 and rep["absent"].shortfall == pytest.approx(30_000)
    assert set(got) <= {d for d, src, n, _ in docs if src and src != "other"}
    more, _ = drawn(spark, docs, goals, total=330_000.0)
    assert all(more.get(d, 0) >= c for d, c in got.items())  # nested


def test_mix_edges(spark):
    got, rep = drawn(spark, [], [("a", 1.0, 1)])
    assert got == {} and rep["a"].actual_share == 0.0
    got, rep = drawn(spark, [(1, "a", 10, "")], [])
    assert got == {} and rep == {}
    got, _ = drawn(spark, [(1, "a", 10, ""), (1, "a", 10, ""), (2, "a", 0, "")], [("a", 1.0, None)])
    assert got == {1: 1, 2: 1}
    got, rep = drawn(spark, [(1, "a", 10, "")], [("a", 1.0, 5)], total=1000.0)
    assert got == {1: 5} and rep["a"].shortfall == 950.0


def test_mix_of_one_hot_source_and_equal_sizes(spark):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", 1, "") for i in range(4000)]
    got, rep = drawn(spark, docs, [("hot", 0.25, 1), *[(f"s{k}", 0.1, 2) for k in range(7)]], total=4000.0)
    assert rep["hot"].drawn == 1000 and sum(got.values()) == sum(r.drawn for r in rep.values())


def test_slices_change_no_count():
    enc = mixing._encoding(TOKENIZER)
    rng = random.Random(6)
    bits = ["word", "it's", "don't  ", " ", "\n\n", "\t", "3.5%", "é", "漢字", "🙂", "...", "_x_", "\u00a0", "\u2003", "\x1c", "A1b2", "'", "'s "]
    for piece in (1, 3, 10, 57):
        for _ in range(150):
            t = "".join(rng.choices(bits, k=60))
            assert "".join(slices(t, piece)) == t and sum(len(enc.encode_ordinary(x)) for x in slices(t, piece)) == len(enc.encode_ordinary(t))
    assert list(slices("x" * 50, 10)) == ["x" * 50] and list(slices("", 10)) == [""]


def test_tokens_of_a_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefghij'", k=rng.randrange(1, 9))) for _ in range(600_000))
    assert len(text) > 3_000_000 and len(list(slices(text))) == 4 - (len(text) < 3_000_000)
    got = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), TOKENIZER).first().tokens
    assert got == len(mixing._encoding(TOKENIZER).encode_ordinary(text))


def test_mix_that_all_sources_can_meet(spark):
    docs = [(i, "a" if i < 900 else "b" if i < 990 else "c", 10 + i % 7, "") for i in range(1000)]
    got, rep = drawn(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], fit=True)
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in rep.values()) and max(rep.values(), key=lambda r: r.drawn / r.available).shortfall < 1e-6
    assert all(r.wanted - r.drawn < 17 for r in rep.values()) and max(got.values()) <= 4
    got, rep = drawn(spark, docs, [("a", 0.5, 1), ("none", 0.5, 1)], fit=True)
    assert len(got) == 900 and rep["none"].shortfall == rep["a"].drawn


def test_tokens_and_source_names(spark):
    df = spark.createDataFrame([(1, "Hello world, 3.5%", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in token_counts(df.drop("tokens"), TOKENIZER).collect()}
    assert got[1] > 3 and got[2] == 0 and got[3] == 0 and got[4] > 1
    names = spark.createDataFrame([(x,) for x in [" Filing-10Q", "FILING 10q", "", None, "filing_10q"]], "s string").select(source_name("s")).collect()
    assert [r[0] for r in names] == ["filing_10q", "filing_10q", None, None, "filing_10q"]
