"""Long exact spans that records share.

Spans of at least ``length`` characters are found by doubling: windows of a quarter of the length that stand in
two records or more are alone extended to half of it, those that repeat again to the full length, and
where the greatest length of shared spans is asked for, to twice that and so on, until no candidate survives.

At the first level not every window is looked at: of all that begin in the same full window the one of smallest hash is an
*anchor*. Every span of ``length`` characters holds an anchor, and it depends on that span alone, so it
is the same one in every record. An anchor is extended both ways, to the window that begins with it and to the one
that ends with it; a shared span reaches far enough to at least one side. What repeats on neither side is dropped; what repeats
on one side only can begin in a part of the positions only. One scan of the texts gives the hashes of both levels, so no text
is moved until the last one.

A pair of records is reported where their common span begins: there the characters before it differ, so each
common span gives one window, not one per character. If two records agree in the whole run from the
anchor before to this anchor's end, the span goes on to the left and is found there; so an anchor is looked at in full
length only where at least two *arrivals* (such runs) differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, staged
from .hashing import NONE, OTHER_BASE, Roller, scramble, sliding_min

#: Characters handled at once; longer texts are read in overlapping slices.
CHUNK = 1 << 17


def level_lengths(length: int) -> tuple[int, int]:
    """Window lengths before the full one: a quarter and a half of it, rounded up."""
    return -(-length // 4), -(-length // 2)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Chars:
    """Scrambled codes of characters, a table for the common ones."""

    def __init__(self) -> None:
        self.table = scramble(np.arange(1, 1 << 16, dtype=np.uint64))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) and int(codes.max()) >= len(self.table):
            return scramble(codes.astype(np.uint64) + np.uint64(1))
        return self.table[codes]


def _anchors(prefix: np.ndarray, stop: np.ndarray, length: int, least: int, roll: Roller) -> np.ndarray:
    """Positions of the anchors in texts laid end to end; ``stop`` has the end of each, none shorter than ``length``."""
    width = length - least + 1
    h = roll.windows(prefix, least)
    total = len(prefix) - 1
    n = total - length + 1  # windows of the full length
    left = np.repeat(stop, np.diff(stop, prepend=0))  # end of the text a character lies in
    at = np.arange(total)
    h[at[: len(h)] + least > left[: len(h)]] = NONE  # would run over into the next text
    low = sliding_min(h, width)[:n]
    low[at[:n] + length > left[:n]] = 0
    # an anchor is a window that is the least of some full window: compare with the greatest of the leasts over it
    pad = np.zeros(n + 2 * (width - 1), np.uint64)
    pad[width - 1 : width - 1 + n] = low
    most = ~sliding_min(~pad, width)  # most[i] covers full windows i-width+1 .. i
    return np.flatnonzero((most[: len(h)] == h) & (h != NONE))


def _rows(text: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray, length: int, run, ends: bool) -> pa.RecordBatch:  # noqa: ANN001
    """Anchors (sorted by ``text``, a number, and position; ``doc`` and ``size`` are their text's) with the hashes of the next level and of the runs between them.

    ``run(which, start, end)`` hashes stretches of the texts of the anchors ``which``. Where a stretch would leave the
    text, a code of the anchor's own stands, which repeats nowhere.
    """
    least, half = level_lengths(length)
    alone = scramble(scramble(doc.astype(np.uint64)) + pos.astype(np.uint64))
    every = np.arange(len(pos))

    def hashed(ok: np.ndarray, start: np.ndarray, end: np.ndarray, tag: int) -> pa.Array:
        out = scramble(alone + np.uint64(tag))
        out[ok] = run(every[ok], start[ok], end[ok])
        return pa.array(out.view(np.int64))

    same = text[1:] == text[:-1]  # not the record: an id may stand for several texts
    before, after = np.append([False], same), np.append(same, [False])
    cols = {
        "h": pa.array(run(every, pos, pos + least).view(np.int64)), "doc": pa.array(doc), "pos": pa.array(pos.astype(np.int32)),
        "begin": hashed(pos + half <= size, pos, pos + half, 1), "close": hashed(pos + least >= half, pos + least - half, pos + least, 2),
        "came": hashed(before, np.roll(pos, 1), pos + least, 3),
    }
    if ends:
        cols["went"] = hashed(after, pos, np.roll(pos, -1) + least, 4)
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _together(held: list[tuple[int, str]], length: int, roll: Roller, chars: _Chars, ends: bool) -> pa.RecordBatch:
    """Anchors of several short texts at once."""
    size = np.array([len(t) for _, t in held])
    stop = np.cumsum(size)
    prefix = roll.prefix(chars(_codes("".join(t for _, t in held))))
    at = _anchors(prefix, stop, length, level_lengths(length)[0], roll)
    text = np.searchsorted(stop, at, side="right")
    origin = (stop - size)[text]
    ids = np.array([d for d, _ in held], np.int64)
    return _rows(text, ids[text], at - origin, size[text], length, lambda w, a, z: roll.runs(prefix, a + origin[w], z + origin[w]), ends)


def _sliced(doc: int, text: str, length: int, roll: Roller, chars: _Chars, ends: bool) -> pa.RecordBatch:
    """Anchors of one long text, slice by slice; a slice reaches far enough to hold every stretch that begins in it."""
    starts = range(0, len(text) - length + 1, CHUNK)
    cut = lambda a: roll.prefix(chars(_codes(text[a : a + CHUNK + 2 * length])))
    found = []
    for a in starts:
        prefix = cut(a)
        if len(prefix) > length:
            found.append(a + _anchors(prefix, np.array([len(prefix) - 1]), length, level_lengths(length)[0], roll))
    pos = np.unique(np.concatenate(found))

    def run(which: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint64)
        part = np.minimum(a // CHUNK, len(starts) - 1)
        for k in np.unique(part):
            on = part == k
            out[on] = roll.runs(cut(starts[int(k)]), a[on] - starts[int(k)], z[on] - starts[int(k)])
        return out

    return _rows(np.zeros(len(pos)), np.full(len(pos), doc, np.int64), pos, np.full(len(pos), len(text)), length, run, ends)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, ends: bool) -> Iterator[pa.RecordBatch]:
    roll, chars = Roller(), _Chars()
    for b in batches:
        held, n = [], 0
        for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
            if t is None or len(t) < length:
                continue
            if len(t) > 2 * CHUNK:
                yield _sliced(d, t, length, roll, chars, ends)
                continue
            held.append((d, t))
            n += len(t)
            if n > CHUNK:
                yield _together(held, length, roll, chars, ends)
                held, n = [], 0
        if held:
            yield _together(held, length, roll, chars, ends)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a text that hold every full window beginning in one of the ranges ``places``, and the character before.

    Overlapping stretches become one, so no window is made twice.
    """
    for b in batches:
        doc, first, body = [], [], []
        for d, t, places in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
            reach = -1
            for low, high in sorted({(p["low"], p["high"]) for p in places}):
                a, z = max(0, low - 1), min(len(t), high + length)
                if z - max(0, low) < length:
                    continue
                if a < reach - length + 1:
                    if z > reach:
                        body[-1] += t[reach:z]
                else:
                    doc.append(d)
                    first.append(a)
                    body.append(t[a:z])
                reach = max(reach, z)
        if doc:
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(body, pa.string())], ["doc", "first", "body"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Full windows of the stretches: hash, record, start, and the character before (a mark of its own at a text's start)."""
    roll, other, chars = Roller(), Roller(OTHER_BASE), _Chars()
    for b in batches:
        for d, first, body in zip(b.column("doc").to_pylist(), b.column("first").to_pylist(), b.column("body").to_pylist(), strict=True):
            codes = _codes(body)
            mixed = chars(codes)
            g = roll.windows(roll.prefix(mixed), length) ^ (other.windows(other.prefix(mixed), length) << np.uint64(1))
            if not len(g):
                continue
            before = np.empty(len(g), np.int64)
            before[1:] = codes[: len(g) - 1]
            skip = 0 if first == 0 else 1  # the stretch's first character is only a predecessor
            before[0] = -1 - d if d >= 0 else -(2**40) + d
            g, before = g[skip:], before[skip:]
            n = len(g)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(np.full(n, d, np.int64)), pa.array(np.arange(skip, skip + n, dtype=np.int32) + first), pa.array(before)], ["g", "doc", "start", "before"]
                )


def _aligned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows that begin at a repeated anchor, and all windows around those where a common span can begin or end."""
    roll, other, chars, least = Roller(), Roller(OTHER_BASE), _Chars(), level_lengths(length)[0]
    for b in batches:
        for d, t, places, edges in zip(*(b.column(k).to_pylist() for k in ("doc", "text", "places", "edges")), strict=True):
            n = len(t) - length + 1
            want = np.zeros(max(n, 0), bool)
            p = np.array(places, np.int64)
            want[p[p < n]] = True
            for q in edges or []:
                want[max(0, q - (length - least)) : q + 1] = True
            at = np.flatnonzero(want)
            if len(at):
                mixed = chars(_codes(t))
                g = roll.runs(roll.prefix(mixed), at, at + length) ^ (other.runs(other.prefix(mixed), at, at + length) << np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(at), d, np.int64)), pa.array(at.astype(np.int32))], ["g", "doc", "start"])


def _texts(docs: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and length(text) >= {length}")


def _repeated(rows: DataFrame, code: str) -> DataFrame:
    """Codes that stand in two records or more. Written, so that joins with it know its size."""
    return staged(rows.groupBy(code).agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select(code))


def repeated_anchors(base: DataFrame, length: int, ends: bool, without: DataFrame | None = None) -> DataFrame:
    """Anchors whose windows repeat at a quarter and at half the length, on one side at least.

    Columns: h, doc, pos, begin, close, came and, if ``ends``, went (codes), and opens, ends - whether the window of half the length
    that begins with the anchor, or closes with it, repeats. Records of ``without`` (doc) take no part.
    A level is reached only by what repeated at the one before, and none is begun once no candidate is left.
    """
    ship(base.sparkSession)
    schema = "h long, doc long, pos int, begin long, close long, came long" + (", went long" if ends else "")
    alive = base.mapInArrow(lambda it: _anchor_rows(it, length, ends), schema)
    alive = staged(alive if without is None else alive.join(without, "doc", "left_anti"))
    alive = staged(alive.join(_repeated(alive.select("h", "doc"), "h"), "h", "left_semi"))
    none = alive.withColumns({"opens": F.lit(True), "closes": F.lit(True)})
    if alive.isEmpty():
        return none
    both = alive.select("doc", F.explode(F.array("begin", "close")).alias("code"))
    again = _repeated(both, "code").withColumn("__hit", F.lit(True))
    for side, flag in (("begin", "opens"), ("close", "closes")):
        alive = alive.join(again.select(F.col("code").alias(side), F.col("__hit").alias(flag)), side, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return staged(alive.where("opens or closes"))


def _several(alive: DataFrame, code: str) -> DataFrame:
    """Hashes of anchors with more than one arrival (or departure)."""
    return staged(alive.groupBy("h").agg(F.min(code).alias("a"), F.max(code).alias("z")).where("a <> z").select("h"))


def span_starts(base: DataFrame, length: int, without: DataFrame | None = None) -> DataFrame:
    """Places where a span common to two records begins, a row per passage and record: key, doc, start, before, several.

    ``base`` has doc and text. A passage is the window of ``length`` characters with which the span begins, told by the
    SHA-256 of its characters (``key``); it stands in two records or more, not everywhere behind the same character. Of a
    record's places with one passage the first is given; ``several`` says whether different characters stand before them.
    """
    least, half = level_lengths(length)
    alive = repeated_anchors(base, length, ends=False, without=without)
    # without the window on its right a span ends soon, so it began long before; without the one on its left it begins near
    low = F.when(F.col("closes"), F.col("pos") + least - length).otherwise(F.col("pos") + least - half + 1)
    high = F.when(F.col("opens"), F.col("pos")).otherwise(F.col("pos") + half - length - 1)
    near = F.struct(F.greatest(low, F.lit(0)).alias("low"), high.alias("high"))
    # a text bounds the list of its own anchors
    places = staged(alive.join(_several(alive, "came"), "h", "left_semi").where(high >= 0).groupBy("doc").agg(F.collect_set(near).alias("places")))
    stretches = staged(base.join(places, "doc").mapInArrow(lambda it: _cut(it, length), "doc long, first int, body string").distinct())
    windows = stretches.mapInArrow(lambda it: _windows(it, length), "g long, doc long, start int, before long")
    begins = staged(
        windows.groupBy("g")
        .agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.min("before").alias("b"), F.max("before").alias("y"))
        .where("a < z and b <> y")
        .select("g")
    )
    starts = windows.join(begins, "g", "left_semi").groupBy("g", "doc").agg(F.min(F.struct("start", "before")).alias("s"), (F.min("before") < F.max("before")).alias("several"))
    at = F.col("s.start") - F.col("first")
    inside = (at >= 0) & (at + length <= F.length("body"))
    keyed = starts.join(stretches, "doc").where(inside).select("doc", "s.start", "s.before", "several", F.sha2(F.substring(F.col("body"), at + 1, F.lit(length)), 256).alias("key"))
    keyed = staged(keyed.groupBy("key", "doc").agg(F.min(F.struct("start", "before")).alias("s"), F.max("several").alias("several")).select("key", "doc", "s.*", "several"))
    true = keyed.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.min("before").alias("b"), F.max("before").alias("y"), F.max("several").alias("m")).where("a < z and (b <> y or m)").select("key")
    return keyed.join(true, "key", "left_semi")


def shared_portions(docs: DataFrame, length: int = 450, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How much of each record lies in spans of ``length`` or more characters that also stand in another record.

    Columns: ``doc_id``, n_chars, shared_chars, share. One row per record; NULL and empty texts have 0
    characters and a NULL share. A span is told by two hashes folded into 64 bits. Rows of one id count as one
    record of their longest text. ``length`` must be at least 4.

    A common span is covered by the windows that begin at its anchors, the one at its beginning and the
    one at its end. The first are one per anchor; for the others all windows are tried, but only
    around anchors with several arrivals or departures. So copies cost as much as other texts: no pair of
    records is ever formed.
    """
    base = _texts(docs, length, doc_id, text)
    alive = repeated_anchors(base, length, ends=True)
    edge = _several(alive, "came").union(_several(alive, "went")).distinct().withColumn("edge", F.lit(True))
    places = staged(
        alive.join(edge, "h", "left").groupBy("doc").agg(F.collect_set("pos").alias("places"), F.collect_set(F.when(F.col("edge"), F.col("pos"))).alias("edges"))
    )
    windows = staged(base.join(places, "doc").mapInArrow(lambda it: _aligned(it, length), "g long, doc long, start int"))
    starts = windows.join(_repeated(windows.select("g", "doc"), "g"), "g", "left_semi").select("doc", "start").distinct()
    step = F.coalesce(F.least(F.lead("start").over(Window.partitionBy("doc").orderBy("start")) - F.col("start"), F.lit(length)), F.lit(length))
    got = starts.select("doc", step.alias("n")).groupBy("doc").agg(F.sum("n").alias("shared_chars"))
    every = docs.select(F.col(doc_id).cast("long").alias("doc"), F.length(F.col(text)).alias("n")).where("doc is not null").groupBy("doc").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("long")
    return every.join(got, "doc", "left").select(F.col("doc").alias(doc_id), F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), (shared / F.nullif("n_chars", F.lit(0))).alias("share"))


def shared_passages(docs: DataFrame, length: int = 450, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The passages with which shared spans begin, and the records that hold them: passage (SHA-256), ``doc_id``, start, records.

    A row per passage and record, however many records share it; ``start`` counts from 0 and is the first in the record. Pairs
    of records are not formed. Rows of one id are one record.
    """
    rows = span_starts(_texts(docs, length, doc_id, text), length)
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("records"))
    return rows.join(n, "key").select(F.col("key").alias("passage"), F.col("doc").alias(doc_id), F.col("start").cast("long").alias("start"), "records")


def shared_lengths(docs: DataFrame, length: int = 450, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How long the spans that a record shares are: ``doc_id``, length, shared_chars for ``length``, twice that, and so on.

    A level is searched among the records alone that shared a span at the one before, and the doubling ends when none is
    left. Records that share nothing have no row.
    """
    alive, out = docs, None
    while True:
        got = staged(shared_portions(alive, length, doc_id, text).where("shared_chars > 0").select(doc_id, F.lit(length).cast("long").alias("length"), "shared_chars"))
        out = got if out is None else out.unionByName(got)
        if got.isEmpty():
            return out
        alive, length = docs.join(got.select(doc_id), doc_id, "left_semi"), 2 * length


#: Above so many pairs between two groups of copies, the pairs are given through one member of each group.
FULL_PAIRS = 1_000_000


def copy_members(base: DataFrame) -> DataFrame:
    """Members of the groups of equal texts with two records or more: doc, k (text digest), rep (smallest doc), n.

    Texts are told by SHA-256, so only digests are moved. An id that stands for several texts is in no group.
    """
    keyed = base.select("doc", F.sha2("text", 256).alias("k"))
    solo = staged(keyed.groupBy("doc").agg(F.min("k").alias("k"), F.max("k").alias("z")).where("k = z").select("doc", "k"))
    groups = solo.groupBy("k").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return staged(solo.join(groups, "k"))


def _with_copies(pairs: DataFrame, members: DataFrame, full_pairs: int) -> DataFrame:
    """Pairs of representatives and the groups of copies, spelled out into pairs of records."""
    sizes = members.where("doc = rep").select("rep", "n")
    side = lambda s: sizes.select(F.col("rep").alias(f"doc_{s}"), F.col("n").alias(f"n_{s}"))
    p = pairs.join(side("a"), "doc_a", "left").join(side("b"), "doc_b", "left").na.fill(1, ["n_a", "n_b"])
    every = lambda s: members.select(F.col("rep").alias(f"doc_{s}"), F.col("doc").alias(f"m_{s}"))

    def spelled(df: DataFrame, *sides: str) -> DataFrame:
        for s in sides:
            df = df.join(every(s), f"doc_{s}", "left").withColumn(f"doc_{s}", F.coalesce(f"m_{s}", f"doc_{s}"))
        return df.select("doc_a", "doc_b")

    small = F.col("n_a") * F.col("n_b") <= full_pairs
    out = spelled(p.where(small), "a", "b").unionByName(spelled(p.where(~small), "a")).unionByName(spelled(p.where(~small), "b"))
    few = members.where(F.col("n") * F.col("n") <= full_pairs).select("rep", "doc")
    within = few.alias("x").join(few.alias("y"), "rep").where("x.doc < y.doc").select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"))
    many = members.where((F.col("n") * F.col("n") > full_pairs) & (F.col("doc") != F.col("rep"))).select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"))
    out = out.unionByName(within).unionByName(many)
    return out.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).where("doc_a < doc_b").distinct()


def copies(docs: DataFrame, length: int = 450, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Records that equal another one of at least ``length`` characters: ``doc_id``, representative (smallest id), records.

    With it the pairs that shared_span_pairs gives through representatives can be spelled out, whatever its full_pairs.
    """
    got = copy_members(_texts(docs, length, doc_id, text))
    return got.select(F.col("doc").alias(doc_id), F.col("rep").alias("representative"), F.col("n").alias("records"))


def shared_span_pairs(docs: DataFrame, length: int = 450, doc_id: str = "doc_id", text: str = "text", full_pairs: int = FULL_PAIRS) -> DataFrame:
    """Pairs of records (doc_a < doc_b) whose texts have a run of at least ``length`` characters in common.

    Characters are compared exactly, case, blanks and line ends included. Rows are distinct. Texts
    that are NULL or shorter than ``length`` are in no pair; a record is in no pair with itself,
    repeated rows notwithstanding. ``length`` must be at least 4.

    Equal texts are searched once, by the smallest id of their group, and spelled out afterwards: copies are
    pairs like any others. Only where that would be more than ``full_pairs`` pairs between two groups (or
    within one) are they given through the smallest id: every member of a group is paired with the
    group's smallest id, and with that of a group it shares a span with. As equality is
    transitive no link is lost, and a third of all rows may be copies of one text; copies() has the members.

    Pairs are formed only among records that hold the same passage, one row each, so no pair is formed that is not a result.
    """
    whole = _texts(docs, length, doc_id, text)
    members = copy_members(whole)
    starts = span_starts(whole, length, members.where("doc <> rep").select("doc"))
    side = lambda s: starts.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "before", "several")])
    met = side("a").join(side("b"), "key").where("doc_a < doc_b and (before_a <> before_b or several_a or several_b)")
    return _with_copies(met.select("doc_a", "doc_b").distinct(), members, full_pairs)
