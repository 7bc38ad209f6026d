"""Evaluation passages inside training documents.

A passage of an item leaks when a window of ``span`` of its words in a row stands in a row in a
document. A window of ``span`` words is the set of its ``span - k + 1`` shingles of k words, each
with its position; since all of them are needed, one of them - the rarest in the corpus - is a
sufficient prefix. Documents are joined on those prefix shingles alone, bounds on length and
position discard windows that would not fit, and the words of what remains are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .hashing import Roller, scramble

SHINGLE = 5
#: Items are handled in blocks of at most so many characters; a block's index is what a task holds.
BLOCK_CHARS = 8_000_000
#: Longer texts are read in slices of about this many bytes, cut so that every window lies in one.
SLICE = 4_000_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, Roller, np.ndarray]:
    inside = np.zeros(256, bool)
    for a, z in ((ord("a"), ord("z")), (ord("0"), ord("9"))):
        inside[a : z + 1] = True
    return inside, scramble(np.arange(1, 257, dtype=np.uint64)), Roller(), np.array([pow(0x2545F4914F6CDD1D, i, 2**64) for i in range(256)], np.uint64)


class Words:
    """Words of a block of texts: byte bounds, hashes, and the text each belongs to."""

    def __init__(self, texts: list[str | None]):
        inside, codes, roll, _ = _tables()
        parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join([*parts, b""])
        byte = np.frombuffer(self.raw, np.uint8)
        mask = np.zeros(len(byte) + 2, np.int8)
        mask[1:-1] = inside[byte]
        edge = np.flatnonzero(np.diff(mask))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = roll.runs(roll.prefix(codes[byte]), self.start, self.end)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        stop = np.cumsum(size)
        self.text = np.searchsorted(stop, self.start, side="right")

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        factor = _tables()[3]
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += self.hash[i : i + n] * factor[i]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, scramble(h[at])

    def words(self, first: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.raw[self.start[i] : self.end[i]] for i in range(first, first + n))


class Lookup:
    """Membership of 64-bit hashes: a bit table first, a binary search for what passes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(np.ceil(np.log2(max(len(keys), 1)))) + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[keys >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``h`` hits, and which key."""
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _slices(ids: list, texts: list[str | None], overlap: int) -> Iterator[tuple[list, list[str]]]:
    """Blocks of bounded size. A text above SLICE is cut before a word, ``overlap`` words being repeated."""
    held_i, held_t, held = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        if not t:
            continue
        if len(t) > SLICE:
            low, at = t.lower(), 0
            while at < len(low):
                cut, kept, word_end = min(len(low), at + SLICE), 0, 0
                while cut < len(low) and kept < overlap:  # to the end of the words that straddle the cut
                    while cut < len(low) and not ("a" <= low[cut] <= "z" or "0" <= low[cut] <= "9"):
                        cut += 1
                    while cut < len(low) and ("a" <= low[cut] <= "z" or "0" <= low[cut] <= "9"):
                        cut += 1
                    kept += 1
                    word_end = word_end or cut
                yield [i], [low[at:cut]]
                nxt = at + SLICE
                while 0 < nxt < len(low) and ("a" <= low[nxt - 1] <= "z" or "0" <= low[nxt - 1] <= "9"):
                    nxt -= 1  # never start inside a word
                at = nxt if nxt > at else word_end or cut  # one word fills the slice: go on behind it
            continue
        held_i.append(i)
        held_t.append(t)
        held += len(t)
        if held > 500_000:
            yield held_i, held_t
            held_i, held_t, held = [], [], 0
    if held_i:
        yield held_i, held_t


def _count(batches: Iterator[pa.RecordBatch], keys: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
    """Texts of this partition that hold each item shingle."""
    look, total = Lookup(keys), np.zeros(len(keys), np.int64)
    for b in batches:
        for _, texts in _slices(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
            w = Words(texts)
            at, h = w.spans(SHINGLE)
            hit, k = look.find(h)
            pairs = np.unique(w.text[at[hit]] * len(keys) + k)
            total += np.bincount(pairs % max(len(keys), 1), minlength=len(keys))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["k", "n"])


class Index:
    """Windows of a block of items under their rarest shingle."""

    def __init__(self, ids: list[int], texts: list[str | None], span: int):
        self.ids, self.span = ids, span
        self.words = Words(texts)
        self.first, self.window = self.words.spans(span)
        _, sh = self.words.spans(SHINGLE)
        self.shingles = np.unique(sh)

    def order(self, frequency: np.ndarray) -> Index:
        """Choose each window's prefix: the shingle in fewest documents, the smaller hash among equals."""
        at, sh = self.words.spans(SHINGLE)
        rank = np.empty(len(self.shingles), np.int64)
        rank[np.lexsort((self.shingles, frequency))] = np.arange(len(self.shingles))
        by_word = np.full(len(self.words.hash) + 1, -1, np.int64)
        by_word[at] = rank[np.searchsorted(self.shingles, sh)]
        each = np.stack([by_word[self.first + j] for j in range(self.span - SHINGLE + 1)], 1) if len(self.first) else np.zeros((0, 1), np.int64)
        self.offset = each.argmin(1)
        chosen = self.shingles[np.argsort(rank)][each.min(1)] if len(each) else np.zeros(0, np.uint64)
        self.items = self._items()
        lead = np.array(sorted(self.items), np.int64)  # windows with the same words are looked for once
        o = lead[np.lexsort((self.window[lead], chosen[lead]))] if len(lead) else lead
        self.keys, self.begin = np.unique(chosen[o], return_index=True)
        self.begin = np.append(self.begin, len(o))
        self.row = o
        return self

    def _items(self) -> dict[int, tuple[int, ...]]:
        """The items of each window, by the first window of the same words."""
        out: dict[int, set[int]] = {}
        _, lead, back = np.unique(self.window, return_index=True, return_inverse=True)
        for r, a in enumerate(lead[back].tolist() if len(lead) else ()):
            # equal hashes of other words stand for themselves
            a = a if r == a or self.words.words(self.first[r], self.span) == self.words.words(self.first[a], self.span) else r
            out.setdefault(a, set()).add(self.ids[self.words.text[self.first[r]]])
        return {a: tuple(sorted(i)) for a, i in out.items()}


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    look, span = Lookup(index.keys), index.span
    own = index.words
    for b in batches:
        found: set[tuple[int, int]] = set()
        seen: set[tuple[int, int]] = set()
        for ids, texts in _slices(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
            w = Words(texts)
            if len(w.hash) < span:  # length bound
                continue
            at, h = w.spans(SHINGLE)
            hit, k = look.find(h)
            if not len(hit):
                continue
            where = at[hit]
            n = index.begin[k + 1] - index.begin[k]
            rows = index.row[np.repeat(index.begin[k], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
            begin = np.repeat(where, n) - index.offset[rows]
            fits = (begin >= 0) & (begin + span <= len(w.hash))  # positional bounds
            begin, rows = begin[fits], rows[fits]
            same = w.text[begin] == w.text[begin + span - 1]
            begin, rows = begin[same], rows[same]
            for j in range(span):  # cheap refusal before words are compared
                if not len(begin):
                    break
                ok = w.hash[begin + j] == own.hash[index.first[rows] + j]
                begin, rows = begin[ok], rows[ok]
            for s, r in zip(begin.tolist(), rows.tolist(), strict=True):
                doc = ids[w.text[s]]
                if (doc, r) not in seen and w.words(s, span) == own.words(index.first[r], span):
                    seen.add((doc, r))
                    found.update((doc, i) for i in index.items[r])
        if found:
            d, i = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], ["doc", "item"])


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, held = [], [], 0
    for r in items.select(F.col(item_id).cast("long"), item_text).where(f"{item_id} is not null and {item_text} is not null").distinct().toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1])
        if held > BLOCK_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 12) -> DataFrame:
    """Pairs (``doc_id``, ``item_id``) where ``span`` words in a row of the item stand in a row in the document.

    A word is a longest run of a-z and 0-9 after lower-casing; anything else only parts words. Items
    with fewer than ``span`` words, and NULL or empty texts, leak nowhere. ``span`` must be 5 or more.
    Rows are distinct, repeated documents or items notwithstanding.

    Items are read in blocks of bounded size, each a scan of the corpus: one pass counts in how
    many documents the block's shingles stand, a second searches. What is broadcast is a block's
    index, never anything that grows with the corpus; documents are not shuffled, only the found
    pairs are.
    """
    names = [doc_id, item_id if item_id != doc_id else f"item_{item_id}"]
    if span < SHINGLE:
        raise ValueError(f"span must be at least {SHINGLE} words")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text")).where(f"doc is not null and length(text) >= {span}")
    out = None
    for ids, words in _blocks(items, item_id, item_text):
        index = Index(ids, words, span)
        shingles = index.shingles
        counts = texts.mapInArrow(lambda it, s=shingles: _count(it, s, span), "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(shingles), np.int64)
        for k, n in counts.toLocalIterator():  # at most one row per shingle of the block
            frequency[k] = n
        held = spark.sparkContext.broadcast(index.order(frequency))
        found = texts.mapInArrow(lambda it, h=held: _search(it, h.value), "doc long, item long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc long, item long").toDF(*names)
    return out.distinct().toDF(*names)
