"""Mix sources to target shares of a total size, by hash thresholds and without sorting.

Every record has a fixed 60-bit hash. A source that must give a fraction of itself gives the
records below a threshold of that hash, so a larger budget always contains a smaller one.
The threshold comes from histograms: sizes by source and hash bucket are summed up once, the
bucket in which the budget ends is found, and only the rows of that one bucket are read into a
finer histogram, until it holds a single hash. What reaches the driver is one row per source and level.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, staged

BITS = 10  # buckets of a level: 1024
LEVELS = 6  # 60 bits in all
# Fixed value: the public pattern that parts a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of about so many characters, which bounds memory and changes no count; see slices().
PIECE = 1_000_000
#: A letter or digit before a blank: no match of PATTERN goes over this place, and none looks beyond it.
_SEAM = re.compile(r"(?<=[^\W_])(?=[ \t\n\r])")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def slices(text: str, piece: int = PIECE) -> Iterator[str]:
    """A text in pieces whose tokens are just those of the whole: cut only where a letter or digit meets a blank.

    There the pattern always ends a match (none holds a blank behind a letter), and what follows does not depend on what went
    before. A stretch without such a place stays whole.
    """
    at = 0
    while len(text) - at > piece:
        seam = _SEAM.search(text, at + piece)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def _tokens(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    enc = _encoding(SparkFiles.get(name))
    for b in batches:
        n = [sum(len(enc.encode_ordinary(x)) for x in slices(t)) if t else 0 for t in b.column("text").to_pylist()]
        rest = [i for i, name in enumerate(b.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(n, pa.int64())], [*[b.schema.names[i] for i in rest], "tokens"])


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``tokens`` BIGINT under a public byte-pair vocabulary, exactly, however long the text.

    NULL and empty texts have 0 tokens. ``tokenizer`` is a vocabulary file that the driver can read; it is sent to the
    executors with the job.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.__dict__.setdefault("_tidemark_files", set())
    if tokenizer not in sent:
        spark.sparkContext.addFile(tokenizer)
        sent.add(tokenizer)
    name = Path(tokenizer).name
    rest = docs.drop(text)
    out = rest.select(*rest.columns, F.lit(0).cast("long").alias("tokens")).schema
    return docs.select(*rest.columns, F.col(text).alias("text")).mapInArrow(lambda it: _tokens(it, name), out)


def source_name(c: Column | str) -> Column:
    """One spelling per source: trimmed, lower case, blanks and hyphens as underscores; blank is NULL."""
    s = F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"[\s\-]+", "_")
    return F.nullif(s, F.lit(""))


def record_hash(record: Column | str, seed: int) -> Column:
    """60 bits of the MD5 of a record's id and the seed, as any engine can make them."""
    text = F.concat_ws("|", (F.col(record) if isinstance(record, str) else record).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass
class Draw:
    """How much of a source is taken: ``copies`` of every record and one more below ``threshold``."""

    share: float
    max_repeats: int
    available: int = 0
    budget: float = 0.0
    copies: int = 0
    threshold: int = 0
    remainder: float = 0.0
    path: int = 0


def _table(spark, rows: list[tuple], ddl: str) -> DataFrame:  # noqa: ANN001
    """A setting per source as a table to broadcast; mix() bounds the number of sources."""
    return F.broadcast(spark.createDataFrame(rows, ddl))


def _histogram(sized: DataFrame, level: int, rows: list[tuple] | None) -> DataFrame:
    """source, bucket, size, n of a level - of all rows, or of those under the open path of each source in ``rows``."""
    shift = BITS * (LEVELS - 1 - level)
    if rows is not None:
        opened = _table(sized.sparkSession, rows, "source string, path long")
        sized = sized.join(opened, "source").where(F.shiftrightunsigned("hash", shift + BITS) == F.col("path"))
    bucket = F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))


def _boundaries(hist: DataFrame, left: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """Per source the bucket in which its remainder ends, its rows, and the size before it. Sources that fit whole are not there."""
    wanted = _table(hist.sparkSession, list(left.items()), "source string, remainder double")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # at most 1024 rows a source
    ends = hist.join(wanted, "source").withColumn("upto", upto).where("upto > remainder").groupBy("source").agg(F.min(F.struct("bucket", "n", (F.col("upto") - F.col("size")).alias("before"))).alias("b"))
    return {r[0]: (r[1], r[2], r[3]) for r in ends.select("source", "b.*").collect()}  # a row per source


def plan_draws(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, fit: bool = False) -> tuple[dict[str, Draw], float]:
    """Thresholds per source for ``total`` tokens.

    Without ``total`` it is all available tokens of the targets' sources or, with ``fit``, the largest total whose
    targets all sources can meet that have anything at all.
    """
    draws = {s: Draw(share, reps) for s, (share, reps) in targets.items()}
    if not draws:
        return draws, total or 0.0
    top = staged(_histogram(sized, 0, None))
    for s, available in top.groupBy("source").agg(F.sum("size")).collect():  # a row per source
        draws[s].available = available
    if total is None:
        able = [d.available * d.max_repeats / d.share for d in draws.values() if d.share > 0 and d.available]
        total = (min(able) if able else 0.0) if fit else float(sum(d.available for d in draws.values()))
    for d in draws.values():
        d.budget = d.share * total
        d.copies = min(int(d.budget // d.available), d.max_repeats) if d.available else 0
        d.remainder = d.budget - d.copies * d.available if d.copies < d.max_repeats and d.available else 0.0
    level, hist, left = 0, top, {s: d.remainder for s, d in draws.items() if d.remainder > 0}
    while left:
        ends = _boundaries(hist, left)
        again: dict[str, float] = {}
        for s in left:
            d = draws[s]
            if s not in ends:  # only rounding can lead here: everything fits
                d.threshold = 1 << (BITS * LEVELS)
                continue
            bucket, n, before = ends[s]
            d.remainder -= before
            d.path = (d.path << BITS) | bucket
            d.threshold = d.path << (BITS * (LEVELS - 1 - level))
            if n > 1 and level + 1 < LEVELS:
                again[s] = d.remainder
        level, left = level + 1, again
        if left:
            hist = _histogram(sized, level, [(s, draws[s].path) for s in left])
    return draws, total


def mix(
    docs: DataFrame, targets: DataFrame, *, total: float | None = None, fit: bool = False, seed: int = 17, doc_id: str = "doc_id", size: str = "tokens", max_sources: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """The drawn records and the shares reached.

    ``docs`` has ``doc_id``, ``source`` and ``size`` (not negative); ``targets`` has source, target_share,
    max_repeats. Each source is to give ``target_share * total`` tokens. Where that is more than it
    has, its records are repeated whole, at most ``max_repeats`` times; the rest is drawn by hash
    threshold, never above the budget: it falls short by less than one record (or by
    all records of one equal hash). A source that cannot meet its target gives
    all it may, and the shortfall is reported, not shifted onto others; with ``fit`` the total is the largest that all sources
    with any records can meet, so their shares reached stand to each other as their targets do.

    First result: doc_id, source, tokens, copies (1 or more). Second, a row per target: source,
    target_share, max_repeats, available, wanted, drawn, actual_share, shortfall (of the wanted
    tokens). Records with a NULL id, size or source, or without target, are not drawn. Records with
    0 tokens follow their hash. Repeated rows of one id share their hash and are drawn together.
    Targets with a NULL share or source are ignored; a NULL ``max_repeats`` means 1; a source named
    twice adds its shares and takes the greater ``max_repeats``. ``targets`` is a setting, not data:
    more than ``max_sources`` rows raise.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_name("source").alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = wanted.where("source is not null and target_share is not null").groupBy("source").agg(F.sum("target_share"), F.max("max_repeats")).take(max_sources + 1)
    if len(rows) > max_sources:
        raise ValueError("more targets than max_sources")
    goals = {r[0]: (float(r[1]), max(int(r[2]), 0)) for r in rows}
    named = docs.select(F.col(doc_id).alias("doc_id"), source_name("source").alias("source"), F.col(size).cast("long").alias("tokens")).where("doc_id is not null and tokens is not null")
    sized = staged(named.join(_table(spark, [(s,) for s in goals], "source string"), "source").select("doc_id", "source", "tokens", record_hash("doc_id", seed).alias("hash")))
    draws, total = plan_draws(sized, goals, total, fit)
    plan = _table(spark, [(s, d.copies, d.threshold) for s, d in draws.items()], "source string, whole int, threshold long")
    drawn = sized.join(plan, "source").withColumn("copies", F.col("whole") + (F.col("hash") < F.col("threshold")).cast("int")).where("copies > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    goal = spark.createDataFrame(
        [(s, d.share, d.max_repeats, d.available, d.budget) for s, d in sorted(draws.items())],
        "source string, target_share double, max_repeats int, available long, wanted double",
    )
    report = goal.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    whole = report.agg(F.sum("drawn").alias("__all"))
    report = report.crossJoin(F.broadcast(whole)).select(  # one row
        *goal.columns, "drawn", F.coalesce(F.col("drawn") / F.nullif(F.col("__all").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("actual_share"), F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0.0)).alias("shortfall")
    )
    return drawn.select("doc_id", "source", "tokens", "copies"), report
