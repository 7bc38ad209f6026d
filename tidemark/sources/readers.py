"""Sources: parquet tables, JSON bars, rate series, filing manifests and documents, bulk archives, paged services."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import number
from ..schemas import MissingColumns, require_columns

# Fields of a bar service and the columns they become.
BAR_FIELDS = {
    "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
    "adjOpen": "adj_open", "adjHigh": "adj_high", "adjLow": "adj_low", "adjClose": "adj_close", "adjVolume": "adj_volume",
    "divCash": "div_cash", "splitFactor": "split_factor",
}
#: Plausible bounds of a short rate as a fraction.
RATE_BOUNDS = (-0.01, 0.25)


class BadSource(ValueError):
    """A source does not hold what its contract says."""


def register_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """Parquet tables as views of the same names; a missing one fails at once and leaves none half registered."""
    frames = {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}
    for n, df in frames.items():
        df.createOrReplaceTempView(n)


def load_bars(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """A folder of bars (one file or folder per ticker) as one table; a wanted ticker without rows raises."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if tickers:
        df = df.where(F.col("ticker").isin(*tickers))
        found = {r[0] for r in df.select("ticker").distinct().collect()}  # at most the wanted tickers
        gone = sorted(set(tickers) - found)
        if gone:
            raise BadSource(f"no bars for {', '.join(gone)}")
    return df


def read_json_bars(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """One ticker's JSON array of bars, typed and renamed. No bar at all, a field missing in any bar, or a repeated day raise.

    A field that is there but null is a NULL.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("bar"))
    need = ["date", *BAR_FIELDS]
    lacks = lambda k: F.sum((~F.map_contains_key("bar", F.lit(k))).cast("int")).alias(k)
    seen = raw.agg(F.count(F.lit(1)).alias("n"), *[lacks(k) for k in need]).first()
    if not seen["n"]:
        raise BadSource(f"no bars of {ticker}")
    gone = [k for k in need if seen[k]]
    if gone:
        raise MissingColumns(f"bars of {ticker} lacks {', '.join(gone)}")
    df = raw.select(F.lit(ticker).alias("ticker"), F.substring(F.col("bar")["date"], 1, 10).try_cast("date").alias("date"), *[number(F.col("bar")[a]).alias(b) for a, b in BAR_FIELDS.items()])
    bad = df.groupBy("date").count().where("date is null or count > 1").limit(1).collect()
    if bad:
        raise BadSource(f"bars of {ticker}: day {bad[0][0]} is unreadable or repeated")
    return df


def read_rate_csv(spark: SparkSession, path: str, series: str, since: date | None = None) -> DataFrame:
    """A rate series in percent as fractions: date, rate.

    '.' is missing; the value stands in the first column that is not the date, whatever its name. An unreadable header, no
    usable value, a repeated day, an implausible value or, with ``since``, a start after that day raise.
    """
    raw = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    day = next((names[k] for k in ("observation_date", "date") if k in names), None)
    value = next((c for c in raw.columns if c != day), None)
    if not day or not value:
        raise BadSource(f"{series}: columns {raw.columns}")
    df = raw.select(F.col(f"`{day}`").try_cast("date").alias("date"), (number(F.trim(F.col(f"`{value}`"))) / 100.0).alias("rate")).where("date is not null and rate is not null")
    low, high = RATE_BOUNDS
    odd = (F.col("rate") < low) | (F.col("rate") >= high)
    got = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("days"), F.min("date").alias("first"), F.min(F.when(odd, F.struct("date", "rate"))).alias("odd")).first()
    if not got["n"]:
        raise BadSource(f"{series}: no usable value")
    if got["odd"]:
        raise BadSource(f"{series}: implausible rate {got['odd']['rate']} on {got['odd']['date']}")
    if got["days"] < got["n"]:
        raise BadSource(f"{series}: a day is repeated")
    if since and got["first"] > since:
        raise BadSource(f"{series}: begins on {got['first']}, after {since}")
    return df


def load_rate(spark: SparkSession, path: str) -> DataFrame:
    """A saved rate series (date, rate); a missing file fails at once."""
    return require_columns(spark.read.parquet(path), ["date", "rate"], path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file under a schema, or with types from all of its rows; a row that does not fit fails."""
    reader = spark.read.option("header", "true").option("mode", "FAILFAST")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").option("samplingRatio", "1.0").csv(path)


def unzip_one_csv(spark: SparkSession, path: str, out: str) -> str:
    """The single CSV of each archive in ``path``, unpacked by the executors into ``out``; several or none raise."""

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise BadSource(f"{len(members)} CSV files in an archive")
                    rows += z.read(members[0]).decode().removesuffix("\n").split("\n")
            yield pd.DataFrame({"value": rows})

    files = spark.read.format("binaryFile").load(path).select("content")
    files.mapInPandas(unpack, "value string").write.mode("overwrite").text(out)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Filing manifests as they are kept: one JSON object of parallel arrays per file."""
    return spark.read.option("multiLine", "true").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of cached documents, one row each: name, raw. A candidate that was never cached is simply not there."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("raw"))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """A paged table service as a Spark source, one partition per page.

    Options: ``fetch`` (module:function, called with the page number and ``page_size``, returning rows, or None when
    the page failed), ``page_size``, ``max_pages``. A failed page fails the read, so a table is never
    silently short; whether it ended before ``max_pages`` is told by page_status().
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(int(self.options.get("max_pages", 64)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        rows = _loaded(self.options["fetch"])(partition.number, int(self.options.get("page_size", 10_000)))
        if rows is None:
            raise BadSource(f"page {partition.number} failed")
        yield from (tuple(r) for r in rows)


def _loaded(spec: str) -> Callable:
    from importlib import import_module

    module, _, name = spec.partition(":")
    return getattr(import_module(module), name)


def page_status(pages: list[int | None], page_size: int, max_pages: int) -> str:
    """'error' if a page failed, 'truncated_maxpages' if the last allowed page was full, else 'complete'."""
    if any(n is None for n in pages):
        return "error"
    full = len(pages) >= max_pages and pages and pages[-1] is not None and pages[-1] >= page_size
    return "truncated_maxpages" if full else "complete"


def write_bars(df: DataFrame, path: str) -> None:
    """One folder per ticker; tickers are laid together first, so each is a file and not one per task."""
    df.repartition("ticker").write.mode("overwrite").partitionBy("ticker").option("compression", "zstd").parquet(path)
