"""Cross-sectional screens, scores and deciles. Everything is within a date (or any group)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known, ratio
from ..schemas import require_columns

WINSOR_SD = 3.0  # fixed value
DECILES = 10  # fixed value


@dataclass(frozen=True)
class Band:
    """A screen: closed ranges per column and allowed values per column."""

    name: str
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    members: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def with_floors(self, **floors: float) -> Band:
        """The same band with other lower bounds."""
        ranges = {**self.ranges, **{c: (low, self.ranges.get(c, (None, None))[1]) for c, low in floors.items()}}
        return replace(self, ranges=ranges)


def _flags(band: Band) -> dict[str, Column]:
    out = {}
    for c, (low, high) in band.ranges.items():
        cond = F.lit(True)
        if low is not None:
            cond = cond & (F.col(c) >= low)
        if high is not None:
            cond = cond & (F.col(c) <= high)
        out[f"{c}_ok"] = known(cond & F.col(c).isNotNull())
    for c, values in band.members.items():
        out[f"{c}_ok"] = known(F.col(c).isin(*values))
    return out


def screen(df: DataFrame, band: Band) -> DataFrame:
    """+ a flag per condition and ``eligible``. A NULL fails its condition; no row is dropped."""
    require_columns(df, [*band.ranges, *band.members], "screened table")
    flags = _flags(band)
    every = F.lit(True)
    for f in flags.values():
        every = every & f
    return df.withColumns({**flags, "eligible": every})


def screen_grid(df: DataFrame, bands: list[Band]) -> DataFrame:
    """Eligibility under several bands at once: + band, eligible. The rows are read once."""
    each = F.array(*[F.struct(F.lit(b.name).alias("band"), _all(b).alias("eligible")) for b in bands])
    return df.withColumn("__b", F.explode(each)).select(*df.columns, "__b.band", "__b.eligible")


def _all(band: Band) -> Column:
    every = F.lit(True)
    for f in _flags(band).values():
        every = every & f
    return every


def funnel(screened: DataFrame, by: str) -> DataFrame:
    """Candidates per group and how many pass each flag."""
    flags = [c for c in screened.columns if c.endswith("_ok")] + ["eligible"]
    return screened.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"), *[F.sum(F.col(c).cast("int")).cast("long").alias(f"n_{c}") for c in flags])


def winsor_z(values: dict[str, Column], by: Window, where: Column | None = None, sd: float = WINSOR_SD):
    """Two steps of expressions that clip at ``sd`` deviations and standardise, within ``by``.

    Returns a function DataFrame -> DataFrame adding one column per name. Population moments; a
    constant group gives 0; NULL stays NULL; with ``where`` only those rows enter and get a value.
    All names are computed in the same two window passes.
    """

    def run(df: DataFrame) -> DataFrame:
        # floats fed to the windows as one column each, so Catalyst shares partitioning and sort
        raw = {f"__x_{k}": (F.when(where, v) if where is not None else v) for k, v in values.items()}
        df = df.withColumns(raw)
        df = df.withColumns({f"__m_{k}": F.avg(f"__x_{k}").over(by) for k in values} | {f"__s_{k}": F.stddev_pop(f"__x_{k}").over(by) for k in values})
        clipped = {}
        for k in values:
            x, m, s = F.col(f"__x_{k}"), F.col(f"__m_{k}"), F.col(f"__s_{k}")
            clipped[f"__c_{k}"] = F.when(x.isNotNull(), F.greatest(m - sd * s, F.least(m + sd * s, x)))
        df = df.withColumns(clipped)
        df = df.withColumns({f"__m_{k}": F.avg(f"__c_{k}").over(by) for k in values} | {f"__s_{k}": F.stddev_pop(f"__c_{k}").over(by) for k in values})
        z = {}
        for k in values:
            c, m, s = F.col(f"__c_{k}"), F.col(f"__m_{k}"), F.col(f"__s_{k}")
            # a deviation that is only rounding noise counts as none
            flat = s <= 1e-14 * F.greatest(F.abs(m), F.lit(1.0))
            z[k] = F.when(c.isNotNull(), F.when(flat, F.lit(0.0)).otherwise((c - m) / F.nullif(s, F.lit(0.0))))
        df = df.withColumns(z)
        return df.drop(*[f"__{p}_{k}" for p in "xmsc" for k in values])

    return run


def decile_of_rank(rank: Column, n: Column, buckets: int = DECILES) -> Column:
    """Bucket of a first-rank under equal-width rank quantiles, in integer arithmetic; NULL below ``buckets`` rows."""
    r, m = rank - 1, n - 1
    up = F.floor((r * buckets + m - 1) / F.nullif(m, F.lit(0))).cast("int")
    return F.when(n >= buckets, F.greatest(up, F.lit(1)))


def deciles(df: DataFrame, by: list[str], score: str, item: str, buckets: int = DECILES, out: str = "decile") -> DataFrame:
    """+ ``out``: bucket of the non-NULL scores within ``by``, ties told apart by ``item``."""
    has = F.col(score).isNotNull()
    part = Window.partitionBy(*by, has)
    rank = F.row_number().over(part.orderBy(score, item))
    n = F.count(F.lit(1)).over(part)
    return df.withColumn(out, F.when(has, decile_of_rank(rank, n, buckets)))


FACTORS = ("momentum", "value", "quality", "lowvol", "size")


def factor_scores(panel: DataFrame, by: str | list[str] = "day", item: str = "permaticker") -> DataFrame:
    """Five standardised factors, composite, ranked flag and decile, within ``by``.

    momentum z(mom); value z of the mean of z(eps/close) and z(bvps/close); quality z(gp/assets); lowvol
    z(-vol); size z(-ln marketcap). Zero denominators give NULL. ``ranked`` needs all five; the
    composite is their mean. Both stages of z-scores share one partitioning: one shuffle.
    """
    by = [by] if isinstance(by, str) else by
    require_columns(panel, [*by, item, "mom", "eps", "bvps", "gp", "assets", "vol", "marketcap", "close"], "panel")
    w = Window.partitionBy(*by)
    first = {
        "momentum": F.col("mom"),
        "__ep": ratio(F.col("eps"), F.col("close")),
        "__bp": ratio(F.col("bvps"), F.col("close")),
        "quality": ratio(F.col("gp"), F.col("assets")),
        "lowvol": -F.col("vol"),
        "size": -F.ln(F.when(F.col("marketcap") > 0, F.col("marketcap"))),
    }
    df = winsor_z(first, w)(panel)
    df = winsor_z({"value": (F.col("__ep") + F.col("__bp")) / 2}, w)(df).drop("__ep", "__bp")
    every = F.lit(True)
    total = F.lit(0.0)
    for f in FACTORS:
        every = every & F.col(f).isNotNull()
        total = total + F.col(f)
    df = df.withColumns({"ranked": every, "composite": F.when(every, total / len(FACTORS))})
    return deciles(df, by, "composite", item)


def normalize_within(df: DataFrame, by: str, columns: list[str], only: str = "ranked") -> DataFrame:
    """+ z_<column> among the rows where ``only`` holds; other rows get NULL and do not enter the moments."""
    return winsor_z({f"z_{c}": F.col(c) for c in columns}, Window.partitionBy(by), known(F.col(only)))(df)


def design_matrix(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Ranked rows only, keys and the columns that exist."""
    return df.where(known(F.col("ranked"))).select(*keys, *[c for c in columns if c in df.columns])


def ranking_coverage(scores: DataFrame, by: str) -> DataFrame:
    n = F.count(F.lit(1))
    ranked = F.sum(F.col("ranked").cast("int")).cast("long")
    return scores.groupBy(by).agg(n.alias("eligible"), ranked.alias("ranked"), (n - ranked).alias("dropped"))
