"""A buffered, capacity-limited portfolio whose holdings depend on the ones before.

Weights have a closed form and stay in the JVM. Which names are held is order-dependent, so one
grouped fold per scenario walks the dates; its input is already cut to the names that
can matter (held or buyable), and scenarios run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BookParams:
    """Fixed values of the portfolio design."""

    target_n: int = 75
    buy: int = 10
    hold: int = 8
    every: int = 3
    max_weight: float = 0.03
    adv_multiple: float = 10.0


# Half-spreads in basis points by size tier, impact, commission, tier limits in $M.
HALF_SPREAD = {"liquid": 10.0, "micro": 50.0, "nano": 150.0}
IMPACT_BPS, COMMISSION_BPS = 100.0, 1.0
NANO_BELOW, MICRO_BELOW = 50.0, 300.0


def size_tier(cap: Column) -> Column:
    """nano, micro or liquid by market value; an unknown value is liquid."""
    return F.when(cap < NANO_BELOW, "nano").when(cap < MICRO_BELOW, "micro").otherwise("liquid")


def half_spread(tier: Column) -> Column:
    return F.when(tier == "nano", HALF_SPREAD["nano"]).when(tier == "micro", HALF_SPREAD["micro"]).otherwise(HALF_SPREAD["liquid"])


def side_cost_bps(participation: Column, spread: Column, scale: Column | float = 1.0) -> Column:
    """Half-spread, square-root impact and commission of one side, in basis points."""
    return (spread + IMPACT_BPS * F.sqrt(F.greatest(participation, F.lit(0.0))) + COMMISSION_BPS) * scale


def water_fill(df: DataFrame, by: list[str], item: str, dollar_volume: str, aum: Column, p: BookParams = BookParams()) -> DataFrame:
    """+ weight: equal shares poured over names, none above its cap, the total at most 1.

    A name's cap is the smaller of ``max_weight`` and its capacity at this ``aum``; a missing volume has
    none. With the caps in order, the level is where the rest shared equally first fits under the next cap:
    one sort per group and prefix sums.
    """
    cap = F.greatest(F.lit(0.0), F.least(F.lit(p.max_weight), p.adv_multiple * F.coalesce(F.col(dollar_volume), F.lit(0.0)) / aum))
    part = Window.partitionBy(*by)
    line = part.orderBy("__cap", item)
    df = df.withColumn("__cap", cap)
    df = df.withColumns(
        {"__n": F.count(F.lit(1)).over(part), "__r": F.row_number().over(line), "__below": F.sum("__cap").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cap"), "__all": F.sum("__cap").over(part)}
    )
    share = (1.0 - F.col("__below")) / (F.col("__n") - F.col("__r") + 1)
    # the first share that a cap exceeds is the level; what follows it only falls, so it is their greatest
    df = df.withColumn("__level", F.max(F.when(F.col("__cap") >= share, share)).over(part))
    weight = F.when(F.col("__all") <= 1.0, F.col("__cap")).otherwise(F.least("__cap", F.coalesce("__level", F.col("__cap"))))
    return df.withColumn("weight", weight).drop("__cap", "__n", "__r", "__below", "__all", "__level")


def fill_exact(caps: np.ndarray) -> np.ndarray:
    """The same weights for one array of caps."""
    if caps.sum() <= 1.0:
        return caps.copy()
    o = np.sort(caps)
    share = (1.0 - (np.cumsum(o) - o)) / (len(o) - np.arange(len(o)))
    return np.minimum(caps, share[np.argmax(o >= share)])


BOOK_SCHEMA = (
    "scenario string, day date, rebalanced boolean, held int, invested double, gross double, turnover double, cost double, net double, "
    "part_mean double, part_max double, valid int, missing int, delisted int"
)


def _spread(cap: np.ndarray) -> np.ndarray:
    return np.where(cap < NANO_BELOW, HALF_SPREAD["nano"], np.where(cap < MICRO_BELOW, HALF_SPREAD["micro"], HALF_SPREAD["liquid"]))


def _walk(days: list, slices: list, n: int, aum: float, scale: float, p: BookParams) -> list[tuple]:
    """One setting's way through the dates; ``slices`` hold the names of a date and their columns."""
    w, out = np.zeros(n), []
    for k, (day, (at, c)) in enumerate(zip(days, slices, strict=True)):
        turnover = cost = 0.0
        parts = np.zeros(0)
        if k % p.every == 0:
            held = w[at] > 0
            kept = held & (c["decile"] >= p.hold)
            fresh = np.flatnonzero(~kept & (c["decile"] >= p.buy))
            best = fresh[np.argsort(-np.nan_to_num(c["composite"][fresh], nan=-np.inf), kind="stable")][: max(0, p.target_n - int(kept.sum()))]
            chosen = np.concatenate([np.flatnonzero(kept), best])
            new = np.zeros(n)
            if len(chosen):
                new[at[chosen]] = fill_exact(np.clip(p.adv_multiple * np.nan_to_num(c["dollarvol"][chosen]) / aum, 0.0, p.max_weight))
            turnover = float(np.abs(new - w).sum())
            # a name that left the panel costs nothing here; one without volume or value trades at no participation
            delta, size = np.abs(new - w)[at], np.maximum(w, new)[at] * aum
            known = (c["dollarvol"] > 0) & ~np.isnan(c["marketcap"])
            part = np.divide(size, c["dollarvol"], out=np.zeros(len(at)), where=known)
            cost = float((delta * (_spread(np.nan_to_num(c["marketcap"])) + IMPACT_BPS * np.sqrt(part) + COMMISSION_BPS) * scale).sum() / 1e4)
            parts, w = part[delta > 0], new
        mine, seen = w[at] > 0, ~np.isnan(c["ret"])
        n_held, valid = int((w > 0).sum()), int((mine & seen).sum())
        gross = float((w[at] * np.nan_to_num(c["ret"])).sum())
        delisted = int((mine & seen & (c["gone"] > 0)).sum())
        figures = (float(parts.mean()), float(parts.max())) if len(parts) else (None, None)
        out.append((day, k % p.every == 0, n_held, float(w.sum()), gross, turnover, cost, gross - cost, *figures, valid, n_held - valid, delisted))
    return out


def _fold(pdf: pd.DataFrame, p: BookParams, settings: list[tuple[float, float]]) -> pd.DataFrame:
    """All settings of one group. Names are numbered and dates cut once; a book is one array over those numbers."""
    pdf = pdf.sort_values(["day", "item"], kind="stable")
    names, code = np.unique(pdf["item"].to_numpy(), return_inverse=True)
    col = {c: pdf[c].to_numpy(float) for c in ("decile", "composite", "ret", "dollarvol", "marketcap", "gone")}
    day = pdf["day"].to_numpy()
    bounds = np.flatnonzero(np.concatenate([[True], day[1:] != day[:-1], [True]]))
    cuts = [slice(a, z) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    days, slices = [day[c.start] for c in cuts], [(code[c], {k: v[c] for k, v in col.items()}) for c in cuts]
    g = pdf["g"].iloc[0]
    rows = [(f"{g}|{int(aum)}|{scale:.1f}", *r) for aum, scale in settings for r in _walk(days, slices, len(names), aum, scale, p)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BOOK_SCHEMA.split(", ")])


def buffered_book(panel: DataFrame, aums: tuple[float, ...] = (5e5,), scales: tuple[float, ...] = (1.0,), p: BookParams = BookParams(), group: str | None = None) -> DataFrame:
    """Monthly book per scenario (``group``|AUM|cost scale): see BOOK_SCHEMA.

    Every ``every``-th date: names held with a decile of ``hold`` or more stay, the best of ``buy`` or more
    fill up to ``target_n``, all are reweighted. Between, weights stand. A missing or absent return
    counts 0. ``panel`` has day, item, decile, composite, ret, dollarvol, marketcap and, if known, fwd_status; of repeated
    (day, item) rows the greatest counts. Only items that can be bought at some date take part, since no other row
    can touch the book; a group's rows are sent once and every AUM and scale is walked over them.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit("-")) if group else F.lit("all")
    gone = F.coalesce(F.col("fwd_status") == "delisted_partial", F.lit(False)) if "fwd_status" in panel.columns else F.lit(False)
    body = F.struct("decile", "composite", "ret", "dollarvol", "marketcap", gone.cast("double").alias("gone"))
    one = panel.select(name.alias("g"), "day", "item", body.alias("b")).where("day is not null and item is not null").groupBy("g", "day", "item").agg(F.max("b").alias("b"))
    can = F.max(F.col("b.decile") >= p.buy).over(Window.partitionBy("g", "item"))
    days = one.select("g", "day").distinct()
    one = one.withColumn("__can", can).where("__can").drop("__can")
    # a date on which nobody can be held still is a date of the walk
    rows = days.join(one, ["g", "day"], "left").select("g", "day", F.coalesce("item", F.lit(-1)).alias("item"), "b.*")
    settings = [(float(a), float(s)) for a in aums for s in scales]
    return rows.groupBy("g").applyInPandas(lambda pdf: _fold(pdf, p, settings), BOOK_SCHEMA)


def book_diagnostics(book: DataFrame) -> DataFrame:
    """Per scenario: months, rebalances, turnover over all months and over rebalances, median names, invested share, mean and greatest participation, delisted and missing name-months."""
    total = lambda c: F.sum(c).cast("long")
    return book.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("months"),
        total(F.col("rebalanced").cast("int")).alias("rebalances"),
        F.avg("turnover").alias("mean_turnover"),
        F.avg(F.when(F.col("rebalanced"), F.col("turnover"))).alias("mean_turnover_rebalanced"),
        F.floor(F.median("held")).cast("int").alias("median_held"),
        F.avg("invested").alias("mean_invested"),
        F.avg("part_mean").alias("mean_participation"),
        F.max("part_max").alias("max_participation"),
        F.max("cost").alias("max_cost"),
        total(F.col("delisted")).alias("delisted"),
        total(F.col("missing")).alias("missing"),
    )
