"""Attributes as they were known at event time, by bitemporal rectangles.

Every record has a *valid day* (from when it describes the world) and a *recorded day*
(from when it could be read). At the point (v, r) the current record is, among those
recorded by r and valid by v, the one with the greatest valid day. Inserting the records
in the order they were recorded cuts the plane into disjoint rectangles: a new record
closes the rectangle of its predecessor at its recorded day, reopens that one up to its own
valid day and opens its own up to the next valid day. So n records give at most 2n
rectangles, and a point lies in at most one.

Rectangles are put into a square grid of days; a point needs one grid cell.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

FAR = 2_000_000  # a day number beyond every calendar; marks an open side


def _sweep(v: np.ndarray, r: np.ndarray, at: int) -> list[tuple[int, int, int, int, int]]:
    """Rectangles (row, v_from, v_to, r_from, r_to) of one entity whose valid days do not just rise; rows count from ``at``."""
    valid: list[int] = []  # sorted valid days now current
    live: list[tuple[int, int]] = []  # (row, opened at recorded day), beside ``valid``
    out = []

    def emit(i: int, until: int) -> None:
        row, since = live[i]
        if since < until:
            out.append((row, valid[i], valid[i + 1] if i + 1 < len(valid) else FAR, since, until))

    for k, (x, y) in enumerate(zip(v.tolist(), r.tolist(), strict=True), at):
        i = bisect_left(valid, x)
        if i < len(valid) and valid[i] == x:  # a restatement takes the same valid span over
            emit(i, y)
            live[i] = (k, y)
            continue
        if i:
            emit(i - 1, y)
            live[i - 1] = (live[i - 1][0], y)
        valid.insert(i, x)
        live.insert(i, (k, y))
    for i in range(len(valid)):
        emit(i, FAR)
    return out


def _cut_up(b: pa.RecordBatch) -> pa.RecordBatch:
    """Rectangles of whole entities sorted by (entity, recorded, valid).

    Where an entity's records come in the order of their valid days, as nearly all do, the two rectangles of
    each are read off its successor, for all such entities at once: open to the right until the successor is recorded, then
    up to the successor's valid day. Entities with late or restated records are swept one by one.
    """
    e, v, r = (b.column(k).to_numpy().astype(np.int64) for k in ("entity", "v", "r"))
    n = len(e)
    first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    size = np.diff(np.append(first, n))
    last = np.zeros(n, bool)
    last[first + size - 1] = True
    falls = np.zeros(n, bool)
    falls[1:] = (v[1:] <= v[:-1]) & ~last[:-1]
    mixed = np.logical_or.reduceat(falls, first)
    plain = ~np.repeat(mixed, size)
    nv, nr = np.append(v[1:], FAR), np.append(r[1:], FAR)
    nv, nr = np.where(last, FAR, nv), np.where(last, FAR, nr)
    rows = np.arange(n)
    one, two = plain & (r < nr), plain & ~last
    far = np.full(n, FAR)
    parts = [np.stack([rows, v, far, r, nr])[:, one], np.stack([rows, v, nv, nr, far])[:, two]]
    swept = [x for k in np.flatnonzero(mixed) for x in _sweep(v[first[k] : first[k] + size[k]], r[first[k] : first[k] + size[k]], int(first[k]))]
    if swept:
        parts.append(np.array(swept, np.int64).T)
    row, *sides = np.concatenate(parts, axis=1)
    names = [c for c in b.schema.names if c not in ("v", "r")]
    kept = [b.column(c).take(pa.array(row)) for c in names]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(x.astype(np.int32)) for x in sides]], [*names, "v_from", "v_to", "r_from", "r_to"])


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where an entity ends; the rest waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        e = b.column("entity").to_numpy()
        cut = int(np.searchsorted(e, e[-1]))  # sorted: where the last entity begins
        if cut or (held and held[-1].column("entity")[-1].as_py() != e[0]):
            done = [*held, b.slice(0, cut)] if cut else held
            yield _cut_up(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield _cut_up(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def rectangles(records: DataFrame, entity: str, valid: str, recorded: str, record: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint current-version rectangles of a record table.

    Columns out: entity, record BIGINT, the ``carry`` columns; v_from, v_to, r_from, r_to INT day numbers, half open.
    Rows with a NULL in any of the four named columns describe nothing and are left out. Repeated
    rows and rows equal in (entity, valid, recorded) are reduced to the greatest record id
    before the shuffle, so an entity sends one row per pair of days, however many rows it has.
    """
    rows = (
        records.select(
            F.col(entity).cast("long").alias("entity"),
            F.unix_date(valid).alias("v"),
            F.unix_date(recorded).alias("r"),
            F.struct(F.col(record).cast("long").alias("record"), *carry).alias("x"),
        )
        .where("entity is not null and v is not null and r is not null and x.record is not null")
        .groupBy("entity", "v", "r")
        .agg(F.max("x").alias("x"))
        .select("entity", "v", "r", "x.*")
    )
    ship(records.sparkSession)
    ordered = rows.repartition("entity").sortWithinPartitions("entity", "r", "v")
    out = ordered.drop("v", "r").select("*", *[F.lit(0).alias(c) for c in ("v_from", "v_to", "r_from", "r_to")]).schema
    return ordered.mapInArrow(_rectangles, out)


def _cells(batches: Iterator[pa.RecordBatch], cell: int, lag_min: int, lag_max: int) -> Iterator[pa.RecordBatch]:
    """Grid cells of each rectangle that a point with r - v in [lag_min, lag_max] can lie in."""

    def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which range, and which cell of it, for every cell of the ranges [low, high]."""
        n = np.maximum(high // cell - low // cell + 1, 0)
        which = np.repeat(np.arange(len(n)), n)
        return which, np.repeat(low // cell, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

    for b in batches:
        v0, v1, r0, r1 = (b.column(k).to_numpy().astype(np.int64) for k in ("v_from", "v_to", "r_from", "r_to"))
        # clip the open sides to the band first: v in [r0 - lag_max, r1 - 1 - lag_min] and so on
        a, z = np.maximum(v0, r0 - lag_max), np.minimum(v1 - 1, r1 - 1 - lag_min)
        i = np.flatnonzero(a <= z)
        which, cv = spread(a[i], z[i])
        i = i[which]
        low, high = np.maximum(a[i], cv * cell), np.minimum(z[i], cv * cell + cell - 1)
        which, cr = spread(np.maximum(r0[i], low + lag_min), np.minimum(r1[i] - 1, high + lag_max))
        if len(which):
            part = b.take(pa.array(i[which]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cv[which].astype(np.int32)), pa.array(cr.astype(np.int32))], [*b.schema.names, "cv", "cr"])


def locate(
    events: DataFrame,
    records: DataFrame,
    *,
    entity: str,
    event_valid: Column,
    event_recorded: Column,
    valid: str,
    recorded: str,
    record: str,
    carry: tuple[str, ...] = (),
    how: str = "inner",
    max_age: int | None = None,
    cell_days: int = 128,
) -> DataFrame:
    """Each event with the record current at its point (``event_valid``, ``event_recorded``).

    Adds ``record``, ``record_valid`` (the record's valid day) and the ``carry`` columns of the record. ``max_age`` drops
    records whose valid day lies more than so many days before the event's. Events with a NULL entity or day, or
    without a current record, give no row (``how='inner'``) or NULLs ('left'). Repeated events stay repeated. Event columns
    of an added name are replaced.

    Rectangles open to the future are clipped to the band of delays that the events really have
    (one small aggregate), so a rectangle meets few cells. Both sides are joined on
    (entity, cell, cell), which also spreads a hot entity over the calendar.
    """
    own = [c for c in events.columns if c not in ("record", "record_valid", *carry)]
    ev = events.select(*own, F.col(entity).cast("long").alias("__e"), F.unix_date(event_valid).alias("__v"), F.unix_date(event_recorded).alias("__r"))
    known = ev.where("__e is not null and __v is not null and __r is not null")
    lo, hi, v_min, v_max = known.agg(F.min(F.expr("__r - __v")), F.max(F.expr("__r - __v")), F.min("__v"), F.max("__v")).first()
    if lo is None:
        lo = hi = v_min = v_max = 0
    rect = rectangles(records, entity, valid, recorded, record, carry)
    start = F.col("v_from")
    rect = rect.withColumns(
        {
            "v_to": F.least("v_to", F.lit(v_max + 1), *([] if max_age is None else [start + (max_age + 1)])),
            "r_to": F.least("r_to", F.lit(v_max + hi + 1)),
        }
    ).where((F.col("v_to") > F.greatest(start, F.lit(v_min))) & (F.col("r_to") > F.col("r_from")))

    # v_from is needed whole for the answer, so the clipped start is a column of its own
    rect = rect.withColumns({"record_from": start, "v_from": F.greatest(start, F.lit(v_min)), "r_from": F.greatest("r_from", F.lit(v_min + lo))})
    out = rect.select("*", F.lit(0).alias("cv"), F.lit(0).alias("cr")).schema
    cells = rect.mapInArrow(lambda it: _cells(it, cell_days, lo, hi), out)
    grid = lambda c: F.floor(F.col(c) / cell_days).cast("int")
    points = (ev if how == "left" else known).withColumns({"__cv": grid("__v"), "__cr": grid("__r")})
    c = cells.select(*[F.col(x).alias(f"__c_{x}") for x in cells.columns])
    hit = points.join(
        c,
        (F.col("__e") == F.col("__c_entity"))
        & (F.col("__cv") == F.col("__c_cv"))
        & (F.col("__cr") == F.col("__c_cr"))
        & (F.col("__v") >= F.col("__c_v_from"))
        & (F.col("__v") < F.col("__c_v_to"))
        & (F.col("__r") >= F.col("__c_r_from"))
        & (F.col("__r") < F.col("__c_r_to")),
        how,
    )
    return hit.select(*own, F.col("__c_record").alias("record"), F.date_from_unix_date("__c_record_from").alias("record_valid"), *[F.col(f"__c_{x}").alias(x) for x in carry])
