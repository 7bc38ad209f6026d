"""Top N items within every group, by a global sort and prefix-summed counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def _changed(col: pa.Array, last: pa.Array | None) -> np.ndarray:
    """True where a value differs from its predecessor (NULL equals NULL, NaN equals NaN)."""
    n = len(col)
    prev = pa.concat_arrays([last if last is not None else col.slice(0, 1), col.slice(0, n - 1)])
    if pa.types.is_floating(col.type):
        a, b = np.asarray(pc.fill_null(col, 0.0)), np.asarray(pc.fill_null(prev, 0.0))
        diff = ~((a == b) | (np.isnan(a) & np.isnan(b)))
    else:
        diff = np.asarray(pc.fill_null(pc.not_equal(col, prev), False))
    diff = diff | (np.asarray(pc.is_null(col)) != np.asarray(pc.is_null(prev)))
    if last is None:
        diff[0] = True
    return diff


def _heads(batches: Iterator[pa.RecordBatch], groups: list[str], item: list[str], n: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group, score, item: the first n of each group with their place in this partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last: dict[str, pa.Array] = {}
    place = 0  # rows of the running group seen so far, repeated ones left out
    for b in batches:
        if not b.num_rows:
            continue
        col = {k: b.column(k) for k in [*groups, *item]}
        fresh = np.zeros(b.num_rows, bool)
        for k in groups:
            fresh |= _changed(col[k], last.get(k))
        new = fresh.copy()
        for k in item:
            new |= _changed(col[k], last.get(k))
        run = np.cumsum(new)
        first = np.maximum.accumulate(np.where(fresh, np.arange(b.num_rows), -1))
        before = np.where(first >= 0, run[np.maximum(first, 0)] - 1, -place)
        at = run - before
        keep = np.flatnonzero(new & (at <= n))
        place = int(at[-1])
        last = {k: v.slice(b.num_rows - 1, 1) for k, v in col.items()}
        if len(keep):
            out = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(np.full(len(keep), part), pa.int32()), pa.array(at[keep], pa.int32())], [*b.schema.names, "__part", "__at"]
            )


def top_n(df: DataFrame, groups: list[str], score: Column | str, item: str, n: int, *, unique_items: bool = True) -> DataFrame:
    """The n items of greatest ``score`` per group, the smaller ``item`` first among equals; adds ``position``.

    The table is range-partitioned and sorted by (group, score, item) as a whole, so a group of
    millions of items lies over several partitions and no task holds it. Each partition passes on
    the first n rows of each of its groups; the counts of the partitions before, summed up, turn a
    place within a partition into the position within the group. Only these heads (n per group and
    partition at most) are shuffled again.

    A NULL or NaN score or a NULL item never counts. A NULL group is a group. Repeated rows count once.
    With ``unique_items`` an item that has several scores counts with its greatest. Smaller groups
    give all they have. Other columns of ``df`` are not kept.
    """
    s = F.col(score) if isinstance(score, str) else score
    base = df.select(*groups, F.col(item).alias("__item"), (s + F.lit(0.0)).alias("__score")).where(
        F.col("__score").isNotNull() & ~F.isnan("__score") & F.col("__item").isNotNull()
    )
    if unique_items:
        # An item's other scores must not take a place: partial maxima first, one row per item goes on.
        base = base.groupBy(*groups, "__item").agg(F.max("__score").alias("__score"))
    order = [*[F.col(g).asc() for g in groups], F.col("__score").desc(), F.col("__item").asc()]
    ship(base.sparkSession)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*laid.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.IntegerType())])
    heads = laid.mapInArrow(lambda it: _heads(it, groups, ["__score", "__item"], n), schema)
    earlier = Window.partitionBy(*groups).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    position = F.count(F.lit(1)).over(earlier) + F.col("__at")
    ranked = heads.withColumn("position", position.cast("int")).where(F.col("position") <= n)
    return ranked.select(*groups, F.col("__item").alias(item), F.col("__score").alias("score"), "position")
