"""Continuous periods and gaps of overlapping day intervals.

The aggregate's state is a sorted list of disjoint intervals; states combine by a linear merge. States are built where
the rows lie and combined in a tree: a level merges at most FAN states of an entity, so a hot entity is
spread over many tasks until few short lists are left. Days bound a list to half the days of the calendar, however
many rows there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

STATE = "key string, branch int, starts array<int>, ends array<int>"
#: States of an entity that one task of a level merges.
FAN = 32


def fuse(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, touch: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint form of closed intervals per owner, sorted; those at most ``touch`` days apart become one.

    Owner and start are sorted as one number by a stable merge sort, which joins the sorted runs it is given in linear time.
    Shifting each owner's ends above all of the owner before lets one running maximum serve all owners.
    """
    if not len(starts):
        return owner, starts, ends
    owner, starts, ends = owner.astype(np.int64), starts.astype(np.int64), ends.astype(np.int64)
    wide = np.int64(1) << 33
    o = np.argsort(owner * wide + starts, kind="stable")
    owner, starts = owner[o], starts[o]
    reach = np.maximum.accumulate(owner * wide + ends[o])
    new = np.concatenate([[True], owner[1:] * wide + starts[1:] > np.where(owner[1:] == owner[:-1], reach[:-1] + touch, -(1 << 62))])
    at = np.flatnonzero(new)
    stop = np.append(at[1:] - 1, len(starts) - 1)
    return owner[at], starts[at], reach[stop] - owner[at] * wide


def _states(names: pa.Array, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, branch: int) -> pa.RecordBatch:
    """One row per owner of the sorted intervals; ``names`` are the owners' keys."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays([names.take(pa.array(owner[first])), pa.array(np.full(len(first), branch, np.int32)), *lists], ["key", "branch", "starts", "ends"])


def _build(batches: Iterator[pa.RecordBatch], branches: int, touch: int) -> Iterator[pa.RecordBatch]:
    """One state per entity of each batch."""
    from pyspark import TaskContext

    branch = TaskContext.get().partitionId() % branches
    for b in batches:
        if b.num_rows:
            key = b.column("key").dictionary_encode()
            yield _states(key.dictionary, *fuse(key.indices.to_numpy(), b.column("a").to_numpy(), b.column("b").to_numpy(), touch), branch)


def _combine(batches: Iterator[pa.RecordBatch], touch: int) -> Iterator[pa.RecordBatch]:
    """Merge states of rows sorted by (branch, key). The last entity of a batch waits, merged, for the next one."""
    held: tuple[int, str, np.ndarray, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        branch = b.column("branch").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(branch[1:] != branch[:-1]) + 1, [len(branch)]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = b.slice(low, high - low)
            key, s, e = part.column("key").dictionary_encode(), part.column("starts"), part.column("ends")
            owner = np.repeat(key.indices.to_numpy().astype(np.int64), s.value_lengths().to_numpy())
            starts, ends, names = s.flatten().to_numpy(), e.flatten().to_numpy(), key.dictionary
            if held is not None:
                if (held[0], held[1]) == (int(branch[low]), names[0].as_py()):  # codes follow the order of appearance
                    owner, starts, ends = np.concatenate([np.zeros(len(held[2]), np.int64), owner]), np.concatenate([held[2], starts]), np.concatenate([held[3], ends])
                else:
                    yield _states(pa.array([held[1]]), np.zeros(len(held[2]), np.int64), held[2], held[3], held[0])
            owner, starts, ends = fuse(owner, starts, ends, touch)
            last = int(np.searchsorted(owner, owner[-1]))
            if last:
                yield _states(names, owner[:last], starts[:last], ends[:last], int(branch[low]))
            held = int(branch[low]), names[int(owner[-1])].as_py(), starts[last:], ends[last:]
    if held is not None:
        yield _states(pa.array([held[1]]), np.zeros(len(held[2]), np.int64), held[2], held[3], held[0])


def periods_and_gaps(windows: DataFrame, keys: list[str], first: str = "first", last: str = "last", *, touch: int = 1, fan: int = FAN) -> DataFrame:
    """Periods and gaps per entity: ``keys`` (STRING), piece ('period' or 'gap'), first_day, last_day DATE.

    Intervals are closed. One starting at most ``touch`` days after a period's end belongs to it.
    Rows with a NULL or reversed end, or a NULL key, hold no interval; an entity without intervals
    does not appear. Repeated, nested and equal intervals count once by the nature of the merge.

    The tree has as many levels of arity ``fan`` as the session's parallelism asks for, and the root.
    """
    spark = windows.sparkSession
    names = [F.col(k).cast("string") for k in keys]
    rows = windows.where(F.col(first) <= F.col(last))
    for c in names:
        rows = rows.where(c.isNotNull())
    rows = rows.select(F.to_json(F.array(*names)).alias("key"), F.unix_date(first).alias("a"), F.unix_date(last).alias("b"))
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    branches = fan
    while branches < max(n, spark.sparkContext.defaultParallelism):
        branches *= fan
    leaves = branches
    state = rows.mapInArrow(lambda it: _build(it, leaves, touch), STATE)
    while branches:
        state = state.withColumn("branch", (F.col("branch") % branches).cast("int")).repartition(n, "key", "branch").sortWithinPartitions("branch", "key")
        state = state.mapInArrow(lambda it: _combine(it, touch), STATE)
        branches //= fan
    zipped = F.arrays_zip("starts", "ends")
    inner = F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0)))
    gaps = F.filter(
        F.transform(F.arrays_zip(inner.alias("n"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))).alias("e")), lambda z: F.struct(F.lit("gap").alias("piece"), (z["e"] + 1).alias("a"), (z["n"] - 1).alias("b"))),
        lambda z: z["a"] <= z["b"],
    )
    whole = F.transform(zipped, lambda z: F.struct(F.lit("period").alias("piece"), z["starts"].alias("a"), z["ends"].alias("b")))
    parts = F.from_json("key", "array<string>")
    return state.select(parts.alias("keys"), F.explode(F.concat(whole, gaps)).alias("p")).select(
        *[F.col("keys")[i].alias(k) for i, k in enumerate(keys)],
        F.col("p.piece").alias("piece"),
        F.date_from_unix_date("p.a").alias("first_day"),
        F.date_from_unix_date("p.b").alias("last_day"),
    )
