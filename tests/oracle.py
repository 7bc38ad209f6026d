"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def canon(rows: list[tuple]) -> list[tuple]:
    def one(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return repr(v + 0.0)  # exactly: the queries themselves say to how many bits
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].replace("T00:00:00", "")
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def constant(cols: list[str], rows: list[tuple]) -> set[str]:
    """Columns that say nothing: NULL in every row, or one value in all of several rows."""
    seen = {c: {r[i] for r in rows} for i, c in enumerate(cols)}
    return {c for c, v in seen.items() if v == {"~"} or (len(rows) > 1 and len(v) == 1)}


def compare(spark, name: str, fn, sql: str, sf_dir: str, may_be_constant: frozenset[str] = frozenset()) -> tuple[bool, str]:
    """Same columns, same rows, to the last bit; rows there are, and no column is constant unless it may be."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = canon([tuple(r) for r in df.select(*cols).collect()])
    if not got or not constant(cols, got) <= may_be_constant:
        return False, f"{name}: {len(got)} rows, constant {sorted(constant(cols, got) - may_be_constant)}"
    rel = connect(sf_dir).execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = canon([tuple(r[i] for i in order) for r in rel.fetchall()])
    if got == want:
        return True, f"{name}: {len(got)} rows"
    extra, lost = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return False, f"{name}: {len(got)} rows against {len(want)}; only here {extra[:3]}; only there {lost[:3]}"
