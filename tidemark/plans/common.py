"""What registered queries share: output form and the SQL that mirrors it.

Two engines add up in different orders, so their doubles differ in the last bits. Both sides give
doubles to 24 significant bits (about seven digits, whatever the size of the number), widen integers and
show days as DATE, so a value has one form in either engine. What is below TINY is the
residue of a cancelled sum and stands for 0. Operators themselves never round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TINY = 1e-12


def out(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.abs(c) < TINY, F.lit(0.0)).otherwise(c.cast("float").cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql_out(sql: str, doubles: str = "", longs: str = "") -> str:
    """``sql`` (a WITH query ending in its final SELECT) with doubles in 24 bits and integers widened."""
    short = "case when abs({c}) < {t} then 0.0 else cast(cast(cast({c} as double) as float) as double) end as {c}"
    parts = [short.format(c=c, t=TINY) for c in doubles.split()] + [f"cast({c} as bigint) as {c}" for c in longs.split()]
    return f"select * replace ({', '.join(parts)}) from ({sql})" if parts else sql
