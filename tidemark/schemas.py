"""Column contracts checked at every boundary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, need: Iterable[str], what: str = "input") -> DataFrame:
    gone = [c for c in need if c not in df.columns]
    if gone:
        raise MissingColumns(f"{what} lacks {', '.join(gone)}")
    return df
