"""Keep the optimizer from computing an expensive column twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sealed(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with their columns computed once.

    A filter on a derived column is pushed below the projection that derives it, which then happens twice
    per row. Filters do not pass a generator whose output they read. ``keys`` pass beside it, so that rows which are dealt
    by them need not be dealt again.
    """
    rest = [c for c in df.columns if c not in keys] if keys else ["*"]
    rows = df.select(*keys, F.explode_outer(F.array(F.struct(*rest))).alias("_row"))
    return rows.select(*keys, "_row.*")
