"""Joins against a unique key when one key may dominate the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many keys are treated as heavy, so what is broadcast is bounded
# by this many rows however large the tables are.
HEAVY_KEYS = 1024
# Keys below this count never need special treatment.
HEAVY_MIN_ROWS = 100_000


def heavy_keys(df: DataFrame, key: str, min_rows: int = HEAVY_MIN_ROWS) -> DataFrame:
    """The most frequent keys; counted with map-side aggregation."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_rows)
        .orderBy(F.desc("n"), key)
        .limit(HEAVY_KEYS)
        .select(key)
    )


def join_unique(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", min_rows: int = HEAVY_MIN_ROWS
) -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique (inner or left_semi).

    Without heavy keys this is a plain join.  Otherwise rows with a heavy key
    meet a broadcast of at most ``HEAVY_KEYS`` right rows and are not shuffled;
    the rest is shuffled by key, where no key is more frequent than the rarest
    heavy one.  The union of both is the full join.  ``left`` is read several
    times, so pass a materialized table.
    """
    keys = heavy_keys(left, key, min_rows).collect()
    if not keys:
        return left.join(right, key, how)
    heavy = F.broadcast(left.sparkSession.createDataFrame(keys))
    heavy_right = F.broadcast(right.join(heavy, key, "left_semi"))
    split = left.join(heavy, key, "left_semi").join(heavy_right, key, how)
    rest = left.join(heavy, key, "left_anti").join(right, key, how)
    return split.unionByName(rest)
