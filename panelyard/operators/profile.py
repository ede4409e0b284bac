"""Integrity profiles and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integrity(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct and duplicate keys, and nulls and NaNs of each column, in one pass."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"),
        *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns),
        *(F.count_if(F.isnan(c)).alias(f"{c}_nans") for c in numbers),
    )


def checksum_compare(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Sums of both sides, and whether they agree within a relative tolerance; two nulls agree, one doesn't."""
    one, two = (df.agg(*(F.sum(c).alias(f"{c}_{n}") for c in columns)) for df, n in ((a, "a"), (b, "b")))
    a, b = (lambda c, n=n: F.col(f"{c}_{n}") for n in "ab")
    agree = {f"{c}_agrees": F.coalesce(F.abs(a(c) - b(c)) <= tolerance * F.greatest(F.abs(a(c)), F.abs(b(c))), a(c).isNull() & b(c).isNull()) for c in columns}
    return one.crossJoin(F.broadcast(two)).withColumns(agree)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def structural_violations(df: DataFrame, month: str, lat: str, lon: str, values: list[str]) -> DataFrame:
    """Counts of rows that break the grid: nulls, months that don't start on day 1, ranges, off-grid cells."""
    from ..functions.calendar import finite

    off = lambda c: F.col(c) * 2 != F.round(F.col(c) * 2)
    return df.agg(
        F.count_if(F.col(month).isNull() | F.col(lat).isNull() | F.col(lon).isNull()).alias("null_keys"),
        F.count_if(F.day(month) != 1).alias("bad_days"),
        F.count_if((F.abs(F.col(lat)) > 90) | (F.abs(F.col(lon)) > 180)).alias("bad_ranges"),
        F.count_if(off(lat) | off(lon)).alias("off_grid"),
        *(F.count_if(~finite(v)).alias(f"{v}_not_finite") for v in values),
    )
