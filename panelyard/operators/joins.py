"""As-of joins, neighbour stencils and zipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before (``strict``: before) its time.

    Both sides go through one shuffle by key and a running window, so no pair of rows is formed;
    left rows without a match keep nulls. Where right rows tie in time the greatest values win.
    Right rows with a null time are ignored.
    """
    lefts = left.columns
    side, time = "__side", "__time"
    right = right.where(F.col(right_time).isNotNull())
    a = right.select(*on, F.col(right_time).alias(time), F.lit(0).alias(side), F.struct(F.col(right_time).alias(f"{right_time}"), *values).alias("__hit"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lefts if c not in on))
    b = left.withColumn("__hit", F.lit(None).cast(a.schema["__hit"].dataType)).select(*on, F.col(left_time).alias(time), F.lit(1).alias(side), "__hit", *(c for c in lefts if c not in on))
    order = F.col(side).desc() if strict else F.col(side).asc()
    running = W.partitionBy(*on).orderBy(time, order, F.col("__hit").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__hit", ignorenulls=True).over(running)).where(F.col(side) == 1)
    return both.select(*lefts, "__last.*")


def neighbour_means(cells: DataFrame, keys: list[str], values: list[str], step: int = 1, lat: str = "lat2", lon: str = "lon2") -> DataFrame:
    """Means over the four cells ``step`` away, and how many there are, by centre and ``keys``."""
    offsets = F.array(*(F.struct(F.lit(a * step).alias("a"), F.lit(b * step).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    moved = cells.withColumn("d", F.explode(offsets)).withColumns({lat: F.col(lat) - F.col("d.a"), lon: F.col(lon) - F.col("d.b")})
    return moved.groupBy(lat, lon, *keys).agg(*(F.avg(v).alias(f"neighbour_{v}") for v in values), F.count("*").alias("neighbour_count"))


def zip_on_key(tables: dict[str, DataFrame], keys: list[str], value: str = "prediction") -> DataFrame:
    """One column for each table's ``value``; rows without a partner in every table raise."""
    out = None
    for name, t in tables.items():
        part = t.select(*keys, F.col(value).alias(name))
        out = part if out is None else out.join(part, keys, "full")
    whole = F.lit(True)
    for name in tables:
        whole = whole & F.col(name).isNotNull()
    return out.withColumn("__ok", F.when(whole, True).otherwise(F.raise_error(F.lit("tables are not aligned")).cast("boolean"))).where("__ok").drop("__ok")


def merge_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on keys that must be unique on both sides; a repeated key raises when it is read."""

    def unique(df: DataFrame) -> DataFrame:
        once = F.when(F.count("*").over(W.partitionBy(*on)) == 1, True).otherwise(F.raise_error(F.lit("key is not unique")).cast("boolean"))
        return df.withColumn("__once", once).where("__once").drop("__once")

    return unique(left).join(unique(right), on, "left")


def within(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other table has, each once: a semi-join, planned by the keys' size."""
    return rows.join(keys.select(*on), on, "left_semi")


def numbered(rows: DataFrame, bucket: str, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in the order of ``bucket``, then ``order``, without one task for all rows.

    ``bucket`` must not contradict the wanted order (a day of a time, say). Counts of buckets, a small
    table, give each bucket's first number; rows are sorted only within their bucket.
    """
    counts = rows.groupBy(bucket).agg(F.count("*").alias("__n"))
    before = counts.select(F.col(bucket).alias("__b"), (F.sum("__n").over(W.orderBy(F.col(bucket).asc_nulls_first())) - F.col("__n")).alias("__before"))
    inside = rows.withColumn("__i", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    return inside.join(before, F.col(bucket).eqNullSafe(F.col("__b"))).withColumn(name, F.col("__before") + F.col("__i")).drop("__b", "__before", "__i")
