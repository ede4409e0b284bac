"""Horizon expansion and hash-ranked samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C

CELL = ["lat2", "lon2"]


def horizon_candidates(panel: DataFrame, folds: DataFrame, seed: int = 20260904, horizons: int = 7) -> DataFrame:
    """Every fit row at each horizon whose exact source month the panel has, with a selection hash."""
    rows = panel.where("target is not null").join(F.broadcast(folds), F.col("m") <= C.add_months("origin", -1))
    rows = rows.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("source_month", C.add_months("m", 1 - F.col("horizon")))
    source = panel.where("v is not null").select(*CELL, F.col("m").alias("source_month"), F.col("v").alias("last_observed"))
    rows = rows.join(source, [*CELL, "source_month"]).withColumn("target_month", C.target_month("m"))
    key = F.concat_ws("|", F.lit(seed), "fold_id", F.col("target_month").cast("string"), "lat2", "lon2", "horizon")
    return rows.withColumn("selection_hash", F.sha2(key, 256)).withColumn("location_id", C.location_id())


def quota_sample(candidates: DataFrame, quotas: dict[int, int], by: tuple[str, ...] = ("fold_id", "horizon")) -> DataFrame:
    """The first ``quotas[horizon]`` rows of each stratum by hash, with population and weight.

    The rank is cut at the greatest quota first, as a literal, which the window can use to keep no
    more rows than that of each stratum in a task.
    """
    table = candidates.sparkSession.createDataFrame(list(quotas.items()), "horizon int, quota int")
    population = candidates.groupBy(*by).agg(F.count("*").alias("population"))
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("selection_hash", "target_month", "location_id"))).where(F.col("rank") <= max(quotas.values()))
    kept = ranked.join(F.broadcast(table), "horizon").where("rank <= quota").join(population, list(by))
    retained = F.least("population", "quota").cast("bigint")
    return kept.withColumn("retained", retained).withColumn("sample_weight", F.col("population") / F.col("retained"))


def sample_violations(sample: DataFrame) -> DataFrame:
    """Counts that must be 0: duplicates, calendar, provenance and cutoff breaches, non-finite values.

    A condition that a null leaves open is broken.
    """
    key = F.struct("fold_id", *CELL, "target_month", "horizon")
    holds = {
        "bad_calendar": F.col("target_month") == C.target_month("m"),
        "bad_horizon": (C.months_between("source_month", "target_month") == F.col("horizon")) & F.col("horizon").between(1, 7),
        "future_source": F.col("source_month") <= F.col("m"),
        "past_cutoff": F.col("target_month") <= F.col("origin"),
        "non_finite": C.finite("target") & C.finite("last_observed"),
    }
    return sample.agg((F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), *(F.count_if(~F.coalesce(good, F.lit(False))).alias(name) for name, good in holds.items()))


def chronological_split(df: DataFrame, month: str = "m", share: float = 0.8) -> DataFrame:
    """``part`` train or test by the ``share`` of distinct months, in order."""
    months = df.select(month).distinct()
    n = months.count()
    cut = months.orderBy(month).limit(max(1, int(n * share))).agg(F.max(month).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(month) <= F.col("cut"), "train").otherwise("test"))


def hash_subset(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for the same seed at any partitioning: the least hashes of seed and key."""
    return rows.withColumn("selection_hash", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("selection_hash", key).limit(n)
