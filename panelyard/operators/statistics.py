"""Group statistics, fallback baselines and climatologies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C

CELL = ["lat2", "lon2"]
#: Baselines and the stages they fall back on.
CHAINS = {
    "global_mean": ("global_mean",),
    "location_mean": ("location_mean", "global_mean"),
    "location_calendar_month_climatology": ("location_calendar_month_climatology", "location_mean", "global_mean"),
    "persistence": ("persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
    "seasonal_naive": ("seasonal_naive", "persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
    "location_trend_seasonal": ("location_trend_seasonal", "seasonal_naive", "persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
}


def fitted(fit: DataFrame) -> dict[str, DataFrame]:
    """Statistics of the fit rows by fold: overall, cell, cell and calendar month, trend, seasonal rest."""
    rows = fit.withColumns({"cal": F.month(C.target_month("m")), "t": C.months_since_epoch(C.target_month("m"))})
    trend = rows.groupBy("fold_id", *CELL).agg(F.regr_slope("target", "t").alias("slope"), F.regr_intercept("target", "t").alias("intercept"), F.count_distinct("t").alias("n_t")).where("n_t > 1").drop("n_t")
    rest = rows.join(trend, ["fold_id", *CELL]).groupBy("fold_id", *CELL, "cal").agg(F.avg(F.col("target") - F.col("intercept") - F.col("slope") * F.col("t")).alias("seasonal_rest"))
    return {
        "overall": rows.groupBy("fold_id").agg(F.avg("target").alias("global_mean")),
        "cell": rows.groupBy("fold_id", *CELL).agg(F.avg("target").alias("location_mean")),
        "climatology": rows.groupBy("fold_id", *CELL, "cal").agg(F.avg("target").alias("location_calendar_month_climatology")),
        "trend": trend,
        "seasonal": rest,
    }


def candidates(retained: DataFrame, panel: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """All stages' values beside each retained row.

    Statistics join by their keys (small sides are broadcast by size, at run time). The seasonal
    value is the panel's at the target month a year before, if that is not after the input.
    """
    out = retained.withColumn("cal", F.month("target_month"))
    out = out.join(stats["overall"], "fold_id", "left").join(stats["cell"], ["fold_id", *CELL], "left")
    out = out.join(stats["climatology"], ["fold_id", *CELL, "cal"], "left").join(stats["trend"], ["fold_id", *CELL], "left").join(stats["seasonal"], ["fold_id", *CELL, "cal"], "left")
    at = panel.select(*CELL, F.col("m").alias("last_observed_month"), F.col("v").alias("persistence"))
    year = panel.select(*CELL, C.add_months("m", 12).alias("target_month"), F.col("v").alias("seasonal_naive"))
    out = out.join(at, [*CELL, "last_observed_month"], "left").join(year, [*CELL, "target_month"], "left")
    line = F.col("intercept") + F.col("slope") * C.months_since_epoch("target_month") + F.col("seasonal_rest")
    return out.withColumn("location_trend_seasonal", line)


def baseline(rows: DataFrame, name: str) -> DataFrame:
    """Prediction of a baseline by its chain, with level, stage and reason."""
    return rows.withColumns(C.first_available({s: F.col(s) for s in CHAINS[name]})).withColumn("model_name", F.lit(name))


def reference_levels(events: DataFrame, value: str, month: str = "cal") -> DataFrame:
    """Means of distinct events at four levels: cell and month, cell, month, all."""
    sets = events.distinct().groupingSets([[*CELL, month], CELL, [month], []], *CELL, month)
    level = F.when(F.grouping_id() == 0, 0).when(F.grouping_id() == 1, 1).when(F.grouping_id() == 6, 2).otherwise(3)
    return sets.agg(level.cast("int").alias("reference_level"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def with_reference(rows: DataFrame, levels: DataFrame, month: str = "cal") -> DataFrame:
    """``rows`` with the finest level's mean that exists, and its number."""
    out = rows
    keys = ([*CELL, month], CELL, [month], [])
    for i, on in enumerate(keys):
        part = levels.where(F.col("reference_level") == i).select(*on, F.col("mean").alias(f"mean_{i}"))
        out = out.join(part, on, "left") if on else out.crossJoin(F.broadcast(part))
    found = C.first_available({str(i): F.col(f"mean_{i}") for i in range(4)})
    return out.withColumns({"reference": found["prediction"], "reference_level": F.coalesce(found["fallback_level"], F.lit(3))}).drop(*(f"mean_{i}" for i in range(4)))


def change_climatology(examples: DataFrame, lat: Column | None = None) -> dict[str, DataFrame]:
    """Mean change from last observation to target, by source and target month: of cells, bands, all."""
    rows = examples.withColumns({"source_cal": F.month("source_month"), "target_cal": F.month("target_month"), "band": C.wide_band(lat if lat is not None else F.col("lat2") / 2), "change": F.col("target") - F.col("last_observed")})
    by = ["fold_id", "source_cal", "target_cal"]
    return {
        "cell": rows.groupBy(*by, *CELL).agg(F.avg("change").alias("cell_change"), F.count("*").alias("n")),
        "band": rows.groupBy(*by, "band").agg(F.avg("change").alias("band_change")),
        "all": rows.groupBy(*by).agg(F.avg("change").alias("all_change")),
    }


def seasonal_anchor(rows: DataFrame, climatology: dict[str, DataFrame], lat: Column | None = None) -> DataFrame:
    """Last observation plus the climatological change, by cell, band, all, or else none."""
    out = rows.withColumns({"source_cal": F.month("last_observed_month"), "target_cal": F.month("target_month"), "band": C.wide_band(lat if lat is not None else F.col("lat2") / 2)})
    by = ["fold_id", "source_cal", "target_cal"]
    out = out.join(climatology["cell"].drop("n"), [*by, *CELL], "left").join(climatology["band"], [*by, "band"], "left").join(climatology["all"], by, "left")
    found = C.first_available({"cell": F.col("cell_change"), "band": F.col("band_change"), "all": F.col("all_change"), "none": F.lit(0.0)})
    return out.withColumns({"change": found["prediction"], "anchor_level": found["fallback_level"], "anchor": F.col("last_observed") + found["prediction"]})


def resolve_fallback(chain: list[str], values: dict[str, float | None]) -> tuple[float, int, str]:
    """Value, level and stage of the first stage that has a value; a stage without one is passed, NaN raises."""
    for level, stage in enumerate(chain):
        value = values.get(stage)
        if value is not None:
            if not math.isfinite(value):
                raise ValueError(f"stage {stage} is not finite")
            return value, level, stage
    raise ValueError("no stage has a value")
