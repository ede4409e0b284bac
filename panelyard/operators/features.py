"""Feature rows for fitting and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from .joins import asof_join

CELL = ["lat2", "lon2"]


def validation_features(retained: DataFrame, panel: DataFrame, covariates: list[str]) -> DataFrame:
    """Retained rows with covariates of their input month and the value of their last observed month."""
    now = panel.select(*CELL, F.col("m").alias("input_month"), *covariates)
    last = panel.select(*CELL, F.col("m").alias("last_observed_month"), F.col("v").alias("last_value"))
    rows = retained.join(now, [*CELL, "input_month"]).join(last, [*CELL, "last_observed_month"])
    return rows.where((F.col("last_observed_month") <= F.col("input_month")) & (C.months_between("last_observed_month", "target_month") == F.col("horizon")))


def residual_rows(rows: DataFrame, target: str = "target", anchor: str = "last_value") -> DataFrame:
    """Target less anchor, and the way back."""
    return rows.withColumn("residual", F.col(target) - F.col(anchor)).withColumn("rebuilt", F.col(anchor) + F.col("residual"))


def history_features(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Second-last observation, gap, slope, last value of the target's calendar month, and indicators."""
    known = panel.where("v is not null")
    second = known.select(*CELL, F.col("m").alias("second_month"), F.col("v").alias("second_value"))
    out = asof_join(rows, second, CELL, "last_observed_month", "second_month", ["second_value"], strict=True)
    same = known.select(*CELL, F.month("m").alias("cal"), F.col("m").alias("season_month"), F.col("v").alias("season_value"))
    out = asof_join(out.withColumn("cal", F.month("target_month")), same, [*CELL, "cal"], "input_month", "season_month", ["season_value"])
    gap = C.months_between("second_month", "last_observed_month")
    return out.withColumns(
        {
            "gap_months": gap,
            "slope": (F.col("last_value") - F.col("second_value")) / F.nullif(gap, F.lit(0)),
            "season_age_months": C.months_between("season_month", "target_month"),
            "season_difference": F.col("last_value") - F.col("season_value"),
            "second_available": F.col("second_month").isNotNull().cast("int"),
            "slope_available": F.coalesce(gap > 0, F.lit(False)).cast("int"),
            "season_available": F.col("season_month").isNotNull().cast("int"),
        }
    )


def fold_reference(panel: DataFrame, folds: DataFrame, value: str) -> DataFrame:
    """Each fold's means of a value over months before its origin: by cell and calendar month, and by cell (``cal`` null)."""
    rows = panel.where(F.col(value).isNotNull()).join(folds, F.col("m") < F.col("origin")).withColumn("cal", F.month("m"))
    sets = rows.groupingSets([["fold_id", *CELL, "cal"], ["fold_id", *CELL]], "fold_id", *CELL, "cal")
    return sets.agg(F.avg(value).alias("mean"))


def enhanced_features(rows: DataFrame, reference: DataFrame, value: str, index: list[str]) -> DataFrame:
    """History rows with the rest of the enhanced set: index differences, an anomaly, encodings, indicators.

    ``index`` names columns from the shortest to the longest span; neighbours are subtracted. The anomaly
    is ``value`` less its fold's mean for the cell and calendar month, or for the cell where that is absent.
    """
    cell = reference.where("cal is null").select("fold_id", *CELL, F.col("mean").alias("cell_mean"))
    month = reference.where("cal is not null").select("fold_id", *CELL, F.col("cal").alias("input_cal"), F.col("mean").alias("month_mean"))
    out = rows.withColumn("input_cal", F.month("input_month")).join(month, ["fold_id", *CELL, "input_cal"], "left").join(cell, ["fold_id", *CELL], "left")
    mean = F.coalesce("month_mean", "cell_mean")
    added = {f"{a}_minus_{b[-2:]}": F.col(a) - F.col(b) for a, b in zip(index, index[1:], strict=False)}
    added |= {"anomaly": F.col(value) - mean, "anomaly_available": mean.isNotNull().cast("int"), "season_difference_available": (F.col("season_month").isNotNull() & F.col("last_value").isNotNull()).cast("int")}
    return out.withColumns(added | C.spherical(F.col("lat2") / 2, F.col("lon2") / 2)).drop("input_cal", "month_mean", "cell_mean")


def availability(rows: DataFrame, indicators: list[str], by: list[str]) -> DataFrame:
    """Share of rows where each indicator is set: overall and by each of ``by``."""
    out = rows.groupingSets([[], *([b] for b in by)], *by).agg(*(F.avg(i).alias(i) for i in indicators), F.count("*").alias("n"), *(F.grouping(b).alias(f"g_{b}") for b in by))
    family = F
    for b in by:
        family = family.when(F.col(f"g_{b}") == 0, b)
    label = F.coalesce(*(F.when(F.col(f"g_{b}") == 0, F.col(b).cast("string")) for b in by), F.lit("all"))
    return out.select(family.otherwise("overall").alias("family"), label.alias("label"), *indicators, "n")


def recent_block(panel: DataFrame, first, last, origin, observations: int = 12) -> DataFrame:
    """Horizon-1 rows of a month range, of cells with enough history before an origin."""
    history = panel.where((F.col("m") < F.lit(origin).cast("date")) & F.col("v").isNotNull()).groupBy(*CELL).agg(F.count("*").alias("n_history")).where(F.col("n_history") >= observations)
    rows = panel.where(F.col("m").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("v").isNotNull() & F.col("target").isNotNull())
    return rows.join(history, CELL).withColumns({"target_month": C.target_month("m"), "horizon": F.lit(1), "last_observed": F.col("v")})


def latest_months(rows: DataFrame, months: int = 12, by: str = "fold_id", month: str = "input_month") -> DataFrame:
    """Rows of each group's latest ``months`` months."""
    latest = F.max(month).over(W.partitionBy(by))
    return rows.withColumn("latest", latest).where(F.col(month) > C.add_months("latest", -months)).drop("latest")


def pivot_grid(rows: DataFrame, value: str, columns: list[int]) -> DataFrame:
    out = rows.groupBy("lat2").pivot("lon2", columns).agg(F.first(value))
    return out.withColumnsRenamed({str(c): f"lon_{c}" for c in columns})


def nearest(rows: DataFrame, column: str, wanted: float) -> DataFrame:
    """The distinct value nearest to ``wanted``; the smaller of two."""
    return rows.agg(F.min_by(column, F.struct(F.abs(F.col(column) - wanted), F.col(column))).alias("nearest"))


def scoring_features(template: DataFrame, rows: DataFrame, origin, covariates: list[str]) -> DataFrame:
    """Rows to predict for a masked panel: covariates of the input month, value of the last unmasked one.

    ``rows`` is the masked panel itself (lat2, lon2, m, v, covariates). Only unmasked rows are
    sources, at the exact month that the template's horizon says; rows without one drop out.
    """
    slots = template.withColumn("input_month", C.add_months(F.lit(origin).cast("date"), F.col("rel")))
    slots = slots.withColumns({"target_month": C.target_month("input_month"), "source_month": C.add_months("input_month", 1 - F.col("horizon"))})
    shown = slots.where("not masked").select(*CELL, F.col("input_month").alias("source_month"))
    values = rows.where("v is not null").select(*CELL, F.col("m").alias("source_month"), F.col("v").alias("last_observed"))
    now = rows.select(*CELL, F.col("m").alias("input_month"), *covariates)
    source = values.join(shown, [*CELL, "source_month"], "left_semi")
    return slots.where("horizon is not null").join(now, [*CELL, "input_month"]).join(source, [*CELL, "source_month"]).drop("rel", "last_rel")
