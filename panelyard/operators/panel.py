"""Masked panels and the folds that a mask template makes of history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from .joins import asof_join

CELL = ["lat2", "lon2"]


@dataclass(frozen=True)
class Gate:
    """Observations and span in months that a cell's history must have before an origin."""

    observations: int = 12
    months: int = 12


def with_next(panel: DataFrame, value: str = "v") -> DataFrame:
    """The value at the exact next calendar month as ``target``; an absent month gives null."""
    ahead = panel.select(*CELL, C.add_months("m", -1).alias("m"), F.col(value).alias("target"))
    return panel.join(ahead, [*CELL, "m"], "left")


def mask_template(rows: DataFrame, origin) -> DataFrame:
    """Structure of a masked panel: cell, relative month, mask, last observed month, horizon.

    ``rows`` has lat2, lon2, m and masked; no values enter. The horizon counts from the last month
    that the cell shows unmasked, null before the first.
    """
    past = W.partitionBy(*CELL).orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("last_observed", F.max(F.when(~F.col("masked"), F.col("m"))).over(past))
    return seen.select(
        *CELL,
        C.months_between(F.lit(origin).cast("date"), "m").alias("rel"),
        "masked",
        C.months_between(F.lit(origin).cast("date"), "last_observed").alias("last_rel"),
        C.effective_horizon("last_observed", C.target_month("m")).alias("horizon"),
    )


def template_summary(template: DataFrame) -> DataFrame:
    cells, months = F.count_distinct(F.struct(*CELL)), F.count_distinct("rel")
    return template.agg(F.count("*").alias("n_rows"), cells.alias("n_cells"), months.alias("n_months"), F.count_if("masked").alias("n_masked"), (cells * months - F.count("*")).alias("omitted_slots"))


def origin_coverage(template: DataFrame, panel: DataFrame, folds: DataFrame) -> DataFrame:
    """By fold: relative months whose input and target months the panel has at all."""
    months = panel.select("m").distinct()
    slots = template.select("rel").distinct().crossJoin(F.broadcast(folds)).withColumn("m", C.add_months("origin", F.col("rel")))
    for name, month in (("has_input", F.col("m")), ("has_target", C.target_month("m"))):
        have = months.select(F.col("m").alias("__m"), F.lit(True).alias(name))
        slots = slots.join(F.broadcast(have), month == F.col("__m"), "left").drop("__m")
    return slots.groupBy("fold_id").agg(F.count("*").alias("n_months"), F.count_if(F.col("has_input")).alias("n_input"), F.count_if(F.col("has_target")).alias("n_target")).withColumn("complete", (F.col("n_months") == F.col("n_input")) & (F.col("n_months") == F.col("n_target")))


def map_template(template: DataFrame, panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The template's rows at each fold's months with the panel's values; absent rows stay unmatched."""
    moved = template.crossJoin(F.broadcast(folds)).withColumn("input_month", C.add_months("origin", F.col("rel")))
    found = panel.select(*CELL, F.col("m").alias("input_month"), F.col("v").alias("value"), "target", F.lit(True).alias("matched"))
    return moved.join(found, [*CELL, "input_month"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("target_month", C.target_month("input_month"))


def cohorts(mapped: DataFrame, panel: DataFrame, folds: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """By fold and cell: completeness of the path and of targets, history, and retention."""
    path = mapped.groupBy("fold_id", *CELL).agg(F.count("*").alias("n_rows"), F.count_if("matched").alias("n_matched"), F.count("target").alias("n_targets"))
    history = panel.where("v is not null").join(F.broadcast(folds), F.col("m") < F.col("origin"))
    history = history.groupBy("fold_id", *CELL).agg(F.count("*").alias("n_history"), C.months_between(F.min("m"), F.max("m")).alias("history_months"))
    out = path.join(history, ["fold_id", *CELL], "left").withColumns({"n_history": F.coalesce("n_history", F.lit(0)), "history_months": F.coalesce("history_months", F.lit(0))})
    whole = {"path_complete": F.col("n_matched") == F.col("n_rows"), "target_complete": F.col("n_targets") == F.col("n_rows"), "history_ok": (F.col("n_history") >= gate.observations) & (F.col("history_months") >= gate.months)}
    return out.withColumns(whole).withColumn("retained", F.col("path_complete") & F.col("target_complete") & F.col("history_ok"))


def sources(mapped: DataFrame, kept: DataFrame, panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Values that a fold may look back on: history before its origin, and what the mask shows."""
    cells = kept.where("retained").select("fold_id", *CELL)
    before = panel.where("v is not null").join(F.broadcast(folds), F.col("m") < F.col("origin")).select("fold_id", *CELL, F.col("m").alias("source_month"), F.col("v").alias("source_value"))
    shown = mapped.where("matched and not masked and value is not null").select("fold_id", *CELL, F.col("input_month").alias("source_month"), F.col("value").alias("source_value"))
    return before.unionByName(shown).join(cells, ["fold_id", *CELL], "left_semi")


def retained_rows(mapped: DataFrame, kept: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of retained cells with what is known of them, its provenance, and the last observation."""
    rows = mapped.join(kept.where("retained").select("fold_id", *CELL), ["fold_id", *CELL], "left_semi")
    rows = rows.select("fold_id", "origin", *CELL, "rel", "masked", F.col("horizon").alias("expected_horizon"), "input_month", "target_month", "target", F.when(~F.col("masked"), F.col("value")).alias("available"), F.when(F.col("masked"), "masked/unavailable").otherwise("observed").alias("provenance"))
    seen = asof_join(rows, source, ["fold_id", *CELL], "input_month", "source_month", ["source_value"])
    return seen.withColumnsRenamed({"source_month": "last_observed_month", "source_value": "last_observed"}).withColumn("horizon", C.effective_horizon("last_observed_month", "target_month"))


def fit_window(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows whose target month lies at or before a fold's origin; written so that a scan can prune."""
    return panel.where("target is not null").join(F.broadcast(folds), F.col("m") <= C.add_months("origin", -1))


def fold_audit(mapped: DataFrame, kept: DataFrame, retained: DataFrame) -> DataFrame:
    """By fold: cohort counts, excluded by cause, and invariants that must be 0."""
    cells = kept.groupBy("fold_id").agg(
        F.count("*").alias("cells"),
        F.count_if("retained").alias("retained_cells"),
        F.sum(F.when(F.col("retained"), F.col("n_rows")).otherwise(0)).alias("retained_rows"),
        F.count_if(~F.col("path_complete")).alias("path_incomplete"),
        F.count_if(F.col("path_complete") & ~F.col("target_complete")).alias("target_incomplete"),
        F.count_if(F.col("path_complete") & F.col("target_complete") & ~F.col("history_ok")).alias("history_excluded"),
    )
    checks = retained.groupBy("fold_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("target").isNull()).alias("null_targets"),
        F.count_if(F.col("last_observed_month") > F.col("input_month")).alias("future_sources"),
        F.count_if(~F.col("horizon").eqNullSafe(F.col("expected_horizon"))).alias("horizon_mismatches"),
        F.count_if(F.col("masked") != F.col("available").isNull()).alias("mask_mismatches"),
        (F.count("*") - F.count_distinct(F.struct(*CELL, "input_month"))).alias("duplicates"),
    )
    return cells.join(checks, "fold_id").withColumn("unaccounted_rows", F.col("rows") - F.col("retained_rows"))


def overlap(retained: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one fold has."""
    return retained.groupBy(*keys).agg(F.count_distinct("fold_id").alias("n_folds")).where("n_folds > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
