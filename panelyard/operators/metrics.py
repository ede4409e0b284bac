"""Errors by slice, summaries and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def accumulate(target: str = "target", prediction: str = "prediction") -> list[Column]:
    error = F.pow(F.col(prediction) - F.col(target), 2)
    return [F.count("*").alias("n"), F.coalesce(F.sum(error), F.lit(0.0)).alias("sse"), F.sqrt(F.avg(error)).alias("rmse")]


def check_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, but reading a row with a null, NaN or infinite value fails."""
    good = F.lit(True)
    for c in columns:
        good = good & C.finite(c)
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.lit("value is not finite")).cast("boolean")))


def sliced(rows: DataFrame, families: dict[str, Column], labels: dict[str, list] | None = None) -> DataFrame:
    """Errors pooled and by each family's label, in one pass; listed labels stay if they are empty."""
    pairs = F.array(F.struct(F.lit("pooled").alias("family"), F.lit("all").alias("label")), *(F.struct(F.lit(k).alias("family"), c.cast("string").alias("label")) for k, c in families.items()))
    error = F.pow(F.col("prediction") - F.col("target"), 2)
    sums = rows.select(error.alias("e"), F.explode(pairs).alias("p")).groupBy("p.family", "p.label").agg(F.count("*").alias("n"), F.sum("e").alias("sse"))
    if labels:
        want = rows.sparkSession.createDataFrame([(k, str(v)) for k, vs in labels.items() for v in vs], "family string, label string")
        sums = sums.join(want, ["family", "label"], "full")
    n, sse = F.coalesce("n", F.lit(0)), F.coalesce("sse", F.lit(0.0))
    return sums.select("family", "label", n.alias("n"), sse.alias("sse"), F.when(n > 0, F.sqrt(sse / F.nullif(n, F.lit(0)))).alias("rmse"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pooled errors from counts and sums."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sqrt(F.sum("sse") / F.nullif(F.sum("n"), F.lit(0))).alias("rmse"))


def scores(target: str = "target", prediction: str = "prediction") -> list[Column]:
    error = F.col(target) - F.col(prediction)
    return [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.sum(error * error) / F.nullif(F.var_pop(target) * F.count(target), F.lit(0.0))).alias("r2")]


def numeric_summary(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, missing, extremes, mean, population deviation and exact quantiles of each column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    long = rows.select(*(by or []), F.explode(pairs).alias("p")).select(*(by or []), "p.feature", F.when(C.finite("p.x"), F.col("p.x")).alias("x"))
    q = F.percentile("x", list(QUANTILES))
    out = long.groupBy(*(by or []), "feature").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), q.alias("q"))
    return out.select("*", *(F.get("q", F.lit(i)).alias(f"q{int(p * 100):02d}") for i, p in enumerate(QUANTILES))).drop("q")


def out_of_range(rows: DataFrame, reference: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """How many values lie outside the reference's range, by group."""
    ends = reference.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    joined = rows.crossJoin(F.broadcast(ends))
    counts = [F.count_if((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))).alias(f"{c}_outside") for c in columns]
    return joined.groupBy(*by).agg(F.count("*").alias("n"), *counts)


def run_ranking(runs: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Runs by pooled error, with the gap between folds and the gain over a baseline run."""
    base = runs.where(F.col("model_name") == baseline).agg(F.first("rmse").alias("base"))
    gap = F.abs(F.col("rmse_f01") - F.col("rmse_f02"))
    out = runs.crossJoin(F.broadcast(base)).withColumns({"fold_gap": gap, "improvement": (F.col("base") - F.col("rmse")) / F.col("base")})
    return out.withColumn("position", F.row_number().over(W.orderBy("rmse", "model_name"))).drop("base")


def promotion_gates(challenger: DataFrame, champion: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Does a challenger's sliced report beat the champion's pooled, by fold, and within tolerance by horizon?"""
    both = challenger.select("family", "label", F.col("rmse").alias("a"), F.col("n").alias("na")).join(champion.select("family", "label", F.col("rmse").alias("b"), F.col("n").alias("nb")), ["family", "label"], "full")
    return both.agg(
        F.bool_and(F.when(F.col("family") == "pooled", F.col("a") < F.col("b"))).alias("pooled_better"),
        F.bool_and(F.when(F.col("family") == "fold", F.col("a") < F.col("b"))).alias("folds_better"),
        F.bool_and(F.when(F.col("family") == "horizon", F.col("a") <= F.col("b") * (1 + tolerance))).alias("horizons_hold"),
        F.bool_and(F.col("na").eqNullSafe(F.col("nb"))).alias("same_coverage"),
    )


def drift_audit(populations: dict[str, DataFrame], columns: list[str], reference: str = "train") -> DataFrame:
    """Summary and nine quantiles of each column in each population, with how many values lie outside the reference's range.

    Columns that a population lacks have ``available`` false and no figures. One pass over each
    population, and one more over the reference for its ranges.
    """
    long = None
    for name, df in populations.items():
        pairs = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias("x"), F.lit(c in df.columns).alias("available")) for c in columns))
        part = df.select(F.explode(pairs).alias("p")).select(F.lit(name).alias("population"), "p.feature", "p.available", F.when(C.finite("p.x"), F.col("p.x")).alias("x"))
        long = part if long is None else long.unionByName(part)
    ends = long.where(F.col("population") == reference).groupBy("feature").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    outside = F.count_if((F.col("x") < F.col("least")) | (F.col("x") > F.col("most")))
    sums = long.join(F.broadcast(ends), "feature", "left").groupBy("population", "feature", "available", "least", "most").agg(
        F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", list(QUANTILES)).alias("__q"), outside.alias("outside"), F.count("x").alias("__k")
    )
    share = F.when(F.col("__k") > 0, F.col("outside") / F.col("__k"))
    quantiles = {f"q{int(p * 100):02d}": F.get("__q", F.lit(i)) for i, p in enumerate(QUANTILES)}
    return sums.withColumns({"outside_share": share, **quantiles}).drop("__k", "__q")


def finite_percentiles(rows: DataFrame, columns: dict[str, Column], shares: tuple[float, ...] = (0.01, 0.99)) -> DataFrame:
    """Exact percentiles of each expression over its values that are neither null nor NaN."""
    value = {k: c.cast("double") for k, c in columns.items()}
    return rows.agg(*(F.percentile(F.when(~F.isnan(c), c), s).alias(f"{k}_p{int(round(s * 100)):02d}") for k, c in value.items() for s in shares))
