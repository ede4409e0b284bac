"""Fitting, scoring and blending."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored
from . import boosting
from .boosting import Trees


#: Training rows that one task fits; MLlib, with a few jobs for each level of each tree, takes more.
IN_TASK = 100_000
#: Options that both know.
_SHARED = {"stepSize", "maxBins", "subsamplingRate", "featureSubsetStrategy"}


def fit_trees(rows: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 5, seed: int = 7, in_task: int = IN_TASK, **more) -> GBTRegressionModel | Trees:
    """Boosted trees with weights and a fixed seed; null or NaN features raise.

    All rows are used. Up to ``in_task`` of them are fitted by one task (see ``boosting``), more by MLlib
    on all tasks, by the same rules; draws of rows and features differ.
    """
    if _SHARED.issuperset(more) and str(more.get("featureSubsetStrategy", "all")).replace(".", "").isdigit() | (more.get("featureSubsetStrategy", "all") in ("all", "auto")) and rows.count() <= in_task:
        return boosting.fit(rows, features, label, weight, rounds, depth, seed, **{"stepSize": 0.1, "maxBins": 64, **more})
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, **{"stepSize": 0.1, "maxBins": 64, **more})
    return (model.setWeightCol(weight) if weight else model).fit(data)


def score(model, rows: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    if isinstance(model, Trees):
        return model.setPredictionCol(name).score(rows, features)
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)
    return model.setPredictionCol(name).transform(out).drop("features")


def fit_residual(train: DataFrame, rows: DataFrame, features: list[str], anchor: str = "last_observed", **options) -> DataFrame:
    """Model of target less anchor; predictions have the anchor added again."""
    model = fit_trees(train.withColumn("residual", F.col("target") - F.col(anchor)), features, "residual", **options)
    return score(model, rows, features, "residual_prediction").withColumn("prediction", F.col(anchor) + F.col("residual_prediction"))


def fit_specialists(train: DataFrame, rows: DataFrame, features: list[str], groups: dict[str, list[int]], **options) -> DataFrame:
    """A residual model for each group of horizons, each scoring its own rows."""
    out = None
    for name, horizons in groups.items():
        part = fit_residual(train.where(F.col("horizon").isin(horizons)), rows.where(F.col("horizon").isin(horizons)), features, **options).withColumn("specialist", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _side_by_side(session: SparkSession, f, calls: list[tuple]) -> list:
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return list(pool.map(inheritable_thread_target(session)(lambda call: f(*call)), calls))


def fit_folds(train: DataFrame, rows: DataFrame, features: list[str], groups: dict[str, list[int]] | None = None, fold: str = "fold_id", **options) -> DataFrame:
    """Residual models for each fold, and for each group of horizons if given, on the fold's own training rows.

    No fold's model sees another's rows. Training and scored rows are computed once, side by side, and written
    to the shared folder; so are the fits run. A fold without training rows raises.
    """
    session = rows.sparkSession

    def fit(name, group) -> DataFrame:
        own, scored = (x.where(F.col(fold) == name) for x in (train, rows))
        return fit_specialists(own, scored, features, {group: groups[group]}, **options) if group else fit_residual(own, scored, features, **options)

    train, rows = _side_by_side(session, stored, [(train, "train"), (rows, "scored")])
    parts = _side_by_side(session, fit, [(r[0], g) for r in rows.select(fold).distinct().orderBy(fold).collect() for g in (groups or [None])])
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def route(rows: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    out = F
    for name, horizons in groups.items():
        out = out.when(F.col("horizon").isin(horizons), name)
    return rows.withColumn("specialist", out.otherwise(F.lit(None)))


def impute_median(rows: DataFrame, columns: list[str]) -> DataFrame:
    return Imputer(strategy="median", inputCols=columns, outputCols=columns, relativeError=0.0).fit(rows).transform(rows)


def gram(rows: DataFrame, columns: list[str], by: list[str], target: str = "target") -> DataFrame:
    """Sums of products of components with each other and with the target, by group, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs] + [F.sum(F.col(a) * F.col(target)).alias(f"{a}__y") for a in columns]
    return rows.groupBy(*by).agg(*sums, F.count("*").alias("n"))


def simplex_weights(products: np.ndarray, with_target: np.ndarray, rounds: int = 5_000) -> np.ndarray:
    """Weights, none negative and with sum 1, of least squared error, by accelerated projected gradients."""
    n = len(with_target)
    scale = float(np.linalg.eigvalsh(products).max()) or 1.0
    w = last = np.full(n, 1 / n)
    momentum = 1.0
    for _ in range(rounds):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        point = w + (momentum - 1) / following * (w - last)
        last, w, momentum = w, _onto_simplex(point - (products @ point - with_target) / scale), following
        if np.abs(w - last).max() < 1e-13:
            break
    return w


def _onto_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    rest = np.cumsum(u) - 1
    k = np.flatnonzero(u - rest / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - rest[k] / (k + 1), 0)


def cross_fit_blend(rows: DataFrame, columns: list[str], folds: tuple[str, str], by: str = "specialist", target: str = "target") -> DataFrame:
    """Blend each fold with the weights of the other, by group; a few sums reach the driver."""
    spark, weights = rows.sparkSession, []
    for r in gram(rows, columns, ["fold_id", by], target).collect():
        products = np.array([[r[f"{a}__{b}" if columns.index(a) <= columns.index(b) else f"{b}__{a}"] for b in columns] for a in columns])
        w = simplex_weights(products / r["n"], np.array([r[f"{a}__y"] for a in columns]) / r["n"])
        weights.append((folds[1] if r["fold_id"] == folds[0] else folds[0], r[by], *map(float, w)))
    table = spark.createDataFrame(weights, f"fold_id string, {by} string, " + ", ".join(f"w_{c} double" for c in columns))
    return apply_blend(rows.join(F.broadcast(table), ["fold_id", by]), columns)


def apply_blend(rows: DataFrame, columns: list[str]) -> DataFrame:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c) * F.col(f"w_{c}")
    return rows.withColumn("prediction", total)


def categorical_means(train: DataFrame, column: str, label: str, prior: float = 10.0) -> DataFrame:
    """Smoothed label means of a category, in place of the category."""
    overall = train.agg(F.avg(label).alias("__all"))
    sums = train.groupBy(column).agg(F.sum(label).alias("__s"), F.count(label).alias("__n"))
    return sums.crossJoin(F.broadcast(overall)).select(column, ((F.col("__s") + prior * F.col("__all")) / (F.col("__n") + prior)).alias(f"{column}_mean"))


def fit_categorical(train: DataFrame, rows: DataFrame, category: str, features: list[str], label: str = "target", **options) -> DataFrame:
    """Trees over features and a category's smoothed label mean; new categories take the overall mean."""
    means = categorical_means(train, category, label)
    overall = train.agg(F.avg(label).alias("__mean"))
    name = f"{category}_mean"

    def coded(df: DataFrame) -> DataFrame:
        out = df.join(means, category, "left").crossJoin(F.broadcast(overall))
        return out.withColumn(name, F.coalesce(name, "__mean")).drop("__mean")

    model = fit_trees(coded(train), [*features, name], label, **options)
    return score(model, coded(rows), [*features, name]).drop(name)


def fit_imputed(train: DataFrame, rows: DataFrame, features: list[str], label: str = "target", **options) -> DataFrame:
    """Trees over features whose missing values take the training median."""
    imputer = Imputer(strategy="median", inputCols=features, outputCols=features, relativeError=0.0).fit(train)
    return score(fit_trees(imputer.transform(train), features, label, **options), imputer.transform(rows), features)


def mean_weights(directions: list[np.ndarray]) -> np.ndarray:
    """Frozen blend of weights fitted in several directions: their mean, with sum 1 again."""
    mean = np.mean(directions, 0)
    return mean / mean.sum()


def save_model(model: GBTRegressionModel | Trees, path: str) -> None:
    """An existing path is an error."""
    if isinstance(model, Trees):
        spark, nodes = SparkSession.active(), {c: v.tolist() for c, v in model.nodes.items()}
        rows = [(i, model.rate, *r) for i, r in enumerate(zip(*nodes.values(), strict=True))]
        spark.createDataFrame(rows, f"node int, rate double, {boosting.NODE}").write.mode("errorifexists").parquet(path)
    else:
        model.write().save(path)


def load_model(path: str) -> GBTRegressionModel | Trees:
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path, "metadata")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return GBTRegressionModel.load(path)
    table = spark.read.parquet(path).orderBy("node").toArrow()
    return Trees({c: table.column(c).to_numpy() for c in table.column_names[2:]}, table.column("rate")[0].as_py())
