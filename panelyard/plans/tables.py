"""The panel and folds that the registered queries run on, from the star-schema tables."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import features as X
from ..operators import panel as P
from ..operators import sampling as S
from ..operators import statistics as T

ORIGIN = dt.date(2000, 1, 1)
FOLDS = (("F01", dt.date(1997, 1, 1)), ("F02", dt.date(1998, 6, 1)))
COVARIATES = ["n", "urgent", "acct"]
#: Index columns by the months that they look back over, and the calendar's encoding.
INDEX = {"spei_01": 1, "spei_03": 3, "spei_06": 6, "spei_12": 12}
ENCODING = ["month_sin", "month_cos"]
#: Customers of one cell: rows of the panel grow with the tables.
BLOCK = 500
QUOTAS = {1: 200, 2: 150, 3: 100, 4: 80, 5: 60, 6: 40, 7: 20}
GROUPS = {"G1": [1], "G23": [2, 3], "G47": [4, 5, 6, 7]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDS, "fold_id string, origin date")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order value by cell (nation, block of customers), with the next month's as target.

    Orders are summed by customer and month before they meet the customers. ``spei_*`` are
    standardised counts of urgent orders (one in five is expected) over a cell's latest rows.
    """
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"), "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("u"))
    orders = orders.groupBy("o_custkey", "m").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("k"), F.sum("u").alias("u"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("lat2"), F.floor((F.col("c_custkey") - 1) / BLOCK).alias("lon2"), "c_acctbal")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    k = F.sum("k")
    rows = joined.groupBy("lat2", "lon2", "m").agg((F.sum("s") / k).alias("v"), k.alias("n"), (F.sum("u") / k).alias("urgent"), (F.sum(F.col("c_acctbal") * F.col("k")) / k).alias("acct"), F.sum("u").alias("us"))
    for name, months in INDEX.items():
        past = W.partitionBy("lat2", "lon2").orderBy("m").rowsBetween(1 - months, 0)
        count = F.sum("n").over(past)
        rows = rows.withColumn(name, (5 * F.sum("us").over(past) - count).cast("double") / (2 * F.sqrt(count.cast("double"))))
    angle = F.month("m") * F.lit(2 * math.pi / 12)
    return P.with_next(rows.drop("us").withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)}))


def template(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """A mask over seven months: the first row of a cell shows, others by a rule of cell and month."""
    window = (rows if rows is not None else panel(spark, sf_dir)).where((F.col("m") >= F.lit(ORIGIN)) & (F.col("m") < F.lit(dt.date(2000, 8, 1)))).select("lat2", "lon2", "m")
    rel = C.months_between(F.lit(ORIGIN), "m")
    first = F.row_number().over(W.partitionBy("lat2", "lon2").orderBy("m")) == 1
    return P.mask_template(window.withColumn("masked", ~first & ((F.col("lat2") * 7 + F.col("lon2") * 3 + rel) % 3 != 0)), ORIGIN)


class World:
    """The steps of the fold pipeline, lazily, over one data folder, or over its panel if that is given."""

    def __init__(self, spark: SparkSession, sf_dir: str, rows: DataFrame | None = None):
        self.spark, self.folds, self.panel = spark, folds(spark), panel(spark, sf_dir) if rows is None else rows
        self.template = template(spark, sf_dir, self.panel)
        self.mapped = P.map_template(self.template, self.panel, self.folds)
        self.cohorts = P.cohorts(self.mapped, self.panel, self.folds)
        self.sources = P.sources(self.mapped, self.cohorts, self.panel, self.folds)
        self.retained = P.retained_rows(self.mapped, self.cohorts, self.sources)
        self.fit = P.fit_window(self.panel, self.folds)
        self.stats = T.fitted(self.fit)

    def candidates(self) -> DataFrame:
        return T.candidates(self.retained, self.panel, self.stats)

    def baseline(self, name: str) -> DataFrame:
        return T.baseline(self.candidates(), name)

    def examples(self) -> DataFrame:
        return S.horizon_candidates(self.panel, self.folds)

    def sample(self) -> DataFrame:
        return S.quota_sample(self.examples(), QUOTAS)

    def features(self) -> DataFrame:
        return X.validation_features(self.retained, self.panel, [*COVARIATES, *INDEX, *ENCODING])

    def history(self) -> DataFrame:
        return X.history_features(self.features(), self.panel)

    def enhanced(self) -> DataFrame:
        return X.enhanced_features(self.history(), X.fold_reference(self.panel, self.folds, "acct"), "acct", list(INDEX))

    def indexed(self, rows: DataFrame) -> DataFrame:
        """Rows with the index columns of their input month."""
        return rows.join(self.panel.select("lat2", "lon2", F.col("m").alias("input_month"), *INDEX), ["lat2", "lon2", "input_month"])
