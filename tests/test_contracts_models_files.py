import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import contracts as K
from panelyard.operators import models as L
from panelyard.operators import profile as I
from panelyard.sources import files
from panelyard.streaming.monthly import monthly_means

ROW = ("run-a", "F01", "lat2=1;lon2=1", dt.date(2000, 1, 1), dt.date(2000, 2, 1), 1, "observed", 1.0, 2.0, "m", "c" * 64, "d" * 64, "e" * 64)
SCHEMA = "run_id string, fold_id string, location_id string, input_month date, target_month date, effective_horizon int, mask_state string, prediction double, validation_actual double, model_name string, configuration_id string, data_manifest_id string, validation_id string"


@pytest.mark.parametrize(
    ("column", "value", "count"),
    [("target_month", dt.date(2000, 3, 1), "bad_calendar"), ("effective_horizon", 8, "bad_horizon"), ("mask_state", "x", "bad_mask"), ("prediction", float("nan"), "bad_prediction"), ("location_id", "lat2=a", "bad_location"), ("run_id", "not a run id", "bad_run_id"), ("validation_id", "v", "bad_validation_id"), ("location_id", None, "bad_location"), ("target_month", None, "bad_calendar"), ("effective_horizon", None, "bad_horizon"), ("mask_state", None, "bad_mask"), ("run_id", None, "bad_run_id")],
)
def test_prediction_contract(spark, column, value, count):
    good = spark.createDataFrame([ROW], SCHEMA)
    assert sum(K.prediction_violations(good).collect()[0]) == 0
    bad = good.withColumn(column, F.lit(value).cast(good.schema[column].dataType))
    assert K.prediction_violations(bad).collect()[0][count] == 1
    assert K.prediction_violations(good.unionAll(good)).collect()[0]["duplicate_keys"] == 1
    assert set(K.prediction_violations(good.limit(0)).collect()[0]) == {0}


def test_identities(spark):
    a = spark.createDataFrame([ROW, (*ROW[:2], "lat2=2;lon2=1", *ROW[3:])], SCHEMA)
    assert K.row_identity(a).collect() == K.row_identity(a.orderBy(F.desc("location_id"))).collect()
    assert K.row_identity(a).collect() == K.row_identity(a.withColumn("prediction", F.lit(9.0))).collect()
    assert K.row_identity(a).collect() != K.row_identity(a.withColumn("validation_actual", F.lit(9.0))).collect()
    assert K.ordered_digest(a, ["location_id"], ["location_id"]) == K.ordered_digest(a.repartition(2), ["location_id"], ["location_id"])
    assert K.canonical_json({"b": 1, "a": [True]}) == '{"a":[true],"b":1}'
    with pytest.raises(ValueError, match="finite"):
        K.canonical_json([float("inf")])


def test_id_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, ordinal long")
    b = spark.createDataFrame([("y", 1), ("x", 2), ("x", 3), ("q", 4)], "id string, ordinal long")
    assert sum(K.id_order_violations(a, a).collect()[0]) == 0
    assert K.id_order_violations(a, b).collect()[0].asDict() == {"missing": 1, "extra": 1, "duplicates": 1, "displaced": 2}


def test_integrity(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan"))], "ID string, value double")
    r = I.integrity(df, "ID").collect()[0].asDict()
    assert (r["n_rows"], r["value_nulls"], r["value_nans"], r["duplicate_keys"]) == (3, 1, 1, 1)


def test_simplex_weights():
    x, y = np.array([[1.0, 2.0], [2.0, 1.0]]), np.array([1.0, 2.0])
    w = L.simplex_weights(x.T @ x, x.T @ y)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and np.allclose(w, [1, 0], atol=1e-6)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    w = L.simplex_weights(x.T @ x, x.T @ (x @ [0.2, 0.5, 0.3]))
    assert np.allclose(w, [0.2, 0.5, 0.3], atol=1e-5)


def test_trees_repeat(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") * 2.0 + 1).alias("target"), F.lit(1.0).alias("w"), F.lit(1.0).alias("last_observed"))
    one, two = (L.fit_residual(df, df, ["a"], weight="w", rounds=2, depth=2).agg(F.sum("prediction")).collect() for _ in range(2))
    assert one == two


def test_fits_by_fold(spark):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, "F01").otherwise("F02").alias("fold_id"), (F.col("id") % 4 + 1).cast("int").alias("horizon"), F.col("id").alias("a"), (F.col("id") * 2.0).alias("target"), F.lit(1.0).alias("w"), F.lit(1.0).alias("last_observed"))
    other = df.withColumn("target", F.when(F.col("fold_id") == "F01", F.col("target")).otherwise(-F.col("target")))
    groups = {"G1": [1, 2], "G2": [3, 4]}
    one, two = ({(r.a, r.prediction) for r in L.fit_folds(t, df, ["a"], groups, weight="w", rounds=2, depth=2).where("fold_id = 'F01'").collect()} for t in (df, other))
    assert len(one) == 100 and one == two


@pytest.mark.parametrize(("name", "fits"), [("gbdt_residual", 2), ("gbdt_specialists", 6)])
def test_registered_fits(spark, monkeypatch, name, fits):
    from panelyard.plans import registry

    seen = []

    def recorded(rows, features, label, **options):
        seen.append((options["rounds"], options["weight"], tuple(r[0] for r in rows.select("fold_id").distinct().collect())))

    monkeypatch.setattr(L, "fit_trees", recorded)
    monkeypatch.setattr(L, "score", lambda model, rows, features, name="prediction": rows.withColumn(name, F.lit(0.0)))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(seen) == sorted((200, "sample_weight", (f,)) for f in ("F01", "F02") for _ in range(fits // 2))


@pytest.mark.parametrize("name", ["gbdt_residual", "gbdt_specialists"])
def test_registered_fits_compute_the_panel_once(spark, monkeypatch, name):
    from panelyard.plans import registry

    seen = []
    monkeypatch.setattr(L, "fit_folds", lambda train, rows, *args, **options: seen.extend((train, rows)) or rows.withColumns({"specialist": F.lit("G1"), "prediction": F.lit(0.0)}))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2
    for x in seen:
        assert all("/panel-" in f for f in x.inputFiles()) and x.inputFiles()


def test_files(spark, tmp_path):
    out = spark.createDataFrame([("b", 0.1, 2), ("a", 1e20, 1)], "ID string, Target double, ordinal int")
    path = str(tmp_path / "s.csv")
    assert files.write_submission(out, path) == 2
    assert open(path).read() == "ID,Target\na,1e+20\nb,0.10000000000000001\n"
    with pytest.raises(FileExistsError):
        files.write_submission(out, path)
    official = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ordinal int")
    sent = files.read_text_columns(spark, path, ["ID", "Target"]).withColumn("ordinal", F.when(F.col("ID") == "a", 1).otherwise(2))
    assert sum(files.submission_violations(official, sent).collect()[0]) == 0
    assert files.submission_violations(official, sent.withColumn("Target", F.lit("nan"))).collect()[0]["bad_numbers"] == 2
    assert files.header_violations(path, ["ID", "Target"]) == {"missing": [], "unexpected": [], "repeated": [], "displaced": []}
    assert files.header_violations(path, ["Target", "X"])["missing"] == ["X"]
    assert files.file_facts(path)["line_feeds"] == 3
    with pytest.raises(ValueError, match="repeated key"):
        files.strict_yaml("a: 1\na: 2")
    registry = str(tmp_path / "r.csv")
    files.append_record({"run_id": "1", "j": "{}"}, registry, ["run_id", "j"], ["j"])
    with pytest.raises(ValueError, match="there already"):
        files.append_record({"run_id": "1", "j": "{}"}, registry, ["run_id", "j"], ["j"])
    files.write_parquet(out, str(tmp_path / "p"), sort_by=["ID"])
    assert files.read_parquet(spark, str(tmp_path / "p"), ["ID"], "Target > 1").collect()[0].ID == "a"
    assert files.unparsable_dates(spark.createDataFrame([("2020-01-01",), ("x",), (None,)], "d string"), "d") == 1


def test_stream_matches_batch(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-05 00:00:00", 2.0), (1, "2024-01-20 00:00:00", 4.0)], "u int, t string, x double").select("u", F.to_timestamp("t").alias("t"), "x").write.parquet(str(tmp_path / "in"))
    batch = monthly_means(spark.read.parquet(str(tmp_path / "in")), "t", ["u"], "x").collect()
    assert [(r.n, r["mean"]) for r in batch] == [(2, 3.0)]
    stream = spark.readStream.schema("u int, t timestamp, x double").parquet(str(tmp_path / "in"))
    query = monthly_means(stream, "t", ["u"], "x").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("daily").agg(F.sum("total") / F.sum("n")).collect()[0][0] == 3.0


def test_boosting_equals_mllib(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (300, 2)).astype(float)
    y = x[:, 0] * 3 - (x[:, 1] > 7) * 11 + rng.normal(size=300)
    rows = spark.createDataFrame([(*r, float(v), float(i % 3 + 1)) for i, (r, v) in enumerate(zip(x.tolist(), y, strict=True))], "a double, b double, target double, w double").coalesce(1)
    one, two = (L.score(L.fit_trees(rows, ["a", "b"], "target", "w", rounds=4, depth=3, in_task=n), rows, ["a", "b"]).select("a", "b", "prediction").orderBy("a", "b").collect() for n in (0, 1000))
    assert np.allclose([r.prediction for r in one], [r.prediction for r in two], atol=1e-6)


def test_fits_take_few_jobs(spark):
    """200 rounds of depth 8 as one task, in any order of the rows, with every row in the trees."""
    rows = spark.range(600).select((F.col("id") * 7 % 601).cast("double").alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") * 7 % 601 % 13).cast("double").alias("target"), F.lit(2.0).alias("w"))
    options = {"rounds": 200, "depth": 8, "stepSize": 0.05, "maxBins": 127, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9", "seed": 20260904}
    spark.sparkContext.setJobGroup("few-jobs", "fits")
    models = [L.fit_trees(df, ["a", "b"], "target", "w", **options) for df in (rows, rows.repartition(3, "target"))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 20
    assert [m.trees for m in models] == [200, 200]
    one, two = ([r.prediction for r in L.score(m, rows, ["a", "b"]).orderBy("a").collect()] for m in models)
    assert one == two
    with pytest.raises(Exception, match="a feature is null"):
        L.fit_trees(rows.withColumn("b", F.lit(None).cast("double")), ["a", "b"], "target", "w", **options)
