import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import features as X
from panelyard.operators import governance as G
from panelyard.operators import joins as J
from panelyard.operators import metrics as M
from panelyard.operators import models as L
from panelyard.operators import panel as P
from panelyard.operators.statistics import resolve_fallback

FIELDS = ["run_id", "run_date_utc", "seed", "decision", "artifact_paths", "overall_cv_rmse"]
RECORD = {"run_id": "run-a", "run_date_utc": "2026-01-01T00:00:00+00:00", "seed": "7", "decision": "keep", "artifact_paths": '["reports/a.json"]', "overall_cv_rmse": "0.5"}


def violations(**change):
    return G.record_violations(RECORD | change, FIELDS, ["run_id"], ["artifact_paths"], ["overall_cv_rmse"], ["keep", "drop"])


@pytest.mark.parametrize(
    ("change", "found"),
    [
        ({}, []),
        ({"run_id": "Run A"}, ["run_id"]),
        ({"run_date_utc": "2026-01-01T00:00:00+02:00"}, ["run_date_utc"]),
        ({"seed": "x"}, ["seed"]),
        ({"decision": "?"}, ["decision"]),
        ({"artifact_paths": "["}, ["json artifact_paths"]),
        ({"artifact_paths": '["/etc/x", "C:/y", "a/../b", "data/raw/t.csv"]'}, ["path /etc/x", "path C:/y", "path a/../b", "path data/raw/t.csv"]),
        ({"overall_cv_rmse": "nan"}, ["number overall_cv_rmse"]),
    ],
)
def test_records(change, found):
    assert violations(**change) == found


def test_guards_and_manifest(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    with pytest.raises(G.ContractError, match="protected"):
        G.output_guard(raw / "x", protected=[raw])
    with pytest.raises(G.ContractError, match="input"):
        G.output_guard(tmp_path / "in.csv", inputs=[tmp_path / "in.csv"])
    with pytest.raises(G.ContractError, match="outside"):
        G.output_guard(tmp_path / "x", allowed=[tmp_path / "out"])
    path = tmp_path / "out" / "m.json"
    digest = G.write_manifest(path, {"n": 3}, {"seconds": 1.5}, allowed=[tmp_path / "out"])
    with pytest.raises(G.ContractError, match="there already"):
        G.write_manifest(path, {"n": 3})
    assert digest == G.write_manifest(path, {"n": 3}, {"seconds": 9.0}, overwrite=True)
    for bad in ({"rows": [1]}, {"x": [{"a": 1}]}, {"x": list(range(65))}):
        with pytest.raises(G.ContractError, match="rows in a manifest"):
            G.row_free(bad)


def test_config():
    G.check_config({"a": 1, "b": {"c": "x"}}, {"a": int, "b": {"c": str}})
    for bad in ({"a": True, "b": {"c": "x"}}, {"a": 1}, {"a": 1, "b": {"c": 2}}, {"a": 1, "b": 3}):
        with pytest.raises(G.ContractError):
            G.check_config(bad, {"a": int, "b": {"c": str}})


def report():
    cell = {"count": 2, "rmse": 0.5}
    return {
        "run_id": "run-a",
        "coverage": {"expected": 2, "predicted": 2},
        "metrics": {"pooled": cell, "fold": {"F01": cell, "F02": cell}, "horizon": {str(h): cell for h in range(1, 8)}, "mask_state": {}, "latitude_band": {}, "spei": {}},
        "runtime_seconds": 1.0,
        "peak_memory_mb": 2.0,
        "decision": "keep",
        "decision_reason": "r",
    }


def test_evidence(spark):
    slices = [("pooled", "all", 4, 0.5), ("fold", "F01", 3, 0.4), ("fold", "F02", 1, 0.9), ("horizon", "1", 4, 0.5)]
    reports = spark.createDataFrame([("run-a", *s) for s in slices] + [("run-b", "pooled", "all", 4, float("nan"))], "run_id string, family string, label string, n long, rmse double")
    right = [("run-a", "rmse", 0.5), ("run-a", "rows", 4.0), ("run-a", "fold rows", 4.0), ("run-a", "fold slices", 2.0), ("run-a", "horizon rows", 4.0)]
    records = spark.createDataFrame([*right, ("run-a", "horizon slices", 7.0), ("run-b", "rows", 5.0), ("run-c", "rows", 4.0)], "run_id string, fact string, value double")
    got = {(r.run_id, r.fact) for r in G.evidence_mismatches(records, reports).collect()}
    assert got == {("run-a", "horizon slices"), ("run-b", "rows"), ("run-b", "rmse"), ("run-c", "rows")}
    assert G.evidence_mismatches(records.limit(0), reports.limit(0)).count() == 0


def test_nested_report(spark):
    rows = spark.createDataFrame([("pooled", "all", 2, 0.5), ("fold", "F01", 2, 0.5), ("spei_01", "[0,1)", 0, None)], "family string, label string, n long, rmse double")
    assert G.nested_report(rows) == {"pooled": {"count": 2, "rmse": 0.5}, "fold": {"F01": {"count": 2, "rmse": 0.5}}, "spei": {"spei_01": {"[0,1)": {"count": 0, "rmse": None}}}}


def test_resumable(spark, tmp_path):
    path, built = f"file://{tmp_path}/step", []

    def build():
        built.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2)

    for _ in range(2):
        assert G.resumable(spark, path, "a", build, ["id", "x"], 5).count() == 5
    assert len(built) == 1
    with pytest.raises(G.ContractError, match="manifest says"):
        G.resumable(spark, path, "b", build, ["id", "x"])
    with pytest.raises(G.ContractError, match="in place of"):
        G.resumable(spark, path, "a", build, ["id", "x"], 6)
    spark.range(1).write.parquet(f"{path}2")
    with pytest.raises(G.ContractError, match="no manifest"):
        G.resumable(spark, f"{path}2", "a", build, ["id"])


def test_sizing_and_types(spark):
    assert G.training_bytes(10, 4) == 10 * 28 * 3
    df = spark.createDataFrame([("7", "2001-02-03", "1.5"), ("8", None, "x"), (None, "2001-02-30", None)], "ID string, time string, y string")
    assert G.cast_losses(df, {"time": "date", "y": "double"}).first().asDict() == {"time": 1, "y": 1}
    assert G.lossless_types(df, {"ID": "bigint", "time": "date", "absent": "int"}) == {"ID": "bigint", "time": "string", "y": "string"}
    assert G.lossless_types(df.limit(1), {"time": "date", "y": "double"}) == {"ID": "string", "time": "date", "y": "double"}
    assert G.profile_differences({"a": 1, "b": 2}, {"a": 1, "b": 3}) == {"b": (2, 3)}
    joined = G.joined_reports({"t": {"n_rows": 2, "csv_bytes": 10, "parquet_bytes": 5}}, {"t": {"line_feeds": 3}})
    assert joined["parquet_bytes"] == 5 and joined["datasets"]["t"]["rows_match_lines"] and joined["datasets"]["t"]["size_ratio"] == 2


def test_audit(spark, tmp_path):
    shape = {"origin": str, "gate": {"observations": int}}
    text = "origin: F01\ngate:\n  observations: 12\n"
    tables = lambda c: {"folds": spark.createDataFrame([(c["origin"], 0, 5)], "fold_id string, bad_rows int, n int")}
    out = G.run_audit(text, shape, tables, tmp_path / "m.json")
    assert out["facts"] == {"folds.0": {"fold_id": "F01", "bad_rows": 0, "n": 5}}
    assert out["structural_sha256"] == G.run_audit(text, shape, tables, tmp_path / "n.json")["structural_sha256"]
    with pytest.raises(G.ContractError, match="bad_rows"):
        G.run_audit(text, shape, lambda c: {"folds": spark.createDataFrame([(1,)], "bad_rows int")}, tmp_path / "o.json")
    many = spark.range(3_000).select((F.col("id") == 2_999).cast("int").alias("bad_rows"), "id")
    with pytest.raises(G.ContractError, match="bad_rows"):
        G.run_audit(text, shape, lambda c: {"folds": many}, tmp_path / "q.json")
    assert G.run_audit(text, shape, lambda c: {"folds": many.where("id < 2999")}, tmp_path / "r.json")["facts"]["folds"]["n"] == 2_999
    with pytest.raises(ValueError, match="repeated key"):
        G.run_audit(text + "origin: F02\n", shape, tables, tmp_path / "p.json")


def test_features_and_tables(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert G.require_features(df, ["b", "a"]).columns == ["b", "a"]
    for bad in (["a", "a"], ["c"]):
        with pytest.raises(G.ContractError):
            G.require_features(df, bad)
    df.createOrReplaceTempView("there")
    assert G.table_exists(spark, "there") and not G.table_exists(spark, "nowhere")
    assert G.describe(df) == [("a", "int"), ("b", "int")]


def test_merge_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert sorted(J.merge_one_to_one(a, b, ["k"]).collect()) == [(1, "x", "z"), (2, "y", None)]
    with pytest.raises(Exception, match="not unique"):
        J.merge_one_to_one(a, b.unionAll(b), ["k"]).collect()


def test_numbered(spark):
    rows = spark.createDataFrame([(i % 7, (i * 37) % 100) for i in range(100)] + [(None, 1000)], "b int, x int")
    got = {(r.b, r.x): r.number for r in J.numbered(rows, "b", ["x"]).collect()}
    want = sorted(got, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    assert [got[t] for t in want] == list(range(1, 102))


def test_drift_and_percentiles(spark):
    train = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    test = spark.createDataFrame([(-1.0,), (5.0,), (float("nan"),)], "x double")
    got = {(r.population, r.feature): r for r in M.drift_audit({"train": train, "test": test}, ["x", "y"]).collect()}
    assert (got["test", "x"].outside, got["test", "x"].missing, got["test", "x"].outside_share) == (1, 1, 0.5)
    assert not got["test", "y"].available and got["test", "y"].outside_share is None
    r = M.finite_percentiles(test, {"x": F.col("x")}, (0.0, 1.0)).first()
    assert (r.x_p00, r.x_p100) == (-1.0, 5.0)


def test_scoring_features(spark):
    months = [dt.date(2000, 1, 1), dt.date(2000, 2, 1), dt.date(2000, 3, 1)]
    rows = spark.createDataFrame([(1, 1, m, float(i + 2), i, i > 0) for i, m in enumerate(months)], "lat2 long, lon2 long, m date, v double, n int, masked boolean")
    got = X.scoring_features(P.mask_template(rows.select("lat2", "lon2", "m", "masked"), months[0]), rows, months[0], ["n"]).orderBy("input_month").collect()
    # the masked months' own values, 3 and 4, are never sources
    assert [(r.horizon, r.last_observed, r.source_month, r.n) for r in got] == [(1, 2.0, months[0], 0), (2, 2.0, months[0], 1), (3, 2.0, months[0], 2)]


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), None if i == 3 else float(i % 5), "ab"[i % 2], 2.0 * i) for i in range(40)], "x double, z double, c string, target double")
    out = L.fit_categorical(rows.where("z is not null"), rows.where("z is not null").withColumn("c", F.when(F.col("x") == 1, "new").otherwise(F.col("c"))), "c", ["x"], rounds=2, depth=2)
    assert out.where("prediction is null").count() == 0
    assert L.fit_imputed(rows, rows, ["x", "z"], rounds=2, depth=2).count() == 40
    model = L.fit_trees(rows, ["x"], "target", rounds=2, depth=2)
    L.save_model(model, f"file://{tmp_path}/model")
    again = L.score(L.load_model(f"file://{tmp_path}/model"), rows, ["x"])
    assert again.select("prediction").collect() == L.score(model, rows, ["x"]).select("prediction").collect()
    assert np.allclose(L.mean_weights([np.array([1.0, 0.0]), np.array([0.5, 0.5])]), [0.75, 0.25])


def test_resolve_fallback():
    assert resolve_fallback(["a", "b"], {"a": None, "b": 2.0}) == (2.0, 1, "b")
    with pytest.raises(ValueError, match="not finite"):
        resolve_fallback(["a"], {"a": math.nan})
    with pytest.raises(ValueError, match="no stage"):
        resolve_fallback(["a"], {})
