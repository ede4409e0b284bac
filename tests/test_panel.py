import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelyard.functions import calendar as C
from panelyard.operators import joins as J
from panelyard.operators import metrics as M
from panelyard.operators import panel as P
from panelyard.operators import sampling as S
from panelyard.operators import statistics as T

D = dt.date
TEMPLATE_ORIGIN, FOLD_ORIGIN = D(2020, 1, 1), D(2010, 1, 1)


def month(origin, n):
    i = origin.year * 12 + origin.month - 1 + n
    return D(i // 12, i % 12 + 1, 1)


def one(df):
    return df.collect()[0]


@pytest.fixture
def fixture(spark):
    """Four cells: whole path, a path with an absent slot, an incomplete path, a null target."""
    shown = {0: (range(18), (0, 7, 14)), 1: ((0, 2, 3), (0,)), 2: ((0, 1, 2), (0,)), 3: ((0, 1), (0,))}
    template = [(c, c, month(TEMPLATE_ORIGIN, o), o not in seen) for c, (offsets, seen) in shown.items() for o in offsets]
    history = [*range(-13, -2), -1]
    train_offsets = {0: range(19), 1: range(4), 2: (0, 2), 3: (0, 1)}
    panel = []
    for c, offsets in train_offsets.items():
        for o in [*history, *offsets]:
            target = None if (c, o) == (3, 1) else float(o + 1)
            panel.append((c, c, month(FOLD_ORIGIN, o), float(o), target))
    rows = spark.createDataFrame(template, "lat2 long, lon2 long, m date, masked boolean")
    table = spark.createDataFrame(panel, "lat2 long, lon2 long, m date, v double, target double")
    return P.mask_template(rows, TEMPLATE_ORIGIN), table, spark.createDataFrame([("F", FOLD_ORIGIN)], "fold_id string, origin date")


def test_calendar_columns(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), D(2020, 2, 1)), (D(2020, 3, 1), D(2019, 12, 31))], "a date, b date")
    assert [r[0] for r in df.select(C.months_between("a", "b")).collect()] == [1, -3]
    assert one(df.select(C.target_month(F.lit(D(2019, 12, 1)))))[0] == D(2020, 1, 1)
    key = one(spark.range(1).select(C.location_id(F.lit(-89), F.lit(3)).alias("k")).select(*C.parse_location("k")))
    assert tuple(key) == (-89, 3)
    assert one(spark.range(1).select(C.cell_index(F.lit(-44.5))))[0] == -89


@pytest.mark.parametrize(("lat", "label"), [(-90, "[-90,-60)"), (-60, "[-60,-30)"), (0, "[0,30)"), (60, "[60,90]"), (90, "[60,90]"), (91, None), (float("nan"), None), (None, None)])
def test_latitude_bands(spark, lat, label):
    assert one(spark.range(1).select(C.latitude_band(F.lit(lat).cast("double"))))[0] == label


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(C.finite("x")).collect()] == [True, False, False, False]


def test_template_and_fold(fixture):
    template, panel, folds = fixture
    summary = one(P.template_summary(template)).asDict()
    assert summary["n_rows"] == 26 and summary["n_cells"] == 4 and summary["n_months"] == 18 and summary["omitted_slots"] == 46
    mapped = P.map_template(template, panel, folds)
    kept = P.cohorts(mapped, panel, folds)
    assert {r.lat2: r.retained for r in kept.collect()} == {0: True, 1: True, 2: False, 3: False}
    rows = P.retained_rows(mapped, kept, P.sources(mapped, kept, panel, folds))
    found = {(r.lat2, r.rel): r for r in rows.collect()}
    assert len(found) == 21 and (1, 1) not in found
    assert [found[0, o].horizon for o in (0, 1, 6, 7)] == [1, 2, 7, 1]
    assert all((r.available is None) == r.masked for r in found.values())
    audit = one(P.fold_audit(mapped, kept, rows)).asDict()
    assert audit["retained_rows"] == 21 and audit["unaccounted_rows"] == 0 and audit["horizon_mismatches"] == 0
    assert audit["path_incomplete"] == 1 and audit["target_incomplete"] == 1


@pytest.mark.parametrize(("months", "passes"), [([*range(-13, -2), -1], True), ([*range(-12, 0)], False), ([-13, *range(-10, 0)], False)])
def test_history_gate(spark, months, passes):
    folds = spark.createDataFrame([("F", FOLD_ORIGIN)], "fold_id string, origin date")
    panel = spark.createDataFrame([(0, 0, month(FOLD_ORIGIN, o), 1.0, 2.0) for o in [*months, 0]], "lat2 long, lon2 long, m date, v double, target double")
    rows = spark.createDataFrame([(0, 0, TEMPLATE_ORIGIN, False)], "lat2 long, lon2 long, m date, masked boolean")
    kept = P.cohorts(P.map_template(P.mask_template(rows, TEMPLATE_ORIGIN), panel, folds), panel, folds)
    assert one(kept).retained is passes


def test_targets_do_not_move_the_mask(fixture):
    template, panel, folds = fixture
    other = panel.withColumn("target", F.col("target") * -3 + 1)
    a, b = (P.cohorts(P.map_template(template, p, folds), p, folds).select("lat2", "retained").orderBy("lat2").collect() for p in (panel, other))
    assert a == b


def test_asof_against_loops(spark):
    left = [(k, t, i) for i, (k, t) in enumerate([(1, 1), (1, 5), (1, 5), (2, 3), (3, 9)])]
    right = [(1, 1, "a"), (1, 4, "b"), (1, 5, "c"), (2, 4, "d"), (1, None, "x")]
    a, b = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, u int, x string")
    for strict in (False, True):
        got = {r.i: r.x for r in J.asof_join(a, b, ["k"], "t", "u", ["x"], strict).collect()}
        for k, t, i in left:
            hits = [(u, x) for kk, u, x in right if kk == k and u is not None and (u < t if strict else u <= t)]
            assert got[i] == (max(hits)[1] if hits else None)


def test_baselines_fall_back(spark):
    panel = spark.createDataFrame([(0, 0, D(2000, i + 1, 1), 10.0 + i, 11.0 + i) for i in range(5)], "lat2 long, lon2 long, m date, v double, target double")
    folds = spark.createDataFrame([("F", D(2000, 4, 1))], "fold_id string, origin date")
    stats = T.fitted(P.fit_window(panel, folds))
    assert one(stats["overall"]).global_mean == 12.0
    row = spark.createDataFrame([("F", 0, 0, D(2000, 4, 1), D(2000, 5, 1), D(2000, 4, 1), 99.0)], "fold_id string, lat2 long, lon2 long, input_month date, target_month date, last_observed_month date, target double")
    out = one(T.baseline(T.candidates(row, panel, stats), "seasonal_naive"))
    assert (out.prediction, out.fallback_level, out.fallback_stage, out.fallback_reason) == (13.0, 1, "persistence", "missing:seasonal_naive")


def test_quota_sample(spark):
    panel = spark.createDataFrame([(0, 0, D(2000, i + 1, 1), float(i), float(i + 1)) for i in range(6)], "lat2 long, lon2 long, m date, v double, target double")
    folds = spark.createDataFrame([("F", D(2000, 4, 1))], "fold_id string, origin date")
    rows = S.horizon_candidates(panel, folds, seed=1)
    assert {r.horizon: r["count"] for r in rows.groupBy("horizon").count().collect()} == {1: 3, 2: 2, 3: 1}
    sample = S.quota_sample(rows, {1: 2, 2: 1, 3: 1})
    assert {r.horizon: (r.n, r.w) for r in sample.groupBy("horizon").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w")).collect()} == {1: (2, 3.0), 2: (1, 2.0), 3: (1, 1.0)}
    assert sum(one(S.sample_violations(sample))) == 0
    for column, value in (("target_month", F.lit(D(2000, 9, 1))), ("target", F.lit(float("nan"))), ("source_month", F.lit(D(2005, 1, 1)))):
        assert sum(one(S.sample_violations(sample.withColumn(column, value)))) > 0


def test_metrics(spark):
    rows = spark.createDataFrame([(-2.0, -1.0, "a"), (2.0, -1.0, "b")], "target double, prediction double, g string")
    report = {(r.family, r.label): r for r in M.sliced(rows, {"g": F.col("g")}, {"g": ["a", "b", "c"]}).collect()}
    assert report["pooled", "all"].sse == 10 and abs(report["pooled", "all"].rmse - 5**0.5) < 1e-12
    assert report["g", "c"].n == 0 and report["g", "c"].rmse is None
    parts = spark.createDataFrame([(1, 9.0), (3, 3.0)], "n long, sse double")
    merged = one(M.merge(parts, []))
    assert (merged.n, merged.sse, merged.rmse) == (4, 12.0, 3**0.5)
    with pytest.raises(Exception, match="not finite"):
        M.check_finite(rows.withColumn("prediction", F.lit(float("nan"))), ["prediction"]).collect()


def test_neighbours_and_levels(spark):
    cells = spark.createDataFrame([(0, 0, 1, 2.0), (0, 2, 1, 4.0)], "lat2 long, lon2 long, cal int, x double")
    near = {(r.lat2, r.lon2): (r.neighbour_x, r.neighbour_count) for r in J.neighbour_means(cells, ["cal"], ["x"]).collect()}
    assert near[0, 1] == (3.0, 2) and (0, 0) not in near
    levels = T.reference_levels(cells, "x")
    got = T.with_reference(spark.createDataFrame([(9, 9, 1), (0, 0, 1), (9, 9, 5)], "lat2 long, lon2 long, cal int"), levels).collect()
    assert sorted((r.reference, r.reference_level) for r in got) == [(2.0, 0), (3.0, 2), (3.0, 3)]
