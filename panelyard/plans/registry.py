"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import contracts as K
from ..operators import features as X
from ..operators import governance as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as L
from ..operators import panel as P
from ..operators import profile as I
from ..operators import sampling as S
from ..operators import statistics as T
from ..sources import files
from . import sql
from .tables import COVARIATES, ENCODING, GROUPS, INDEX, ORIGIN, World, panel, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None, *views: str, plain: bool = False):
    """Register a query of the fold pipeline (or, ``plain``, of spark and folder) with its SQL."""

    def add(f):
        QUERIES[name] = f if plain else lambda spark, sf_dir: f(World(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = sql.nudged(oracle if plain else sql.of(oracle, *views))
        return f

    return add


def band():
    return C.latitude_band(F.col("lat2") * 5 - 60)


def near(x, digits: int = 4):
    """``x`` rounded. Engines round halves, and sum doubles, each in their way: a nudge avoids both."""
    return F.round(C.col(x) + F.lit(sql.NUDGE), digits)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(near(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# panel
register("panel_monthly", "SELECT lat2, lon2, m, round(v, 4) v, n, round(urgent, 4) urgent, round(acct, 4) acct FROM panel")(lambda w: rounded(w.panel.select("lat2", "lon2", "m", "v", "n", "urgent", "acct")))
register("panel_index", "SELECT lat2, lon2, m, round(spei_01, 4) spei_01, round(spei_03, 4) spei_03, round(spei_06, 4) spei_06, round(spei_12, 4) spei_12, round(month_sin, 4) month_sin, round(month_cos, 4) month_cos FROM panel")(
    lambda w: rounded(w.panel.select("lat2", "lon2", "m", *INDEX, *ENCODING))
)
register("panel_target_next_month", "SELECT lat2, lon2, m, round(target, 4) target FROM panel")(lambda w: rounded(w.panel.select("lat2", "lon2", "m", "target")))
register("panel_location_key", "SELECT DISTINCT lat2, lon2, 'lat2=' || lat2 || ';lon2=' || lon2 location_id, lat2 back_lat2, lon2 back_lon2 FROM panel")(
    lambda w: w.panel.select("lat2", "lon2").distinct().withColumn("location_id", C.location_id()).withColumns(dict(zip(("back_lat2", "back_lon2"), C.parse_location("location_id"), strict=True)))
)
register("mask_template", "SELECT * FROM template")(lambda w: w.template)
register("template_summary", "SELECT count(*)::BIGINT n_rows, count(DISTINCT (lat2, lon2))::BIGINT n_cells, count(DISTINCT rel)::BIGINT n_months, (count(*) FILTER (masked))::BIGINT n_masked, (count(DISTINCT (lat2, lon2)) * count(DISTINCT rel) - count(*))::BIGINT omitted_slots FROM template")(
    lambda w: P.template_summary(w.template)
)
register(
    "origin_coverage",
    """SELECT fold_id, count(*)::BIGINT n_months, (count(*) FILTER (i))::BIGINT n_input, (count(*) FILTER (t))::BIGINT n_target, bool_and(i AND t) complete FROM (
  SELECT fold_id, (origin + to_months(rel))::DATE IN (SELECT m FROM panel) i, (origin + to_months(rel + 1))::DATE IN (SELECT m FROM panel) t FROM (SELECT DISTINCT rel FROM template) CROSS JOIN folds) GROUP BY fold_id""",
)(lambda w: P.origin_coverage(w.template, w.panel, w.folds))
register("fold_mapped", "SELECT fold_id, lat2, lon2, rel, masked, input_month, target_month, matched, round(\"value\", 4) \"value\", round(target, 4) target FROM mapped")(
    lambda w: rounded(w.mapped.select("fold_id", "lat2", "lon2", "rel", "masked", "input_month", "target_month", "matched", "value", "target"))
)
register("fold_cohorts", "SELECT * FROM cohorts")(lambda w: w.cohorts)
register("fold_sources", "SELECT fold_id, lat2, lon2, source_month, round(source_value, 4) source_value FROM sources")(lambda w: rounded(w.sources))
register("fold_retained", "SELECT fold_id, lat2, lon2, rel, masked, expected_horizon, input_month, target_month, round(target, 4) target, round(available, 4) available, provenance, last_observed_month, round(last_observed, 4) last_observed, horizon FROM retained")(
    lambda w: rounded(w.retained.drop("origin"))
)
register(
    "fold_audit",
    """SELECT * FROM (SELECT fold_id, count(*)::BIGINT cells, (count(*) FILTER (retained))::BIGINT retained_cells, sum(CASE WHEN retained THEN n_rows ELSE 0 END)::BIGINT retained_rows,
  (count(*) FILTER (NOT path_complete))::BIGINT path_incomplete, (count(*) FILTER (path_complete AND NOT target_complete))::BIGINT target_incomplete,
  (count(*) FILTER (path_complete AND target_complete AND NOT history_ok))::BIGINT history_excluded FROM cohorts GROUP BY fold_id)
JOIN (SELECT fold_id, count(*)::BIGINT "rows", (count(*) FILTER (target IS NULL))::BIGINT null_targets, (count(*) FILTER (last_observed_month > input_month))::BIGINT future_sources, (count(*) FILTER (horizon IS DISTINCT FROM expected_horizon))::BIGINT horizon_mismatches,
  (count(*) FILTER (masked <> (available IS NULL)))::BIGINT mask_mismatches, (count(*) - count(DISTINCT (lat2, lon2, input_month)))::BIGINT duplicates,
  (count(*) - (SELECT sum(n_rows) FROM cohorts c WHERE c.retained AND c.fold_id = r.fold_id))::BIGINT unaccounted_rows FROM retained r GROUP BY fold_id) USING (fold_id)""",
)(lambda w: P.fold_audit(w.mapped, w.cohorts, w.retained))
register("fold_horizon_counts", "SELECT fold_id, horizon, count(*)::BIGINT n FROM retained GROUP BY ALL")(lambda w: w.retained.groupBy("fold_id", "horizon").agg(F.count("*").alias("n")))
register("fold_band_exclusions", f"SELECT fold_id, {sql.BAND} band, count(*)::BIGINT n, min(lat2) first_lat2 FROM cohorts WHERE NOT retained GROUP BY ALL")(
    lambda w: w.cohorts.where("not retained").groupBy("fold_id", band().alias("band")).agg(F.count("*").alias("n"), F.min("lat2").alias("first_lat2"))
)
register("cross_fold_overlap_months", "SELECT input_month FROM mapped WHERE fold_id = 'F01' INTERSECT SELECT (input_month - INTERVAL 14 MONTH)::DATE FROM mapped WHERE fold_id = 'F02'")(
    lambda w: w.mapped.where("fold_id = 'F01'").select("input_month").intersect(w.mapped.where("fold_id = 'F02'").select(C.add_months("input_month", -14).alias("input_month")))
)
register("cross_fold_overlap_keys", "SELECT lat2, lon2, rel, count(DISTINCT fold_id)::BIGINT n_folds FROM retained GROUP BY ALL HAVING count(DISTINCT fold_id) > 1")(lambda w: P.overlap(w.retained, ["lat2", "lon2", "rel"]))
register("duplicate_keys", "SELECT o_custkey, o_orderstatus, count(*)::BIGINT n FROM orders GROUP BY ALL HAVING count(*) > 1", plain=True)(lambda spark, d: P.duplicate_keys(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"]))
register("fit_window_rows", "SELECT fold_id, lat2, lon2, m, round(target, 4) target FROM fit")(lambda w: rounded(w.fit.select("fold_id", "lat2", "lon2", "m", "target")))

# statistics and baselines
register("stat_global", "SELECT fold_id, round(global_mean, 4) global_mean FROM st_all")(lambda w: rounded(w.stats["overall"]))
register("stat_location", "SELECT fold_id, lat2, lon2, round(location_mean, 4) location_mean FROM st_cell")(lambda w: rounded(w.stats["cell"]))
register("stat_climatology", "SELECT fold_id, lat2, lon2, cal, round(climatology, 4) location_calendar_month_climatology FROM st_cal")(lambda w: rounded(w.stats["climatology"]))
register("stat_trend", "SELECT fold_id, lat2, lon2, round(slope, 4) slope, round(intercept, 2) intercept FROM st_trend")(lambda w: w.stats["trend"].select("fold_id", "lat2", "lon2", near("slope", 4).alias("slope"), near("intercept", 2).alias("intercept")))
register("stat_trend_seasonal", "SELECT fold_id, lat2, lon2, cal, round(seasonal_rest, 3) seasonal_rest FROM st_rest")(lambda w: rounded(w.stats["seasonal"], 3))
for _name in T.CHAINS:
    register(f"baseline_{_name}", "SELECT fold_id, lat2, lon2, input_month, horizon, round(prediction, 3) prediction, fallback_level, fallback_stage, fallback_reason FROM scored", sql.scored(_name))(
        lambda w, name=_name: rounded(w.baseline(name).select("fold_id", "lat2", "lon2", "input_month", "horizon", "prediction", "fallback_level", "fallback_stage", "fallback_reason"), 3)
    )
register("fallback_counts", "SELECT fallback_stage, count(*)::BIGINT n FROM scored GROUP BY ALL", sql.scored("location_trend_seasonal"))(lambda w: w.baseline("location_trend_seasonal").groupBy("fallback_stage").agg(F.count("*").alias("n")))

# examples and samples
register("horizon_candidates", "SELECT fold_id, location_id, target_month, horizon, source_month, round(last_observed, 4) last_observed, selection_hash FROM examples")(
    lambda w: rounded(w.examples().select("fold_id", "location_id", "target_month", "horizon", "source_month", "last_observed", "selection_hash"))
)
register("horizon_population", "SELECT fold_id, horizon, count(*)::BIGINT n FROM examples GROUP BY ALL")(lambda w: w.examples().groupBy("fold_id", "horizon").agg(F.count("*").alias("n")))
register("stratified_sample", "SELECT fold_id, location_id, target_month, horizon, selection_hash FROM sample")(lambda w: w.sample().select("fold_id", "location_id", "target_month", "horizon", "selection_hash"))
register("sample_weights", "SELECT fold_id, horizon, population, kept, round(min(sample_weight), 6) sample_weight, round(sum(sample_weight), 3) total FROM sample GROUP BY fold_id, horizon, population, kept")(
    lambda w: w.sample().groupBy("fold_id", "horizon", "population", F.col("retained").alias("kept")).agg(near(F.min("sample_weight"), 6).alias("sample_weight"), near(F.sum("sample_weight"), 3).alias("total"))
)
_SAMPLE_CHECKS = """(count(*) - count(DISTINCT (fold_id, lat2, lon2, target_month, horizon)))::BIGINT duplicate_keys,
  (count(*) FILTER (NOT coalesce(target_month = (m + INTERVAL 1 MONTH)::DATE, false)))::BIGINT bad_calendar,
  (count(*) FILTER (NOT coalesce(date_diff('month', source_month, target_month) = horizon AND horizon BETWEEN 1 AND 7, false)))::BIGINT bad_horizon,
  (count(*) FILTER (NOT coalesce(source_month <= m, false)))::BIGINT future_source, (count(*) FILTER (NOT coalesce(target_month <= origin, false)))::BIGINT past_cutoff,
  (count(*) FILTER (NOT coalesce(isfinite(target) AND isfinite(last_observed), false)))::BIGINT non_finite"""
register("sample_validation", f"SELECT {_SAMPLE_CHECKS} FROM sample")(lambda w: S.sample_violations(w.sample()))
#: What is broken in which rows of the sample: a column, its value in SQL, and the horizon of the rows.
_SAMPLE_FAULTS = (("m", "NULL", 1), ("target_month", "(target_month + INTERVAL 1 MONTH)::DATE", 2), ("horizon", "horizon + 5", 3), ("source_month", "NULL", 4), ("source_month", "(m + INTERVAL 2 MONTH)::DATE", 5), ("target", "'NaN'::DOUBLE", 6), ("last_observed", "NULL", 7))


def _faulty_sample(w: World) -> DataFrame:
    values = {
        "m": [(1, F.lit(None))],
        "target_month": [(2, C.add_months("target_month", 1))],
        "horizon": [(3, F.col("horizon") + 5)],
        "source_month": [(4, F.lit(None)), (5, C.add_months("m", 2))],
        "target": [(6, F.lit(float("nan")))],
        "last_observed": [(7, F.lit(None))],
    }
    rows = w.sample()
    out = {c: F.col(c) for c in values}
    for c, faults in values.items():
        for h, v in faults:
            out[c] = F.when(F.col("horizon") == h, v).otherwise(out[c])
    rows = rows.withColumns({c: v.cast(rows.schema[c].dataType) for c, v in out.items()})
    return rows.unionByName(rows.where("horizon = 7"))


_FAULTY = "faulty AS (SELECT * REPLACE (" + ", ".join(f"(CASE {' '.join(f'WHEN horizon = {h} THEN {v}' for x, v, h in _SAMPLE_FAULTS if x == c)} ELSE {c} END)::{t} AS {c}" for c, t in (("m", "DATE"), ("target_month", "DATE"), ("horizon", "INT"), ("source_month", "DATE"), ("target", "DOUBLE"), ("last_observed", "DOUBLE"))) + ") FROM sample)"
register("sample_validation_faults", f"SELECT {_SAMPLE_CHECKS} FROM (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE horizon = 7)", _FAULTY)(lambda w: S.sample_violations(_faulty_sample(w)))
register("validation_features", "SELECT fold_id, lat2, lon2, input_month, horizon, n, round(urgent, 4) urgent, round(acct, 4) acct, round(last_value, 4) last_value FROM feat")(
    lambda w: rounded(w.features().select("fold_id", "lat2", "lon2", "input_month", "horizon", *COVARIATES, "last_value"))
)
register("residual_target_reconstruct", "SELECT fold_id, lat2, lon2, input_month, round(target - last_value, 3) residual, round(target, 3) rebuilt FROM feat")(
    lambda w: rounded(X.residual_rows(w.features()).select("fold_id", "lat2", "lon2", "input_month", "residual", "rebuilt"), 3)
)

# as-of joins
_EVENTS = "SELECT l.event_id, l.user_id, l.ts, r.event_id purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"


def _asof_events(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"))
    left = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return J.asof_join(left, right, ["user_id"], "ts", "purchase_ts", ["purchase_id"], strict).drop("purchase_ts")


register("asof_backward", _EVENTS, plain=True)(_asof_events)
register("asof_backward_strict", _EVENTS.replace(">=", ">"), plain=True)(lambda spark, d: _asof_events(spark, d, True))
register("asof_strict", "SELECT fold_id, lat2, lon2, input_month, second_month, round(second_value, 4) second_value FROM history")(lambda w: rounded(w.history().select("fold_id", "lat2", "lon2", "input_month", "second_month", "second_value")))
register("asof_seasonal", "SELECT fold_id, lat2, lon2, input_month, season_month, round(season_value, 4) season_value FROM history")(lambda w: rounded(w.history().select("fold_id", "lat2", "lon2", "input_month", "season_month", "season_value")))
_HISTORY = ("gap_months", "slope", "season_age_months", "season_difference", "second_available", "slope_available", "season_available")
register("history_features", "SELECT fold_id, lat2, lon2, input_month, gap_months, round(slope, 3) slope, season_age_months, round(season_difference, 3) season_difference, second_available, slope_available, season_available FROM history")(
    lambda w: rounded(w.history().select("fold_id", "lat2", "lon2", "input_month", *_HISTORY), 3)
)
_ENHANCED = ("second_value", "gap_months", "slope", "season_value", "season_age_months", "season_difference", "spei_01_minus_03", "spei_03_minus_06", "spei_06_minus_12", "anomaly", "lat_sin", "lat_cos", "lon_sin", "lon_cos", "second_available", "slope_available", "season_available", "season_difference_available", "anomaly_available")
register(
    "enhanced_features",
    """SELECT h.fold_id, h.lat2, h.lon2, h.input_month, round(second_value, 3) second_value, gap_months, round(slope, 3) slope, round(season_value, 3) season_value, season_age_months, round(season_difference, 3) season_difference,
  round(spei_01 - spei_03, 3) spei_01_minus_03, round(spei_03 - spei_06, 3) spei_03_minus_06, round(spei_06 - spei_12, 3) spei_06_minus_12, round(h.acct - coalesce(rm.mean, rc.mean), 3) anomaly,
  round(sin(radians(h.lat2 / 2.0)), 3) lat_sin, round(cos(radians(h.lat2 / 2.0)), 3) lat_cos, round(sin(radians(h.lon2 / 2.0)), 3) lon_sin, round(cos(radians(h.lon2 / 2.0)), 3) lon_cos,
  second_available, slope_available, season_available, (season_month IS NOT NULL AND last_value IS NOT NULL)::INT season_difference_available, (coalesce(rm.mean, rc.mean) IS NOT NULL)::INT anomaly_available
FROM history h LEFT JOIN (SELECT fold_id, lat2, lon2, month(m) cal, avg(acct) mean FROM panel JOIN folds ON m < origin GROUP BY ALL) rm ON rm.fold_id = h.fold_id AND rm.lat2 = h.lat2 AND rm.lon2 = h.lon2 AND rm.cal = month(h.input_month)
LEFT JOIN (SELECT fold_id, lat2, lon2, avg(acct) mean FROM panel JOIN folds ON m < origin GROUP BY ALL) rc ON rc.fold_id = h.fold_id AND rc.lat2 = h.lat2 AND rc.lon2 = h.lon2""",
)(lambda w: rounded(w.enhanced().select("fold_id", "lat2", "lon2", "input_month", *_ENHANCED), 3))
register(
    "feature_availability",
    """SELECT 'overall' family, 'all' "label", round(avg(second_available), 4) second_available, round(avg(season_available), 4) season_available, count(*)::BIGINT n FROM history
UNION ALL SELECT 'provenance', provenance, round(avg(second_available), 4), round(avg(season_available), 4), count(*)::BIGINT FROM history GROUP BY provenance
UNION ALL SELECT 'horizon', horizon::VARCHAR, round(avg(second_available), 4), round(avg(season_available), 4), count(*)::BIGINT FROM history GROUP BY horizon""",
)(lambda w: rounded(X.availability(w.history(), ["second_available", "season_available"], ["provenance", "horizon"])))

# reference levels, climatologies, neighbours
_LEVELS = "lv AS (SELECT DISTINCT lat2, lon2, month(m)::INT cal, m, acct FROM panel)"
_SETS = "SELECT lat2, lon2, cal, 0 reference_level, avg(acct) mean, count(acct)::BIGINT n FROM lv GROUP BY lat2, lon2, cal UNION ALL SELECT lat2, lon2, NULL, 1, avg(acct), count(acct) FROM lv GROUP BY lat2, lon2 UNION ALL SELECT NULL, NULL, cal, 2, avg(acct), count(acct) FROM lv GROUP BY cal UNION ALL SELECT NULL, NULL, NULL, 3, avg(acct), count(acct) FROM lv"


def _levels(w: World) -> DataFrame:
    return T.reference_levels(w.panel.select("lat2", "lon2", F.month("m").alias("cal"), "m", "acct"), "acct")


register("soil_reference_levels", f"SELECT lat2, lon2, cal, reference_level, round(mean, 3) mean, n FROM ({_SETS})", _LEVELS)(lambda w: rounded(_levels(w), 3))
register(
    "soil_anomaly",
    "SELECT p.lat2, p.lon2, p.m, round(p.acct - coalesce(a.mean, b.mean), 3) anomaly, CASE WHEN a.mean IS NOT NULL THEN 0 ELSE 1 END reference_level FROM panel p LEFT JOIN sets a ON a.reference_level = 0 AND a.lat2 = p.lat2 AND a.lon2 = p.lon2 AND a.cal = month(p.m) LEFT JOIN sets b ON b.reference_level = 1 AND b.lat2 = p.lat2 AND b.lon2 = p.lon2",
    _LEVELS,
    f"sets AS ({_SETS})",
)(lambda w: T.with_reference(w.panel.withColumn("cal", F.month("m")), _levels(w)).select("lat2", "lon2", "m", near(F.col("acct") - F.col("reference"), 3).alias("anomaly"), "reference_level"))
_CHANGE = "ch AS (SELECT fold_id, lat2, lon2, month(source_month)::INT source_cal, month(target_month)::INT target_cal, floor((lat2/2.0 + 90)/30)::INT band, target - last_observed change FROM examples)"
register("change_climatology", "SELECT fold_id, lat2, lon2, source_cal, target_cal, round(avg(change), 3) cell_change, count(*)::BIGINT n FROM ch GROUP BY ALL", _CHANGE)(lambda w: rounded(T.change_climatology(w.examples())["cell"], 3))
register("change_climatology_levels", "SELECT fold_id, band, source_cal, target_cal, round(avg(change), 3) change FROM ch GROUP BY ALL UNION ALL SELECT fold_id, NULL, source_cal, target_cal, round(avg(change), 3) FROM ch GROUP BY ALL", _CHANGE)(
    lambda w: rounded((c := T.change_climatology(w.examples()))["band"].select("fold_id", "band", "source_cal", "target_cal", F.col("band_change").alias("change")).unionByName(c["all"].select("fold_id", F.lit(None).cast("int").alias("band"), "source_cal", "target_cal", F.col("all_change").alias("change"))), 3)
)
register(
    "seasonal_anchor",
    """SELECT r.fold_id, r.lat2, r.lon2, r.input_month, round(r.last_observed + coalesce(c.x, b.x, g.x, 0), 3) anchor, CASE WHEN c.x IS NOT NULL THEN 0 WHEN b.x IS NOT NULL THEN 1 WHEN g.x IS NOT NULL THEN 2 ELSE 3 END anchor_level FROM retained r
LEFT JOIN (SELECT fold_id, lat2, lon2, source_cal, target_cal, avg(change) x FROM ch GROUP BY ALL) c ON c.fold_id = r.fold_id AND c.lat2 = r.lat2 AND c.lon2 = r.lon2 AND c.source_cal = month(r.last_observed_month) AND c.target_cal = month(r.target_month)
LEFT JOIN (SELECT fold_id, band, source_cal, target_cal, avg(change) x FROM ch GROUP BY ALL) b ON b.fold_id = r.fold_id AND b.band = floor((r.lat2/2.0 + 90)/30) AND b.source_cal = month(r.last_observed_month) AND b.target_cal = month(r.target_month)
LEFT JOIN (SELECT fold_id, source_cal, target_cal, avg(change) x FROM ch GROUP BY ALL) g ON g.fold_id = r.fold_id AND g.source_cal = month(r.last_observed_month) AND g.target_cal = month(r.target_month)""",
    _CHANGE,
)(lambda w: T.seasonal_anchor(w.retained, T.change_climatology(w.examples())).select("fold_id", "lat2", "lon2", "input_month", near("anchor", 3).alias("anchor"), "anchor_level"))
for _step in (1, 2):
    register(
        f"neighbour_features_step{_step}",
        f"SELECT lat2 - a lat2, lon2 - b lon2, m, round(avg(v), 3) neighbour_v, round(avg(acct), 3) neighbour_acct, count(*)::BIGINT neighbour_count FROM panel CROSS JOIN (VALUES (-{_step},0),({_step},0),(0,-{_step}),(0,{_step})) d(a, b) GROUP BY lat2 - a, lon2 - b, m",
    )(lambda w, step=_step: rounded(J.neighbour_means(w.panel, ["m"], ["v", "acct"], step), 3))
register("spherical_encoding", "SELECT DISTINCT lat2, lon2, round(sin(radians(lat2/2.0)), 6) lat_sin, round(cos(radians(lat2/2.0)), 6) lat_cos, round(sin(radians(lon2/2.0)), 6) lon_sin, round(cos(radians(lon2/2.0)), 6) lon_cos FROM panel")(
    lambda w: rounded(w.panel.select("lat2", "lon2").distinct().withColumns(C.spherical(F.col("lat2") / 2, F.col("lon2") / 2)), 6)
)
register("recency_weight", "SELECT m, round(pow(0.5, date_diff('month', m, (SELECT max(m) FROM panel)) / 24.0), 6) weight, count(*)::BIGINT n FROM panel GROUP BY m")(
    lambda w: w.panel.groupBy("m").agg(F.count("*").alias("n")).crossJoin(F.broadcast(w.panel.agg(F.max("m").alias("latest")))).select("m", near(C.recency_weight("m", "latest"), 6).alias("weight"), "n")
)
register("recent_block", "SELECT lat2, lon2, m, round(v, 4) last_observed, round(target, 4) target FROM panel JOIN (SELECT lat2, lon2 FROM panel WHERE m < DATE '1998-06-01' AND v IS NOT NULL GROUP BY ALL HAVING count(*) >= 12) USING (lat2, lon2) WHERE m BETWEEN DATE '1999-01-01' AND DATE '1999-12-01' AND target IS NOT NULL")(
    lambda w: rounded(X.recent_block(w.panel, "1999-01-01", "1999-12-01", "1998-06-01").select("lat2", "lon2", "m", "last_observed", "target"))
)
register("recent_rmse_latest_3", f"SELECT fold_id, {sql.ERRORS} FROM (SELECT *, max(input_month) OVER (PARTITION BY fold_id) mx FROM scored) WHERE input_month > (mx - INTERVAL 3 MONTH)::DATE GROUP BY fold_id", sql.scored("persistence"))(
    lambda w: _errors(X.latest_months(w.baseline("persistence"), 3), "fold_id")
)


def _errors(rows: DataFrame, *by: str) -> DataFrame:
    out = rows.groupBy(*by).agg(*M.accumulate())
    return out.withColumns({"sse": near("sse", -2), "rmse": near("rmse", 4)})


# metrics
register("metrics_pooled", f"SELECT {sql.ERRORS} FROM scored", sql.scored("persistence"))(lambda w: _errors(w.baseline("persistence")))
for _label, _column, _sql in (("fold", lambda: F.col("fold_id"), "fold_id"), ("horizon", lambda: F.col("horizon"), "horizon"), ("mask", lambda: F.col("provenance"), "provenance"), ("band", band, sql.BAND), ("bin", lambda: C.index_bin((F.col("lat2") - 12) / 4), None)):
    _case = _sql or "CASE WHEN (lat2-12)/4.0 < -2 THEN '(-inf,-2)' WHEN (lat2-12)/4.0 < -1.5 THEN '[-2,-1.5)' WHEN (lat2-12)/4.0 < -1 THEN '[-1.5,-1)' WHEN (lat2-12)/4.0 < 1 THEN '[-1,1)' WHEN (lat2-12)/4.0 < 1.5 THEN '[1,1.5)' WHEN (lat2-12)/4.0 < 2 THEN '[1.5,2)' ELSE '[2,inf)' END"
    register(f"metrics_by_{_label}", f"SELECT {_case} slice, {sql.ERRORS} FROM scored GROUP BY ALL", sql.scored("persistence"))(lambda w, c=_column: _errors(w.baseline("persistence").withColumn("slice", c()), "slice"))
register("metrics_merge", f"SELECT fold_id, {sql.ERRORS} FROM scored GROUP BY fold_id", sql.scored("persistence"))(
    lambda w: M.merge(w.baseline("persistence").groupBy("fold_id", "horizon").agg(*M.accumulate()), ["fold_id"]).withColumns({"sse": near("sse", -2), "rmse": near("rmse", 4)})
)


def _report(w: World, name: str) -> DataFrame:
    families = {"fold": F.col("fold_id"), "horizon": F.col("horizon"), "mask": F.col("provenance"), "band": band(), **{c: C.index_bin(c) for c in INDEX}}
    labels = {"horizon": list(range(1, 8)), "band": [b for _, b in C.LATITUDE_BANDS], **{c: [b for _, b in C.INDEX_BINS] for c in INDEX}}
    return M.sliced(w.indexed(w.baseline(name)), families, labels)


_REPORT = "SELECT family, \"label\", n, round(sse, -2) sse, round(rmse, 4) rmse FROM rep"


def _report_sql(name: str, view: str = "rep", source: str = "scored") -> tuple[str, ...]:
    cols = "count(*)::BIGINT n, sum(pow(prediction - target, 2)) sse, sqrt(avg(pow(prediction - target, 2))) rmse"
    return (
        sql.scored(name, f"{source}_plain"),
        f"{source} AS (SELECT s.*, {', '.join(INDEX)} FROM {source}_plain s JOIN panel p ON p.lat2 = s.lat2 AND p.lon2 = s.lon2 AND p.m = s.input_month)",
        f"{view}0 AS ({''.join(f"SELECT '{c}' family, {sql.index_bin(c)} \"label\", {cols} FROM {source} GROUP BY ALL UNION ALL " for c in INDEX)}SELECT 'pooled' family, 'all' \"label\", {cols} FROM {source} UNION ALL SELECT 'fold', fold_id, {cols} FROM {source} GROUP BY fold_id UNION ALL SELECT 'horizon', horizon::VARCHAR, {cols} FROM {source} GROUP BY horizon UNION ALL SELECT 'mask', provenance, {cols} FROM {source} GROUP BY provenance UNION ALL SELECT 'band', {sql.BAND}, {cols} FROM {source} GROUP BY ALL)",
        f"{view} AS (SELECT family, \"label\", coalesce(n, 0)::BIGINT n, coalesce(sse, 0.0) sse, rmse FROM {view}0 FULL JOIN (SELECT 'horizon' family, x::VARCHAR \"label\" FROM range(1, 8) r(x) UNION ALL SELECT 'band', unnest(['[-90,-60)', '[-60,-30)', '[-30,0)', '[0,30)', '[30,60)', '[60,90]']){''.join(f" UNION ALL SELECT '{c}', unnest({sql.INDEX_LABELS})" for c in INDEX)}) USING (family, \"label\"))",
    )


register("metrics_report", _REPORT, *_report_sql("seasonal_naive"))(lambda w: _report(w, "seasonal_naive").withColumns({"sse": near("sse", -2), "rmse": near("rmse", 4)}))
register("metrics_empty_slices", "SELECT family, \"label\" FROM rep WHERE n = 0", *_report_sql("persistence"))(lambda w: _report(w, "persistence").where("n = 0").select("family", "label"))
register("worst_slices", "SELECT family, \"label\", round(rmse, 4) rmse FROM rep WHERE n > 0 AND family = 'band' ORDER BY rmse DESC, \"label\" LIMIT 3", *_report_sql("persistence"))(
    lambda w: _report(w, "persistence").where("n > 0 and family = 'band'").orderBy(F.desc("rmse"), "label").limit(3).select("family", "label", near("rmse", 4).alias("rmse"))
)
register("mae_rmse_r2", "SELECT fold_id, round(avg(abs(target - prediction)), 4) mae, round(sqrt(avg(pow(target - prediction, 2))), 4) rmse, round(1 - sum(pow(target - prediction, 2)) / (var_pop(target) * count(target)), 6) r2 FROM scored GROUP BY fold_id", sql.scored("location_mean"))(
    lambda w: w.baseline("location_mean").groupBy("fold_id").agg(*M.scores()).select("fold_id", near("mae", 4).alias("mae"), near("rmse", 4).alias("rmse"), near("r2", 6).alias("r2"))
)
_Q = ", ".join(f"round(quantile_cont(x, {q}), 4) q{int(q * 100):02d}" for q in M.QUANTILES)
register(
    "numeric_summary_quantiles",
    f"SELECT feature, count(*)::BIGINT n, (count(*) FILTER (x IS NULL))::BIGINT missing, round(min(x), 4) lo, round(max(x), 4) hi, round(avg(x), 4) mean, round(stddev_pop(x), 4) std, {_Q} FROM (SELECT 'l_quantity' feature, l_quantity x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY feature",
    plain=True,
)(lambda spark, d: rounded(M.numeric_summary(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])))
register(
    "drift_out_of_range",
    "SELECT l_returnflag, count(*)::BIGINT n, (count(*) FILTER (l_quantity < ql OR l_quantity > qh))::BIGINT l_quantity_outside, (count(*) FILTER (l_extendedprice < pl OR l_extendedprice > ph))::BIGINT l_extendedprice_outside FROM lineitem CROSS JOIN (SELECT min(l_quantity) ql, max(l_quantity) qh, min(l_extendedprice) pl, max(l_extendedprice) ph FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01') WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY l_returnflag",
    plain=True,
)(lambda spark, d: M.out_of_range((t := read(spark, d, "lineitem")).where("l_shipdate >= timestamp_ntz '2000-01-01'"), t.where("l_shipdate < timestamp_ntz '1995-02-01'"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]))

# profiles
register(
    "integrity_profile",
    "SELECT count(*)::BIGINT n_rows, count(DISTINCT l_orderkey)::BIGINT n_keys, (count(l_orderkey) - count(DISTINCT l_orderkey))::BIGINT duplicate_keys, "
    + ", ".join(f"(count(*) FILTER ({c} IS NULL))::BIGINT {c}_nulls" for c in ("l_orderkey", "l_quantity", "l_returnflag"))
    + ", (count(*) FILTER (isnan(l_quantity)))::BIGINT l_quantity_nans FROM lineitem",
    plain=True,
)(lambda spark, d: I.integrity(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), "l_orderkey"))
register(
    "checksum_compare",
    "SELECT round(qa, 2) l_quantity_a, round(qb, 2) l_quantity_b, abs(qa - qb) <= 1e-10 * greatest(abs(qa), abs(qb)) l_quantity_agrees, round(ta, 2) l_tax_a, round(tb, 2) l_tax_b, abs(ta - tb) <= 1e-10 * greatest(abs(ta), abs(tb)) l_tax_agrees FROM (SELECT sum(l_quantity) qa, sum(l_quantity + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) qb, sum(l_tax) ta, sum(l_tax) tb FROM lineitem)",
    plain=True,
)(lambda spark, d: rounded(I.checksum_compare((t := read(spark, d, "lineitem")), t.withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)), ["l_quantity", "l_tax"]), 2))
register("distinct_dup_ids", "SELECT count(DISTINCT (user_id, event_type))::BIGINT pairs, count(DISTINCT event_id)::BIGINT ids, (count(*) - count(DISTINCT event_id))::BIGINT duplicates FROM events", plain=True)(
    lambda spark, d: read(spark, d, "events").agg(F.count_distinct(F.struct("user_id", "event_type")).alias("pairs"), F.count_distinct("event_id").alias("ids"), (F.count("*") - F.count_distinct("event_id")).alias("duplicates"))
)
register("value_counts", "SELECT event_type \"value\", count(*)::BIGINT n FROM events GROUP BY ALL", plain=True)(lambda spark, d: I.value_counts(read(spark, d, "events"), "event_type"))
register(
    "structural_violations",
    """SELECT (count(*) FILTER (m IS NULL OR lat IS NULL OR lon IS NULL))::BIGINT null_keys, (count(*) FILTER (day(m) <> 1))::BIGINT bad_days, (count(*) FILTER (abs(lat) > 90 OR abs(lon) > 180))::BIGINT bad_ranges,
  (count(*) FILTER (lat * 2 <> floor(lat * 2) OR lon * 2 <> floor(lon * 2)))::BIGINT off_grid, (count(*) FILTER (NOT coalesce(isfinite(v), false)))::BIGINT v_not_finite FROM broken""",
    """broken AS (SELECT CASE WHEN lat2 = 1 THEN NULL WHEN lat2 = 2 THEN m + 3 ELSE m END m, CASE WHEN lat2 = 3 THEN 91.0 ELSE lat2 / 4.0 END::DOUBLE lat,
  CASE WHEN lat2 = 4 THEN NULL WHEN lat2 = 5 THEN -200.5 ELSE lon2 / 2.0 END::DOUBLE lon, CASE WHEN lat2 = 6 THEN 'NaN'::DOUBLE WHEN lat2 = 7 THEN NULL ELSE v END v FROM panel)""",
)(
    lambda w: I.structural_violations(
        w.panel.select(
            F.when(F.col("lat2") == 1, None).when(F.col("lat2") == 2, F.date_add("m", 3)).otherwise(F.col("m")).alias("m"),
            F.when(F.col("lat2") == 3, 91.0).otherwise(F.col("lat2") / 4).alias("lat"),
            F.when(F.col("lat2") == 4, None).when(F.col("lat2") == 5, -200.5).otherwise(F.col("lon2") / 2).alias("lon"),
            F.when(F.col("lat2") == 6, float("nan")).when(F.col("lat2") == 7, None).otherwise(F.col("v")).alias("v"),
        ),
        "m",
        "lat",
        "lon",
        ["v"],
    )
)

# ensembles, ranking, contracts
_PARTS = ("persistence", "location_mean", "seasonal_naive")


def _components(w: World) -> DataFrame:
    keys = ["fold_id", "lat2", "lon2", "input_month", "horizon", "target"]
    return w.candidates().select(*keys, F.col("persistence"), F.col("location_mean"), F.coalesce("seasonal_naive", "persistence").alias("seasonal_naive"))


register(
    "ensemble_gram",
    "SELECT fold_id, " + ", ".join(f"round(sum({a} * {b}), 0) {a}__{b}" for i, a in enumerate(_PARTS) for b in _PARTS[i:]) + ", " + ", ".join(f"round(sum({a} * target), 0) {a}__y" for a in _PARTS) + ", count(*)::BIGINT n FROM parts GROUP BY fold_id",
    "parts AS (SELECT fold_id, target, persistence, location_mean, coalesce(seasonal_naive, persistence) seasonal_naive FROM cand)",
)(lambda w: rounded(L.gram(_components(w), list(_PARTS), ["fold_id"]), 0))
register(
    "ensemble_apply",
    "SELECT fold_id, lat2, lon2, input_month, round(0.5 * persistence + 0.3 * location_mean + 0.2 * coalesce(seasonal_naive, persistence), 3) prediction FROM cand",
)(lambda w: rounded(L.apply_blend(_components(w).withColumns({f"w_{c}": F.lit(x) for c, x in zip(_PARTS, (0.5, 0.3, 0.2), strict=True)}), list(_PARTS)).select("fold_id", "lat2", "lon2", "input_month", "prediction"), 3))
register("specialist_routing", "SELECT fold_id, CASE WHEN horizon = 1 THEN 'G1' WHEN horizon IN (2, 3) THEN 'G23' WHEN horizon BETWEEN 4 AND 7 THEN 'G47' END specialist, count(*)::BIGINT n FROM retained GROUP BY ALL")(
    lambda w: L.route(w.retained, GROUPS).groupBy("fold_id", "specialist").agg(F.count("*").alias("n"))
)
_RUNS = " UNION ALL ".join(f"SELECT '{n}' model_name, sqrt(avg(pow(e, 2))) rmse, sqrt(avg(pow(e, 2)) FILTER (fold_id = 'F01')) rmse_f01, sqrt(avg(pow(e, 2)) FILTER (fold_id = 'F02')) rmse_f02 FROM (SELECT fold_id, prediction - target e FROM s_{n})" for n in _PARTS)


def _runs(w: World) -> DataFrame:
    """Errors of several baselines from one pass over the candidates."""
    runs = F.array(*(F.struct(F.lit(n).alias("model_name"), F.coalesce(*T.CHAINS[n]).alias("prediction")) for n in _PARTS))
    rows = w.candidates().select("fold_id", "target", F.inline(runs))
    error = F.pow(F.col("prediction") - F.col("target"), 2)
    return M.run_ranking(rows.groupBy("model_name").agg(F.sqrt(F.avg(error)).alias("rmse"), *(F.sqrt(F.avg(F.when(F.col("fold_id") == f, error))).alias(f"rmse_{f.lower()}") for f in ("F01", "F02"))))


register(
    "run_comparison_rank",
    f"SELECT model_name, round(rmse, 4) rmse, round(rmse_f01, 4) rmse_f01, round(rmse_f02, 4) rmse_f02, round(abs(rmse_f01 - rmse_f02), 4) fold_gap, round((base - rmse) / base, 6) improvement, row_number() OVER (ORDER BY rmse, model_name)::INT \"position\" FROM runs CROSS JOIN (SELECT rmse base FROM runs WHERE model_name = 'persistence')",
    *(sql.scored(n, f"s_{n}") for n in _PARTS),
    f"runs AS ({_RUNS})",
)(lambda w: _runs(w).select("model_name", *(near(c, 4).alias(c) for c in ("rmse", "rmse_f01", "rmse_f02", "fold_gap")), near("improvement", 6).alias("improvement"), "position"))
register(
    "promotion_gates",
    "SELECT bool_and(a.rmse < b.rmse) FILTER (family = 'pooled') pooled_better, bool_and(a.rmse < b.rmse) FILTER (family = 'fold') folds_better, bool_and(a.rmse <= b.rmse * 1.02) FILTER (family = 'horizon') horizons_hold, bool_and(a.n = b.n) same_coverage FROM ra a FULL JOIN rb b USING (family, \"label\")",
    *_report_sql("location_mean", "ra", "sa"),
    *_report_sql("persistence", "rb", "sb"),
)(lambda w: M.promotion_gates(_report(w, "location_mean"), _report(w, "persistence")))


def _predictions(w: World, name: str = "persistence") -> DataFrame:
    return K.as_predictions(w.baseline(name), "run-baseline", "c" * 64, "d" * 64, "e" * 64)


_UNIFORM = ("run_id", "model_name", "configuration_id", "data_manifest_id", "validation_id")
_CONTRACT = (
    """SELECT (count(*) FILTER (NOT coalesce((input_month + INTERVAL 1 MONTH)::DATE = target_month, false)))::BIGINT bad_calendar, (count(*) FILTER (NOT coalesce(effective_horizon BETWEEN 1 AND 7, false)))::BIGINT bad_horizon,
  (count(*) FILTER (NOT coalesce(mask_state IN ('observed', 'masked/unavailable'), false)))::BIGINT bad_mask, (count(*) FILTER (NOT coalesce(isfinite(prediction), false)))::BIGINT bad_prediction,
  (count(*) FILTER (NOT coalesce(isfinite(validation_actual), false)))::BIGINT bad_actual, (count(*) FILTER (NOT coalesce(regexp_matches(location_id, '^lat2=-?[0-9]+;lon2=-?[0-9]+$'), false)))::BIGINT bad_location,
  (count(*) FILTER (NOT coalesce(length(fold_id) > 0, false)))::BIGINT bad_fold, (count(*) FILTER (NOT coalesce(length(model_name) > 0, false)))::BIGINT bad_model,
  (count(*) FILTER (NOT coalesce(regexp_matches(run_id, '^run-[a-z0-9][a-z0-9-]*$'), false)))::BIGINT bad_run_id, """
    + ", ".join(f"(count(*) FILTER (NOT coalesce(regexp_matches({c}, '^[0-9a-f]{{64}}$'), false)))::BIGINT bad_{c}" for c in _UNIFORM[2:])
    + ", (count(*) - count(DISTINCT (fold_id, location_id, input_month, target_month)))::BIGINT duplicate_keys, "
    + ", ".join(f"greatest(count(DISTINCT {c}) - 1, 0)::BIGINT mixed_{c}" for c in _UNIFORM)
    + " FROM "
)
_ROWS = "pred AS (SELECT 'run-baseline' run_id, fold_id, 'lat2=' || lat2 || ';lon2=' || lon2 location_id, input_month, target_month, horizon effective_horizon, provenance mask_state, prediction, target validation_actual, model_name, repeat('c', 64) configuration_id, repeat('d', 64) data_manifest_id, repeat('e', 64) validation_id, lat2 FROM scored)"
register("prediction_contract_violations", _CONTRACT + "pred", sql.scored("persistence"), _ROWS)(lambda w: K.prediction_violations(_predictions(w)))
#: A fault for each cell row: column, value in SQL, value in Spark.
_FAULTS = (
    ("location_id", "NULL", None), ("target_month", "NULL", None), ("target_month", "input_month", lambda: F.col("input_month")), ("effective_horizon", "9", 9), ("effective_horizon", "NULL", None), ("mask_state", "'hidden'", "hidden"),
    ("mask_state", "NULL", None), ("prediction", "'NaN'::DOUBLE", float("nan")), ("validation_actual", "NULL", None), ("run_id", "'not a run id'", "not a run id"), ("run_id", "NULL", None), ("configuration_id", "'c'", "c"),
    ("data_manifest_id", "repeat('D', 64)", "D" * 64), ("validation_id", "NULL", None), ("model_name", "''", ""), ("fold_id", "NULL", None), ("location_id", "'lat2=1;lon2=x'", "lat2=1;lon2=x"), ("prediction", "'Infinity'::DOUBLE", float("inf")),
)


def _faulty_predictions(w: World) -> DataFrame:
    rows = _predictions(w)
    cell = F.regexp_extract("location_id", "lat2=([0-9]+)", 1).cast("int")
    rows = rows.withColumn("cell", cell)
    for i, (column, _, value) in enumerate(_FAULTS):
        rows = rows.withColumn(column, F.when(F.col("cell") == i, value() if callable(value) else value).otherwise(F.col(column)).cast(rows.schema[column].dataType))
    return rows.unionByName(rows.where(F.col("cell") == 20)).drop("cell")


_BROKEN = "broken AS (SELECT * REPLACE (" + ", ".join(f"CASE {' '.join(f'WHEN lat2 = {i} THEN {v}' for i, (x, v, _) in enumerate(_FAULTS) if x == c)} ELSE {c} END AS {c}" for c in dict.fromkeys(f[0] for f in _FAULTS)) + ") FROM pred)"
register("prediction_contract_faults", _CONTRACT + "(SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE lat2 = 20)", sql.scored("persistence"), _ROWS, _BROKEN)(lambda w: K.prediction_violations(_faulty_predictions(w)))
register("prediction_rows", "SELECT fold_id, 'lat2=' || lat2 || ';lon2=' || lon2 location_id, input_month, target_month, horizon effective_horizon, provenance mask_state, round(prediction, 4) prediction, round(target, 4) validation_actual, model_name FROM scored", sql.scored("persistence"))(
    lambda w: rounded(_predictions(w).select("fold_id", "location_id", "input_month", "target_month", "effective_horizon", "mask_state", "prediction", "validation_actual", "model_name"))
)
register(
    "id_order_check",
    """WITH official AS (SELECT event_id::VARCHAR id, event_id o FROM events),
candidate AS (SELECT CASE WHEN event_id = 5 THEN 'x5' ELSE event_id::VARCHAR END id, CASE event_id WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE event_id END c FROM events WHERE event_id <> 6 UNION ALL SELECT '7', 100000000),
one AS (SELECT id, count(*) n, min(c) c FROM candidate GROUP BY id)
SELECT (count(*) FILTER (c IS NULL))::BIGINT missing, (count(*) FILTER (o IS NULL))::BIGINT extra, coalesce(sum(n - 1), 0)::BIGINT duplicates, (count(*) FILTER (o <> c))::BIGINT displaced FROM official FULL JOIN one USING (id)""",
    plain=True,
)(
    lambda spark, d: K.id_order_violations(
        (e := read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ordinal"))),
        e.where("ordinal <> 6")
        .select(F.when(F.col("ordinal") == 5, "x5").otherwise(F.col("id")).alias("id"), F.when(F.col("ordinal") == 3, 4).when(F.col("ordinal") == 4, 3).otherwise(F.col("ordinal")).alias("ordinal"))
        .unionByName(spark.range(1).select(F.lit("7").alias("id"), F.lit(100000000).cast("bigint").alias("ordinal"))),
    )
)
register("pivot_grid", "SELECT lat2, round(max(v) FILTER (lon2 = 0), 4) lon_0, round(max(v) FILTER (lon2 = 1), 4) lon_1 FROM panel WHERE m = DATE '1999-01-01' GROUP BY lat2")(lambda w: rounded(X.pivot_grid(w.panel.where("m = date '1999-01-01'"), "v", [0, 1])))
register("nearest_cell", "SELECT lat2 nearest FROM panel ORDER BY abs(lat2 - 11.4), lat2 LIMIT 1")(lambda w: X.nearest(w.panel, "lat2", 11.4))
register("chrono_split", "SELECT CASE WHEN m <= (SELECT max(m) FROM (SELECT DISTINCT m FROM panel ORDER BY m LIMIT (SELECT greatest(1, floor(count(DISTINCT m) * 0.8))::BIGINT FROM panel))) THEN 'train' ELSE 'test' END part, count(*)::BIGINT n, min(m) first_month, max(m) last_month FROM panel GROUP BY ALL")(
    lambda w: S.chronological_split(w.panel).groupBy("part").agg(F.count("*").alias("n"), F.min("m").alias("first_month"), F.max("m").alias("last_month"))
)
register("median_impute", "SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN \"value\" END, (SELECT quantile_disc(\"value\", 0.5) FROM events WHERE event_type <> 'error')) filled FROM events", plain=True)(
    lambda spark, d: L.impute_median(read(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("filled")), ["filled"])
)
# scoring rows, drift, orders and relations
register(
    "scoring_features",
    """SELECT t.lat2, t.lon2, t.masked, t.horizon, s.input_month, s.target_month, s.source_month, p.n, round(p.urgent, 4) urgent, round(p.acct, 4) acct, round(q.v, 4) last_observed
FROM template t CROSS JOIN LATERAL (SELECT (DATE '2000-01-01' + to_months(t.rel))::DATE input_month, (DATE '2000-01-01' + to_months(t.rel + 1))::DATE target_month, (DATE '2000-01-01' + to_months(t.rel + 1 - t.horizon))::DATE source_month) s
JOIN panel p ON p.lat2 = t.lat2 AND p.lon2 = t.lon2 AND p.m = s.input_month
JOIN template u ON u.lat2 = t.lat2 AND u.lon2 = t.lon2 AND NOT u.masked AND u.rel = t.rel + 1 - t.horizon
JOIN panel q ON q.lat2 = t.lat2 AND q.lon2 = t.lon2 AND q.m = s.source_month WHERE q.v IS NOT NULL""",
)(lambda w: rounded(X.scoring_features(w.template, w.panel, ORIGIN, COVARIATES)))
_POPULATIONS = {"train": "o_orderdate < TIMESTAMP '1999-01-01'", "recent": "o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'", "test": "o_orderdate >= TIMESTAMP '2000-01-01'"}
register(
    "drift_audit",
    "WITH x AS ("
    + " UNION ALL ".join(f"SELECT '{k}' population, 'o_totalprice' feature, o_totalprice x FROM orders WHERE {c} UNION ALL SELECT '{k}', 'o_custkey', o_custkey::DOUBLE FROM orders WHERE {c}" for k, c in _POPULATIONS.items())
    + """), e AS (SELECT feature, min(x) least, max(x) most FROM x WHERE population = 'train' GROUP BY feature)
SELECT population, feature, true available, round(least, 4) least, round(most, 4) most, count(*)::BIGINT n, (count(*) FILTER (x IS NULL))::BIGINT missing, round(min(x), 4) lo, round(max(x), 4) hi, round(avg(x), 3) mean, round(stddev_pop(x), 3) std, """ + _Q + """,
  (count(*) FILTER (x < least OR x > most))::BIGINT outside, round((count(*) FILTER (x < least OR x > most)) / count(x), 6) outside_share FROM x JOIN e USING (feature) GROUP BY ALL""",
    plain=True,
)(
    lambda spark, d: (lambda o: M.drift_audit({k: o.where(c.replace("TIMESTAMP", "timestamp_ntz")) for k, c in _POPULATIONS.items()}, ["o_totalprice", "o_custkey"]))(read(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_custkey")).select("population", "feature", "available", near("least").alias("least"), near("most").alias("most"), "n", "missing", near("lo").alias("lo"), near("hi").alias("hi"), near("mean", 3).alias("mean"), near("std", 3).alias("std"), *(near(f"q{int(q * 100):02d}").alias(f"q{int(q * 100):02d}") for q in M.QUANTILES), "outside", near("outside_share", 6).alias("outside_share"))
)
register("map_percentiles", "SELECT round(quantile_cont(prediction, 0.01), 4) prediction_p01, round(quantile_cont(prediction, 0.99), 4) prediction_p99, round(quantile_cont(abs(prediction - target), 0.01), 4) error_p01, round(quantile_cont(abs(prediction - target), 0.99), 4) error_p99 FROM scored", sql.scored("persistence"))(
    lambda w: rounded(M.finite_percentiles(w.baseline("persistence"), {"prediction": F.col("prediction"), "error": F.abs(F.col("prediction") - F.col("target"))}))
)
register("hash_subset", "SELECT event_id, sha256('42|' || event_id) selection_hash FROM events ORDER BY selection_hash, event_id LIMIT 100", plain=True)(lambda spark, d: S.hash_subset(read(spark, d, "events").select("event_id"), "event_id", 100))
register("ordered_numbers", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id)::BIGINT AS number FROM events", plain=True)(
    lambda spark, d: J.numbered(read(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day")), "day", ["ts", "event_id"]).select("event_id", "number")
)
register("merge_one_to_one", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT r_regionkey n_nationkey, r_name FROM region) USING (n_nationkey)", plain=True)(
    lambda spark, d: J.merge_one_to_one(read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), "r_name"), ["n_nationkey"])
)
register("semi_join_months", "SELECT lat2, lon2, m, round(v, 4) v FROM panel WHERE m IN (SELECT input_month FROM retained)")(lambda w: rounded(J.within(w.panel.select("lat2", "lon2", "m", "v"), w.retained.select(F.col("input_month").alias("m")), ["m"])))
_NUMBERS = "SELECT event_id::VARCHAR id, event_id ordinal FROM events"
register(
    "id_relationship",
    f"WITH a AS ({_NUMBERS}), b AS (SELECT id, ordinal FROM a WHERE id <> '7' UNION ALL SELECT '8', 7) SELECT (SELECT count(*) FROM a) = (SELECT count(*) FROM b) same_count, bool_and(x.o IS NOT DISTINCT FROM y.o) same_order, bool_and(x.n IS NOT DISTINCT FROM 1 AND y.n IS NOT DISTINCT FROM 1) each_once FROM (SELECT id, count(*) n, min(ordinal) o FROM a GROUP BY id) x FULL JOIN (SELECT id, count(*) n, min(ordinal) o FROM b GROUP BY id) y USING (id)",
    plain=True,
)(lambda spark, d: (lambda e: G.id_relationship(e, e.where("id <> '7'").unionByName(spark.range(1).select(F.lit("8").alias("id"), F.lit(7).cast("long").alias("ordinal")))))(read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ordinal"))))
_IDENTITY = ("fold_id", "location_id", "input_month", "target_month", "effective_horizon", "mask_state")
register(
    "identity_keys",
    f"SELECT count(*)::BIGINT n, sum(('0x' || substring(sha256(concat_ws(chr(31), {', '.join(f'{c}::VARCHAR' for c in _IDENTITY)})), 1, 15))::BIGINT)::VARCHAR \"identity\" FROM pred",
    sql.scored("persistence"),
    _ROWS,
)(lambda w: K.row_identity(_predictions(w), _IDENTITY))

# sources and sinks: each writes new files below the shared folder and reads them back
register("csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate::DATE o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'a \"b\", ' || o_orderpriority END note FROM orders", plain=True)(
    lambda spark, d: files.csv_round_trip(
        read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('a "b", '), "o_orderpriority")).alias("note")),
        files.scratch(spark, "orders-csv"),
    )
)


def _parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "orders-parts")
    files.write_parquet(read(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"], sort_by=["o_orderkey"])
    return files.read_parquet(spark, path, ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderstatus <> 'O' and o_orderkey > 100")


register("parquet_partitions", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey > 100", plain=True)(_parquet_parts)
_LOSSES = {"c_name": "int", "c_acctbal": "int", "c_mktsegment": "date", "c_nationkey": "double"}
register("cast_losses", "SELECT (count(*) FILTER (c_name IS NOT NULL AND TRY_CAST(c_name AS INT) IS NULL))::BIGINT c_name, 0::BIGINT + (count(*) FILTER (abs(c_acctbal) > 2147483647))::BIGINT c_acctbal, (count(*) FILTER (TRY_CAST(c_mktsegment AS DATE) IS NULL))::BIGINT c_mktsegment, (count(*) FILTER (TRY_CAST(c_nationkey AS DOUBLE) IS NULL))::BIGINT c_nationkey FROM customer", plain=True)(
    lambda spark, d: G.cast_losses(read(spark, d, "customer").withColumn("c_acctbal", F.floor("c_acctbal")), _LOSSES)
)


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission of all events, written, read as text and checked against a list that lacks one id and has another."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ID"), F.col("value").alias("Target"), F.col("event_id").alias("ordinal"))
    path = files.scratch(spark, "submission")
    files.write_lines(events, path, ["ID", "Target"], "ordinal")
    sent = files.read_ordered(spark, path, "ID string, Target string")
    official = events.select(F.when(F.col("ordinal") == 7, "x7").otherwise(F.col("ID")).alias("id"), "ordinal").where("ordinal <> 9")
    start = events.agg(F.min("ordinal").alias("start"))
    return files.submission_violations(official, sent.crossJoin(F.broadcast(start)).withColumn("ordinal", F.col("ordinal") + F.col("start")).drop("start"))


register("submission_check", "SELECT 1::BIGINT * (count(*) FILTER (event_id = 7)) missing, (count(*) FILTER (event_id IN (7, 9)))::BIGINT extra, (count(*) - count(DISTINCT event_id))::BIGINT duplicates, (count(*) FILTER (event_id NOT IN (7, 9) AND event_id <> rn))::BIGINT displaced, (count(*) FILTER (\"value\" IS NULL))::BIGINT bad_numbers FROM (SELECT event_id, \"value\", row_number() OVER (ORDER BY event_id) - 1 + min(event_id) OVER () rn FROM events)", plain=True)(_submission)


def _evidence(w: World) -> DataFrame:
    """Reports of two baselines against records of which one has another error and counts a row too many."""
    names = ("persistence", "location_mean")
    reports = None
    for n in names:
        part = _report(w, n).select(F.lit(n).alias("run_id"), "family", "label", "n", "rmse")
        reports = part if reports is None else reports.unionByName(part)
    facts = G.evidence_facts(reports)
    wrong = (F.col("run_id") == "persistence") & F.col("fact").isin("rmse", "fold rows")
    records = facts.where("fact <> 'band slices'").withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value")))
    return G.evidence_mismatches(records, reports)


_FACTS = " UNION ALL ".join(
    f"SELECT '{r}' run_id, CASE WHEN family = 'pooled' THEN 'rmse' ELSE family || ' slices' END fact, CASE WHEN family = 'pooled' THEN max(rmse) ELSE count(*)::DOUBLE END \"value\" FROM {v} GROUP BY family UNION ALL SELECT '{r}', CASE WHEN family = 'pooled' THEN 'rows' ELSE family || ' rows' END, sum(n)::DOUBLE FROM {v} GROUP BY family"
    for r, v in (("persistence", "ra"), ("location_mean", "rb"))
)
register(
    "evidence_mismatches",
    "SELECT run_id, fact, CASE WHEN fact <> 'band slices' THEN round(\"value\" + 1, 4) END recorded, round(\"value\", 4) reported FROM facts WHERE fact = 'band slices' OR (run_id = 'persistence' AND fact IN ('rmse', 'fold rows'))",
    *_report_sql("persistence", "ra", "sa"),
    *_report_sql("location_mean", "rb", "sb"),
    f"facts AS ({_FACTS})",
)(lambda w: rounded(_evidence(w)))
# rows only: hashes of doubles' bits and fitted trees have no twin in SQL
_FEATURES = ["horizon", *COVARIATES, "last_observed"]


def _train_and_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The panel, which both name again and again, is computed once, in the columns that they need."""
    w = World(spark, sf_dir, files.stored(panel(spark, sf_dir).drop(*INDEX, *ENCODING), "panel"))
    rows = X.validation_features(w.retained, w.panel, COVARIATES)
    return w.sample().select("fold_id", "lat2", "lon2", "target", "sample_weight", *_FEATURES), rows.select("fold_id", "lat2", "lon2", "input_month", "target", *_FEATURES)


#: The reference's settings, as far as MLlib has them (no limit of leaves).
_BOOSTING = {"weight": "sample_weight", "rounds": 200, "depth": 8, "stepSize": 0.05, "maxBins": 127, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9", "seed": 20260904}
register("identity_hash")(lambda w: K.row_identity(_predictions(w)))
register("gbdt_residual", plain=True)(lambda spark, sf_dir: (lambda t, r: L.fit_folds(t, r, _FEATURES, **_BOOSTING))(*_train_and_rows(spark, sf_dir)).select("fold_id", "lat2", "lon2", "input_month", "prediction"))
register("gbdt_specialists", plain=True)(lambda spark, sf_dir: (lambda t, r: L.fit_folds(t, r, _FEATURES, GROUPS, **_BOOSTING))(*_train_and_rows(spark, sf_dir)).select("fold_id", "lat2", "lon2", "input_month", "specialist", "prediction"))
register("ensemble_cross_fit")(lambda w: L.cross_fit_blend(L.route(_components(w), GROUPS), list(_PARTS), ("F01", "F02")).select("fold_id", "lat2", "lon2", "input_month", "specialist", "prediction"))

FLAGSHIP = "metrics_by_horizon"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)

