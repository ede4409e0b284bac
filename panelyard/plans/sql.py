"""DuckDB SQL of the registered queries, on a common set of views."""

from __future__ import annotations

_QUOTAS = "(1,200),(2,150),(3,100),(4,80),(5,60),(6,40),(7,20)"
_INDEX = ", ".join(f"(5 * sum(us) OVER w{k} - sum(n) OVER w{k})::DOUBLE / (2 * sqrt((sum(n) OVER w{k})::DOUBLE)) spei_{k:02d}" for k in (1, 3, 6, 12))
_PAST = ", ".join(f"w{k} AS (PARTITION BY lat2, lon2 ORDER BY m ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (1, 3, 6, 12))
WITH = f"""
WITH base AS (
  SELECT c_nationkey::BIGINT lat2, floor((c_custkey - 1) / 500)::BIGINT lon2, date_trunc('month', o_orderdate)::DATE m, o_totalprice,
         (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE u, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey),
p0 AS (SELECT lat2, lon2, m, avg(o_totalprice) v, count(*)::BIGINT n, avg(u) urgent, avg(c_acctbal) acct, sum(u) us FROM base GROUP BY lat2, lon2, m),
p1 AS (SELECT lat2, lon2, m, v, n, urgent, acct, {_INDEX},
  sin(month(m) * 2 * pi() / 12) month_sin, cos(month(m) * 2 * pi() / 12) month_cos FROM p0 WINDOW {_PAST}),
panel AS (SELECT a.*, b.v target FROM p1 a LEFT JOIN p0 b ON a.lat2 = b.lat2 AND a.lon2 = b.lon2 AND b.m = (a.m + INTERVAL 1 MONTH)::DATE),
folds(fold_id, origin) AS (VALUES ('F01', DATE '1997-01-01'), ('F02', DATE '1998-06-01')),
win AS (SELECT lat2, lon2, m, date_diff('month', DATE '2000-01-01', m)::INT rel FROM panel WHERE m >= DATE '2000-01-01' AND m < DATE '2000-08-01'),
win2 AS (SELECT *, row_number() OVER (PARTITION BY lat2, lon2 ORDER BY m) > 1 AND (lat2*7 + lon2*3 + rel) % 3 <> 0 masked FROM win),
win3 AS (SELECT *, max(CASE WHEN NOT masked THEN m END) OVER (PARTITION BY lat2, lon2 ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) lo FROM win2),
template AS (SELECT lat2, lon2, rel, masked, date_diff('month', DATE '2000-01-01', lo)::INT last_rel, (date_diff('month', lo, m) + 1)::INT horizon FROM win3),
mapped AS (
  SELECT f.fold_id, f.origin, t.*, (f.origin + to_months(t.rel))::DATE input_month, (f.origin + to_months(t.rel + 1))::DATE target_month, p.m IS NOT NULL matched, p.v "value", p.target
  FROM template t CROSS JOIN folds f LEFT JOIN panel p ON p.lat2 = t.lat2 AND p.lon2 = t.lon2 AND p.m = (f.origin + to_months(t.rel))::DATE),
path AS (SELECT fold_id, lat2, lon2, count(*)::BIGINT n_rows, (count(*) FILTER (matched))::BIGINT n_matched, count(target)::BIGINT n_targets FROM mapped GROUP BY ALL),
hist AS (SELECT fold_id, lat2, lon2, count(*)::BIGINT n_history, date_diff('month', min(m), max(m))::INT history_months FROM panel JOIN folds ON m < origin WHERE v IS NOT NULL GROUP BY ALL),
cohorts AS (
  SELECT p.*, coalesce(n_history, 0)::BIGINT n_history, coalesce(history_months, 0)::INT history_months, n_matched = n_rows path_complete, n_targets = n_rows target_complete,
         coalesce(n_history, 0) >= 12 AND coalesce(history_months, 0) >= 12 history_ok,
         n_matched = n_rows AND n_targets = n_rows AND coalesce(n_history, 0) >= 12 AND coalesce(history_months, 0) >= 12 retained
  FROM path p LEFT JOIN hist h USING (fold_id, lat2, lon2)),
keep AS (SELECT fold_id, lat2, lon2 FROM cohorts WHERE retained),
sources AS (
  SELECT fold_id, lat2, lon2, m source_month, v source_value FROM panel JOIN folds ON m < origin JOIN keep USING (fold_id, lat2, lon2) WHERE v IS NOT NULL
  UNION ALL SELECT fold_id, lat2, lon2, input_month, "value" FROM mapped JOIN keep USING (fold_id, lat2, lon2) WHERE matched AND NOT masked AND "value" IS NOT NULL),
retained AS (
  SELECT r.fold_id, r.origin, r.lat2, r.lon2, rel, masked, horizon expected_horizon, input_month, target_month, target, CASE WHEN NOT masked THEN "value" END available,
         CASE WHEN masked THEN 'masked/unavailable' ELSE 'observed' END provenance, s.source_month last_observed_month, s.source_value last_observed,
         date_diff('month', s.source_month, target_month)::INT horizon
  FROM (SELECT mapped.* FROM mapped JOIN keep USING (fold_id, lat2, lon2)) r
  ASOF LEFT JOIN sources s ON r.fold_id = s.fold_id AND r.lat2 = s.lat2 AND r.lon2 = s.lon2 AND r.input_month >= s.source_month),
fit AS (SELECT panel.*, fold_id, origin, month(m + INTERVAL 1 MONTH)::INT cal, (date_diff('month', DATE '1970-01-01', m) + 1)::INT t FROM panel JOIN folds ON (m + INTERVAL 1 MONTH)::DATE <= origin WHERE target IS NOT NULL),
st_all AS (SELECT fold_id, avg(target) global_mean FROM fit GROUP BY ALL),
st_cell AS (SELECT fold_id, lat2, lon2, avg(target) location_mean FROM fit GROUP BY ALL),
st_cal AS (SELECT fold_id, lat2, lon2, cal, avg(target) climatology FROM fit GROUP BY ALL),
st_trend AS (SELECT fold_id, lat2, lon2, regr_slope(target, t) slope, regr_intercept(target, t) intercept FROM fit GROUP BY ALL HAVING count(DISTINCT t) > 1),
st_rest AS (SELECT fold_id, lat2, lon2, cal, avg(target - intercept - slope * t) seasonal_rest FROM fit JOIN st_trend USING (fold_id, lat2, lon2) GROUP BY ALL),
cand AS (
  SELECT r.*, month(r.target_month)::INT cal, global_mean, location_mean, climatology location_calendar_month_climatology, p.v persistence, y.v seasonal_naive,
         intercept + slope * date_diff('month', DATE '1970-01-01', r.target_month) + seasonal_rest location_trend_seasonal
  FROM retained r LEFT JOIN st_all USING (fold_id) LEFT JOIN st_cell USING (fold_id, lat2, lon2)
  LEFT JOIN st_cal ON st_cal.fold_id = r.fold_id AND st_cal.lat2 = r.lat2 AND st_cal.lon2 = r.lon2 AND st_cal.cal = month(r.target_month)
  LEFT JOIN st_trend ON st_trend.fold_id = r.fold_id AND st_trend.lat2 = r.lat2 AND st_trend.lon2 = r.lon2
  LEFT JOIN st_rest ON st_rest.fold_id = r.fold_id AND st_rest.lat2 = r.lat2 AND st_rest.lon2 = r.lon2 AND st_rest.cal = month(r.target_month)
  LEFT JOIN panel p ON p.lat2 = r.lat2 AND p.lon2 = r.lon2 AND p.m = r.last_observed_month
  LEFT JOIN panel y ON y.lat2 = r.lat2 AND y.lon2 = r.lon2 AND y.m = (r.target_month - INTERVAL 12 MONTH)::DATE),
examples AS (
  SELECT p.lat2, p.lon2, p.m, p.target, p.n, p.urgent, p.acct, f.fold_id, f.origin, h.horizon::INT horizon, s.m source_month, s.v last_observed, (p.m + INTERVAL 1 MONTH)::DATE target_month,
         sha256('20260904|' || f.fold_id || '|' || ((p.m + INTERVAL 1 MONTH)::DATE)::VARCHAR || '|' || p.lat2 || '|' || p.lon2 || '|' || h.horizon) selection_hash,
         'lat2=' || p.lat2 || ';lon2=' || p.lon2 location_id
  FROM panel p JOIN folds f ON (p.m + INTERVAL 1 MONTH)::DATE <= f.origin CROSS JOIN range(1, 8) h(horizon)
  JOIN panel s ON s.lat2 = p.lat2 AND s.lon2 = p.lon2 AND s.m = (p.m - to_months(h.horizon::INT - 1))::DATE
  WHERE p.target IS NOT NULL AND s.v IS NOT NULL),
quotas(horizon, quota) AS (VALUES {_QUOTAS}),
ranked AS (SELECT e.*, row_number() OVER (PARTITION BY fold_id, horizon ORDER BY selection_hash, target_month, location_id) rk, count(*) OVER (PARTITION BY fold_id, horizon) population FROM examples e),
sample AS (SELECT ranked.*, least(population, quota)::BIGINT kept, population::DOUBLE / least(population, quota) sample_weight FROM ranked JOIN quotas USING (horizon) WHERE rk <= quota),
feat AS (
  SELECT r.*, p.n, p.urgent, p.acct, p.spei_01, p.spei_03, p.spei_06, p.spei_12, p.month_sin, p.month_cos, q.v last_value FROM retained r JOIN panel p ON p.lat2 = r.lat2 AND p.lon2 = r.lon2 AND p.m = r.input_month
  JOIN panel q ON q.lat2 = r.lat2 AND q.lon2 = r.lon2 AND q.m = r.last_observed_month
  WHERE r.last_observed_month <= r.input_month AND date_diff('month', r.last_observed_month, r.target_month) = r.horizon),
known AS (SELECT lat2, lon2, m, v FROM panel WHERE v IS NOT NULL),
hist1 AS (SELECT f.*, s.m second_month, s.v second_value FROM feat f ASOF LEFT JOIN known s ON f.lat2 = s.lat2 AND f.lon2 = s.lon2 AND f.last_observed_month > s.m),
kcal AS (SELECT *, month(m) cal FROM known),
tcal AS (SELECT *, month(target_month) cal FROM hist1),
hist2 AS (SELECT t.*, s.m season_month, s.v season_value FROM tcal t ASOF LEFT JOIN kcal s ON t.lat2 = s.lat2 AND t.lon2 = s.lon2 AND t.cal = s.cal AND t.input_month >= s.m),
history AS (
  SELECT *, date_diff('month', second_month, last_observed_month)::INT gap_months, (last_value - second_value) / NULLIF(date_diff('month', second_month, last_observed_month), 0) slope,
         date_diff('month', season_month, target_month)::INT season_age_months, last_value - season_value season_difference,
         (second_month IS NOT NULL)::INT second_available, coalesce(date_diff('month', second_month, last_observed_month) > 0, false)::INT slope_available, (season_month IS NOT NULL)::INT season_available
  FROM hist2)
"""
CHAINS = {
    "global_mean": ("global_mean",),
    "location_mean": ("location_mean", "global_mean"),
    "location_calendar_month_climatology": ("location_calendar_month_climatology", "location_mean", "global_mean"),
    "persistence": ("persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
    "seasonal_naive": ("seasonal_naive", "persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
    "location_trend_seasonal": ("location_trend_seasonal", "seasonal_naive", "persistence", "location_calendar_month_climatology", "location_mean", "global_mean"),
}


#: What is added before rounding, here and in Spark, so that no value lies on a half.
NUDGE = 3e-7


def nudged(text: str) -> str:
    """``round(x, n)`` everywhere as ``round((x) + NUDGE, n)``."""
    out, at = "", 0
    while (found := text.find("round(", at)) >= 0:
        depth, comma, i = 0, -1, found + 6
        while depth or text[i] != ")":
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            comma = i if text[i] == "," and not depth else comma
            i += 1
        out += f"{text[at:found]}round(({nudged(text[found + 6 : comma])}) + {NUDGE:.7f}{text[comma:i]})"
        at = i + 1
    return out + text[at:]


def of(body: str, *more: str) -> str:
    """A query on the views, and on more of its own."""
    return WITH + "".join(f",\n{m}" for m in more) + "\n" + body


def scored(name: str, view: str = "scored") -> str:
    chain = CHAINS[name]
    level = " ".join(f"WHEN {c} IS NOT NULL THEN {i}" for i, c in enumerate(chain))
    reason = " ".join(f"WHEN {c} IS NOT NULL THEN '{'missing:' + ','.join(chain[:i]) if i else 'primary'}'" for i, c in enumerate(chain))
    stage = " ".join(f"WHEN {c} IS NOT NULL THEN '{c}'" for c in chain)
    return f"{view} AS (SELECT *, coalesce({', '.join(chain)}) prediction, (CASE {level} END)::INT fallback_level, CASE {stage} ELSE 'exhausted' END fallback_stage, CASE {reason} ELSE 'exhausted' END fallback_reason, '{name}' model_name FROM cand)"


ERRORS = "count(*)::BIGINT n, round(sum(pow(prediction - target, 2)), -2) sse, round(sqrt(avg(pow(prediction - target, 2))), 4) rmse"
BAND = "CASE WHEN lat2*5-60 < -60 THEN '[-90,-60)' WHEN lat2*5-60 < -30 THEN '[-60,-30)' WHEN lat2*5-60 < 0 THEN '[-30,0)' WHEN lat2*5-60 < 30 THEN '[0,30)' WHEN lat2*5-60 < 60 THEN '[30,60)' ELSE '[60,90]' END"
INDEX_LABELS = "['(-inf,-2)', '[-2,-1.5)', '[-1.5,-1)', '[-1,1)', '[1,1.5)', '[1.5,2)', '[2,inf)']"


def index_bin(c: str) -> str:
    return f"CASE WHEN {c} < -2 THEN '(-inf,-2)' WHEN {c} < -1.5 THEN '[-2,-1.5)' WHEN {c} < -1 THEN '[-1.5,-1)' WHEN {c} < 1 THEN '[-1,1)' WHEN {c} < 1.5 THEN '[1,1.5)' WHEN {c} < 2 THEN '[1.5,2)' ELSE '[2,inf)' END"
