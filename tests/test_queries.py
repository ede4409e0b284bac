"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from panelyard.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["fold_audit", "fold_retained", "baseline_location_trend_seasonal", "metrics_report", "stratified_sample", "asof_backward_strict", "history_features", "soil_anomaly", "seasonal_anchor", "numeric_summary_quantiles", "promotion_gates", "chrono_split", "nearest_cell", "scoring_features", "drift_audit", "map_percentiles", "hash_subset", "ordered_numbers", "merge_one_to_one", "semi_join_months", "id_relationship", "median_impute"])
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, str(DATA))
    theirs = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    columns = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in theirs.fetchall()), key=repr)
    assert a == b


def test_flagship(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0
