"""Queries that SQL can state, against DuckDB on the smallest tables."""

import random
from pathlib import Path

import duckdb
import pytest

from panelyard.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(tuple(r[c] for c in columns) for r in ours.collect()) == sorted(theirs.fetchall())


def compare(con, spark, name, folder):
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    ours = sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(folder)).collect())
    assert ours == sorted(theirs.fetchall())
    return ours


def test_rules_that_decide(spark, tmp_path):
    """Tables on which certified rules reject and mined rules block, against SQL."""
    rng = random.Random(2)
    good = [(i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(30)), "en") for i in range(2500)]
    bad = [(5000 + i, " ".join(f"w{rng.randrange(10**6)}###$" for _ in range(30)), "en") for i in range(60)]
    few = [(6000 + i, f"kurz ### {i} " * 6, "de") for i in range(30)]
    docs = good + bad + few + [(9000, None, None), (9001, bad[0][1], "en"), (9002, "", "en")]
    spark.createDataFrame([(*d, "s", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d in good), 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # the labels' good ids run up to 2500: spam among 5000 to 5059
    pages = [(i, f"http://h{i}.net/a/{i}?page=2") for i in range(300)] + [(5000 + i, f"http://www.spam{i % 2}.net/win/{i}.html#x") for i in range(60)] + [(7000, "http://www.spam1.net/win/7"), (7001, None), (7002, "x"), (7003, "http://spam1.net/lose/")]
    spark.createDataFrame([(*p, "") for p in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    kept = {r[0]: r[-1] for r in compare(con, spark, "op3_quality_rules", tmp_path)}
    assert all(kept[d[0]] for d in good) and not any(kept[d[0]] for d in bad) and sum(kept.values()) < len(good) + 30
    verdict = {r[0]: r[-1] for r in compare(con, spark, "op9_url_rules", tmp_path)}
    assert {i for i, v in verdict.items() if v == "block"} >= {*range(5000, 5060), 7000} and verdict[7001] == verdict[5] == "allow"
