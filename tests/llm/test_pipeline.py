"""The pipeline's stages, one after another and against plain lists."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from panelyard.llm import secret_scan  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    insult = "you are a stupid idiot and a worthless moron "
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea in the old tower by the sea today"
    rng = random.Random(8)
    clean = [(i, f"document number {i} tells " + " ".join(f"w{rng.randrange(9973)}" for _ in range(60))) for i in range(200)]
    toxic = [(1000 + i, clean[i][1] + " " + insult * 2) for i in range(100)]
    other = [(2000, clean[0][1]), (2001, clean[1][1] + " extra"), (2002, clean[5][1][:100] + " " + item + " zzz"), (2003, "login: password=abcdef123456 " + clean[7][1][::-1]), (2004, None), (2005, "")]
    docs = clean + toxic + other
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, seen = {}, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        gone[name] = set(seen) - set(rows)
        if name == "secrets":
            assert {i: r.text for i, r in rows.items()} == {i: secret_scan.redact(t) for i, t in seen.items()}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows.values())
        seen = {i: r.text for i, r in rows.items()}
        docs = spark.createDataFrame(list(rows.values()), after.schema)
    assert gone["toxicity"] == set(range(1000, 1100))
    assert gone["near_dedup"] == {2000, 2001}
    assert gone["decontamination"] == {2002}
    assert not gone["secrets"] and "password=" not in seen[2003]


@pytest.mark.parametrize("files", [False, True])
def test_near_dedup_of_null_and_repeated_ids(spark, tmp_path, files):
    text = ["".join(f"{a}{i} " for i in range(60)) for a in "abcde"]
    rows = [(None, text[0]), (None, text[0] + "x"), (None, text[1]), (7, text[1]), (8, text[2]), (8, text[2]), (9, text[3]), (9, text[4]), (None, None), (10, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if files:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    after = pipeline.near_dedup(spark, docs, "")
    assert after.columns == docs.columns
    got = [(r.doc_id, r.text) for r in after.collect()]
    assert sum(t in (text[0], text[0] + "x") for _, t in got) == 1
    assert sorted((i, t) for i, t in got if i is not None) == sorted([(7, text[1]), (8, text[2]), (9, text[3]), (9, text[4]), (10, ""), (10, "")])
    assert (None, None) in got and len(got) == 8


def test_run(spark, folder):
    out = pipeline.run(spark, folder).toPandas()
    assert set(out.doc_id) == {*range(200), 2003, 2004, 2005}
    for _, b in out.sort_values("offset").groupby("sequence_id"):
        assert b.length.sum() <= 2048 and b.offset.tolist() == [0, *b.length.cumsum().tolist()[:-1]]


def test_empty(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_are_not_shuffled_for_what_stays(spark, folder):
    """However long the list of kept rows: it goes to the texts as bits."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = pipeline.near_dedup(spark, docs, folder)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        ids = {r.doc_id for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == {r.doc_id for r in pipeline.near_dedup(spark, docs, folder).collect()} and len(ids) < docs.count()
