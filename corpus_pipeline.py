"""Training-data pipeline over ``documents``: filters, then packed sequences.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept, written as Parquet and
read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm._common import among, delete, fresh_path, id_words, release, table
from panelyard.llm.decontaminate import keep_clean as without_leaks
from panelyard.llm.minhash import near_duplicates
from panelyard.llm.packing import pack_documents
from panelyard.llm.secret_scan import redact_documents
from panelyard.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels of documents at hand.

    Each row is judged by its own text; null and empty texts are scored as empty ones. Rows that share
    an id, or have none, are judged one by one.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a number for each row of files: its file's place among all files, and its place in the file.

    The list of files is sent to all executors; the driver holds that list anyway, to plan the scan.
    """
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    places = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{name}_file long, {name}_path string")
    placed = docs.withColumns({f"{name}_at": F.col("_metadata.file_path"), f"{name}_row": F.col("_metadata.row_index")})
    numbered = placed.join(F.broadcast(places), F.col(f"{name}_at") == F.col(f"{name}_path"))
    return numbered.select(*docs.columns, (F.shiftleft(f"{name}_file", 40) + F.col(f"{name}_row")).alias(name))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id.

    Rows count one by one, by their places in the files they are read from (others are written to
    the shared folder first). Of rows that share the smallest doc_id the first one stays; a row with
    a null doc_id stays if its group has no other id. Rows without words all stay.
    """
    names = docs.columns
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        path = fresh_path(spark, "rows")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    key = "row_key"
    while any(x.lower().startswith(key) for x in names):
        key = f"_{key}"
    docs = with_row_key(docs, key)
    classes = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    ids = docs.select(key, F.col("doc_id").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", key))
    kept = classes.join(ids, key).groupBy("component_id").agg(least.alias("least")).select(f"least.{key}")
    # as bits, so that texts stay where they are read unless the list is too long to send to all
    words = id_words(kept, key)
    release(spark)
    return among(docs, key, words).select(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; each is judged by itself, whatever its id."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every row stays, whatever its id, and null texts stay null."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place; a null text has the end id alone."""
    # the executors' workers have run all stages before this one: it stays small beside them
    return pack_documents(docs, cache=150_000, slice_bytes=1 << 20, forget=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Not to be had in SQL: a classifier, similarity classes, alignments and packing. Tests hold the run
#: against a version on plain Python lists.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage left is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
