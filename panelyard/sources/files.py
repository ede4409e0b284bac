"""Readers, writers and file facts."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header: by schema, failing on rows that don't fit it, or inferred from all rows."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def read_text_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with all columns as text."""
    return read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet with projection and filter, which the scan takes over."""
    out = spark.read.parquet(path)
    out = out.where(where) if where else out
    return out.select(*columns) if columns else out


def read_header(path: str) -> list[str]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        return next(csv.reader(f), [])


def header_violations(path: str, expected: list[str]) -> dict[str, list[str]]:
    """Columns that are missing, unexpected or repeated, and whether the order differs."""
    found = read_header(path)
    return {"missing": [c for c in expected if c not in found], "unexpected": [c for c in found if c not in expected], "repeated": sorted({c for c in found if found.count(c) > 1}), "displaced": [] if [c for c in found if c in expected] == expected else found}


def unparsable_dates(df: DataFrame, column: str) -> int:
    """Texts that are no date; nulls don't count."""
    return df.agg(F.count_if(F.col(column).isNotNull() & F.try_to_date(column).isNull())).first()[0]


def sample_profile(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Null counts of a bounded head."""
    head = df.limit(min(rows, 10_000))
    return head.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns))


def file_facts(path: str) -> dict:
    """SHA-256, bytes and line feeds of a file, read in blocks."""
    digest, lines, size = hashlib.sha256(), 0, 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
            lines += block.count(b"\n")
            size += len(block)
    return {"name": Path(path).name, "sha256": digest.hexdigest(), "bytes": size, "line_feeds": lines}


def with_ordinal(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    """Lines of an ordered list of ids (header first) with their place in the file, from 1 on.

    Lines are read in splits and numbered split by split, in the file's order; a file's size has no limit.
    """
    lines = spark.read.text(path).where("value <> ''").select(F.rtrim("value").alias(column), F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("at"), "_metadata.file_block_start")
    counts = lines.groupBy("file_block_start", "split").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file_block_start", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file_block_start", "split", "least", before.alias("before"))  # a row for each split
    out = lines.join(F.broadcast(starts), ["file_block_start", "split"]).withColumn("ordinal", (F.col("before") + F.col("at") - F.col("least")).cast("bigint"))
    return out.where("ordinal > 0").select("ordinal", column)


def strict_yaml(text: str):
    """YAML in which a repeated key is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        seen = set()
        for key, _ in node.value:
            name = loader.construct_object(key, deep=deep)
            if name in seen:
                raise ValueError(f"repeated key: {name}")
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep=deep)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Compressed Parquet, in ranges and order of ``sort_by``; an existing path is an error."""
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share (a temporary one in local mode)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = f"file://{tempfile.mkdtemp(prefix='panelyard-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, written below the shared folder and read from there: lineage and plan end."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as CSV with a header, in parts, and read back by its schema; quotes and nulls survive."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("escape", '"').schema(df.schema).csv(path)


def write_lines(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """CSV parts whose names sort as ``order`` does: ranges of it, each sorted; doubles with all their digits."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of such parts with their place in the whole, from 0 on, as ``ordinal``."""
    rows = spark.read.option("header", True).schema(schema).csv(path).select("*", "_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    parts = rows.groupBy("file_path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file_path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("file_path", before.alias("before"))  # a row for each file
    place = F.row_number().over(W.partitionBy("file_path").orderBy("at")) - 1
    out = rows.join(F.broadcast(starts), "file_path").withColumn("ordinal", (F.col("before") + place).cast("bigint"))
    return out.drop("file_path", "at", "before")


def write_json(value, path: str) -> None:
    """Sorted, compact JSON, replaced as a whole."""
    _replace(path, json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n")


def write_submission(df: DataFrame, path: str, identifier: str = "ID", value: str = "Target", order: str = "ordinal") -> int:
    """Two-column CSV in order, numbers with 17 digits, a new file only; rows pass the driver one partition at a time."""
    if os.path.exists(path):
        raise FileExistsError(path)
    n = 0
    with open(f"{path}.part", "w", encoding="utf-8", newline="\n") as f:
        f.write(f"{identifier},{value}\n")
        for row in df.select(identifier, value, order).orderBy(order).toLocalIterator():
            f.write(f"{row[identifier]},{format(row[value], '.17g')}\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.rename(f"{path}.part", path)
    return n


def submission_violations(official: DataFrame, submission: DataFrame) -> DataFrame:
    """Checks a submission read as text against the official ids (both with ordinals)."""
    from ..functions.calendar import finite
    from ..operators.contracts import id_order_violations

    bad = submission.agg(F.count_if(~finite(F.col("Target").try_cast("double"))).alias("bad_numbers"))
    return id_order_violations(official, submission.withColumnRenamed("ID", "id")).crossJoin(F.broadcast(bad))


def _replace(path: str, text: str) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


#: Fields of an experiment record.
REGISTRY_KEY = "run_id"


def append_record(record: dict[str, str], path: str, fields: list[str], json_fields: list[str]) -> None:
    """Add a record to a CSV registry: known fields only, JSON where it must be, ids once."""
    if set(record) != set(fields):
        raise ValueError(f"fields differ: {sorted(set(record) ^ set(fields))}")
    for name in json_fields:
        json.loads(record[name])
    rows = []
    if os.path.exists(path):
        with open(path, encoding="utf-8", newline="") as f:
            rows = list(csv.DictReader(f))
    if any(r[REGISTRY_KEY] == record[REGISTRY_KEY] for r in rows):
        raise ValueError(f"run is there already: {record[REGISTRY_KEY]}")
    lines = [",".join(fields)]
    for r in [*rows, record]:
        lines.append(",".join('"' + r[f].replace('"', '""') + '"' for f in fields))
    _replace(path, "\n".join(lines) + "\n")


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A small table as Markdown, numbers with six digits."""
    show = lambda v: format(v, ".6f") if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body])
