"""Helpers shared by the text-pipeline operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts, as Java, RE2 and Python all read it.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; Python workers started from here on find this package too."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([x for x in (root, known) if x])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary
    folder, as its executors share the machine; a cluster gets an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and context.getCheckpointDir() is None and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or f"file://{tempfile.mkdtemp(prefix='panelyard-')}")
    return configured or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A folder name below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of files that nothing needs any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Give back the disk of what is cut: files of the checkpoints ``done``, and shuffles that nothing refers to.

    No plan that is still to run may read ``done``. Spark drops the files of a shuffle once the driver
    has collected its plan, so a collection is asked for.
    """
    for df in done:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(spark, file.get())
    spark._jvm.System.gc()


#: Words of ids that are sent to all executors, some 40 bytes each; more are joined by a shuffle.
SENT_WORDS = 1 << 20


def id_words(ids: DataFrame, name: str) -> DataFrame:
    """The ids of a column as bits: a row for each 64 neighbours of which one or more is there. Null is none."""
    words = ids.where(F.col(name).isNotNull()).select(F.shiftright(name, 6).alias("word"), F.col(name).bitwiseAND(63).cast("int").alias("bit"))
    return cut(words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))


def among(rows: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """Rows whose id is in ``words`` (of ``id_words``), where they are read; they are shuffled only where the words are too many to send."""
    word, bits = f"{name}_word", f"{name}_bits"
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    sent = F.broadcast(words) if words.count() <= SENT_WORDS else words
    met = rows.join(sent, F.shiftright(name, 6) == F.col(word))
    return met.where(F.expr(f"bit_get(`{bits}`, cast(`{name}` & 63 as int)) = 1")).select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass over one column."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hash of pairs, by multiply-xorshift steps (order matters)."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    if array.buffers()[2] is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_slices(batch, size: int = 4 << 20):
    """Parts of an Arrow batch with about ``size`` bytes of text each; a row is never divided."""
    _, offsets = string_bytes(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next stage needs it elsewhere."""
    from .suffix_dedup import _POWERS

    _POWERS.clear()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)
