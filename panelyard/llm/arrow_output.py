"""Token ids as Arrow files of fixed-size-list batches, and the way back."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_slices, fresh_path, shuffle_partitions
from .encoding import DEFAULT_VOCABULARY, encoder, vocabulary_path, with_end

SHARDS = "shard int, path string, documents long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str):
    """File system and path for a URI or a plain path; whatever pyarrow has a file system for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """One shard: ``<name>.arrow`` with rows of ``width`` ids and a mask, ``<name>.docs.arrow`` as index.

    Both are Arrow IPC files: equal-length rows lie back to back in each batch, so row ``i`` of a
    memory-mapped file is a slice without a copy. Ids take 16 bits if the vocabulary fits, else 32.
    The mask, a bit each, is true for ids and false for the padding of the last row. A shard is written under a name of the attempt and renamed at its end, so a
    repeated or lost task leaves either a whole shard or none.
    """

    def __init__(self, folder: str, name: str, width: int, rows: int, attempt: str, kind: str = "uint32"):
        import pyarrow as pa

        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.width, self.rows = f"{root}/{name}", width, rows
        self.names = [f"{root}/_{name}-{attempt}{x}" for x in (".arrow", ".docs.arrow")]
        self.kind = np.dtype(kind)
        self.sequences = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), width)), ("mask", pa.list_(pa.bool_(), width))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(n) for n in self.names]
        self.out, self.docs = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.sequences, self.index), strict=True))
        self.held, self.count, self.tokens, self.documents = [], 0, 0, 0

    def add(self, doc_ids, ids: np.ndarray, offsets: np.ndarray) -> None:
        import pyarrow as pa

        self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(offsets[:-1] + self.tokens), pa.array(np.diff(offsets))], schema=self.index))
        self.held.append(ids)
        self.count += len(ids)
        self.tokens += len(ids)
        self.documents += len(offsets) - 1
        if self.count >= self.width * self.rows:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.width * self.width
            self._write(flat[:whole], whole)
            self.held, self.count = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, valid: int) -> None:
        import pyarrow as pa

        step = self.width * self.rows
        for a in range(0, len(flat), step):
            ids = flat[a : a + step]
            mask = np.arange(a, a + len(ids)) < valid
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids.astype(self.kind), mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.sequences))

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        self._write(np.concatenate([flat, np.zeros(-len(flat) % self.width, np.uint32)]), len(flat))
        for x in (self.out, self.docs, *self.sinks):
            x.close()
        for name, end in zip(self.names, (".arrow", ".docs.arrow"), strict=True):
            self.fs.move(name, self.final + end)


def write_token_files(docs: DataFrame, folder: str | None = None, width: int = 2048, batch_rows: int = 256, shards: int | None = None, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; return the manifest, a row for each shard.

    Documents are dealt into ranges of doc_id, so shard after shard holds ascending ids. Each text
    is encoded whole and ``end_id`` follows it. Null texts are empty (the end id alone); a
    null doc_id sorts first; rows that share a doc_id lie side by side in one shard, in any order.
    An empty table writes no shards. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)

    def write(batches):
        import pyarrow as pa

        task = TaskContext.get()
        writer, shard = None, task.partitionId()
        for batch in batches:
            for part in byte_slices(batch):
                if writer is None:
                    writer = ShardWriter(folder, f"shard-{shard:06d}", width, batch_rows, str(task.taskAttemptId()), "uint16" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "uint32")
                writer.add(part.column("doc_id").to_pylist(), *with_end(*encoder(path).encode(part.column("text")), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/shard-{shard:06d}", "documents": writer.documents, "tokens": writer.tokens}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(shards or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    found = sorted(dealt.mapInArrow(write, SHARDS).collect())  # a row for each file
    starts = np.concatenate([[0], np.cumsum([r.tokens for r in found], dtype=np.int64)])
    return spark.createDataFrame([(*r, int(s)) for r, s in zip(found, starts[:-1], strict=True)], SHARDS + ", start long")


def read_shard(path: str):
    """Documents of a shard as (doc_ids, starts in it, ids by slices without copies)."""
    import pyarrow as pa

    fs, name = _open(path)
    local = fs.type_name == "local"
    source = pa.memory_map(name + ".arrow") if local else fs.open_input_file(name + ".arrow")
    reader = pa.ipc.open_file(source)
    index = pa.ipc.open_file(fs.open_input_file(name + ".docs.arrow")).read_all()
    return reader, index


def document_checks(batches):
    """mapInArrow function: manifest rows to one row for each document, from the files."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            reader, index = read_shard(row["path"])
            starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
            crcs, at, k, crc = np.zeros(len(starts), np.int64), 0, 0, 0
            for b in range(reader.num_record_batches):
                part = reader.get_batch(b)
                mask = part.column("mask").flatten()
                ids = part.column("ids").flatten().to_numpy()[: mask.true_count].astype("<u4")  # padding comes last
                while k < len(starts) and starts[k] < at + len(ids):
                    a, z = max(int(starts[k]), at), min(int(starts[k] + sizes[k]), at + len(ids))
                    crc = zlib.crc32(memoryview(ids[a - at : z - at]).cast("B"), crc)
                    if z < starts[k] + sizes[k]:
                        break
                    crcs[k], crc = crc, 0
                    k += 1
                at += len(ids)
            yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks() if index.num_rows else pa.array([], pa.int64()), pa.array(starts + row["start"]), pa.array(sizes), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document, read back from the files that ``write_token_files`` wrote."""
    shards = max(1, manifest.count())
    return manifest.repartitionByRange(shards, "shard").mapInArrow(document_checks, READ)


def training_batches(path: str):
    """(ids as a matrix, mask as Arrow lists) of a shard, batch by batch, both views into the mapped file."""
    reader, _ = read_shard(path)
    for b in range(reader.num_record_batches):
        part = reader.get_batch(b)
        width = part.schema.field("ids").type.list_size
        yield part.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(-1, width), part.column("mask")


