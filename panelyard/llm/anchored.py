"""Repeated windows over all documents, found through shared anchors.

Both substring operators ask of each window of K symbols whether the same string starts in an
earlier place. They choose anchors so that any two equal windows share one. The steps here:

1. Documents are dealt into chunks by doc_id. A chunk keeps one entry for each distinct
   context (anchor with everything its windows span), so a passage with any number of copies sends
   a chunk one row at most, and an anchor meets as many rows as there are chunks.
2. Entries meet by anchor. An equal context in an earlier document settles all windows of the later
   one. Where an anchor has several contexts that agree on a side far enough to share a window,
   the first holder of each is asked for its content.
3. The contents asked for meet by anchor and are compared exactly, window by window.
4. Each chunk unites the spans found and cuts its documents.

The text is shuffled once; the plan reuses that exchange for the steps that read it.

Contexts are equal if 32 bits of the anchor's hash beside its bucket, 64 bits of an independent hash of
the whole context and 16 bits of either side are: 128 bits, 96 where both sides are too short to tell.
Contexts meet only in their bucket. Of 10^13 anchors (some 180 TB of text) the expected number of pairs
that are taken for equal by mistake is under 10^-8 even at 96 bits.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shuffle_partitions, string_bytes, text_bytes

BLOB = "key long, kind int, payload binary"


@dataclass
class Chunk:
    """A chunk's documents in doc_id order: ids, bytes, and offsets (one more than documents)."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    known: np.ndarray  # False where doc_id is null: such rows are not compared


@dataclass
class Anchors:
    """Anchors of a chunk in ascending place; spans are in the chunk's symbols."""

    hash: np.ndarray  # of the anchor's content
    context: np.ndarray  # of the whole context, by another hash than the anchor's
    left: np.ndarray  # of what lies to the left, or 0 if too little does
    right: np.ndarray
    place: np.ndarray
    doc: np.ndarray  # row in the chunk
    first: np.ndarray  # first window's start
    last: np.ndarray  # last window's start


@dataclass
class Method:
    """What an operator adds: its symbols, anchors, contents and output."""

    window: int
    symbols: Callable  # (chunk) -> object with .bounds, the documents' offsets in symbols
    anchors: Callable  # (chunk, symbols) -> Anchors
    content: Callable  # (chunk, symbols, anchors, chosen, sides) -> (route hash, payload maker, spans settled at once)
    resolve: Callable  # (payloads) -> (chunk, starts of windows, lengths) found in an earlier place
    output: Callable  # (chunk, symbols, covered) -> columns
    schema: str = ""
    options: dict = field(default_factory=dict)


def load(table) -> Chunk:
    """Rows of a chunk in a stable order: by doc_id, null last; rows that share one by text."""
    ids = table.column("doc_id").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    nulls = np.isnan(ids) if ids.dtype.kind == "f" else np.zeros(len(ids), bool)
    if nulls.any():  # never through floats
        ids = table.column("doc_id").fill_null(0).to_numpy()
    order = np.lexsort((ids, nulls))
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (nulls[i], ids[i], texts[i] or "")))
    data, offsets = string_bytes(table.column("text").take(order))
    return Chunk(ids[order].astype(np.int64), data, offsets, ~nulls[order])


_KINDS = [np.dtype(k) for k in ("u1", "<u2", "<u4", "<u8", "<i4", "<i8")]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (_KINDS.index(a.dtype), len(a)))], "<i8")
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def unpack_arrays(payload: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    head = np.frombuffer(payload, "<i8", 2 * n, 8)
    out, at = [], 8 + 16 * n
    for num, size in head.reshape(-1, 2).tolist():
        kind = _KINDS[num]
        out.append(np.frombuffer(payload, kind, size, at))
        at += size * kind.itemsize
    return out


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a hash; ascending hashes give ascending buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Entries:
    """Distinct contexts of a chunk, sorted by anchor hash; each with its first holder."""

    def __init__(self, a: Anchors, ids: np.ndarray, buckets: int):
        sides = a.left.astype(np.uint32) << np.uint32(16) | a.right
        order = np.lexsort((sides, a.context, a.hash))  # stable: ascending place within a context
        h, c, s = a.hash[order], a.context[order], sides[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        self.of = np.empty(len(h), np.int64)  # entry of each anchor
        self.of[order] = np.cumsum(new) - 1
        self.anchor = order[new]  # the first anchor of each entry
        self.min_doc = ids[a.doc[self.anchor]]
        self.buckets, self.edges = np.unique(buckets_of(h[new], buckets), return_index=True)

    def start(self, bucket: int) -> int:
        """The first entry of a bucket."""
        return int(self.edges[np.searchsorted(self.buckets, np.uint64(bucket))])


_HEAD = struct.Struct("<qII")


def pack_entries(number: int, h, c, left, right, doc: np.ndarray) -> bytes:
    """Entries of a chunk in a bucket: 16 bytes and their arrays; docs as a list of distinct ones if that is shorter."""
    docs, at = np.unique(doc, return_inverse=True)
    arrays = [h.astype(np.uint32), c, left, right]
    if 8 * len(docs) + 4 * len(doc) < 8 * len(doc):
        arrays += [docs, at.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32)]
    else:
        docs = doc[:0]
        arrays.append(doc)
    return b"".join([_HEAD.pack(number, len(h), len(docs)), *(x.tobytes() for x in arrays)])


def unpack_entries(payload: bytes):
    number, n, n_docs = _HEAD.unpack_from(payload)
    at, out = _HEAD.size, []
    kinds = [(np.uint32, n), (np.uint64, n), (np.uint16, n), (np.uint16, n)]
    kinds += [(np.int64, n_docs), (np.uint16 if n_docs < 1 << 16 else np.uint32, n)] if n_docs else [(np.int64, n)]
    for kind, size in kinds:
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return number, *out[:4], out[4][out[5]] if n_docs else out[4]


def _table(key: list[int], kind: list[int], payload: list[bytes]):
    import pyarrow as pa

    return pa.Table.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["key", "kind", "payload"])


def _send(chunk: Chunk, number: int, a: Anchors, buckets: int):
    e = Entries(a, chunk.ids, buckets)
    keys, blobs = e.buckets.astype(np.int64).tolist(), []
    for x, y in zip(e.edges.tolist(), np.append(e.edges, len(e.anchor))[1:].tolist(), strict=True):
        own = e.anchor[x:y]
        blobs.append(pack_entries(number, a.hash[own], a.context[own], a.left[own], a.right[own], e.min_doc[x:y]))
    return _table(keys, [0] * len(keys), blobs)


def _meet(bucket: int, table):
    """Entries of a bucket: for each chunk, which are settled, and which contents are asked for."""
    parts = [unpack_entries(p) for p in table.column("payload").to_pylist()]
    if not parts:
        return _table([], [], [])
    sizes = np.array([len(p[1]) for p in parts])
    h, c, left, right, doc = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    sides = left << np.uint64(16) | right
    key = h.astype(np.uint64) << np.uint64(32) | sides
    order = np.lexsort((doc, c, key))
    k, s = key[order], c[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    least = np.empty(len(k), np.int64)
    least[order] = doc[order][new][group]
    # contexts of an anchor that agree on one side
    hs, agree = h[order][new].astype(np.uint64), np.zeros(int(new.sum()), np.uint8)
    for bit, side in ((1, left[order][new]), (2, right[order][new])):
        pair = hs << np.uint64(16) | side
        by = np.argsort(pair, kind="stable")
        same = (pair[by][1:] == pair[by][:-1]) & (side[by][1:] > 0)
        which = np.zeros(len(pair), bool)
        which[by[1:][same]] = True
        which[by[:-1][same]] = True
        agree[which] |= bit
    asked = np.empty(len(k), np.uint8)
    asked[order] = agree[group]
    keys, blobs, at = [], [], 0
    for p, n in zip(parts, sizes.tolist(), strict=True):
        mine, own = least[at : at + n], doc[at : at + n]
        settled = np.flatnonzero(mine < own)
        wanted = np.flatnonzero((asked[at : at + n] > 0) & (mine == own))
        if len(settled) or len(wanted):
            docs, place = np.unique(mine[settled], return_inverse=True)
            keys.append(p[0])
            blobs.append(pack_arrays(np.array([bucket]), settled.astype(np.uint32), docs, place.astype(np.uint32), wanted.astype(np.uint32), asked[at : at + n][wanted]))
        at += n
    return _table(keys, [1] * len(keys), blobs)


def _apply(m: Method, chunk: Chunk, number: int, symbols, a: Anchors, replies: list[bytes], buckets: int):
    """Spans that are settled, and the contents asked for, by bucket."""
    e = Entries(a, chunk.ids, buckets)
    least, wanted = e.min_doc.copy(), np.zeros(len(e.anchor), np.uint8)
    for payload in replies:
        b, settled, docs, place, asked, sides = unpack_arrays(payload)
        at = e.start(b[0])
        least[at + settled.astype(np.int64)] = docs[place]
        wanted[at + asked.astype(np.int64)] = sides
    gone = m.options["later"](chunk, a, e, least)
    starts, ends = a.first[gone], a.last[gone] + m.window
    keys, kinds, blobs = [], [], []
    chosen = np.flatnonzero((wanted[e.of] > 0) & (chunk.ids[a.doc] == least[e.of]) & m.options["holder"](a, e))
    if len(chosen):
        route, make, more, to = m.content(chunk, symbols, a, chosen, wanted[e.of[chosen]])
        starts, ends = np.concatenate([starts, more]), np.concatenate([ends, to])
        b = buckets_of(route, buckets)
        order = np.argsort(b, kind="stable")
        filled, edges = np.unique(b[order], return_index=True)
        for i, x, y in zip(filled.tolist(), edges.tolist(), np.append(edges, len(order))[1:].tolist(), strict=True):
            keys.append(i)
            kinds.append(1)
            blobs.append(make(order[x:y], number))
    mask = covered(int(symbols.bounds[-1]), starts, ends)
    keys.append(number)
    kinds.append(0)
    blobs.append(pack_arrays(*np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).T))
    return _table(keys, kinds, blobs)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` symbols lie in a span."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, m: Method, chunk_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Run ``m`` over all rows of ``docs(doc_id, text)``; see the module's text.

    A chunk has about ``chunk_bytes`` of text and a bucket the entries of about ``bucket_bytes`` of it,
    whatever the size of the table: both counts grow with it, so that what a worker holds does not.
    """
    spark = docs.sparkSession
    parts, size = shuffle_partitions(spark), text_bytes(docs)
    chunks = max(2 * parts, -(-size // chunk_bytes))
    buckets = max(2 * parts, -(-size // bucket_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # null ids have no order; their rows are spread by text and only counted
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    dealt = rows.withColumn("key", F.pmod(spread, F.lit(chunks)))

    def send(key, table):
        chunk = load(table)
        return _send(chunk, key[0].as_py(), m.anchors(chunk, m.symbols(chunk)), buckets)

    def apply(table, replies):
        chunk = load(table)
        if not len(chunk.ids):
            return _table([], [], [])
        symbols = m.symbols(chunk)
        return _apply(m, chunk, table.column("key")[0].as_py(), symbols, m.anchors(chunk, symbols), replies.column("payload").to_pylist(), buckets)

    def resolve(key, table):
        if key[0].as_py() == 0:  # spans already
            return table.select(["key", "kind", "payload"])
        keys, blobs = [], []
        for number, starts, ends in m.resolve(table.column("payload").to_pylist()):
            keys.append(number)
            blobs.append(pack_arrays(starts, ends))
        return _table(keys, [0] * len(keys), blobs)

    def finish(table, spans):
        import pyarrow as pa

        chunk = load(table)
        symbols = m.symbols(chunk)
        found = [unpack_arrays(p) for p in spans.column("payload").to_pylist()]
        none = np.zeros(0, np.int64)
        mask = covered(int(symbols.bounds[-1]), np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)]))
        columns = m.output(chunk, symbols, mask)
        ids = pa.array(chunk.ids, mask=~chunk.known)
        return pa.Table.from_arrays([ids, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=[x.split()[0] for x in m.schema.split(", ")])

    by_chunk = dealt.groupBy("key")
    entries = by_chunk.applyInArrow(send, BLOB)
    replies = entries.groupBy("key").applyInArrow(lambda key, table: _meet(key[0].as_py(), table), BLOB)
    applied = by_chunk.cogroup(replies.groupBy("key")).applyInArrow(apply, BLOB)
    spans = applied.groupBy("kind", "key").applyInArrow(resolve, BLOB)
    return by_chunk.cogroup(spans.groupBy("key")).applyInArrow(finish, m.schema)


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def strings(values):
    import pyarrow as pa

    return pa.array(list(values), pa.string())


def text_columns(texts: list[str], spans: list[list[dict]]):
    """What is kept, and the spans cut."""
    import pyarrow as pa

    return strings(texts), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
