"""Best-fit packing of token sequences: hierarchical, with residual rounds."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_slices, cut, give_back
from .encoding import DEFAULT_VOCABULARY, encoder, vocabulary_path, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin long, size int, items array<long>, lengths array<int>"


def token_pieces(docs: DataFrame, max_tokens: int = 2048, vocabulary: str | None = None, end_id: int = 0, cache: int = 450_000, slice_bytes: int = 4 << 20, forget: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of each document, its end id counted.

    Only longer documents are cut, and then into pieces of ``max_tokens``; the first may be shorter.
    Null texts are empty and give one piece with the end id alone; a null doc_id stays null.
    Repeated rows are documents of their own. Other columns are not read. A worker encodes ``slice_bytes``
    of text at a time, with ``cache`` parts remembered, which it forgets with ``forget`` after each task:
    less memory, more time, the same pieces.
    """
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)

    def cut_up(batches):
        import pyarrow as pa

        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        for batch in batches:
            for part in byte_slices(batch, slice_bytes):
                ids, offsets = with_end(*encoder(path, cache).encode(part.column("text")), end_id)
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    first = (b - a - 1) % max_tokens + 1
                    edges = [a, *range(a + first, b + 1, max_tokens)]
                    rows += [(doc, k, x - a, y - x, zlib.crc32(ids[x:y].astype("<u4").tobytes())) for k, (x, y) in enumerate(zip(edges, edges[1:]))]  # noqa: B905
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
        if forget:
            encoder(path, cache).forget()
            give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_up, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of ``sizes`` by bin.

    Open bins lie in lists by free space; an integer whose set bits are the free spaces in use
    finds the tightest bin in one step.
    """
    bins: list[list[int]] = []
    at_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        above = used >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            b = at_space[space].pop()
            if not at_space[space]:
                used &= ~(1 << space)
            bins[b].append(i)
        else:
            b, space = len(bins), capacity
            bins.append([i])
        if space - size:
            at_space[space - size].append(b)
            used |= 1 << (space - size)
    return bins


def _merge(ids, sizes, items, lengths, capacity: int, names: list[str]):
    """One round over a group's bins, which are its items."""
    import pyarrow as pa

    out = [[], [], [], []]
    for members in best_fit(sizes, capacity):
        own = [x for m in members for x in items[m]]
        out[0].append(min(ids[m] for m in members))
        out[1].append(sum(sizes[m] for m in members))
        out[2].append(own)
        out[3].append([x for m in members for x in lengths[m]])
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def pack(items: DataFrame, capacity: int = 2048, slack: int = 8, fan_in: int = 8, group_items: int = 200_000) -> DataFrame:
    """Sequence and offset of each row of ``items(item long, length long, ...)``.

    Round 0 packs each partition by best fit where it lies. Bins with at most ``slack`` tokens free
    are done; the others go on as items, ``fan_in`` groups merged into one each round, until
    one group is left or a group would hold over ``group_items`` bins: memory stays bounded at any
    input size, at the cost of one part-filled tail a group. ``item`` must be unique;
    lengths must lie between 1 and ``capacity`` (others raise). No rows give no rows.
    """
    names = [x.split()[0] for x in BINS.split(", ")]

    def local(batches):
        import pyarrow as pa

        parts = [(b.column("item").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
            raise ValueError(f"lengths must lie between 1 and {capacity}")
        for at in range(0, len(ids), group_items):
            own, lengths = ids[at : at + group_items].tolist(), sizes[at : at + group_items].tolist()
            yield from _merge(own, lengths, [[x] for x in own], [[x] for x in lengths], capacity, names).to_batches()
        if not len(ids):
            yield pa.RecordBatch.from_pylist([], schema=_merge([], [], [], [], capacity, names).schema)

    def again(group):
        return _merge(*(group.column(c).to_pylist() for c in names), capacity, names)

    open_bins = F.col("size") < capacity - slack
    bins = cut(items.select("item", "length").mapInArrow(local, BINS))
    done, groups = [bins.where(~open_bins)], items.rdd.getNumPartitions()
    left, before = bins.where(open_bins), 0
    while True:
        count = left.count()
        fewest = -(-count // group_items)
        if count < 2 or (before == 1) or (before and max(-(-before // fan_in), fewest) >= before):
            break
        before = max(1, -(-(before or groups) // fan_in), fewest)
        keyed = left.withColumn("home", F.pmod(F.xxhash64("bin"), F.lit(before)))
        bins = cut(keyed.groupBy("home").applyInArrow(again, BINS))
        done.append(bins.where(~open_bins))
        left = bins.where(open_bins)
    done.append(left)
    packed = done[0].select(*names)
    for part in done[1:]:
        packed = packed.unionByName(part.select(*names))
    placed = F.transform(
        "items",
        lambda x, i: F.struct(x.alias("item"), F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("long"), lambda a, b: a + b).alias("offset")),
    )
    return packed.select(F.col("bin").alias("sequence_id"), F.explode(placed).alias("x")).select("x.item", "sequence_id", "x.offset")


def pack_documents(docs: DataFrame, max_tokens: int = 2048, vocabulary: str | None = None, end_id: int = 0, cache: int = 450_000, slice_bytes: int = 4 << 20, forget: bool = False, **options) -> DataFrame:
    """All documents as sequences of at most ``max_tokens`` ids: the pieces, each with its place.

    Returns ``token_pieces`` with ``sequence_id`` and ``offset``; places in a sequence are gapless
    from 0. Pieces of full length are sequences of their own and are not packed. See there and at
    ``pack`` for nulls, empty texts, repeated rows and empty tables.
    """
    pieces = cut(token_pieces(docs, max_tokens, vocabulary, end_id, cache, slice_bytes, forget).withColumn("item", F.monotonically_increasing_id()))
    full = F.col("length") == max_tokens
    places = pack(pieces.where(~full).select("item", "length"), max_tokens, **options)
    alone = pieces.where(full).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(pieces.where(~full).join(places, "item")).drop("item")
