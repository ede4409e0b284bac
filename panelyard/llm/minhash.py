"""Near-duplicates by MinHash with sequential Bayesian verification."""

from __future__ import annotations

from math import comb, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import among, byte_slices, cut, give_back, id_words, mix, release, string_bytes
from .components import connected_components
from .substring_dedup import RangeHash, Words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BATCH = 32
#: Bytes of text that a worker takes at a time.
SLICE = 1 << 20


class _Part:
    def __init__(self, data, offsets):
        self.data, self.offsets = data, offsets


def shingle_sets(texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, in a row; offsets (one more than texts).

    Words are runs without white space, A-Z lower-cased. A text with fewer words than ``size`` has
    its whole sequence as one shingle; one without words, or null, has none.
    """
    data, offsets = string_bytes(texts)
    words = Words(_Part(_LOWER[data], offsets))
    count = np.diff(words.bounds)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), shingles)
    start = words.bounds[:-1][doc] + np.arange(len(doc)) - (np.cumsum(shingles) - shingles)[doc]
    h = RangeHash(words.hash)(start, np.minimum(start + size, words.bounds[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(h: np.ndarray, offsets: np.ndarray, hashes: int, seed: int = 6) -> np.ndarray:
    """MinHash matrix (texts x hashes); rows of empty sets are all ones.

    Each cell is 16 bits of the least hash: others agree with it by chance once in 65,536.
    """
    rng = np.random.default_rng(seed)
    factors, terms = (rng.integers(0, 1 << 64, hashes, np.uint64) for _ in range(2))
    out = np.full((len(offsets) - 1, hashes), np.uint16(0xFFFF))
    rows = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(rows):  # blocks that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(offsets[rows], offsets[rows[at]] + 32_768)))
        own = rows[at:to]
        x = h[offsets[own[0]] : offsets[own[-1] + 1]]
        begins = offsets[own] - offsets[own[0]]
        for i in range(hashes):
            out[own, i] = (np.minimum.reduceat(x * (factors[i] | np.uint64(1)) + terms[i], begins) >> np.uint64(32)) & np.uint64(0xFFFF)
        at = to
    return out


def band_keys(matrix: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each signature's bands."""
    bands = matrix.shape[1] // rows
    parts = matrix[:, : bands * rows].astype(np.uint64).reshape(len(matrix), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(matrix), bands)).copy()
    for i in range(rows):
        key = mix(key, parts[:, :, i])
    return key.view(np.int64)


def least_matches(hashes: int, threshold: float, miss: float) -> dict[int, int]:
    """After each batch, the fewest equal hashes a pair may have.

    With a uniform prior and m of n hashes equal, the similarity has a Beta(m+1, n-m+1)
    posterior; it reaches ``threshold`` with the probability that n+1 throws give m hits at most.
    Pairs for which that is under ``miss`` are given up.
    """
    out = {}
    for n in range(BATCH, hashes + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def likely_blocks(part: np.ndarray, sizes: np.ndarray, matrix: np.ndarray, percent: int, fewest: dict[int, int], side: np.ndarray, strip: int = 256):
    """Pairs of different parts that sizes and signatures leave open: nodes of side 0, nodes of side 1, which are open; a strip at a time."""
    every, other = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    for low in range(0, len(every), strip):
        one, two = every[low : low + strip], other
        small, large = (f.outer(sizes[one], sizes[two]) for f in (np.minimum, np.maximum))
        open_ = (part[one][:, None] != part[two][None, :]) & (small >= large * (percent / 100) - 1e-6)
        equal = np.zeros(open_.shape, np.int16)
        for n, least in fewest.items():
            rows, columns = open_.any(1), open_.any(0)
            one, two, open_, equal = one[rows], two[columns], open_[rows][:, columns], equal[rows][:, columns]
            if not len(one):
                break
            for c in range(n - BATCH, n):
                equal += matrix[one, c][:, None] == matrix[two, c][None, :]
            open_ &= equal >= least
        rows, columns = open_.any(1), open_.any(0)
        if rows.any():
            yield one[rows], two[columns], open_[rows][:, columns]


def links(nodes: list[int], label: list[int], matrix: np.ndarray, sets: list[np.ndarray], percent: int, fewest: dict[int, int], side: np.ndarray, strip: int = 256) -> list[tuple[int, int]]:
    """Links that join the labels of some nodes, exactly verified: one for each join at most.

    Nodes of side 0 meet those of side 1 (all nodes meet where there is one side only). Signatures rule
    pairs of two labels out in batches; of the others, intersections of full sets decide. Memory is that
    of ``strip`` nodes of side 0 against side 1.
    """
    part = np.unique(np.array(label), return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int32, len(sets))
    met = [np.zeros((2, 0), np.int64)]
    for one, two, open_ in likely_blocks(part, sizes, matrix, percent, fewest, side, strip):
        shared = intersections([sets[i] for i in one], [sets[i] for i in two])
        open_ &= 100 * shared >= percent * (sizes[one].astype(np.int64)[:, None] + sizes[two][None, :] - shared)
        met.append(np.stack([x[y] for x, y in zip((one, two), np.nonzero(open_), strict=True)]))
    i, j = np.concatenate(met, axis=1)
    _, first = np.unique(part[i] * len(part) + part[j], return_index=True)
    root, out = list(range(len(part))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
        u, v = find(int(part[x])), find(int(part[y]))
        if u != v:
            root[u] = v
            out.append((nodes[x], nodes[y]))
    return out


def intersections(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``, by common bits of incidence blocks."""
    both = [*one, *two]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, member, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    keep = several[member]
    owner, member = owner[keep], number[member[keep]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    out = np.zeros((len(one), len(two)), np.int64)
    for low in range(0, int(several.sum()), width):
        x, y = np.searchsorted(member, (low, low + width))
        has = np.zeros((len(both), width), bool)
        has[owner[x:y], member[x:y] - low] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        for i in range(len(one)):
            out[i] += np.bitwise_count(bits[i] & bits[len(one) :]).sum(1, dtype=np.int64)
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of ascending sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 40, rows: int = 4, miss: float = 1e-9, block: int = 2048) -> DataFrame:
    """Each document's class under links of similarity ``percent`` or more: doc_id, n_shingles, component_id, kept.

    Equal sets become one node before anything else, so copies cost one row each. In a band's
    bucket each node is compared with the bucket's least node only; where the verified links leave a
    bucket in several parts, its nodes of like set sizes meet in pairs of blocks: signatures first (blocks of
    four times ``block``), then, with full sets, the nodes that have a likely partner (twice ``block``).
    Candidates miss a pair at the threshold with probability (1 - s^rows)^bands
    (2.5e-7 as set), the Bayesian rule with ``miss``; links are confirmed on full sets.

    Null texts and texts without words are linked with nothing. Rows that share a doc_id need not
    have one text; each counts, and the id is reachable through any of them. A null doc_id is never
    a component_id while another is there. Empty tables give no rows; other columns are not read.
    """
    hashes = -(-bands * rows // BATCH) * BATCH
    fewest = least_matches(hashes, percent / 100, miss)
    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def fingerprints(h, offsets):
        """Of each set: 128 bits from two sums over its members, and its size."""
        twice = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, np.uint64(k)))]) for k in (1, 2)]
        sums = [mix(s[offsets[1:]] - s[offsets[:-1]], np.diff(offsets).astype(np.uint64)) for s in twice]
        return [f"{x:016x}{y:016x}" if n else None for x, y, n in zip(*(s.tolist() for s in sums), np.diff(offsets).tolist(), strict=True)]

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, SLICE):
                h, offsets = shingle_sets(part.column("text"), size)
                matrix = signatures(h, offsets, hashes)
                raw = [m.tobytes() for m in matrix]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(fingerprints(h, offsets), pa.string()), pa.array(raw, pa.binary())], names=["doc_id", "n", "set", "signature"])

    def full(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, SLICE):
                h, offsets = shingle_sets(part.column("text"), size)
                keep = [i for i, (f, g) in enumerate(zip(fingerprints(h, offsets), part.column("set").to_pylist(), strict=True)) if f == g]
                raw = [h[offsets[i] : offsets[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], names=["node", "members"])

    def unnamed(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, SLICE):
                h, offsets = shingle_sets(part.column("text"), size)
                raw = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(h, offsets), pa.string()), pa.array(raw, pa.binary())], names=["set", "members"])

    def to_bands(batches):
        import pyarrow as pa

        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(batch.num_rows, hashes)
            keys = band_keys(matrix[:, : bands * rows], rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "keys"])

    sketches = cut(rows_in.mapInArrow(sketch, "doc_id long, n long, set string, signature binary"))
    nodes = sketches.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    every = nodes.select("node", "signature").mapInArrow(to_bands, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    # only buckets with two nodes or more go on
    leaders = every.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    banded = cut(every.join(leaders, "key"))
    stars = banded.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    signs = nodes.select("node", "signature")

    def likely(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, hashes) for c in ("su", "sv"))
            alive = np.ones(batch.num_rows, bool)
            equal = np.zeros(batch.num_rows, np.int64)
            for n, least in fewest.items():
                equal[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                alive &= equal >= least
            yield batch.select(["u", "v"]).filter(pa.array(alive))

    def sure(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("mu", "mv"))
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def with_both(pairs, side, column):
        for end in ("u", "v"):
            pairs = pairs.join(side.select(F.col("node").alias(end), F.col(column).alias(column[0] + end)), end)
        return pairs

    likely_pairs = cut(with_both(stars, signs, "signature").mapInArrow(likely, "u long, v long"))
    # full sets of all nodes that may be needed: those of shared buckets
    needed = cut(banded.select("node").distinct().join(nodes.select("node", "doc_id", "set"), "node"))
    # most texts are not needed: they go where they are read
    few = among(rows_in, "doc_id", id_words(needed, "doc_id"))
    named_sets = few.join(needed, "doc_id").mapInArrow(full, "node long, members binary")
    # no id leads to sets that only rows with a null doc_id have; they meet by fingerprint
    null_sets = rows_in.where("doc_id is null").mapInArrow(unnamed, "set string, members binary").join(needed.where("doc_id is null").select("node", "set"), "set")
    sets = cut(named_sets.unionByName(null_sets.groupBy("node").agg(F.first("members").alias("members"))))
    release(docs.sparkSession)
    linked = cut(with_both(likely_pairs, sets, "members").mapInArrow(sure, "u long, v long"))
    first = connected_components(linked)

    # buckets that are still in parts, without those of two nodes, which have met. Their nodes meet in
    # pairs of blocks of one bucket; similar sets are of one size class or of neighbours
    labelled = banded.join(first, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    parted = cut(labelled.join(parts, "key").join(nodes.select("node", "n"), "node"))
    release(docs.sparkSession, banded, likely_pairs)
    # a bucket beyond a block is divided by set size: like sets are of one size class or of neighbours
    class_of = F.floor(F.log("n") / F.lit(-log(percent / 100)) + F.lit(1e-9))

    def dealt(rows, most, members):
        """Nodes of ``rows`` by pairs of blocks: at most about ``most`` nodes and ``members`` shingles in a block."""
        sizes = rows.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("sum"))
        classes = F.when((F.col("many") > most) | (F.col("sum") > members), F.array(class_of, class_of - 1)).otherwise(F.array(F.lit(-2).cast("long")))
        rest = rows.join(sizes, "key").select("key", "node", "label", "n", F.explode(classes).alias("class"))
        blocks = F.ceil(F.greatest(F.count("*") / most, F.sum("n") / members)).cast("int")
        mixed = rest.groupBy("key", "class").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks.alias("blocks")).where("low <> high")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        out = rest.join(mixed.select("key", "class", "blocks"), ["key", "class"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", other)
        return out.select("node", "label", "n", "key", "class", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"))

    def arrays(group):
        matrix = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(group.num_rows, hashes)
        return matrix, group.column("label").to_pylist(), group.column("side").to_numpy()

    def partners(key, group):
        """Nodes that signatures leave a partner in the bucket: sets are sent for these only."""
        import pyarrow as pa

        matrix, label, side = arrays(group)
        some = np.zeros(group.num_rows, bool)
        for one, two, _ in likely_blocks(np.array(label), group.column("n").to_numpy(), matrix, percent, fewest, side):
            some[one] = some[two] = True
        give_back()
        return group.filter(pa.array(some)).select(["key", "node", "label", "n"])

    seen = dealt(parted, 4 * block, 1 << 40).join(signs, "node").groupBy("key", "class", "a", "b")
    close = cut(seen.applyInArrow(partners, "key long, node long, label long, n long").distinct())
    release(docs.sparkSession, parted)

    def join_up(key, group):
        import pyarrow as pa

        matrix, label, side = arrays(group)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
        found = links(group.column("node").to_pylist(), label, matrix, sets, percent, fewest, side)
        give_back()
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    met = dealt(close, 2 * block, 1024 * block).join(signs, "node").join(sets, "node").groupBy("key", "class", "a", "b").applyInArrow(join_up, "u long, v long")
    more = cut(met.distinct())
    release(docs.sparkSession, close, sets)
    # what these add joins whole components of before
    ends = more.join(first.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
    joined = connected_components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))

    named = nodes.select("set", "node", "doc_id").join(first, "node", "left").withColumn("old", F.coalesce("label", "node")).drop("label")
    named = named.join(joined.select(F.col("node").alias("old"), "label"), "old", "left").withColumn("label", F.coalesce("label", "old")).drop("old")
    named = cut(named.drop("node"))
    release(docs.sparkSession, nodes, linked, more)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(smallest, "label").select("set", "component_id")
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set").join(classes, "set", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


