"""Repeated byte strings through a multi-document Burrows-Wheeler transform built by columns."""

from __future__ import annotations

import contextlib
import hashlib
import io
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import anchored
from ._common import mix, shared_dir

SEGMENT = 1 << 18
GRAM = 16
_RANDOM, _RANDOM_2 = (np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1) for seed in (20, 21))
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Files:
    """Named arrays that are written and read in order: files of a folder, or memory without one."""

    def __init__(self, folder: str | None):
        self.folder, self.used, self.held = folder, 0, {}

    def writer(self, name: str):
        self.used += self.folder is not None
        if self.folder is None:
            self.held[name] = io.BytesIO()
            return contextlib.nullcontext(self.held[name])
        return open(os.path.join(self.folder, name), "wb")

    def blocks(self, name: str, dtype, sizes):
        """The array's next parts, of the sizes that ``sizes`` gives."""
        width = np.dtype(dtype).itemsize
        if self.folder is None:
            source = self.held[name]
            source.seek(0)
            for size in sizes:
                yield np.frombuffer(source.read(size * width), dtype)
        else:
            with open(os.path.join(self.folder, name), "rb", buffering=0) as source:
                for size in sizes:
                    yield np.fromfile(source, dtype, size)

    def whole(self, name: str, dtype) -> np.ndarray:
        """The array, mapped if it is a file: only the pages in use are read."""
        if self.folder is None:
            return np.frombuffer(self.held[name].getbuffer(), dtype)
        path = os.path.join(self.folder, name)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class ColumnwiseIndex:
    """Burrows-Wheeler transform and common prefixes of a collection of byte strings.

    Round t inserts the suffix of length t of every string that has one, all at once: the symbol
    that each string put into the transform a round ago says, by its rank among equal symbols,
    where the suffix goes. Transform and common prefixes lie in files of the ``scratch`` folder (in
    memory without one). A round reads them in order twice, ``block`` symbols at a time: once for ranks
    and for the prefixes of new neighbours (range minima of the old ones plus one, carried from
    block to block for each symbol), once to merge the new symbols in and write the next files.
    Beside a block only a few numbers for each string are held.

    Strings must be free of the byte 0xFF, as UTF-8 is. Equal suffixes stand in the
    order of their strings. Empty strings are allowed. ``close`` removes the files.
    """

    def __init__(self, strings: list[bytes], scratch: str | None = None, block: int = 1 << 20):
        self.n, self.block = len(strings), block
        self.folder = tempfile.TemporaryDirectory(dir=scratch) if scratch else None
        self.files = Files(self.folder.name if self.folder else None)
        self.sizes = np.fromiter(map(len, strings), np.int64, self.n)
        self.longest = int(self.sizes.max()) if self.n else 0
        self.prefix = np.dtype("u1" if self.longest < 255 else "<u4")
        self._columns(strings)
        self._build()

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.close()

    def _columns(self, strings: list[bytes]) -> None:
        """Column t: the symbol before the suffix of length t of each string that has one, 0 where that is the whole string."""
        order = np.argsort(-self.sizes, kind="stable")  # strings that a column has come first
        self.has = np.searchsorted(-self.sizes[order], -np.arange(self.longest + 1), "right")
        flat = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum(self.sizes)[order]
        self.order = order
        with self.files.writer("columns") as out:
            for t in range(self.longest + 1):
                own = order[: self.has[t]]
                symbols = np.zeros(len(own), np.uint8)
                more = self.sizes[own] > t
                symbols[more] = flat[ends[: len(own)][more] - 1 - t] + 1
                out.write(symbols.tobytes())

    def _parts(self, size: int) -> list[int]:
        return [min(self.block, size - s) for s in range(0, size, self.block)]

    def _build(self) -> None:
        columns = self.files.blocks("columns", np.uint8, self.has.tolist())
        first = np.zeros(self.n, np.uint8)
        if self.n:
            first[self.order] = next(columns)
        with self.files.writer("bwt0") as out:
            out.write(first.tobytes())
        with self.files.writer("lcp0") as out:
            out.write(np.zeros(self.n, self.prefix).tobytes())
        self.size, self.total, self.turn = self.n, np.bincount(first, minlength=257).astype(np.int64), 0
        place = self.order.copy()  # of each string's last suffix; strings as in a column
        for t in range(1, self.longest + 1):
            symbols = next(columns)
            place = place[: len(symbols)]
            new, at, value = self._ranks(place)
            self._merge(new, symbols, at, value)
            self.total += np.bincount(symbols, minlength=257)
            place = new

    def _ranks(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the suffixes that continue those at ``place`` go; places whose common prefix is new, and these."""
        begin = self.n + np.concatenate([[0, 0], np.cumsum(self.total[1:256])])  # first place of each symbol's suffixes
        by = np.argsort(place, kind="stable")
        sorted_, new = place[by], np.empty(len(place), np.int64)
        seen, low, was_fresh = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, bool)
        places, values, start, done = [], [], 0, 0
        parts = self._parts(self.size)
        for bwt, lcp in zip(self.files.blocks(f"bwt{self.turn}", np.uint8, parts), self.files.blocks(f"lcp{self.turn}", self.prefix, parts), strict=True):
            upto = int(np.searchsorted(sorted_, start + len(bwt)))
            here = sorted_[done:upto] - start
            order = np.argsort(bwt, kind="stable")
            count = np.bincount(bwt, minlength=257)
            kinds = np.flatnonzero(count)
            count = count[kinds]
            edge = np.cumsum(count) - count
            fresh = np.zeros(len(bwt), bool)
            fresh[here] = True
            flag = fresh[order]
            mine = np.flatnonzero(flag)
            shift = begin[kinds] + seen[kinds] - edge  # from places by symbol to places of suffixes
            kind_of = np.searchsorted(edge, mine, "right") - 1
            # ``here`` ascends, so the places in order of the transform are the same
            new[by[done:upto]] = (mine + shift[kind_of])[np.argsort(order[mine])]
            # new suffixes and those that follow one have new neighbours
            flag[1:] |= flag[:-1].copy()
            flag[edge] = fresh[order[edge]] | was_fresh[kinds]
            if kinds[0] == 0:
                flag[: count[0]] = False
            at = np.flatnonzero(flag)
            kind_of = np.searchsorted(edge, at, "right") - 1
            value = np.zeros(len(at), np.int64)
            inside = at != edge[kind_of]
            if inside.any():
                one, two = order[at[inside] - 1] + 1, order[at[inside]] + 1
                # from the last range to the first: what lies between two of them is not gone through
                back = np.argsort(-one, kind="stable")
                least = np.empty(len(one), np.int64)
                least[back] = np.minimum.reduceat(np.append(lcp, np.iinfo(lcp.dtype).max), np.stack([one[back], two[back]], 1).ravel())[::2]
                value[inside] = least + 1
            least = np.minimum.accumulate(lcp)
            carried = at[~inside]
            kind = kinds[kind_of[~inside]]
            value[~inside] = np.where(seen[kind] > 0, np.minimum(low[kind], least[order[carried]]) + 1, 0)
            places.append(at + shift[kind_of])
            values.append(value)
            # for each symbol, the least prefix since its last place
            low = np.minimum(low, int(least[-1]))
            last = order[edge + count - 1]
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(lcp.dtype).max)
            low[kinds], was_fresh[kinds] = tail[last + 1], fresh[last]
            seen[kinds] += count
            start, done = start + len(bwt), upto
        return new, np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *values])

    def _merge(self, new: np.ndarray, symbols: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        by = np.argsort(new)
        new, symbols = new[by], symbols[by]
        by = np.argsort(at)
        at, value = at[by], value[by].astype(self.prefix)
        size = self.size + len(new)
        parts = self._parts(size)
        starts = np.cumsum([0, *parts])
        edges, marks = np.searchsorted(new, starts), np.searchsorted(at, starts)
        old = [p - int(e) for p, e in zip(parts, np.diff(edges), strict=True)]
        sources = (self.files.blocks(f"bwt{self.turn}", np.uint8, old), self.files.blocks(f"lcp{self.turn}", self.prefix, old))
        with self.files.writer(f"bwt{1 - self.turn}") as out, self.files.writer(f"lcp{1 - self.turn}") as out_lcp:
            for i, (old_bwt, old_lcp) in enumerate(zip(*sources, strict=True)):
                fresh = np.zeros(parts[i], bool)
                inserted = new[edges[i] : edges[i + 1]] - starts[i]
                fresh[inserted] = True
                bwt, lcp = np.empty(parts[i], np.uint8), np.zeros(parts[i], self.prefix)
                bwt[~fresh], lcp[~fresh] = old_bwt, old_lcp
                bwt[inserted] = symbols[edges[i] : edges[i + 1]]
                lcp[at[marks[i] : marks[i + 1]] - starts[i]] = value[marks[i] : marks[i + 1]]
                out.write(bwt.tobytes())
                out_lcp.write(lcp.tobytes())
        self.size, self.turn = size, 1 - self.turn

    @property
    def bwt(self) -> np.ndarray:
        return self.files.whole(f"bwt{self.turn}", np.uint8)

    @property
    def lcp(self) -> np.ndarray:
        return self.files.whole(f"lcp{self.turn}", self.prefix)

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of ``length``: their string, start, and a class that equal windows share.

        One pass writes, for each place of the transform, where the suffix that continues it lies, and
        its class; the walk through all strings reads these files where it needs them.
        """
        begin = self.n + np.concatenate([[0, 0], np.cumsum(self.total[1:256])])
        seen, group, parts = np.zeros(256, np.int64), 0, self._parts(self.size)
        with self.files.writer("next") as out, self.files.writer("class") as out_class:
            for bwt, lcp in zip(self.files.blocks(f"bwt{self.turn}", np.uint8, parts), self.files.blocks(f"lcp{self.turn}", self.prefix, parts), strict=True):
                order = np.argsort(bwt, kind="stable")
                count = np.bincount(bwt, minlength=256)
                to = np.empty(len(bwt), np.int64)
                to[order] = np.arange(len(bwt)) + np.repeat(begin[:256] + seen - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                of = group + np.cumsum(lcp < length)
                out.write(to.tobytes())
                out_class.write(of.tobytes())
                seen += count
                group = int(of[-1])
        target, of = self.files.whole("next", np.int64), self.files.whole("class", np.int64)
        place, alive = np.arange(self.n), np.arange(self.n)
        found = []
        for t in range(1, self.longest + 1):
            keep = self.sizes[alive] >= t
            alive, place = alive[keep], target[place[keep]]
            if t >= length:
                found.append((alive, self.sizes[alive] - t, of[place]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[size] = tuple(out)
    return tuple(p[:n] for p in _POWERS[size])


class RangeHash:
    """Hashes of ranges of 64-bit symbols, by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], (end - start).astype(np.uint64))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, random: np.ndarray = _RANDOM, block: int = 900_000) -> np.ndarray:
    """Hashes of ascending, disjoint byte ranges, in blocks that bound the memory for sums and powers."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + block, "right")))
        low = start[at]
        out[at:to] = RangeHash(random[data[low : end[to - 1]]])(start[at:to] - low, end[at:to] - low)
        at = to
    return out


class _Bytes:
    def __init__(self, chunk):
        self.bounds = chunk.offsets


def _anchors(k: int):
    """Minimizers: the least hash of 16 bytes in each window of ``k`` is its anchor."""
    width = k - GRAM + 1
    half = (k - GRAM) // 2

    def find(chunk, symbols) -> anchored.Anchors:
        n, bounds = len(chunk.data), chunk.offsets
        ok = np.ones(max(0, n - k + 1), bool)
        tails = np.where(chunk.known, np.maximum(bounds[:-1], bounds[1:] - k + 1), bounds[:-1])
        for a, b in zip(tails.tolist(), bounds[1:].tolist(), strict=True):
            ok[a:b] = False
        out = []
        for s in range(0, len(ok), SEGMENT):
            e = min(s + SEGMENT, len(ok))  # windows that start in [s, e)
            mapped = _RANDOM[chunk.data[s : e + k - 1]]
            h = mapped
            for step in (1, 2, 4, 8):
                h = mix(h[:-step], h[step:])
            low = np.uint64((1 << 24) - 1)
            least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            have = 1
            while have < width:
                step = min(have, width - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            p = (least & low).astype(np.int64)
            valid = ok[s:e]
            p[~valid] = -1
            change = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            first, last = change, np.concatenate([change[1:], [len(p)]]) - 1
            keep = p[change] >= 0
            first, last, p = first[keep], last[keep], p[change][keep]
            ranges = RangeHash(mapped)
            context = ranges(first, last + k)
            sides = []
            for has, x, y in ((first <= p - half, p - half, p), (last + k >= p + GRAM + half, p + GRAM, p + GRAM + half)):
                side = np.zeros(len(p), np.uint16)
                side[has] = (ranges(x[has], y[has]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
                sides.append(side)
            doc = np.searchsorted(bounds, first + s, "right") - 1
            # least hashes are small ones: mixed again, they spread
            out.append(anchored.Anchors(mix(h[p], np.uint64(5)), context, *sides, p + s, doc, first + s, last + s))
        if not out:
            z = np.zeros(0, np.int64)
            return anchored.Anchors(z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint16), z.astype(np.uint16), z, z, z, z)
        return anchored.Anchors(*(np.concatenate([getattr(a, f) for a in out]) for f in anchored.Anchors.__dataclass_fields__))

    return find


#: Bytes beyond an anchor that decide, with it, where a piece goes.
NEAR = 5
#: Bytes of pieces that one transform takes; more are dealt into several, by route.
COLLECTION = 2 << 20


def _content(k: int):
    """The strings around chosen anchors, in pieces that equal windows share.

    Windows that reach under ``NEAR`` bytes beyond the anchor on one side go by the anchor; they are
    the same in most copies of a passage, and a chunk sends each distinct one once. The others go
    by the anchor and those bytes, so what follows a very common passage spreads.
    """
    half = (k - GRAM) // 2

    def make(chunk, symbols, a, chosen, sides):
        p, first, last, h = a.place[chosen], a.first[chosen], a.last[chosen], a.hash[chosen]
        symbols = _RANDOM[chunk.data]
        ranges = RangeHash(symbols)
        reach = k - GRAM  # a window that starts at p - x reaches reach - x bytes beyond the anchor
        parts = []
        for bit, low, high, route in (
            (1, first, np.minimum(last, p - reach + NEAR - 1), None),
            (1, np.maximum(first, p - reach + NEAR), np.minimum(last, p - half), (GRAM, GRAM + NEAR)),
            (2, np.maximum(first, p - half + 1), np.minimum(last, p - NEAR), (-NEAR, 0)),
            (2, np.maximum(first, p - NEAR + 1), last, None),
        ):
            on = np.flatnonzero((sides & bit > 0) & (low <= high))
            way = h[on] if route is None else mix(h[on], ranges(p[on] + route[0], p[on] + route[1]))
            parts.append((low[on], high[on] + k, mix(way, np.uint64(bit + 4 * (route is None))), a.doc[chosen[on]]))
        start, end, route, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, whole, again = chunk.ids[doc], mix(ranges(start, end), route), RangeHash(_RANDOM_2[chunk.data])(start, end)
        order = np.lexsort((ids, again, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (again[order][1:] != again[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = ids[order][new][np.cumsum(new) - 1]
        later = ids > least  # an equal piece in this chunk settles it
        start_, end_, route, ids = start[~later], end[~later], route[~later], ids[~later]

        def payload(which, number):
            text = b"".join(chunk.data[x:y].tobytes() for x, y in zip(start_[which].tolist(), end_[which].tolist(), strict=True))
            docs, at = np.unique(ids[which], return_inverse=True)
            return anchored.pack_arrays(np.array([number]), docs, at.astype(np.uint32), route[which], start_[which].astype(np.int64), (end_ - start_)[which].astype(np.uint32), np.frombuffer(text, np.uint8))

        return route, payload, start[later], end[later]

    return make


def _resolve(k: int, scratch: str | None):
    def resolve(payloads):
        if not payloads:
            return
        parts = [anchored.unpack_arrays(p) for p in payloads]
        chunk = np.concatenate([np.repeat(p[0], len(p[2])) for p in parts])
        doc = np.concatenate([p[1][p[2]] for p in parts])
        route, place, size = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        size = size.astype(np.int64)
        data = np.concatenate([p[6] for p in parts])
        ends = np.cumsum(size)
        # a string that no other has come to meet needs no comparison
        content = RangeHash(_RANDOM[data])(ends - size, ends)
        order = np.lexsort((content, route))
        r, c = route[order], content[order]
        begins = np.concatenate([[True], r[1:] != r[:-1]])
        of = np.cumsum(begins) - 1
        alone = np.bincount(of, np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])) < 2
        same_doc = np.minimum.reduceat(doc[order], np.flatnonzero(begins)) == np.maximum.reduceat(doc[order], np.flatnonzero(begins))
        order = order[~(alone & same_doc)[of]]
        raw, edges = data.tobytes(), np.flatnonzero(np.concatenate([[True], route[order][1:] != route[order][:-1], [True]])) if len(order) else [0]
        sums = np.concatenate([[0], np.cumsum(size[order])])
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(sums[edges], sums[edges[at]] + COLLECTION, "right")) - 1)
            mine = order[edges[at] : edges[to]]
            holder, start = _compare(raw, ends[mine] - size[mine], ends[mine], doc[mine], k, scratch)
            holder, starts = chunk[mine[holder]], place[mine[holder]] + start
            for number in np.unique(holder).tolist():
                own = starts[holder == number]
                yield number, own, own + k
            at = to

    return resolve


def _compare(raw: bytes, start, end, doc, k: int, scratch: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Windows of strings that also lie in a string of a smaller doc: which string, which start."""
    strings = [raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
    distinct = {s: i for i, s in enumerate(dict.fromkeys(strings))}
    which = np.fromiter(map(distinct.__getitem__, strings), np.int64, len(strings))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    with ColumnwiseIndex(list(distinct), scratch) as index:
        string, start, group = index.classes(k)
    lowest = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, least[string])
    # windows of each distinct string, side by side, for every holder of the string
    order = np.argsort(string, kind="stable")
    string, start, found = string[order], start[order], lowest[group[order]]
    edges = np.searchsorted(string, np.arange(len(distinct) + 1))
    count = (edges[1:] - edges[:-1])[which]
    holder = np.repeat(np.arange(len(which)), count)
    window = np.repeat(edges[:-1][which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    gone = found[window] < doc[holder]
    return holder[gone], start[window[gone]]


def _output(chunk, symbols, mask):
    n, removed, spans, digest = [], [], [], []
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        part, own = chunk.data[a:b], mask[a:b]
        n.append(b - a)
        gone = int(np.count_nonzero(own))
        removed.append(gone)
        spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0]) if gone else 0)
        digest.append(hashlib.sha256(part[~own].tobytes() if gone else part.tobytes()).hexdigest())
    return np.array(n, np.int64), np.array(removed, np.int64), np.array(spans, np.int64), anchored.strings(digest)


def scratch_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that Python opens, or none if it isn't mounted."""
    folder = shared_dir(spark)
    return "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith(("file:", "/")) else None


def remove_repeated_bytes(docs: DataFrame, length: int = 50, output=_output, schema: str | None = None, **options) -> DataFrame:
    """Cut each byte covered by a ``length``-byte string that also starts in a smaller doc_id.

    ``docs(doc_id, text)``; texts are UTF-8 bytes, and no string crosses documents. All judgements
    are on the input. Null texts are empty. Rows with a null doc_id are compared with nothing and
    stay whole. Rows that share a doc_id are one document to each other: neither cuts the other.
    An empty table gives no rows; other columns are not read.

    Candidate strings (with their surroundings) meet by minimizer and are compared by
    ``ColumnwiseIndex``, whose files lie in the shared folder if it is a mounted one (else they are held
    in memory, at most ``COLLECTION`` bytes of strings at a time); see ``anchored`` for what is settled
    before that. Long texts are compared whole. ``output`` maps a
    chunk and its mask of cut bytes to the columns after doc_id, as ``schema`` names them.
    """
    if length < GRAM + 2:
        raise ValueError(f"length must be {GRAM + 2} or more")
    scratch = scratch_folder(docs.sparkSession)
    method = anchored.Method(
        length,
        _Bytes,
        _anchors(length),
        _content(length),
        _resolve(length, scratch),
        output,
        schema or "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        {"later": lambda chunk, a, e, least: chunk.ids[a.doc] > least[e.of], "holder": lambda a, e: np.ones(len(a.doc), bool)},
    )
    return anchored.remove_repeats(docs, method, **options)


def _texts(chunk, symbols, mask):
    parts = [chunk.data[a:b][~mask[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
    spans = [[{"start": x, "end": y} for x, y in anchored.runs(mask[a:b])] for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
    return anchored.text_columns(parts, spans)


def kept_texts(docs: DataFrame, length: int = 50, **options) -> DataFrame:
    """The same, as texts: doc_id, what is kept (a cut inside a character leaves U+FFFD), byte spans cut."""
    return remove_repeated_bytes(docs, length, _texts, "doc_id long, text string, removed array<struct<start:long,end:long>>", **options)
