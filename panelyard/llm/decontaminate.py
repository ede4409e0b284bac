"""Benchmark passages in documents: q-gram lemma in diagonal bands, then banded alignment."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_slices, string_bytes

#: Greatest q; items for which it proves too little get a smaller one.
Q = 10
#: q-grams that an occurrence must share at least, where an item may have edits.
LEAST = 4
#: Bytes of index for each byte of items: a gram's code, item, place and first place, and up to 128 cells.
INDEX_BYTES = 152
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
FAR = 1 << 30


def _codes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of each ``q``-gram, q up to ``Q``; grams of 8 bytes and fewer are their own codes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), 0, (1,))
    if q <= 8:
        return eight[:n] & np.uint64((1 << 8 * q) - 1)
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[q - 8 :][:n]


def _cells(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_size(size: int, edits: int) -> int:
    """The greatest q, ``Q`` at most, of which an occurrence within ``edits`` shares enough grams.

    Each edit spoils q grams, so ``size`` - q + 1 - q * ``edits`` are left. Items without edits are
    searched word for word: any of their grams must be there.
    """
    if not edits:
        return min(Q, size)
    return next((q for q in range(Q, 0, -1) if size - q + 1 - q * edits >= LEAST), 1)


def gram_sizes(texts: list[np.ndarray], rate: float, common: int) -> list[int]:
    """A q for each item: the greatest by which its own grams alone prove an occurrence.

    Own grams are those that fewer than ``common`` items hold; with a smaller q each edit spoils fewer.
    Items that are like many others at every q get what ``gram_size`` says.
    """
    out = [gram_size(len(t), int(rate * len(t))) for t in texts]
    open_ = [i for i, t in enumerate(texts) if int(rate * len(t))]
    for q in range(Q, 3, -1):
        if not open_:
            break
        codes = [np.unique(_codes(texts[i], q)) for i in open_]
        grams, held = np.unique(np.concatenate(codes), return_counts=True)
        rare = grams[held < common]
        left = []
        for i in open_:
            own = _codes(texts[i], q)
            at = np.minimum(np.searchsorted(rare, own), max(0, len(rare) - 1))
            if len(rare) and int((rare[at] == own).sum()) - q * int(rate * len(texts[i])) >= LEAST:
                out[i] = q
            else:
                left.append(i)
        open_ = left
    return out


class GramIndex:
    """q-grams of benchmark items: where each lies, and how many an occurrence must share.

    An occurrence of an item of length L within e edits shares at least L - q + 1 - q * e of its
    q-grams, and of any R chosen ones R - q * e. e is ``rate`` of L. Grams that ``common`` items or
    more hold are left out, commonest first, while the rest proves an occurrence.
    """

    def __init__(self, items: list[tuple[list, np.ndarray]], q: int, rate: float, common: int):
        self.q, self.items = q, items
        size = np.array([len(t) for _, t in items], np.int64)
        self.edits = (rate * size).astype(np.int64)
        codes = [_codes(t, q) for _, t in items]
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c), dtype=np.int32) for c in codes), np.zeros(0, np.int32)])
        # how many places hold each gram, and each gram's turn in its item, rarest first
        _, which, held = np.unique(flat, return_inverse=True, return_counts=True)
        held = held[which]
        order = np.lexsort((place, held, item))
        turn = np.empty(len(flat), np.int64)
        turn[order] = np.arange(len(flat)) - np.repeat(np.cumsum([0, *map(len, codes)])[:-1], [len(c) for c in codes])
        need = q * self.edits + LEAST
        keep = (held < common) | (turn < need[item])
        flat, item, place = flat[keep], item[keep], place[keep]
        self.shared = np.maximum(1, np.bincount(item, minlength=len(items)) - q * self.edits)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int32)
        self.bits = (64 * len(self.grams) + 1).bit_length()  # one cell in 64 or fewer is taken
        self.table = np.zeros(1 << self.bits, bool)
        self.table[_cells(self.grams, self.bits)] = True

    def regions(self, data: np.ndarray, offsets: np.ndarray):
        """(document, item, least diagonal, greatest diagonal) of bands that share enough q-grams.

        Bands are as wide as twice an item's edits and overlap by half, so the diagonals of any
        occurrence within its edits lie in one of them.
        """
        if not len(self.grams):
            return
        codes = _codes(data, self.q)
        at = np.flatnonzero(self.table[_cells(codes, self.bits)])
        row = np.searchsorted(self.grams, codes[at])
        good = self.grams[np.minimum(row, len(self.grams) - 1)] == codes[at]
        at, row = at[good], row[good]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[doc + 1]
        at, row, doc = at[inside], row[inside], doc[inside]
        count = (self.first[row + 1] - self.first[row]).astype(np.int64)
        which = np.repeat(self.first[row] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, doc, at = self.item[which], np.repeat(doc, count), np.repeat(at, count)
        diagonal = at - offsets[doc] - self.place[which] + FAR
        half = self.edits[item] + 1
        found = set()
        for shift in (0, 1):
            band = (diagonal // half + shift) // 2
            order = np.lexsort((band, item, doc))
            d, i, b = doc[order], item[order], band[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])) if len(d) else np.zeros(0, np.int64)
            many = np.diff(np.append(new, len(d))) >= self.shared[i[new]]
            for x in new[many].tolist():
                low = (2 * int(b[x]) - shift) * int(self.edits[i[x]] + 1) - FAR
                found.add((int(d[x]), int(i[x]), low, low + 2 * int(self.edits[i[x]] + 1) - 1))
        yield from sorted(found)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best occurrence (edits, start, end) of each (document, item) within the item's edits; ``data`` is folded."""
        out = {}
        for doc, i, low, high in self.regions(data, offsets):
            text = data[offsets[doc] : offsets[doc + 1]]
            if not enough(self.items[i][1], text, low, high, int(self.edits[i])):
                continue
            best = banded(self.items[i][1], text, low, high, int(self.edits[i]))
            if best and ((doc, i) not in out or best < out[doc, i]):
                out[doc, i] = best
        return out


def enough(pattern: np.ndarray, text: np.ndarray, low: int, high: int, edits: int, q: int = 4) -> bool:
    """The lemma once more, with ``q`` small, on the diagonals of a region: most of them fail it before any alignment."""
    need = len(pattern) - q + 1 - q * edits
    if need < LEAST or not edits:
        return True
    window = text[max(0, low) : high + len(pattern)]
    codes = np.zeros(len(pattern) - q + 1 + high - low, np.uint64)
    found = _codes(window, q)
    shift = max(0, low) - low
    found = found[: max(0, len(codes) - shift)]
    codes[shift : shift + len(found)] = found
    seen = np.lib.stride_tricks.sliding_window_view(codes, high - low + 1)
    return int((seen == _codes(pattern, q)[:, None]).any(1).sum()) >= need


class Benchmark:
    """All items of a block: equal ones (folded) once, an index for each q that they call for."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float, common: int = 8):
        ids: dict[bytes, list] = {}
        for i, t in items:
            ids.setdefault(_FOLD[np.frombuffer(t, np.uint8)].tobytes(), []).append(i)
        texts = [np.frombuffer(t, np.uint8) for t in ids if t]
        by_q: dict[int, list] = {}
        for q, text in zip(gram_sizes(texts, rate, common), texts, strict=True):
            by_q.setdefault(q, []).append((ids[text.tobytes()], text))
        self.parts = [GramIndex(some, q, rate, common) for q, some in sorted(by_q.items())]

    def matches(self, column) -> list[tuple]:
        """(row, item_id, edits, start, end) of every item that a row of an Arrow string column holds."""
        data, offsets = string_bytes(column)
        data = _FOLD[data]
        return [(doc, i, *best) for part in self.parts for (doc, k), best in part.matches(data, offsets).items() for i in part.items[k][0]]


_BUILT: dict[str, Benchmark] = {}


def _built(key: str, rate: float, block) -> Benchmark:
    """The index of a block, built once in each Python worker: only texts are sent."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Benchmark(block.value, rate)
    return _BUILT[key]


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``pattern`` in ``text`` on diagonals low..high.

    The start is free on these diagonals, and paths may leave them by ``edits`` to either side.
    Ties go to the leftmost end. None if more than ``edits`` are needed.
    """
    window = text[max(0, low) : high + len(pattern)].tobytes()
    exact = window.find(pattern.tobytes())
    if exact >= 0:
        return 0, max(0, low) + exact, max(0, low) + exact + len(pattern)
    left, width = low - edits, high - low + 1 + 2 * edits
    big, step = 1 << 20, np.arange(width)
    start = left + step  # text position of each cell in row 0
    cost = np.where((start >= max(0, low)) & (start <= min(len(text), high)), 0, big)
    origin = start.copy()
    for r in range(1, len(pattern) + 1):
        place = left + step + r  # text position after this row
        usable = (place >= 1) & (place <= len(text))
        letter = np.zeros(width, np.int64)
        letter[usable] = text[place[usable] - 1]
        diagonal = np.where(usable, cost + (letter != pattern[r - 1]), big)
        down = np.append(cost[1:] + 1, big)  # a letter of the pattern without one of the text
        take = down < diagonal
        row, source = np.where(take, down, diagonal), np.where(take, np.append(origin[1:], 0), origin)
        row = np.where((place >= 0) & (place <= len(text)), row, big)
        # letters of the text without one of the pattern: running minima along the row
        packed = ((row - step) << 32) + step
        least = np.minimum.accumulate(packed)
        origin = source[least & 0xFFFFFFFF]
        cost = np.minimum((least >> 32) + step, big)
        if cost.min() > edits:
            return None
    cell = int(np.argmin(cost))
    return (int(cost[cell]), int(origin[cell]), left + cell + len(pattern)) if cost[cell] <= edits else None


def _blocks(benchmark: DataFrame, rate: float, block_bytes: int):
    """Items in blocks whose index has at most ``block_bytes``, each as a function from text columns to matches."""
    texts = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text <> ''")
    total = INDEX_BYTES * (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    blocks = -(-total // block_bytes) * (2 if total > block_bytes else 1) or 1
    context = benchmark.sparkSession.sparkContext
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        sent = context.broadcast([(r.item_id, r.text.encode()) for r in part.collect()])
        yield lambda column, sent=sent, key=uuid.uuid4().hex: _built(key, rate, sent).matches(column)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 64 << 20) -> DataFrame:
    """Benchmark items that occur in documents: doc_id, item_id, edits, start, end.

    An item occurs if a part of the text is within ``rate`` of its length in edits (of UTF-8 bytes,
    A-Z lower-cased, each white space a blank; rounded down, so items under 13 bytes occur word for
    word only). One row for each document and item, with the best place, in bytes; of equally
    good places the leftmost. Items of any length are found, short ones by shorter q-grams. Null or empty
    texts and items have none; repeated rows of either table each count; null ids stay null. Long texts
    are searched whole. Empty tables give no rows; other columns are not read.

    The items' texts go to all tasks in blocks whose index has ``block_bytes`` at most (an item is
    never divided), so its size is bounded; more items mean more passes over the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, edits int, start long, end long"
    out = None
    for matches in _blocks(benchmark, rate, block_bytes):

        def search(batches, matches=matches):
            import pyarrow as pa

            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            for batch in batches:
                for some in byte_slices(batch, 2 << 20):
                    ids = some.column("doc_id").to_pylist()
                    found = [(ids[d], *rest) for d, *rest in matches(some.column("text"))]
                    columns = list(zip(*found, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item (see ``find_leaks``), all columns as they are.

    Each row is judged by its own text, where it is read: ids, null or repeated, play no part, and
    nothing is shuffled. Rows with a null or empty text stay.
    """
    names = docs.columns
    for matches in _blocks(benchmark, rate, block_bytes):

        def clean(batches, matches=matches):
            import pyarrow as pa

            for batch in batches:
                for some in byte_slices(batch, 2 << 20):
                    keep = np.ones(some.num_rows, bool)
                    keep[[d for d, *_ in matches(some.column(names.index("text")))]] = False
                    yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
