"""Repeated word windows through difference-cover anchors."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import anchored
from ._common import mix
from .suffix_dedup import _RANDOM_2, RangeHash, byte_hashes

#: Perfect difference covers: every difference modulo the period is one of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a chunk: byte ranges, 64-bit hashes, and the documents' offsets in words."""

    def __init__(self, chunk):
        data, offsets = chunk.data, chunk.offsets
        inside = ~_WHITE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = byte_hashes(data, self.start, self.end)
        self._data = data

    @functools.cached_property
    def second(self) -> np.ndarray:
        """Hashes of the words that are independent of the first ones."""
        return byte_hashes(self._data, self.start, self.end, _RANDOM_2)


def _anchors(k: int, period: int):
    gram = k - period + 1
    reach, half = period - 1, (period - 1 + 1) // 2

    def find(chunk, words) -> anchored.Anchors:
        n, bounds = len(words.start), words.bounds
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(n) - bounds[:-1][doc]
        cover = np.zeros(period, bool)
        cover[list(COVERS[period])] = True
        long_enough = (sizes[doc] >= k) & chunk.known[doc]
        p = np.flatnonzero(cover[within % period] & (within + gram <= sizes[doc]) & long_enough)
        d = doc[p]
        low, high = bounds[:-1][d], bounds[1:][d]
        ranges = RangeHash(words.hash)
        from_, to = np.maximum(low, p - reach), np.minimum(high, p + gram + reach)
        place = ((p - from_) * 64 + (to - p)).astype(np.uint64)
        context = mix(RangeHash(words.second)(from_, to), place)
        sides = []
        for has, x, y in ((p - half >= low, p - half, p), (p + gram + half <= high, p + gram, p + gram + half)):
            side = np.zeros(len(p), np.uint16)
            side[has] = (ranges(x[has], y[has]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
            sides.append(side)
        return anchored.Anchors(ranges(p, p + gram), context, *sides, p, d, from_, np.minimum(p, high - k))

    return find


def _content(k: int):
    """Every placement of the window around a chosen anchor, by its hash."""

    def make(chunk, words, a, chosen, sides):
        count = a.last[chosen] - a.first[chosen] + 1
        at = np.unique(np.repeat(a.first[chosen] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
        h, g = (RangeHash(x)(at, at + k) for x in (words.hash, words.second))
        # of equal windows of a chunk the first alone goes on; two hashes tell windows apart
        order = np.lexsort((g, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        gone, at, h, g = at[later], at[~later], h[~later], g[~later]
        doc = chunk.ids[np.searchsorted(words.bounds, at, "right") - 1]

        def payload(which, number):
            docs, place = np.unique(doc[which], return_inverse=True)
            return anchored.pack_arrays(np.array([number]), h[which], docs, place.astype(np.uint32), at[which].astype(np.uint32), g[which])

        return h, payload, gone, gone + k

    return make


def _resolve(k: int):
    def resolve(payloads):
        if not payloads:
            return
        parts = [anchored.unpack_arrays(p) for p in payloads]
        chunk = np.concatenate([np.repeat(p[0], len(p[1])) for p in parts])
        h, at, g = (np.concatenate([p[i] for p in parts]) for i in (1, 4, 5))
        doc, at = np.concatenate([p[2][p[3]] for p in parts]), at.astype(np.int64)
        order = np.lexsort((at, doc, g, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        for number in np.unique(chunk[later]).tolist():
            mine = at[later & (chunk == number)]
            yield number, mine, mine + k

    return resolve


def _kept(chunk, words, mask):
    raw = chunk.data.tobytes()
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        keep = np.flatnonzero(~mask[a:b]) + a
        yield b - a, b - a - len(keep), b" ".join([raw[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])


def _output(chunk, words, mask):
    rows = [(n, gone, hashlib.sha256(text).hexdigest()) for n, gone, text in _kept(chunk, words, mask)]
    n, gone, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(n, np.int64), np.array(gone, np.int64), anchored.strings(digest)


def _texts(chunk, words, mask):
    spans = [[{"start": x, "end": y} for x, y in anchored.runs(mask[a:b])] for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
    return anchored.text_columns([text.decode() for _, _, text in _kept(chunk, words, mask)], spans)


def remove_repeated_words(docs: DataFrame, length: int = 20, period: int = 13, output=_output, schema: str | None = None, **options) -> DataFrame:
    """Cut each word covered by a ``length``-word window that also starts earlier.

    Earlier is a smaller doc_id, or the same and an earlier start. Windows of one document only, and
    all judgements are on the input. Anchors of ``length - period + 1`` words are hashed at the
    places whose index modulo ``period`` is in a difference cover: of two equal windows one such
    place is the same in both. An anchor extends by ``period - 1`` words to each side; see
    ``anchored``. Null texts have no words. Rows with a null doc_id are compared with nothing and
    stay whole. Rows that share a doc_id count as parts of one document, in the order of their
    texts. Long texts are compared whole. Empty tables give no rows; other columns are not read.
    Equal words, contexts and windows are told apart by two independent hashes, 128 bits in all for windows.
    """
    if period not in COVERS or length < period + 1:
        raise ValueError(f"period must be one of {sorted(COVERS)} and under length")
    method = anchored.Method(
        length,
        Words,
        _anchors(length, period),
        _content(length),
        _resolve(length),
        output,
        schema or "doc_id long, n_words long, n_removed long, kept_sha256 string",
        {"later": lambda chunk, a, e, least: (chunk.ids[a.doc] > least[e.of]) | (e.anchor[e.of] != np.arange(len(a.doc))), "holder": lambda a, e: e.anchor[e.of] == np.arange(len(a.doc))},
    )
    return anchored.remove_repeats(docs, method, **options)


def kept_words(docs: DataFrame, length: int = 20, **options) -> DataFrame:
    """The same, as texts: doc_id, the words kept joined by a space, and the word spans cut."""
    return remove_repeated_words(docs, length, output=_texts, schema="doc_id long, text string, removed array<struct<start:long,end:long>>", **options)
