"""Token ids by the tokenizers library, with a cache of what lies between spaces."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

from ._common import string_bytes
from .suffix_dedup import byte_hashes

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
_ODD_AFTER = np.zeros(256, bool)
_ODD_AFTER[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: White space but blanks and line feeds, or bytes that may begin some.
_ANY_SPACE = re.compile(rb"[\t-\r\x1c- \xc2\xe1\xe2\xe3]")
_OTHER_SPACE = re.compile(rb"[\t\x0b-\r\x1c-\x1f\xc2\xe1\xe2\xe3]")
_ENCODERS: dict[tuple[str, int], CachedEncoder] = {}


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    """Byte-level BPE by the tokenizers library.

    A byte-level pre-tokenizer starts a token at any space or line feed that a non-space follows, and
    what comes after does not depend on what came before. So a text is cut there, and the library
    encodes each distinct part once while it stays in the cache. Texts with spaces or line feeds
    before other white space or at their end go to the library whole. New parts go to it many in a
    line, apart by line feeds, which are tokens of their own there. ``capacity`` bounds the
    parts of the cache, which keeps one full table beside the one it fills.
    """

    def __init__(self, path: str, capacity: int = 450_000):
        from tokenizers import Tokenizer

        # a task has one core; the library's threads would each keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # each part comes here once while it is cached, so the library's own cache would only cost
        self.tokenizer.model._resize_cache(0)
        self.capacity = capacity
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.rows = 0
        #: The table before this one; what is found there comes over.
        self.old = {}, self.flat, self.starts, self.sizes

    def forget(self) -> None:
        """Empty the cache, the table before this one too."""
        self._clear()
        self._clear()

    def _add(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of the table: ranges of ``ids``."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.rows : self.rows + len(sizes)] = self.used + starts
        self.sizes[self.rows : self.rows + len(sizes)] = sizes
        self.used += len(ids)
        self.rows += len(sizes)

    def _learn_parts(self, parts: list[bytes]) -> None:
        """Encode new parts and remember them."""
        lines: dict[bytes, list[bytes]] = {b" ": [], b"\n": [], b"": []}
        flat = b"".join(parts)
        marks = [p[:1] for p in parts]
        inner = _OTHER_SPACE.search(flat) or flat.count(b" ") + flat.count(b"\n") > marks.count(b" ") + marks.count(b"\n") or len(self.feed) != 1
        for p, mark in zip(parts, marks, strict=True):
            plain = mark in (b" ", b"\n") and len(p) > 1 and not (inner and (len(self.feed) != 1 or _ANY_SPACE.search(p, 1)))
            lines[mark if plain else b""].append(p)
        for mark, some in lines.items():
            width = 50 if mark else 1
            # a line of parts: "\n", " a", "\n", " b", or "\na", "\nb"
            joined = [(b"" if mark != b" " else b"\n") + (b"\n" if mark == b" " else b"").join(some[i : i + width]) for i in range(0, len(some), width)]
            for at in range(0, len(joined), 20_000 // width):
                texts = [x.decode() for x in joined[at : at + 20_000 // width]]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
                own = some[width * at : width * at + width * (20_000 // width)]
                starts = np.cumsum(sizes) - sizes if not mark else np.flatnonzero(flat == np.uint32(self.feed[0]))
                if len(starts) != len(own):
                    raise AssertionError("line feeds did not come out as tokens of their own")
                skip = 1 if mark == b" " else 0
                first = self.rows
                self._add(flat, starts + skip, np.append(starts[1:], len(flat)) - starts - skip)
                self.known.update(zip(own, range(first, first + len(own)), strict=True))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column in a row, and offsets (one more than texts). Null: empty.

        Parts are told apart by 64-bit hashes of their bytes, checked by length and first bytes;
        each distinct one is looked up once a call, by its bytes.
        """
        if self.rows > self.capacity or self.used > 16 * self.capacity:
            old = self.known, self.flat, self.starts, self.sizes
            self._clear()
            self.old = old
        data, offsets = string_bytes(texts)
        begins, ends, first = _parts(data, offsets)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        h = byte_hashes(data, begins, ends)
        _, index, which = np.unique(h, return_index=True, return_inverse=True)
        start8 = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), 0, (1,))[begins]
        size = ends - begins
        if not ((size == size[index][which]) & ((start8 == start8[index][which]) | (size < 8))).all():
            index = which = np.arange(len(begins))  # two parts share a hash: look all up
        raw, known = data.tobytes(), self.known
        parts = [raw[x:y] for x, y in zip(begins[index].tolist(), ends[index].tolist(), strict=True)]
        found = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        lost = np.flatnonzero(found < 0).tolist()
        if lost:
            new = [parts[i] for i in lost]
            was, flat, starts, lengths = self.old
            again = [p for p in new if p in was]
            if again:
                rows = np.fromiter(map(was.__getitem__, again), np.int64, len(again))
                n = lengths[rows]
                at = np.cumsum(n) - n
                known.update(zip(again, range(self.rows, self.rows + len(again)), strict=True))
                self._add(flat[np.repeat(starts[rows] - at, n) + np.arange(int(n.sum()))], at, n)
                new = [p for p in new if p not in was]
            if new:
                self._learn_parts(list(dict.fromkeys(new)))
            found[lost] = np.fromiter((known[parts[i]] for i in lost), np.int64, len(lost))
        rows = found[which]
        sizes = self.sizes[rows]
        to = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[rows] - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)]
        return ids, np.concatenate([[0], to])[first]


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of all texts: where they begin and end, and how many lie before each text.

    Cuts lie before blanks and line feeds. A text where one of them is followed by white space (or
    by a byte that may begin some beyond ASCII), or stands at its end, is one part.
    """
    n = len(data)
    blank = np.flatnonzero((data == 32) | (data == 10))
    doc = np.searchsorted(offsets, blank, "right") - 1
    after = data[np.minimum(blank + 1, max(n - 1, 0))]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[doc[_ODD_AFTER[after] | (blank + 1 >= offsets[doc + 1])]] = True
    cuts = blank[~odd[doc] & (blank > offsets[doc])]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = np.sort(np.concatenate([heads, cuts]))
    ends = np.append(begins[1:], n)[: len(begins)]
    return begins, ends, np.searchsorted(begins, offsets)


def encoder(path: str, capacity: int = 450_000) -> CachedEncoder:
    """The worker process's encoder for a vocabulary file."""
    if (path, capacity) not in _ENCODERS:
        _ENCODERS[path, capacity] = CachedEncoder(path, capacity)
    return _ENCODERS[path, capacity]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))
