"""Secrets in texts: fixed patterns, and values that would cost many guesses."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_slices
from .encoding import vocabulary_path

#: Kinds in the order that ties follow.
KINDS = ("assign", "access", "hex", "guess")
# fixed values: the base patterns, letters of the first in either case
_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "pin")
#: Where a credential may follow: a named field with a separator before six characters of a value, or the password of a URL.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth(?:orization)?|bearer|login|pin)"
    r"[\"']?\s{0,3}(?::=|=>|[:=]|\bis\b|\bist\b|\best\b|\bes\b)\s{0,3}(?:bearer\s|basic\s)?[\"']?(?=[^\s\"',;<>]{6})"
    r"|://[^\s/:@]+:([^\s/@]{4,})@",
    re.IGNORECASE,
)
_VALUE_END = re.compile(r"[\s\"',;<>]|\Z")
#: Words that passwords are commonly made of, commonest first.
COMMON = (
    "password pass admin login welcome letmein qwerty secret monkey dragon master shadow sunshine princess football baseball "
    "summer winter spring autumn monday friday january december hello love god money test guest root user default changeme "
    "iloveyou trustno example sample token key value none null true false required optional string"
).split()
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "yxcvbnm")
_NEXT = {a + b for row in _ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}  # noqa: B905
_LEET = str.maketrans("013457@$!", "oleastasi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:(?:19|20)?\d\d)")


@functools.cache
def ranks() -> dict[str, int]:
    """Words by rank: ``COMMON``, then the whole words of the tokenizer's vocabulary, which lists frequent ones first.

    Whole words are entries of three small letters or more (a-z) that begin after a space.
    """
    with open(vocabulary_path(), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w[1:] for w in sorted(vocabulary, key=vocabulary.get) if re.fullmatch("\u0120[a-z]{3,}", w))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


@functools.cache
def longest() -> int:
    """Characters that a word or a date has at most."""
    return max(10, *map(len, ranks()))


def _class_bits(c: str) -> float:
    return log2(10) if c.isdigit() else log2(26) if c.isalpha() and c.isascii() else log2(33) if c.isascii() else log2(100)


def guess_bits(value: str) -> float:
    """Bits of the cheapest way to guess ``value``: its least-cost cut into pieces.

    Pieces are words (by rank in ``ranks``, with capitals or digits for letters dearer), dates, repeats
    of one character and keyboard walks of any length, and spans tried by brute force. Each piece beyond
    the first adds a bit for the cut. Time is linear in the length: words and dates are no longer than
    ``longest``, and so far before its possible end, or from its beginning, a repeat or walk need not stop,
    as no other piece that begins between could reach beyond it.
    """
    return suffix_bits(value)[0]


def suffix_bits(value: str) -> list[float]:
    """``guess_bits`` of ``value`` from each place on, in one pass from its end; 0 for the empty end."""
    n = len(value)
    whole = [0.0] * (n + 1)  # by where a guess begins
    later = [0.0] * (n + 1)  # the same within a span of brute force: another piece pays for the cut
    after = [0.0] * (n + 1)  # the same after another piece: the next one pays for the cut
    small = value.lower()
    plain = small.translate(_LEET)
    rank_of, piece = ranks(), longest()
    run = walk = n  # where a repeat and a walk from here end at the latest
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            run = run if value[i] == value[i + 1] else i + 1
            walk = walk if small[i : i + 2] in _NEXT else i + 1
        # brute force: one character more, without a cut
        one = _class_bits(value[i])
        brute = one + later[i + 1]
        best = float("inf")
        date = _DATE.match(value, i)
        if date:
            best = after[date.end()] + log2(365 * 120 if date.end() - i > 4 else 120) + 2
        for least, stop, cost in ((3, run, one), (4, walk, log2(47) + 3)):
            if stop - i >= least:
                near = min(stop, i + piece)
                for j in (*range(i + least, near + 1), *range(max(near + 1, stop - piece), stop + 1)):
                    best = min(best, cost + log2(j - i) + after[j])
        for j in range(i + 3, min(n, i + piece) + 1):
            rank = rank_of.get(plain[i:j])
            if rank:
                best = min(best, log2(rank) + 1 + (value[i:j] != small[i:j]) + 2 * (plain[i:j] != small[i:j]) + after[j])
        whole[i] = min(brute, best)
        later[i], after[i] = min(brute, best + 1), whole[i] + 1
    return whole


def context_values(text: str):
    """Start, end and bits of every value in a credential's context, by start.

    A value may hold a context, or end with one, so the search goes on from its start. Values that
    begin in one run of characters end together: the run's end and bits are found once.
    """
    at = first = end = last = 0
    bits: list[float] = []
    while m := CONTEXT.search(text, at):
        if m[1] is not None:
            at = m.start(1)
            value = m[1].rstrip(".)]}")
            yield at, at + len(value), guess_bits(value)
            continue
        at = m.end()
        if at >= end:
            first, end = at, _VALUE_END.search(text, at).start()
            last = first + len(text[first:end].rstrip(".)]}"))
            bits = suffix_bits(text[first:last])
        if at < last:
            yield at, last, bits[at - first]


def find_spans(text: str | None, least_bits: float = 36.0) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind) in code points, by start, then kind as listed.

    Base spans are the leftmost non-overlapping matches of each base pattern without those that
    are too short. A value in a credential's context becomes a ``guess`` span if it takes
    ``least_bits`` or more and is not part of a base span or of a ``guess`` span before it; it may
    go beyond a base span. Null texts have none.
    """
    if not text:
        return []
    small = text.lower()
    found = []
    if any(w in small for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    if any(w in small for w in _STEMS) or ("://" in text and "@" in text):
        base, known, reach = sorted(found), 0, 0
        for start, end, bits in context_values(text):
            while known < len(base) and base[known][0] <= start:
                reach = max(reach, base[known][1])
                known += 1
            if end > reach and bits >= least_bits:
                found.append((start, end, "guess"))
                reach = end
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: The runs of HEX with 32 characters or more: such a run is the same leftmost match.
_LONG_HEX = re.compile("[0-9a-f]{32,}")


def written(spans, kinds=KINDS) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans if kind in kinds)


def redact(text: str | None, least_bits: float = 36.0, mark: str = "[SECRET]") -> str | None:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``; null stays null."""
    out, at = [], 0
    for a, b, _ in find_spans(text, least_bits):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, least_bits: float = 36.0) -> DataFrame:
    """Spans of every document: doc_id, counts by kind, sha256 of the base spans, all spans.

    A row for each row, in no order; null texts count as empty, null doc_ids stay. Other columns
    are not read. No shuffle: each text is searched whole, where it is read.
    """

    def search(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in byte_slices(whole)):
            rows = [find_spans(t, least_bits) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            base = pa.array([hashlib.sha256(written(r, KINDS[:3]).encode()).hexdigest() for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, base, pa.array(map(written, rows), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(search, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, least_bits: float = 36.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``n_chars``, if there, as the new length.

    All other columns pass through unchanged, whatever their names and types.
    """
    names = docs.columns

    def replace(batches):
        import pyarrow as pa

        at = names.index("text")
        for batch in (part for whole in batches for part in byte_slices(whole)):
            texts = [redact(t, least_bits, mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
