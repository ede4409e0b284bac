"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import byte_slices, cut

# fixed values: pronouns of the second person in the corpus's languages
YOU = frozenset("you your yours yourself u du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta vous votre vos tú ti tuyo usted vosotros vuestro".split())
# fixed values: common insults, beside what the labels teach
INSULTS = frozenset("idiot moron stupid dumb trash scum loser pathetic worthless disgusting clown garbage filth vermin imbecile".split())
_MARKS = ".,;:!?\"'()[]{}«»“”„¡¿|*#$%&<>-_…"
_LEET = str.maketrans("013457@$!|", "oieastasil")
_MASKED = re.compile(r"(?<![^\s])[^\W\d_]+[*@$!0-9][\w*@$!]*[^\W\d_]")
STEMS = (4, 5, 6, 7)
FEATURES = ("hits", "log_hits", "stem_hits", "log_stem_hits", "weight", "near_you", "you", "capitals", "shouting", "punctuation", "masked", "masked_hits", "log_words")


@dataclass
class Lexicon:
    """Words and word beginnings with their log-odds."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        self.heads = {w[:4] for w in self.words} | {s[:4] for s in self.stems}

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        return max(found, *(self.stems.get(word[:n], 0.0) for n in STEMS))


def tokens(text: str | None) -> list[str]:
    """Words in small letters, without marks around them."""
    return [w.strip(_MARKS) for w in text.lower().split()] if text else []


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text, as FEATURES names them; null counts as empty."""
    text = text or ""
    words, n = tokens(text), 0
    hits, stem_hits, weight, near, you, places = 0, 0, 0.0, 0, 0, []
    heads = lexicon.heads
    for i, w in enumerate(words):
        if w[:4] in heads:
            found = lexicon.weight(w)
            if found:
                hits += w in lexicon.words
                stem_hits += 1
                weight += found
                places.append(i)
    n = max(1, len(words))
    you_at = [i for i, w in enumerate(words) if w in YOU]
    you = len(you_at)
    if places and you_at:
        at = np.searchsorted(you_at, places)
        left = np.abs(np.array(places) - np.array([-(10**9), *you_at])[at])
        right = np.abs(np.array([*you_at, 10**9])[at] - np.array(places))
        near = int((np.minimum(left, right) <= 3).sum())
    masked = _MASKED.findall(text)
    masked_hits = sum(lexicon.weight(m.lower().translate(_LEET)) > 0 for m in masked)
    letters = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    capitals, small = int(letters[65:91].sum()), int(letters[97:123].sum())
    shouting = sum(w.isupper() and len(w) > 2 for w in text.split()) if capitals * 20 > small else 0
    marks = int(letters[33] + letters[63])
    return [hits / n, math.log1p(hits), stem_hits / n, math.log1p(stem_hits), weight / n, near / n, you / n, capitals / max(1, capitals + small), shouting / n, marks / n, len(masked) / n, math.log1p(masked_hits), math.log1p(n)]


class Trees:
    """Boosted regression trees for the logistic loss, over values in bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 0.5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = self._bin(x)
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.start, self.trees = math.log(share / (1 - share)), []
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = y - p, p * (1 - p)
            feature, cutoff = np.zeros(2**self.depth, int), np.full(2**self.depth, self.bins + 1)
            node = np.ones(n, int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    inside = np.flatnonzero(node == k)
                    best = (1e-6, 0, self.bins + 1)
                    total, heavy = gradient[inside].sum(), curve[inside].sum()
                    for j in range(width):
                        g = np.cumsum(np.bincount(binned[inside, j], gradient[inside], self.bins + 1))[:-1]
                        h = np.cumsum(np.bincount(binned[inside, j], curve[inside], self.bins + 1))[:-1]
                        gain = g**2 / (h + self.ridge) + (total - g) ** 2 / (heavy - h + self.ridge) - total**2 / (heavy + self.ridge)
                        gain[(h < self.least) | (heavy - h < self.least)] = 0
                        b = int(np.argmax(gain))
                        if gain[b] > best[0]:
                            best = (float(gain[b]), j, b)
                    feature[k], cutoff[k] = best[1:]
                node = 2 * node + (binned[np.arange(n), feature[node]] > cutoff[node])
            leaf = node - 2**self.depth
            value = self.rate * np.bincount(leaf, gradient, 2**self.depth) / (np.bincount(leaf, curve, 2**self.depth) + self.ridge)
            self.trees.append((feature, cutoff, value))
            score += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.start)
        for feature, cutoff, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (binned[np.arange(len(x)), feature[node]] > cutoff[node])
            out += value[node - 2**self.depth]
        return out


class Isotonic:
    """Monotone steps from scores to shares, by pooling adjacent violators; linear in between."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1, s, s])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
                v, c, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + c, blocks[-1][2], high]
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        # half a case of each kind keeps the outer steps off 0 and 1
        self.y = np.repeat([(b[0] + 0.5 * share) / (b[1] + 0.5) for b in blocks for share in [float(y.mean())]], 2)
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) + 1e-6 / (1 + np.exp(-score)) * (1 - np.interp(score, self.x, self.y))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    scale: Isotonic | None
    share: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts or self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(self.scale(self.trees.score(np.array([features(t, self.lexicon) for t in texts]))), 0.0, 1.0)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text. Remainder 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, least_docs: int = 5) -> Model:
    """Learn from labelled documents that are not held out.

    At most about ``max_rows`` labelled rows (a hash of doc_id picks them) take part; folds 1 and 2
    teach the lexicon (executors count terms; all that ``least_docs`` toxic documents hold, with
    log-odds over 2, come to the driver: the bound on rows bounds them), fold 3 the trees, fold 4 the calibration. Only counts and
    features reach the driver. Null labels don't count; with a single class the score is its share.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)")
    usable = usable.where(fold("label_id") > 0)
    count = usable.count()
    if count > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    # max_rows of two small numbers each: bounded
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = cut(rows.join(F.broadcast(usable), F.col("doc_id") == F.col("label_id")).select("text", "toxic", fold().alias("fold")))
    sizes = {r["toxic"]: r["n"] for r in sample.where("fold in (1, 2)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def terms(batches):
        import pyarrow as pa

        def flushed(seen):
            for toxic, counts in seen.items():
                for at in range(0, len(items := list(counts.items())), 50_000):
                    part = items[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"term": [t for t, _ in part], "toxic": pa.array([toxic] * len(part), pa.int32()), "n": pa.array([n for _, n in part], pa.int64())})
                counts.clear()

        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in (part for whole in batches for part in byte_slices(whole)):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in tokens(text) if len(w) > 2}
                seen[toxic].update({f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n})
                if sum(map(len, seen.values())) > 500_000:
                    yield from flushed(seen)
        yield from flushed(seen)

    counted = sample.where("fold in (1, 2)").select("text", "toxic").mapInArrow(terms, "term string, toxic int, n long")
    sums = counted.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("q") + 0.5) / (sizes.get(0, 0) + 1))
    found = sums.where(F.col("p") >= least_docs).withColumn("odds", odds).where("odds > 2").select("term", "odds").collect()
    lexicon = Lexicon({w: 2.0 for w in INSULTS} | {r.term[1:]: r.odds for r in found if r.term[0] == "w"}, {r.term[1:]: r.odds for r in found if r.term[0] == "s"})

    def measured(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in byte_slices(whole)):
            values = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column("toxic"), batch.column("fold").cast(pa.int64())], names=["x", "toxic", "fold"])

    taught = sample.where("fold in (3, 4)").mapInArrow(measured, "x array<double>, toxic int, fold long").collect()
    taught = sorted((r.fold, r.x, r.toxic) for r in taught)
    x, y, f = np.array([r[1] for r in taught]).reshape(-1, len(FEATURES)), np.array([r[2] for r in taught], float), np.array([r[0] for r in taught])
    if not len(y) or len(set(y[f == 3])) < 2 or not (f == 4).any():
        total = sum(sizes.values())
        return Model(lexicon, None, None, sizes.get(1, 0) / total if total else 0.0)
    trees = Trees().fit(x[f == 3], y[f == 3])
    return Model(lexicon, trees, Isotonic().fit(trees.score(x[f == 4]), y[f == 4]), float(y.mean()))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Toxicity of each document: doc_id, held_out, score, predicted (1 from score 0.5 on).

    A row for each row; every whole text is scored, null texts as empty. Labels, lang, source and
    doc_id are no inputs of the score. Other columns are not read. Scoring shuffles nothing.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.value(part.column("text").to_pylist()))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch, 2 << 20):
                yield part.filter(pa.array(model.value(part.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
