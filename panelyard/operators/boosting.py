"""Boosted regression trees over histograms, fitted by one task, for training rows that one task holds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node: its tree, the feature that divides it (-1: a leaf), the last value that goes left, its children, its mean.
NODE = "tree int, feature int, threshold double, low int, high int, value double"
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def thresholds(x: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` places to divide a feature: between all its values, or at quantiles by weight, as in MLlib."""
    values, of = np.unique(x, return_inverse=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    sums = np.cumsum(np.bincount(of, weight))
    out, stride = [], sums[-1] / bins
    target = stride
    for i in range(1, len(values)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[: bins - 1])


def grow(binned: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int, depth: int, features: int, rng) -> list[list]:
    """One tree, level by level: nodes as (feature, bin, left, right, mean), the root first.

    Splits take the greatest loss of squared error; each node draws ``features`` of all features.
    """
    n, width = binned.shape
    node, nodes, level = np.zeros(n, np.int64), [[-1, 0, 0, 0, float(np.average(y, weights=weight))]], np.array([0])
    rows = np.arange(n)
    for _ in range(depth):
        k = len(level)
        cell = (node[:, None] * width + np.arange(width)) * bins + binned[rows]
        shape, flat, w = (k, width, bins), cell.ravel(), weight[rows]
        count, total, sums = (
            np.bincount(flat, None if v is None else np.repeat(v, width), k * width * bins).reshape(shape).cumsum(2) for v in (None, w, w * y[rows])
        )
        all_n, all_w, all_s = count[:, :, -1:], total[:, :, -1:], sums[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / total + (all_s - sums) ** 2 / (all_w - total) - all_s**2 / all_w
        open_ = (count > 0) & (count < all_n)
        if features < width:
            drawn = rng.random((k, width)).argsort(1)[:, :features]
            open_ &= np.isin(np.arange(k * width).reshape(k, width), drawn + np.arange(k)[:, None] * width)[:, :, None]
        # differences that rounding makes are no gain
        least = 1e-12 * np.bincount(node, w * y[rows] ** 2, k)
        gain = np.where(open_, gain, -1.0).reshape(k, -1)
        best = gain.argmax(1)
        split = np.flatnonzero(gain[np.arange(k), best] > least)
        if not len(split):
            break
        feature, at = np.divmod(best, bins)
        children = np.full(k, -1)
        following = []
        for i, j in enumerate(split.tolist()):
            f, b = int(feature[j]), int(at[j])
            wl, sl, w_, s_ = total[j, f, b], sums[j, f, b], all_w[j, f, 0], all_s[j, f, 0]
            nodes[level[j]][:4] = f, b, len(nodes), len(nodes) + 1
            following += [len(nodes), len(nodes) + 1]
            nodes += [[-1, 0, 0, 0, float(sl / wl)], [-1, 0, 0, 0, float((s_ - sl) / (w_ - wl))]]
            children[j] = 2 * i
        on = children[node] >= 0
        rows, node = rows[on], node[on]
        node = children[node] + (binned[rows, feature[node]] > at[node])
        level = np.array(following)
    return nodes


@dataclass
class Trees:
    """Fitted trees, one node after another; a prediction is the first tree's value and ``rate`` times those of the others."""

    nodes: dict[str, np.ndarray]
    rate: float
    name: str = "prediction"

    @property
    def trees(self) -> int:
        return int(self.nodes["tree"].max()) + 1

    def setPredictionCol(self, name: str) -> Trees:  # noqa: N802  as MLlib's models have it
        return Trees(self.nodes, self.rate, name)

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, low, high, value = (self.nodes[c] for c in _NAMES[1:])
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for t, root in enumerate(np.flatnonzero(np.diff(self.nodes["tree"], prepend=-1)).tolist()):
            at = np.full(len(x), root)
            while (inner := feature[at] >= 0).any():
                f = np.where(inner, feature[at], 0)
                at = np.where(inner, np.where(x[rows, f] <= threshold[at], low[at], high[at]), at)
            out += value[at] * (self.rate if t else 1.0)
        return out

    def score(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """``rows`` and their predictions; null or NaN features raise."""
        predict = self.predict

        @F.arrow_udf("double")
        def of(*columns):
            import pyarrow as pa

            return pa.array(predict(matrix(columns)))

        return rows.withColumn(self.name, of(*(F.col(f).cast("double") for f in features)))


def matrix(columns) -> np.ndarray:
    if any(c.null_count for c in columns):
        raise ValueError("a feature is null")
    out = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
    if np.isnan(out).any():
        raise ValueError("a feature is NaN")
    return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float, bins: int, share: float, features: int, seed: int) -> dict[str, np.ndarray]:
    """Nodes of ``rounds`` trees on squared error, each on a draw of ``share`` of the rows.

    As in MLlib, the first tree fits the label and counts in full, the others fit the gradient, which is
    twice the residual, and count ``rate``. The order of the rows does not matter.
    """
    order = np.lexsort((weight, y, *x.T))
    x, y, weight = x[order], y[order], weight[order]
    rng, out = np.random.default_rng(seed), []
    edges = [thresholds(c, weight, bins) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    fitted = np.zeros(len(y))
    for t in range(rounds):
        own = np.flatnonzero(rng.random(len(y)) < share) if share < 1 else np.arange(len(y))
        if not len(own):
            own = np.arange(len(y))
        nodes = grow(binned[own], (2 if t else 1) * (y - fitted)[own], weight[own], bins, depth, features, rng)
        first = len(out)
        out += [(t, f, float(edges[f][b]) if f >= 0 else 0.0, first + low, first + high, v) for f, b, low, high, v in nodes]
        grown = {c: np.array(v) for c, v in zip(_NAMES, zip(*((0, f, b, low, high, v) for f, b, low, high, v in nodes), strict=True), strict=True)}
        fitted += Trees(grown, rate).predict(binned) * (rate if t else 1.0)
    return {c: np.array(v) for c, v in zip(_NAMES, zip(*out, strict=True), strict=True)}


def fit(rows: DataFrame, features: list[str], label: str, weight: str | None, rounds: int, depth: int, seed: int, stepSize: float, maxBins: int, subsamplingRate: float = 1.0, featureSubsetStrategy: str = "all") -> Trees:  # noqa: N803
    """Trees over all ``rows``, which go to one task; only the nodes reach the driver. No rows raise."""
    share = 1.0 if featureSubsetStrategy in ("all", "auto") else float(featureSubsetStrategy)
    drawn = max(1, min(len(features), math.ceil(share * len(features))))

    def run(batches):
        import pyarrow as pa

        parts = [b for b in batches if b.num_rows]
        if not parts:
            raise ValueError("no training rows")
        table = pa.Table.from_batches(parts)
        x, y, w = matrix([table.column(i) for i in range(len(features))]), *(table.column(len(features) + i).to_numpy().astype(float) for i in (0, 1))
        if not (np.isfinite(y).all() and (w > 0).all()):
            raise ValueError("labels must be finite and weights positive")
        nodes = boost(x, y, w, rounds, depth, stepSize, maxBins, subsamplingRate, drawn, seed)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[c], t) for c, t in zip(_NAMES, (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=_NAMES)

    own = [*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")]
    table = rows.select(*own).coalesce(1).mapInArrow(run, NODE).toArrow()
    return Trees({c: table.column(c).to_numpy() for c in _NAMES}, stepSize)
