"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_batches

SYMBOLS = b"#*$%&|<>"
STATISTICS = [
    "log_words", "log_bytes", "word_bytes", "upper", "lower", "digit", "non_ascii", "symbol", "bar", "exclamation", "stop", "comma",
    "distinct_words", "distinct_triples", "distinct_lines", "short_words",
]


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.zeros(256, np.int64)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - at), at), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = sum(map(len, words))
    n, size = max(1, len(words)), max(1, letters)
    triples = max(1, len(words) - 2)
    share = lambda chars: sum(int(counts[c]) for c in chars) / size
    return [
        np.log1p(len(words)), np.log1p(len(raw)), letters / n, counts[65:91].sum() / size, counts[97:123].sum() / size,
        counts[48:58].sum() / size, counts[128:].sum() / size, share(SYMBOLS), share(b"|"), share(b"!"), share(b"."), share(b","),
        len(set(words)) / n, len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 1.0,
        len(set(lines)) / max(1, len(lines)) if lines else 1.0, sum(len(w) < 4 for w in words) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth in flat arrays: row t holds tree t, node k has
    children 2k+1 and 2k+2, and values above a node's threshold go right."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Logistic boosting on binned columns; every level is cut by the gain of
    gradient histograms. One class (or no row) gives the smoothed prior."""
    inner = 2**depth - 1
    positive = (float(y.sum()) + 0.5) / (len(y) + 1)
    prior = float(np.log(positive / (1 - positive)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(cut, column, "left") for cut, column in zip(cuts, x.T)])
    raw, made = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, curvature = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = node - first
            best = np.full(width, 1e-6)
            for f, column in enumerate(binned):
                key = slot * bins + column
                g = np.bincount(key, gradient, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, curvature, width * bins).reshape(width, bins).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(h < least / 4) | (rest_h < least / 4)] = -1
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], threshold[first + k] = top[k], f, cuts[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        g, h = np.bincount(slot, gradient, inner + 1), np.bincount(slot, curvature, inner + 1)
        leaf = rate * g / (h + ridge)
        raw += leaf[slot]
        made.append((feature, threshold, leaf))
    return Forest(prior, *map(np.array, zip(*made)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", bound: int = 20_000, **options) -> Forest:
    """A forest fitted on at most ``bound`` labelled documents, those whose ids have
    the smallest hashes.

    Labels other than 0 and 1 and null ids are passed over; an id labelled twice
    counts as 0 if any label is 0; of several rows with one id the smallest
    statistics count. The driver receives at most ``bound`` short rows."""
    small_batches()
    known = (
        labels.select(column(labels, label_id).alias("id"), column(labels, label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(bound)
    )
    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text")).join(F.broadcast(known), "id")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "x": [list(map(float, statistics(t))) for t in frame["text"]]})

    kind = dict(docs.dtypes)[doc_id]
    found = rows.mapInPandas(measured, f"id {kind}, y int, x array<double>").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()
    found.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(STATISTICS))
    return boost(x, np.array([r["y"] for r in found], float), **options)


def scored(forest: Forest, text: Column) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts are scored as empty."""
    small_batches()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch], float).reshape(len(batch), len(STATISTICS))
            yield pd.Series(forest.score(x))

    return score(text)
