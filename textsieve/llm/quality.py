"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic
regression.

The cosines of random projections approximate a Gaussian kernel. Each task sums its rows' products of features; the sums
of all tasks are the normal equations of the ridge fit, a matrix of fixed size. Scores of rows that the fit has not seen
are then put in order of outcome by pooling adjacent violators over a fixed number of score bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Of statistics(), in order.
STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "letters", "digits", "spaces", "upper",
    "marks", "symbols", "non_ascii", "shouted", "odd_ends", "long_words", "lines", "repeated_lines", "repeated_pairs",
)


def statistics(text: str) -> list[float]:
    """Of a whole text; shares lie from 0 to 1. An empty text gives zeros."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KIND[data], minlength=7) / len(data)
    n, counts = len(words), Counter(words)
    ends = Counter(w[-1] for w in words)
    odd = sum(k for c, k in ends.items() if not (c.isalnum() or c in ".,:;?!'\")"))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    shouted = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(text)), np.log1p(n), (len(text) - n + 1) / n, len(counts) / n**0.9, max(counts.values()) / n, *kinds[:4],
        kinds[4], kinds[5], kinds[6], shouted / n, odd / n, sum(k for w, k in counts.items() if len(w) > 18) / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, n - 1),
    ]


_KIND = np.full(256, 5, np.int64)  # symbols
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(48, 58)]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[[*range(65, 91)]] = 3
_KIND[[ord(c) for c in ".,:;?!'\"-()"]] = 4
_KIND[128:] = 6


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `stats` (array<double>) of every row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            stats = [statistics(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], names=[id_col, "stats"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray = None
    levels: np.ndarray = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def pooled(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to the values (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, n in zip(values, sizes, strict=True):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, k2 = blocks.pop()
            v1, n1, k1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _summed(rows: DataFrame, of: "callable", n_rows: int) -> np.ndarray:
    """of(stats, y) gives a matrix with n_rows rows for a batch; the sum over all batches and tasks. Each task sends each
    matrix row once; they are added up row by row on the executors."""

    def each(batches):
        total = None
        for b in batches:
            if b.num_rows:
                stats = np.array(b.column(0).to_pylist(), dtype=np.float64)
                part = of(stats, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(each, "i int, row array<double>")
    # lost or doubled nothing: element by element, by position
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    found = cells.select("i", F.col("row.v").alias("row")).collect()  # n_rows rows of fixed width
    out = np.zeros((n_rows, len(found[0]["row"]) if found else 1))
    for r in found:
        out[r["i"]] = r["row"]
    return out


def fit(train: DataFrame, label_col: str, n_features: int = 192, width: float = 3.0, ridge: float = 1e-3, bins: int = 400, seed: int = 7) -> Model | None:
    """Fit to all rows of train (`stats`, a 0/1 label, `_part` from 0 to 4; rows of part 0 calibrate, the others fit).
    Null labels are left out. None if nothing is labelled."""
    rows = train.where(F.col(label_col).isNotNull()).select("stats", F.col(label_col).cast("double").alias("y"), "_part")
    fitted, kept = rows.where("_part <> 0").select("stats", "y"), rows.where("_part = 0").select("stats", "y")
    p = len(STATISTICS)
    moments = _summed(fitted, lambda s, y: np.vstack([np.hstack([s.sum(0), len(s)]), np.hstack([(s * s).sum(0), y.sum()])]), 2)
    if moments.shape[1] < p + 1 or not moments[0, p]:
        return None
    n = moments[0, p]
    mean = moments[0, :p] / n
    scale = np.sqrt(np.maximum(moments[1, :p] / n - mean**2, 1e-9))
    draw = np.random.default_rng(seed)
    model = Model(mean, scale, draw.normal(size=(p, n_features)) / width, draw.uniform(0, 2 * np.pi, n_features), None)

    def products(s, y):
        z = model.features(s)
        return np.vstack([z.T @ z, y @ z])

    sums = _summed(fitted, products, n_features + 2)
    model.weights = np.linalg.solve(sums[:-1] + ridge * n * np.eye(n_features + 1) / n_features, sums[-1])
    low, high = -0.5, 1.5

    def binned(s, y):
        k = np.clip(((model.raw(s) - low) / (high - low) * bins).astype(int), 0, bins - 1)
        return np.vstack([np.bincount(k, minlength=bins), np.bincount(k, weights=y, minlength=bins)]).astype(float)

    count, ones = _summed(kept, binned, 2) if not kept.isEmpty() else _summed(fitted, binned, 2)
    full = count > 0
    prior = moments[1, p] / n
    model.edges = low + (np.flatnonzero(full) + 0.5) * (high - low) / bins
    model.levels = pooled((ones[full] + prior) / (count[full] + 1), count[full] + 1)
    return model


def scored(stats: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """The id column and `score`, 0.5 where there is no model."""
    kind = stats.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            score = model.score(s) if model is not None and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    return stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {kind}, score double")


def train_rows(stats: DataFrame, labels: DataFrame, label_col: str, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """The statistics of labelled rows that are not held out, each label once an id. Labels are a few bytes a row; what
    they meet are statistics, not texts."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias(label_col))
    rows = stats.where(~held_out).join(known, F.col(id_col) == F.col("_id")).select("stats", label_col, id_col)
    return rows.select("stats", label_col, F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(5)).alias("_part"))


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is `least` or more; all of them where there is no model.
    Texts are read once and not shuffled."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            stats = np.array([statistics(x or "") for x in b.column(at).to_pylist()])
            yield b.filter(pa.array(model.score(stats) >= least)) if b.num_rows else b

    return docs.mapInArrow(run, docs.schema)
