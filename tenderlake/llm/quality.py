"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are counts over bytes, words and lines; trees are grown on binned statistics of a bounded sample and flattened
into arrays, which numpy walks for whole batches, one step a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import shared
from tenderlake.llm.labelled import held_out, training_rows
from tenderlake.llm.textbytes import IS_SPACED, pieces, runs, words

IS_LINE = np.ones(256, bool)
IS_LINE[10] = False
SYMBOLS = b"|!%*&#$.,"


def _share(mask: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds]) / np.maximum(of, 1)


def _repeats(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: share of values seen before in it, and share of its most frequent value."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    count = np.bincount(t, minlength=n)
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, t[at], np.diff(np.append(at, len(h))))
    return 1 - np.bincount(t[at], minlength=n) / np.maximum(count, 1), most / np.maximum(count, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text; an empty one's are 0 but for its repeats."""
    n = len(column)
    found = words(column, IS_SPACED, fold=False)
    data, offsets, hashes = found.data, found.offsets, found.hashes()
    size, bounds = np.diff(offsets), found.bounds()
    count = np.diff(bounds)
    length = (found.end - found.start).astype(float)
    mean = np.bincount(found.text, length, n) / np.maximum(count, 1)
    out = [np.log1p(size), np.log1p(count), mean, np.sqrt(np.bincount(found.text, (length - mean[found.text]) ** 2, n) / np.maximum(count, 1))]
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | (data >= 97) & (data <= 122) | (data >= 128)
    out += [_share(x, offsets, size) for x in (upper, digit, letter, data >= 128, data == 10, ~letter & ~digit & (data > 32))]
    out += [_share(data == s, offsets, count) for s in SYMBOLS]
    starts, ends = data[found.start], data[found.end - 1]
    marked = ~((ends >= 48) & (ends <= 57) | (ends >= 65) & (ends <= 90) | (ends >= 97) & (ends <= 122) | (ends >= 128))
    out += [_share(x, bounds, count) for x in (marked, (starts >= 65) & (starts <= 90), length == 1, length > 15)]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.text[1:] == found.text[:-1])
    out += [_share(same, bounds, count), *_repeats(hashes, found.text, n), *_repeats(*runs(hashes, found.text, 3), n)]
    line = words(column, IS_LINE)
    out += [np.log1p(np.bincount(line.text, minlength=n)), *_repeats(line.hashes(), line.text, n)]
    return np.stack(out, 1)


@dataclass
class Trees:
    """All trees in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2; a leaf keeps sending rows left."""

    start: float
    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray  # rows with a value up to the cut go left
    value: np.ndarray  # (trees, leaves)
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of logistic loss, level by level on histograms of ``bins`` quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    nodes, leaves = 2**depth - 1, 2**depth
    model = Trees(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves)), depth)
    raw = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * d + np.arange(d)) * bins + binned).ravel()
            g, h = (np.bincount(cell, np.repeat(v, d), wide * d * bins).reshape(wide, d, bins).cumsum(2) for v in (slope, bend))
            gain = g**2 / (h + smooth) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + smooth) - g[..., -1:] ** 2 / (h[..., -1:] + smooth)
            gain[(h < least) | (h[..., -1:] - h < least)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            at = np.full(wide, bins)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                if gain[k, f, cut] > 1e-9:
                    model.feature[t, first + k], model.cut[t, first + k], at[k] = f, edges[f][cut], cut
            own = model.feature[t, node]
            node = 2 * node + 1 + (binned[np.arange(n), own] > at[node - first])
        leaf = node - nodes
        model.value[t] = -rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + smooth)
        raw += model.value[t][leaf]
    return model


def train(documents: DataFrame, labels: DataFrame, most: int = 12000) -> Trees:
    """Fits on at most ``most`` labelled rows (documents: doc_id, text; labels: doc_id, quality). No rows give a model of score 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            table = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1]).cast(pa.list_(pa.float64())), batch.column(2)], ["x", "y"])

    rows = training_rows(documents, labels, "quality", most).mapInArrow(run, "x array<double>, y int").toArrow()  # at most ``most`` rows
    if not rows.num_rows:
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 1)
    return fit(rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows["y"].to_numpy().astype(float))


def score(documents: DataFrame, model: Trees) -> DataFrame:
    """Returns (doc_id, score) for every row of documents (doc_id, text); null texts count as empty."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(statistics(batch.column(1))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Returns a row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Learns from labels that aren't held out; a row's own label, language, source or id is no input of its score.
    """
    documents = shared.only(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(shared.documents(spark, sf_dir), shared.labels(spark, sf_dir))
