"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first few bytes, so stems count in any language; Spark counts them over the labelled sample, and
those that go with the label enough are the model's. Beside a weight each has a vector whose products with the others' are
learned, so a pair can mean more than its two terms. The model goes to all tasks, where numpy scores whole texts.
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
from tenderlake.llm.textbytes import IS_PLAIN, mixed, pieces, ragged, words

STEMS = (5, 6, 7)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of every text as 32-bit hashes, in order of text, and each text's bounds in them."""
    found, low = words(column, IS_PLAIN), np.uint64(32)
    parts = [(found.text.astype(np.uint64) << low) | (found.hashes() >> low)]
    for size in STEMS:
        stem = found.hashes(size)
        long = stem != 0
        parts.append((found.text[long].astype(np.uint64) << low) | (mixed(stem[long] + np.uint64(size)) >> low))
    both = np.unique(np.concatenate(parts))
    return (both & np.uint64(2**32 - 1)).astype(np.int64), np.searchsorted(both >> low, np.arange(len(column) + 1, dtype=np.uint64))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray  # (terms,)
    vectors: np.ndarray  # (terms, factors)

    def inputs(self, items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the model's own terms among all."""
        place = np.minimum(np.searchsorted(self.terms, items), max(len(self.terms) - 1, 0))
        keep = self.terms[place] == items if len(self.terms) else np.zeros(len(items), bool)
        return place[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

    def raw(self, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each row's sum of vectors."""
        total = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])[bounds], axis=0)
        vectors = self.vectors[places]
        sums = total(vectors)
        return self.bias + total(self.weights[places]) + 0.5 * ((sums**2).sum(1) - total((vectors**2).sum(1))), sums

    def scores(self, items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(items, bounds))[0], -500, 500)))


def fit(known: np.ndarray, items: np.ndarray, bounds: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.2, decay: float = 1e-5, favour: float = 2.0, seed: int = 1) -> FactorizationMachine:
    """AdaGrad over small batches of logistic loss, for the ``known`` terms. A toxic row counts as ``favour`` rows."""
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(known, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(len(known)), rng.normal(0, 0.02, (len(known), factors)))
    items, bounds = model.inputs(items, bounds)
    past_w, past_v, past_b = np.full(len(known), 1e-2), np.full((len(known), factors), 1e-2), 1e-2
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            counts = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(counts)
            own = items[np.repeat(bounds[rows] - (ends - counts), counts) + np.arange(int(counts.sum()))]
            raw, sums = model.raw(own, np.concatenate([[0], ends]))
            slope = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y[rows]) * np.where(y[rows] > 0, favour, 1) / len(rows)
            used, at = np.unique(own, return_inverse=True)
            each = np.repeat(slope, counts)
            to_w = np.bincount(at, each, len(used)) + decay * model.weights[used]
            to_v = np.stack([np.bincount(at, each * np.repeat(sums[:, f], counts), len(used)) for f in range(factors)], 1) - to_w[:, None] * model.vectors[used]
            past_w[used] += to_w**2
            past_v[used] += to_v**2
            past_b += slope.sum() ** 2
            model.weights[used] -= rate * to_w / np.sqrt(past_w[used])
            model.vectors[used] -= 0.1 * rate * to_v / np.sqrt(past_v[used])
            model.bias -= 0.1 * rate * slope.sum() / np.sqrt(past_b)
    return model


def train(documents: DataFrame, labels: DataFrame, most: int = 30_000, least: int = 4, surprise: float = 15.0) -> FactorizationMachine:
    """Fits on at most ``most`` labelled rows (documents: doc_id, text; labels: doc_id, toxic).

    A term is used if ``least`` rows have it and the likelihood ratio of its presence against the label is ``surprise`` or
    more. Without rows the model scores 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            items, bounds = terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([ragged(items, bounds), batch.column(2)], ["terms", "y"])

    rows = shared.written(training_rows(documents, labels, "toxic", most).mapInArrow(run, "terms array<long>, y int"), "terms")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()  # one row
    if not n:
        return FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 1)))
    seen = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).where(F.col("n") >= least)
    cells = [("k", f"n * {toxic}"), ("n - k", f"n * {n - toxic}"), (f"{toxic} - k", f"({n} - n) * {toxic}"), (f"{n - toxic} - n + k", f"({n} - n) * {n - toxic}")]
    ratio = " + ".join(f"if({o} > 0, ({o}) * ln(({o}) * {n}D / ({e})), 0)" for o, e in cells)
    chosen = seen.where(f"2 * ({ratio}) >= {surprise}").select("term")
    chosen = shared.written(chosen, "chosen")
    held = np.sort(chosen.toPandas()["term"].to_numpy(np.int64))  # a bounded sample's terms

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy().astype(np.int64))])
            keep = held[np.minimum(np.searchsorted(held, items), len(held) - 1)] == items if len(held) else np.zeros(len(items), bool)
            yield pa.RecordBatch.from_arrays([ragged(items[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]), batch.column(1)], ["terms", "y"])

    kept = rows.mapInArrow(own, "terms array<long>, y int").orderBy("y", F.xxhash64("terms")).toArrow()  # at most ``most`` rows
    shared.drop(rows, chosen)
    lists = kept["terms"].combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
    return fit(held, lists.flatten().to_numpy(), bounds, kept["y"].to_numpy().astype(float))


def score(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """Returns (doc_id, score) for every row of documents (doc_id, text); null and empty texts get the model's bias."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shipped.value.scores(*terms(batch.column(1))))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents (all columns) that score less than ``threshold``; null and empty texts stay unless most rows are toxic."""
    model = train(shared.only(documents, doc_id="doc_id", text="text"), labels)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = shipped.value.scores(*terms(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Returns a row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Learns from labels that aren't held out; a row's own label, language, source or id is no input of its score.
    """
    documents = shared.only(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(shared.documents(spark, sf_dir), shared.labels(spark, sf_dir))
