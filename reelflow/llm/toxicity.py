"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct words and the first five and six bytes of each. Those that the
labelled documents show to be much more frequent in toxic texts are the model's markers. One weight
per marker serves all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . counts). A labelled
toxic document has grade 2 if it holds at least `SEVERE` distinct marker words, else 1; a clean one 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import slices, stored, tokens, utf8
from reelflow.llm.shingles import WordHashes, shingle_set

#: Labelled documents used for fitting, the ones with the smallest hashes of their ids.
LABELLED = 20_000
#: Markers at most, those with the largest z-scores; toxic documents that must hold one; least z and ratio of rates.
MARKERS, LEAST_DOCS, LEAST_Z, LEAST_RATIO = 4096, 4, 3.0, 8.0
SEVERE = 3
RIDGE = 0.01
STEPS = 600
LIMIT = 0.5

SCORE = "expected_severity double, grade int, p_toxic double, toxic boolean"


def parts(word: bytes) -> set[bytes]:
    """A word's features."""
    return {word, b"^" + word[:5], b"^" + word[:6]}


@dataclass
class Model:
    """Marker weights and ordered thresholds; without markers every text is clean."""

    weights: dict[bytes, float]
    thresholds: list[float]

    def score(self, found: set[bytes], cache: dict[bytes, float]) -> tuple[float, int, float, bool]:
        """Expected severity, most probable grade, probability of any toxicity, decision."""
        if not self.weights:
            return 0.0, 0, 0.0, False
        total = 0.0
        for word in sorted(w for w in found if cache[w]):
            total += cache[word]
        above = [1 / (1 + np.exp(np.clip(t - total, -50, 50))) for t in self.thresholds]
        by_grade = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        p = round(float(above[0]), 6)
        return round(float(sum(above)), 6), int(np.argmax(by_grade)), p, p >= LIMIT


class _Weights(dict):
    """Word -> sum of its features' weights."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 1 << 19:
            self.clear()
        value = self[word] = sum(self.weights.get(p, 0.0) for p in sorted(parts(word)))
        return value


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, family, words); copies of a text mostly share the smallest shingle hash."""
    hashes = WordHashes()
    for batch in slices(batches, 256):
        texts = utf8(batch.column(2))
        sets = [shingle_set(t, hashes) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([int(s[0]) if len(s) else 0 for s in sets], pa.int64()),
                pa.array([sorted(set(tokens(t))) for t in texts], pa.list_(pa.binary())),
            ],
            ["doc_id", "toxic", "family", "words"],
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 128):
        toxic, found = [], []
        for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = set().union(*map(parts, words)) if words else set()
            found += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(found, pa.binary())], ["toxic", "feature"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, family, words) of a bounded sample with one document of each family, written out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most LABELLED ids, whatever the input's size: the texts are not shuffled to find theirs
    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(
        _families, "doc_id long, toxic int, family long, words array<binary>"))
    first = sample.groupBy("family").agg(F.min("doc_id").alias("doc_id"))
    return stored(sample.join(first, ["family", "doc_id"], "left_semi").select("doc_id", "toxic", "words"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of `labels` (doc_id, toxic 0/1; the largest of repeated ones) on the texts of `docs`.

    Unlabelled documents and labels without a document or a value are left out. Marker counts are
    Spark aggregates; the driver gets at most `MARKERS` markers and, of at most `LABELLED`
    documents, the markers they hold.
    """
    sample = _labelled(docs, labels)
    n_toxic, n_clean = (v or 0 for v in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n_toxic or not n_clean:
        return Model({}, [])
    counts = sample.select("toxic", "words").mapInArrow(_features, "toxic int, feature binary").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST_DOCS)
    odds = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_clean - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (n_toxic - F.col("a") + 0.5) + 1 / (n_clean - F.col("b") + 0.5))
    ratio = (F.col("a") / n_toxic) / ((F.col("b") + 0.5) / n_clean)
    marked = counts.withColumn("z", odds / error).where((F.col("z") >= LEAST_Z) & (ratio >= LEAST_RATIO))
    markers = sorted(bytes(r.feature) for r in marked.orderBy(F.desc("z"), "feature").limit(MARKERS).collect())
    if not markers:
        return Model({}, [])
    number = {m: k for k, m in enumerate(markers)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            own = [[sorted(number[p] for p in parts(w) if p in number) for w in words] for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([sum(bool(x) for x in doc) for doc in own], pa.int32()),
                    pa.array([sorted(k for x in doc for k in x) for doc in own], pa.list_(pa.int32())),
                ],
                ["doc_id", "toxic", "words", "markers"],
            )

    rows = sample.mapInArrow(held, "doc_id long, toxic int, words int, markers array<int>").toPandas().sort_values("doc_id")
    grades = np.where(rows.toxic.to_numpy() == 0, 0, np.where(rows.words.to_numpy() >= SEVERE, 2, 1))
    weights, thresholds = fit_ordinal(rows.markers.tolist(), grades, len(markers))
    return Model(dict(zip(markers, weights, strict=True)), thresholds)


def fit_ordinal(features: list, grades: np.ndarray, size: int) -> tuple[list[float], list[float]]:
    """Weights and thresholds that maximise the ridge-penalised cumulative-link likelihood.

    `features`: per document the numbers of its features, repeated as often as they occur. Steps
    have a size for each parameter that grows while its gradient keeps its sign (Rprop).
    """
    top = int(grades.max())
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate([np.asarray(f, np.int64) for f in features]) if len(row) else np.empty(0, np.int64)
    share = np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades)
    start = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))  # a threshold is the one before it and exp(gap)
    x = np.concatenate((np.zeros(size), start[:1], gaps))
    step, before = np.full(len(x), 0.05), np.zeros(len(x))
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -50, 50)))
    for _ in range(STEPS):
        limits = np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))
        score = np.bincount(row, x[column], len(features))
        below = sigmoid(np.concatenate((limits, [np.inf]))[grades] - score)
        above = np.where(grades > 0, sigmoid(limits[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(below - above, 1e-12)
        up, low = below * (1 - below) / p, above * (1 - above) / p
        slope = np.concatenate((
            np.bincount(column, (low - up)[row], size) - RIDGE * x[:size],
            *([np.sum(up[grades == k]) - np.sum(low[grades == k + 1])] for k in range(top)),
        ))
        inner = slope[size:]
        slope[size:] = [inner.sum(), *(np.exp(x[size + k]) * inner[k:].sum() for k in range(1, top))]
        same = slope * before
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-7, 0.5)
        slope = np.where(same < 0, 0.0, slope)
        x, before = x + np.sign(slope) * step, slope
    limits = np.cumsum(np.concatenate((x[size : size + 1], np.exp(x[size + 1 :]))))
    return x[:size].tolist(), limits.tolist()


def severity(text: Column, model: Model) -> Column:
    """A struct of `SCORE` for a text column; null and empty texts are clean."""
    weights, thresholds = model.weights, model.thresholds

    @F.pandas_udf(SCORE)
    def score(texts: pd.Series) -> pd.DataFrame:
        own = Model(weights, thresholds)
        cache = _Weights(weights)
        return pd.DataFrame([own.score(set(tokens(t)), cache) for t in texts], columns=[c.split()[0] for c in SCORE.split(", ")])

    return score(text.cast("binary"))


def grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, toxic) for every row of `docs`.

    Only `doc_id` and `text` of `docs` and `doc_id` and `toxic` of `labels` are read. Null ids are kept,
    repeated rows are scored again, null and empty texts are clean, an empty table gives an empty
    result; without labels of both kinds, or without a marker, every text is clean with severity 0.
    """
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(F.col("text"), model).alias("s"))
    return scored.select("doc_id", "s.*")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is not toxic."""
    return docs.where(~severity(F.col("text"), fit(docs, labels))["toxic"])
