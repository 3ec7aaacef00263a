"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity is an ordered grade 0 .. K-1. One weight vector is shared by all thresholds: P(grade <= k) = sigmoid(t_k - w.x),
t_1 < t_2 < ...; the output is the expected grade. x marks which words a text has, whatever its length.

The model is fitted on a bounded, documented sample (`SAMPLE` labelled documents, in order of a hash of their ids), in one
task; features are the `FEATURES` words that separate the grades best in it. Scoring covers every document and
its whole text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm import bytetext

SAMPLE = 20_000
FEATURES = 4096
MIN_DOCS = 3
ROUNDS = 1000
STEP, SPARSITY = 0.2, 5e-5
#: A document is rejected at this probability of a grade above 0: a missed toxic text costs more than a lost clean one.
REJECT = 0.3
SCORE = "struct<severity: double, p_toxic: double, grade: int>"


def _presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash), each pair once."""
    lower = bytetext.LOWER[data]
    starts, ends, bounds = bytetext.words(lower, offsets, bytetext.NOT_ALNUM)
    hashes = bytetext.word_hashes(lower, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


class OrdinalModel:
    """Weights of hashed words and ordered thresholds."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.hashes, self.weights, self.thresholds = hashes, weights, thresholds

    def margins(self, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=n)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k), one column per threshold."""
        return _sigmoid(margins[:, None] - self.thresholds)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, hashes=self.hashes, weights=self.weights, thresholds=self.thresholds)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> OrdinalModel:
        with np.load(io.BytesIO(raw)) as f:
            return cls(f["hashes"], f["weights"], f["thresholds"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _associations(doc, feature, n_features: int, marked: np.ndarray) -> np.ndarray:
    """z of each feature: its rate among marked texts against the rest."""
    inside = np.bincount(feature, weights=marked[doc], minlength=n_features)
    total = np.bincount(feature, minlength=n_features)
    m, rest = marked.sum(), len(marked) - marked.sum()
    a, b = (inside + 0.5) / (m + 1), (total - inside + 0.5) / (rest + 1)
    pooled = (total + 1) / (len(marked) + 2)
    return (a - b) / np.sqrt(pooled * (1 - pooled) * (1 / (m + 1) + 1 / (rest + 1)))


def severity_grades(doc: np.ndarray, feature: np.ndarray, n_features: int, toxic: np.ndarray) -> np.ndarray:
    """Grades from binary labels: 0 not toxic; a toxic text is 2 when it has more of the words that mark toxic texts than the
    median toxic text, else 1."""
    marking = _associations(doc, feature, n_features, toxic) > 4
    hits = np.bincount(doc, weights=marking[feature], minlength=len(toxic))
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    return np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)


def fit(doc: np.ndarray, hashes: np.ndarray, grades: np.ndarray | None, toxic: np.ndarray) -> OrdinalModel:
    """Fit on texts given as (text number, word hash) pairs. `grades` None: derive them from `toxic`."""
    n = len(toxic)
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0, 60.0]))
    if not n or not (toxic.any() if grades is None else (grades > 0).any()):
        return nothing
    vocabulary, feature = np.unique(hashes, return_inverse=True)
    often = np.bincount(feature) >= MIN_DOCS
    keep = often[feature]
    doc, hashes = doc[keep], hashes[keep]
    vocabulary, feature = np.unique(hashes, return_inverse=True)
    if not len(vocabulary):
        return nothing
    if grades is None:
        grades = severity_grades(doc, feature, len(vocabulary), toxic)
    z = _associations(doc, feature, len(vocabulary), grades > 0)
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:FEATURES])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[feature] >= 0
    doc, feature = doc[keep], place[feature[keep]]
    top = int(grades.max())
    # P(grade > k) starts at its rate; gaps between thresholds stay positive as exponentials.
    rates = np.array([(grades > k).mean() for k in range(top)])
    first = -np.log(rates / np.maximum(1 - rates, 1e-9))
    params = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    weights = np.zeros(len(chosen))
    seen_w, seen_p = np.full(len(weights), 1e-8), np.full(len(params), 1e-8)
    for _ in range(ROUNDS):
        t = np.concatenate([[-np.inf], params[0] + np.concatenate([[0], np.cumsum(np.exp(params[1:]))]), [np.inf]])
        m = np.bincount(doc, weights=weights[feature], minlength=n)
        upper, lower = _sigmoid(t[grades + 1] - m), _sigmoid(t[grades] - m)
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        slope = (du - dl) / n  # of the negative log-likelihood by the margin
        g = np.bincount(feature, weights=slope[doc], minlength=len(weights)) + 1e-5 * weights
        by_threshold = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) / n for k in range(top)])
        gp = np.concatenate([[by_threshold.sum()], np.exp(params[1:]) * np.cumsum(by_threshold[::-1])[::-1][1:]])
        seen_w += g * g
        seen_p += gp * gp
        weights -= STEP * g / np.sqrt(seen_w)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - STEP * SPARSITY / np.sqrt(seen_w), 0)  # L1: few words matter
        params -= 0.05 * gp / np.sqrt(seen_p)
    used = weights != 0
    thresholds = params[0] + np.concatenate([[0], np.cumsum(np.exp(params[1:]))])
    return OrdinalModel(vocabulary[chosen][used], weights[used], thresholds)


@F.arrow_udf(T.ArrayType(T.LongType()))
def word_set(texts: pa.Array) -> pa.Array:
    """The distinct word hashes of each text."""
    parts = []
    for first, last, data, offsets in bytetext.chunks(texts):
        doc, hashes = _presence(data, offsets)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=last - first))]).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, grades, counts, hashes = [], [], [], []
    for batch in batches:
        labels.append(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool))
        grades.append(batch.column("grade").to_numpy(zero_copy_only=False).astype(float))
        sets = batch.column("words")
        counts.append(sets.value_lengths().to_numpy(zero_copy_only=False))
        hashes.append(sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    if labels:
        toxic, grade = np.concatenate(labels), np.concatenate(grades)
        doc = np.repeat(np.arange(len(toxic)), np.concatenate(counts))
        model = fit(doc, np.concatenate(hashes), None if np.isnan(grade).any() else grade.astype(int), toxic)
    else:
        model = fit(np.zeros(0, int), np.zeros(0, np.uint64), None, np.zeros(0, bool))
    yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
    grade: str | None = None, sample: int = SAMPLE,
) -> OrdinalModel:
    """The model of up to `sample` labelled documents. `grade`: a column of ordered grades; without it they come from `toxic`.

    Null ids or labels are not sampled; several labels of an id count as the largest; of documents with one id, any
    one may be taken. No labels, or no toxic one: every document scores 0.
    """
    level = F.col(grade) if grade else F.lit(None)
    asked = labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(key).agg(
        F.max(F.col(toxic).cast("int")).alias("toxic"), F.max(level).cast("int").alias("grade"))
    asked = asked.orderBy(F.xxhash64(key), key).limit(sample).withColumnRenamed(key, "_id")
    known = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(asked), F.col("_k") == F.col("_id"))
    rows = known.select("_id", "toxic", "grade", word_set(F.col("_t")).alias("words")).limit(sample)
    fitted = rows.coalesce(1).mapInArrow(_fit_task, "model binary").first()
    return OrdinalModel.from_bytes(fitted[0]) if fitted else fit(np.zeros(0, int), np.zeros(0, np.uint64), None, np.zeros(0, bool))


def score(df: DataFrame, text: Column, model: OrdinalModel) -> Column:
    """struct(severity: expected grade, p_toxic: P(grade > 0), grade: the likeliest); null or empty text has no words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCORE)
    def scored(texts: pa.Array) -> pa.Array:
        margins = [np.zeros(0)]
        for first, last, data, offsets in bytetext.chunks(texts):
            doc, hashes = _presence(data, offsets)
            margins.append(shared.value.margins(doc, hashes, last - first))
        above = shared.value.above(np.concatenate(margins))
        ordered = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        grades = (ordered[:, :-1] - ordered[:, 1:]).argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grades.astype(np.int32))], ["severity", "p_toxic", "grade"])

    return scored(text)
