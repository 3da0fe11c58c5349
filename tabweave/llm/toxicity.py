"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic documents and unlabelled text.
The risk of calling unlabelled text toxic is corrected by the class prior, and
kept from going below zero: R = prior * R+(positive) + max(0, R-(unlabelled) -
prior * R-(positive)). Where the second term is negative, only the first one counts.

A text's features are the distinct hashes of its words and of its words' first
bytes (affixes PREFIXES), in BUCKETS. Words are runs of ASCII letters and digits
and bytes above 0x7F, with A-Z lower-cased. The prior is the share of toxic rows
among the labelled ones. Training takes at most SAMPLE_POSITIVE confirmed and
SAMPLE_UNLABELLED other documents, chosen by a hash of the id; features are made
by Spark, of a text with more than SAMPLE_FEATURES those with the smallest hashes,
and the bounded sample is fitted in numpy on the driver. Scores use all features.

Null and empty texts have no features and the score of the bias alone. Without
confirmed examples every score is 0. Repeated rows get the same answer each, rows
without id are scored and never learned from, other columns are ignored. Where
several labels belong to one id, one toxic label makes it confirmed.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents
from tabweave.llm.langid import held_out

BUCKETS = 1 << 20
PREFIXES = (4, 5)
SAMPLE_POSITIVE = 1500
SAMPLE_UNLABELLED = 5000
SAMPLE_FEATURES = 8192
LEAST_SIGMAS = 2.0
SMOOTHING = 4.0
STEPS = 100
FOLDS = 4
LINE_STEPS = 3000
RATE = 0.05
RIDGE = 1e-2
THRESHOLD = 0.7


def buckets_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, flat, and each text's first one."""
    data, offsets = tx.buffers(column)
    data = tx.LOWER[data]
    starts, ends, firsts = tx.spans(data, offsets, tx.ALNUM)
    kinds = [tx.hashes(data, starts, ends)]
    for n in PREFIXES:
        kinds.append(tx.hashes_any(data, starts, np.minimum(starts + n, ends)) + np.uint64(n))
    row = tx.row_of(firsts).astype(np.uint64)
    flat = np.concatenate([(row << np.uint64(20)) | (tx.mix(k) & np.uint64(BUCKETS - 1)) for k in kinds])
    flat = np.unique(flat)
    cuts = np.searchsorted(flat, np.arange(len(offsets), dtype=np.uint64) << np.uint64(20))
    return (flat & np.uint64(BUCKETS - 1)).astype(np.int32), cuts


@dataclasses.dataclass
class Model:
    weights: np.ndarray
    cap: float
    factor: float
    bias: float

    def scores(self, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return sigmoid(self.factor * np.minimum(total[cuts[1:]] - total[cuts[:-1]], self.cap) + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50).astype(np.float64)))


def risk_slope(f: np.ndarray, p: int, prior: float) -> np.ndarray:
    """Derivative of the non-negative risk by each margin; the first ``p`` are confirmed, the rest unlabelled."""
    s, u = sigmoid(f), len(f) - p
    out = np.empty(len(f))
    if np.logaddexp(0, f[p:]).mean() - prior * np.logaddexp(0, f[:p]).mean() >= 0:
        out[:p], out[p:] = -prior / p, s[p:] / u
    else:
        out[:p], out[p:] = prior * (s[:p] - 1) / p, 0
    return out


def descend(w: np.ndarray, slope, steps: int) -> np.ndarray:
    """Adam from ``w`` along ``slope(w)``."""
    a, b = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = slope(w)
        a += 0.1 * (g - a)
        b += 0.001 * (g * g - b)
        w = w - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return w


def weigh(rows: list[np.ndarray], p: int, prior: float) -> np.ndarray:
    """Weights of all buckets that minimise the non-negative risk with logistic loss; the first ``p`` rows are confirmed."""
    buckets = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    n, u = len(rows), len(rows) - p
    # Buckets count by how much oftener confirmed documents have them, where that is no
    # chance, so that the many words that only tell single documents apart have no weight.
    in_positive = np.bincount(buckets[doc < p], minlength=BUCKETS)
    in_unlabelled = np.bincount(buckets[doc >= p], minlength=BUCKETS)
    some = np.flatnonzero(in_positive + in_unlabelled)
    in_positive, in_unlabelled = in_positive[some], in_unlabelled[some]
    lift = np.log((in_positive + SMOOTHING * p / n) / p) - np.log((in_unlabelled + SMOOTHING * u / n) / u)
    expected = in_unlabelled * (p / u)
    clear = np.abs(in_positive - expected) >= LEAST_SIGMAS * np.sqrt(expected + 1)
    scale = np.zeros(BUCKETS)
    scale[some] = np.where(clear, lift * np.abs(lift), 0)
    del some, in_positive, in_unlabelled, lift, expected, clear
    used = np.flatnonzero(scale)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    kept = scale[buckets] != 0
    doc, feature, value = doc[kept], number[buckets[kept]], scale[buckets[kept]].astype(np.float32)
    del buckets, kept

    def slope(w: np.ndarray) -> np.ndarray:
        by_doc = risk_slope(np.bincount(doc, w[feature] * value, n) + w[-1], p, prior)
        by_feature = np.bincount(feature, by_doc[doc] * value, len(used)) + RIDGE * w[:-1]
        return np.concatenate([by_feature, [by_doc.sum()]])

    w = descend(np.concatenate([np.zeros(len(used)), [np.log(prior / (1 - prior))]]), slope, STEPS)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w[:-1] * scale[used]
    return weights


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Weights averaged over FOLDS fits, and the scale and offset of the margins.

    Each fit leaves out one part of the documents, and the margins of these under
    it are those of documents it has not seen. Scale and offset are fitted to the
    same risk on the margins of all documents, without a ridge.
    """
    # Empty lists come without their type.
    positive, unlabelled = ([np.asarray(x, np.int32) for x in side] for side in (positive, unlabelled))
    folds = min(FOLDS, len(positive), len(unlabelled))
    out = [np.zeros(len(side)) for side in (positive, unlabelled)]
    weights = np.zeros(BUCKETS, np.float32)
    for fold in range(folds):
        held = [[i for i in range(len(side)) if folds > 1 and i % folds == fold] for side in out]
        seen = [[x for i, x in enumerate(side) if folds == 1 or i % folds != fold] for side in (positive, unlabelled)]
        own = weigh(seen[0] + seen[1], len(seen[0]), prior)
        weights += own / folds
        for into, side, late in zip(out, (positive, unlabelled), held, strict=True):
            for i in late or range(len(side)):
                into[i] = own[side[i]].sum(dtype=np.float64)
    f, p = np.concatenate(out), len(positive)
    # Above the lower quartile of confirmed documents all count as equally sure, else the few largest margins rule the fit.
    cap = float(np.quantile(f[:p], 0.25))
    f = np.minimum(f, cap)
    unit = f.std() or 1.0

    def line_slope(v: np.ndarray) -> np.ndarray:
        by_doc = risk_slope(v[0] * f / unit + v[1], p, prior)
        return np.array([(by_doc * f / unit).sum(), by_doc.sum()])

    factor, bias = descend(np.array([1.0, np.log(prior / (1 - prior))]), line_slope, LINE_STEPS)
    return Model(weights, cap, float(factor / unit), float(bias))


def thinned(buckets: np.ndarray, cuts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` features of each text, those with the smallest hashes."""
    parts = [buckets[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, x in enumerate(parts):
        if len(x) > most:
            parts[i] = np.sort(x[np.argpartition(tx.mix(x.astype(np.uint64)), most)[:most]])
    return np.concatenate(parts or [buckets]), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            buckets, cuts = buckets_of(batch.column("text"))
            buckets, cuts = thinned(buckets, cuts, SAMPLE_FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(buckets))
            yield pa.RecordBatch.from_arrays([batch.column("confirmed"), batch.column("chance"), lists], ["confirmed", "chance", "buckets"])

    return docs.select("confirmed", "chance", "text").mapInArrow(run, "confirmed boolean, chance double, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """A model from ``usable`` documents: those with a toxic label, and the others as unlabelled text."""
    rows = docs.filter(usable & F.col("doc_id").isNotNull() ).select("doc_id", "text")
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") == 1).alias("confirmed"))
    ids = rows.select("doc_id").join(marks, "doc_id", "left")
    n, p, known = ids.agg(F.count(F.lit(1)), F.count_if("confirmed"), F.count("confirmed")).first()
    if not p:
        return None
    prior = min(max(p / known, 1e-4), 1 - 1e-4)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    of_positive, of_all = min(1.0, SAMPLE_POSITIVE / p), min(1.0, SAMPLE_UNLABELLED / n)
    chosen = rows.withColumn("chance", chance).filter(F.col("chance") < max(of_positive, of_all))
    chosen = chosen.join(marks.filter("confirmed"), "doc_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    chosen = chosen.filter((F.col("chance") < of_all) | F.col("confirmed")).orderBy("chance", "doc_id")
    sample = features(chosen).toPandas()
    positive = sample[sample.confirmed & (sample.chance < of_positive)].buckets.tolist()
    # Unlabelled text is drawn from all documents; confirmed ones among it stay, as the prior counts them.
    unlabelled = sample[sample.chance < of_all].buckets.tolist()
    del sample
    return train(positive, unlabelled, prior) if positive else None


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in tx.chunks(batches):
            scores = own.scores(*buckets_of(batch.column("text"))) if own else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = fit(docs, documents(spark, sf_dir, "labels"), ~F.col("held_out"))
    return predict(docs, model, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
