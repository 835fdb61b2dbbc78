"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document is its word and punctuation 1- and 2-grams, hashed into 2**BITS features, each the root of its share. The
model is a vector of that length: a task scores documents as sparse dot products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chobo.llm import _names, _text

BITS = 18
MOST_ROWS = 16_384
"""Labelled rows to learn from, about: of more, those whose hashed id falls in the first so many parts of all."""
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS


def _rows(data, offsets, bits):
    """(row, bucket, value): values of a row have length 1."""
    row, bucket, count = _text.features(data, offsets, bits)
    total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
    return row, bucket, np.sqrt(count / total[row])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, bits: int = BITS, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0) -> Model:
    """Learn label_col (0 or 1) of ``labels`` from the texts of ``docs``.

    Null ids and labels are left out; of labels that share an id the least counts. Documents are turned into features
    by all tasks; the updates, which are sequential, run in one task over about ``most_rows`` rows in the order of
    their hashed ids. Without labelled rows all weights are 0 and every score is 0.5.
    """
    known = labels.filter(_names.col(label_col).isNotNull() & _names.col(id_col).isNotNull()).groupBy(_names.col(id_col).cast("long").alias("__id")).agg(F.min(_names.col(label_col)).cast("int").alias("__y"))
    n = known.count()
    parts = 1 << 40
    some = known if n <= most_rows else known.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(parts)) < int(parts * most_rows / n))
    # at most about most_rows rows of two numbers
    rows = docs.select(_names.col(id_col).cast("long").alias("__id"), _names.col(text_col).alias("text")).join(F.broadcast(some), "__id")
    rows = rows.select(F.xxhash64("__id", F.lit(12)).alias("o"), F.col("__y").alias("y"), "text")

    def featurise(batches):
        for batch in _text.pieces(batches, "text"):
            row, bucket, value = _rows(*_text.utf8(batch.column(2)), bits)
            at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], names=["o", "y", "b", "v"])

    def learn(batches):
        data = []
        for batch in batches:
            y, b, v = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            data += [(int(y[i]), b[i].values.to_numpy().copy(), v[i].values.to_numpy().astype(np.float64)) for i in range(batch.num_rows)]
        size = 1 << bits
        z, g2 = np.zeros(size + 1), np.zeros(size + 1)
        for _ in range(epochs):
            for y, b, v in data:
                j, x = np.append(b, size), np.append(v, 1.0)
                zj, nj = z[j], g2[j]
                w = np.where(np.abs(zj) <= l1, 0.0, (np.sign(zj) * l1 - zj) / ((beta + np.sqrt(nj)) / alpha + l2))
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                z[j] += g - (np.sqrt(nj + g * g) - np.sqrt(nj)) / alpha * w
                g2[j] += g * g
        w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], names=["j", "w"])

    features = rows.mapInArrow(featurise, "o long, y int, b array<int>, v array<float>")
    # one sequential learner, over a bounded sample
    fitted = features.repartition(1).sortWithinPartitions("o", "y").mapInArrow(learn, "j long, w double").toArrow()
    w = np.zeros((1 << bits) + 1)
    w[fitted.column("j").to_numpy()] = fitted.column("w").to_numpy()
    return Model(w[:-1], float(w[-1]), bits)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (0 to 1, higher for label 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts have no features: their score is that of the bias alone. Columns may have any
    names; those named as the results are replaced. Every row is scored on its own, whole text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, names = _names.packed(docs, ["score", "predicted"], text=_names.col(text_col))

    def run(batches):
        m = shared.value
        for batch in _text.pieces(batches, "text"):
            row, bucket, value = _rows(*_text.utf8(batch.column(1)), m.bits)
            s = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=m.weights[bucket] * value, minlength=batch.num_rows) + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    return _names.unpacked(rows.mapInArrow(run, _names.with_fields(rows, ["row"], "score double, predicted int")), names, "score", "predicted")
