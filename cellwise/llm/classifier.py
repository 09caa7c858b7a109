"""Operator 8: a compression classifier of text quality.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad.
A text is compressed with each, block by block so that long texts keep using the dictionary; the
difference of the two sizes, divided by the text's size, says which kind it is more like. A logistic
curve fitted on labelled texts that made no dictionary, shifted by the log odds of all training
labels, turns the difference into a probability.

Labels are read only from rows whose crc32(doc_id as text) mod 3 is not 1. The model is fitted on a
bounded sample of those (``PER_CLASS`` documents of each label, ``SAMPLE_BYTES`` of text at most from
each, chosen by a hash of the id); every document is scored over its whole text, however long. Null
texts count as empty. Empty texts get the score of a difference of zero. Rows with a null doc_id are
scored and count as not held out. A doc_id with labels of both kinds teaches nothing; one that stands on
several rows of ``docs`` gives the least of their texts. When there is too little text of a label to train
on, every score is 0.5. Every row is scored, equal texts alike; other columns are left out, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, only

PER_CLASS, SAMPLE_BYTES, DICT_BYTES, LEVEL, BLOCK = 800, 16_384, 112 << 10, 3, 1024


@dataclass
class CompressionModel:
    """Two dictionaries and the curve over the difference of the sizes they give."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def packers(self):
        made = []
        for data in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False))
        return made

    def difference(self, text: bytes, packers=None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text; 0 for no text."""
        if not text or not (self.good and self.bad):
            return 0.0
        good, bad = packers or self.packers()
        total = 0
        for k in range(0, len(text), BLOCK):
            block = text[k : k + BLOCK]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / len(text)

    def score(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * difference + self.offset))))


def held_out(doc_id: str) -> F.Column:
    """True where crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, both labels weighing the same, by Newton's method."""
    scale = float(np.abs(x).max()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Fit on the bounded sample described above."""
    labels = only(labels, doc_id="long", quality="int").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    parts = [labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for q in (1, 0)]
    chosen = parts[0].unionByName(parts[1])
    text = only(docs, doc_id="long", text="string").where(F.octet_length("text") > 0)
    start = F.substring(F.col("text"), 1, SAMPLE_BYTES)
    # One text for each of at most 2 * PER_CLASS ids, however many rows have the id.
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(start).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    texts = {q: [r.text.encode()[:SAMPLE_BYTES] for r in rows if r.quality == q] for q in (0, 1)}
    made = {q: t[0::2] or t for q, t in texts.items()}
    try:
        good, bad = (zstandard.train_dictionary(DICT_BYTES, [x[k : k + BLOCK] for x in made[q] for k in range(0, len(x), BLOCK)]).as_bytes() for q in (1, 0))
    except (zstandard.ZstdError, ValueError):  # too little text of a kind
        return CompressionModel(b"", b"", 0.0, 0.0)
    model = CompressionModel(good, bad, 0.0, 0.0)
    rest = {q: t[1::2] or t for q, t in texts.items()}
    packers = model.packers()
    x = np.array([model.difference(t, packers) for q in (0, 1) for t in rest[q]])
    y = np.array([q for q in (0, 1) for _ in rest[q]])
    model.slope, model.offset = _fit_curve(x, y)
    share = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    model.offset += math.log(share[1] / share[0])
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, held_out, score, predicted and the size difference, for every document."""

    def run(batches):
        packers = model.packers() if model.good and model.bad else None
        for batch in batches:
            difference = [model.difference((t or "").encode(), packers) for t in column(batch, "text").to_pylist()]
            scores = [model.score(d) for d in difference]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(difference, pa.float64())], names=["doc_id", "held_out", "score", "predicted", "difference"])

    rows = only(docs, doc_id="long", text="string").select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, difference double")


def accepted(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of ``docs``, all their columns, that the model takes for good.

    Each row is judged by its own text, whatever its doc_id: repeated rows and equal texts stay or go
    together. Null and empty texts are judged alike. An empty table gives no rows.
    """

    def run(batches):
        packers = model.packers() if model.good and model.bad else None
        for batch in batches:
            keep = [model.score(model.difference((t or "").encode(), packers)) >= 0.5 for t in column(batch, "text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
