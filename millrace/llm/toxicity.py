"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Per-coordinate learning rates and L1 keep the weights sparse, so they can be broadcast: at most ``2**BITS``
of them, whatever the corpus. The model is fitted on a bounded sample of labelled rows (``max_rows``, the
smallest hashes of their ids, and at most twice as many different texts of them: one of each id, then those with
the smallest hashes); it then scores every whole text. Without a labelled row every score is 0.

Null texts are scored as empty ones, very long texts whole. Labels of a repeated id count once (the larger one). Null
labels and null ids are not learnt from. Repeated documents are scored each; equal rows of an id are learnt from once. Without
documents there is no row. Columns besides pass through; one named like the score is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, bucket, discard, given_back, map_columns, saved, with_columns

BITS = 20
#: labelled rows that the model is fitted on, at most
MAX_ROWS = 8_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


class Features:
    """Sorted distinct feature numbers of a text: words, pairs of neighbours, pairs with one word between."""

    def __init__(self, remembered: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").translate(ALNUM).split()
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        h = np.empty(len(words), dtype=np.uint64)
        h[:] = [known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
        parts = [h * _A >> _SHIFT, (h[:-1] * _B + h[1:] * _A) * _C >> _SHIFT, (h[:-2] * _C + h[2:] * _B) * _A >> _SHIFT]
        return np.unique(np.concatenate(parts)).astype(np.int32)


@dataclass
class Model:
    """Weights that are not 0, by feature number."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.index] = self.weight
        return out


def ftrl(rows, labels, *, alpha=1.0, beta=1.0, l1=6.0, l2=0.1, epochs=6, seed=7) -> Model:
    """``rows`` are arrays of feature numbers (each feature counts once), ``labels`` are 0 or 1."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, without L1
    if not len(rows):
        return Model(np.empty(0, np.int32), np.empty(0, np.float32), 0.0, False)
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        keep = np.where(i == size, 0.0, l1)
        w = -(zi - np.sign(zi) * keep) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= keep, 0.0, w)

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            i = np.append(rows[k], size)
            w = weights(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
            g = p - labels[k]
            grown = np.sqrt(n[i] + g * g)
            z[i] += g - (grown - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size])
    return Model(index.astype(np.int32), w[index].astype(np.float32), float(w[size]), True)


def fit(df: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic", folds=5, max_rows=MAX_ROWS) -> Model:
    """Learns from labelled rows outside fold 0 (crc32 of the id as text, modulo ``folds``)."""
    chosen = (
        labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (bucket("_id", folds) != 0))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # at most max_rows ids, so this side may be broadcast
    known = df.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")

    def start():
        features = Features()

        def work(ids, texts, ys):
            rows = [features(t).tobytes() for t in texts]
            return [ids, rows, ys, [xxhash.xxh3_64_intdigest(r) >> 1 for r in rows]]

        return work

    texts = map_columns(known, ["_id", "_t", "_y"], "id long, x binary, y int, h long", start)
    texts = saved(texts.groupBy("id", "h").agg(F.first("x").alias("x"), F.first("y").alias("y")), "sample")
    # at most max_rows rows
    least = texts.groupBy("id").agg(F.min("h").alias("least"))
    # an id may stand on any number of rows: the bound holds before they go to the driver
    got = texts.join(F.broadcast(least), "id").orderBy(F.col("h") != F.col("least"), "h", "id").limit(2 * max_rows).drop("least")
    with given_back():
        model = _learnt(got.toArrow().combine_chunks().sort_by([("id", "ascending"), ("h", "ascending")]))
    discard(texts)
    return model


def _learnt(sample: pa.Table) -> Model:
    """Rows are views of the table's own memory: it is held once."""
    rows: list[np.ndarray] = []
    for chunk in sample["x"].chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        whole = np.frombuffer(data or b"", dtype=np.int32)
        rows += [whole[i // 4 : j // 4] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    return ftrl(rows, sample["y"].to_pylist())


def score(df: DataFrame, model: Model, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Adds ``output``, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        w, f, bias, trained = shared.value.dense(), Features(), shared.value.bias, shared.value.trained

        def work(texts):
            if not trained:
                return [pa.array(np.zeros(len(texts)))]
            logits = np.array([float(w[f(t)].sum(dtype=np.float64)) + bias for t in texts], dtype=np.float64)
            return [pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))]

        return work

    return with_columns(df, text, f"`{output}` double", start)


def judged(df: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(df.select("doc_id", "text"), fit(df, labels))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (bucket("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
