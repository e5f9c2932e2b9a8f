"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of distinct character n-grams (n = 1 to 3, lower-cased) that
both hold, divided by the geometric mean of their own numbers; presence is kept in a hashed bit vector.
Nyström landmarks turn it into features, one-versus-rest kernel ridge regression into scores, and batches
of texts are scored by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, session, texts

#: Bits of a presence vector, landmarks, training rows (the bounded sample), ridge penalty.
DIM_BITS, LANDMARKS, SAMPLE_ROWS, RIDGE = 15, 64, 1500, 1e-3
DIM, UND, SCORE_ROWS = 1 << DIM_BITS, "und", 128
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L (Lu, Ll, Lt, Lm, Lo) is in the text; digits like ½ and ² are none."""
    return any(map(str.isalpha, text))


def presence(text: str, out: np.ndarray) -> None:
    """Set the bits of the text's n-grams in a vector of DIM zeros."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = codes * _MIX[0]
    for n in range(3):
        if len(mixed) == 0:
            return
        out[mixed >> np.uint32(32 - DIM_BITS)] = 1
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MIX[1] + codes[n + 1 :] * _MIX[2]


@dataclass
class Model:
    classes: list[str]
    landmarks: np.ndarray  # DIM x m presence columns, each divided by the root of its sum
    weights: np.ndarray  # m x classes, from kernel values to scores

    def scores(self, rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(rows.sum(1, dtype=np.float32), 1))[:, None]
        return (rows.astype(np.float32) @ self.landmarks / norm) @ self.weights


def fit(vectors: np.ndarray, langs: list[str]) -> Model | None:
    """Landmarks are spread evenly over the languages, in sample order. None without training rows."""
    classes = sorted(set(langs))
    if not classes:
        return None
    label = np.array([classes.index(x) for x in langs])
    turn = np.zeros(len(label), np.int64)
    for c in range(len(classes)):
        turn[label == c] = np.arange((label == c).sum())
    chosen = np.lexsort((label, turn))[:LANDMARKS]
    rows = vectors.astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
    marks = rows[chosen].T.copy()
    values, basis = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = basis[:, keep] / np.sqrt(values[keep])
    mapped = (rows @ marks) @ root
    wanted = np.where(label[:, None] == np.arange(len(classes)), 1.0, -1.0)
    share = np.bincount(label, minlength=len(classes)) / len(label)
    weight = (1 / (len(classes) * share))[label][:, None]
    ridge = np.linalg.solve(mapped.T @ (weight * mapped) + RIDGE * len(label) * np.eye(mapped.shape[1]), mapped.T @ (weight * wanted))
    return Model(classes, marks, (root @ ridge).astype(np.float32))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most sample_rows rows outside fold 0 whose lang is known, the lowest by a hash of the id."""

    def vectors(batches):
        for batch in batches:
            rows = np.zeros((len(batch), DIM), np.uint8)
            for text, row in zip(texts(batch), rows, strict=True):
                presence(text, row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([x.tobytes() for x in np.packbits(rows, axis=1)], pa.binary())], ["doc_id", "lang", "bits"])

    known = docs.where(F.col("lang").isNotNull() & (fold() != 0))
    wanted = known.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(sample_rows).select("doc_id").distinct()
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(wanted), "doc_id").mapInArrow(vectors, "doc_id long, lang string, bits binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bits").limit(sample_rows).collect()
    if not rows:
        return None
    return fit(np.unpackbits(np.stack([np.frombuffer(r.bits, np.uint8) for r in rows]), axis=1), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each input row with lang_pred and score added to doc_id, text and the columns in keep.

    A null text, or one without a letter, is `und` with score 0, as is every text where nothing was learned.
    Ties go to the first language in order. Repeated rows get equal answers, rows with a null id one each; texts are read
    whole; an empty table gives no rows. Other columns are ignored, also those named lang_pred or score; such names can't be in keep.
    """
    if {"doc_id", "text", "lang_pred", "score"} & set(keep):
        raise ValueError("keep names a column of the result")
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            got = texts(batch)
            langs, scores = [UND] * len(got), [0.0] * len(got)
            wanted = [i for i, x in enumerate(got) if own is not None and has_letter(x)]
            for at in range(0, len(wanted), SCORE_ROWS):
                part = wanted[at : at + SCORE_ROWS]
                rows = np.zeros((len(part), DIM), np.uint8)
                for i, row in zip(part, rows, strict=True):
                    presence(got[i], row)
                value = own.scores(rows)
                best = value.argmax(1)
                for i, k, v in zip(part, best.tolist(), value.max(1).tolist(), strict=True):
                    langs[i], scores[i] = own.classes[k], min(1.0, max(0.0, (v + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", lang_pred string, score double")
