"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram of a word (with its borders) and the event that a word repeats the one before has a learned vector, found by a
hash. A document is the average of the vectors of all its occurrences; a softmax layer over it gives the label. Both are trained by stochastic
gradient descent in numpy on a bounded sample. As the output is linear in the average, a trained bucket needs one number to score with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, texts

#: Labelled rows at most (the bound), passes over them, numbers in a vector, bits of a bucket.
SAMPLE_ROWS, PASSES, SIZE, BITS = 2500, 4, 8, 18
#: Lengths of n-grams; the step of the first pass, which falls to 0.
LENGTHS, STEP = (3, 4, 5), 2.0
#: Characters that are hashed at once: texts are taken together up to here, a longer one alone.
BLOCK_CHARS = 1 << 18
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_TOP = np.uint32(32 - BITS)


def held_out(doc_id="doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1. A null id is never held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def buckets(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each occurrence of a feature in these texts."""
    codes = np.frombuffer("".join(f" {x} " for x in block).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(block), dtype=np.int32), [len(x) + 2 for x in block])
    blank = (codes == 32) | (codes - np.uint32(9) < 5)
    codes = np.where(blank, np.uint32(32), codes)
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    found, whose = [], []
    if len(start):
        # words: a polynomial of the code points, by their places in the word
        letters = np.flatnonzero(~blank)
        size = end - start
        place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.full(int(size.max()), _MIX[1], np.uint32), dtype=np.uint32)
        word = np.add.reduceat((codes[letters] + np.uint32(1)) * power[place], np.cumsum(size) - size, dtype=np.uint32) ^ (size.astype(np.uint32) * _MIX[2])
        word = (word ^ (word >> np.uint32(16))) * _MIX[0]
        found.append(word >> _TOP)
        whose.append(owner[start])
        again = np.flatnonzero((word[1:] == word[:-1]) & (owner[start[1:]] == owner[start[:-1]]))
        found.append(np.zeros(len(again), np.uint32))
        whose.append(owner[start[again]])
    mixed = codes * _MIX[0]
    inner = np.zeros(len(codes), bool)  # whether a blank stands between the first and the last place of the n-gram
    for n in range(2, max(LENGTHS) + 1):
        if len(mixed) < 2:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MIX[1] + codes[n - 1 :] * _MIX[2]
        inner = inner[: len(mixed)] | blank[n - 2 : n - 2 + len(mixed)] if n > 2 else inner[: len(mixed)]
        if n in LENGTHS:
            good = np.flatnonzero(~inner)
            value = mixed[good]
            found.append(((value ^ (value >> np.uint32(13))) * _MIX[0]) >> _TOP)
            whose.append(owner[good])
    return np.concatenate(found), np.concatenate(whose)


def blocks(rows: list[str]):
    """(first, texts) of runs of rows with up to BLOCK_CHARS characters."""
    first, chars = 0, 0
    for k, text in enumerate(rows):
        if k > first and chars + len(text) > BLOCK_CHARS:
            yield first, rows[first:k]
            first, chars = k, 0
        chars += len(text)
    if first < len(rows):
        yield first, rows[first:]


@dataclass
class Model:
    bias: float
    value: np.ndarray  # of each bucket: its vector times the difference of the two output columns

    def scores(self, rows: list[str]) -> np.ndarray:
        total = np.zeros(len(rows))
        for first, block in blocks(rows):
            bucket, text = buckets(block)
            n = np.bincount(text, minlength=len(block))
            total[first : first + len(block)] = np.bincount(text, self.value[bucket], len(block)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, seed: int = 7) -> Model:
    """rows: distinct buckets and their shares (which sum to 1, or none) of each text. A text's step is divided by the sum of its squared shares, so
    that a long text, whose shares are small, moves its average as far as a short one. Buckets that no text has stay at 0."""
    seen = np.unique(np.concatenate([ids for ids, _ in rows])) if rows else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    value = np.zeros(1 << BITS, np.float32)
    bias = np.array([0.0, np.log(prior / (1 - prior))])
    if len(set(labels.tolist())) < 2:
        return Model(float(bias[1]), value)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (len(seen), SIZE)).astype(np.float32)
    out = rng.uniform(-1, 1, (SIZE, 2)).astype(np.float32)
    local = [(np.searchsorted(seen, ids), share.astype(np.float32)) for ids, share in rows]
    reach = [float(share @ share) for _, share in local]
    total, done = passes * len(rows), 0
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            ids, share = local[k]
            rate = STEP * (1 - done / total)
            done += 1
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            bias -= 0.1 * rate * p
            if len(ids):
                back = out @ p
                out -= 0.1 * rate * np.outer(hidden, p).astype(np.float32)
                vectors[ids] -= np.outer(share * np.float32(rate * 0.1 / reach[k]), back).astype(np.float32)
    value[seen] = vectors @ (out[:, 1] - out[:, 0])
    return Model(float(bias[1] - bias[0]), value)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows that are not held out, the lowest by a hash of the id. Rows with a null id, text or label teach
    nothing; of an id labelled twice, the larger label counts, and of an id with several texts each teaches. Texts are read whole, however long; an
    empty one teaches the bias. Other columns are ignored. Without rows every text scores 0.5; with one label alone, its share among the rows, kept off 0 and 1."""

    def features(batches):
        for batch in batches:
            ids, shares = [], []
            for text in texts(batch):
                bucket, n = np.unique(buckets([text])[0], return_counts=True)
                ids.append(bucket.astype(np.int32).tobytes())
                shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "quality", "ids", "shares"])

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(features, "doc_id long, quality int, ids binary, shares binary").orderBy(F.xxhash64("doc_id"), "doc_id", "ids", "shares").limit(sample_rows).collect()
    return fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows], np.array([r.quality for r in rows], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of each row; a null text scores as an empty one, equal texts score equally.

    An empty text, or one of blanks, has no feature and gets the bias alone. Repeated rows and null ids give a row each; whole texts are read, with about 40
    bytes of memory for each character of the longest; other columns, also one named `score`, are ignored; an empty table gives no rows."""
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(texts(batch)), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")
