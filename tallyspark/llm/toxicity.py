"""Toxicity classifier with counterfactual regularisation.

A logistic model over the distinct words of a text and the distinct beginnings of its words. Beside the loss on the labelled
rows, training penalises the squared change of a labelled text's own score when an identity term in it is swapped for others of its
group. A labelled text without any term stands for a neutral mention instead: a term is added to it, and swapped in the same way. So
the mere mention of a group moves no score, in whatever text it stands.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, session, texts

#: Rows of the bounded training sample, bits of a word's hash, words kept by their association with the label (1,000 and 4,000 did no better on held-out rows).
SAMPLE_ROWS, HASH_BITS, WORDS_KEPT = 4000, 22, 300
#: Lengths of the beginnings of words.
BEGINNINGS = (4, 5, 6)
#: Penalties on the weights and on counterfactual score changes; passes over the sample; other terms that a term is swapped for.
L2, SWAP, STEPS, OTHERS = 1e-4, 10.0, 400, 3
#: Identity terms by group, for swaps, in the languages of the corpus. A term stands in one group.
IDENTITY = {
    "gender": ["man", "woman", "men", "women", "male", "female", "trans", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"],
    "ethnicity": ["black", "white", "asian", "latino", "african", "european", "arab", "indian", "mexican"],
    "ability": ["deaf", "blind", "disabled", "autistic"],
    "age": ["old", "young", "elderly", "teenage"],
    "gender, German": ["mann", "frau", "männer", "frauen", "männlich", "weiblich"],
    "orientation, German": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
    "religion, German": ["christen", "muslime", "juden", "hindus", "buddhisten", "katholiken", "atheisten"],
    "ethnicity, German": ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "türken"],
    "gender, French": ["homme", "femme", "hommes", "femmes", "masculin", "féminin"],
    "orientation, French": ["gai", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    "religion, French": ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques", "athées"],
    "ethnicity, French": ["noirs", "blancs", "asiatiques", "africains", "européens", "arabes"],
    "gender, Spanish": ["hombre", "mujer", "hombres", "mujeres", "masculino", "femenino"],
    "orientation, Spanish": ["lesbiana", "bisexuales", "heterosexuales", "homosexuales"],
    "religion, Spanish": ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos", "ateos"],
    "ethnicity, Spanish": ["negros", "asiáticos", "africanos", "europeos", "árabes", "gitanos"],
}
GROUP = {term: group for group, terms in IDENTITY.items() for term in terms}
find_words = re.compile(r"[^\W\d_]+").findall


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - HASH_BITS)


def slots(word: str) -> set[int]:
    """The word's own place and those of its beginnings; identity terms have their own alone."""
    return {slot(word), *(slot(f"^{word[:n]}") for n in BEGINNINGS if len(word) >= n and word not in GROUP)}


def word_set(text: str) -> set[str]:
    return set(find_words(text.lower()))


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by a word's hash
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)  # a word's places that have a weight

    def score(self, text: str) -> float:
        found: set[int] = set()
        seen, weights = self.seen, self.weights
        if len(seen) > 300_000:
            seen.clear()
        for word in word_set(text):
            known = seen.get(word)
            if known is None:
                known = seen[word] = tuple(x for x in slots(word) if x in weights)
            if known:
                found.update(known)
        total = self.bias + sum(weights[x] for x in sorted(found))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def swaps(rows: list[np.ndarray]) -> np.ndarray:
    """(row, term, other, added) of the counterfactuals, by slots: each identity term of a labelled text with the next OTHERS of its
    group; for a text without any, a term added to it (the terms take turns) with the next of its group."""
    follow = {slot(t): [slot(terms[(i + k) % len(terms)]) for k in range(1, min(OTHERS, len(terms) - 1) + 1)] for terms in IDENTITY.values() for i, t in enumerate(terms)}
    terms = np.array(sorted(follow))
    turn = list(follow)
    out: list[tuple[int, int, int, int]] = []
    for k, row in enumerate(rows):
        own = np.intersect1d(row, terms).tolist()
        out += [(k, a, b, 0) for a in own for b in follow[a]] if own else [(k, turn[k % len(turn)], follow[turn[k % len(turn)]][0], 1)]
    return np.array(out, np.int64).reshape(-1, 4)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def penalty(w: np.ndarray, b: float, x: np.ndarray, swapped: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The mean squared change of the labelled texts' scores under swapped (row, column of the term, of the other, added), and its
    gradient by w and b. A text that holds the other term already only loses the first."""
    row, one, two, added = swapped.T
    new = 1.0 - x[row, two]
    z = x @ w.astype(x.dtype) + b
    before, after = sigmoid(z[row] + added * w[one]), sigmoid(z[row] - (1 - added) * w[one] + new * w[two])
    change = after - before
    up = 2 * change / max(1, len(row))
    down, up = up * before * (1 - before), up * after * (1 - after)
    grad = (x.T @ np.bincount(row, up - down, len(x)).astype(x.dtype)).astype(np.float64)
    np.add.at(grad, one, -(1 - added) * up - added * down)
    np.add.at(grad, two, new * up)
    return float((change**2).sum() / max(1, len(row))), grad, float((up - down).sum())


def fit(rows: list[np.ndarray], labels: np.ndarray, more: list[tuple[int, int, int, int]] = ()) -> Model:  # type: ignore[assignment]
    """rows: the slots of each labelled text; more: swaps (row, term, other, added) beside those of `swaps`."""
    prior = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    if len(set(labels.tolist())) < 2:
        return Model(float(np.log(prior / (1 - prior))), {})
    every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(labels, [len(x) for x in rows])
    found, at = np.unique(every, return_inverse=True)
    n1, n0 = labels.sum(), (1 - labels).sum()
    with1, with0 = np.bincount(at, owner, len(found)), np.bincount(at, 1 - owner, len(found))
    p1, p0, p = with1 / n1, with0 / n0, (with1 + with0) / len(labels)
    strength = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)) * ((with1 + with0) >= 3)
    swapped = np.concatenate([swaps(rows), np.array(more, np.int64).reshape(-1, 4)])
    kept = np.unique(np.concatenate([found[np.argsort(-strength, kind="stable")[:WORDS_KEPT]], swapped[:, 1], swapped[:, 2], [slot(t) for t in GROUP]]))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for k, row in enumerate(rows):
        i = np.searchsorted(kept, row)
        ok = (i < len(kept)) & (kept[np.minimum(i, len(kept) - 1)] == row)
        x[k, i[ok]] = 1
    swapped[:, 1:3] = np.searchsorted(kept, swapped[:, 1:3])
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    mean, squares = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        error = sigmoid(x @ w.astype(np.float32) + b) - labels
        _, by_w, by_b = penalty(w, b, x, swapped)
        grad = np.append(x.T @ error.astype(np.float32) / len(labels) + L2 * w + SWAP * by_w, error.mean() + SWAP * by_b)
        mean, squares = 0.9 * mean + 0.1 * grad, 0.99 * squares + 0.01 * grad**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {int(h): float(v) for h, v in zip(kept, w, strict=True) if abs(v) > 1e-4})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows outside fold 0, the lowest by a hash of the id. Rows with a null id,
    text or label teach nothing; of an id labelled twice, the larger label counts, and of an id with several texts each teaches. Texts are
    read whole, however long. Other columns are ignored. Without rows, or with one label alone, every text gets the same score."""

    def features(batches):
        for batch in batches:
            hashed = [np.array(sorted(set().union(*map(slots, word_set(text)))), np.int32).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(hashed, pa.binary())], ["doc_id", "toxic", "words"])

    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, toxic int, words binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "words").limit(sample_rows).collect()
    return fit([np.frombuffer(r.words, np.int32).astype(np.int64) for r in rows], np.array([r.toxic for r in rows], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row; a null text scores as an empty one, equal texts score equally.

    Repeated rows and null ids give a row each; whole texts are read; other columns, also one named `score`, are
    ignored; an empty table gives no rows."""
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(x) for x in texts(batch)], pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")
