"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest piece, from where the last one
ended, that is no phrase yet. The set of phrases is hashed, and SIZE minimum hashes are its signature;
the share of equal places in two signatures estimates the likeness of the sets, which is high where the
texts compress alike.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, texts

#: Minimum hashes in a signature; documents in a range of ids (the unit of work that is dealt out). Beyond MOST_RANGES ranges, which bounds
#: the list of borders, a range holds more; it is read as a stream all the same.
SIZE, RANGE_ROWS, MOST_RANGES = 64, 2000, 100_000
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
NONE = np.full(SIZE, 0xFFFFFFFF, np.uint32)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(text: str, known: set[str] | None = None) -> set[str]:
    """Distinct phrases of a parse, which goes on from those already known."""
    known = set() if known is None else known
    begin, add = 0, known.add
    for end in range(1, len(text) + 1):
        piece = text[begin:end]
        if piece not in known:
            add(piece)
            begin = end
    return known


def minima(found: list[str]) -> np.ndarray:
    """The least of each of SIZE hashes over the phrases."""
    if not found:
        return NONE
    keys = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in found), np.uint64, len(found))
    out = NONE
    for at in range(0, len(keys), 1024):
        part = keys[None, at : at + 1024] * np.uint64(0x9E3779B97F4A7C15)
        out = np.minimum(out, ((_A[:, None] * (part ^ (part >> np.uint64(29))) + _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(1))
    return out


def signature(text: str) -> np.ndarray:
    return minima(list(phrases(text)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def both(text: str, other: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The signature of a text, its edited text (the last half replaced by as many first characters of the
    other, or all it has) and that text's signature. Both parses share the first half."""
    half = len(text) // 2
    start, new = text[: len(text) - half], other[:half]
    first = phrases(start)
    shared = minima(list(first))
    rest = len(start) - sum(map(len, first))  # the unfinished phrase goes on in either second half
    signs = []
    for tail in (text[len(start) :], new):
        own = phrases(start[len(start) - rest :] + tail, set(first))
        signs.append(np.minimum(shared, minima(list(own - first))))
    return signs[0], start + new, signs[1]


def ranges(docs: DataFrame, rows: int) -> list[int]:
    """Borders between ranges of about `rows` ids each; at most MOST_RANGES numbers come to the driver."""
    count = docs.count()
    parts = min(MOST_RANGES, count // rows)
    if parts < 2:
        return []
    return sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (20 * parts))})


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness (and that to the next document).

    The next document is the one with the next smaller doc_id, and after the last the first. Rows are dealt
    out by ranges of ids, a partition each; each range also gets the first document of the next, so no row looks beyond its own. A null text
    is an empty one; an empty text has no phrases and is as like another empty one as can be. Of rows that repeat
    an id, the order is by text; each gets a row. Rows with a null id have no place in the order: each one's next document is the first
    (an empty text where there is none). Other columns are ignored; an empty table gives no rows; whole texts are read.
    """
    spark = session(docs.sparkSession)
    own = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    borders = ranges(own.where("doc_id is not null").select("doc_id"), range_rows)
    at = np.array(borders, np.int64)
    count = len(at) + 1

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(), "right").astype(np.int32))

    nameless = own.where("doc_id is null").count()
    groups = min(MOST_RANGES, nameless // range_rows + 1) if nameless else 0
    heads = own.where("doc_id is not null").select("doc_id", range_of("doc_id").alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).orderBy(F.desc("part")).collect()
    # the range that comes before each in descending order borrows its first document; the last range, and rows without an id, that of the first
    borrow = [(r.part, r.head, heads[i - 1].part, 1) for i, r in enumerate(heads)]
    borrow += [(heads[0].part, heads[0].head, count + k, -1) for k in range(groups)] if heads else []
    known = F.when(F.col("doc_id").isNotNull(), range_of(F.coalesce("doc_id", F.lit(0))))
    own = own.withColumn("part", F.coalesce(known, F.lit(count) + F.pmod(F.xxhash64("text"), F.lit(max(1, groups)))).cast("int"))
    again = own.join(F.broadcast(spark.createDataFrame(borrow, "part int, head long, taker int, borrowed int")), "part")
    again = again.where("doc_id = head").groupBy("taker", "borrowed").agg(F.max(F.struct("doc_id", "text")).alias("d"))
    dealt = own.select("part", F.lit(0).alias("borrowed"), "doc_id", "text").union(again.select("taker", "borrowed", "d.doc_id", "d.text"))
    dealt = dealt.repartitionById(count + groups, F.col("part")).sortWithinPartitions("part", "borrowed", F.desc("doc_id"), F.desc("text"))

    def run(batches):
        first, sign_first = "", NONE  # the first document of all, for rows without an id; it is borrowed before them
        waiting = None  # part, doc_id, text of the row whose next one is still to come
        pending = None  # a finished row that lacks the likeness to the next document
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

        def done(row, after):
            doc, text, edited, sign, other = row
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), sign.tobytes().hex(), other.tobytes().hex(), likeness(sign, other), likeness(sign, after)

        for batch in batches:
            out = []
            for part_, borrowed, doc, text in zip(*(batch.column(n).to_pylist() for n in ("part", "borrowed", "doc_id")), texts(batch), strict=True):
                if borrowed < 0:
                    first, sign_first = text, signature(text)
                    continue
                if doc is None:
                    sign, edited, other = both(text, first)
                    out.append(done((doc, text, edited, sign, other), sign_first))
                    continue
                if waiting is not None and waiting[0] == part_:
                    sign, edited, other = both(waiting[2], text)
                    if pending is not None:
                        out.append(done(pending, sign))
                    pending = waiting[1], waiting[2], edited, sign, other
                if borrowed:
                    if pending is not None:
                        out.append(done(pending, signature(text)))
                    waiting = pending = None
                else:
                    waiting = part_, doc, text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return dealt.mapInArrow(run, RESULT)
