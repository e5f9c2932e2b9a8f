"""Exact removal of repeated byte strings with suffix arrays.

Every string of `length` bytes is given to one of its own GRAM-byte pieces, the one with the least hash (the
leftmost of several). Equal strings choose equal pieces, so the piece's hash is a shard key: equal
strings meet in one shard, whatever documents they stand in, and only pieces seen twice matter. Neighbouring
strings with the same piece form one segment; segments with equal bytes are settled by comparing places
alone. Those that share a piece and differ are concatenated, shard by shard, and sorted: Larsson-Sadakane
refinement in numpy gives a suffix array, Kasai's rule the common prefixes, and of every run of
suffixes that agree in `length` bytes all but the earliest are marked. A key with very many different segments is
split into several shards by salt; the survivors of its shards are merged by binary search in
ranges of string hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, forget, raw, session, stored

LENGTH, GRAM = 100, 32
#: Bytes hashed in one go; different segments of a key that fill a shard; bytes of a suffix array.
CHUNK, SHARD_SEGMENTS, BLOCK_BYTES = 1 << 18, 512, 1 << 20

_RNG = np.random.Generator(np.random.PCG64(13))
_BYTE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(x) | 1 for x in _RNG.integers(1, 1 << 63, 2, dtype=np.uint64)]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = [powers(b, CHUNK + 256) for b in _BASE]
_DOWN = [powers(pow(b, -1, 1 << 64), CHUNK + 256) for b in _BASE]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a chunk, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * _UP[which][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _DOWN[self.which][start]

    def every(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * _DOWN[self.which][: len(self.sums) - width]


def segments(data: np.ndarray, owner_end: np.ndarray, length: int):
    """Start, number of strings, key and digest of each segment in a chunk. owner_end: the end of the text at each byte."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(data, 0)
    gram = mix(roll.every(GRAM))
    order = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    width = length - GRAM + 1  # pieces in a string
    least, have = order, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    piece = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.arange(len(piece))
    whole = at + length <= owner_end[: len(piece)]
    change = np.ones(len(piece), bool)
    change[1:] = (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1]) | (owner_end[1 : len(piece)] != owner_end[: len(piece) - 1])
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(piece)))
    start, count = start[whole[start]], count[whole[start]]
    return start, count, gram[piece[start]], mix(Rolling(data, 1).of(start, start + count + length - 1) + count.astype(np.uint64))


def scan(docs: DataFrame, length: int) -> DataFrame:
    """The segments of all texts: key, digest, doc_id, start, n. Of equal segments in a batch only the first by (doc_id,
    start) is a row; what the others cover is settled already and becomes one more row of the batch, under a key of its
    own, with the merged ranges as flat triples (doc_id, start, end) in `settled`."""

    def run(batches):
        for batch in batches:
            offsets, data = raw(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for at in range(0, max(1, len(data) - length + 1), CHUNK):
                stop = min(len(data), at + CHUNK + length - 1)
                cuts = offsets[(offsets > at) & (offsets < stop)]
                inside = np.concatenate([[at], cuts, [stop]])
                text_end = np.append(cuts, offsets[np.searchsorted(offsets, stop)])  # of the text of each stretch
                start, count, key, digest = segments(data[at:stop], np.repeat(text_end - at, np.diff(inside)), length)
                parts.append((start + at, count, key, digest))
            start, count, key, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.searchsorted(offsets, start, "right") - 1
            doc, start = ids[row], start - offsets[row]
            order = np.lexsort((start, doc, digest, key))
            doc, start, count, key, digest = doc[order], start[order], count[order], key[order], digest[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            rest = ~first
            known = intervals(doc[rest], start[rest], start[rest] + count[rest] + length - 1)
            triples = np.stack([c.to_numpy() for c in known.columns], 1).ravel()
            more = int(len(triples) > 0)
            n = int(first.sum())
            own = mix(np.array([ids[0] if len(ids) else 0, 0x5EED], np.int64).view(np.uint64))[:more]
            column = lambda x, fill: pa.array(np.append(x, np.full(more, fill, np.int64)))
            offsets_ = np.append(np.zeros(n + 1, np.int32), np.full(more, len(triples), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(key[first], own).view(np.int64)), column(digest[first].view(np.int64), 0), column(doc[first], 0), column(start[first].astype(np.int64), 0), column(count[first].astype(np.int64), 0), pa.ListArray.from_arrays(offsets_, pa.array(triples))],
                ["key", "digest", "doc_id", "start", "n", "settled"],
            )

    return docs.mapInArrow(run, "key long, digest long, doc_id long, start long, n long, settled array<long>")


# --- suffix arrays


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first `depth` bytes at least, and ranks by those. Larsson-Sadakane: the order by h bytes is
    refined to 2h, and only in groups that are not single yet."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes and the number of bytes there are, so that an end sorts before a zero byte
        word = (word << np.uint64(8)) | padded[k : n + k]
    word = (word << np.uint64(8)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    order = np.argsort(word)
    sorted_word = word[order]
    new = np.ones(n, bool)
    new[1:] = sorted_word[1:] != sorted_word[:-1]
    # a group's rank is the place of its last member
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(stops - 1, stops - starts)
    h = 7
    while h < depth:
        single = np.zeros(n, bool)
        single[starts[stops - starts == 1]] = True
        open_ = np.flatnonzero(~single)
        if len(open_) == 0:
            break
        who = order[open_]
        group = rank[who]
        nxt = rank[np.minimum(who + h, n)]
        sub = np.argsort(group * (n + 1) + nxt + 1)
        who, group, nxt = who[sub], group[sub], nxt[sub]
        order[open_] = who
        head = np.ones(len(open_), bool)
        head[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        new[open_] = head
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], n)
        rank[order] = np.repeat(stops - 1, stops - starts)
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to `most`) that each suffix shares with the one before it in order. Kasai: at the next place of the text the
    value falls by one, as long as the neighbour moves on by one too and the bytes just passed are equal (after unequal ones
    the value was 0 and says nothing); elsewhere, and at `heads`, bytes are compared.
    Exact at up to `most` minus the distance to the last head."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    compare = np.ones(n, bool)
    compare[1:] = (before[1:] != before[:-1] + 1) | (data[:-1] != data[before[1:] - 1])
    compare |= before <= 0
    compare[heads] = True
    live = np.flatnonzero(compare & (before >= 0))
    value = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : n + k]
    at = 0
    while len(live) and at < most:  # eight bytes at a time, then the bytes of the first word that differs
        a, b = live + at, before[live] + at
        inside = (a + 8 <= n) & (b + 8 <= n)
        differ = word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)]
        same = inside & (differ == 0)
        part = ~same
        d = differ[part]
        bytes_ = np.full(len(d), 8, np.int64)
        for k in range(8):  # leading equal bytes
            bytes_ = np.minimum(bytes_, np.where((d >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0, k, 8))
        limit = n - np.maximum(a[part], b[part])
        value[live[part]] = at + np.minimum(bytes_, np.maximum(limit, 0))
        live = live[same]
        at += 8
        value[live] = at
    known = np.flatnonzero(compare)
    place = np.arange(n)
    source = known[np.searchsorted(known, place, "right") - 1]
    return np.maximum(value[source] - (place - source), 0)[order]


def repeated(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of `length` bytes in these segments: segment, offset in it, and whether an equal string stands earlier by (doc, place)."""
    sizes = np.array([len(x) for x in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = suffix_array(data, length)
    shared = common_prefixes(data, order, begin[:-1], int(sizes.max()) + length)
    owner = np.repeat(np.arange(len(texts)), sizes)[order]
    offset = order - begin[owner]
    valid = offset + length <= sizes[owner]
    group = np.cumsum(shared < length)  # suffixes that share `length` bytes are neighbours
    group, owner, offset = group[valid], owner[valid], offset[valid]
    sub = np.lexsort((start[owner] + offset, doc[owner], group))
    group, owner, offset = group[sub], owner[sub], offset[sub]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    return owner, offset, later


def intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The union of [start, end) in each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc) == 0:
        cut = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cut)] * 3, ["doc_id", "start", "end"])
    # ends only grow within a document once a document's base is added
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    number = np.cumsum(fresh) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * span)
    cut = fresh.copy()
    cut[1:] |= (start + number * span)[1:] > reach[:-1]
    heads = np.flatnonzero(cut)
    last = np.append(heads[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(start[heads]), pa.array(reach[last] - number[last] * span)], ["doc_id", "start", "end"])


SPANS = "doc_id long, start long, end long"


def settled(kept: DataFrame, length: int) -> DataFrame:
    """Spans of segments whose bytes stand earlier as a whole."""

    def run(batches):
        for batch in batches:
            later = ~batch.column("first").to_numpy(zero_copy_only=False)
            doc, start, n = (batch.column(c).to_numpy(zero_copy_only=False)[later] for c in ("doc_id", "start", "n"))
            more = batch.column("settled").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            yield intervals(np.append(doc, more[:, 0]), np.append(start, more[:, 1]), np.append(start + n + length - 1, more[:, 2]))

    return kept.select("first", "doc_id", "start", "n", "settled").mapInArrow(run, SPANS)


def shard_results(pieces: DataFrame, length: int) -> DataFrame:
    """Per-shard suffix arrays over (key, salt, doc_id, start, bytes), sorted by key and salt in each partition: spans of
    strings that stand earlier in their shard, and, for salted keys, the other strings as (h1, h2, doc_id, start)."""

    def solve(rows):
        texts = [r[4] for r in rows]
        doc, start = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        owner, offset, later = repeated(texts, doc, start, length)
        d, s = doc[owner[later]], start[owner[later]] + offset[later]
        spans = intervals(d, s, s + length)
        salted = np.array([r[1] >= 0 for r in rows])[owner] & ~later
        h = [[int.from_bytes(hashlib.blake2b(texts[o][f : f + length], digest_size=16).digest()[k : k + 8], "little", signed=True) for k in (0, 8)] for o, f in zip(owner[salted].tolist(), offset[salted].tolist(), strict=True)]
        h = np.array(h, np.int64).reshape(-1, 2)
        n, m = len(spans), len(h)
        none = pa.nulls(n, pa.int64())
        columns = [pa.concat_arrays([none, pa.array(h[:, k])]) for k in (0, 1)]
        columns += [pa.concat_arrays([spans.column(0), pa.array(doc[owner[salted]])]), pa.concat_arrays([spans.column(1), pa.array(start[owner[salted]] + offset[salted])]), pa.concat_arrays([spans.column(2), pa.nulls(m, pa.int64())])]
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "start", "end"])

    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "doc_id", "start", "bytes")), strict=True):
                if held >= BLOCK_BYTES and row[:2] != last:
                    yield solve(rows)
                    rows, held = [], 0
                last = row[:2]
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)

    return pieces.mapInArrow(run, "h1 long, h2 long, doc_id long, start long, end long")


def merged(survivors: DataFrame, length: int) -> DataFrame:
    """Spans of survivors whose string another shard of the same key has earlier. Rows come sorted by (h1, h2, doc_id,
    start); in each batch the first place of every string is found by binary search, and the last string is carried on."""

    def run(batches):
        carried = None
        for batch in batches:
            h1, h2, doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "start"))
            if len(h1) == 0:
                continue
            name = np.empty(len(h1), [("a", np.int64), ("b", np.int64)])
            name["a"], name["b"] = h1, h2
            runs = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            first = runs[np.searchsorted(runs, np.arange(len(name)), "right") - 1]
            later = first < np.arange(len(name))
            if carried is not None and carried == (h1[0], h2[0]):
                later |= first == 0
            carried = (h1[-1], h2[-1])
            yield intervals(doc[later], start[later], start[later] + length)

    # a string's survivors, one from each shard of its key at most, stay together
    return survivors.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "start").mapInArrow(run, SPANS)


def cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (key, salt, doc_id, start, n)."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "salt", "start", "n")).alias("list"))

    def run(batches):
        for batch in batches:
            keys, salts, ids, starts, out = [], [], [], [], []
            for doc, body, rows in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), batch.column("list").to_pylist(), strict=True):
                for r in rows:
                    keys.append(r["key"])
                    salts.append(r["salt"])
                    ids.append(doc)
                    starts.append(r["start"])
                    out.append(body[r["start"] : r["start"] + r["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(salts, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(out, pa.binary())], ["key", "salt", "doc_id", "start", "bytes"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).join(by_doc, "doc_id").mapInArrow(run, "key long, salt long, doc_id long, start long, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans): byte ranges [start, end) of each document that a string of `length` bytes covers which also starts earlier,
    merged and ascending; documents without any have no row. Ids are distinct and not null, texts not null."""
    kept = scan(docs, length)
    by_key = Window.partitionBy("key")
    kept = kept.withColumn("rows", F.count("*").over(by_key)).where((F.col("rows") > 1) | (F.size("settled") > 0))
    kept = kept.withColumn("first", F.row_number().over(Window.partitionBy("key", "digest").orderBy("doc_id", "start")) == 1)
    kept = kept.withColumn("kinds", F.sum(F.col("first").cast("long")).over(by_key))
    kept = stored(kept.select("key", "digest", "doc_id", "start", "n", "settled", "first", "kinds"), "segments", PIECE)
    shards = F.ceil(F.col("kinds") / SHARD_SEGMENTS)
    salt = F.when(F.col("kinds") > SHARD_SEGMENTS, F.pmod(F.xxhash64("digest"), shards)).otherwise(F.lit(-1))
    wanted = kept.where("first and kinds > 1").select("key", salt.cast("long").alias("salt"), "doc_id", "start", "n")
    pieces = cut(docs, wanted, length).repartition("key", "salt").sortWithinPartitions("key", "salt")
    solved = stored(shard_results(pieces, length), "shards")
    spans = solved.where("end is not null").select("doc_id", "start", "end")
    survivors = solved.where("end is null").select("h1", "h2", "doc_id", "start")
    every = settled(kept, length).unionByName(spans).unionByName(merged(survivors, length))

    def union(batches):
        for batch in batches:
            out = []
            for rows in batch.column("list").to_pylist():
                a = np.array([(r["start"], r["end"]) for r in rows], np.int64)
                got = intervals(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])
                out.append([{"start": s, "end": e} for s, e in zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    found = every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("list")).mapInArrow(union, "doc_id long, spans array<struct<start:long,end:long>>")
    found = stored(found, "spans")
    forget(docs.sparkSession, kept, solved)
    return found


def alone(docs: DataFrame) -> DataFrame | None:
    """Ids that several rows bear, with the least hash of their texts; None where there are none."""
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return None
    return stored(docs.join(twice, "doc_id").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least")), "repeated-ids")


def deduplicated(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, body (UTF-8 bytes), spans (null: none) and the columns in keep of every row; spans are the byte ranges to remove.

    Places are bytes of the input, whatever is removed elsewhere. A null text is an empty one. Rows that
    repeat an id with the same text are one document and get the same spans; of different texts
    under one id the one with the least hash counts, and the others, like rows with a null id, keep all bytes
    and are not looked at. Other columns are ignored; an empty table gives no rows; whole texts are read.
    """
    session(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    ids, rest = own.where("doc_id is not null"), own.where("doc_id is null")
    repeats = alone(own)
    one = ids.select("doc_id", "text")
    if repeats is not None:
        marked = ids.join(repeats, "doc_id", "left").withColumn("_chosen", F.coalesce(F.xxhash64("text") == F.col("least"), F.lit(True))).drop("least")
        ids, rest = marked.where("_chosen").drop("_chosen"), rest.union(marked.where("not _chosen").drop("_chosen"))
        one = ids.select("doc_id", "text").dropDuplicates(["doc_id"])
    spans = repeated_spans(one, length)
    columns = ["doc_id", F.col("text").cast("binary").alias("body"), "spans", *keep]
    judged = ids.join(spans, "doc_id", "left").select(*columns)
    return judged if rest.isEmpty() else judged.union(rest.withColumn("spans", F.lit(None).cast("array<struct<start:long,end:long>>")).select(*columns))


def summary(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, body, spans in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                digest, at, gone = hashlib.sha256(), 0, 0
                for r in spans or []:
                    digest.update(body[at : r["start"]])
                    at, gone = r["end"], gone + r["end"] - r["start"]
                digest.update(body[at:])
                out.append((doc, len(body), gone, len(spans or []), digest.hexdigest()))
            kinds = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(body: bytes, spans) -> str:
    """What is left as text: a removed range gives back the bytes of characters that it only cuts into."""
    out, at = [], 0
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(body[at:a])
            at = b
    return b"".join([*out, body[at:]]).decode("utf-8", "replace")


def remaining(body: Column, spans: Column) -> Column:
    """The text that is left of the bytes without the spans."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([kept_text(b, [] if s is None else list(zip(s, e, strict=True))) for b, s, e in zip(bodies, starts, ends, strict=True)], dtype=object)

    return run(body, spans.getField("start"), spans.getField("end"))
