"""Near-duplicate documents by min-max hashing, exact confirmation and connected components.

Of every permutation both the least and the greatest hash of a document's shingle set are kept, so half as
many hashes give a signature; bands of the signature make candidates. Documents with equal sets are one class
from the start, and only its least document goes on. No pairs are listed within a bucket. Each document is first compared with the
hub (the least document) of the buckets that it shares most of; that makes a forest, whose roots join most of a group. Then only buckets
that hold several roots are looked at again, in blocks of bounded size: first on sketches, then on full sets where a link is
possible. So no link that joins two components is lost, and every link is confirmed on full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import PIECE, counted, forget, raw, session, stored

#: Permutations; a signature has twice as many values.
PERMUTATIONS = 80
#: A pair is not confirmed if its estimated similarity is this far below the threshold (seven standard errors).
SLACK = 0.2
#: Bytes of text hashed in one go.
PART_BYTES = 1 << 19
#: Queries and members in a block of texts; a block of sketches holds FINE times as many of each.
QUERIES, MEMBERS, FINE = 128, 512, 2

_RNG = np.random.Generator(np.random.PCG64(11))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_ORDER = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PERM = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, 2 * PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; documents link where parts * |intersection| >= share * |union|."""

    words: int = 5
    share: int = 80
    parts: int = 100

    @property
    def rows(self) -> int:
        """Values in a band: a linked pair shares none of the bands with a probability under 1e-8."""
        return 5 if self.share * 100 >= 85 * self.parts else 4


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased, cut at ASCII white space), and where each text's words begin."""
    is_word = _WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = is_word[heads]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    value = _BYTE[_LOWER[data]] * _PLACE[place & 0xFFFF] * (2 * (place >> 16) + 1).astype(np.uint64)
    value[~is_word] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words has none.
    Texts are taken in stretches of about PART_BYTES, so that the arrays stay small whatever a batch holds."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        out += part_sets(offsets[at : stop + 1] - offsets[at], data[offsets[at] : offsets[stop]], words)
        at = stop
    return out


def part_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    hashes, first = word_hashes(offsets, data)
    joined = hashes * _ORDER[0]
    for k in range(1, words):
        joined[:-k] += hashes[k:] * _ORDER[k]
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(keys: np.ndarray) -> np.ndarray:
    """The least and the greatest value of a set under each permutation."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(keys), 2048):
        h = ((_PERM[:, None] * keys[None, at : at + 2048]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, size of the set, 128 bits that name the set, band keys, and a byte of each signature value."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*raw(batch), rule.words)
            sign = np.stack([signature(x) for x in sets]) if sets else np.zeros((0, 2 * PERMUTATIONS), np.uint32)
            bands = (sign.astype(np.uint64) * _BAND).reshape(len(sets), -1, rule.rows).sum(2, dtype=np.uint64)
            bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            names = np.array([[mix(x).sum(dtype=np.uint64), mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            keys = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, max(1, bands.shape[1])).astype(np.int32), pa.array(bands.ravel()))
            small = [x.tobytes() for x in (sign & 0xFF).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), keys, pa.array(small, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sign"])

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sign binary")


def forest(parents: DataFrame) -> DataFrame:
    """(id, root) for every id of a stored forest (id, parent): pointers are doubled until no parent has one of its own.
    Each round is a table in the shared folder; whether it moved anything is counted as it is written."""
    at = parents
    while True:
        moves = Observation()
        longer = at.join(at.selectExpr("id parent", "parent next"), "parent", "left").observe(moves, F.count("next").alias("n"))
        last, at = at, stored(longer.select("id", F.coalesce("next", "parent").alias("parent")), "forest", PIECE)
        if last is not parents:
            forget(at.sparkSession, last)
        if not moves.get["n"]:
            out = at.selectExpr("id", "parent root")
            out.stored_at = at.stored_at
            return out


def components(links: DataFrame) -> DataFrame:
    """(id, root) of the ids in links (a, b) that are not the least of their component.

    Every id hooks to the least smaller id that it is linked with; the roots of that forest take the ids' places in the links,
    and so on until no link between two roots is left. Least ids are found by partial aggregation and joins read stored tables on both
    sides, so that an id with very many links is split at run time."""
    spark = links.sparkSession
    edges = counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    known = None
    while True:
        parents = counted(edges.groupBy("u").agg(F.min("v").alias("parent")).withColumnRenamed("u", "id"), "parents")
        tree = forest(parents)
        if known is None:
            known = tree
        else:
            deeper = known.join(tree.selectExpr("id root", "root deeper"), "root", "left").select("id", F.coalesce("deeper", "root").alias("root"))
            last, known = known, stored(deeper.union(tree), "components", PIECE)
            forget(spark, last, tree)
        whole = edges.stored_rows == parents.stored_rows  # one link of each id, and all of them followed
        last = edges
        if not whole:
            moved = edges.join(known.selectExpr("id u", "root ru"), "u", "left").join(known.selectExpr("id v", "root rv"), "v", "left")
            moved = moved.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v")
            edges = counted(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        forget(spark, parents, last)
        if whole or not edges.stored_rows:
            if not whole:
                forget(spark, edges)
            out = known.select("id", "root")
            out.stored_at = known.stored_at
            return out


def confirmed(pairs: DataFrame, words: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (id, parent) whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = [similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), rule) for x, y in zip(shingle_sets(*raw(batch, "ta"), rule.words), shingle_sets(*raw(batch, "tb"), rule.words), strict=True)]
            yield batch.select(["id", "parent"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(words.selectExpr("doc_id id", "text ta"), "id").join(words.selectExpr("doc_id parent", "text tb"), "parent")
    return both.select("id", "parent", "ta", "tb").mapInArrow(run, "id long, parent long").distinct()


def similar(shared, one, two, rule: Rule):
    return (shared > 0) & (rule.parts * shared >= rule.share * (one + two - shared))


def overlaps(queries: list[np.ndarray], members: list[np.ndarray], most: int = 1_000_000) -> np.ndarray:
    """Sizes of the intersections, members x queries: an index of the queries' shingles, probed by the members in turn."""
    keys = np.concatenate(queries) if queries else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    out = np.zeros((len(members), len(queries)), np.int64)
    at = 0
    while at < len(members):
        stop, held = at, 0
        while stop < len(members) and (stop == at or held + len(members[stop]) * len(queries) <= most):
            held += len(members[stop]) * len(queries)
            stop += 1
        part = np.concatenate(members[at:stop])
        row = np.repeat(np.arange(stop - at), [len(x) for x in members[at:stop]])
        low = np.searchsorted(keys, part)
        n = np.searchsorted(keys, part, "right") - low
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[at:stop] = np.bincount(np.repeat(row, n) * len(queries) + owner[hit], minlength=(stop - at) * len(queries)).reshape(stop - at, -1)
        at = stop
    return out


def blocks(batches, columns: tuple[str, ...], parse):
    """The rows of each block of sorted batches as (key, rows): a key is (family, q, m); a row is what parse makes of a batch
    for it, after its side."""
    now, held = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("family", "q", "m")), strict=True)
        for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in columns), parse(batch), strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def batch_of(rows: list[tuple], columns: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


FINER = "family long, q long, m long, side long, doc_id long, root long"


def possible(rows: DataFrame, rule: Rule) -> DataFrame:
    """Blocks of sketches (family, q, m, side, part, doc_id, root, n_shingles, sign), sorted: the members of their finer blocks
    that have a partner there of another root whom sizes and signatures allow to be a link."""
    least = rule.share / rule.parts - SLACK

    def solve(key, held):
        family, q, m = key
        sides = [[r for r in held if r[0] == side] for side in (0, 1)]
        if not all(sides):
            return
        part, doc, root, size = ([np.array([r[k] for r in side]) for side in sides] for k in (1, 2, 3, 4))
        sign = [np.frombuffer(b"".join(r[5] for r in side), np.uint8).reshape(len(side), -1) for side in sides]
        able = np.zeros((len(sides[0]), len(sides[1])), bool)
        for at in range(0, len(sides[0]), 16):
            same = (sign[0][at : at + 16, None] == sign[1][None]).mean(2, dtype=np.float32)
            able[at : at + 16] = (same - 1 / 256) / (1 - 1 / 256) >= least
        able &= root[0][:, None] != root[1]
        able &= rule.parts * np.minimum(size[0][:, None], size[1]) >= rule.share * np.maximum(size[0][:, None], size[1])
        for x in np.unique(part[0]):
            for y in np.unique(part[1]):
                i, j = np.flatnonzero(part[0] == x), np.flatnonzero(part[1] == y)
                block = able[np.ix_(i, j)]
                for side, who in ((0, i[block.any(1)]), (1, j[block.any(0)])):
                    for k in who.tolist():
                        yield family, q * FINE + int(x), m * FINE + int(y), side, int(doc[side][k]), int(root[side][k])

    def run(batches):
        for key, held in blocks(batches, ("side", "part", "doc_id", "root", "n_shingles"), lambda b: b.column("sign").to_pylist()):
            yield batch_of(list(solve(key, held)), FINER)

    return rows.mapInArrow(run, FINER)


def linked(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between roots from blocks of texts (family, q, m, side, doc_id, root, text), sorted: for each query one with every root
    that it is linked with in a block."""

    def solve(held):
        sides = [[r for r in held if r[0] == side] for side in (0, 1)]
        if not all(sides):
            return
        count = overlaps([r[2] for r in sides[0]], [r[2] for r in sides[1]])
        sizes = [np.array([len(r[2]) for r in side]) for side in sides]
        roots = [np.array([r[1] for r in side]) for side in sides]
        found = similar(count, sizes[1][:, None], sizes[0][None], rule) & (roots[1][:, None] != roots[0][None])
        m, q = np.nonzero(found)
        yield from {(int(roots[0][j]), int(roots[1][i])) for i, j in zip(m, q, strict=True)}

    def run(batches):
        for _, held in blocks(batches, ("side", "root"), lambda b: shingle_sets(*raw(b), rule.words)):
            yield batch_of(list(solve(held)), "a long, b long")

    return rows.select("family", "q", "m", "side", "root", "text").mapInArrow(run, "a long, b long")


def across(members: DataFrame, roots: DataFrame, classes: DataFrame, words: DataFrame, rule: Rule) -> DataFrame | None:
    """Links (a, b) between different roots; None where there are none.

    Only buckets with several roots can hide such a link. Roots that meet in these buckets make a family; the documents outside a family's
    largest root are the queries that meet the whole family, in blocks of bounded size: first on sketches, then, in
    blocks where a link is possible, on full sets. Blocks return which documents take part, then links, but no list of pairs."""
    spark = members.sparkSession
    rooted = members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rooted = stored(rooted, "rooted", PIECE)
    several = counted(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "low"), "several")
    if not several.stored_rows:
        forget(spark, rooted, several)
        return None
    held = stored(rooted.join(several, "key").select("doc_id", "root", "low").distinct(), "held", PIECE)
    families = components(held.where("root <> low").selectExpr("root a", "low b"))
    at = held.select("doc_id", "root").distinct().join(families.selectExpr("id root", "root family"), "root", "left").select("doc_id", "root", F.coalesce("family", "root").alias("family"))
    at = stored(at, "families", PIECE)
    parts = at.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("inside"))
    parts = stored(parts.select("family", "main", F.ceil((F.col("size") - F.col("inside")) / (QUERIES * FINE)).alias("qs"), F.ceil(F.col("size") / (MEMBERS * FINE)).alias("ms")), "shares", PIECE)
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sketch = at.join(parts, "family").join(classes.select("doc_id", "n_shingles", "sign"), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FINE)))
    columns = ("side", "part", "doc_id", "root", "n_shingles", "sign")
    asked = sketch.where("root <> main").withColumn("side", F.lit(0)).select("family", block("qs").alias("q"), spread("ms").alias("m"), *columns)
    all_ = sketch.withColumn("side", F.lit(1)).select("family", spread("qs").alias("q"), block("ms").alias("m"), *columns)
    able = counted(possible(asked.union(all_).repartition("family", "q", "m").sortWithinPartitions("family", "q", "m", "side"), rule), "possible")
    forget(spark, rooted, several, held, families, at, parts)
    if not able.stored_rows:
        forget(spark, able)
        return None
    found = able.join(words, "doc_id").repartition("family", "q", "m").sortWithinPartitions("family", "q", "m", "side")
    found = counted(linked(found, rule).distinct(), "across")
    forget(spark, able)
    return found


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id and kept of every row.

    component_id is the least doc_id that links reach, kept tells whether it is the row's own. A text that is null or
    has no words has an empty set and no links. Rows that repeat an id are one node: what one of them is linked
    with, all are. A row with a null id is linked with nothing: its component_id is null and it is kept. Other columns are
    ignored; an empty table gives no rows; texts of any length are read whole.
    """
    spark = docs.sparkSession
    own = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    every = stored(sketches(own, rule), "sketches")
    full = every.where("doc_id is not null and n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("n_shingles", "sign", "bands")]
    classes = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *first), "classes", PIECE)
    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    hubs = stored(banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs", PIECE)
    members = stored(banded.join(hubs, "key"), "members", PIECE)
    near = members.where("doc_id <> hub").repartition("doc_id").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
    pairs = near.groupBy("doc_id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("parent")).withColumnRenamed("doc_id", "id")
    words = stored(own.where("text is not null").join(members.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"), "texts", PIECE)
    links = stored(confirmed(pairs, words, rule), "confirmed", PIECE)
    twice = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        roots = forest(links)
    else:
        same = full.select("doc_id", "k1", "k2").join(twice, "doc_id").join(classes.select("k1", "k2", F.col("doc_id").alias("b")), ["k1", "k2"])
        roots = components(links.selectExpr("id a", "parent b").union(same.selectExpr("doc_id a", "b")))
    more = across(members, roots, classes, words, rule)
    named = classes.select("k1", "k2", "doc_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k1", "k2", F.coalesce("root", "doc_id").alias("root"))
    if more is not None:
        named = named.join(components(more).selectExpr("id root", "root deeper"), "root", "left").select("k1", "k2", F.coalesce("deeper", "root").alias("root"))
        forget(spark, more)
    named = stored(named, "named", PIECE)
    forget(spark, classes, hubs, members, words, links, roots)
    found = every.where("doc_id is not null and n_shingles > 0").join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", "root")
    alone = every.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    return found.union(alone).select("doc_id", "n_shingles", F.col("root").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
