"""Centroid clustering with Yinyang bounds, in exact integers.

The centroids are put into groups once. A vector keeps an upper bound of the distance to its own centroid and, for each group, a lower bound of the
distance to the group's other centroids. When centroids move, the bounds move with them, and a vector is compared only where they leave a doubt: not
at all where the upper bound is under every lower one, else not with the groups whose lower bound is above it. What is compared is compared exactly,
so the result is that of comparing everything.

Each round is one pass without a shuffle, from one stored table to the next: a row carries its vector and its bounds, and a task's last row
what the task's vectors add to the clusters' sums and take from them. That row is committed with the task's file, so that a repeated task counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, session, stored

#: Centroids in a group, on average; passes in which the groups are found.
GROUP_SIZE, GROUP_PASSES = 4, 5
#: An integer component must stay under this, so that squared distances of up to 512 components are exact in a long.
MOST = 1 << 26
#: Share by which a bound is moved outwards when it is computed in floating point.
_OUT = 1e-12
#: In place of a cluster, where a task says how many distances it computed.
_SCANNED = -1
STATE = "vec_id long, parts binary, cluster int, upper double, lower binary, distance long, moved array<struct<cluster:int,sums:array<bigint>>>"


@dataclass(frozen=True)
class Rule:
    """components: what a vector must have; scale: an integer is floor(scale * x); seed: what the hash that picks the first centroids starts with."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: int = 3


@dataclass
class Clustering:
    """rows: vec_id, cluster, distance (squared). inertia: by cluster. scanned: distances that were computed; a plain method computes rounds + 1 for each vector and centroid."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scanned: int


def integers(values: np.ndarray, rule: Rule) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * rule.scale)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component of {MOST // rule.scale} or more can't be told in exact distances")
    return scaled.astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each of c. A product of floating-point matrices is exact as long as nothing reaches 2**53."""
    big = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * big) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few plain passes over the centroids from evenly spread ones."""
    k = len(centroids)
    n = max(1, -(-k // GROUP_SIZE))
    heads = centroids[np.arange(n) * k // n].astype(np.float64)
    for _ in range(GROUP_PASSES):
        group = ((centroids[:, None].astype(np.float64) - heads) ** 2).sum(2).argmin(1)
        heads = np.stack([centroids[group == g].mean(0) if (group == g).any() else heads[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


@dataclass
class Step:
    """What a pass needs: the centroids, their groups, and how far each has moved since the pass before (None at the first)."""

    centroids: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None

    def __post_init__(self):
        self.members = [np.flatnonzero(self.group == g) for g in range(int(self.group.max()) + 1)]
        self.most = None if self.drift is None else np.array([self.drift[m].max() for m in self.members])

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New (cluster, upper, lower) of the rows and the number of distances computed."""
        rows = np.arange(len(x))
        if self.drift is None:
            cluster, best = np.zeros(len(x), np.int64), squares(x, self.centroids[:1])[:, 0]
            upper, lower = np.sqrt(best) * (1 + _OUT), np.full((len(x), len(self.members)), -1.0)
            open_rows, scanned = rows, len(x)
        else:
            cluster = cluster.astype(np.int64)
            moved = self.drift[cluster]
            upper = (upper + moved) * (1 + _OUT)
            lower = lower - self.most - _OUT * (np.minimum(np.abs(lower), 1e300) + self.most)  # infinite where a group has no other centroid
            least = lower.min(1)
            open_rows = np.flatnonzero(upper >= least)  # the global filter
            best = np.zeros(len(x), np.int64)
            best[open_rows] = ((x[open_rows] - self.centroids[cluster[open_rows]]) ** 2).sum(1)
            scanned = len(open_rows)
            upper[open_rows] = np.sqrt(best[open_rows]) * (1 + _OUT)
            open_rows = open_rows[upper[open_rows] >= least[open_rows]]
        own, own_upper = cluster.copy(), upper.copy()
        searched = np.zeros(lower.shape, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for g, members in enumerate(self.members):
            some = open_rows[own_upper[open_rows] >= lower[open_rows, g]]  # the filter by group; a tie is searched
            far = squares(x[some], self.centroids[members])
            scanned += far.size
            searched[some, g] = True
            found.append((some, far))
            if len(some):
                at = far.argmin(1)
                value, number = far[np.arange(len(some)), at], members[at]
                better = (value < best[some]) | ((value == best[some]) & (number < cluster[some]))
                best[some[better]], cluster[some[better]] = value[better], number[better]
        for g, (some, far) in enumerate(found):
            other = np.where(self.members[g] == cluster[some][:, None], np.inf, np.sqrt(far))
            lower[some, g] = other.min(1) * (1 - _OUT)
        changed = np.flatnonzero(cluster != own)
        upper[changed] = np.sqrt(best[changed]) * (1 + _OUT)
        left = changed[~searched[changed, self.group[own[changed]]]]  # the centroid that was left counts in its group again
        lower[left, self.group[own[left]]] = np.minimum(lower[left, self.group[own[left]]], own_upper[left] * (1 - 3 * _OUT))
        return cluster, upper, lower, scanned


def fixed(values: np.ndarray) -> pa.Array:
    """Each row of an array as binary."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * width).astype(np.int32)), pa.py_buffer(values)])


def unfixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[0] + len(column) * size].view(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def added(total: np.ndarray, cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
    """Counts (first column) and sums of the rows, by cluster."""
    for c in np.unique(cluster):
        mine = x[cluster == c]
        total[c, 0] += sign * len(mine)
        total[c, 1:] += sign * mine.sum(0)


def passed(step: Step, rule: Rule, last: bool):
    """The pass over the rows of a task. last: exact distances and their sums by cluster, and no vectors, go out."""
    groups, kinds = len(step.members), pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))]))
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(batches):
        total = np.zeros((len(step.centroids), 2 if last else 1 + rule.components), np.int64)
        scanned = 0
        for batch in batches:
            n = len(batch)
            if step.drift is None:
                x = integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, rule.components), rule)
                old, upper, lower = None, None, None
            else:
                x = unfixed(batch.column("parts"), "<i4", rule.components).astype(np.int64)
                old, upper, lower = batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), unfixed(batch.column("lower"), "<f8", groups)
            cluster, upper, lower, count = step.assign(x, old, upper, lower)
            scanned += count
            distance = None
            if last:
                distance = ((x - step.centroids[cluster]) ** 2).sum(1)
                added(total, cluster, distance[:, None], 1)
            else:
                changed = slice(None) if old is None else cluster != old
                added(total, cluster[changed], x[changed], 1)
                if old is not None:
                    added(total, old[changed], x[changed], -1)
            nothing = pa.nulls(n, pa.binary())
            columns = [batch.column("vec_id"), nothing if last else fixed(x.astype("<i4")), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), nothing if last else fixed(lower), pa.array(distance, pa.int64()) if last else pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, kinds)], names)
        sums = [{"cluster": c, "sums": row.tolist()} for c, row in enumerate(total) if row.any()] + [{"cluster": _SCANNED, "sums": [scanned]}]
        empty = [pa.nulls(1, k) for k in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([sums], kinds)], names)

    return run


def kept(vectors: DataFrame, rule: Rule) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.size("vector") == rule.components).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def totals(table: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """What the tasks of a pass add up to: one number for each cluster and column, however many tasks there were."""
    out, scanned = np.zeros(shape, np.int64), 0
    ends = table.where("cluster is null").select(F.explode("moved").alias("m")).select("m.cluster", F.posexplode("m.sums"))
    for c, at, value in ends.groupBy("cluster", "pos").agg(F.sum("col")).collect():
        if c == _SCANNED:
            scanned = value
        else:
            out[c, at] = value
    return out, scanned


def cluster(vectors: DataFrame, rule: Rule = Rule()) -> Clustering:
    """Cluster the rows (vec_id, embedding) whose vector has exactly the rule's components, none null or non-finite; others go.

    The first centroids are the vectors whose ids have the smallest hashes; fewer vectors make fewer clusters, and an empty table none. Ties between
    centroids go to the smaller number. Repeated ids and repeated rows are vectors of their own; rows with a null id are clustered, but start no cluster
    unless there are too few others. Other columns, also those named like a result, are ignored. A component of 65,536 or more (2**26 as an integer)
    is an error. Centroids that no longer move end the rounds early, as nothing changes after that."""
    spark = session(vectors.sparkSession)
    rows = kept(vectors, rule)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), "vec_id", "vector").limit(rule.clusters).collect()
    if not first:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, rule.components), np.int64), [], 0)
    centroids = integers(np.array([r.vector for r in first]), rule)
    step = Step(centroids, grouped(centroids), None)
    sums, scanned = np.zeros((len(centroids), 1 + rule.components), np.int64), 0
    table = None
    for _ in range(rule.rounds):
        before, table = table, stored((rows if table is None else table.where("cluster is not null")).mapInArrow(passed(step, rule, False), STATE), "yinyang")
        if before is not None:
            forget(spark, before)
        change, count = totals(table, sums.shape)
        sums, scanned = sums + change, scanned + count
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] // np.maximum(sums[:, :1], 1), centroids)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + _OUT)
        still, centroids = bool((moved == centroids).all()), moved
        step = Step(centroids, step.group, drift)
        if still:
            break
    end = stored((rows if table is None else table.where("cluster is not null")).mapInArrow(passed(step, rule, True), STATE), "yinyang")
    if table is not None:
        forget(spark, table)
    inertia, count = totals(end, (len(centroids), 2))
    return Clustering(end.where("cluster is not null").select("vec_id", "cluster", "distance"), centroids, inertia[:, 1].tolist(), scanned + count)
