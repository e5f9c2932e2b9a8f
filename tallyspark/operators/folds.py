"""Ratings that depend on the order of contests.

One pool for all is the plain rule. A rating depends on all contests before it, so dates are taken one after the other, and what is parallel is inside: runs of dates with at most
`BLOCK_ROWS` contests are one ordered stream, which gets its participants' ratings with its rows; a larger date is dealt to the whole cluster, in levels of contests whose sides have no
earlier one left. No task ever gets more than a block, and ratings pass from block to block as a table. Pools by division are a departure that needs no blocks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .evaluate import MOST_DATES

#: Contests that one task may take as a stream.
BLOCK_ROWS = 1_000_000


def elo(contests: DataFrame, pool: str | None, k: float = 32.0, start: float = 1500.0, by_date: bool = False, date_snapshot: bool = False) -> DataFrame:
    """contests (pool, event_date, event_id, bout_id, a, b, score) with both ratings before and the expected score of a.

    score: 1, 0.5 or 0 for a, null for no contest (which changes nothing). In order of (event_date, event_id,
    bout_id); by_date: all changes of a date are computed from the ratings before it and applied together; date_snapshot: changes follow each other
    within a date, but what is shown are the ratings before the date. pool None: one pool, where a participant has one rating whatever the
    division (see `one_pool`).
    """
    if pool is None:
        return one_pool(contests, k, start, by_date, date_snapshot)
    rows = contests.withColumns({"_pool": F.col(pool).cast("string"), "_start_a": F.lit(start), "_start_b": F.lit(start)})
    return streamed(rows, [Rule(k, by_date, date_snapshot)]).drop("_pool", "_start_a", "_start_b", "_change")


def runs(values: np.ndarray) -> list[slice]:
    """Stretches of equal values."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [slice(x, y) for x, y in zip(edges, edges[1:], strict=False) if x < y]


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.power(10.0, (b - a) / 400))


class Pool:
    """The ratings of a pool while its contests pass in order: a number for each participant, one for the changes that its date holds back and one for its rating before the date."""

    def __init__(self, k: float, by_date: bool, date_snapshot: bool, name: str | None = None) -> None:
        self.k, self.by_date, self.date_snapshot, self.name = k, by_date, date_snapshot, name
        self.place: dict = {}
        self.rating, self.held, self.before, self.first = np.empty(0), np.empty(0), np.empty(0), np.empty(0, dtype=np.int64)
        self.date, self.touched = None, []

    def places(self, a, b, start_a, start_b) -> tuple[np.ndarray, np.ndarray]:
        """Where both sides' numbers are; new participants begin with the rating that their first contest brings."""
        codes, who = pd.factorize(np.concatenate([a.to_numpy(), b.to_numpy()]), use_na_sentinel=False)
        known = len(self.place)
        at = np.array([self.place.setdefault(w, len(self.place)) for w in who], dtype=np.int64)
        if len(self.place) > len(self.rating):
            more = np.zeros(max(len(self.place), 2 * len(self.rating)) - len(self.rating))
            self.rating, self.held, self.before = (np.concatenate([x, more]) for x in (self.rating, self.held, self.before))
            self.first = np.concatenate([self.first, more.astype(np.int64)])
        starts = np.concatenate([start_a.to_numpy(dtype=float), start_b.to_numpy(dtype=float)])
        new, at_first = at >= known, np.unique(codes, return_index=True)[1]
        self.rating[at[new]] = self.before[at[new]] = starts[at_first][new]
        return at[codes[: len(a)]], at[codes[len(a) :]]

    def take(self, date, a, b, score) -> tuple[np.ndarray, ...]:
        """Contests of one date, which may go on in the next call: ratings shown, expected score, change."""
        if date != self.date:
            for x in self.touched:
                self.rating[x] += self.held[x]
                self.held[x] = 0.0
                self.before[x] = self.rating[x]
            self.date, self.touched = date, []
        both = np.column_stack([a, b]).ravel()
        self.touched.append(np.unique(both))
        if self.by_date:
            ra, rb = self.rating[a], self.rating[b]
            p = chance(ra, rb)
            change = np.where(np.isnan(score), 0.0, self.k * (score - p))
            np.add.at(self.held, both, np.column_stack([change, -change]).ravel())
            return ra, rb, p, change
        ra, rb, change = self.in_turn(a, b, score)
        if self.date_snapshot:
            ra, rb = self.before[a], self.before[b]
        return ra, rb, chance(ra, rb), change

    def in_turn(self, a, b, score) -> tuple[np.ndarray, ...]:
        """One contest after the other; those go together that are the next one of both their sides, as long as they are many."""
        ra, rb, change = (np.empty(len(a)) for _ in range(3))
        left = np.arange(len(a))
        while len(left) > 64:
            x, y = a[left], b[left]
            own, both = np.arange(len(left)), np.column_stack([x, y]).ravel()
            self.first[both[::-1]] = np.repeat(own, 2)[::-1]
            ready = (self.first[x] == own) & (self.first[y] == own)
            if 8 * ready.sum() < len(left):
                break
            now, x, y = left[ready], x[ready], y[ready]
            ra[now], rb[now] = self.rating[x], self.rating[y]
            change[now] = np.where(np.isnan(score[now]), 0.0, self.k * (score[now] - chance(ra[now], rb[now])))
            self.rating[x] = ra[now] + change[now]
            self.rating[y] = rb[now] - change[now]
            left = left[~ready]
        for i in left.tolist():
            x, y = a[i], b[i]
            ra[i], rb[i] = u, v = float(self.rating[x]), float(self.rating[y])
            change[i] = 0.0 if np.isnan(score[i]) else self.k * (score[i] - 1 / (1 + 10 ** ((v - u) / 400)))
            self.rating[x], self.rating[y] = u + change[i], v - change[i]
        return ra, rb, change


@dataclass(frozen=True)
class Rule:
    k: float
    by_date: bool = False
    date_snapshot: bool = False


def streamed(rows: DataFrame, rules: list[Rule], marks: tuple[str, ...] = ("",)) -> DataFrame:
    """Every pool (_pool) as one ordered stream in one task; sides begin with _start_a and _start_b. Adds the ratings, the expected score and `_change`, what the contest
    gives to a and takes from b; for each rule under names with its mark. A task holds a few numbers for each participant of the pool at hand."""

    def run(batches):
        fresh = lambda name=None: [Pool(r.k, r.by_date, r.date_snapshot, name) for r in rules]
        pools = fresh()
        for batch in batches:
            n = batch.num_rows
            column = lambda name: batch.column(names.index(name))
            series = {c: pd.Series(column(c).to_numpy(zero_copy_only=False)) for c in ("a", "b", *[f"_start_{s}{m}" for s in "ab" for m in marks])}
            score = np.asarray(column("score").cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
            days = column("event_date")
            days = (days.cast(pa.int32()).fill_null(-(1 << 31)) if pa.types.is_date32(days.type) else days).to_numpy(zero_copy_only=False)
            named = column("_pool").to_numpy(zero_copy_only=False)
            out = [np.empty(n) for _ in range(4 * len(rules))]
            for part in runs(named):
                if named[part.start] != pools[0].name:
                    pools = fresh(named[part.start])
                for r, (pool, mark) in enumerate(zip(pools, marks, strict=True)):
                    a, b = pool.places(*[series[c].iloc[part] for c in ("a", "b", f"_start_a{mark}", f"_start_b{mark}")])
                    for at in runs(days[part]):
                        to = slice(part.start + at.start, part.start + at.stop)
                        for values, got in zip(out[4 * r : 4 * r + 4], pool.take(days[to.start], a[at], b[at], score[to]), strict=True):
                            values[to] = got
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in out]], names=[*names, *added])

    names, added = rows.columns, [f"{c}{m}" for m in marks for c in ("rating_a", "rating_b", "p_a", "_change")]
    ordered = rows.repartition(F.col("_pool")).sortWithinPartitions("_pool", "event_date", "event_id", "bout_id")
    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]]))


def blocks(contests: DataFrame, most: int) -> list[tuple]:
    """(first date, last date, contests) of runs of dates with at most `most` contests; a larger date is a block of its own."""
    counts = contests.groupBy("event_date").agg(F.count("*").alias("n")).orderBy("event_date").limit(MOST_DATES + 1).collect()
    if len(counts) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    out: list[tuple] = []
    for r in counts:
        if out and out[-1][2] + r.n <= most:
            out[-1] = (out[-1][0], r.event_date, out[-1][2] + r.n)
        else:
            out.append((r.event_date, r.event_date, r.n))
    return out


def by_block(contests: DataFrame, parts: list[tuple]) -> str:
    """Where the contests are stored by block: they are made once, and a block reads its own rows alone. Ranges of dates keep the files few, and split a large date."""
    rows = store.stored(contests, "contests")
    number = F.size(F.filter(F.array(*[F.lit(first) for first, _, _ in parts]), lambda first: first <= F.col("event_date"))) - 1
    place = store.scratch(contests.sparkSession, "blocks")
    rows.withColumn("_block", number).repartitionByRange("event_date", "event_id", "bout_id").write.partitionBy("_block").parquet(place)
    store.forget(rows)
    return place


def one_pool(contests: DataFrame, k: float, start: float = 1500.0, by_date: bool = False, date_snapshot: bool = False, most: int | None = None) -> DataFrame:
    """One rating for each participant. Rows without a date are left out (they have no place in the order); of an empty table none come back."""
    return rated(contests, [Rule(k, by_date, date_snapshot)], ("",), start, most)


def pools(contests: DataFrame, rules: list[Rule], start: float = 1500.0, most: int | None = None) -> DataFrame:
    """`one_pool` by several rules, with rating_a0, rating_b0 and p_a0 by the first, rating_a1 ... by the second: a block is sorted and streamed once for all of them."""
    return rated(contests, rules, tuple(map(str, range(len(rules)))), start, most)


def rated(contests: DataFrame, rules: list[Rule], marks: tuple[str, ...], start: float, most: int | None) -> DataFrame:
    most = BLOCK_ROWS if most is None else most
    contests = contests.where("event_date is not null")
    parts = blocks(contests, most)
    starts = [f"_start_{s}{m}" for m in marks for s in "ab"]
    columns = [*contests.columns, *[f"{c}{m}" for m in marks for c in ("rating_a", "rating_b", "p_a")]]
    if len(parts) <= 1 and (not parts or parts[0][2] <= most):
        rows = contests.withColumns({"_pool": F.lit("block"), **dict.fromkeys(starts, F.lit(start))})
        return streamed(rows, rules, marks).select(*columns)
    spark = contests.sparkSession
    place = store.scratch(spark, "ratings")
    dealt = by_block(contests, parts)
    kind = contests.schema["a"].dataType.simpleString()
    now = store.stored(spark.createDataFrame([], f"who {kind}, " + ", ".join(f"rating{m} double" for m in marks)), "rating")
    for number, (_, _, n) in enumerate(parts):
        rows = spark.read.schema(contests.schema).parquet(f"{dealt}/_block={number}")
        path = f"{place}/block={number}"
        if n <= most:
            done = streamed(with_ratings(rows, now, start, marks).withColumn("_pool", F.lit("block")), rules, marks).drop("_pool", *starts)
            store.write(done, path)
            done = spark.read.schema(done.schema).parquet(path)
        else:
            done = large_date(rows, now, rules, marks, start)
            store.write(done, path)
            done = spark.read.parquet(path)
        before, now = now, store.stored(moved(now, done, start, marks), "rating")
        store.forget(before)
    store.forget(now)
    store.remove(spark, dealt)
    return spark.read.parquet(place).select(*columns)


def large_date(rows: DataFrame, now: DataFrame, rules: list[Rule], marks: tuple[str, ...], start: float) -> DataFrame:
    """A date beyond what one task takes, rule by rule; the rules meet again by the row's number."""
    rows = store.stored(rows.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    out = rows
    for rule, mark in zip(rules, marks, strict=True):
        own = now.select("who", F.col(f"rating{mark}").alias("rating"))
        parts = [at_once(with_ratings(rows, own, start), rule.k)] if rule.by_date else levels(rows, own, rule.k, start, rule.date_snapshot)
        done = reduce(DataFrame.unionByName, parts)
        out = out.join(done.select("_number", *[F.col(c).alias(f"{c}{mark}") for c in ("rating_a", "rating_b", "p_a", "_change")]), "_number")
    return out.drop("_number")


def with_ratings(rows: DataFrame, now: DataFrame, start: float, marks: tuple[str, ...] = ("",)) -> DataFrame:
    """Rows with both sides' ratings so far as _start_a and _start_b (for each rule, with its mark)."""
    for s in "ab":
        rows = rows.join(now.select(F.col("who").alias(s), *[F.col(f"rating{m}").alias(f"_start_{s}{m}") for m in marks]), s, "left").withColumns({f"_start_{s}{m}": F.coalesce(f"_start_{s}{m}", F.lit(start)) for m in marks})
    return rows


def moved(now: DataFrame, done: DataFrame, start: float, marks: tuple[str, ...] = ("",)) -> DataFrame:
    """Ratings after contests with a _change."""
    both = done.select(F.inline(F.array(F.struct(F.col("a").alias("who"), *[F.col(f"_change{m}") for m in marks]), F.struct(F.col("b").alias("who"), *[(-F.col(f"_change{m}")).alias(f"_change{m}") for m in marks]))))
    change = both.groupBy("who").agg(*[F.sum(f"_change{m}").alias(f"_change{m}") for m in marks])
    return now.join(change, "who", "full").select("who", *[(F.coalesce(f"rating{m}", F.lit(start)) + F.coalesce(f"_change{m}", F.lit(0.0))).alias(f"rating{m}") for m in marks])


def at_once(known: DataFrame, k: float) -> DataFrame:
    """Contests that all see the ratings they came with."""
    p = 1 / (1 + F.pow(F.lit(10.0), (F.col("_start_b") - F.col("_start_a")) / 400))
    change = F.when(F.col("score").isNull(), F.lit(0.0)).otherwise(k * (F.col("score") - p))
    return known.withColumns({"rating_a": F.col("_start_a"), "rating_b": F.col("_start_b"), "p_a": p, "_change": change}).drop("_start_a", "_start_b")


def levels(rows: DataFrame, now: DataFrame, k: float, start: float, date_snapshot: bool) -> list[DataFrame]:
    """Contests of one large date in order: those go first that are the next one of both their sides, then ratings move on, and so forth. Stored tables, one for each level; there are as many
    as the longest chain of contests that share sides."""
    columns = rows.columns
    rows = store.stored(rows.withColumn("_row", F.monotonically_increasing_id()), "date")  # tells repeated rows apart
    who = rows.select("_row", "bout_id", "event_id", F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("who")), F.struct(F.lit("b").alias("side"), F.col("b").alias("who")))))
    order = Window.partitionBy("who").orderBy("event_id", "bout_id", "_row")
    turn = who.withColumn("turn", F.row_number().over(order)).groupBy("_row").agg(F.max(F.when(F.col("side") == "a", F.col("turn"))).alias("_turn_a"), F.max(F.when(F.col("side") == "b", F.col("turn"))).alias("_turn_b"))
    pending = store.stored(rows.join(turn, "_row").drop("_row"), "pending")
    store.forget(rows)
    rating, taken, out = now, None, []
    while pending.limit(1).count():
        known = with_ratings(pending, rating, start)
        for s in "ab":
            if taken is None:
                known = known.withColumn(f"_taken_{s}", F.lit(0))
            else:
                known = known.join(taken.select(F.col("who").alias(s), F.col("taken").alias(f"_taken_{s}")), s, "left").withColumn(f"_taken_{s}", F.coalesce(f"_taken_{s}", F.lit(0)))
        ready = (F.col("_turn_a") == F.col("_taken_a") + 1) & (F.col("_turn_b") == F.col("_taken_b") + 1)
        done = store.stored(at_once(known.where(ready).select(*columns, "_start_a", "_start_b"), k), "level")
        own = done.select(F.explode(F.array("a", "b")).alias("who")).groupBy("who").agg(F.count("*").alias("more"))
        last_taken = taken
        if taken is None:
            taken = store.stored(own.select("who", F.col("more").alias("taken")), "taken")
        else:
            taken = store.stored(taken.join(own, "who", "full").select("who", (F.coalesce("taken", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("taken")), "taken")
        last_pending, pending = pending, store.stored(known.where(~ready).select(*columns, "_turn_a", "_turn_b"), "pending")
        last_rating, rating = rating, store.stored(moved(rating, done, start), "rating")
        for old in (last_taken, last_pending, last_rating if last_rating is not now else None):
            if old is not None:
                store.forget(old)
        if date_snapshot:
            shown = with_ratings(done.drop("rating_a", "rating_b", "p_a"), now, start)
            seen = store.stored(shown.withColumns({"rating_a": F.col("_start_a"), "rating_b": F.col("_start_b"), "p_a": 1 / (1 + F.pow(F.lit(10.0), (F.col("_start_b") - F.col("_start_a")) / 400))}).drop("_start_a", "_start_b"), "shown")
            store.forget(done)
            done = seen
        out.append(done)
    for old in (taken, pending, rating if rating is not now else None):
        if old is not None:
            store.forget(old)
    return out
