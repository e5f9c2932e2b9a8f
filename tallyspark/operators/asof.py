"""As-of operators: strictly earlier windows, last N with whole-date ties, latest rows, as-of joins.

All of them are windows, sorted streams or equi-joins on the entity key, so they shuffle once by that key; none is a
range join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def day_number(date: str | Column) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def earlier(keys: list[str], day: str, gap: int = 1) -> WindowSpec:
    """Rows of the same key at least `gap` whole days earlier; rows of one date never see each other."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -gap)


def latest(df: DataFrame, keys: list[str], order: list[Column], valid: Column | None = None, filter_first: bool = True) -> DataFrame:
    """The first row of each key by `order`. filter_first: invalid rows hide nothing; otherwise the latest row is
    chosen first, and a key whose latest row is invalid has none."""
    if valid is not None and filter_first:
        df = df.where(valid)
    df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    return df.where(valid) if valid is not None and not filter_first else df


def last_with_ties(df: DataFrame, key: str, day: str, order: str, measures: list[str], n: int, gap: int) -> DataFrame:
    """For each row, count and sums over the last n rows of its key at least `gap` days earlier, with every row of
    the boundary date, as n_last and last_... columns (see `sums_before`)."""
    out = sums_before(df, key, day, order, [F.col(m) for m in measures], n, gap)
    return out.select(*df.columns, "n_last", *[F.get("_last", F.lit(i)).alias(f"last_{m}") for i, m in enumerate(measures)])


def sums_before(df: DataFrame, key: str, day: str, order: str, measures: list[Column], n: int, gap: int, keep: list[str] | None = None, finish: Callable[[np.ndarray], np.ndarray] | None = None, shuffled: bool = False) -> DataFrame:
    """The columns `keep` (all) of each row, with n_last and the array _last: count and sums of the measures over the last n rows of its key at least `gap` whole days earlier, with
    every row of the boundary date. One shuffle by the key, no join: a task's rows pass as one sorted stream, in numpy. Of a key only the totals of its last
    n + gap dates are held, whatever its number of rows: n dates are enough (a date has a row at least), and at most `gap` dates are too near. finish: what becomes of the sums (a row of them for each row). shuffled: df comes from a window by
    the key, whose partitions serve here too."""
    if gap < 1 or n < 1:
        raise ValueError("at least one row, and one day earlier")
    keep = df.columns if keep is None else keep
    values = F.array(*[F.coalesce(m.cast("double"), F.lit(0.0)) for m in measures]).alias("_values")
    ordered = (df if shuffled else df.repartition(key)).sortWithinPartitions(key, day, order)
    rows = ordered.select(*keep, F.col(key).alias("_key"), F.col(day).cast("long").alias("_day"), values)
    width, start = len(measures), np.iinfo(np.int64).min // 2  # rows without a date come first, as one date that counts for none

    def run(batches):
        last, days, counts, sums = None, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(len(keep)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            at = batch.column(len(keep) + 1).fill_null(start).to_numpy(zero_copy_only=False)
            v = batch.column(len(keep) + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])]))
            of_row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            who, c, s = code[first], np.diff(np.append(first, len(at))), np.add.reduceat(v, first, axis=0)
            d = at[first]
            head, tail = (batch.column(len(keep))[i].as_py() for i in (0, -1))
            held = 0
            if last is not None and last[0] == head:
                if days[-1] == d[0]:  # a date that the batch before began
                    c[0] += counts[-1]
                    s[0] += sums[-1]
                    days, counts, sums = days[:-1], counts[:-1], sums[:-1]
                held = len(days)
                d, c, s, who = np.concatenate([days, d]), np.concatenate([counts, c]), np.concatenate([sums, s]), np.concatenate([np.full(held, who[0]), who])
            c[d == start], s[d == start] = 0, 0.0
            place = np.arange(len(d))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], who[1:] != who[:-1]]), place, 0))
            total, added = c.copy(), s.copy()
            for back in range(1, n):
                more = np.flatnonzero((place - back >= begin) & (total < n))
                total[more] += c[more - back]
                added[more] += s[more - back]
            seen = place.copy()
            for _ in range(gap):
                seen -= (seen >= begin) & (d[seen] > d - gap)
            none = seen < begin
            total, added = np.where(none, 0, total[seen]), np.where(none[:, None], 0.0, added[seen])
            rest = max(begin[-1], len(d) - n - gap)
            last, days, counts, sums = (tail,), d[rest:], c[rest:], s[rest:]
            to = of_row + held
            added = added if finish is None else finish(added)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1, dtype=np.int32) * added.shape[1]), pa.array(added[to].ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total[to]), flat], names=[*keep, "n_last", "_last"])

    schema = T.StructType([*[f for name in keep for f in df.schema if f.name == name], T.StructField("n_last", T.LongType()), T.StructField("_last", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def last_rows(df: DataFrame, key: str, day: str, order: list[str], value: str, n: int, counts: Column | None = None) -> DataFrame:
    """df with `last`: the value of the last n rows of the key on strictly earlier dates, in order of (day, *order), oldest first. Each row carries
    the n values up to itself; a later date takes those of the last row before it. counts: which rows count at all."""
    rows = df.withColumn("_counts", F.lit(True) if counts is None else F.coalesce(counts, F.lit(False)))
    own = Window.partitionBy(key, "_counts").orderBy(day, *order).rowsBetween(1 - n, 0)
    rows = rows.withColumn("_own", F.collect_list(value).over(own))
    seen = F.max_by("_own", F.when(F.col("_counts"), F.struct(day, *order))).over(earlier([key], day))
    return rows.withColumn("last", F.coalesce(seen, F.array().cast(df.select(F.array(value)).schema[0].dataType))).drop("_own", "_counts")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row at or before its time (forward: the next one at or after;
    strict: not at the same time). Both sides are sorted together once; the last right row seen is carried along."""
    side = F.lit(0 if strict != forward else 1)  # whether a left row comes after right rows of its own time
    other = F.lit(1 if strict != forward else 0)
    rows = F.struct(*values)
    a = left.select(*keys, F.col(left_time).alias("_t"), side.alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(rows.alias("r")).schema["r"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_time).alias("_t"), other.alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), rows.alias("_right"))
    frame = (Window.currentRow, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, Window.currentRow)
    window = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(*frame)
    seen = (F.first if forward else F.last)("_right", ignorenulls=True).over(window)
    return a.unionByName(b).withColumn("_seen", seen).where("_left is not null").select("_left.*", *[F.col(f"_seen.{v}").alias(v) for v in values])


def latest_by_field(df: DataFrame, keys: list[str], fields: list[str], time: str, tie: str) -> DataFrame:
    """The latest non-null value of each field on its own, and whether values of its latest time disagree."""
    out = []
    for f in fields:
        has = F.col(f).isNotNull()
        out.append(F.max_by(f, F.when(has, F.struct(time, tie))).alias(f))
        out.append(F.max(F.when(has, F.col(time))).alias(f"_t_{f}"))
    found = df.groupBy(*keys).agg(*out)
    check = df.join(found.select(*keys, *[f"_t_{f}" for f in fields]), keys)
    check = check.groupBy(*keys).agg(*[(F.countDistinct(F.when(F.col(time) == F.col(f"_t_{f}"), F.col(f))) > 1).alias(f"{f}_conflict") for f in fields])
    return found.drop(*[f"_t_{f}" for f in fields]).join(check, keys)
