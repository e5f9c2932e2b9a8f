"""Append-only ledgers whose entries name the digest of the entry before."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "0" * 64


def digest(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, payload), 256)


def verify(entries: DataFrame, chain: str) -> DataFrame:
    """Entries (chain, number, payload, previous_sha256, entry_sha256) with `problem`: gap, broken_link, wrong_digest or null."""
    w = Window.partitionBy(chain).orderBy("number")
    before = F.coalesce(F.lag("entry_sha256").over(w), F.lit(ROOT))
    expected = F.coalesce(F.lag("number").over(w), F.lit(0)) + 1
    problem = F.when(F.col("number") != expected, "gap").when(F.col("previous_sha256") != before, "broken_link").when(F.col("entry_sha256") != digest(F.col("payload"), F.col("previous_sha256")), "wrong_digest")
    return entries.withColumn("problem", problem)


def chained(rows: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """Entries (chain, number, payload, previous_sha256, entry_sha256) of whole ledgers from rows (chain, *order, payload). Each digest needs the
    one before it, so a chain is read in order by one task, as a stream that holds one digest; chains are dealt out."""

    def run(batches):
        now, number, last = None, 0, ROOT
        for batch in batches:
            out = []
            for who, payload in zip(batch.column(chain).to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if who != now:
                    now, number, last = who, 0, ROOT
                number += 1
                entry = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
                out.append((number, last, entry))
                last = entry
            kinds = (pa.int64(), pa.string(), pa.string())
            new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "number", "previous_sha256", "entry_sha256"])

    sorted_ = rows.repartition(chain).sortWithinPartitions(chain, *order)
    return sorted_.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", number long, previous_sha256 string, entry_sha256 string")


def append(entries: DataFrame, chain: str, new: DataFrame) -> DataFrame:
    """The next entry of each chain in new (chain, payload); one for each chain, so that each names what stands there now."""
    last = entries.groupBy(chain).agg(F.max("number").alias("_n"), F.max_by("entry_sha256", "number").alias("_last"))
    rows = new.join(last, chain, "left").select(chain, (F.coalesce("_n", F.lit(0)) + 1).alias("number"), "payload", F.coalesce("_last", F.lit(ROOT)).alias("previous_sha256"))
    return rows.withColumn("entry_sha256", digest(F.col("payload"), F.col("previous_sha256")))


def is_prefix(short: DataFrame, long: DataFrame, chain: str) -> bool:
    """Whether every entry of one ledger stands in the other under the same number."""
    return short.join(long.select(chain, "number", "entry_sha256"), [chain, "number", "entry_sha256"], "left_anti").isEmpty()
