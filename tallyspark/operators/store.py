"""Versioned tables with an active pointer, upserts, conflict-aware inserts and fingerprints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], root: str, run_id: str, source_sha256: str) -> None:
    """Write a version of all tables, verify the row counts read back, then make it the active one. A version that is there
    with the same source is only made active; with another source it is an error. Readers see the old version until the last step."""
    spark = next(iter(tables.values())).sparkSession
    known = [r.source_sha256 for r in versions(spark, root).where(F.col("run_id") == run_id).collect()]
    if known and known[0] != source_sha256:
        raise ValueError(f"version {run_id} has another source")
    if not known:
        for name, df in tables.items():
            write_counted(df, version(root, name, run_id))
    activate(spark, root, run_id, source_sha256)


def version(root: str, name: str, run_id: str) -> str:
    return f"{root}/{name}/run_id={run_id}"


def write_counted(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back; another number of rows than was written is an error."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (read := out.count()) != rows.get["n"]:
        raise ValueError(f"{path}: wrote {rows.get['n']} rows, read {read}")
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder of spark.checkpoint.dir. Where it is unset a local session (as in tests) gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write a step's table; what was shuffled for it is deleted at once, so that steps one after the other do not add up on disk."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A step of an iteration as a table in the shared folder, which cuts its lineage (see `write`)."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def files(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    at, system = files(spark, path)
    return system.getContentSummary(at).getLength()


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    at, system = files(spark, path)
    system.delete(at, True)


def versions(spark: SparkSession, root: str) -> DataFrame:
    schema = "sequence long, run_id string, source_sha256 string"
    at, system = files(spark, f"{root}/_pointers")
    return spark.read.schema(schema).parquet(f"{root}/_pointers") if system.exists(at) else spark.createDataFrame([], schema)


def activate(spark: SparkSession, root: str, run_id: str, source_sha256: str) -> None:
    """Append a pointer; the one with the greatest sequence number is active. A number belongs to whoever creates its file in _claims, which
    the file system lets one publisher do; so two of them never write the same number, and the greater one wins."""
    number = (versions(spark, root).agg(F.max("sequence")).first()[0] or 0) + 1
    while True:
        at, system = files(spark, f"{root}/_claims/{number}")
        if system.createNewFile(at):
            break
        number += 1
    spark.createDataFrame([(number, run_id, source_sha256)], "sequence long, run_id string, source_sha256 string").coalesce(1).write.mode("append").parquet(f"{root}/_pointers")


def rollback(spark: SparkSession, root: str, run_id: str) -> str | None:
    """When a step after activation fails, make the version that was active before `run_id` active again; returns it."""
    rows = versions(spark, root).orderBy("sequence").collect()  # a row for each publication
    before = next((r for r in reversed(rows) if r.run_id != run_id), None)
    if not rows or rows[-1].run_id != run_id or before is None:
        return rows[-1].run_id if rows else None
    activate(spark, root, before.run_id, before.source_sha256)
    return before.run_id


def active(spark: SparkSession, root: str) -> str | None:
    return versions(spark, root).agg(F.max_by("run_id", "sequence")).first()[0]


def read(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the active version (or another): the version's folder alone is listed and read."""
    return spark.read.parquet(version(root, name, run_id or active(spark, root)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows by key; where both have one, a new value wins unless it is null."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest]), new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in rest])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of new whose key old lacks, and rows whose key old has with other values (conflicts)."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.join(old.select(*keys), keys, "left_anti")
    both = new.join(old.select(*keys, F.xxhash64(*rest).alias("_old")), keys)
    return fresh, both.where(F.xxhash64(*rest) != F.col("_old")).drop("_old")


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and a sum of row hashes that does not depend on their order."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def schema_differences(df: DataFrame, wanted) -> list[str]:
    have, want = {f.name: f.dataType.simpleString() for f in df.schema}, {f.name: f.dataType.simpleString() for f in wanted}
    return sorted(f"{c}: {have.get(c)} instead of {want.get(c)}" for c in have.keys() | want.keys() if have.get(c) != want.get(c))


def key_problems(df: DataFrame, keys: list[str], required: list[str] = ()) -> dict[str, int]:
    """What the data say about keys and nullability: rows beyond the first of a key, and nulls of each required column. Repeats come
    from counts by key, nulls from one aggregate."""
    repeats = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    columns = sorted({*keys, *required})
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return {"repeats": repeats} | {f"null:{c}": nulls[c] for c in columns}


def publish_document(documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: rows of new (kind, key, identity, captured_at, payload) that may be appended, and those refused with `problem`: another identity under
    a known key, or a capture not later than the newest there."""
    known = documents.groupBy("kind", "key").agg(F.max("captured_at").alias("_last"), F.min("identity").alias("_identity"))
    rows = new.join(known, ["kind", "key"], "left")
    problem = F.when(F.col("identity") != F.col("_identity"), "other_identity").when(F.col("captured_at") <= F.col("_last"), "not_later")
    rows = rows.withColumn("problem", problem).drop("_last", "_identity").select(*new.columns, "problem")
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null")


def write_new(df: DataFrame, path: str) -> None:
    """Write JSON lines to a place where nothing is yet; anything there is an error."""
    df.write.mode("errorifexists").json(path)
