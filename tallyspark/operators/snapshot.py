"""Logical snapshots: tables as typed JSON rows under a manifest, which read back exactly what was written, and single-file databases of old as tables.

A row is an ordinal and the row as a JSON object. Binary columns are base64, decimals, floating-point numbers, dates and times text, so that JSON loses nothing. A table's checksum is a sum of row
digests: it needs no sort, and as every digest covers the ordinal, moved rows change it. All rows are written and checked by tasks; the driver sees one row for each table.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import files

FORMAT = 1
ORDINAL = "_ordinal"
#: Types that are text in a snapshot.
AS_TEXT = (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FloatType, T.DoubleType)


def encoded(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(column).alias(field.name)
    if isinstance(field.dataType, AS_TEXT):
        return column.cast("string").alias(field.name)
    if isinstance(field.dataType, (T.StringType, T.IntegralType, T.BooleanType)):
        return column
    raise ValueError(f"{field.name}: a snapshot has no {field.dataType.simpleString()}")


def decoded(field: T.StructField) -> Column:
    column = F.col(f"row.`{field.name}`")
    return (F.unbase64(column) if isinstance(field.dataType, T.BinaryType) else column.cast(field.dataType)).alias(field.name)


def text_schema(schema: T.StructType) -> T.StructType:
    """The types of the row's JSON."""
    text = lambda f: isinstance(f.dataType, (T.BinaryType, *AS_TEXT))
    return T.StructType([T.StructField(f.name, T.StringType() if text(f) else f.dataType) for f in schema])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ordinals from 1 by the order, which must be a key. Rows are dealt to ranges and sorted within; ordinals follow from the ranges' counts (a row for each range
    on the driver), so no task sees all rows."""
    if ORDINAL in df.columns:
        raise ValueError(f"{ORDINAL} is taken")
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.min("_id").alias("low")).orderBy("_range").collect()
    before, start = [], 1
    for r in counts:
        before.append((r["_range"], start - r.low))
        start += r.n
    shift = df.sparkSession.createDataFrame(before, "_range int, _shift long")
    return ranged.join(F.broadcast(shift), "_range").withColumn(ORDINAL, F.col("_id") + F.col("_shift")).select(ORDINAL, *df.columns)


def row_sum(rows: DataFrame) -> tuple[int, str]:
    """Rows and the sum of the first 60 bits of every row's digest, over ordinal and text."""
    part = F.conv(F.left(F.sha2(F.concat_ws("\n", F.col("ordinal").cast("string"), "text"), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(part)).first()
    return n, str(total or 0)


def digest(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def lines(df: DataFrame, order: list[str]) -> DataFrame:
    """ordinal and text of each row; fields that are null are in the text as null."""
    schema = df.schema
    return numbered(df, order).select(F.col(ORDINAL).alias("ordinal"), F.to_json(F.struct(*[encoded(f) for f in schema]), {"ignoreNullFields": "false"}).alias("text"))


def export(tables: dict[str, tuple[DataFrame, list[str]]], root: str, keys: dict[str, list[str]] | None = None, links: list[tuple[str, str, str, str]] = ()) -> dict:
    """Write every table (with the columns that order it, which must be a key) and then the manifest, which names schemas, order, keys, links (child, column, parent, column), rows and checksums.
    Without a manifest a folder is no snapshot, so a failed export is never read."""
    spark = next(iter(tables.values()))[0].sparkSession
    body = {"format": FORMAT, "tables": {}, "links": [list(x) for x in links]}
    for name, (df, order) in sorted(tables.items()):
        path = f"{root}/{name}"
        lines(df, order).write.mode("errorifexists").option("compression", "gzip").json(path)
        n, total = row_sum(read_lines(spark, path))
        body["tables"][name] = {"schema": json.loads(df.schema.json()), "order": order, "key": (keys or {}).get(name, order), "rows": n, "checksum": total}
    manifest = body | {"sha256": digest(body)}
    at, system = files(spark, f"{root}/manifest.json")
    out = system.create(at, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal long, text string").json(path)


def manifest_of(spark: SparkSession, root: str) -> dict:
    return json.loads(bytes(spark.read.format("binaryFile").load(f"{root}/manifest.json").first().content))


def problems(spark: SparkSession, root: str) -> list[str]:
    """What is wrong with a snapshot: its manifest's digest, and for each table rows, checksum, ordinals (1 to n, once each), unreadable rows, nulls or repeats of its key, and children without parents."""
    manifest = manifest_of(spark, root)
    out = []
    if digest({k: v for k, v in manifest.items() if k != "sha256"}) != manifest.get("sha256"):
        out.append("the manifest does not have its digest")
    if manifest.get("format") != FORMAT:
        return [*out, "another format"]
    for name, t in manifest["tables"].items():
        rows = read_lines(spark, f"{root}/{name}")
        n, total = row_sum(rows)
        if (n, total) != (t["rows"], t["checksum"]):
            out.append(f"{name}: rows differ from the checksum")
            continue
        low, high, different = rows.agg(F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal")).first()
        if n and (low, high, different) != (1, n, n):
            out.append(f"{name}: ordinals are not 1 to {n}")
        df = table(spark, root, manifest, name)
        schema = T.StructType.fromJson(t["schema"])
        spoiled = df.agg(F.count_if(F.col("_bad"))).first()[0]
        if spoiled:
            out.append(f"{name}: {spoiled} rows do not fit the schema")
        null = df.agg(F.count_if(F.greatest(*[F.col(f"`{k}`").isNull() for k in t["key"]], F.lit(False)))).first()[0]
        if null:
            out.append(f"{name}: {null} null keys")
        if df.groupBy(*[f"`{k}`" for k in t["key"]]).count().where("count > 1").limit(1).count():
            out.append(f"{name}: repeated keys")
        required = [f.name for f in schema if not f.nullable]
        if required and df.where(F.greatest(*[F.col(f"`{c}`").isNull() for c in required], F.lit(False))).limit(1).count():
            out.append(f"{name}: null in a required column")
    for child, column, parent, key in manifest["links"]:
        lone = table(spark, root, manifest, child).select(F.col(column).alias("k")).where("k is not null").join(table(spark, root, manifest, parent).select(F.col(key).alias("k")), "k", "left_anti")
        if lone.limit(1).count():
            out.append(f"{child}.{column}: no such {parent}")
    return out


def table(spark: SparkSession, root: str, manifest: dict, name: str) -> DataFrame:
    """The table's columns, its ordinal, and `_bad`: a row that is no object of the schema, or that says something else when it is written again."""
    schema = T.StructType.fromJson(manifest["tables"][name]["schema"])
    rows = read_lines(spark, f"{root}/{name}").select("ordinal", "text", F.from_json("text", text_schema(schema)).alias("row"))
    back = rows.select("ordinal", "text", *[decoded(f) for f in schema])
    again = F.to_json(F.struct(*[encoded(f) for f in schema]), {"ignoreNullFields": "false"})
    return back.select(*[f"`{f.name}`" for f in schema], F.col("ordinal").alias(ORDINAL), (~again.eqNullSafe(F.col("text"))).alias("_bad"))


def restore(spark: SparkSession, root: str, target: str) -> dict[str, DataFrame]:
    """Read a verified snapshot into a new place as Parquet, and verify what was written there against the snapshot's checksums. A target that exists is an error, and nothing is made active.
    The tables, without their ordinals, in the manifest's types."""
    if found := problems(spark, root):
        raise ValueError("the snapshot does not verify: " + "; ".join(found))
    at, system = files(spark, target)
    if system.exists(at):
        raise ValueError(f"{target} exists")
    manifest, out = manifest_of(spark, root), {}
    for name, t in manifest["tables"].items():
        table(spark, root, manifest, name).drop("_bad").write.parquet(f"{target}/{name}")
        df = spark.read.parquet(f"{target}/{name}")
        schema = T.StructType.fromJson(t["schema"])
        rows = df.select(F.col(ORDINAL).alias("ordinal"), F.to_json(F.struct(*[encoded(f) for f in schema]), {"ignoreNullFields": "false"}).alias("text"))
        if row_sum(rows) != (t["rows"], t["checksum"]):
            raise ValueError(f"{name}: restored rows differ from the snapshot")
        out[name] = df.drop(ORDINAL)
    return out


def clone(spark: SparkSession, root: str, target: str) -> dict:
    """A copy of a snapshot under another name, with the same manifest, by the tasks that read it."""
    if found := problems(spark, root):
        raise ValueError("the snapshot does not verify: " + "; ".join(found))
    manifest = manifest_of(spark, root)
    for name in manifest["tables"]:
        read_lines(spark, f"{root}/{name}").write.mode("errorifexists").option("compression", "gzip").json(f"{target}/{name}")
    at, system = files(spark, f"{target}/manifest.json")
    out = system.create(at, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if found := problems(spark, target):
        raise ValueError("the copy does not verify: " + "; ".join(found))
    return manifest


#: Rows of an old database that a task hands over at once.
OLD_ROWS = 1000


def _opened(content: bytes) -> tuple[sqlite3.Connection, str]:
    """A database in a file of the task's own, read only."""
    handle, path = tempfile.mkstemp(suffix=".sqlite")
    with os.fdopen(handle, "wb") as file:
        file.write(content)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True), path


def old_rows(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """S20. Rows of single-file databases (SQLite): database, table, ordinal (the row id), and the row as JSON, in which binary values are {"$bytes": base64}. Each file is read and checked by one task (2 GB at most,
    as binaryFile has it); rows go out in batches. A file with another digest than stated, or one that fails its integrity or foreign-key check, is an error; so is a table without row ids."""
    import base64

    def run(batches):
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if sha256 and hashlib.sha256(content).hexdigest() != sha256:
                    raise ValueError(f"{place} has another digest")
                base, own = _opened(content)
                try:
                    if base.execute("pragma integrity_check").fetchone()[0] != "ok" or base.execute("pragma foreign_key_check").fetchone():
                        raise ValueError(f"{place} does not verify")
                    for (name,) in base.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall():
                        quoted = '"' + name.replace('"', '""') + '"'
                        cursor = base.execute(f"select rowid, * from {quoted} order by rowid")
                        columns = [c[0] for c in cursor.description[1:]]
                        while rows := cursor.fetchmany(OLD_ROWS):
                            text = [json.dumps({c: {"$bytes": base64.b64encode(v).decode()} if isinstance(v, bytes) else v for c, v in zip(columns, row[1:], strict=True)}, ensure_ascii=False) for row in rows]
                            yield pa.RecordBatch.from_arrays([pa.array([place] * len(rows)), pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(text)], ["database", "table", "ordinal", "row"])
                finally:
                    base.close()
                    os.unlink(own)

    read = spark.read.format("binaryFile").load(path).select("path", "content")
    return read.mapInArrow(run, "database string, `table` string, ordinal long, row string")


def old_table(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """One table of `old_rows` with the types of schema, and the ordinals that order it."""
    return rows.where(F.col("table") == name).select(F.col("ordinal").alias(ORDINAL), F.from_json("row", schema).alias("r")).select(ORDINAL, "r.*")
