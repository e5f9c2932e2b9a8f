"""What the training-data operators share: the shared folder, stored tables, Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: a batch of long documents ends at the bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def session(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches are bounded from now on (the setting is read when a plan runs, so it can't be put back)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a temporary one; on a cluster, whose machines
    share no such folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of stored tables that are not deleted yet; a path holds a name that no other table has.
_STORED: set[str] = set()
_OPEN = threading.local()


#: Shuffled bytes in a file of a table that is stored without Python work.
PIECE = "32m"


def stored(df: DataFrame, name: str, piece: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. piece: what a file
    gets of a shuffle, where the session's advice would make too many small files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    if piece:
        spark.conf.set(key, piece)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if piece:
            spark.conf.set(key, old)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _STORED.add(path)
    for mine in getattr(_OPEN, "sets", ()):
        mine.add(path)
    return out


def counted(df: DataFrame, name: str, piece: str | None = PIECE) -> DataFrame:
    """A stored table whose rows were counted as it was written, as `stored_rows`."""
    rows = Observation()
    out = stored(df.observe(rows, F.count(F.lit(1)).alias("n")), name, piece)
    out.stored_rows = rows.get["n"]
    return out


@contextmanager
def recorded():
    """The set of the tables that are stored meanwhile in this thread and not deleted again."""
    mine: set[str] = set()
    outer, _OPEN.sets = getattr(_OPEN, "sets", ()), (*getattr(_OPEN, "sets", ()), mine)
    try:
        yield mine
    finally:
        _OPEN.sets = outer
        mine &= _STORED


def delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths & _STORED:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _STORED.discard(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    delete(spark, {f.stored_at for f in frames})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return pc.fill_null(batch.column(name), "").to_pylist()


def raw(batch: pa.RecordBatch, name: str = "text"):
    """Offsets and UTF-8 bytes of a text column as numpy arrays, nulls as empty texts."""
    import numpy as np

    column = pc.fill_null(batch.column(name), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]
