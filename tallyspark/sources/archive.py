"""The four-file archive: CSV files of text columns whose bytes a manifest names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers of the four files, and the names used here.
HEADERS = {
    "events": {"EVENT": "event", "DATE": "date", "URL": "url"},
    "results": {"EVENT": "event", "BOUT": "bout", "OUTCOME": "outcome", "WEIGHTCLASS": "weightclass", "ROUND": "round", "TIME": "time", "TIME FORMAT": "time_format", "URL": "url"},
    "rounds": {
        "EVENT": "event", "BOUT": "bout", "ROUND": "round", "FIGHTER": "fighter", "KD": "kd", "SIG.STR.": "sig", "TOTAL STR.": "total", "TD": "td", "SUB.ATT": "sub_attempts", "REV.": "reversals", "CTRL": "control",
        "HEAD": "head", "BODY": "body", "LEG": "leg", "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground",
    },
    "profiles": {"FIGHTER": "fighter", "REACH": "reach", "URL": "url"},
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All columns as text under the engine's names. The header (with or without a byte-order mark) must hold every required
    column; others are left out."""
    wanted = HEADERS[kind]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if lacking := [c for c in wanted if c not in found]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return raw.select(*[F.col(f"`{found[c]}`").cast(T.StringType()).alias(n) for c, n in wanted.items()])


def mismatches(spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
    """Files (name, expected, actual) whose SHA-256 the manifest (name, sha256) doesn't name, and named files that are missing."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    both = manifest.select("name", F.col("sha256").alias("expected")).join(files, "name", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def write_csv(df: DataFrame, path: str, kind: str) -> None:
    """A folder of compressed CSV files of one kind, each with its header; `read_csv` reads the folder."""
    df.select(*[F.col(n).alias(c) for c, n in HEADERS[kind].items()]).write.option("header", True).option("escape", '"').option("emptyValue", "").option("compression", "gzip").csv(path)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name and sha256 of each file under the paths: a manifest. A file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,csv.gz}").load(paths)
    return files.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("name"), F.sha2("content", 256).alias("sha256"))
