"""URL rules: a blocked Bloom filter of the listed URLs, then an exact hash join.

Every listed rule is a canonical host and a path prefix. A url's candidates are its host and the hosts
above it, each with the prefixes of its path that are as long as some listed path. The filter (blocks of
256 bits, eight bits a key) lets possible hits through; a join on the exact strings removes the false ones; the
longest rule that is left decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session

#: Bits for each listed key, and the most blocks (of 32 bytes) the filter may have, so that it can be broadcast
#: whatever the list's size: a fuller filter lets more false hits through to the join, and loses none.
KEY_BITS, MOST_BLOCKS = 16, 1 << 20
_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = after(url)
    size = F.length(F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1))
    return F.substring_index(F.substring_index(F.substr(rest, size + 1), "?", 1), "#", 1)


def block_bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each 64-bit key and the bit it sets in each of the block's eight words."""
    high, low = (keys >> np.uint64(32)), keys.astype(np.uint32)
    return ((high * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64), np.uint32(1) << ((low[:, None] * _SALT) >> np.uint32(27))


def build(rules: DataFrame) -> np.ndarray:
    """Blocks x 8 words. Each task adds its keys to a filter of its own; the partial filters, of bounded size, are merged."""
    count = rules.count()
    blocks = int(min(MOST_BLOCKS, max(1, count * KEY_BITS // 256)))

    def run(batches):
        words = np.zeros((blocks, 8), np.uint32)
        for batch in batches:
            block, bits = block_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), blocks)
            np.bitwise_or.at(words, block, bits)
        for at in range(0, blocks, 4096):
            part = words[at : at + 4096]
            used = np.flatnonzero(part.any(1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used + at, pa.int64()), *(pa.array(part[used, i].astype(np.int64)) for i in range(8))], ["block", *(f"w{i}" for i in range(8))])

    rows = rules.select(F.xxhash64("rule").alias("h")).mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    words = np.zeros((blocks, 8), np.uint32)
    merged = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toPandas()
    if len(merged):
        words[merged["block"].to_numpy()] = merged.drop(columns="block").to_numpy().astype(np.uint32)
    return words


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins, between equal lengths the first by name, and of a rule listed twice the smaller verdict
    ("allow" before "block"). Rows that no rule fits get rule null and the verdict `otherwise`. A null url, or one
    without ://, has empty host and path. Repeated rows and null ids give a row each; extra columns are ignored.
    """
    spark = session(pages.sparkSession)
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.concat("host", "path").alias("rule"), F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("_p")).distinct().collect())  # as many as a path has lengths
    shared = spark.sparkContext.broadcast(build(rules))

    def possible(batches):
        words = shared.value
        for batch in batches:
            column = batch.column("hashes")
            keys = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            block, bits = block_bits(keys, len(words))
            hit = ((words[block] & bits) == bits).all(1)
            counts = np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), counts)[hit]
            names = batch.column("names").flatten().take(pa.array(np.flatnonzero(hit)))
            yield pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(row)), names], ["url", "rule"])

    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    split = F.array(*[F.lit(n) for n in lengths]) if lengths else F.expr("array_repeat(0, 0)")
    prefixes = F.transform(F.filter(split, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    names = F.flatten(F.transform(above, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    urls = pages.where(F.col("url").isNotNull()).select("url").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host <> ''")
    asked = urls.select("url", names.alias("names")).select("url", "names", F.transform("names", lambda x: F.xxhash64(x)).alias("hashes"))
    hits = asked.mapInArrow(possible, "url string, rule string")
    exact = hits.join(rules, "rule").where((host(F.col("url")) == F.col("_h")) | host(F.col("url")).endswith(F.concat(F.lit("."), F.col("_h"))))
    exact = exact.where(path(F.col("url")).startswith(F.col("_p")))
    best = exact.groupBy("url").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"), F.col("verdict"))).alias("best"))
    joined = pages.select("page_id", "url").join(best, "url", "left")
    return joined.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
