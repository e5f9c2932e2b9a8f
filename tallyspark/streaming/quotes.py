"""Quotes as a stream: late ones are dropped by a watermark, repeats once, prices are summed by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(stream: DataFrame, lateness: str = "60 seconds") -> DataFrame:
    """Quotes (quote_id, book, side, price, ts) not stamped later than they were captured, each id once."""
    rows = stream.where("price > 1 and ts <= captured_at")
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["quote_id"])


def by_window(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Number, last and mean price of each book and side in tumbling windows."""
    return stream.groupBy(F.window("ts", width).alias("w"), "book", "side").agg(F.count("*").alias("n"), F.max_by("price", "ts").alias("last_price"), F.avg("price").alias("mean_price")).select("w.start", "book", "side", "n", "last_price", "mean_price")
