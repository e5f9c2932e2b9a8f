"""Query-result bindings (JSON) as rows, with repeated items and labels flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def rows(responses: DataFrame, keys: tuple[str, ...] = ("item", "itemLabel", "externalId")) -> DataFrame:
    """responses (payload) -> a row for each binding: its values, the item's Q number, whether the item or the label occurs
    more than once, and `problem` where a value is missing or the item is no entity address."""
    schema = "results struct<bindings array<struct<" + ", ".join(f"`{k}` struct<value string>" for k in keys) + ">>>"
    out = responses.select(F.explode(F.from_json("payload", schema).getField("results").getField("bindings")).alias("b"))
    out = out.select(*[F.nullif(F.trim(F.col(f"b.{k}.value")), F.lit("")).alias(k) for k in keys])
    qid = F.regexp_extract(F.col(keys[0]), r"^https?://www\.wikidata\.org/entity/(Q[1-9][0-9]*)$", 1)
    lacking = F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True)
    out = out.withColumn("qid", F.nullif(qid, F.lit(""))).withColumn("label_key", names.name_key(F.col(keys[1])))
    by_label = Window.partitionBy("label_key")
    several = F.min("qid").over(by_label) != F.max("qid").over(by_label)
    return out.select(*keys, "qid", (F.count("*").over(Window.partitionBy("qid")) > 1).alias("repeated_item"), F.coalesce(several, F.lit(False)).alias("shared_label"), F.when(lacking, "missing_value").when(F.col("qid").isNull(), "item_address").alias("problem"))
