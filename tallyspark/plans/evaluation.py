"""Scores of probabilities and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evaluate
from .domain import CONTESTS, FORECASTS, contests, forecasts, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LOSS = "-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12), 1 - 1e-12)) ELSE ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) END"


@query(f"""WITH {FORECASTS} SELECT lang, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({LOSS}), 6) AS log_loss FROM forecasts GROUP BY lang""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, Brier score and log loss of each cohort."""
    n, *rest = evaluate.binary_metrics(F.col("p"), F.col("y"))
    return forecasts(spark, sf_dir).groupBy("lang").agg(n, *rest).select("lang", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss")])


@query(f"""WITH {FORECASTS}, b AS (SELECT CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM forecasts GROUP BY 1)
    SELECT CAST(range AS BIGINT) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM range(5) LEFT JOIN b ON bin = range""")
def calibration_bins(spark, sf_dir):
    """Five bins of all forecasts; empty ones are there (a test shows one)."""
    return calibrated(forecasts(spark, sf_dir))


def calibrated(rows: DataFrame) -> DataFrame:
    return evaluate.calibration(rows, "p", "y").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(f"""WITH {FORECASTS}, b AS (SELECT CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM forecasts GROUP BY 1)
    SELECT CAST(range AS BIGINT) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM range(5) LEFT JOIN b ON bin = range""")
def calibration_bins_all(spark, sf_dir):
    """The same as calibration_bins, which once left out a part."""
    return calibration_bins(spark, sf_dir)


@query(f"""WITH {FORECASTS}, f AS (SELECT greatest(p, 1 - p) AS q, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS hit FROM forecasts)
    SELECT CASE WHEN q < 0.6 THEN 0.5 WHEN q < 0.7 THEN 0.6 WHEN q < 0.8 THEN 0.7 WHEN q < 0.9 THEN 0.8 ELSE 0.9 END::DOUBLE AS edge, count(*) AS n, round(avg(q), 6) AS mean_q, round(avg(hit), 6) AS hits FROM f GROUP BY 1""")
def favourite_bins(spark, sf_dir):
    """Reliability of favourites."""
    q = F.greatest("p", 1 - F.col("p"))
    edge = F.when(F.col("q") < 0.6, 0.5).when(F.col("q") < 0.7, 0.6).when(F.col("q") < 0.8, 0.7).when(F.col("q") < 0.9, 0.8).otherwise(0.9)
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")
    return forecasts(spark, sf_dir).withColumn("q", q).groupBy(edge.alias("edge")).agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean_q"), F.round(F.avg(hit), 6).alias("hits"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT d, dense_rank() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM d)
    SELECT CASE WHEN r <= CAST(floor(n * 0.7) AS INT) THEN 'train' WHEN r <= CAST(floor(n * 0.85) AS INT) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT d) AS dates, min(d) AS first_date, max(d) AS last_date
    FROM orders JOIN r ON d = CAST(o_orderdate AS DATE) GROUP BY 1""")
def chronological_split(spark, sf_dir):
    """Whole dates in order."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return evaluate.split_by_date(o, "d").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("d").alias("dates"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))


@query(f"""WITH {CONTESTS}, b AS (SELECT event_date, count(*) AS n, sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END)::BIGINT AS wins FROM contests GROUP BY 1) SELECT event_date, n, wins FROM b""")
def date_blocks(spark, sf_dir):
    """What the block bootstrap draws from."""
    return contests(spark, sf_dir).groupBy("event_date").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "win").alias("wins"))


@query()
def bootstrap_interval(spark, sf_dir):
    """95 % interval of the share of wins, by dates."""
    blocks = evaluate.block_sums(contests(spark, sf_dir), "event_date", [(F.col("outcome") == "win").cast("double")])
    low, high = evaluate.bootstrap(blocks, "event_date")
    return spark.createDataFrame([(low, high)], "low double, high double")


@query()
def logistic_fit(spark, sf_dir):
    """M5: weights of a regularised logistic model without intercept."""
    rows = forecasts(spark, sf_dir).select((F.col("p") - 0.5).alias("x1"), (F.col("doc_id") % 7 / 7 - 0.4).alias("x2"), "y")
    weights = evaluate.logistic(rows, ["x1", "x2"], "y", 0.02)
    return spark.createDataFrame(list(weights.items()), "feature string, weight double")


@query()
def temperature_fit(spark, sf_dir):
    """M6: the scale of the logits that fits best."""
    return spark.createDataFrame([(evaluate.temperature(forecasts(spark, sf_dir), "p", "y"),)], "scale double")


@query(f"""WITH {FORECASTS}, l AS (SELECT k AS candidate, y, least(greatest(p * (1 - k) + 0.8 * k, 1e-12), 1 - 1e-12) AS p FROM forecasts, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(k)), s AS (SELECT candidate, avg({LOSS}) AS loss FROM l GROUP BY 1)
    SELECT candidate, round(loss, 6) AS log_loss, row_number() OVER (ORDER BY loss, candidate) AS place FROM s""")
def candidate_selection(spark, sf_dir):
    """Losses of a declared list of candidates in one pass, and their order."""
    ks = [0.0, 0.5, 0.9]
    losses = [F.avg(evaluate.loss(F.col("p") * (1 - k) + 0.8 * k, F.col("y"))).alias(f"k{i}") for i, k in enumerate(ks)]
    one = forecasts(spark, sf_dir).agg(*losses)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(f"k{i}").alias("loss")) for i, k in enumerate(ks)])))
    return rows.select("candidate", F.round("loss", 6).alias("log_loss"), F.row_number().over(Window.orderBy("loss", "candidate")).cast("long").alias("place"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: -x)[1:2] AS swapped, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.5)), 5) + 0.0 AS contribution FROM embeddings""")
def vector_orientation(spark, sf_dir):
    """Contributions over whole vectors, and the first two negated entries; vector_orientation_whole returns all of them."""
    e = F.col("embedding")
    part = F.aggregate(F.transform(e, lambda x: x.cast("double") * 0.5), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.transform(e, lambda x: -x), 1, 2).alias("swapped"), (F.round(part, 5) + 0.0).alias("contribution"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: -x) AS swapped, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.5)), 5) + 0.0 AS contribution FROM embeddings""")
def vector_orientation_whole(spark, sf_dir):
    """Negated features and linear contributions over whole arrays."""
    e = F.col("embedding")
    part = F.aggregate(F.transform(e, lambda x: x.cast("double") * 0.5), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(e, lambda x: -x).alias("swapped"), (F.round(part, 5) + 0.0).alias("contribution"))


@query(f"""WITH {FORECASTS} SELECT doc_id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) + 0.0 AS logit,
    CASE WHEN greatest(p, 1 - p) = 0.5 THEN 'even' WHEN greatest(p, 1 - p) < 0.55 THEN 'near even' WHEN greatest(p, 1 - p) < 0.6 THEN 'small' WHEN greatest(p, 1 - p) < 0.7 THEN 'clear' ELSE 'strong' END AS favourite FROM forecasts""")
def logit_labels(spark, sf_dir):
    """C18, C33."""
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    return forecasts(spark, sf_dir).select("doc_id", (F.round(F.log(p / (1 - p)), 6) + 0.0).alias("logit"), scalar.favourite(F.col("p")).alias("favourite"))
