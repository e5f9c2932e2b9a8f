"""Scoring of probabilities: metrics, calibration, splits, block bootstrap, logistic fits, temperature."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-12
#: Dates (three centuries of days) that a table of one row for each date may have to be broadcast or brought to the driver.
MOST_DATES = 110_000


def loss(p: Column, y: Column, clip: float = CLIP) -> Column:
    """Log loss of one row; null where p is null (greatest and least would skip it)."""
    clipped = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return -F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))


def binary_metrics(p: Column, y: Column) -> list[Column]:
    """Number, accuracy (p of one half picks 1), Brier score and log loss."""
    return [
        F.count(F.lit(1)).alias("n"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss(p, y)).alias("log_loss"),
    ]


def compared(rows: DataFrame, models: dict[str, Column], cohorts: dict[str, Column], y: str) -> DataFrame:
    """Metrics of every model in every cohort, over the cohort's rows for which the model has a probability; `asked` are all rows of the cohort.
    One aggregate in a single pass, however many models there are."""
    long = rows.select(y, *[c.alias(f"_in_{k}") for k, c in cohorts.items()], *[p.alias(f"_p_{m}") for m, p in models.items()])
    cells = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("cohort"), F.col(f"_p_{m}").alias("p"), F.col(f"_in_{k}").alias("inside")) for m in models for k in cohorts]
    _, *scores = binary_metrics(F.col("p"), F.col("y"))
    found = long.select(F.col(y).alias("y"), F.inline(F.array(*cells))).where("inside").groupBy("model", "cohort").agg(F.count("*").alias("asked"), F.count("p").alias("n"), *scores)
    return found.select("model", "cohort", "asked", "n", "accuracy", "brier", "log_loss")


def calibration(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """Equal bins of p with counts and means; empty bins are there, with null means."""
    found = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(found), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def split_by_date(df: DataFrame, date: str, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """train, validation or test by whole dates. Dates are ranked on their own, so rows are not moved to one task."""
    dates = df.select(date).distinct()
    ranked = dates.withColumn("_r", F.dense_rank().over(Window.orderBy(date)))  # as many rows as there are dates
    total = dates.count()
    first, second = int(total * shares[0]), int(total * (shares[0] + shares[1]))
    part = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= second, "validation").otherwise("test")
    ranked = ranked.withColumn("split", part).drop("_r")
    return df.join(F.broadcast(ranked) if total <= MOST_DATES else ranked, date)


def block_sums(df: DataFrame, date: str, values: list[Column]) -> DataFrame:
    """Counts and sums for each date: what the bootstrap draws from."""
    return df.groupBy(date).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)])


def bootstrap(blocks: DataFrame, date: str, value: str = "s0", repeats: int = 2000, seed: int = 20260926) -> tuple[float, float]:
    """95 % interval of a mean by drawing whole dates; blocks has a row for each date, which bounds what the driver gets."""
    rows = [(r[value], r["n"]) for r in blocks.orderBy(date).limit(MOST_DATES + 1).collect()]
    if len(rows) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates; draw coarser blocks")
    rnd, out = random.Random(seed), []
    for _ in range(repeats):
        drawn = [rows[rnd.randrange(len(rows))] for _ in rows]
        out.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
    out.sort()
    return out[int(0.025 * (repeats - 1))], out[int(0.975 * (repeats - 1))]


def logistic(df: DataFrame, features: list[str], label: str, l2: float):
    """Logistic regression without intercept: mean log loss plus half l2 times the squared weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, F.col(label).cast("double").alias("_y")))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", fitIntercept=False, standardization=False, regParam=l2, tol=1e-12, maxIter=500).fit(data)
    return dict(zip(features, fit.coefficients.toArray().tolist(), strict=True))


def score(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(w)
    return 1 / (1 + F.exp(-total))


def temperature(df: DataFrame, p: str, y: str, steps: int = 40) -> float:
    """The scale of the logits with the least loss between 0.25 and 4, plus .002 (s - 1)**2; 1 with fewer than 30 rows.
    Each step is an aggregate over the rows for a grid of scales; no rows come to the driver."""
    logit = F.log(F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP)) / (1 - F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))))
    rows = df.select(logit.alias("z"), F.col(y).alias("y")).persist()
    try:
        if rows.count() < 30:
            return 1.0
        low, high = 0.25, 4.0
        for _ in range(max(1, steps // 8)):
            grid = [low + (high - low) * i / 16 for i in range(17)]
            got = rows.agg(*[F.avg(loss(1 / (1 + F.exp(-F.col("z") * s)), F.col("y"))).alias(f"g{i}") for i, s in enumerate(grid)]).first()
            best = min(range(17), key=lambda i: got[i] + 0.002 * (grid[i] - 1) ** 2)
            low, high = grid[max(0, best - 1)], grid[min(16, best + 1)]
        return (low + high) / 2
    finally:
        rows.unpersist()


def report_problems(saved: DataFrame, forecasts: DataFrame, cohort: str, within: float = 1e-6) -> DataFrame:
    """A saved report (cohort, n, ones, zeros, brier, low, high) against its own rules and against the forecasts (cohort, p, y) that it is made from."""
    again = forecasts.groupBy(cohort).agg(F.count("*").alias("_n"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("_brier"))
    both = saved.join(again, cohort)
    return both.select(
        cohort, (F.col("n") == F.col("ones") + F.col("zeros")).alias("outcomes_add_up"), (F.col("n") == F.col("_n")).alias("rows_match"),
        (F.abs(F.col("brier") - F.col("_brier")) < within).alias("metrics_match"), ((F.col("low") >= 0) & (F.col("high") <= 1) & (F.col("low") <= F.col("high"))).alias("in_range"),
    )


def contributions(weights: dict[str, float], scale: float = 1.0) -> Column:
    """(name, weight * value * scale) of the three largest by size."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(n) * w * scale).alias("value")) for n, w in weights.items()])
    order = F.array_sort(F.transform(parts, lambda x: F.struct((-F.abs(x["value"])).alias("k"), x["name"].alias("name"), x["value"].alias("value"))))
    return F.transform(F.slice(order, 1, 3), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


