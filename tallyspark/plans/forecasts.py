"""Forecasts of the test tables' contests: live, by vector, selected by folds, compared in pairs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, forecast
from ..operators.store import forget, stored
from .domain import RECORDS, records
from .models import vectors_of, with_people

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(year: int) -> int:
    return (date(year, 1, 1) - date(1970, 1, 1)).days


AS_OF = day(2000)
NAMES = ["log_contests", "win_rate", "form"]


def rows_before(spark: SparkSession, sf_dir: str, as_of: int | None = None) -> DataFrame:
    """bout_id, day, y and the three differences of every contest, from strictly earlier dates; contests from as_of on see only what was before it."""
    base = records(spark, sf_dir)
    seen = base if as_of is None else base.withColumn("day", F.least("day", F.lit(as_of)))
    pairs = features.sides(features.state(seen), ["points", "scored", "total", "form"])
    d = {
        "log_contests": F.log1p("a.scored") - F.log1p("b.scored"),
        "win_rate": (F.col("a.total") + 1) / (F.col("a.scored") + 2) - (F.col("b.total") + 1) / (F.col("b.scored") + 2),
        "form": F.col("a.form") - F.col("b.form"),
    }
    y = F.when(F.col("a.points").isin(0.0, 1.0), F.col("a.points"))
    return pairs.select("bout_id", "day", y.alias("y"), F.array(*[d[n] for n in NAMES]).alias("x"))


def seen_sql(limit: str) -> str:
    """The same differences, every contest against every earlier one of its sides; `limit` is the day before which a record must lie."""
    return f"""WITH {RECORDS},
    aim AS MATERIALIZED (SELECT bout_id, fighter_id, opponent_id, points, {limit} AS day FROM records),
    sums AS (SELECT t.bout_id, t.fighter_id, count(p.points) AS scored, coalesce(sum(p.points), 0) AS total
        FROM aim t LEFT JOIN records p ON p.fighter_id = t.fighter_id AND p.day < t.day GROUP BY ALL),
    forms AS (SELECT bout_id, fighter_id, (coalesce(sum(points), 0) + 1) / (count(points) + 2) AS form FROM (
        SELECT t.bout_id, t.fighter_id, p.points, row_number() OVER (PARTITION BY t.bout_id, t.fighter_id ORDER BY p.day DESC, p.event_id DESC, p.bout_id DESC) AS k
        FROM aim t LEFT JOIN records p ON p.fighter_id = t.fighter_id AND p.day < t.day AND p.points IS NOT NULL) WHERE k <= 5 GROUP BY ALL),
    s AS (SELECT * FROM aim JOIN sums USING (bout_id, fighter_id) JOIN forms USING (bout_id, fighter_id)),
    r AS MATERIALIZED (SELECT a.bout_id, a.day, CASE WHEN a.points IN (0, 1) THEN a.points END AS y, ln(1 + a.scored) - ln(1 + b.scored) AS x1,
        (a.total + 1) / (a.scored + 2) - (b.total + 1) / (b.scored + 2) AS x2, a.form - b.form AS x3 FROM s a JOIN s b ON b.bout_id = a.bout_id AND a.fighter_id < b.fighter_id)"""


def live_sql(steps: int = 9) -> str:
    """Newton steps of three weights one after the other (the inverse by cofactors), then of the temperature."""
    parts = [
        seen_sql(f"least(day, {AS_OF})"),
        f"known AS MATERIALIZED (SELECT * FROM r WHERE day < {AS_OF} AND y IS NOT NULL)",
        "days AS (SELECT day, count(*) AS n FROM known GROUP BY day)",
        "tail AS (SELECT day, sum(n) OVER (ORDER BY day DESC) - n AS later, row_number() OVER (ORDER BY day DESC) AS k, sum(n) OVER () AS total FROM days)",
        "border AS MATERIALIZED (SELECT min(day) AS first FROM tail WHERE later < greatest(30, ceil(total * 0.2)) OR k <= 2)",
        "train AS MATERIALIZED (SELECT known.* FROM known, border WHERE day < first)",
        "calibrate AS MATERIALIZED (SELECT known.* FROM known, border WHERE day >= first)",
        "w0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)",
    ]
    for k in range(steps):
        p = "1 / (1 + exp(-(a * x1 + b * x2 + c * x3)))"
        sums = ", ".join(f"avg(p * (1 - p) * x{i} * x{j}) + {0.02 if i == j else 0.0} AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
        parts += [
            f"p{k} AS (SELECT *, {p} AS p FROM train, w{k})",
            f"g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, avg((p - y) * x1) + 0.02 * any_value(a) AS g1, avg((p - y) * x2) + 0.02 * any_value(b) AS g2, avg((p - y) * x3) + 0.02 * any_value(c) AS g3, {sums} FROM p{k})",
            f"i{k} AS (SELECT *, h22 * h33 - h23 * h23 AS c11, h13 * h23 - h12 * h33 AS c12, h12 * h23 - h13 * h22 AS c13, h11 * h33 - h13 * h13 AS c22, h12 * h13 - h11 * h23 AS c23, h11 * h22 - h12 * h12 AS c33 FROM g{k})",
            f"w{k + 1} AS MATERIALIZED (SELECT a - (c11 * g1 + c12 * g2 + c13 * g3) / d AS a, b - (c12 * g1 + c22 * g2 + c23 * g3) / d AS b, c - (c13 * g1 + c23 * g2 + c33 * g3) / d AS c FROM (SELECT *, h11 * c11 + h12 * c12 + h13 * c13 AS d FROM i{k}))",
        ]
    parts += [f"z AS MATERIALIZED (SELECT y, a * x1 + b * x2 + c * x3 AS z FROM calibrate, w{steps})", "s0 AS (SELECT 1.0::DOUBLE AS s)"]
    for k in range(steps + 3):
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT any_value(s) - (avg((p - y) * z) + 0.004 * (any_value(s) - 1)) / (avg(p * (1 - p) * z * z) + 0.004) AS s FROM (SELECT *, 1 / (1 + exp(-s * z)) AS p FROM z, s{k}))")
    heat = f"(SELECT CASE WHEN (SELECT count(*) FROM z) < 30 THEN 1.0 ELSE greatest(0.25, least(4.0, s)) END AS s FROM s{steps + 3})"
    return ",\n".join(parts) + f"\nSELECT bout_id, round(1 / (1 + exp(-h.s * (a * x1 + b * x2 + c * x3))), 6) AS p FROM r, w{steps}, {heat} h WHERE day >= {AS_OF}"


@query(live_sql())
def live_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for every contest from 2000 on, from the contests before: trained on the earlier dates, calibrated on the reserved ones."""
    rows = stored(rows_before(spark, sf_dir, AS_OF), "live")
    run = forecast.live(rows, rows.where(F.col("day") >= AS_OF), NAMES, AS_OF)
    return run.forecasts.select("bout_id", F.round("p", 6).alias("p"))


#: Where the four vectors stand when base, the hinge, the ten recent and the 22 context differences are one array.
KINDS = {"base": 13, "reduced": 11, "rich": 21, "whole": 43}


@query()
def vector_forecasts(spark, sf_dir):
    """Research forecasts of every contest from 2000 on by the vectors of 13, 11, 21 and 43 features; four fits share the passes (against a plain
    numpy fit in the tests)."""
    base = stored(with_people(spark, sf_dir), "records")
    y = base.where("fighter_id < opponent_id").select("bout_id", "day", F.when(F.col("points").isin(0.0, 1.0), F.col("points")).alias("y"))
    places = [("base", i) for i in range(13)] + [("reduced", 10)] + [("recent", i) for i in range(10)] + [("context", i) for i in range(22)]
    # each feature once, as a column of its own: those with few values take next to no place
    once = vectors_of(base, features.vector_parts).join(y, "bout_id").select("bout_id", "day", "y", *[F.get(c, F.lit(i)).alias(f"x{k}") for k, (c, i) in enumerate(places)])
    rows = stored(once, "vectors")
    forget(base)
    return vector_models(rows.select("bout_id", "day", "y", F.array(*[f"x{k}" for k in range(len(places))]).alias("x")), AS_OF, ONCE)


#: Places of the vectors in the 13, then the 43 (which begin with the 11 and the 21).
PLACES = {"base": range(13), "reduced": range(13, 24), "rich": range(13, 34), "whole": range(13, 56)}
#: Places where each feature is there once: the 13, the age hinge, 10 recent and 22 context differences.
SHARED = [features.BASE.index(n) for n in features.REDUCED[:-1]] + [13]
ONCE = {"base": range(13), "reduced": SHARED, "rich": [*SHARED, *range(14, 24)], "whole": [*SHARED, *range(14, 46)]}


def vector_models(rows: DataFrame, as_of: int, places: dict = PLACES) -> DataFrame:
    """rows: x, of which a vector takes its places."""
    known = rows.where((F.col("day") < as_of) & F.col("y").isNotNull())
    days = forecast.per_day(known)
    border = forecast.border_of([d for d, _ in days], 0.15)
    fits = [forecast.Fit(days[0][0], border, tuple(p), 0.02) for p in places.values()]
    weights = [w for _, w in forecast.newton(known, fits)]
    heat = forecast.scales(known, [forecast.temperature_of(f, w, border, as_of) for f, w in zip(fits, weights, strict=True)])
    each = [forecast.probability(F.col("x"), f.columns, w, s).alias(f"p_{k}") for k, f, w, s in zip(places, fits, weights, heat, strict=True)]
    return rows.where(F.col("day") >= as_of).select("bout_id", *each)


YEARS = (1997, 1998, 1999)
PROTOCOL = forecast.Protocol(
    "one-difference-v1",
    tuple(forecast.Candidate(n, (i,)) for i, n in enumerate(NAMES)) + (forecast.Candidate("form_two_years", (2,), 0.1, 2),),
    tuple(forecast.Fold(str(y), day(y), day(y + 1)) for y in YEARS),
    "log_contests",
)


def selection_sql(steps: int = 12) -> str:
    candidates = ", ".join(f"('{c.name}', {c.columns[0] + 1}, {c.l2}, {'NULL' if c.lookback is None else int(c.lookback * 365.2425)})" for c in PROTOCOL.candidates)
    folds = ", ".join(f"('{f.name}', {f.origin}, {f.until})" for f in PROTOCOL.folds)
    parts = [
        seen_sql("day"),
        "known AS MATERIALIZED (SELECT * FROM r WHERE y IS NOT NULL)",
        f"cells AS (SELECT *, coalesce(origin - back, (SELECT min(day) FROM known)) AS low FROM (VALUES {candidates}) c(candidate, place, l2, back), (VALUES {folds}) f(fold, origin, until))",
        "dates AS (SELECT candidate, fold, day, row_number() OVER (PARTITION BY candidate, fold ORDER BY day) AS k, count(*) OVER (PARTITION BY candidate, fold) AS n FROM cells JOIN (SELECT DISTINCT day FROM known) ON day >= low AND day < origin)",
        "borders AS (SELECT candidate, fold, day AS border FROM dates WHERE k = n - greatest(1, floor(n * 0.15)) + 1)",
        """l AS MATERIALIZED (SELECT candidate, fold, l2, bout_id, y, CASE place WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS x, CASE WHEN day >= origin THEN 'test' WHEN day >= border THEN 'tail' ELSE 'train' END AS part
            FROM cells JOIN borders USING (candidate, fold) JOIN known ON day >= low AND day < until)""",
        "w0 AS (SELECT candidate, fold, 0.0::DOUBLE AS w FROM cells)",
    ]
    for k in range(steps):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT candidate, fold, any_value(w) - (avg((p - y) * x) + any_value(l2) * any_value(w)) / (avg(p * (1 - p) * x * x) + any_value(l2)) AS w FROM (SELECT *, 1 / (1 + exp(-w * x)) AS p FROM l JOIN w{k} USING (candidate, fold) WHERE part = 'train') GROUP BY ALL)")
    parts += [f"z AS MATERIALIZED (SELECT candidate, fold, y, w * x AS z, part FROM l JOIN w{steps} USING (candidate, fold) WHERE part <> 'train')", "s0 AS (SELECT candidate, fold, 1.0::DOUBLE AS s FROM cells)"]
    for k in range(steps):
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT candidate, fold, any_value(s) - (avg((p - y) * z) + 0.004 * (any_value(s) - 1)) / (avg(p * (1 - p) * z * z) + 0.004) AS s FROM (SELECT *, 1 / (1 + exp(-s * z)) AS p FROM z JOIN s{k} USING (candidate, fold) WHERE part = 'tail') GROUP BY ALL)")
    parts += [
        "few AS (SELECT candidate, fold, count(*) FILTER (WHERE part = 'tail') < 30 AS few FROM z GROUP BY ALL)",
        f"p AS (SELECT candidate, y, 1 / (1 + exp(-CASE WHEN few THEN 1.0 ELSE greatest(0.25, least(4.0, s)) END * z)) AS p FROM z JOIN s{steps} USING (candidate, fold) JOIN few USING (candidate, fold) WHERE part = 'test')",
        "t AS (SELECT candidate, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS exact FROM p GROUP BY candidate)",
    ]
    return ",\n".join(parts) + "\nSELECT candidate, n, brier, log_loss, exact = (SELECT min(exact) FROM t) AS selected FROM t"


@query(selection_sql())
def selected_policies(spark, sf_dir):
    """Policies tried on yearly folds, each trained on the dates before, calibrated on their tail and scored on the year; the least loss is
    selected. `forecast.select` gives the document that is frozen; a changed row makes its verification fail (tests)."""
    rows = stored(rows_before(spark, sf_dir), "folds")
    document = forecast.select(rows, PROTOCOL)
    forget(rows)
    found = [(k, t["n"], round(t["brier"], 6), round(t["log_loss"], 6), k == document["selected"]) for k, t in document["trials"].items()]  # a row for each candidate
    return spark.createDataFrame(found, "candidate string, n long, brier double, log_loss double, selected boolean")


REPEATS, SEED = 2000, 20260926
LOSS = "-CASE WHEN y = 1 THEN ln({p}) ELSE ln(1 - {p}) END"


@query(f"""{seen_sql("day")},
    p AS (SELECT CASE WHEN bout_id % 3 = 0 THEN 'third' ELSE 'rest' END AS cohort, day, y, 1 / (1 + exp(-2.0 * x2)) AS p0, 1 / (1 + exp(-2.0 * x3)) AS p1 FROM r WHERE y IS NOT NULL),
    blocks AS MATERIALIZED (SELECT cohort, day, row_number() OVER (PARTITION BY cohort ORDER BY day) - 1 AS slot, count(*) AS n, sum({LOSS.format(p="p0")}) AS l0, sum({LOSS.format(p="p1")}) AS l1, sum((p0 - y) * (p0 - y)) AS b0, sum((p1 - y) * (p1 - y)) AS b1 FROM p GROUP BY cohort, day),
    whole AS (SELECT cohort, count(*) AS dates, sum(n)::BIGINT AS n, sum(l0) AS l0, sum(l1) AS l1, sum(b0) AS b0, sum(b1) AS b1 FROM blocks GROUP BY cohort),
    draws AS (SELECT cohort, repeat, ('0x' || left(md5('{SEED}:' || repeat || ':' || draw), 12))::BIGINT % dates AS slot FROM whole, range({REPEATS}) a(repeat), range((SELECT max(dates) FROM whole)) b(draw) WHERE draw < dates),
    means AS (SELECT cohort, repeat, (sum(l1) - sum(l0)) / sum(n) AS dl, (sum(b1) - sum(b0)) / sum(n) AS db FROM draws JOIN blocks USING (cohort, slot) GROUP BY ALL),
    ends AS (SELECT cohort, list_sort(list(dl)) AS dl, list_sort(list(db)) AS db FROM means GROUP BY cohort)
    SELECT cohort, n, dates, round(l0 / n, 6) AS baseline_loss, round(l1 / n, 6) AS candidate_loss, round((l1 - l0) / n, 6) + 0.0 AS loss_delta, round(dl[{int(0.025 * (REPEATS - 1)) + 1}], 6) AS loss_low, round(dl[{int(0.975 * (REPEATS - 1)) + 1}], 6) AS loss_high,
        round((b1 - b0) / n, 6) + 0.0 AS brier_delta, round(db[{int(0.025 * (REPEATS - 1)) + 1}], 6) AS brier_low, round(db[{int(0.975 * (REPEATS - 1)) + 1}], 6) AS brier_high FROM whole JOIN ends USING (cohort)""")
def paired_comparison(spark, sf_dir):
    """Two models over the same contests, by cohort: losses, their difference, and its interval by 2,000 draws of whole dates."""
    rows = rows_before(spark, sf_dir).where("y is not null")
    p = lambda k: 1 / (1 + F.exp(F.lit(-2.0) * F.get("x", F.lit(k))))
    rows = rows.select(F.when(F.col("bout_id") % 3 == 0, "third").otherwise("rest").alias("cohort"), "day", "y", p(1).alias("p0"), p(2).alias("p1"))
    out = forecast.paired(rows, "day", "y", "p0", "p1", "cohort", REPEATS, SEED)
    return out.select("cohort", "n", "dates", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns[3:]])


@query(f"""{seen_sql("day")},
    m AS (SELECT 'coin' AS model, y, 0.5::DOUBLE AS p FROM r WHERE y IS NOT NULL UNION ALL SELECT 'win_rate', y, 1 / (1 + exp(-2.0 * x2)) FROM r WHERE y IS NOT NULL
        UNION ALL SELECT 'younger', y, CASE WHEN a.s % 4 <> 0 AND b.s % 4 <> 0 AND a.s % 300 <> b.s % 300 THEN CASE WHEN a.s % 300 > b.s % 300 THEN 0.55 ELSE 0.45 END ELSE 0.5 END FROM r JOIN (SELECT bout_id, fighter_id AS s, opponent_id AS o FROM records) a ON a.bout_id = r.bout_id AND a.s < a.o JOIN (SELECT bout_id, fighter_id AS s FROM records) b ON b.bout_id = r.bout_id AND b.s = a.o WHERE y IS NOT NULL)
    SELECT model, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({LOSS.format(p="p")}), 6) AS log_loss FROM m GROUP BY model""")
def plain_baselines(spark, sf_dir):
    """A coin, earlier win rates, and the younger side (0.55 where both births are known and differ) on all decided contests."""
    from .domain import people

    sides = features.sides(records(spark, sf_dir).join(people(spark, sf_dir), "fighter_id", "left"), ["birth_day"]).select("bout_id", F.col("a.birth_day").alias("a"), F.col("b.birth_day").alias("b"))
    rows = rows_before(spark, sf_dir).where("y is not null").join(sides, "bout_id")
    younger = F.when(F.col("a") > F.col("b"), 0.55).when(F.col("a") < F.col("b"), 0.45).otherwise(0.5)
    models = {"coin": F.lit(0.5), "win_rate": 1 / (1 + F.exp(F.lit(-2.0) * F.get("x", F.lit(1)))), "younger": younger}
    out = evaluate.compared(rows, models, {"all": F.lit(True)}, "y")
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "log_loss")])
