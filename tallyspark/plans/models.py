"""Feature vectors, metric bundles, replays and ratings over the test tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, evaluate, features, folds
from ..operators.store import stored
from .domain import PEOPLE, RECORDS, people, records
from .history import scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Fixed(NamedTuple):
    """A metric as the SQL has it, in numbers of its own: not made of operators.features."""

    name: str
    num: str
    den: str
    valid: str
    prior: float
    weight: float
    unit: float = 1.0
    complement: bool = False
    counted: str = "true"


PER_MINUTE, ENDED = "elapsed / 60", "points in (0, 1) and method in ('ko_tko', 'submission', 'decision', 'decision_unanimous', 'decision_split', 'decision_majority')"
#: The ten recent metrics and ten of the context metrics: name, sums, which rows count, prior, weight, unit.
RECENT_SQL = (
    Fixed("sig_landed_per_minute", "sig_landed", PER_MINUTE, "sig_landed is not null and elapsed > 0", 3.0, 30.0),
    Fixed("sig_absorbed_per_minute", "o_sig_landed", PER_MINUTE, "o_sig_landed is not null and elapsed > 0", 3.0, 30.0),
    Fixed("sig_accuracy", "sig_landed", "sig_attempted", "sig_landed <= sig_attempted", 0.5, 50.0, counted="sig_attempted > 0"),
    Fixed("sig_defence", "o_sig_landed", "o_sig_attempted", "o_sig_landed <= o_sig_attempted", 0.5, 50.0, complement=True, counted="o_sig_attempted > 0"),
    Fixed("knockdowns_per_15", "kd", PER_MINUTE, "kd is not null and elapsed > 0", 0.1, 30.0, 15.0),
    Fixed("takedowns_per_15", "td_landed", PER_MINUTE, "td_landed is not null and elapsed > 0", 1.0, 30.0, 15.0),
    Fixed("takedown_accuracy", "td_landed", "td_attempted", "td_landed <= td_attempted", 0.4, 10.0, counted="td_attempted > 0"),
    Fixed("takedown_defence", "o_td_landed", "o_td_attempted", "o_td_landed <= o_td_attempted", 0.4, 10.0, complement=True, counted="o_td_attempted > 0"),
    Fixed("submission_attempts_per_15", "sub_attempts", PER_MINUTE, "sub_attempts is not null and elapsed > 0", 0.5, 30.0, 15.0),
    Fixed("control_share", "control_seconds", "elapsed", "elapsed > 0 and control_seconds <= elapsed", 0.25, 1800.0),
)
CONTEXT_SQL = (
    Fixed("clinch_share", "clinch_attempted", "sig_attempted", "sig_attempted > 0 and clinch_attempted <= sig_attempted", 0.10, 50.0),
    Fixed("ground_share", "ground_attempted", "sig_attempted", "sig_attempted > 0 and ground_attempted <= sig_attempted", 0.15, 50.0),
    Fixed("body_share", "body_attempted", "sig_attempted", "sig_attempted > 0 and body_attempted <= sig_attempted", 0.20, 50.0),
    Fixed("leg_share", "leg_attempted", "sig_attempted", "sig_attempted > 0 and leg_attempted <= sig_attempted", 0.15, 50.0),
    Fixed("takedown_attempts_per_15", "td_attempted", PER_MINUTE, "td_attempted is not null and elapsed > 0", 2.5, 30.0, 15.0),
    Fixed("ko_win_share", "case when method = 'ko_tko' and points = 1 then 1 else 0 end", "1", ENDED, 0.15, 4.0),
    Fixed("ko_loss_share", "case when method = 'ko_tko' and points = 0 then 1 else 0 end", "1", ENDED, 0.15, 4.0),
    Fixed("submission_win_share", "case when method = 'submission' and points = 1 then 1 else 0 end", "1", ENDED, 0.10, 4.0),
    Fixed("submission_loss_share", "case when method = 'submission' and points = 0 then 1 else 0 end", "1", ENDED, 0.10, 4.0),
    Fixed("opponent_win_rate", "o_rate", "1", "o_rate is not null", 0.5, 2.0),
)


def last_five_sql(metrics: tuple[Fixed, ...], more: str = "", source: str = "records") -> str:
    """The metrics over the last five contests before the embargo as SQL: every earlier record is ranked for every target."""
    value = lambda m: ("1 - " if m.complement else "") + f"(coalesce({m.name}_num, 0) + {m.prior * m.weight / m.unit!r}::DOUBLE) / (coalesce({m.name}_den, 0) + {m.weight!r}::DOUBLE) * {m.unit!r}::DOUBLE"
    sums = ", ".join(f"sum({m.num}) FILTER (WHERE {m.valid}) AS {m.name}_num, sum({m.den}) FILTER (WHERE {m.valid}) AS {m.name}_den, count(*) FILTER (WHERE {m.valid} AND {m.counted}) AS {m.name}_n" for m in metrics)
    out = ", ".join(f"round({value(m)}, 9) + 0.0 AS {m.name}, coalesce({m.name}_n, 0) AS {m.name}_n" for m in metrics)
    return f"""WITH {RECORDS}{more}, past AS (SELECT f.bout_id AS t_bout, f.fighter_id AS t_fighter, p.*, rank() OVER (PARTITION BY f.bout_id, f.fighter_id ORDER BY p.day DESC) AS place FROM records f JOIN {source} p ON p.fighter_id = f.fighter_id AND p.day < f.day - 2),
    sums AS (SELECT t_bout, t_fighter, count(*) AS n_last, {sums} FROM past WHERE place <= 5 GROUP BY ALL)
    SELECT f.bout_id, f.fighter_id, coalesce(n_last, 0) AS n_last, {out} FROM records f LEFT JOIN sums ON t_bout = f.bout_id AND t_fighter = f.fighter_id"""


def rounded(rows: DataFrame, metrics: tuple[features.Ratio, ...]) -> DataFrame:
    return rows.select("bout_id", "fighter_id", "n_last", *[x for m in metrics for x in ((F.round(m.name, 9) + 0.0).alias(m.name), F.col(f"{m.name}_n"))])


@query(last_five_sql(RECENT_SQL))
def recent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten recent metrics of each side with their numbers of observations, over the last five contests with ties, before an embargo."""
    return rounded(features.metrics_before(records(spark, sf_dir), features.RECENT, keep=["bout_id", "fighter_id"]), features.RECENT)


RATES = """, rated AS (SELECT f.*, (SELECT NULL) AS none, CASE WHEN r.n > 0 THEN r.t / r.n END AS o_rate FROM records f JOIN (SELECT f.bout_id, f.fighter_id, count(p.points) AS n, coalesce(sum(p.points), 0) AS t FROM records f
    LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL) r ON r.bout_id = f.bout_id AND r.fighter_id = f.opponent_id)"""


@query(last_five_sql(CONTEXT_SQL, RATES, "rated"))
def context_metrics(spark, sf_dir):
    """A12 but for the opponents' ratings (feature_vectors has them): shares, finishes and the win rate that opponents had."""
    known = features.state(records(spark, sf_dir))
    pair = features.sides(known, ["scored", "total"])
    rate = lambda s: F.when(F.col(f"{s}.scored") > 0, F.col(f"{s}.total") / F.col(f"{s}.scored"))
    other = pair.select("bout_id", F.inline(F.array(F.struct(F.col("a.fighter_id").alias("fighter_id"), rate("b").alias("o_rate")), F.struct(F.col("b.fighter_id").alias("fighter_id"), rate("a").alias("o_rate")))))
    return rounded(features.metrics_before(known.join(other, ["bout_id", "fighter_id"]), features.CONTEXT, keep=["bout_id", "fighter_id"]), features.CONTEXT)


def style_sql() -> str:
    parts = []
    for m in features.STYLE:
        exposed = f"{m.num} IS NOT NULL AND coalesce({m.den} > 0, false)"
        over = f"({exposed} AND {m.num} > {m.den} AND {m.valid})"
        ok = f"({exposed} AND NOT {over})"
        value = f"sum({m.num}) FILTER (WHERE {ok}) / nullif(sum({m.den}) FILTER (WHERE {ok}), 0) * {m.unit!r}::DOUBLE"
        parts.append(
            f"""SELECT fighter_id, '{m.name}' AS metric, round({"1 - " if m.complement else ""}{value}, 9) + 0.0 AS value, sum({m.num}) FILTER (WHERE {ok}) AS numerator, sum({m.den}) FILTER (WHERE {ok}) AS denominator, count(*) FILTER (WHERE {ok}) AS n,
            count(*) FILTER (WHERE {m.num} IS NULL) AS no_count, count(*) FILTER (WHERE {m.num} IS NOT NULL AND NOT coalesce({m.den} > 0, false)) AS no_exposure, count(*) FILTER (WHERE {over}) AS above_exposure FROM records GROUP BY fighter_id"""
        )
    return f"WITH {RECORDS} " + " UNION ALL ".join(parts)


@query(style_sql())
def style_metrics(spark, sf_dir):
    """Seventeen style metrics of each participant with numerator, denominator, rows that count and rows left out by reason."""
    return features.style(records(spark, sf_dir)).withColumn("value", F.round("value", 9) + 0.0)


STATE = f"""WITH {RECORDS}, {PEOPLE}, shown AS (SELECT *, points IS NOT NULL AND sig_landed IS NOT NULL AND o_sig_landed IS NOT NULL AND sig_attempted > 0 AND o_sig_attempted > 0 AS ok FROM records),
    basic AS (SELECT f.bout_id, f.fighter_id, f.opponent_id, f.day, count(p.points) AS scored, coalesce(sum(p.points), 0) AS total, max(p.day) FILTER (WHERE p.points IS NOT NULL) AS last_day FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL),
    forms AS (SELECT bout_id, fighter_id, (coalesce(sum(points), 0) + 1) / (count(points) + 2) AS form FROM (SELECT f.bout_id, f.fighter_id, p.points, row_number() OVER (PARTITION BY f.bout_id, f.fighter_id ORDER BY p.day DESC, p.event_id DESC, p.bout_id DESC) AS k
        FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day AND p.points IS NOT NULL) WHERE k <= 5 GROUP BY ALL),
    given AS (SELECT f.bout_id, f.fighter_id, any_value(f.day) AS day, any_value(f.sig_landed) / any_value(f.sig_attempted) - (coalesce(sum(p.sig_landed), 0) + 1) / (coalesce(sum(p.sig_attempted), 0) + 2) AS residual FROM shown f LEFT JOIN shown p ON p.opponent_id = f.opponent_id AND p.day < f.day AND p.ok WHERE f.ok GROUP BY ALL),
    adjusted AS (SELECT f.bout_id, f.fighter_id, count(g.residual) AS stat_n, coalesce(sum(g.residual), 0) / (count(g.residual) + 2) AS adjusted FROM records f LEFT JOIN given g ON g.fighter_id = f.fighter_id AND g.day < f.day GROUP BY ALL),
    states AS (SELECT * FROM basic JOIN forms USING (bout_id, fighter_id) JOIN adjusted USING (bout_id, fighter_id) LEFT JOIN people USING (fighter_id))"""
AGE, REST = "(x.day - {s}.birth_day) / 365.2425", "CASE WHEN {s}.last_day IS NULL THEN 0 ELSE least(x.day - {s}.last_day, 730) / 365.0 END"


@query(f"""{STATE} SELECT x.bout_id, round(ln(1 + x.scored) - ln(1 + y.scored), 6) + 0.0 AS log_contests, round((x.total + 1) / (x.scored + 2) - (y.total + 1) / (y.scored + 2), 6) + 0.0 AS win_rate, round({REST.format(s="x")} - {REST.format(s="y")}, 6) + 0.0 AS rest_years,
    (x.last_day IS NOT NULL)::INT::DOUBLE - (y.last_day IS NOT NULL)::INT::DOUBLE AS known_rest, round(x.form - y.form, 6) + 0.0 AS form, round(coalesce(({AGE.format(s="x")} - {AGE.format(s="y")}) / 10, 0), 6) + 0.0 AS age, (x.birth_day IS NOT NULL)::INT::DOUBLE - (y.birth_day IS NOT NULL)::INT::DOUBLE AS known_age,
    round(coalesce((x.reach_cm - y.reach_cm) / 20, 0), 6) + 0.0 AS reach, (x.reach_cm IS NOT NULL)::INT::DOUBLE - (y.reach_cm IS NOT NULL)::INT::DOUBLE AS known_reach, round(x.adjusted - y.adjusted, 6) + 0.0 AS adjusted_accuracy, (x.stat_n > 0)::INT::DOUBLE - (y.stat_n > 0)::INT::DOUBLE AS known_accuracy,
    round(ln(1 + x.stat_n) - ln(1 + y.stat_n), 6) + 0.0 AS log_stat_contests, CASE WHEN x.birth_day IS NULL OR y.birth_day IS NULL THEN 0.0 ELSE round((greatest({AGE.format(s="x")} - 32, 0) - greatest({AGE.format(s="y")} - 32, 0)) / 5, 6) + 0.0 END::DOUBLE AS age_decline
    FROM states x JOIN states y ON y.bout_id = x.bout_id AND x.fighter_id < y.fighter_id""")
def state_differences(spark, sf_dir):
    """M1, M2 but for the ratings (feature_vectors has them): twelve differences and the age hinge of both sides before the date."""
    known = features.state(records(spark, sf_dir)).join(people(spark, sf_dir), "fighter_id", "left").withColumn("elo", F.lit(0.0))
    pairs = features.sides(known, ["elo", "scored", "total", "last_day", "form", "birth_day", "reach_cm", "adjusted", "stat_n"])
    return pairs.select("bout_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in features.differences(pairs).items() if n != "elo"])


@query()
def feature_vectors(spark, sf_dir):
    """Vectors of 13, 11, 21 and 43 features of every contest (against a plain replay in the tests). The records are made once and stored; both ratings are
    one pass over the contests that they tell of."""
    return vectors_of(stored(with_people(spark, sf_dir), "records"))


def with_people(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).join(people(spark, sf_dir), "fighter_id", "left")


def vectors_of(base: DataFrame, vectors=features.vectors) -> DataFrame:
    """Vectors (or their parts) of stored records (with birth_day and reach_cm)."""
    contests = base.where("fighter_id < opponent_id").select("event_date", "event_id", "bout_id", F.col("fighter_id").alias("a"), F.col("opponent_id").alias("b"), F.col("points").alias("score"))
    both = folds.pools(contests, [folds.Rule(32.0, date_snapshot=True), folds.Rule(64.0, by_date=True)])
    return vectors(base, both.select("bout_id", *[F.col(f"rating_{s}{n}").alias(f"{name}_{s}") for n, name in enumerate(("elo", "strong")) for s in "ab"]))


@query()
def elo_one_pool(spark, sf_dir):
    """ratings contest by contest, one rating for a participant whatever the division (against a plain fold in the tests)."""
    return folds.elo(scored(spark, sf_dir), None, 32.0)


ELO = f"""WITH RECURSIVE {RECORDS}, ranked AS (SELECT bout_id, a, b, CASE outcome WHEN 'win' THEN 1.0 WHEN 'draw' THEN 0.5 END::DOUBLE AS score, dense_rank() OVER (ORDER BY event_date) AS k FROM contests),
    who AS (SELECT DISTINCT fighter_id FROM records), last AS (SELECT max(k) AS k FROM ranked),
    r(k, fighter_id, rating) AS (SELECT 1::BIGINT, fighter_id, 1500.0::DOUBLE FROM who UNION ALL
        SELECT r.k + 1, r.fighter_id, r.rating + coalesce(c.change, 0) FROM r LEFT JOIN (SELECT fighter_id, sum(change) AS change FROM (SELECT unnest([g.a, g.b]) AS fighter_id, unnest([1, -1]) * 64.0 * (g.score - 1 / (1 + pow(10, (y.rating - x.rating) / 400))) AS change
            FROM ranked g JOIN r x ON x.k = g.k AND x.fighter_id = g.a JOIN r y ON y.k = g.k AND y.fighter_id = g.b WHERE g.score IS NOT NULL) GROUP BY fighter_id) c ON c.fighter_id = r.fighter_id WHERE r.k < (SELECT k FROM last))
    SELECT g.bout_id, round(x.rating, 6) AS rating_a, round(y.rating, 6) AS rating_b FROM ranked g JOIN r x ON x.k = g.k AND x.fighter_id = g.a JOIN r y ON y.k = g.k AND y.fighter_id = g.b"""


@query(ELO)
def elo_one_pool_by_date(spark, sf_dir):
    """ratings date by date in one pool; the SQL steps from date to date."""
    return folds.elo(scored(spark, sf_dir), None, 64.0, by_date=True).select("bout_id", F.round("rating_a", 6).alias("rating_a"), F.round("rating_b", 6).alias("rating_b"))


@query(f"""WITH {RECORDS} SELECT f.bout_id, f.fighter_id, CAST(f.day - f.event_id % 10 AS INTEGER) AS cutoff, count(p.points) AS scored, coalesce(sum(p.points), 0)::DOUBLE AS total, max(p.day) AS last_day
    FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day - f.event_id % 10 AND p.points IS NOT NULL GROUP BY ALL""")
def replay_as_of(spark, sf_dir):
    """what was known of each side at its event's own cutoff (up to nine days before). Running state after each date, found as of the cutoff by one
    sort, instead of a replay for each event."""
    rows = records(spark, sf_dir).select("bout_id", "fighter_id", "day", "event_id", "points")
    upto = asof.earlier(["fighter_id"], "day", 0)
    seen = rows.where("points is not null").groupBy("fighter_id", "day").agg(F.count("*").alias("n"), F.sum("points").alias("t")).select("fighter_id", F.col("day").alias("last_day"), F.sum("n").over(upto).alias("scored"), F.sum("t").over(upto).alias("total"))
    target = rows.withColumn("cutoff", (F.col("day") - F.col("event_id") % 10).cast("int"))
    out = asof.asof_join(target, seen.select("*", F.col("last_day").alias("at")), ["fighter_id"], "cutoff", "at", ["scored", "total", "last_day"], strict=True)
    return out.select("bout_id", "fighter_id", "cutoff", F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("total", F.lit(0.0)).alias("total"), "last_day")


@query(f"""WITH {RECORDS}, s AS (SELECT f.bout_id, f.fighter_id, f.opponent_id, f.event_date, f.points, (coalesce(sum(p.points), 0) + 1) / (count(p.points) + 2) AS w FROM records f LEFT JOIN records p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL),
    t AS (SELECT x.event_date, x.w / (x.w + y.w) AS p, x.points AS y FROM s x JOIN s y ON y.bout_id = x.bout_id AND x.fighter_id < y.fighter_id WHERE x.points IN (0, 1))
    SELECT event_date, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM t GROUP BY event_date""")
def walk_forward(spark, sf_dir):
    """every date is forecast from earlier dates alone and scored; the forecast weighs both sides' win rates so far."""
    known = features.state(records(spark, sf_dir))
    pairs = features.sides(known, ["points", "scored", "total", "event_date"])
    weight = lambda s: (F.col(f"{s}.total") + 1) / (F.col(f"{s}.scored") + 2)
    rows = pairs.where("a.points in (0, 1)").select("a.event_date", (weight("a") / (weight("a") + weight("b"))).alias("p"), F.col("a.points").alias("y"))
    n, _, brier, loss = evaluate.binary_metrics(F.col("p"), F.col("y"))
    return rows.groupBy("event_date").agg(n, F.round(brier, 6).alias("brier"), F.round(loss, 6).alias("log_loss"))
