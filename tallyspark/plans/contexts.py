"""Forward replay and matchup contexts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, replay
from ..operators.store import stored
from .domain import CONTESTS, RECORDS, contests, records, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def two_times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Targets, contests by side, revisions and quotes. A contest's lines are revisions of its result, captured up to two days after it and now and then
    a month later, or never; lines are quotes too, of two books, captured up to four days before, some updated after their capture."""
    c = contests(spark, sf_dir)
    key = F.col("bout_id")
    targets = c.select("bout_id", F.concat_ws(":", F.col("event_id").cast("string"), F.col("day").cast("string")).alias("card"), "a", "b", "day", (F.col("day") - 2).alias("cutoff"))
    sides = c.select("bout_id", "day", "outcome", F.explode(F.array("a", "b")).alias("fighter_id"), "a")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("who"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    late = F.when(F.col("part") % 97 == 0, 30).otherwise(F.col("part") % 3).cast("int")
    won = ((key % 2 == 0) == (F.col("fighter_id") == F.col("a"))).cast("double")
    points = F.when(F.col("flag") == "R", None).when(F.col("outcome") == "win", won).when(F.col("outcome") == "draw", 0.5)
    revisions = sides.join(line.where("part % 211 <> 0"), "bout_id").select("bout_id", "fighter_id", (F.col("day") + late).alias("captured"), "number", points.alias("points"))
    captured = F.col("day") - (key % 5).cast("int")
    one = F.struct(F.lit(0).alias("book"), captured.alias("captured"))
    two = F.struct(F.lit(1).alias("book"), (captured - F.when(F.col("number") % 2 == 1, 1).otherwise(0)).alias("captured"))
    quotes = c.select("bout_id", "day").join(line, "bout_id").select("bout_id", F.explode(F.array(one, two)).alias("q"), F.col("who").alias("side"), (1 + F.col("quantity") / 10).alias("price"), "part")
    quotes = quotes.select("bout_id", "q.book", "side", F.when(F.col("part") % 31 != 0, F.col("price")).alias("price"), (F.col("q.captured") + F.when(F.col("part") % 7 == 0, 1).otherwise(0)).alias("updated"), "q.captured")
    return targets, sides.select("bout_id", "fighter_id", "day"), revisions, quotes


REPLAY = f"""WITH {CONTESTS}, line AS (SELECT l_orderkey AS bout_id, l_linenumber AS number, l_partkey AS part, l_suppkey AS who, l_quantity AS quantity, l_returnflag AS flag FROM lineitem),
    both_sides AS (SELECT bout_id, day, outcome, a, unnest([a, b]) AS fighter_id FROM contests),
    rev AS (SELECT s.bout_id, s.fighter_id, s.day, s.day + CASE WHEN part % 97 = 0 THEN 30 ELSE part % 3 END AS captured, number,
        CASE WHEN flag = 'R' THEN NULL WHEN outcome = 'win' THEN ((s.bout_id % 2 = 0) = (fighter_id = a))::INT::DOUBLE WHEN outcome = 'draw' THEN 0.5 END AS points FROM both_sides s JOIN line USING (bout_id) WHERE part % 211 <> 0),
    aims AS (SELECT bout_id, event_id || ':' || day AS card, a, b, day, day - 2 AS cutoff FROM contests),
    aim AS (SELECT bout_id, card, cutoff, unnest([a, b]) AS fighter_id, unnest(['a', 'b']) AS side FROM aims),
    required AS (SELECT x.bout_id, x.side, count(s.bout_id) AS required FROM aim x LEFT JOIN both_sides s ON s.fighter_id = x.fighter_id AND s.day < x.cutoff GROUP BY ALL),
    newest AS (SELECT x.bout_id, x.side, r.bout_id AS old, arg_max(struct_pack(p := r.points), (r.captured, r.number, coalesce(r.points, -1))).p AS points FROM aim x JOIN rev r ON r.fighter_id = x.fighter_id AND r.day < x.cutoff AND r.captured <= x.cutoff GROUP BY ALL),
    proven AS (SELECT bout_id, side, count(*) AS proven, count(points) AS scored, coalesce(sum(points), 0) AS total FROM newest GROUP BY ALL),
    state AS (SELECT bout_id, card, side, required, coalesce(proven, 0) AS proven, coalesce(scored, 0) AS scored, coalesce(total, 0) AS total FROM aim JOIN required USING (bout_id, side) LEFT JOIN proven USING (bout_id, side)),
    cards AS (SELECT card, sum(required - proven)::BIGINT AS unproven FROM state GROUP BY card),
    quotes AS (SELECT bout_id, book, who AS side, CASE WHEN part % 31 <> 0 THEN 1 + quantity / 10 END AS price, day - bout_id % 5 - CASE WHEN book = 1 THEN number % 2 ELSE 0 END AS captured,
        day - bout_id % 5 - CASE WHEN book = 1 THEN number % 2 ELSE 0 END + CASE WHEN part % 7 = 0 THEN 1 ELSE 0 END AS updated FROM contests JOIN line USING (bout_id), (VALUES (0), (1)) t(book)),
    seen AS (SELECT q.*, a, b FROM quotes q JOIN aims USING (bout_id) WHERE captured <= cutoff),
    last AS (SELECT bout_id, book, max(captured) AS captured FROM seen GROUP BY ALL),
    market AS (SELECT bout_id, book, max(updated) AS updated, max(price) FILTER (WHERE side = a) AS pa, max(price) FILTER (WHERE side = b) AS pb FROM seen JOIN last USING (bout_id, book, captured) GROUP BY ALL
        HAVING count(*) = 2 AND bool_and(coalesce(price > 1 AND updated <= captured AND side IN (a, b), false)) AND min(updated) = max(updated) AND count(DISTINCT side) = 2),
    saved AS (SELECT bout_id, count(*) AS books, avg((1 / pa) / (1 / pa + 1 / pb)) AS market_p, max(updated) AS updated FROM market GROUP BY bout_id)"""


@query(f"""{REPLAY} SELECT m.bout_id, m.card, unproven, CASE WHEN unproven > 0 THEN 'held_incomplete_history' ELSE 'exploratory' END AS status,
    CASE WHEN unproven = 0 THEN round((x.total + 1) / (x.scored + 2) / ((x.total + 1) / (x.scored + 2) + (y.total + 1) / (y.scored + 2)), 6) END AS p, x.scored::BIGINT AS prior_a, y.scored::BIGINT AS prior_b,
    CASE WHEN books > 0 THEN 'two_sided' ELSE 'no_two_sided_book' END AS odds_status, coalesce(books, 0) AS books, round(market_p, 6) AS market_p, (m.cutoff - updated)::BIGINT AS age
    FROM aims m JOIN cards USING (card) JOIN state x ON x.bout_id = m.bout_id AND x.side = 'a' JOIN state y ON y.bout_id = m.bout_id AND y.side = 'b' LEFT JOIN saved ON saved.bout_id = m.bout_id""")
def forward_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contest as it looked at its capture, two days before: the newest results captured by then, held with its whole card where one is missing,
    and each book's two-sided market of its newest capture."""
    out = replay.replay(*two_times(spark, sf_dir))
    return out.select("bout_id", "card", F.col("unproven").cast("long").alias("unproven"), "status", F.round("p", 6).alias("p"), F.col("prior_a").cast("long").alias("prior_a"), F.col("prior_b").cast("long").alias("prior_b"), "odds_status", "books", F.round("market_p", 6).alias("market_p"), F.col("age").cast("long").alias("age"))


#: The seventeen style metrics as SQL: name, count, exposure, factor, whether 1 less, whether a count may not exceed its exposure.
STYLE = [
    ("distance_share", "distance_attempted", "sig_attempted", 1, False, True),
    ("clinch_share", "clinch_attempted", "sig_attempted", 1, False, True),
    ("ground_share", "ground_attempted", "sig_attempted", 1, False, True),
    ("head_share", "head_attempted", "sig_attempted", 1, False, True),
    ("body_share", "body_attempted", "sig_attempted", 1, False, True),
    ("leg_share", "leg_attempted", "sig_attempted", 1, False, True),
    ("striking_accuracy", "sig_landed", "sig_attempted", 1, False, True),
    ("takedown_accuracy", "td_landed", "td_attempted", 1, False, True),
    ("sig_landed_per_minute", "sig_landed", "elapsed", 60, False, False),
    ("sig_absorbed_per_minute", "o_sig_landed", "elapsed", 60, False, False),
    ("takedown_attempts_per_15", "td_attempted", "elapsed", 900, False, False),
    ("takedowns_per_15", "td_landed", "elapsed", 900, False, False),
    ("submission_attempts_per_15", "sub_attempts", "elapsed", 900, False, False),
    ("knockdowns_per_15", "kd", "elapsed", 900, False, False),
    ("striking_defence", "o_sig_landed", "o_sig_attempted", 1, True, True),
    ("takedown_defence", "o_td_landed", "o_td_attempted", 1, True, True),
    ("control_share", "control_seconds", "elapsed", 1, False, True),
]


def matchup_sql() -> str:
    def value(num, den, factor, complement, bounded):
        ok = f"eligible AND {num} IS NOT NULL AND {den} > 0" + (f" AND {num} <= {den}" if bounded else "")
        return ("1 - " if complement else "") + f"sum({num}) FILTER (WHERE {ok}) / sum({den}) FILTER (WHERE {ok}) * {factor}.0::DOUBLE"

    columns = ", ".join(f"{value(*rest)} AS {name}" for name, *rest in STYLE)
    result = "CASE outcome WHEN 'win' THEN CASE WHEN points = 1 THEN 'win' ELSE 'loss' END ELSE outcome END"
    differences = ", ".join(f"round(x.{name} - y.{name}, 9) + 0.0 AS d_{name}" for name, *_ in STYLE)
    sides = ", ".join(f"{s}.available AS available_{k}, {s}.left_out AS left_out_{k}, {s}.fights AS fights_{k}, {s}.results AS results_{k}, {s}.strengths AS strengths_{k}, {s}.eligible AS eligible_{k}, round({s}.rate, 6) AS opponents_{k}" for s, k in (("x", "a"), ("y", "b")))
    return f"""WITH {RECORDS}, e AS MATERIALIZED (SELECT *, bout_id % 11 <> 0 AS eligible FROM records),
    was AS (SELECT f.bout_id, f.fighter_id, count(*) FILTER (WHERE p.eligible AND p.points = 1) AS wins, count(*) FILTER (WHERE p.eligible AND p.points = 0) AS losses, count(*) FILTER (WHERE p.eligible AND p.points = 0.5) AS draws
        FROM e f LEFT JOIN e p ON p.fighter_id = f.fighter_id AND p.day < f.day GROUP BY ALL),
    told AS MATERIALIZED (SELECT e.*, {result} AS result, wins, losses, draws FROM e JOIN was ON was.bout_id = e.bout_id AND was.fighter_id = e.opponent_id),
    past AS (SELECT f.bout_id AS t_bout, f.fighter_id AS t_fighter, p.*, row_number() OVER (PARTITION BY f.bout_id, f.fighter_id ORDER BY p.day DESC, p.bout_id DESC) AS place, count(*) OVER (PARTITION BY f.bout_id, f.fighter_id) AS available
        FROM e f JOIN told p ON p.fighter_id = f.fighter_id AND p.day < f.day - 2),
    near AS (SELECT f.bout_id, f.fighter_id, count(*) - 1 AS left_out FROM e f JOIN e p ON p.fighter_id = f.fighter_id AND p.day BETWEEN f.day - 2 AND f.day GROUP BY ALL),
    five AS (SELECT t_bout AS bout_id, t_fighter AS fighter_id, any_value(available) AS available, list(bout_id ORDER BY day, bout_id) AS fights, list(result ORDER BY day, bout_id) AS results, list(wins || '-' || losses || '-' || draws ORDER BY day, bout_id) AS strengths,
        count(*) FILTER (WHERE eligible) AS eligible, avg((wins + 0.5 * draws) / (wins + losses + draws)) FILTER (WHERE eligible AND wins + losses + draws > 0) AS rate, {columns} FROM past WHERE place <= 5 GROUP BY ALL),
    s AS (SELECT f.bout_id, f.fighter_id, f.opponent_id, coalesce(available, 0) AS available, left_out, coalesce(fights, []) AS fights, coalesce(results, []) AS results, coalesce(strengths, []) AS strengths, coalesce(five.eligible, 0) AS eligible, rate, {", ".join(n for n, *_ in STYLE)}
        FROM e f JOIN near USING (bout_id, fighter_id) LEFT JOIN five USING (bout_id, fighter_id))
    SELECT x.bout_id, {sides}, {differences} FROM s x JOIN s y ON y.bout_id = x.bout_id AND x.fighter_id < y.fighter_id"""


RESULTS = ("win", "loss", "draw", "no_contest", "unknown")


def eligible_records(spark, sf_dir) -> DataFrame:
    """The records, made once and stored; some are held."""
    return stored(records(spark, sf_dir).withColumn("eligible", F.col("bout_id") % 11 != 0), "records")


@query(matchup_sql())
def matchup_context(spark, sf_dir):
    """Q15, M17 inputs: for every contest the last five earlier ones of both sides (nested), how many there were, how many were left out for the embargo, the
    opponents' records then, and the differences of the seventeen measured metrics. Held contests are shown and not measured."""
    side = context.contexts(eligible_records(spark, sf_dir), brief=True)
    fights, names = F.col("fights"), F.array(*map(F.lit, RESULTS))
    strength = F.transform(fights, lambda f: F.concat_ws("-", *[f["strength"][c].cast("string") for c in ("wins", "losses", "draws")]))
    code = F.transform(fights, lambda f: F.array_position(names, f["result"]).cast("tinyint"))
    # only what is shown goes to the contest, results as their places
    side = side.select("bout_id", "fighter_id", "opponent_id", "day", "available", "left_out", fights["bout_id"].alias("ids"), code.alias("results"), strength.alias("strengths"), "eligible", "opponent_win_rate", F.array(*[F.col("style")[i]["value"] for i in range(len(STYLE))]).alias("values"))
    columns = []
    for s in "ab":
        results = F.transform(F.col(f"{s}.results"), lambda c: F.element_at(names, c.cast("int")))
        columns += [F.col(f"{s}.{c}").alias(f"{n}_{s}") for c, n in (("available", "available"), ("left_out", "left_out"), ("ids", "fights"))]
        columns += [results.alias(f"results_{s}"), F.col(f"{s}.strengths").alias(f"strengths_{s}")]
        columns += [F.col(f"{s}.eligible").cast("long").alias(f"eligible_{s}"), F.round(f"{s}.opponent_win_rate", 6).alias(f"opponents_{s}")]
    columns += [(F.round(F.col("a.values")[i] - F.col("b.values")[i], 9) + 0.0).alias(f"d_{name}") for i, (name, *_) in enumerate(STYLE)]
    return context.paired(side).select("bout_id", *columns)
