"""Lookups over the archive: profiles and cards, derived keys, optional bounds, typed columns, audit codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from .domain import CONTESTS, FACTS, RECORDS, contests, facts, records, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bounded(column: str, low=None, high=None) -> Column:
    """Column between two optional bounds. A missing bound is left out of the plan, so that a given one reaches the scan."""
    parts = [F.col(column) >= F.lit(low)] if low is not None else []
    parts += [F.col(column) <= F.lit(high)] if high is not None else []
    return reduce(Column.__and__, parts, F.lit(True))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def optional_bounds(spark: SparkSession, sf_dir: str, low="1996-01-01", high=None) -> DataFrame:
    """Contests between two dates, each of which may be left out."""
    at = lambda x: None if x is None else F.lit(x).cast("timestamp")
    return table(spark, sf_dir, "orders").where(bounded("o_orderdate", at(low), at(high))).select("o_orderkey", F.to_date("o_orderdate").alias("d"))


@query(f"""WITH {RECORDS} SELECT bout_id, fighter_id, elapsed IS NOT NULL AND points IS NOT NULL AND sig_landed IS NOT NULL AND o_sig_landed IS NOT NULL AS eligible FROM records""")
def eligible_rows(spark, sf_dir):
    """Whether a side's record may be used: a result that counts, a duration and both sides' strikes."""
    given = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("elapsed", "points", "sig_landed", "o_sig_landed")])
    return records(spark, sf_dir).select("bout_id", "fighter_id", given.alias("eligible"))


@query("""SELECT o_orderkey, 'own' AS by_key, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'other', c_custkey FROM orders JOIN customer ON c_custkey = o_orderkey % 1000 AND c_custkey <> o_custkey""")
def either_key(spark, sf_dir):
    """Rows that match by one id or by another, as two equi-joins; a row that matches by both comes once."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey")
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.lit("own").alias("by_key"), "c_custkey")
    other = o.withColumn("k", F.col("o_orderkey") % 1000).join(c, F.col("k") == F.col("c_custkey")).where("c_custkey <> o_custkey")
    return own.unionByName(other.select("o_orderkey", F.lit("other").alias("by_key"), "c_custkey"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE (user_id::VARCHAR) END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ':' || event_type END AS ref FROM events)
    SELECT event_id, ref, c_custkey FROM r LEFT JOIN customer ON c_custkey = try_cast(split_part(ref, ':', 1) AS BIGINT)""")
def derived_keys(spark, sf_dir):
    """Joined by the number before a colon in a composed id; what is no number matches nothing."""
    head = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, head).otherwise(F.concat_ws(":", head, "event_type")).alias("ref"))
    e = e.withColumn("c_custkey", F.split_part("ref", F.lit(":"), F.lit(1)).try_cast("long"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("found"))
    return e.join(c, "c_custkey", "left").select("event_id", "ref", F.col("found").alias("c_custkey"))


@query("""WITH r AS (SELECT s_suppkey % 40 AS who, 'a' AS system, s_nationkey % 3 AS name FROM supplier UNION ALL SELECT s_suppkey % 60, 'b', s_nationkey % 3 FROM supplier WHERE s_acctbal > 0)
    SELECT who, list_sort(list(DISTINCT system)) AS systems, count(*) AS occurrences, CASE WHEN count(DISTINCT name) = 1 THEN min(name) END::BIGINT AS name, count(DISTINCT name) > 1 AS conflict FROM r GROUP BY who""")
def ranking_occurrences(spark, sf_dir):
    """One row for each ranked participant over all systems; names that disagree are a conflict. Systems are a small fixed set."""
    s = table(spark, sf_dir, "supplier")
    rows = [s.select((F.col("s_suppkey") % n).alias("who"), F.lit(system).alias("system"), (F.col("s_nationkey") % 3).cast("long").alias("name"), "s_acctbal") for n, system in ((40, "a"), (60, "b"))]
    both = rows[0].unionByName(rows[1].where("s_acctbal > 0"))
    one = F.min("name") == F.max("name")
    return both.groupBy("who").agg(F.sort_array(F.collect_set("system")).alias("systems"), F.count("*").alias("occurrences"), F.when(one, F.min("name")).alias("name"), (~one).alias("conflict"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '-3' WHEN 2 THEN NULL WHEN 3 THEN '12.5' WHEN 4 THEN 'nan' ELSE (event_id % 100)::VARCHAR END AS raw FROM events)
    SELECT event_id, CASE WHEN raw ~ '^[0-9]+$' THEN raw::BIGINT END AS count_value, CASE WHEN raw ~ '^-?[0-9]+(\\.[0-9]+)?$' THEN raw::DOUBLE END AS number_value, CASE WHEN raw IS NULL THEN 'missing' WHEN raw ~ '^[0-9]+$' THEN 'ok' WHEN raw ~ '^-[0-9]+$' THEN 'negative' ELSE 'not_a_count' END AS problem FROM t""")
def typed_columns(spark, sf_dir):
    """Text read as a count and as a number, with the reason where it is no count."""
    c = F.col("event_id")
    raw = F.when(c % 6 == 0, "abc").when(c % 6 == 1, "-3").when(c % 6 == 3, "12.5").when(c % 6 == 4, "nan").when(c % 6 == 5, (c % 100).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    count, number = F.col("raw").rlike("^[0-9]+$"), F.col("raw").rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    problem = F.when(F.col("raw").isNull(), "missing").when(count, "ok").when(F.col("raw").rlike("^-[0-9]+$"), "negative").otherwise("not_a_count")
    return rows.select("event_id", F.when(count, F.col("raw").try_cast("long")).alias("count_value"), F.when(number, F.col("raw").try_cast("double")).alias("number_value"), problem.alias("problem"))


@query(f"""WITH {FACTS} SELECT fighter_id, any_value(s_name) AS name, count(*) AS contests, count(landed) AS with_landed, count(seconds) AS with_seconds, min(event_date) AS first_date, max(event_date) AS last_date, count(DISTINCT opponent_id) AS opponents, count(DISTINCT event_id) AS events
    FROM facts JOIN supplier ON s_suppkey = fighter_id GROUP BY fighter_id""")
def profiles(spark, sf_dir):
    """Q12: what the archive knows of each participant, by one aggregate joined with the dimension afterwards."""
    f = facts(spark, sf_dir).groupBy("fighter_id").agg(F.count("*").alias("contests"), F.count("landed").alias("with_landed"), F.count("seconds").alias("with_seconds"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.countDistinct("opponent_id").alias("opponents"), F.countDistinct("event_id").alias("events"))
    return f.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fighter_id"), F.col("s_name").alias("name")), "fighter_id").select("fighter_id", "name", *[c for c in f.columns if c != "fighter_id"])


@query(f"""WITH {FACTS}, n AS (SELECT l_orderkey AS bout_id, count(*) AS lines, count(DISTINCT l_suppkey) AS sides FROM lineitem GROUP BY 1), x AS (SELECT bout_id, count(*) AS f, count(landed) AS usable FROM facts GROUP BY 1)
    SELECT event_id, count(*) AS contests, sum(lines)::BIGINT AS rounds, count(*) FILTER (WHERE usable = 2) AS complete, min(event_date) AS first_date FROM contests JOIN n USING (bout_id) JOIN x USING (bout_id) GROUP BY event_id""")
def event_cards(spark, sf_dir):
    """Q12: each event with its contests, rounds and complete contests."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bout_id")).agg(F.count("*").alias("lines"))
    x = facts(spark, sf_dir).groupBy("bout_id").agg(F.count("landed").alias("usable"), F.min("event_id").alias("event_id"), F.min("event_date").alias("event_date"))
    return x.join(n, "bout_id").groupBy("event_id").agg(F.count("*").alias("contests"), F.sum("lines").alias("rounds"), F.count_if(F.col("usable") == 2).alias("complete"), F.min("event_date").alias("first_date"))


@query("""SELECT l_orderkey AS bout_id, count(*) AS rounds, count(*) FILTER (WHERE len(json_extract_string(errors, '$[*]')) > 0) AS with_errors FROM (SELECT l_orderkey, CASE WHEN l_partkey % 9 = 0 THEN '["sig:unparsed"]' WHEN l_partkey % 9 = 1 THEN '["td:unparsed","kd:unparsed"]' ELSE '[]' END AS errors FROM lineitem) GROUP BY 1""")
def round_quality(spark, sf_dir):
    """Q8: contests with the number of rounds whose list of errors, kept as JSON, is not empty."""
    p = F.col("l_partkey") % 9
    errors = F.when(p == 0, '["sig:unparsed"]').when(p == 1, '["td:unparsed","kd:unparsed"]').otherwise("[]")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bout_id"), errors.alias("errors")).groupBy("bout_id").agg(F.count("*").alias("rounds"), F.count_if(F.json_array_length("errors") > 0).alias("with_errors"))


@query("""SELECT lang AS kind, source, count(*) AS rows, count(DISTINCT sha256(text)) AS payloads, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL""")
def source_provenance(spark, sf_dir):
    """Q9: what each source delivered: rows, distinct payloads by digest, first and last id."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "source", "doc_id", F.sha2("text", 256).alias("d")).groupBy("kind", "source").agg(F.count("*").alias("rows"), F.countDistinct("d").alias("payloads"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""WITH {CONTESTS}, x AS (SELECT event_id, event_date, count(*) AS contests, count(*) FILTER (WHERE outcome = 'no_contest') AS open_n, count(*) FILTER (WHERE outcome = 'win') AS won FROM contests GROUP BY ALL)
    SELECT event_id, event_date, contests, open_n = 0 AS settled, CASE WHEN open_n = 0 THEN won END AS won FROM x""")
def settled_cards(spark, sf_dir):
    """A card is settled as a whole or not at all: one contest without a result leaves all of them open."""
    x = contests(spark, sf_dir).groupBy("event_id", "event_date").agg(F.count("*").alias("contests"), F.count_if(F.col("outcome") == "no_contest").alias("open_n"), F.count_if(F.col("outcome") == "win").alias("won"))
    return x.select("event_id", "event_date", "contests", (F.col("open_n") == 0).alias("settled"), F.when(F.col("open_n") == 0, F.col("won")).alias("won"))


#: Rules of the archive's audit: table, code, what is wrong with a row.
RULES = (
    ("lineitem", "quantity_not_positive", "l_quantity <= 0"),
    ("lineitem", "discount_out_of_range", "l_discount < 0 OR l_discount > 0.09"),
    ("lineitem", "tax_out_of_range", "l_tax < 0 OR l_tax > 0.07"),
    ("lineitem", "round_above_six", "l_linenumber > 6"),
    ("lineitem", "returned_but_open", "l_returnflag = 'R' AND l_linestatus = 'O'"),
    ("lineitem", "price_not_positive", "l_extendedprice <= 0"),
    ("orders", "total_not_positive", "o_totalprice <= 0"),
    ("orders", "total_very_large", "o_totalprice > 450000"),
    ("orders", "status_unknown", "o_orderstatus NOT IN ('F', 'O')"),
    ("orders", "priority_missing", "o_orderpriority IS NULL"),
    ("orders", "date_before_archive", "o_orderdate < TIMESTAMP '1992-02-01'"),
    ("events", "value_missing", "value IS NULL"),
    ("events", "value_at_most_one", "value <= 1"),
    ("events", "value_very_large", "value > 100"),
    ("events", "type_unknown", "event_type NOT IN ('click', 'view', 'purchase')"),
    ("events", "props_missing", "props IS NULL"),
    ("supplier", "balance_negative", "s_acctbal < 0"),
    ("supplier", "name_missing", "s_name IS NULL"),
    ("customer", "balance_negative", "c_acctbal < 0"),
    ("part", "size_not_positive", "p_size <= 0"),
    ("part", "price_not_positive", "p_retailprice <= 0"),
    ("documents", "text_empty", "text IS NULL OR text = ''"),
    ("documents", "length_wrong", "n_chars <> length(text)"),
    ("documents", "language_missing", "lang IS NULL"),
    ("pages", "address_without_scheme", "url NOT LIKE '%://%'"),
    ("labels", "label_unknown", "toxic NOT IN (0, 1) OR quality NOT IN (0, 1)"),
)
#: Foreign keys: child table and column, parent table and column.
PARENTS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))
#: Keys that must not repeat.
KEYS = (("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id"), ("labels", "doc_id"))


def audit_sql() -> str:
    parts = [f"SELECT '{t}' AS source, '{code}' AS code, count(*) AS n FROM {t} WHERE {rule}" for t, code, rule in RULES]
    parts += [f"SELECT '{c}', 'orphan:{k}', count(*) FROM {c} x WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{q} = x.{k})" for c, k, p, q in PARENTS]
    parts += [f"SELECT '{t}', 'repeated:{k.replace(', ', '+')}', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})" for t, k in KEYS]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") ORDER BY n DESC, source, code"


@query(audit_sql())
def full_audit(spark, sf_dir):
    """Issues of all tables by code: row rules in one pass over each table, orphans by anti-joins, repeated keys by counts; codes without an issue
    are there with zero."""
    out = []
    for name in dict.fromkeys(t for t, _, _ in RULES):
        counts = [F.struct(F.lit(name).alias("source"), F.lit(code).alias("code"), F.count_if(F.expr(rule)).alias("n")) for t, code, rule in RULES if t == name]
        out.append(table(spark, sf_dir, name).agg(F.array(*counts).alias("a")).select(F.inline("a")))
    for child, key, parent, other in PARENTS:
        lone = joins.orphans(table(spark, sf_dir, child), table(spark, sf_dir, parent), [key], [other])
        out.append(lone.agg(F.lit(child).alias("source"), F.lit(f"orphan:{key}").alias("code"), F.count("*").alias("n")))
    for name, key in KEYS:
        columns = key.split(", ")
        seen = table(spark, sf_dir, name).groupBy(*columns).agg(F.count("*").alias("k"))
        out.append(seen.agg(F.lit(name).alias("source"), F.lit(f"repeated:{'+'.join(columns)}").alias("code"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("n"), "source", "code")
