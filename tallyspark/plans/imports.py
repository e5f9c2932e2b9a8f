"""Imports whose sources are made of the test tables, with faults at fixed places: receipts, payload places, identities, overlays, restored and recounted rows, wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scalar
from ..operators import evidence, identity, receipts
from ..sources import wikitext
from .domain import CONTESTS, contests, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT page_id, CASE page_id % 11 WHEN 1 THEN 'not_successful' WHEN 2 THEN 'changed_file' WHEN 3 THEN 'missing_file' WHEN 4 THEN 'metadata_differs' WHEN 5 THEN 'not_before_cutoff' WHEN 6 THEN 'outside_storage'
    WHEN 7 THEN 'byte_count_differs' WHEN 8 THEN 'not_public' WHEN 9 THEN 'not_a_receipt' END AS problem FROM pages""")
def retained_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a capture of three files (response, headers, receipt); nine of eleven kinds are spoiled in a way of their own."""
    k = F.col("page_id") % 11
    p = table(spark, sf_dir, "pages").select("page_id", k.alias("k"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    name = F.concat(F.lit("data/raw/"), F.col("page_id").cast("string"))
    url = F.concat(F.when(F.col("k") == 8, "https://me@example.org/").otherwise("https://example.org/"), F.col("page_id").cast("string"))
    fetched = F.when(F.col("k") == 5, "2024-02-01T00:00:00Z").otherwise("2024-01-31T00:00:00Z")
    headers = F.lit("content-type: text/html").cast("binary")
    at = F.concat(F.when(F.col("k") == 6, "data/raw/../").otherwise("data/raw/"), F.col("page_id").cast("string"), F.lit(".html"))
    said = {
        "request_url": url, "response_url": url, "http_status": F.when(F.col("k") == 1, 404).otherwise(200).cast("long"), "fetched_at_utc": fetched, "response_path": at,
        "response_sha256": F.sha2("body", 256), "headers_path": F.concat(name, F.lit(".headers")), "headers_sha256": F.sha2(headers, 256),
    }
    bent = {**said, "request_url": F.concat(url, F.when(F.col("k") == 4, "x").otherwise(""))}
    size = F.octet_length("body").cast("long") + F.when(F.col("k") == 7, 1).otherwise(0)
    text = F.to_json(F.struct(F.when(F.col("k") == 9, 2).otherwise(1).alias("schema_version"), *[v.alias(c) for c, v in bent.items()], size.alias("response_bytes")))
    p = p.withColumn("receipt", text.cast("binary"))
    sources = p.select("page_id", *[v.alias(c) for c, v in said.items()], F.concat(name, F.lit(".json")).alias("receipt_path"), F.sha2("receipt", 256).alias("receipt_sha256"), F.lit(None).cast("long").alias("response_bytes"))
    each = F.array(
        F.struct(F.concat(name, F.lit(".html")).alias("path"), F.concat("body", F.when(F.col("k") == 2, "x").otherwise("").cast("binary")).alias("content")),
        F.struct(F.when(F.col("k") != 3, F.concat(name, F.lit(".headers"))).alias("path"), headers.alias("content")), F.struct(F.concat(name, F.lit(".json")).alias("path"), F.col("receipt").alias("content")),
    )
    files = receipts.described(p.select(F.inline(each)).where("path is not null"))
    return receipts.receipt_problems(sources, files, "2024-02-01T00:00:00Z").select("page_id", "problem")


@query("""SELECT c_custkey AS receipt_id, CASE WHEN c_custkey % 4 = 0 THEN 'index' WHEN c_custkey % 4 = 1 THEN 'manifest' ELSE 'path' END AS tier,
    CASE WHEN c_custkey % 17 = 0 THEN 'invalid_receipt_hash' WHEN c_custkey % 4 = 0 AND c_custkey % 5 = 0 THEN 'invalid_recovery_receipt' WHEN c_custkey % 4 = 1 AND c_custkey % 7 = 0 THEN 'missing_source_manifest' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'invalid_payload_path'
    WHEN c_custkey % 4 > 1 AND c_custkey % 13 = 0 THEN 'missing_payload_path' WHEN c_custkey % 11 = 0 THEN 'unreadable_payload' WHEN c_custkey % 19 = 0 THEN 'payload_hash_mismatch' END AS problem FROM customer""")
def payload_places(spark, sf_dir):
    """Where each receipt's payload lies: by the recovery index, beside its manifest, or at its recorded path."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("receipt_id"))
    k, text = F.col("receipt_id"), F.col("receipt_id").cast("string")
    sha = F.sha2(text, 256)
    stated = F.when(k % 17 == 0, F.lit("?")).otherwise(sha)
    recorded = F.when((k % 4 == 1) & (k % 3 == 0), F.concat(F.lit("../"), text)).when((k % 4 > 1) & (k % 13 == 0), F.lit("")).otherwise(F.concat(F.when(k % 4 > 1, "data/").otherwise(""), text))
    manifest = F.when(k % 4 == 1, F.sha2(F.concat(F.lit("m"), (k % 7).cast("string")), 256))
    rows = c.select("receipt_id", F.lit("s").alias("source"), stated.alias("sha256"), recorded.alias("recorded_path"), manifest.alias("manifest_sha256"))
    index = c.where("receipt_id % 4 = 0").select("receipt_id", stated.alias("sha256"), F.concat(F.when(k % 5 == 0, "/").otherwise(""), F.lit("archive/"), text).alias("archive_path"))
    manifests = c.select((k % 7).alias("n")).distinct().where("n <> 0").select(F.sha2(F.concat(F.lit("m"), F.col("n").cast("string")), 256).alias("sha256"), F.concat(F.lit("raw/"), F.col("n").cast("string")).alias("folder"))
    place = F.when(k % 4 == 0, F.concat(F.lit("archive/"), text)).when(k % 4 == 1, F.concat(F.lit("raw/"), (k % 7).cast("string"), F.lit("/"), text)).otherwise(F.concat(F.lit("data/"), text))
    files = c.where("receipt_id % 11 <> 0").select(place.alias("path"), F.when(k % 19 == 0, F.lit("0" * 64)).otherwise(sha).alias("sha256"))
    return receipts.located(rows, index, manifests, files).select("receipt_id", "tier", "problem")


@query("""SELECT s_suppkey AS fighter_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 4 = 0 THEN NULL ELSE round((40 + s_suppkey % 50) * 2.54, 6) END::DOUBLE AS reach_cm,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'unverified' WHEN s_suppkey % 4 = 0 THEN 'disagreeing' END AS reach_hold FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 8 = 4""")
def attached_reach(spark, sf_dir):
    """Reach observations attached to a target set: some have none, some only unverified or late ones, some two that disagree."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fighter_id"))
    k = F.col("fighter_id")
    inches = (40 + k % 50).cast("double")
    one = F.struct(inches.alias("reach_inches"))
    two = F.struct((inches + 1).alias("reach_inches"))
    facts = s.where("fighter_id % 3 <> 0").select("fighter_id", F.explode(F.when(k % 4 == 0, F.array(one, two)).otherwise(F.array(one))).alias("r")).select(
        "fighter_id", (F.col("r.reach_inches") * 2.54).alias("reach_cm"), "r.reach_inches", F.lit("2024-01-01T00:00:00Z").alias("observed_at"),
        F.when(k % 7 == 0, "2024-02-01T00:00:00Z").otherwise("2024-01-02T00:00:00Z").alias("fetched_at"), F.when(k % 5 == 0, "changed_file").alias("problem"),
    )
    out = receipts.attached(s.where("fighter_id % 2 = 1 or fighter_id % 8 = 4"), facts, "2024-02-01T00:00:00Z")
    return out.select("fighter_id", F.round("reach_cm", 6).alias("reach_cm"), "reach_hold")


@query(f"""WITH {CONTESTS}, who AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'missing' ELSE 'linked' END AS kind FROM supplier),
    s AS (SELECT bout_id, side, id, CASE kind WHEN 'linked' THEN 'page:' || CASE WHEN id % 13 = 0 THEN id + 1000000 ELSE id END WHEN 'missing' THEN NULL ELSE CASE WHEN bout_id % 3 = 0 AND bout_id % 5 <> 0 THEN 'own:' || id END END AS fid
        FROM (SELECT bout_id, unnest(['a', 'b']) AS side, unnest([a, b]) AS id FROM contests) JOIN who USING (id))
    SELECT x.bout_id AS position, CASE WHEN x.fid IS NOT NULL AND y.fid IS NOT NULL THEN x.fid END AS a_id, CASE WHEN x.fid IS NOT NULL AND y.fid IS NOT NULL THEN y.fid END AS b_id, CASE WHEN x.fid IS NULL OR y.fid IS NULL THEN 'unresolved_identity' END AS reason
    FROM s x JOIN s y ON y.bout_id = x.bout_id AND x.side = 'a' AND y.side = 'b'""")
def resolved_contests(spark, sf_dir):
    """Both sides of every contest by link (some through redirects, some to no page) or, without a link, by a reviewed decision on exactly this contest and revision; one unresolved side leaves the contest out."""
    key = F.col("bout_id")
    c = contests(spark, sf_dir).select("bout_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("id")))).alias("s")).select("bout_id", "s.*")
    text = F.col("id").cast("string")
    title = F.when(F.col("id") % 7 != 0, F.concat(F.lit("Page "), text))
    sides = c.select(F.lit("all").alias("event_id"), key.cast("int").alias("position"), "side", F.concat(F.lit("Name "), text).alias("name"), title.alias("title"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).where("id % 7 <> 0")
    moved = F.col("id") % 13 == 0
    pages = s.where("id % 11 <> 0").select(F.concat(F.when(moved, "Moved ").otherwise("Page "), text).alias("title"), F.when(moved, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("page_id"), F.lit(False).alias("disambiguation"))
    redirects = s.where("id % 13 = 0").select(F.concat(F.lit("Page "), text).alias("title"), F.concat(F.lit("Moved "), text).alias("target"))
    decisions = c.where("id % 7 = 0 and bout_id % 3 = 0").select(F.lit("all").alias("event_id"), key.cast("int").alias("position"), F.concat(F.lit("Name "), text).alias("name"), F.concat(F.lit("own:"), text).alias("fighter_id"), F.lit(None).cast("string").alias("page_title"), F.when(key % 5 == 0, 2).otherwise(1).cast("long").alias("revision_id"), F.lit("r").alias("receipt_sha256"), F.lit("reviewer").alias("reviewed_by"))
    events = spark.createDataFrame([("all", 1, "r")], "event_id string, revision_id long, receipt_sha256 string")
    _, out = identity.resolve(sides, events, pages, redirects, decisions)
    return out.select(F.col("position").cast("long").alias("position"), "a_id", "b_id", "reason")


@query("""WITH h AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) SELECT k, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 IN (1, 2) THEN v WHEN k % 6 = 3 THEN v + 1 END AS v,
    CASE WHEN k % 6 = 0 THEN 'conflict' WHEN k % 6 IN (1, 2) THEN 'primary' WHEN k % 6 = 3 THEN 'fallback' ELSE 'held' END AS origin FROM h""")
def restored_rows(spark, sf_dir):
    """Held rows with the primary source's value, else the fallback's; where both have one and differ, neither counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    primary = o.where("k % 6 in (0, 1, 2)")
    fallback = o.where("k % 6 in (0, 2, 3)").select("k", F.when(F.col("k") % 6 == 2, F.col("v")).otherwise(F.col("v") + 1).alias("v"))
    return evidence.restored(o, primary, fallback, ["k"], ["v"])


@query("""WITH l AS (SELECT l_orderkey AS e, l_partkey % 40 AS s FROM lineitem), v AS (SELECT s, CASE WHEN s % 9 <> 0 THEN s % 4 END AS v FROM range(40) t(s)), g AS (SELECT e, min(v)::BIGINT AS low, max(v)::BIGINT AS high FROM l LEFT JOIN v USING (s) GROUP BY e)
    SELECT e, CASE WHEN low IS NULL OR low <> high OR (e % 5 = 0 AND low <> 1) THEN NULL ELSE low END AS v, CASE WHEN low IS NULL THEN 'missing' WHEN low <> high THEN 'subjects_disagree' WHEN e % 5 = 0 AND low <> 1 THEN 'differs_from_known' END AS hold FROM g""")
def fanned_out_values(spark, sf_dir):
    """A value of many linked subjects for each entity, where they agree and nothing else is known."""
    links = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("s"), F.col("l_orderkey").alias("e"))
    values = links.select("s").distinct().where("s % 9 <> 0").select("s", (F.col("s") % 4).alias("v"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("e"), F.lit(1).cast("long").alias("v"))
    return evidence.fanned_out(values, links, known, "s", "e", "v")


@query("""WITH n AS (SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS r FROM customer)
    SELECT k, CASE WHEN k % 5 = 0 THEN 'undecided' WHEN k % 5 = 1 THEN 'decided_twice' WHEN k % 5 = 2 THEN 'rejected' WHEN r = 0 THEN 'no_row' WHEN r > 1 THEN 'several_rows' END AS hold FROM n""")
def recounted_gaps(spark, sf_dir):
    """Which gaps a later import may fill: those with one accepted decision and one row."""
    gaps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    decisions = gaps.where("k % 5 <> 0").select("k", (F.col("k") % 5 != 2).alias("accepted"))
    decisions = decisions.unionByName(decisions.where("k % 5 = 1"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return evidence.recounted(gaps, decisions, rows, ["k"])


#: Wordings of a result's method, and the group of each.
METHODS = [
    ("Decision - Unanimous", "decision_unanimous"), ("decision  - SPLIT", "decision_split"), ("Decision - Majority", "decision_majority"), ("Decision", "decision"), ("KO/TKO", "ko_tko"), ("TKO (punches)", "ko_tko"), ("Submission (rear-naked choke)", "submission"),
    ("SUB", "submission"), ("TKO - Doctor's Stoppage", "doctor_stoppage"), ("DQ (knee)", "disqualification"), ("Could Not Continue", "could_not_continue"), ("Overturned", "overturned"), ("Knockout", "other"), ("  ", "unknown"), (None, "unknown"),
]


@query(f"""SELECT o_orderkey AS bout_id, CASE WHEN o_orderstatus = 'P' THEN 'no_contest' ELSE [{", ".join(f"'{g}'" for _, g in METHODS)}][o_orderkey % {len(METHODS)} + 1] END AS method_group FROM orders""")
def method_groups(spark, sf_dir):
    """The thirteen groups of a result's method."""
    said = F.element_at(F.array(*[F.lit(m).cast("string") for m, _ in METHODS]), (F.col("o_orderkey") % len(METHODS) + 1).cast("int"))
    outcome = F.when(F.col("o_orderstatus") == "P", "no_contest").otherwise("win")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"), scalar.method_group(said, outcome).alias("method_group"))


@query("""SELECT c_custkey AS page_id, unnest([1, 2, 3]) AS position, unnest([2, 3, 2]) AS level, unnest(['One ' || c_custkey, 'Sub', 'Two']) AS name, unnest([0, 19 + length(c_custkey::VARCHAR), 38 + length(c_custkey::VARCHAR)]) AS start,
    unnest([38 + length(c_custkey::VARCHAR), 38 + length(c_custkey::VARCHAR), 53 + length(c_custkey::VARCHAR)]) AS "end" FROM customer""")
def heading_spans(spark, sf_dir):
    """Headings of wiki text with their level, name, and where their section ends."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("== One "), k, F.lit(" ==\ntext...\n=== Sub ===\nmore..\n== Two ==\nend.\n"))
    return wikitext.headings(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), text.alias("source")))


@query("""SELECT p_partkey, 'round ' || p_partkey || ' & café' AS section, 'Café ' || p_partkey AS title FROM part""")
def source_keys(spark, sf_dir):
    """A section's name as it stands in an address, and a page's title with an accent that is written apart."""
    k = F.col("p_partkey").cast("string")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", names.section_key(F.concat(F.lit("ROUND_"), k, F.lit("%20&amp;%20Cafe%CC%81"))).alias("section"), names.title_key(F.concat(F.lit("Café_"), k)).alias("title"))


@query("""WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'Q' || (CASE WHEN s_suppkey % 10 = 1 THEN s_suppkey + 1 ELSE s_suppkey END + 1) END AS qid, CASE WHEN s_suppkey % 6 = 0 THEN 'shared' ELSE 'label ' || s_suppkey END AS label, s_suppkey % 8 = 0 AS lacks FROM supplier)
    SELECT k, qid, count(*) OVER (PARTITION BY qid) > 1 AS repeated_item, coalesce(min(qid) OVER (PARTITION BY label) <> max(qid) OVER (PARTITION BY label), false) AS shared_label, CASE WHEN lacks THEN 'missing_value' WHEN qid IS NULL THEN 'item_address' END AS problem FROM r""")
def query_bindings(spark, sf_dir):
    """Bindings of a query's result as JSON, one document for each supplier; some lack a value, name no entity, repeat an item or share a label."""
    from ..sources import bindings

    k = F.col("s_suppkey")
    entity = F.concat(F.when(k % 9 == 0, "http://example.org/Q").otherwise("http://www.wikidata.org/entity/Q"), (F.when(k % 10 == 1, k + 1).otherwise(k) + 1).cast("string"))
    label = F.when(k % 6 == 0, "  SHARED ").otherwise(F.concat(F.lit("Label "), k.cast("string")))
    value = lambda x: F.struct(x.alias("value"))
    one = F.struct(value(entity).alias("item"), value(label).alias("itemLabel"), value(F.when(k % 8 != 0, "x")).alias("externalId"), value(k.cast("string")).alias("row"))
    payload = F.to_json(F.struct(F.struct(F.array(one).alias("bindings")).alias("results")))
    rows = bindings.rows(table(spark, sf_dir, "supplier").select(payload.alias("payload")), ("item", "itemLabel", "externalId", "row"))
    return rows.select(F.col("row").cast("long").alias("k"), "qid", "repeated_item", "shared_label", "problem")


@query(f"""WITH {CONTESTS}, c AS (SELECT bout_id, outcome, a, b, bout_id % 7 AS kind FROM contests)
    SELECT bout_id AS page_id, 1 AS position, 'Name ' || a AS a, 'Page ' || a AS a_title, CASE kind WHEN 2 THEN 'Name ' || a ELSE 'Name ' || b END AS b,
    CASE WHEN kind = 3 OR (kind = 1 AND outcome <> 'win') THEN NULL WHEN outcome = 'win' THEN 'win' WHEN outcome = 'draw' THEN 'draw' ELSE 'no_contest' END AS outcome,
    CASE WHEN kind = 1 THEN 'shape' WHEN kind = 2 THEN 'identical_names' WHEN kind = 3 THEN 'ambiguous_result' END AS problem FROM c""")
def result_templates(spark, sf_dir):
    """A result template in wiki text for each contest, with links, a champion's mark and nested markup; some lack a method, name one side twice or contradict themselves."""
    kind = F.col("bout_id") % 7
    link = F.concat(F.lit("[[Page_"), F.col("a").cast("string"), F.lit("|Name "), F.col("a").cast("string"), F.lit("]]"))
    other = F.concat(F.lit("Name "), F.when(kind == 2, F.col("a")).otherwise(F.col("b")).cast("string"), F.when(kind == 4, " (c)").otherwise(""))
    marker = F.when(kind == 3, "beat").when(F.col("outcome") == "win", "def.").otherwise("vs.")
    method = F.when(kind == 1, "").when(F.col("outcome") == "win", "Decision {{small|(30–27)}}").when(F.col("outcome") == "draw", "Draw (majority)").otherwise("No contest")
    text = F.concat(F.lit("<!-- {{MMAevent bout|x}} -->\n{{MMAevent card}}\n{{ MMAevent bout\n|Lightweight|"), link, F.lit("|"), marker, F.lit("|"), other, F.lit("|"), method, F.lit("|3|5:00|}}\n{{end}}"))
    rows = wikitext.contests(contests(spark, sf_dir).select(F.col("bout_id").alias("page_id"), text.alias("source")))
    return rows.select("page_id", "position", "a", "a_title", "b", "outcome", "problem")


@query(f"""WITH {CONTESTS}, c AS (SELECT bout_id, outcome, a, b, bout_id % 6 AS kind FROM contests)
    SELECT bout_id, CASE kind WHEN 1 THEN NULL WHEN 5 THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN kind IN (1, 5) THEN NULL WHEN outcome = 'win' AND kind = 4 THEN 'win' ELSE outcome END AS outcome,
    CASE WHEN kind = 1 THEN 'unknown_status' WHEN kind = 2 AND outcome = 'win' THEN 'unresolved_winner' WHEN kind = 3 THEN 'no_date' WHEN kind = 4 THEN 'competitors' END AS problem FROM c""")
def daily_summaries(spark, sf_dir):
    """A feed's nested entry for each contest; some have an unknown state, contradict themselves about the winner, lack a date or a side, or are cancelled."""
    from ..sources import summaries

    kind, key = F.col("bout_id") % 6, F.col("bout_id").cast("string")
    side = lambda x, q: F.struct(x.cast("string").alias("id"), F.lit("n").alias("name"), F.lit(q).alias("qualifier"), F.lit(False).alias("virtual"))
    home, away = side(F.col("a"), "home"), side(F.col("b"), "away")
    day = F.when(kind != 3, F.date_format("event_date", "yyyy-MM-dd"))
    season = F.struct(key.alias("id"), F.lit("s").alias("name"), day.alias("start_date"))
    context = F.struct(F.struct(F.lit("wanted").alias("id")).alias("category"), season.alias("season"), F.struct(F.lit("c").alias("name")).alias("competition"))
    event = F.struct(key.alias("id"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("replaced_by"), context.alias("sport_event_context"), F.when(kind == 4, F.array(home)).otherwise(F.array(home, away)).alias("competitors"))
    won = F.col("outcome") == "win"
    state = F.when(kind == 1, "unheard_of").when(kind == 5, "cancelled").otherwise("closed")
    told = F.struct(state.alias("status"), F.when(won, "home_team").otherwise(F.col("outcome")).alias("winner"), F.when(won, F.when(kind == 2, F.col("b")).otherwise(F.col("a"))).cast("string").alias("winner_id"), F.lit("w").alias("weight_class"), F.lit(3).alias("scheduled_length"), F.lit("m").alias("method"))
    payload = F.to_json(F.struct(F.array(F.struct(event.alias("sport_event"), told.alias("sport_event_status"))).alias("summaries")))
    rows = summaries.contests(contests(spark, sf_dir).select(payload.alias("payload")), "wanted")
    return rows.select(F.col("bout_id").cast("long").alias("bout_id"), "status", "outcome", "problem")
