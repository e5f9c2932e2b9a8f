"""Sources with nested or marked-up input: summaries, rankings, wiki text, bindings."""

import hashlib
import json
import struct
import zlib

from pyspark.sql import functions as F
from tallyspark.functions import names, scalar
from tallyspark.sources import bindings, images, rankings, summaries, wikitext


def summary(i, status="closed", winner="home_team", season="s1", day="2024-01-02", sides=("a", "b"), **kw):
    event = {"id": f"e{i}", "start_time": "2024-01-02T20:00:00+00:00", "sport_event_context": {"category": {"id": "cat"}, "season": {"id": season, "name": "Card", "start_date": day}}, "competitors": [{"id": s, "name": s, "qualifier": q} for s, q in zip(sides, ("home", "away"), strict=False)]} | kw
    return {"sport_event": event, "sport_event_status": {"status": status, "winner": winner}}


def test_summaries(spark):
    entries = [summary(1), summary(2, winner="draw"), summary(3, winner=None), summary(4, status="not_started", winner=None), summary(5, status="odd"), summary(6, sides=("a",)), summary(7, season="s2", day="2024-01-05"), summary(8, season="s2", day="2024-01-06"), summary(9, status="not_started", winner=None, replaced_by="e1"), summary(10), summary(10), summary(11, winner="someone")]
    entries[0]["sport_event"]["sport_event_context"]["category"]["id"] = "cat"
    other = summary(99)
    other["sport_event"]["sport_event_context"]["category"]["id"] = "else"
    frame = spark.createDataFrame([(json.dumps({"summaries": [*entries, other]}),), ("{}",), (None,), ("bad",)], "payload string")
    rows = summaries.contests(frame, "cat")
    got = {r.bout_id: r for r in rows.collect()}
    assert "e99" not in got
    assert (got["e1"].status, got["e1"].outcome, got["e1"].winner_id, got["e1"].problem) == ("completed", "win", "a", None)
    assert got["e2"].outcome == "draw" and got["e3"].incomplete and got["e3"].status == "scheduled" and got["e4"].status == "scheduled"
    assert [got[k].problem for k in ("e5", "e6", "e7", "e8", "e10", "e11")] == ["unknown_status", "competitors", "inconsistent_date", "inconsistent_date", "duplicate_id", "unresolved_winner"]
    assert got["e9"].status == "cancelled"
    card = summaries.cards(rows).collect()
    assert [(c.event_id, c.bouts) for c in card] == [("s1", ["e1", "e2", "e3", "e4", "e9"])]


def test_rankings(spark):
    row = lambda label, name: f"<tr><td>{label}</td><td><a href='/x/{name}'>{name}</a></td></tr>"
    html = "<table><caption>Light</caption>" + row("1", "A") + row("T-2", "B") + row("T-2", "C") + row("4", "D") + "<tr><td>5</td><td>Vacant</td></tr>" + row("16", "E") + row("7", "A") + "</table>"
    found = rankings.rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    got = {(r.rank, r.name): (r.tied, r.tie_size, r.problem) for r in rankings.placed(found).collect()}
    assert got[2, "B"] == got[2, "C"] == (True, 2, None) and got[4, "D"] == (False, 1, None)
    assert got[16, "E"][2] == "outside" and got[7, "A"][2] == "repeated_athlete"
    gaps = {r.rank: r.reason for r in rankings.gaps(found).collect()}
    assert gaps[3] == "tie_skips_rank" and gaps[5] == "vacancy" and gaps[15] == "not_published" and 2 not in gaps
    bad = rankings.rows(spark.createDataFrame([(1, "<table><caption>L</caption>" + row("1", "A") + row("1", "B") + row("2", "C") + "</table>")], "page_id long, html string"))
    assert {r.name: r.problem for r in rankings.placed(bad).collect()} == {"A": None, "B": None, "C": "overlaps_a_tie"}


def test_wikitext(spark):
    text = """{{Infobox MMA event|name = Card 1 <!-- [[ -->|date={{start date|2021|3|5}}}} ==Results==
    {{MMAevent bout|Light|[[Ann_A (fighter)|Ann A]] |def.|Bob B (c)|KO|2|1:00}} {{MMAevent bout|Light|[[Cy C]]|vs.|Di D|Draw (majority)}}
    {{MMAevent bout|Light|E|vs.|F|Decision}} {{MMAevent bout|Light|G|def.|g|Decision}} {{MMAevent bout|Light}} {{wrap|{{MMAevent bout|Heavy|H|nc|I|NC (overturned)}}}} {{MMAevent bout|never closed"""
    frame = spark.createDataFrame([(1, text), (2, None)], "page_id long, source string")
    got = wikitext.contests(frame).orderBy("position").collect()
    assert (got[0].a, got[0].a_title, got[0].b, got[0].outcome, got[0].problem) == ("Ann A", "Ann A (fighter)", "Bob B", "win", None)
    assert (got[1].a, got[1].outcome) == ("Cy C", "draw")
    assert [g.problem for g in got[2:5]] == ["ambiguous_result", "identical_names", "shape"]
    assert got[5].outcome == "no_contest" and len(got) == 6
    box = wikitext.event_fields(frame).collect()
    assert [(b.page_id, b.name, str(b.event_date)) for b in box] == [(1, "Card 1", "2021-03-05")]


def test_bindings(spark):
    bind = lambda q, label, x="i": {"item": {"value": f"http://www.wikidata.org/entity/{q}"}, "itemLabel": {"value": label}, "externalId": {"value": x}}
    payload = {"results": {"bindings": [bind("Q1", "Ann"), bind("Q1", "Ann"), bind("Q2", "ann "), bind("Q3", "Bob"), bind("X", "Cy"), bind("Q4", "Di", "")]}}
    got = bindings.rows(spark.createDataFrame([(json.dumps(payload),), ("no json",)], "payload string")).collect()
    by = {(r.qid, r.itemLabel): r for r in got}
    assert len(got) == 6 and by["Q1", "Ann"].repeated_item and by["Q2", "ann"].shared_label and not by["Q3", "Bob"].shared_label
    assert by[None, "Cy"].problem == "item_address" and by["Q4", "Di"].problem == "missing_value"


def test_methods(spark):
    texts = ["KO/TKO", "TKO - Doctor's Stoppage", "DQ", "Decision - Unanimous", "Decision - Split", "Decision", "Submission", "sub", "Overturned", "Could Not Continue", " ", None, "Kotaro", "Odd"]
    frame = spark.createDataFrame([(i, t, "win") for i, t in enumerate(texts)] + [(99, "KO", "no_contest")], "i int, m string, o string")
    got = [r[0] for r in frame.orderBy("i").select(scalar.method_group(F.col("m"), F.col("o"))).collect()]
    assert got == ["ko_tko", "doctor_stoppage", "disqualification", "decision_unanimous", "decision_split", "decision", "submission", "submission", "overturned", "could_not_continue", "unknown", "unknown", "other", "other", "no_contest"]


def test_headings_and_revisions(spark):
    text = "intro\n== One ==\na\n=== Sub ===\nb\n==Two==\n== uneven ===\nc"
    frame = spark.createDataFrame([(1, text), (2, None)], "page_id long, source string")
    got = [(r.level, r.name, text[r.start : r.end].strip()) for r in wikitext.headings(frame).orderBy("position").collect()]
    assert [g[:2] for g in got] == [(2, "One"), (3, "Sub"), (2, "Two")]
    assert got[0][2].endswith("b") and got[1][2].endswith("b") and got[2][2].endswith("c")
    sha = hashlib.sha1(b"new").hexdigest()
    revisions = spark.createDataFrame([(1, 10, 5, "old", "x"), (1, 11, 7, "new", names.base36(sha)), (1, 12, 9, "later", "x"), (2, 20, 9, "late", "x")], "page_id long, revision_id int, stamped int, content string, sha1 string")
    cutoffs = spark.createDataFrame([(1, 8), (2, 8)], "page_id long, cutoff int")
    out = {r.page_id: (r.revision_id, r.verified) for r in wikitext.latest_revisions(revisions, cutoffs).collect()}
    assert out == {1: (11, True), 2: (None, False)}


def test_keys():
    assert names.section("Fight_Night%20%26amp;  1") == "fight night & 1" and names.title("A_B") == "A B"
    assert int(names.base36("ff" * 20), 36) == int("ff" * 20, 16) and len(names.base36("00")) == 31


def test_images(spark):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", 20, 30, 8, 0, 0, 0, 0)
    png = images.PNG + chunk(b"IHDR", head) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 40, 50) + b"\x01\x01\x11\x00\xff\xd9"
    small = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    rows = [("png", png), ("jpeg", jpeg), ("cut", png[:-1]), ("bent", png[:30] + bytes([png[30] ^ 1]) + png[31:]), ("end", png + b"x"), ("small", small), ("text", b"hello"), ("null", None), ("nodata", images.PNG + chunk(b"IHDR", head) + chunk(b"IEND", b""))]
    got = {r.name: (r.mime, r.width, r.height, r.problem) for r in images.inspected(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["png"] == ("image/png", 20, 30, None) and got["jpeg"] == ("image/jpeg", 50, 40, None)
    assert [got[k][3] for k in ("cut", "bent", "end", "small", "text", "null", "nodata")] == ["truncated", "checksum", "truncated", "dimensions", "not_an_image", "not_an_image", "incomplete"]


def test_plain_titles_equal_the_sql_on_odd_pages(spark, tmp_path):
    import duckdb
    from tallyspark.plans import text

    pages = ["<title>a&amp;&amp</title>", "<title>token = &quot;0b</title>", "<title>  x\x0b\t\r\n y &lt;b&gt; &amp;lt; 　</title>", "<TITLE>a</TITLE>", "<title lang='en'>a</title>", "<title>cut", "<title> </title>", "<title></title><title>b</title>", "", None, "no title", "<title>a<b>c</title>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(text.ORACLES["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, text.page_titles(spark, str(tmp_path)).collect())) == sorted(want)
