"""Receipts of three files, capture manifests, payload places, overlays, identities, snapshots."""

import base64
import datetime as dt
import decimal
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import identity, receipts, snapshot

CUTOFF = "2024-02-01T00:00:00Z"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def capture(folder, name, change_receipt=None, change_source=None, after=None):
    """Three files on disk and the source that names them."""
    here = folder / "data" / "raw"
    here.mkdir(parents=True, exist_ok=True)
    body, headers = f"<html>{name}</html>".encode(), b"content-type: text/html"
    source = {
        "request_url": f"https://example.org/{name}", "response_url": f"https://example.org/{name}", "http_status": 200, "fetched_at_utc": "2024-01-31T23:59:59Z",
        "response_path": f"data/raw/{name}.html", "response_sha256": sha(body), "headers_path": f"data/raw/{name}.headers", "headers_sha256": sha(headers), "response_bytes": None,
    }
    said = {"schema_version": 1, **{k: v for k, v in source.items() if v is not None}, "response_bytes": len(body)} | (change_receipt or {})
    text = json.dumps({k: v for k, v in said.items() if v != "absent"}).encode()
    source |= {"receipt_path": f"data/raw/{name}.json", "receipt_sha256": sha(text)} | (change_source or {})
    for path, content in ((f"{name}.html", body), (f"{name}.headers", headers), (f"{name}.json", text)):
        (here / path).write_bytes(content)
    if after:
        after(here)
    return {"name": name, **source}


def test_receipts_of_three_files(spark, tmp_path):
    both = lambda **c: {"change_receipt": c, "change_source": c}
    cases = {
        "good": (None, {}),
        "sized": (None, {"change_source": {"response_bytes": 18}}),
        "unsized": (None, {"change_receipt": {"response_bytes": "absent"}}),
        "gone": ("missing_file", {"after": lambda d: (d / "gone.headers").unlink()}),
        "bent": ("changed_file", {"after": lambda d: (d / "bent.html").write_bytes(b"other")}),
        "outside": ("outside_storage", {"change_source": {"response_path": "data/raw/../outside.html"}}),
        "list": ("changed_file", {"after": lambda d: (d / "list.json").write_bytes(b"[1]")}),
        "version": ("not_a_receipt", {"change_receipt": {"schema_version": 2}}),
        "differs": ("metadata_differs", {"change_receipt": {"request_url": "https://example.org/x"}}),
        "lacks": ("metadata_differs", {"change_receipt": {"headers_path": "absent"}}),
        "status": ("not_successful", both(http_status=404)),
        "user": ("not_public", both(response_url="https://me:pw@example.org/")),
        "scheme": ("not_public", both(request_url="file:///etc/x")),
        "late": ("not_before_cutoff", both(fetched_at_utc="2024-02-01T00:00:00Z")),
        "zoneless": ("not_before_cutoff", both(fetched_at_utc="2024-01-01T00:00:00")),
        "bytes": ("byte_count_differs", {"change_receipt": {"response_bytes": 3}}),
        "bytes2": ("byte_count_differs", {"change_source": {"response_bytes": 3}}),
    }
    sources = [capture(tmp_path, name, **how) for name, (_, how) in cases.items()]
    text = capture(tmp_path, "plain")
    (tmp_path / "data/raw/plain.json").write_bytes(b"no json \xff")
    sources.append(text | {"receipt_sha256": sha(b"no json \xff")})
    schema = "name string, " + receipts.RECEIPT.replace("schema_version string, ", "") + ", receipt_path string, receipt_sha256 string"
    frame = spark.createDataFrame(sources, schema)
    files = receipts.described(receipts.contents(spark, f"file://{tmp_path}"))
    got = {r.name: r.problem for r in receipts.receipt_problems(frame, files, CUTOFF).collect()}
    assert got == {name: problem for name, (problem, _) in cases.items()} | {"plain": "not_a_receipt"}
    assert receipts.receipt_problems(frame.where("false"), files, CUTOFF).count() == 0


def test_capture_manifests(spark, tmp_path):
    page = {"title": "T", "id": 7, "latest": {"id": 70, "timestamp": "2024-01-01T00:00:00Z"}, "license": {"title": "L", "url": "https://creativecommons.org/licenses/by-sa/4.0/"}, "source": "text"}
    good = {"raw_path": "a.json", "page_id": 7, "page_title": "T", "revision_id": 70, "revised_at": "2024-01-01T00:00:00Z", "captured_at": "2024-01-02T00:00:00Z", "starts_at": "2024-01-03T00:00:00Z", "license_title": "L", "license_url": page["license"]["url"], "api_url": "https://wiki.example.org/w/rest.php/v1/page/T"}
    for name, content in {"a.json": page, "b.json": page | {"source": None}, "c.json": [1]}.items():
        (tmp_path / name).write_text(json.dumps(content))
    digest = lambda name: sha((tmp_path / name).read_bytes())
    cases = [
        (None, {}), ("missing_file", {"raw_path": "z.json"}), ("changed_file", {"raw_sha256": "0" * 64}), ("not_a_page", {"raw_path": "c.json"}), ("other_revision", {"revision_id": 71}), ("other_revision", {"page_title": "U"}),
        ("other_license", {"license_url": "https://example.org/"}), ("not_an_api_address", {"api_url": "http://wiki.example.org/T"}), ("no_text", {"raw_path": "b.json"}), ("not_before_start", {"starts_at": "2024-01-02T00:00:00Z"}), ("not_before_start", {"captured_at": None}),
    ]
    rows = []
    for k, (_, change) in enumerate(cases):
        row = good | change
        rows.append((k, row["raw_path"], change.get("raw_sha256") or (digest(row["raw_path"]) if row["raw_path"] != "z.json" else "x"), *[row[c] for c in ("page_id", "page_title", "revision_id", "revised_at", "captured_at", "starts_at", "license_title", "license_url", "api_url")]))
    frame = spark.createDataFrame(rows, "k int, raw_path string, raw_sha256 string, page_id long, page_title string, revision_id long, revised_at string, captured_at string, starts_at string, license_title string, license_url string, api_url string")
    pages = receipts.described(receipts.contents(spark, f"file://{tmp_path}"), receipts.PAGE)
    got = {r.k: r.problem for r in receipts.capture_problems(frame, pages).collect()}
    assert got == {k: p for k, (p, _) in enumerate(cases)}


def test_places_of_payloads(spark):
    a, b, m = "a" * 64, "b" * 64, "c" * 64
    rows = [(1, a, "data/x", None), (2, a, "old", None), (3, "zz", "data/x", None), (4, a, "y", m), (5, a, "y", "d" * 64), (6, a, "../y", m), (7, a, None, None), (8, a, "nowhere", None), (9, b, "data/x", None), (10, a, "data/x", None), (11, a, "data/x", None)]
    frame = spark.createDataFrame([(i, "s", s, p, x) for i, s, p, x in rows], "receipt_id long, source string, sha256 string, recorded_path string, manifest_sha256 string")
    index = spark.createDataFrame([(2, a, "archive/2"), (10, b, "data/x"), (11, a, "/data/x")], "receipt_id long, sha256 string, archive_path string")
    manifests = spark.createDataFrame([(m, "data/raw/m")], "sha256 string, folder string")
    files = spark.createDataFrame([("data/x", a), ("archive/2", a), ("data/raw/m/y", a)], "path string, sha256 string")
    got = {r.receipt_id: (r.tier, r.place, r.problem) for r in receipts.located(frame, index, manifests, files).collect()}
    assert got == {
        1: ("path", "data/x", None), 2: ("index", "archive/2", None), 3: ("path", None, "invalid_receipt_hash"), 4: ("manifest", "data/raw/m/y", None), 5: ("manifest", None, "missing_source_manifest"), 6: ("manifest", None, "invalid_payload_path"),
        7: ("path", None, "missing_payload_path"), 8: ("path", None, "unreadable_payload"), 9: ("path", None, "payload_hash_mismatch"), 10: ("index", None, "invalid_recovery_receipt"), 11: ("index", None, "invalid_recovery_receipt"),
    }


def test_an_overlay_touches_targets_alone(spark):
    t, late = "2024-01-05T00:00:00Z", "2024-03-01T00:00:00Z"
    facts = [(1, 177.8, 70.0, t, t, None), (2, 177.8, 70.0, t, late, None), (3, 177.0, 70.0, t, t, None), (4, 177.8, 70.0, t, t, "changed_file"), (5, 177.8, 70.0, t, t, None), (5, 180.34, 71.0, t, t, None), (6, 177.8, 70.0, "2024-01-06T00:00:00Z", t, None), (9, 177.8, 70.0, t, t, None), (8, 254.0, 100.0, t, t, None), (1, 177.8, 70.0, "2024-01-04T00:00:00Z", t, None)]
    targets = spark.createDataFrame([(k, f"n{k}") for k in (1, 2, 3, 4, 5, 6, 7, 8, 1)], "fighter_id long, name string")
    frame = spark.createDataFrame(facts, "fighter_id long, reach_cm double, reach_inches double, observed_at string, fetched_at string, problem string")
    got = [(r.fighter_id, r.reach_cm, r.reach_hold) for r in receipts.attached(targets, frame, CUTOFF).orderBy("fighter_id").collect()]
    assert got == [(1, 177.8, None), (1, 177.8, None), (2, None, "unverified"), (3, None, "unverified"), (4, None, "unverified"), (5, None, "disagreeing"), (6, None, "unverified"), (7, None, None), (8, None, "unverified")]
    assert targets.columns == ["fighter_id", "name"]


def test_identities_fail_closed(spark):
    sides = [
        ("e", 1, "a", "Ann", "Ann A"), ("e", 1, "b", "Bob", "Bobby"), ("e", 2, "a", "Cy", None), ("e", 2, "b", "Ann", "Ann A"), ("e", 3, "a", "Di", "Di (many)"), ("e", 3, "b", "Ann", "Ann A"), ("e", 4, "a", "Ann", "Ann A"), ("e", 4, "b", "Ann again", "Ann B"),
        ("e", 5, "a", "Cy", None), ("e", 5, "b", "Ann", "Ann A"), ("e", 6, "a", "Ed", "Round 1"), ("e", 6, "b", "Ann", "Ann A"), ("e", 7, "a", "Flo", None), ("e", 7, "b", "Guy", None), ("e", 8, "a", "Ann", "Ann A"), ("f", 1, "a", "Cy", None), ("f", 1, "b", "Bob", "Bob B"),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pages = frame([("Ann A", 1, False), ("Bob B", 2, None), ("Di (many)", 3, True), ("Cy C", 4, False), ("Twice", 5, False), ("Twice", 6, False)], "title string, page_id long, disambiguation boolean")
    redirects = frame([("Bobby", "Robert"), ("Robert", "Bob B"), ("Ann B", "Ann A"), ("Round 1", "Round 2"), ("Round 2", "Round 1")], "title string, target string")
    events = frame([("e", 10, "r1"), ("f", 11, "r2")], "event_id string, revision_id long, receipt_sha256 string")
    schema = "event_id string, position int, name string, fighter_id string, page_title string, revision_id long, receipt_sha256 string, reviewed_by string"
    decisions = [
        ("e", 2, "Cy", "page:4", "Cy C", 10, "r1", "me"), ("e", 5, "Cy", "own:9", None, 10, "other", "me"), ("e", 7, "Flo", "own:1", None, 10, "r1", "me"), ("e", 7, "Guy", "own:2", None, 10, "r1", "me"), ("e", 7, "Guy", "own:3", None, 10, "r1", "me"),
        ("f", 1, "Cy", "page:5", "Cy C", 11, "r2", "me"), ("f", 1, "Bob", "own:4", None, 11, "r2", "me"), ("f", 9, "No", "own:5", None, 11, "r2", ""), ("zz", 1, "No", "own:5", None, 11, "r2", "me"),
    ]
    sides, decisions = frame(sides, "event_id string, position int, side string, name string, title string"), frame(decisions, schema)
    told, contests = identity.resolve(sides, events, pages, redirects, decisions)
    got = {(r.event_id, r.position): (r.a_id, r.b_id, r.reason) for r in contests.collect()}
    none = lambda why: (None, None, why)
    assert got == {
        ("e", 1): ("page:1", "page:2", None), ("e", 2): ("page:4", "page:1", None), ("e", 3): none("unresolved_identity"), ("e", 4): none("one_id_twice"), ("e", 5): none("unresolved_identity"), ("e", 6): none("unresolved_identity"),
        ("e", 7): none("unresolved_identity"), ("e", 8): none("missing_side"), ("f", 1): none("unresolved_identity"),
    }
    reasons = {(r.event_id, r.position, r.side): (r.tier, r.reason) for r in told.collect()}
    assert reasons["e", 1, "b"] == ("linked", None) and reasons["e", 2, "a"] == ("reviewed", None) and reasons["e", 3, "a"] == (None, "missing_page") and reasons["e", 7, "b"] == (None, "unlinked_name") and reasons["e", 7, "a"] == ("reviewed", None)
    known = identity.pages_of(sides.select("title").unionByName(decisions.select(F.col("page_title").alias("title"))), pages, redirects)
    found = {(r.event_id, r.position, r.name): r.problem for r in identity.decision_problems(decisions, events, sides, known).collect()}
    assert found == {("e", 2, "Cy"): None, ("e", 5, "Cy"): "other_revision", ("e", 7, "Flo"): None, ("e", 7, "Guy"): "twice", ("f", 1, "Cy"): "other_page", ("f", 1, "Bob"): "no_such_side", ("f", 9, "No"): "unreviewed"}
    old = frame([("e", 1), ("e", 5), ("g", 1)], "event_id string, position int")
    assert {(r.event_id, r.position) for r in identity.absent(old, contests).collect()} == {("e", 5), ("g", 1)}


ROWS = [
    (k, f"naïve \"{k}\" \\ \n 🎉" if k % 3 else None, k / 7, float("inf") if k == 4 else -0.0 if k == 5 else None if k == 6 else 1e-300, decimal.Decimal(k) / 4, dt.date(1969, 12, 31) + dt.timedelta(days=k), dt.datetime(2024, 1, 1, 0, 0, 0, k), bytes([0, 255, k]), k % 2 == 0, k if k % 5 else None)
    for k in range(200)
]
SCHEMA = "k long, t string, d double, e double, m decimal(20,4), day date, at timestamp, b binary, f boolean, parent long"


def test_a_snapshot_reads_back_what_was_written(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    parents = df.select(F.col("k").alias("id"), "t")
    root = f"file://{tmp_path}/s1"
    links = [("rows", "parent", "parents", "id")]
    manifest = snapshot.export({"rows": (df, ["k"]), "parents": (parents, ["id"]), "none": (df.where("false"), ["k"])}, root, links=links)
    assert manifest["tables"]["rows"]["rows"] == 200 and manifest["tables"]["none"]["rows"] == 0
    assert snapshot.problems(spark, root) == []
    out = snapshot.restore(spark, root, f"file://{tmp_path}/restored")
    back = out["rows"]
    assert back.schema.simpleString() == df.schema.simpleString()
    assert [tuple(r) for r in back.orderBy("k").collect()] == [tuple(r) for r in df.orderBy("k").collect()]
    ordinals = spark.read.parquet(f"file://{tmp_path}/restored/rows").orderBy("_ordinal").select("_ordinal", "k").collect()
    assert [tuple(r) for r in ordinals] == [(k + 1, k) for k in range(200)]
    assert snapshot.clone(spark, root, f"file://{tmp_path}/s2") == manifest and snapshot.problems(spark, f"file://{tmp_path}/s2") == []
    with pytest.raises(ValueError, match="exists"):
        snapshot.restore(spark, root, f"file://{tmp_path}/restored")
    other = snapshot.export({"rows": (df.repartition(2), ["k"]), "parents": (parents, ["id"]), "none": (df.where("false"), ["k"])}, f"file://{tmp_path}/s3", links=links)
    assert other == manifest  # whatever the partitions


def rewritten(spark, root, name, change):
    """Replace a table of a snapshot."""
    rows = snapshot.read_lines(spark, f"{root}/{name}").toPandas()
    change(rows)
    spark.createDataFrame(rows).write.mode("overwrite").json(f"{root}/{name}_new")
    import shutil

    at = root.removeprefix("file://")
    shutil.rmtree(f"{at}/{name}")
    shutil.move(f"{at}/{name}_new", f"{at}/{name}")


def test_a_bent_snapshot_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "k long, t string")

    def bend(name, change):
        root = f"file://{tmp_path}/{name}"
        snapshot.export({"rows": (df, ["k"])}, root)
        rewritten(spark, root, "rows", change)
        return snapshot.problems(spark, root)

    def text(rows):
        rows.loc[3, "text"] = rows.loc[3, "text"].replace("t", "u")

    def swap(rows):
        rows.loc[[0, 1], "ordinal"] = rows.loc[[1, 0], "ordinal"].to_numpy()

    assert bend("a", text) == bend("b", swap) == ["rows: rows differ from the checksum"]
    assert bend("c", lambda rows: rows.drop(index=0, inplace=True)) == ["rows: rows differ from the checksum"]
    with pytest.raises(ValueError, match="differ from the checksum"):
        snapshot.restore(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/never")
    root = f"file://{tmp_path}/keys"
    twice = spark.createDataFrame([(1, 1, None), (1, 2, 5), (None, 3, 1)], "k long, o long, p long")
    snapshot.export({"rows": (twice, ["o"])}, root, keys={"rows": ["k"]}, links=[("rows", "p", "rows", "k")])
    assert snapshot.problems(spark, root) == ["rows: 1 null keys", "rows: repeated keys", "rows.p: no such rows"]
    with pytest.raises(ValueError, match="no array"):
        snapshot.export({"rows": (df.withColumn("a", F.array("k")), ["k"])}, f"file://{tmp_path}/array")


def test_old_databases(spark, tmp_path):
    path = tmp_path / "old.sqlite"
    base = sqlite3.connect(path)
    base.executescript('create table a (id integer primary key, t text, x real, b blob); create table "odd ""name" (v); insert into a values (5, \'é"\n\', 0.1, x\'00ff\'), (2, null, null, null);')
    base.executemany('insert into "odd ""name" values (?)', [(k,) for k in range(2500)])
    base.commit()
    base.close()
    rows = snapshot.old_rows(spark, f"file://{path}", sha(path.read_bytes()))
    got = rows.where("`table` = 'a'").orderBy("ordinal").collect()
    assert [(r.ordinal, json.loads(r.row)) for r in got] == [(2, {"id": 2, "t": None, "x": None, "b": None}), (5, {"id": 5, "t": 'é"\n', "x": 0.1, "b": {"$bytes": base64.b64encode(b"\0\xff").decode()}})]
    typed = snapshot.old_table(rows, "a", "id long, t string, x double, b struct<`$bytes`: string>").orderBy("id").collect()
    assert [(r._ordinal, r.id, r.x) for r in typed] == [(2, 2, None), (5, 5, 0.1)]
    assert rows.where("`table` = 'odd \"name'").agg(F.count("*"), F.sum("ordinal")).first()[:] == (2500, 2500 * 2501 // 2)
    with pytest.raises(Exception, match="another digest"):
        snapshot.old_rows(spark, f"file://{path}", "0" * 64).count()
