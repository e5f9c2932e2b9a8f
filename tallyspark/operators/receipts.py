"""Retained captures: receipts of three files, capture manifests, where a receipt's payload lies, and observations attached to a target set.

A file is read whole by one task, which gives its digest, its size and, where it is one, the JSON object that it holds. Contents stay where they are read: what is
joined are digests and the few fields of receipts and manifests. Everything comes back with the first `problem` that holds, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

#: What a receipt says, and what of it its source must say too.
RECEIPT = "schema_version string, request_url string, response_url string, http_status long, fetched_at_utc string, response_path string, response_sha256 string, headers_path string, headers_sha256 string, response_bytes long"
EQUAL = ("request_url", "response_url", "http_status", "fetched_at_utc", "response_path", "response_sha256", "headers_path", "headers_sha256")
#: What a page's payload says; a manifest has the event and the source that were made of it.
PAGE = "title string, id long, latest struct<id: long, timestamp: string>, license struct<title: string, url: string>, source string"


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and content of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    return files.select(F.substring_index(at, f"{base}/", -1).alias("path"), "content")


def described(files: DataFrame, schema: str = RECEIPT) -> DataFrame:
    """path, sha256, bytes and `said` (the JSON object, null where the file is none) of files (path, content)."""
    text = F.when(F.octet_length("content") <= 1 << 20, F.col("content").cast("string"))  # a receipt is small
    said = F.when(text.rlike(r"^\s*\{"), F.from_json(F.when(F.is_valid_utf8(text), text), schema))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), said.alias("said"))


def first(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; a rule that is null does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(True)), name).otherwise(out)
    return out


def by_path(files: DataFrame, prefix: str) -> DataFrame:
    """One row for each path, with columns under a prefix."""
    one = files.groupBy("path").agg(F.min(F.struct("sha256", "bytes", "said")).alias("f"))
    return one.select(F.col("path").alias(f"{prefix}_path"), *[F.col(f"f.{c}").alias(f"_{prefix}_{c}") for c in ("sha256", "bytes", "said")])


def public(url: Column) -> Column:
    return url.rlike(r"^https?://[^/?#@\s]+([/?#]|$)")


def inside(path: Column, storage: str) -> Column:
    return F.startswith(path, F.lit(storage)) & ~path.rlike(r"(^|/)\.\.?(/|$)")


def receipt_problems(sources: DataFrame, files: DataFrame, cutoff: str, storage: str = "data/raw/") -> DataFrame:
    """S24. sources (the columns of EQUAL, receipt_path, receipt_sha256, and response_bytes or null) with `problem`: outside_storage, missing_file, changed_file,
    not_a_receipt (no JSON object, or another schema than 1), metadata_differs, not_successful, not_public, not_before_cutoff, byte_count_differs.

    All three files must lie in the retained storage and have the stated digests; receipt and source must agree in every field; the capture must be strictly earlier
    than the cutoff. A repeated source is checked once for each row."""
    plain = files.select("path", "sha256", "bytes", "said")
    rows = sources
    for name in ("response", "headers", "receipt"):
        rows = rows.join(by_path(plain, name), f"{name}_path", "left")
    said = lambda c: F.col(f"_receipt_said.{c}")
    paths = ["response_path", "headers_path", "receipt_path"]
    every = lambda test: F.forall(F.array(*[test(n) for n in ("response", "headers", "receipt")]), lambda x: F.coalesce(x, F.lit(False)))
    size = said("response_bytes")
    rules = [
        ("outside_storage", ~F.forall(F.array(*[inside(F.col(p), storage) for p in paths]), lambda x: F.coalesce(x, F.lit(False)))),
        ("missing_file", ~every(lambda n: F.col(f"_{n}_sha256").isNotNull())),
        ("changed_file", ~every(lambda n: F.col(f"_{n}_sha256") == F.col(f"{n}_sha256"))),
        ("not_a_receipt", F.col("_receipt_said").isNull() | ~said("schema_version").eqNullSafe("1")),
        ("metadata_differs", ~F.forall(F.array(*[F.coalesce(F.col(c).cast("string") == said(c).cast("string"), F.lit(False)) for c in EQUAL]), lambda x: x)),
        ("not_successful", said("http_status") != 200),
        ("not_public", ~(public(said("request_url")) & public(said("response_url")))),
        ("not_before_cutoff", ~(scalar.utc(said("fetched_at_utc")) < F.lit(cutoff).cast("timestamp"))),
        ("byte_count_differs", size.isNotNull() & ~(size.eqNullSafe(F.col("_response_bytes")) & (F.col("response_bytes").isNull() | (F.col("response_bytes") == size)))),
    ]
    return rows.select(*sources.columns, first(rules).alias("problem"))


def capture_problems(manifests: DataFrame, pages: DataFrame) -> DataFrame:
    """S23. Capture manifests (raw_path, raw_sha256, page_id, page_title, revision_id, revised_at, captured_at, starts_at, license_title, license_url, api_url) against the retained page
    payloads (path, sha256, said as in PAGE): missing_file, changed_file, not_a_page, other_revision, other_license, not_an_api_address, no_text or not_before_start.

    The payload must be of the page and the revision that the manifest names, under the same free licence, and revision <= capture < start must hold."""
    rows = manifests.join(by_path(pages.withColumn("bytes", F.lit(0).cast("long")), "raw"), "raw_path", "left")
    said = lambda c: F.col(f"_raw_said.{c}")
    at = lambda c: scalar.utc(F.col(c))
    same = (said("title") == F.col("page_title")) & (said("id") == F.col("page_id")) & (said("latest.id") == F.col("revision_id")) & (said("latest.timestamp") == F.col("revised_at"))
    licence = (said("license.title") == F.col("license_title")) & (said("license.url") == F.col("license_url")) & F.startswith(F.col("license_url"), F.lit("https://creativecommons.org/licenses/by-sa/4.0/"))
    rules = [
        ("missing_file", F.col("_raw_sha256").isNull()), ("changed_file", F.col("_raw_sha256") != F.col("raw_sha256")), ("not_a_page", F.col("_raw_said").isNull()), ("other_revision", ~same), ("other_license", ~licence),
        ("not_an_api_address", ~F.col("api_url").rlike(r"^https://[^/]+/w/rest\.php/v1/page/")), ("no_text", said("source").isNull()), ("not_before_start", ~((at("revised_at") <= at("captured_at")) & (at("captured_at") < at("starts_at")))),
    ]
    return rows.select(*manifests.columns, first(rules).alias("problem"))


def located(receipts: DataFrame, index: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """J36. receipts (receipt_id, source, sha256, recorded_path, manifest_sha256) with `place`, `tier` and `problem`.

    A receipt in the recovery index (receipt_id, sha256, archive_path) lies where that says; else one with a manifest digest lies beside that manifest (manifests: sha256, folder);
    else at its recorded path. A tier that applies decides: it never falls through to the next. Problems: invalid_receipt_hash, invalid_recovery_receipt, missing_source_manifest,
    invalid_payload_path, missing_payload_path, unreadable_payload, payload_hash_mismatch."""
    saved = index.groupBy("receipt_id").agg(F.min(F.struct(F.col("sha256").alias("_index_sha"), F.col("archive_path").alias("_archive"))).alias("_i")).select("receipt_id", "_i.*", F.lit(True).alias("_indexed"))
    beside = manifests.groupBy(F.col("sha256").alias("manifest_sha256")).agg(F.min("folder").alias("_folder"))
    content = files.groupBy(F.col("path").alias("place")).agg(F.min("sha256").alias("_actual"))
    rows = receipts.join(saved, "receipt_id", "left").join(beside, "manifest_sha256", "left")
    safe = lambda c: F.coalesce((F.col(c) != "") & ~F.col(c).rlike(r"^/|(^|/)\.\.?(/|$)"), F.lit(False))
    indexed, listed = F.col("_indexed").isNotNull(), F.coalesce("manifest_sha256", F.lit("")) != ""
    tier = F.when(indexed, "index").when(listed, "manifest").otherwise("path")
    place = F.when(indexed, F.col("_archive")).when(listed, F.concat_ws("/", "_folder", "recorded_path")).otherwise(F.col("recorded_path"))
    rows = rows.withColumn("tier", tier).withColumn("place", place).join(content, "place", "left")
    rules = [
        ("invalid_receipt_hash", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("invalid_recovery_receipt", indexed & ~(F.coalesce(F.col("_index_sha") == F.col("sha256"), F.lit(False)) & safe("_archive"))),
        ("missing_source_manifest", (F.col("tier") == "manifest") & F.col("_folder").isNull()),
        ("invalid_payload_path", (F.col("tier") == "manifest") & ~safe("recorded_path")),
        ("missing_payload_path", (F.col("tier") == "path") & (F.coalesce("recorded_path", F.lit("")) == "")),
        ("unreadable_payload", F.col("_actual").isNull()),
        ("payload_hash_mismatch", F.col("_actual") != F.col("sha256")),
    ]
    problem = first(rules)
    return rows.select(*receipts.columns, "tier", F.when(problem.isNull(), F.col("place")).alias("place"), problem.alias("problem"))


def attached(targets: DataFrame, facts: DataFrame, cutoff: str) -> DataFrame:
    """K19. targets with `reach_cm` and `reach_observed_at` from facts (fighter_id, reach_cm, reach_inches, observed_at, fetched_at, problem): an overlay that lives in the
    result alone; neither stored rows nor participants beyond the targets get anything, and no target is added or lost.

    A fact counts if its receipt has no problem, it was observed by its capture and captured before the cutoff, the reach lies in 100..250 cm and is the stated inches times 2.54. Of a
    participant with several facts that count, none does if they disagree, else the earliest observation; `reach_hold` says disagreeing or unverified where there were facts."""
    at = lambda c: scalar.utc(F.col(c))
    good = F.coalesce(F.col("problem").isNull() & (at("observed_at") <= at("fetched_at")) & (at("fetched_at") < F.lit(cutoff).cast("timestamp")) & F.col("reach_cm").between(100, 250) & (F.abs(F.col("reach_cm") - F.col("reach_inches") * 2.54) <= 1e-7), F.lit(False))
    rows = facts.select("fighter_id", good.alias("_good"), "reach_cm", "observed_at")
    own = F.when(F.col("_good"), F.col("reach_cm"))
    found = rows.groupBy("fighter_id").agg(F.min(own).alias("_low"), F.max(own).alias("_high"), F.min(F.when(F.col("_good"), F.col("observed_at"))).alias("_at"))
    one = F.col("_low") == F.col("_high")
    out = targets.join(found.withColumn("_any", F.lit(True)), "fighter_id", "left")
    hold = F.when(F.col("_any").isNull(), None).when(F.col("_low").isNull(), "unverified").when(~one, "disagreeing")
    return out.select(*targets.columns, F.when(one, F.col("_low")).alias("reach_cm"), F.when(one, F.col("_at")).alias("reach_observed_at"), hold.alias("reach_hold"))
