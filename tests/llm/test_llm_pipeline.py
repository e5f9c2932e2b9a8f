"""The pipeline's stages on their own inputs, and the contracts of the registered queries."""

import hashlib
import re
import zlib

import corpus_pipeline
import public_tokenizers as P
import pytest
from tallyspark.llm import pii, queries
from test_llm_operators import brute_links, brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    base = tmp_path_factory.mktemp("pipeline")
    words = "the quick brown fox jumps over a lazy dog and runs far away from here to there".split()
    passage = " ".join(words[i % 16] + str(i) for i in range(60))
    extra = [(10_001, "!!! 123 ???", None, "x", 11), (10_002, None, None, "x", 0), (10_003, passage + " mail me at jo.81@mail7.example.com please", "en", "x", 0), (10_004, "something else first " + " ".join(f"own{i} word" for i in range(80)) + " " + passage + " and an end", "en", "x", 0), (None, "no id but words", "en", "x", 15)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, "/root/testdata/sf0.001")
        result.write.parquet(f"{base}/{k}")
        result = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = result
    return {name: rest for name, *rest in out}


def test_columns(stages):
    assert [stages[n][2] == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1]] == [True] * 4


def test_language_stage_keeps_what_has_letters(stages):
    before, after, _ = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")} and 10_001 in gone
    assert all(r.lang for r in after)


def test_neardup_stage_keeps_one_of_each_group(stages):
    before, after, _ = stages["minhash_neardup"]
    links = brute_links([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
    assert {r.doc_id for r in after if r.doc_id is not None} == {i for i, (_, c) in links.items() if c == i}
    assert sum(r.doc_id is None for r in after) == 1


def test_suffix_stage_removes_later_passages(stages):
    before, after, _ = stages["suffix_array_dedup"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    seen, texts = set(), {r.doc_id: r.text for r in after}
    for r in sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id):
        body = r.text.encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 99):
            if body[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(body[k : k + 100])
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        assert len(texts[r.doc_id].encode()) >= len(kept)
        assert texts[r.doc_id] == r.text or len(texts[r.doc_id].encode()) - len(kept) <= 6 * len(re.findall(b"\1+", bytes(gone)))
    assert "there" not in texts[10_004] and texts[10_004].startswith("something else first")


def test_pii_stage_masks(stages):
    before, after, _ = stages["pii_masking"]
    assert len(before) == len(after)
    assert not any(brute_spans(r.text) for r in after if r.text)
    assert any("<EMAIL>" in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
    clean = {r.doc_id: r.text for r in before if not re.search(r"[0-9@]", r.text)}
    assert all(r.text == clean[r.doc_id] for r in after if r.doc_id in clean)


def test_packing_stage_packs_all(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["packing"]
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same row twice over and over again", "en", "s", 38), (3, "the same row twice over and over again", "en", "s", 38),
    (4, "one id with two texts of some length here", "en", "s", 1), (4, "another text under the very same id", "en", "s", 1), (None, "the row without an id speaks", "en", "s", 1), (None, None, None, None, None),
    (5, "long words " * 30_000, "en", "s", 330_000), (6, "passage " * 40, "en", "s", 1), (7, "passage " * 40 + "tail", "en", "s", 1), (8, "mail jo.81@mail7.example.com", None, "s", 1),
]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_columns(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, `key` int")
    assert stage(spark, docs.where("false"), "odd").collect() == []
    rows = stage(spark, docs, "odd").collect()
    ids = sorted(str(r.doc_id) for r in rows)
    given = sorted(str(r[0]) for r in ODD)
    if name == "language_id":
        assert ids == sorted(str(i) for i, t, *_ in ODD if t)
    elif name == "minhash_neardup":
        assert ids == sorted({str(r[0]) for r in ODD if r[0] is not None}) + ["None"] * 2
    elif name == "suffix_array_dedup":
        assert ids == [i for i in given if i != "6"] or ids == given
        assert all(r.n_chars == len(r.text) for r in rows)
    elif name == "pii_masking":
        assert ids == given and [r.text for r in rows if r.doc_id == 8] == ["mail <EMAIL>"]
        assert all((r.text is None) == (r.n_chars is None) for r in rows)
    else:
        assert {str(r.doc_id) for r in rows} == set(ids) and sum(r.start == 0 for r in rows) == len(ODD)


def test_pipelines_in_one_process_keep_their_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    one, two = (corpus_pipeline.STAGES[1][1](spark, docs, at) for at in ("here", "there"))
    corpus_pipeline.STAGES[3][1](spark, docs, "there")
    assert one.count() > 0


def test_run_is_registered(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


CONTRACTS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_pii_semi_crf": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_minhash_neardup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_lz_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, name):
    frame = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert CONTRACTS[name].items() <= dict(frame.dtypes).items()
    table = "pages" if name.startswith("op1_") else "documents"
    rows = frame.collect()
    key = "page_id" if table == "pages" else "doc_id"
    assert {r[key] for r in rows} == {r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(key).collect()}
    if name != "op7_packing":
        assert len(rows) == len({r[key] for r in rows})
    for r in rows:
        if "held_out" in frame.columns:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if "score" in frame.columns:
            assert 0 <= r.score <= 1


def test_base_digest_of_the_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op2_pii_semi_crf(spark, "/root/testdata/sf0.001").collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in spans) for x in pii.BASE]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
