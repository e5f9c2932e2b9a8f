"""Each operator against brute force, exact round trips or held-out accuracy, and on odd rows."""

import base64
import hashlib
import json
import random
import re
import struct
import zlib

import public_tokenizers as P
import pytest
from tallyspark.llm import bpe, langid, lz_fingerprint, media, neardup, packing, pii, suffix_dedup, toxicity, url_filter
from tallyspark.llm.common import scratch, stored

LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (5, LONG),
    (6, "a"),
    (7, " \n\t "),
    (8, "naïve café — 日本語 🎉 \u0301x"),
    (None, "no id here but some words follow it"),
    (9, "same row twice"),
    (9, "same row twice"),
    (10, "x" * 5000),
    (11, "12345 !!! ???"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with other columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", "k", "p", 1.0) for i, t in ODD], "doc_id long, text string, lang string, source string, key string, part string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_bpe_equals_tiktoken(spark, odd, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.encode_documents(odd, path, P.PATTERN))
    want = []
    for i, t in ODD:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), bytearray(struct.pack(f"<{len(ids)}I", *ids)), bytearray((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0
    codec = bpe.codec(path, P.PATTERN)
    letters = [chr(c) for c in (*range(0x250), 0x2028, 0x3000, 0x4E2D, 0x1F389)] + list("   'sthe\n")
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choices(letters, k=rnd.randrange(30)))
        ids = own.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_packing_covers_every_token_once(spark, odd, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    pieces = [r.asDict() for r in packing.pack(odd, path).collect()]
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    texts = dict(ODD)
    for i in {r["doc_id"] for r in pieces if r["doc_id"] not in (None, 9)}:
        ids = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    assert len({r["doc_id"] for r in pieces}) == len({i for i, _ in ODD})
    assert packing.pack(none, path).count() == 0


def test_packing_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.words(path)
    plain.encode_special_tokens = True
    letters = [chr(c) for c in (*range(0x250), 0x301, 0x327, 0x2028, 0x4E2D)] + list("    aaZZ''..\n")
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choices(letters, k=rnd.randrange(30)))
        assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_best_cuts_are_the_cheapest():
    import numpy as np

    rnd = random.Random(4)
    for _ in range(200):
        places = np.cumsum([0] + [rnd.randint(1, 3) for _ in range(rnd.randint(2, 12))])
        cost = np.array([rnd.choice([0, 2, 5]) for _ in places])
        window = 6

        def brute(k):
            return 0 if k == 0 else min(brute(i) + window - (places[k] - places[i]) + cost[k] for i in range(k) if places[k] - places[i] <= window)

        cuts = packing.best_cuts(places, cost, window, False)
        k = int(np.searchsorted(places, cuts[-1])) if cuts else 0
        at, total = 0, 0
        for c in cuts:
            total += window - (c - at) + cost[np.searchsorted(places, c)]
            at = c
        assert total == brute(k)
        assert places[-1] - at <= window
        last = packing.best_cuts(places, cost, window, True)
        assert last[-1] == places[-1]


def test_media_round_trip(spark, odd, none):
    got = media.media_columns(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, t in ODD:
        body = (t or "").encode()
        payload = body.ljust(max(1, -(-len(body) // 192)) * 192, b" ")
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(body), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and (r.width, r.height, r.depth) == (192, len(payload) // 192, 8)
        assert json.loads(r.feature)["hist"]
    assert by[1].media_sha256 == by[4].media_sha256 and by[1].feature == by[4].feature and by[2].feature == by[3].feature
    assert media.media_columns(none).count() == 0
    refs = spark.range(1000).selectExpr("id doc_id", "concat('s', id % 3) shard", "id * 700 offset", "700L length")
    tasks = media.dealt(refs, 20 * media.READ_BYTES)
    assert tasks.rdd.getNumPartitions() == 20 and tasks.count() == 1000


def test_media_shards_are_tar_files(spark, odd):
    import tarfile

    folder = scratch(spark, "media-test")
    refs = stored(media.store(odd, folder), "refs").collect()
    root = folder.removeprefix("file://")
    for shard in {r.shard for r in refs}:
        with tarfile.open(f"{root}/{shard}") as tar:
            members = {m.name: m for m in tar.getmembers()}
        for r in refs:
            if r.shard == shard:
                m = members[f"{bytes(r.digest).hex()}.png"]
                assert (m.offset_data, m.size) == (r.offset, r.length)


def brute_links(texts, words, share):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(count=160, seed=5):
    """Chains of edits, so that links join what no common neighbour does."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=3))
    out = []
    for i in range(count):
        if i % 4 == 0 or not out:
            text = [word() for _ in range(rnd.randint(1, 120))]
        else:
            text = list(rnd.choice(out[-20:])[1])
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = word()
        out.append((i, text))
    return [(i, " ".join(t)) for i, t in out]


@pytest.mark.parametrize(("words", "share"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, share):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), neardup.Rule(words, share)).collect()}
    assert got == brute_links(texts, words, share)


@pytest.mark.parametrize("blocks", [(128, 512), (3, 5)])
def test_near_duplicates_in_a_dense_group(spark, blocks, monkeypatch):
    """One large group whose members lie just above and just below the threshold."""
    monkeypatch.setattr(neardup, "QUERIES", blocks[0])
    monkeypatch.setattr(neardup, "MEMBERS", blocks[1])
    rnd = random.Random(12)
    base = ["".join(rnd.choices("abcdefghij", k=4)) for _ in range(150)]
    texts = []
    for i in range(250):
        words = list(base)
        for _ in range(rnd.randint(1, 9)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", "z"]) + str(rnd.randrange(20))
        texts.append((i, " ".join(words)))
    want = brute_links(texts, 3, 85)
    assert 2 < len({c for _, c in want.values()}) < 200
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), neardup.Rule(3, 85)).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 1 and not by[4].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[7].n_shingles == 0 and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept
    assert by[9].component_id == 9
    assert neardup.near_duplicates(none).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(again).collect()} == {1}


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        body = t.encode()
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if body[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(body[k : k + length])
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdéfgh", k=rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rnd.randint(12, 60))) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        parts.insert(rnd.randrange(3), rnd.choice(shared)[rnd.randint(0, 20) :])
        texts.append((i, " ".join(parts)))
    texts += [(60, "z" * 3000), (61, "ab" * 700), (62, texts[3][1]), (63, ""), (64, "z" * 99), (65, "z" * 100), (66, "abc " * 300 + shared[0]), (67, "y" * 250)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("shard", [4096, 2])
def test_repeated_strings_equal_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", shard)
    texts = passages()
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.summary(suffix_dedup.deduplicated(frame)).collect()}
    assert got == brute_repeats(texts)


def test_repeated_strings_of_odd_rows(spark, odd, none):
    got = rows(suffix_dedup.summary(suffix_dedup.deduplicated(odd)))
    assert len(got) == len(ODD)
    by = {r[0]: r for r in got}
    assert by[10][2] == 4999 and by[2][1] == 0 and by[None][2] == 0
    assert suffix_dedup.summary(suffix_dedup.deduplicated(none)).count() == 0
    twice = spark.createDataFrame([(1, "q" * 150), (1, "r" * 150), (2, "q" * 150), (2, "q" * 150)], "doc_id long, text string")
    assert suffix_dedup.summary(suffix_dedup.deduplicated(twice)).count() == 4


def test_suffix_array_orders_every_suffix():
    import numpy as np

    rnd = random.Random(7)
    for _ in range(50):
        data = bytes(rnd.choices([0, 1, 97, 98, 255], k=rnd.randint(1, 200)))
        order, _ = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), len(data) + 1)
        assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))
        shared = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), order, np.array([0]), 2 * len(data))
        for k in range(1, len(data)):
            a, b = data[order[k] :], data[order[k - 1] :]
            n = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
            assert shared[k] == n


def test_common_prefixes_after_differing_bytes(spark):
    import numpy as np

    rnd = random.Random(9)
    body = bytes(rnd.choices(b"klmnop", k=40))
    cases = [b"axyzbxyzc", *(bytes([a]) + body + bytes([b]) + body + bytes([c]) for a, b, c in ((97, 98, 99), (51, 52, 0), (65, 66, 255)))]
    for _ in range(300):  # copies of one passage, each with one byte changed
        parts = []
        for _ in range(rnd.randint(2, 4)):
            part = bytearray(body)
            part[rnd.randrange(len(part))] = rnd.randrange(256)
            parts.append(bytes(part))
        cases.append(b"".join(parts))
    for case in cases:
        data = np.frombuffer(case, np.uint8)
        order, _ = suffix_dedup.suffix_array(data, len(case) + 1)
        shared = suffix_dedup.common_prefixes(data, order, np.array([0]), 2 * len(case))
        for k in range(1, len(case)):
            a, b = case[order[k] :], case[order[k - 1] :]
            assert shared[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
    passage = "".join(rnd.choices("klmnop", k=140))
    texts = [(1, f"3{passage}0"), (2, f"4{passage}1"), (3, f"A{passage}B"), (4, f"é{passage}ü")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.summary(suffix_dedup.deduplicated(frame)).collect()} == brute_repeats(texts)


def test_kept_text_gives_back_cut_characters():
    body = "aébc".encode()
    assert suffix_dedup.kept_text(body, [(2, 4)]) == "aéc"
    assert suffix_dedup.kept_text(body, [(0, 2)]) == "ébc"
    assert suffix_dedup.kept_text(body, [(0, 5)]) == ""


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.BASE.index(x[2])))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    for _ in range(20_000):
        text = "".join(rnd.choices("0123456789 0123 --..@@a+_()é+.Z4", k=rnd.randrange(60)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_finds_more(spark, odd, none):
    text = 'é mail jo.81@mail7.example.com or call +1 (325) 555-8094 190.1.2.3, ssn 219-09-9999, token = "f95017526fc608ad71587f8ea5418b66ff2e6d38" on 2024-01-02'
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    one, two = sorted(pii.spans(frame).collect())
    kinds = [x.split(":")[0] for x in one.spans.split(",")]
    assert one.n_email == 1 and {"email", "phone", "ssn", "secret"} <= set(kinds)
    assert one.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in brute_spans(text)).encode()).hexdigest()
    assert two.spans == "" and two.base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = [r[0] for r in frame.orderBy("doc_id").select(pii.masked(frame.text)).collect()]
    assert "example.com" not in masked[0] and "<EMAIL>" in masked[0] and "2024-01-02" in masked[0] and masked[1] is None
    assert pii.spans(odd).count() == len(ODD) and pii.spans(none).count() == 0


def test_field_reads_words_of_any_length():
    import time

    import numpy as np

    weights = np.array(pii.learned())
    secret, iban, ssn = "f95017526fc608ad71587f8ea5418b66ff2e6d38", "DE89370400440532013000", "219-09-9999"
    words = {
        f"{'这是一个很长的句子没有空格' * 12}身份证号是{ssn}请保密{'谢谢' * 40}": (ssn, "ssn"),
        f"{'これはとても長い文です。' * 12}口座は{iban}です{'はい' * 40}": (iban, "iban"),
        '{"rows":[' + "1," * 80 + f'],"token":"{secret}","more":[' + "2," * 80 + "3]}": (secret, "secret"),
        "a,b,c," * 30 + f"{ssn}," + "d,e,f," * 30 + "g": (ssn, "ssn"),
    }
    for text, (entity, kind) in words.items():
        assert len(text.split()) == 1 and len(text) > pii.MOST_CHARS
        at = text.index(entity)
        assert [x for x in pii.find(text, weights)[1] if x[2] == kind] == [(at, at + len(entity), kind)], text
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        pii.find("x1," * n, weights)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]  # 4 in linear time, 16 in quadratic
    assert pii.find("7" * 300_000, weights)[1] == []


def test_dynamic_programme_equals_all_divisions():
    import numpy as np

    rng = np.random.default_rng(2)
    tried = 0
    for text, _ in pii.sentences(60, seed=7):
        rows = pii.lattice(text, 0, len(text))
        if not 1 <= len(rows) <= 9:
            continue
        tried += 1
        weights = rng.normal(size=(len(pii.TYPES), len(pii.FEATURES)))

        def divisions(j, rows=rows):
            """Every division of the first j tokens into candidate segments."""
            if j == 0:
                yield ()
            else:
                for i, a, b, facts in rows[j - 1]:
                    for rest in divisions(i):
                        yield (*rest, (j - 1 - i, a, b, facts))

        typed = lambda d: [(a, b, y, weights[y, list(f)].sum()) for n, a, b, f in d for y in [max(range(n > 0, len(pii.TYPES)), key=lambda y: weights[y, list(f)].sum())]]
        scored = [(sum(x[3] for x in typed(d)), [(a, b, pii.TYPES[y]) for a, b, y, _ in typed(d) if y]) for d in divisions(len(rows))]
        got, most = pii.decode(rows, weights), max(v for v, _ in scored)
        assert any(abs(v - most) < 1e-9 and x == got for v, x in scored), text
    assert tried > 20


def test_gradient_has_finite_differences():
    import numpy as np

    text, gold = next(x for x in pii.sentences(50, seed=3) if x[1] and len(x[0]) < 40)
    rows = pii.lattice(text, 0, len(text))
    segments = set(gold) | {(e[-1][1], e[-1][2], 0) for e in rows if not any(s < e[-1][2] and e[-1][1] < t for s, t, _ in gold)}
    weights = np.random.default_rng(4).normal(size=(len(pii.TYPES), len(pii.FEATURES))) * 0.3

    def likelihood(w):
        def total(j):
            return 1.0 if j == 0 else sum(total(i) * sum(np.exp(w[y, list(f)].sum()) for y in range(i != j - 1, len(pii.TYPES))) for i, _, _, f in rows[j - 1])

        return sum(w[y, list(f)].sum() for ends in rows for _, a, b, f in ends for y in range(len(pii.TYPES)) if (a, b, y) in segments) - np.log(total(len(rows)))

    grad = pii.gradient(rows, segments, weights)
    for y, k in ((0, 0), (3, 1), (5, 6), (7, 9), (1, 2)):
        step = np.zeros_like(weights)
        step[y, k] = 1e-5
        assert abs((likelihood(weights + step) - likelihood(weights - step)) / 2e-5 - grad[y, k]) < 1e-5


@pytest.mark.parametrize(
    ("text", "span", "kind"),
    [
        ("token=" + "aB3" * 45 + "x", "aB3" * 45 + "x", "secret"),
        ("api_key=" + "f9" * 75, "f9" * 75, "secret"),
        ("password=correcthorsebatterystaple", "correcthorsebatterystaple", "secret"),
        ("his ssn 219 09 9999, he says", "219 09 9999", "ssn"),
        ("or 555-867-5309 by day", "555-867-5309", "phone"),
        ("passport X1234567 is lost", "X1234567", "passport"),
        ("lives at 221 Baker Street since", "221 Baker Street", "street"),
        ("we met Mr. John Smith there", "John Smith", "name"),
        ("iban DE89 3704 0044 0532 0130 00 please", "DE89 3704 0044 0532 0130 00", "iban"),
    ],
)
def test_field_finds_entities_that_no_base_pattern_fits(text, span, kind):
    import numpy as np

    at = text.index(span)
    assert pii.find(text, np.array(pii.learned()))[1] == [(at, at + len(span), kind)]


@pytest.mark.parametrize("text", ["on 2024-01-02 at 10:30", "isbn 978-3-1614-8410-0", "12 34 56 78 and 1,200.50", "a password is needed", "key = value", "The Bank of 2020 Great Hall", "x" * 5000, ""])
def test_field_leaves_other_numbers_and_words(text):
    import numpy as np

    assert pii.find(text, np.array(pii.learned()))[1] == []


def test_field_decodes_the_best_division():
    import numpy as np

    weights = np.array(pii.learned())
    wrong = 0
    for text, gold in pii.sentences(150, seed=99):
        got = pii.decode(pii.lattice(text, 0, len(text)), weights)
        wrong += sorted(got) != sorted((a, b, pii.TYPES[y]) for a, b, y in gold)
    assert wrong <= 20


def test_windows_end_inside_long_sentences_only():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(50):
        lengths = rng.integers(1, 60, 12).tolist()
        ends = np.flatnonzero(rng.random(sum(lengths)) < 0.1) + 1
        places, cost = packing.candidates(lengths, ends, 24, 5)
        allowed = {0, *np.cumsum(lengths).tolist(), *ends.tolist()}
        at = sorted(allowed)
        inside = {p for a, b in zip(at, at[1:], strict=False) if b - a > 24 for p in range(a + 5, b, 5)}
        assert set(places.tolist()) == allowed | inside
        assert all((c == 0) == (p == 0 or p in np.cumsum(lengths)) for p, c in zip(places.tolist(), cost.tolist(), strict=True))


def test_language_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    got = langid.predict(docs, model, ("lang",)).where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[7].lang_pred == by[11].lang_pred == "und" and by[2].score == 0
    assert by[1].lang_pred == by[4].lang_pred and by[1].score == by[4].score
    digits = spark.createDataFrame([(1, "½ ² ① Ⅷ 7", "x", 0.0), (2, "½ ª", "x", 0.0)], "doc_id long, text string, lang_pred string, score double")
    assert [r.lang_pred == "und" for r in langid.predict(digits, model).orderBy("doc_id").collect()] == [True, False]
    with pytest.raises(ValueError):
        langid.predict(digits, model, ("lang_pred",))
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    caught = [r.score >= 0.5 for r in got if r.toxic]
    false = [r.score >= 0.5 for r in got if not r.toxic]
    assert sum(caught) >= 0.8 * len(caught) and sum(false) <= 0.01 * len(false)
    mentions = [abs(model.score(f"those {a} people live here") - model.score(f"those {b} people live here")) for t in toxicity.IDENTITY.values() for a, b in zip(t, t[1:], strict=False)]
    assert max(mentions) < 0.02
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[4] and scores[2] == scores[3] and all(0 <= x <= 1 for x in scores.values())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.train(docs, labels.where("false"))).count() == len(ODD)


def test_counterfactual_penalty_lowers_the_change(monkeypatch):
    import numpy as np

    texts = [("muslim idiot", 1), ("muslim scum", 1), ("christian walk", 0), ("christian home", 0), ("idiot", 1), ("walk", 0)] * 20
    data = [np.array(sorted(set().union(*map(toxicity.slots, t.split())))) for t, _ in texts]
    labels = np.array([float(y) for _, y in texts])
    change = []
    for strength in (0.0, 50.0):
        monkeypatch.setattr(toxicity, "SWAP", strength)
        model = toxicity.fit(data, labels, [])
        change.append(abs(model.score("muslim home") - model.score("christian home")))
    assert change[1] < change[0] / 3


def test_penalty_has_the_gradient_of_finite_differences():
    import numpy as np

    rng = np.random.default_rng(5)
    x = (rng.random((12, 7)) < 0.4).astype(float)
    swapped = [(k, *rng.choice(7, 2, replace=False).tolist()) for k in range(12)]
    swapped = np.array([(k, a, b, 0 if x[k, a] else 1) for k, a, b in swapped if x[k, a] or not x[k, b]])
    w, b, h = rng.normal(size=7), 0.3, 1e-6
    value, by_w, by_b = toxicity.penalty(w, b, x, swapped)
    brute = []
    for k, one, two, added in swapped.tolist():
        before, after = x[k].copy(), x[k].copy()
        if added:
            before[one], after[two] = 1, 1
        else:
            after[one], after[two] = 0, 1
        brute.append((1 / (1 + np.exp(-(after @ w + b))) - 1 / (1 + np.exp(-(before @ w + b)))) ** 2)
    assert abs(value - np.mean(brute)) < 1e-12
    for i in range(7):
        step = np.eye(7)[i] * h
        assert abs((toxicity.penalty(w + step, b, x, swapped)[0] - toxicity.penalty(w - step, b, x, swapped)[0]) / (2 * h) - by_w[i]) < 1e-7
    assert abs((toxicity.penalty(w, b + h, x, swapped)[0] - toxicity.penalty(w, b - h, x, swapped)[0]) / (2 * h) - by_b) < 1e-7


def test_labelled_sentences_decide_the_penalty(monkeypatch):
    import numpy as np

    texts = [("muslim idiot", 1), ("muslim scum", 1), ("christian walk", 0), ("jewish home", 0), ("idiot", 1), ("walk", 0)] * 20
    data = [np.array(sorted(set().union(*map(toxicity.slots, t.split())))) for t, _ in texts]
    labels = np.array([float(y) for _, y in texts])
    found = toxicity.swaps(data)
    assert {(k, a) for k, a, _, added in found.tolist() if not added} == {(k, toxicity.slot(t.split()[0])) for k, (t, _) in enumerate(texts) if " " in t}
    assert {k for k, _, _, added in found.tolist() if added} == {k for k, (t, _) in enumerate(texts) if " " not in t}
    terms = ("muslim", "christian", "jewish")
    spread = lambda m: max(m.score(f"{t} home") for t in terms) - min(m.score(f"{t} home") for t in terms)
    whole = spread(toxicity.fit(data, labels))
    monkeypatch.setattr(toxicity, "swaps", lambda rows: np.zeros((0, 4), np.int64))
    assert whole < spread(toxicity.fit(data, labels)) / 3


def test_odd_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (5, 0), (6, 0), (9, 1), (9, 1), (10, 0)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 9}) == 1 and sum(r.doc_id is None for r in got) == 1


def test_fingerprints(spark, odd, none):
    for range_rows in (1000, 3):
        got = lz_fingerprint.fingerprints(odd, range_rows).collect()
        assert len(got) == len(ODD)
        order = sorted((t or "", i) for i, t in ODD if i is not None)
        order = sorted(order, key=lambda x: (x[1], x[0]), reverse=True)
        by = {r.doc_id: r for r in got}
        for k, (t, i) in enumerate(order):
            if i in (9, 1):  # 9 is repeated; 1 is followed by the row with a null id
                continue
            nxt = order[k + 1][0]
            edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            r = by[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            sign = [lz_fingerprint.signature(x) for x in (t, edited, nxt)]
            assert r.fingerprint == sign[0].tobytes().hex() and r.edited_fingerprint == sign[1].tobytes().hex()
            assert r.near_edited == lz_fingerprint.likeness(*sign[:2]) and r.near_next == lz_fingerprint.likeness(sign[0], sign[2])
        last, nameless = by[1], by[None]  # after the least id comes the greatest, and so it does after a row without an id
        for r, t in ((last, ODD[0][1]), (nameless, ODD[8][1])):
            edited = t[: len(t) - len(t) // 2] + order[0][0][: len(t) // 2]
            sign = [lz_fingerprint.signature(x) for x in (t, edited, order[0][0])]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.edited_fingerprint == sign[1].tobytes().hex()
            assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(*sign[:2]), lz_fingerprint.likeness(sign[0], sign[2]))
        nine = sorted((r for r in got if r.doc_id == 9), key=lambda r: r.near_next)
        assert [r.n_chars for r in nine] == [14, 14] and nine[1].near_next == 1.0
    assert lz_fingerprint.fingerprints(none).count() == 0
    assert [r.near_next for r in lz_fingerprint.fingerprints(odd.where("doc_id is null")).collect()] == [0.0]


def test_minimum_hashes_estimate_the_likeness_of_phrase_sets():
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(60)]
    for _ in range(20):
        one = " ".join(rnd.choices(words, k=200))
        two = one[: rnd.randrange(len(one))] + " ".join(rnd.choices(words, k=100))
        a, b = lz_fingerprint.phrases(one), lz_fingerprint.phrases(two)
        assert abs(lz_fingerprint.likeness(lz_fingerprint.signature(one), lz_fingerprint.signature(two)) - len(a & b) / len(a | b)) < 0.25


def test_phrases_are_a_parse():
    rnd = random.Random(9)
    for _ in range(200):
        text = "".join(rnd.choices("abé", k=rnd.randrange(80)))
        found = lz_fingerprint.phrases(text)
        assert text.startswith("".join(sorted(found, key=list(dict.fromkeys(parse(text))).index)))


def parse(text):
    seen, begin = set(), 0
    for end in range(1, len(text) + 1):
        if text[begin:end] not in seen:
            seen.add(text[begin:end])
            yield text[begin:end]
            begin = end


def test_kernel_scores_equal_brute_force():
    """Presence kernels from sets of hashed n-grams, and ridge regression in the landmarks' span by another route."""
    import numpy as np

    rnd = random.Random(3)
    texts = [("".join(rnd.choices("abcde ", k=40)), "x") for _ in range(30)] + [("".join(rnd.choices("cdefg ", k=40)), "y") for _ in range(30)]
    rows = np.zeros((len(texts), langid.DIM), np.uint8)
    for (t, _), row in zip(texts, rows, strict=True):
        langid.presence(t, row)
    model = langid.fit(rows, [y for _, y in texts])
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t, _ in texts]
    assert all(abs(int(r.sum()) - len(g)) <= 4 for r, g in zip(rows, grams, strict=True))  # few collisions
    sets = [set(np.flatnonzero(r).tolist()) for r in rows]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    # with as many landmarks as rows, the Nyström map spans the kernel: plain kernel ridge regression gives the same scores
    wanted = np.array([[1.0, -1.0] if y == "x" else [-1.0, 1.0] for _, y in texts])
    alpha = np.linalg.solve(kernel + langid.RIDGE * len(texts) * np.eye(len(texts)), wanted)
    assert np.abs(model.scores(rows) - kernel @ alpha).max() < 1e-3


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://EXAMPLE.com/en/1?x=/en/", "https://www.example.com/en/", "https://m.example.com/fr/#a", "http://a.net/es/x", "http://net/es/", "http://xnet/es/", "ftp://host", None, "", "no scheme", "://", "http://example.com?/en/", "http://com/", "http://example.com/en/1?x=/en/", "a://b://c.com/"]
    want = ["block", "allow", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "allow"]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string, host string")
    got = url_filter.judge(frame, rules).collect()
    assert len(got) == 2 * len(urls)
    by = {r.page_id: r for r in got}
    assert [by[i].verdict for i in range(len(urls))] == want
    assert (by[0].host, by[0].path, by[0].rule) == ("example.com", "/en/1", "example.com/en/") and by[7].host == "" and by[11].path == ""
    assert by[14].host == "b:" and by[5].rule is None
    assert url_filter.judge(frame.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(frame, rules.where("false")).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    import numpy as np

    rules = spark.range(5000).selectExpr("concat('host', id, '.com/') rule")
    words = url_filter.build(rules)
    keys = np.array([r[0] for r in rules.selectExpr("xxhash64(rule)").collect()], np.int64).view(np.uint64)
    block, bits = url_filter.block_bits(keys, len(words))
    assert ((words[block] & bits) == bits).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    block, bits = url_filter.block_bits(other, len(words))
    assert ((words[block] & bits) == bits).all(1).mean() < 0.02
