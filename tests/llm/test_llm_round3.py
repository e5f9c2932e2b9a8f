"""Fill-in-middle, centroid clustering and quality: against brute force, exact round trips and held-out labels, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.llm import fill_in_middle as fim
from tallyspark.llm import quality, yinyang

TEXTS = [
    (1, "The quick brown fox, 12 hens & naïve café 🎉日本 end"),
    (2, None),
    (3, ""),
    (4, "<P> stands in it"),
    (5, "lorem ipsum dolor " * 20_000),
    (6, "a"),
    (7, " \n\t "),
    (8, "a<b<P" + "S>M>" + "é" * 50),
    (None, "no id here but words"),
    (9, "same row twice"),
    (9, "same row twice"),
    *((k, f"Word{k} and more; words follow <here> {'x' * k}") for k in range(100, 400)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1.0, "x", 5) for i, t in TEXTS], "doc_id long, text string, lang string, score double, output string, n int").repartition(3)


def by_regex(i, text):
    """The contract, with the pattern itself."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_the_pattern_and_is_undone(docs):
    got = fim.fill_in_middle(docs)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((by_regex(*r) for r in TEXTS), key=str)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in TEXTS), key=str)
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_token_starts_on_random_code_points():
    rnd = random.Random(5)
    letters = [*"azAZ@[`{mM  09", "é", "ſ", "K", "日", "\U0001f389", "\U00010041"]
    for _ in range(500):
        text = "".join(rnd.choices(letters, k=rnd.randrange(40)))
        starts = fim.token_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert [text[a:b] for a, b in zip(starts, starts[1:])] == re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)


def test_marks_that_overlap_are_refused():
    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>x", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P|", "|S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Rule(prefix=marks[0], suffix=marks[1], middle=marks[2])


def lloyd(x, start, rounds):
    """Plain rounds in Python integers."""
    c = [list(map(int, r)) for r in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, row)), k) for k, row in enumerate(c))

    vectors = [list(map(int, v)) for v in x]
    for _ in range(rounds):
        mine = [nearest(v)[1] for v in vectors]
        for k in range(len(c)):
            own = [v for v, m in zip(vectors, mine) if m == k]
            if own:
                c[k] = [sum(column) // len(own) for column in zip(*own)]
    out = [nearest(v) for v in vectors]
    return [k for _, k in out], [d for d, _ in out], c


@pytest.mark.parametrize("low,high,k,d", [(0, 3, 5, 2), (-2, 3, 9, 3), (-1000, 1000, 8, 6), (-(1 << 25), 1 << 25, 6, 4)])
def test_bounds_never_change_an_answer(low, high, k, d):
    """Small ranges make many ties and empty clusters, large ones leave floating point."""
    rng = np.random.default_rng(k)
    for _ in range(6):
        x = rng.integers(low, high, (80, d))
        c = x[:k].copy()
        step, total = yinyang.Step(c, yinyang.grouped(c), None), np.zeros((k, 1 + d), np.int64)
        cluster = upper = lower = None
        for r in range(8):
            new, upper, lower, _ = step.assign(x, cluster, upper, lower)
            far = yinyang.squares(x, c)
            assert new.tolist() == far.argmin(1).tolist()
            own = np.arange(80), new
            assert (upper >= np.sqrt(far[own])).all()
            for g, members in enumerate(step.members):
                others = np.where(members == new[:, None], np.inf, np.sqrt(far[:, members]))
                assert (lower[:, g] <= others.min(1)).all()
            if r:
                yinyang.added(total, cluster, x, -1)
            yinyang.added(total, new, x, 1)
            cluster = new
            moved = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), c)
            step = yinyang.Step(moved, step.group, np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-12))
            c = moved


def test_squares_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 20, yinyang.MOST - 1):
        x, c = rng.integers(-top, top + 1, (7, 64)), rng.integers(-top, top + 1, (5, 64))
        assert yinyang.squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]


def odd_vectors(rng, n):
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 4), 1, 4)]) for i in range(n)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5]), (n, None), (n + 1, []), (n + 2, [1.0, 2.0, 3.0]), (n + 3, [1.0, None, 2.0, 3.0])]
    return [*rows, (n + 4, [1.0, float("nan"), 0.0, 0.0]), (n + 5, [float("inf"), 0.0, 0.0, 0.0]), (n + 6, [0.0, 0.0, 0.0, -float("inf")]), (n + 7, [-0.0001, 0.0, 1e-9, 2.0])]


def test_clustering_equals_plain_rounds(spark):
    rows = odd_vectors(np.random.default_rng(2), 300)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(4)
    rule = yinyang.Rule(clusters=6, rounds=7, components=4)
    good = [(i, v) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x = np.floor(np.array([v for _, v in good]) * 1024).astype(np.int64)
    cluster, distance, centroids = lloyd(x, x[:6], 7)
    found = yinyang.cluster(frame, rule)
    assert found.centroids.tolist() == centroids
    got = sorted(map(tuple, found.rows.collect()), key=str)
    assert got == sorted(((i, c, d) for (i, _), c, d in zip(good, cluster, distance)), key=str)
    assert found.inertia == [sum(d for c, d in zip(cluster, distance) if c == k) for k in range(6)]
    assert found.scanned < 0.8 * 8 * 6 * len(good)


def test_clustering_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.25])], "vec_id long, embedding array<float>")
    found = yinyang.cluster(frame, yinyang.Rule(components=2))
    assert len(found.centroids) == 3
    assert {(r.vec_id, r.distance) for r in found.rows.collect()} == {(1, 0), (2, 0), (3, 0)}
    assert len({r.cluster for r in found.rows.where("vec_id < 3").collect()}) == 1  # the smaller of two equal centroids
    none = yinyang.cluster(frame.where("false"), yinyang.Rule(components=2))
    assert none.rows.count() == 0 and none.inertia == []
    assert yinyang.cluster(frame, yinyang.Rule(components=2, rounds=0)).rows.count() == 3
    with pytest.raises(Exception, match="exact distances"):
        yinyang.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), yinyang.Rule(components=1))


def plain_buckets(text):
    """Features of a text by loops; numpy only to wrap at 32 bits."""
    a, b, c = (int(x) for x in quality._MIX)
    cut, wrap = 32 - quality.BITS, 0xFFFFFFFF
    out, before = [], None
    for word in re.findall(r"[^\t-\r ]+", text):
        h, power = 0, 1
        for ch in word:
            power = power * b & wrap
            h = (h + (ord(ch) + 1) * power) & wrap
        h ^= len(word) * c & wrap
        h = (h ^ h >> 16) * a & wrap
        out += [h >> cut] + [0] * (h == before)
        before = h
        marked = f" {word} "
        for n in quality.LENGTHS:
            for i in range(len(marked) - n + 1):
                g = ord(marked[i]) * a & wrap
                for ch in marked[i + 1 : i + n]:
                    g = ((g ^ g >> 15) * b + ord(ch) * c) & wrap
                out.append(((g ^ g >> 13) * a & wrap) >> cut)
    return sorted(out)


def test_features_equal_loops():
    rnd = random.Random(6)
    block = ["", " ", "a", "ab ab ab", "word\n\tword  wörd 🎉", *("".join(rnd.choices("abc  \n.é日", k=rnd.randrange(60))) for _ in range(200))]
    bucket, text = quality.buckets(block)
    for k, x in enumerate(block):
        assert sorted(bucket[text == k].tolist()) == plain_buckets(x), repr(x)
    assert [len(b) for _, b in quality.blocks(["x" * (1 << 17)] * 5)] == [2, 2, 1]
    assert [b for _, b in quality.blocks([])] == []


def test_one_step_follows_the_gradient(monkeypatch):
    """A step lowers the loss of its text."""
    ids, share = np.array([3, 5, 9]), np.array([0.5, 0.25, 0.25], np.float32)
    other = np.array([11, 12]), np.array([0.5, 0.5], np.float32)
    few = quality.fit([(ids, share), other], np.array([1, 0]), passes=1)
    many = quality.fit([(ids, share), other], np.array([1, 0]), passes=30)

    def loss(m):
        z = [m.bias + float(share @ m.value[ids]), m.bias + float(other[1] @ m.value[other[0]])]
        return np.log1p(np.exp(-z[0])) + np.log1p(np.exp(z[1]))

    assert loss(many) < loss(few) < 2 * np.log(2) + 0.5 and loss(many) < 0.2
    assert not many.value[[1, 2, 4]].any()


def test_quality_on_held_out_rows(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    scores = quality.score(docs, quality.train(docs, labels))
    held = scores.join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out()).toPandas()
    right = (held.score >= 0.5) == (held.quality == 1)
    assert len(held) > 1000 and right.mean() > 0.98
    assert right[held.quality == 0].mean() > 0.95 and right[held.quality == 1].mean() > 0.99


def test_quality_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0, 0.5) for i in range(100, 400)] + [(None, 1, 1, 0.1), (1, None, 0, 0.1), (9, 0, 0, 0.0), (9, 1, 0, 0.0)], "doc_id long, quality int, toxic int, score double")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[2] == by[3] == by[7]
    assert quality.score(docs.where("false"), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}
    one = quality.train(docs, labels.where("quality = 1"))
    assert {round(r.score, 3) for r in quality.score(docs, one).collect()} == {0.999}
    held = docs.select("doc_id", quality.held_out().alias("h")).collect()
    import zlib

    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


def test_the_field_is_trained_on_all_sentences_at_once():
    from tallyspark.llm import pii

    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.3, (len(pii.TYPES), len(pii.FEATURES)))
    data = []
    for text, spans in pii.sentences(12, seed=9):
        rows = pii.lattice(text, 0, len(text))
        gold = set(spans) | {(a, b, 0) for *_, (_, a, b, _) in rows if not any(s < b and a < e for s, e, _ in spans)}
        data.append((rows, gold))
    want = sum(pii.gradient(rows, gold, weights) for rows, gold in data)
    assert np.abs(pii.Sample(data).gradient(weights) - want).max() < 1e-9


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("İ hello Mr. Smith Jones said", {"name": "Smith Jones"}),
        ("İİ the password: hunterhunterhunterhunter end", {"secret": "hunterhunterhunterhunter"}),
        ("yes Herr Müller-Lüdenscheidt kam", {"name": "Müller-Lüdenscheidt"}),
        ("Mrs. Anne-Marie Jones-Smith left", {"name": "Anne-Marie Jones-Smith"}),
        ('token = "' + "a1B2" * 1500 + '"', {"secret": "a1B2" * 1500}),
    ],
)
def test_no_length_and_no_letter_hides_an_entity(text, kinds):
    from tallyspark.llm import pii

    found = pii.find(text, np.array(pii.learned()))[1]
    assert {k: text[a:b] for a, b, k in found} == kinds


def test_precision_and_recall_of_added_spans_by_type():
    """Sentences of another seed than those that taught the field, by type."""
    from collections import Counter

    from tallyspark.llm import pii

    weights, right, said, there = np.array(pii.learned()), Counter(), Counter(), Counter()
    typed = pii.best_types(weights)
    for text, gold in pii.sentences(600, seed=77):
        own = {(a, b, pii.TYPES[y]) for a, b, y in gold}
        got = set(pii.find(text, weights, typed)[1])
        for part, counter in ((own & got, right), (got, said), (own, there)):
            counter.update(k for _, _, k in part)
    for kind in ("ssn", "iban", "secret", "passport", "street", "name"):
        print(kind, "precision", round(right[kind] / said[kind], 3), "recall", round(right[kind] / there[kind], 3), "of", there[kind])
        assert right[kind] / said[kind] > 0.8 and right[kind] / there[kind] > 0.8, kind
