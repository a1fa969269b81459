"""The training-data operators against brute force, and on nulls, empty and very long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import decontamination, embeddings, html, language, licenses, lm, mixing, quality, simhash, substrings
from shelfmark.llm.common import texts
from shelfmark.llm.components import components
from shelfmark.llm.queries import MIXED, QUERIES
from shelfmark.llm.suffixes import suffix_arrays

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, kept string"
LONG = "Alpha beta, gamma delta. " * 6000


def rows(texts_):
    return [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts_)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, no letters, one word, copies, a repeated and a null id, a very long text, clashing columns."""
    given = [None, "", "  \n", "12 34 !", "word", "the same text again and again", "the same text again and again", LONG, "Übergrößen ÄÖÜ und é", "cc by cc by"]
    listed = rows(given) + [(4, "word", "en", "s1", 4, "x", "y", "z"), (None, "the same text without an id", None, None, 10, "x", "y", "z")]
    return spark.createDataFrame(listed, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def test_suffix_arrays():
    random.seed(5)
    strings = [[random.randint(1, random.choice([1, 2, 9])) for _ in range(random.randint(0, 50))] + [0] for _ in range(200)]
    found = suffix_arrays(np.array([x for s in strings for x in s]), np.array([len(s) for s in strings]))
    at = 0
    for s in strings:
        assert (found[at : at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        at += len(s)


def removed(given, length):
    """By brute force: bytes left and number of runs, by row."""
    bodies = [(t or "").encode() for t in given]
    count = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


@pytest.mark.parametrize("group", [substrings.GROUP, 2])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    """With a small group the exact way for large groups runs too."""
    monkeypatch.setattr(substrings, "GROUP", group)
    random.seed(3)
    base = ["".join(random.choice("abc é\n") for _ in range(60)) for _ in range(12)]
    given = ["".join(random.sample(base, 3)) + "".join(random.choice("xyz") for _ in range(20)) for _ in range(30)] + [None, "", "aaaa" * 40]
    frame = spark.createDataFrame(rows(given), SCHEMA)
    got = {r.doc_id: r for r in substrings.without_repeats(frame, length=25).collect()}
    for i, (left, spans) in enumerate(removed(given, 25)):
        r = got[i]
        size = len((given[i] or "").encode())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(left), spans, hashlib.sha256(left).hexdigest())


def test_fingerprints_and_components(spark, docs):
    some = docs.limit(200)
    got = {r.doc_id: r for r in simhash.near_duplicates(some).collect()}
    marks = {}
    for r in some.collect():
        w = split(r.text)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        marks[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in marks}
    for _ in marks:
        root = {i: min(root[j] for j in marks if (marks[i] ^ marks[j]).bit_count() <= 2) for i in marks}
    assert {i: (f"{marks[i]:016x}", root[i]) for i in marks} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}


def test_long_posting_lists_link_alike(spark, monkeypatch):
    random.seed(1)
    values = {0}
    while len(values) < 400:
        values.add(random.choice(sorted(values)) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)))
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")

    def roots():
        return {(r.node, r.root) for r in components(simhash.links(frame)).collect()}

    usual = roots()
    monkeypatch.setattr(simhash, "LIST_LENGTH", 1)
    assert roots() == usual
    assert usual == {(v, min(values)) for v in values}


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((8, 12))
    vectors = [(base[i % 8] + 0.13 * rng.standard_normal(12)).tolist() for i in range(90)]
    listed = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(90, vectors[0], 0), (91, vectors[0], None), (92, [0.0] * 12, 0), (93, None, 0), (94, [float("nan")] * 12, 1), (95, [None] + [1.0] * 11, 1), (96, [1.0], 0), (97, [1e-200] * 12, 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(listed, "vec_id bigint, embedding array<double>, label int")).collect()}
    usable = {i: (np.array(v), label) for i, v, label in listed if label is not None and i < 92}
    near = {i: {j for j, (y, b) in usable.items() if i != j and a == b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93} for i, (x, a) in usable.items()}
    root = {i: i for i in usable}
    for _ in usable:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in usable}
    for i, _, _ in listed:
        expected = (len(near[i]), root[i]) if i in near else (0, i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (*expected, expected[1] == i)


def test_language_on_held_out_rows(spark):
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").filter("held_out")
    joined = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, rejected = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.95 and rejected < 0.01


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op2_quality"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_trees_walk_like_their_nodes():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4))
    trees = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)
    margin = np.full(len(x), trees.bias)
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        for i, row in enumerate(x):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin[i] += v[node - len(f)]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-margin)))


@pytest.mark.parametrize("block_bytes", [lm.BLOCK_BYTES, 100_000])
def test_language_model_against_brute_force(spark, docs, block_bytes):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {r.doc_id: r for r in lm.score(docs, learn, block_bytes=block_bytes).collect()}
    tokens = {r.doc_id: [*split(r.text), None] for r in docs.collect()}
    one, two, three = (collections.Counter() for _ in range(3))
    for w in (w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2):
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    total, vocabulary = sum(one.values()), len(one)

    def p1(a):
        return (one[a] + 1) / (total + vocabulary + 1)

    def p2(a, b):
        return (two[a, b] + lm.PRIOR * p1(b)) / (one[a] + lm.PRIOR)

    def p3(a, b, c):
        return (three[a, b, c] + lm.PRIOR * p2(b, c)) / (two[a, b] + lm.PRIOR)

    assert got.keys() == tokens.keys()
    for i, w in tokens.items():
        score = math.log10(p1(w[0])) + sum(math.log10(p2(*k)) for k in zip(w[:2], w[1:2]))
        score += sum(math.log10(p3(*k)) for k in zip(w, w[1:], w[2:]))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[a] > 0 for a in w), total)
        assert math.isclose(r.base_score, sum(math.log10(p1(a)) for a in w), rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-9)


def test_language_model_of_held_out_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b b", "a", "a b", "b a b"])], "doc_id int, text string")
    asked = docs.unionByName(spark.createDataFrame([(100 + i, f"a b {t}") for i, t in enumerate("abx")], "doc_id int, text string"))
    found = {r.doc_id: r for r in lm.score(asked, F.col("doc_id") < 100).collect()}
    first = {r.doc_id: r for r in lm.score(asked, F.col("doc_id") < 100, order=1).collect()}
    assert found[102].n_known == 3 and found[102].n_tokens == 4 and found[102].score < found[100].score
    assert all(math.isclose(first[i].score, first[i].base_score) for i in first)


def test_license_places_against_brute_force(spark, docs, odd):
    extra = spark.createDataFrame(rows(["CC BY CC-by 4.0", "All rights reserved. all\nRIGHTS reserved", "xcc by", "GNU General Public License, version 3", "ccİ by"]), SCHEMA)
    for frame in (docs, extra, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        got = {r.doc_id: r for r in licenses.digest(licenses.scan(frame)).collect()}
        for r in frame.collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
            hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            g = got[r.doc_id]
            labels = sorted({label for _, label in hits})
            starts = [i for i, _ in hits]
            assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(labels))
            assert set(labels) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_suppression(spark):
    frame = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. Also MIT License.")], "doc_id int, text string")
    found = licenses.scan(frame).first().detections
    assert [(d.label, d.start, d.stop) for d in found] == [("apache-2.0", 0, 8), ("mit", 9, 11)]
    assert len(licenses.rules()) > 200


def test_mixing_meets_targets(spark, docs):
    found = mixing.mix(docs).collect()
    taken, target = collections.Counter(), {}
    for r in found:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    sizes = sum(r.size for r in found)
    assert math.isclose(sum(target.values()), 1.5 * sizes, rel_tol=1e-9)
    assert abs(sum(taken.values()) - 1.5 * sizes) < 0.15 * sizes
    assert "from documents" in MIXED


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b\n c</p><p>d<br>e</p>", "a & b c\n\nd e"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p><b>one, two<p>three</article><footer>f</footer>", "T\n\none, two\n\nthree"),
        ("<div class='content'><p>Long text, with commas, and more.</p><p>Second one.</p></div><div class=sidebar><p>side, side, side, side</p></div><div id=comments><p>me, too, me, too</p></div>", "Long text, with commas, and more.\n\nSecond one."),
        ("<article><p>x</p><script>var t='</p>';</script><style>p{}</style><form><p>no</p></form></article>", "x"),
        ("<article><p>unclosed <i>text", "unclosed text"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_deep_page_is_no_trouble():
    assert html.extract("<div>" * 5000 + "<p>deep</p>") == "deep"


def test_decontamination(spark):
    random.seed(8)
    words = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [" ".join(random.sample(words, n)) + "." for n in (15, 25, 40, 60)]
    clean = [" ".join(random.sample(words, 150)) for _ in range(40)]
    near = items[2].split()
    near[5] = "other"
    dirty = [" ".join([*random.sample(words, 37), item, *random.sample(words, 50)]) for item in [*items, " ".join(near)]]
    frame = spark.createDataFrame(rows([*clean, *dirty, None, "", items[0]]), SCHEMA)
    benchmark = spark.createDataFrame(list(enumerate([*items, None, ""])), "item_id bigint, text string")
    found = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.with_matches(frame, benchmark).collect()}
    expected = {40: [0], 41: [1], 42: [2], 43: [3], 44: [2], 47: [0]}
    assert {i: m for i, m in found.items() if m} == expected and len(found) == 48
    none = decontamination.with_matches(frame, benchmark.filter("item_id > 3"))
    assert none.filter(F.size("matches") > 0).count() == 0


def test_common_subsequence():
    random.seed(2)
    for _ in range(50):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_slices_cover_all_rows():
    given = ["a", None, "", "bcd", None, "é" * 9]
    for column in (pa.array(given), pa.array(["x", *given])[1:], pa.chunked_array([given[:2], given[2:]])):
        found = [bytes(p.data[a:b]).decode() for p in texts(column, 4) for a, b in zip(p.offsets, p.offsets[1:])]
        assert found == [g or "" for g in given]


def applied(frame, spark):
    """What each operator returns for a frame of documents."""
    benchmark = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    return {
        "language": language.predict(frame, language.fit(frame)),
        "quality": quality.score(frame, quality.fit(frame, labels)),
        "repeats": substrings.without_repeats(frame),
        "licenses": licenses.digest(licenses.scan(frame)),
        "decontamination": decontamination.with_matches(frame, benchmark),
        "mixing": mixing.mix(frame),
        "lm": lm.score(frame, F.col("doc_id") != 5),
        "simhash": simhash.near_duplicates(frame),
    }


def test_odd_rows(spark, odd, empty):
    n = odd.count()
    for name, result in applied(odd, spark).items():
        found = result.collect()
        assert len(found) == n, name
        by_id = {r.doc_id: r for r in found}
        if name == "language":
            assert [by_id[i].lang_pred for i in range(4)] == ["und"] * 4 and by_id[4].lang_pred == "en"
        if name == "simhash":
            assert by_id[0].fingerprint == "0" * 16 and by_id[1].component_id == 0 and by_id[6].component_id == 5
        if name == "repeats":
            assert by_id[0].n_bytes == 0 and by_id[7].n_removed == len(LONG)
        if name == "lm":
            assert by_id[0].n_tokens == 1 and by_id[4].n_tokens == 2
        if name == "mixing":
            assert by_id[0].size == 0
    for name, result in applied(empty, spark).items():
        assert result.count() == 0, name


def test_pipeline_on_odd_rows(spark, odd, empty, tmp_path):
    for frame in (odd, empty):
        folder = str(tmp_path / str(id(frame)))
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == frame.columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept == ({4, 5, 7, 8, 9, None} if frame is odd else set())
        assert corpus_pipeline.run(spark, folder).columns == [*frame.columns, "copy"]


def test_language_without_letters_and_clashing_names(spark):
    """A language all of whose texts are null, empty or without letters; columns named like the operators' own."""
    given = [(1, None, "fr"), (2, "", "fr"), (3, "1 2 3", "xx"), (4, "a", "yy"), (5, "the cat and the dog", "en"), (6, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string")
    for name in ("_lowered", "_letters", "_text", "_found", "lowered", "letters", "row"):
        docs = docs.withColumn(name, F.lit(f"mine {name}"))
    model = language.fit(docs)
    assert set(model.langs) == {"en", "de"}
    rows = language.predict(docs, model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "und", 2: "und", 3: "und", 4: rows[3].lang_pred, 5: "en", 6: "de"}
    none = language.fit(docs.filter("doc_id < 4"))
    assert none.langs == [] and {r.rejected for r in language.predict(docs, none).collect()} == {True}
    items = spark.createDataFrame([(1, "the cat and the dog"), (2, "nowhere to be seen")], "item_id bigint, text string")
    found = decontamination.with_matches(docs, items).collect()
    assert {r.doc_id: [m.item_id for m in r.matches] for r in found} == {i: [1] if i == 5 else [] for i in range(1, 7)}
    for r in [*rows, *found]:
        for name in ("_lowered", "_letters", "_text", "_found", "lowered", "letters", "row"):
            assert r[name] == f"mine {name}"
