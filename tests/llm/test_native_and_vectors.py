"""Secret scans and URL filters against plain Python, nearest neighbours against all products, the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from querygrade.llm import secret_scan, url_filter, vector_search

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_base_spans_against_plain_python(documents, odd_documents):
    rng = random.Random(3)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ": ", '"', "AKIA", "ABCDEFGHIJ0123456", "deadbeef", "é", "😀", " ", "xyz.", "0123456789abcdef", "secret"]
    rows = [(i, "".join(rng.choices(parts, k=14))) for i in range(300)]
    frame = documents(rows).unionByName(odd_documents)
    found = secret_scan.secret_spans(frame).collect()
    assert len(found) == frame.count()
    for r in found:
        if r.doc_id is not None and r.doc_id < 300 and r.doc_id > 8:
            spans = plain_spans(rows[r.doc_id][1])
            listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
            assert not listed or set(listed.split(",")) <= set(r.spans.split(","))


def test_window_entropy_against_counting(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choices(secret_scan.ALPHABET[: rng.choice([2, 16, 66])], k=rng.choice([1, 19, 20, 21, 70]))) for _ in range(60)]

    def plain(s):
        windows = [s[i : i + 20] for i in range(len(s) - 19)]
        return max((-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in windows), default=-1.0)

    frame = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    got = {r.i: r.h for r in frame.select("i", secret_scan.window_entropy(F.col("s")).alias("h")).collect()}
    assert all(math.isclose(got[i], plain(s), abs_tol=1e-9) for i, s in enumerate(strings))


def test_entropy_spans_and_redaction(documents):
    key = "sk9XqL2vT7bWm4RzPq1Yc8Nd"
    rows = [(1, f"a {key} b"), (2, "a very-long-name-made-of-plain-words b"), (3, "1234567890123456 is a card"), (4, f"token = {key}."), (5, None)]
    spans = {r.doc_id: r.spans for r in secret_scan.secret_spans(documents(rows)).collect()}
    assert spans == {1: "entropy:2:26", 2: "", 3: "hex:0:16", 4: "assign:0:33", 5: ""}
    texts = {r.doc_id: r.text for r in secret_scan.redact(documents(rows)).collect()}
    assert texts == {1: "a [secret] b", 2: rows[1][1], 3: rows[2][1], 4: "[secret]", 5: None}


def test_example_words_cover_their_part_only(documents):
    key = "sk9XqL2vT7bWm4RzPq1Yc8Nd"
    texts = [f"/latest/{key} b", f"STRIPE_TEST={key}", f"a {key}/x/test", f"/latest/{key[:9]}/{key[9:]}", f"a test-{key}", f"{key}example", f"/latest/{'very-long-words' * 2}", f"test/{key[:12]}/test/{key[12:]}"]
    spans = [r.spans for r in secret_scan.secret_spans(documents(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert spans == ["entropy:0:32", "entropy:0:36", "entropy:2:33", "entropy:0:33", "", "", "", ""]


def test_pipeline_masks_all_spans(spark, documents):
    import corpus_pipeline

    rows = [(1, "1234567890123456 is hex"), (2, "a 00000000000000000000 b deadbeefdeadbeef c"), (3, "123456789012345 is short"), (4, 'token = "123456789012345678" x'), (5, None)]
    hidden = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, documents(rows), "").collect()}
    assert {i: r.text for i, r in hidden.items()} == {1: "[secret] is hex", 2: "a [secret] b [secret] c", 3: rows[2][1], 4: '[secret]" x', 5: None}
    assert all(r.text is None or r.n_chars == len(r.text) for r in hidden.values())


def test_pipeline_judges_texts_of_one_id_apart(spark, documents):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, b), (2, a + " tail"), (3, c), (3, c), (4, d), (4, e), (None, d + " end"), (None, "no one else has this text"), (None, "no one else has this text")]
    rows += [(5, None), (5, ""), (5, ""), (None, None), (None, None)]
    kept = corpus_pipeline.drop_near_copies(spark, documents(rows), "")
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(1, a), (2, b), (3, c), (4, d), (4, e), (None, "no one else has this text"), (5, None), (5, ""), (None, None), (None, None)]
    assert found == sorted(want, key=repr)
    assert corpus_pipeline.drop_near_copies(spark, documents(rows).limit(0), "").count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, documents, tmp_path):
    """Columns named like the stages' own come back as they were; an empty table stays empty."""
    import corpus_pipeline

    rng = random.Random(41)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)) + (" key deadbeefdeadbeef" if i % 2 else ""), "en") for i in range(12)]
    names = ["score", "lang_pred", "features", "predicted", "spans", "_base", "_row", "_class", "_rest", "_first", "_bare", "hash", "class", "a.b"]
    docs = documents(rows)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id")))
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r.doc_id: r.asDict() for r in out.collect()}
        assert got.keys() == {r[0] for r in rows}
        assert all(r[n] == f"{n}-{i}" for i, r in got.items() for n in names)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_drops_texts_of_a_few_letters(spark, documents):
    import corpus_pipeline

    rng = random.Random(8)
    words = {"en": "the house and that with which there other about water".split(), "de": "und nicht eine auch wenn schon über zwischen wasser haus".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(2, 60))), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, "the water", None), (201, "das haus und", None), (202, "$$$ q $$$ 12", None), (203, "zzzz zzzz", None), (204, "7 x 9 x 7", None)]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], documents([]).schema)
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, frame, "").collect()}
    assert kept == {r[0] for r in rows} - {202, 203, 204}
    assert corpus_pipeline.keep_languages(spark, frame.limit(0), "").count() == 0


def test_urls(spark):
    urls = [
        (1, "HTTPS://WWW.Example.COM/en/x#a", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "x://a.b.example.com/en/?q", "a.b.example.com", "/en/", "example.com/en/", "block"),
        (3, "x://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        (4, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (5, "x://com", "com", "", None, None), (6, None, "", "", None, "allow"), (7, "nothing", "", "", None, "allow"),
        (8, "http://best-casino-bets.example.org/en/1", "best-casino-bets.example.org", "/en/1", None, "block"),
        (9, "http://library.example.org/en/1", "library.example.org", "/en/1", None, "allow"),
    ]
    pages = spark.createDataFrame([(u[0], u[1], "x") for u in urls], "page_id long, url string, html string")
    rows = url_filter.judge_urls(pages, url_filter.labelled_urls(spark))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.page_id: r for r in rows.collect()}
    for page, _, host, path, rule, verdict in urls:
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
        assert verdict in (None, got[page].verdict)
    untrained = url_filter.judge_urls(pages, url_filter.labelled_urls(spark).where("label = 1"))
    assert {r.verdict for r in untrained.where("rule IS NULL").collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.labelled_urls(spark)).count() == 0


def plain_nearest(ids, vectors, query):
    scores = (vectors * vectors[ids.tolist().index(query)]).sum(axis=1)
    other = ids != query
    order = np.lexsort((ids[other], -scores[other]))[:20]
    return list(zip(ids[other][order].tolist(), scores[other][order].tolist()))


@pytest.mark.parametrize("n", [3, 1500])
def test_nearest_neighbours(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((12, 16))
    vectors = (centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, 16))).astype(np.float32)
    vectors[n // 2 :] = vectors[n // 2]  # half of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(n + 20, None), (n + 40, [0.0] * 16), (n + 60, [float("nan")] * 16), (n + 80, [None] * 16), (None, [1.0] * 16), (n + 100, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = {}
    for r in vector_search.nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, wide = np.arange(n), vectors.astype(np.float64)
    assert sorted(found) == list(range(0, n, 20))
    hits = total = 0
    for query, got in found.items():
        want = plain_nearest(ids, wide, query)
        assert [g[0] for g in got] == list(range(1, len(want) + 1))
        assert got == sorted(got, key=lambda g: (-g[2], g[1])) and all(g[2] == (wide[g[1]] * wide[query]).sum() for g in got)
        hits += len({g[1] for g in got} & {w[0] for w in want})
        total += len(want)
    assert hits >= (0.9 if n > 100 else 1.0) * total
    assert vector_search.nearest_neighbours(frame.limit(0)).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    graph = vector_search.neighbour_graph(rng.standard_normal((400, 8)))
    sizes = np.bincount(vector_search.balanced_parts(graph, 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(20)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(40)) + "."
    junk = lambda: " ".join("".join(rng.choices("abcdefghij", k=4)) + "$$$" for _ in range(40))
    copied = prose()
    texts = [prose() if i % 4 else junk() for i in range(200)] + [copied, copied, copied + " tail", "12345", "", None, f"{prose()} token = \"4d44c79e8bf7c55759c4958dd60ed83d\" end"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(range(207)) - set(kept[0]) == {203, 204, 205}
    assert {i for i in kept[0] if i < 200} - set(kept[1]) == set(range(0, 200, 4))
    assert set(kept[1]) - set(kept[2]) == {201, 202} & set(kept[1])
    assert "4d44c79e" not in kept[3][206] and "[secret]" in kept[3][206]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept[3])
