import json
import os
import sys
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpuscle import schemas as S
from corpuscle.operators import agreement, corpus, labeling, rollup, sampling, sentences, statistics
from corpuscle.session import ensure_checkpoint_dir, squash
from corpuscle.sources import readers, sinks
from corpuscle.streaming import pipelines

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

DIM = "actor string, type string, positioning string, pair string, target int"


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("Acme Labs", "company", "safety", None, 5), ("Bo Lee", "individual", "capability", "Acme Labs", 5), ("The Board", "policymaker", "regulator", None, 5)], DIM)


RAW = "doc_id string, actor string, context string, platform string, date string, text string"


def test_enrich_and_dedup(spark, dim):
    long = "x " * 150
    rows = [
        ("1", " ACME\tlabs", "Policy ", "Blog", "2022-11-30", "some text"),
        ("2", "nobody", "policy", "blog", "2020-01-01", "t"),
        ("3", "Bo Lee", "other", "blog", "2020-01-01", "t"),
        ("4", "Bo Lee", "public", "tv", None, "a b c"),
        ("5", "Bo Lee", "public", None, "unknown", " 　 "),
        ("6", "Bo Lee", "public", "speech", "2020-01-01", long + "one"),
        ("7", "Bo Lee", "public", "speech", "2020-01-01", long + "two"),
        ("8", "Bo Lee", "public", "speech", "2020-01-02", long + "two"),
    ]
    e = corpus.enrich(spark.createDataFrame(rows, RAW), dim)
    got = {r.doc_id: (r.actor, r.context, r.platform, r.date, r.post_chatgpt, r.word_count) for r in e.collect()}
    assert set(got) == {"1", "4", "6", "7", "8"}
    assert got["1"] == ("Acme Labs", "policy", "blog", "2022-11-30", 1, 2) and got["4"][2:5] == ("press_release", "unknown", 0)
    assert {r.doc_id for r in corpus.deduplicate(e).collect()} == {"1", "4", "6", "8"}
    assert corpus.deduplicate(e.limit(0)).count() == 0
    gaps = {(r.actor, r.context): r.missing for r in corpus.coverage_gaps(e, dim, 2).collect()}
    assert ("The Board", "commercial") not in gaps and gaps["Acme Labs", "policy"] == 1 and ("Bo Lee", "public") not in gaps
    assert {r.rule: r.passed for r in corpus.balance_rules(e).collect()}["min_total_docs"] is False


def test_one_row_per_id(spark, monkeypatch):
    from corpuscle import session

    rows = [(f"d{i % 40}", i, f"text {i % 40}", None) for i in range(90)]
    rows += [("tie", 1, "b", "x"), ("tie", 1, "a", "x"), ("tie", 0, "z", None), ("same", 3, "b", None), ("same", 3, "b", None), ("same", 3, "a", None), (None, 2, "n", None), (None, 1, "m", None), ("late", None, "q", None), ("late", 4, "r", None)]
    df = spark.createDataFrame(rows, "doc_id string, scraped_at int, text string, actor string")
    want = {(f"d{i}", f"text {i}", None) for i in range(40)} | {("tie", "z", None), ("same", "a", None), (None, "m", None), ("late", "q", None)}
    for most in (100_000, 0):  # beyond the bound only rows that may be repeated are shuffled
        monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", most)
        out = corpus.one_per_id(df)
        assert [c for c in out.columns] == ["doc_id", "text", "actor"]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        docs = spark.createDataFrame([("b", "x", "1", "same"), ("a", "x", "1", "same"), ("c", "x", "2", "same"), ("d", None, "1", None), ("e", None, "1", None)], "doc_id string, actor string, date string, text string")
        assert {r.doc_id for r in corpus.deduplicate(docs).collect()} == {"a", "c", "d"}
    assert corpus.one_per_id(df.limit(0)).count() == 0


def test_texts_do_not_move(spark):
    rows = [(f"d{i % 30}", i, "some text " * 50, "x", str(i), ) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, scraped_at int, text string, actor string, date string")
    plan = corpus.deduplicate(corpus.one_per_id(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_squash(spark):
    df = spark.createDataFrame([("\tA\xa0 b C ",), (None,)], "v string")
    assert [r[0] for r in df.select(squash(F.col("v"))).collect()] == ["a b c", None]


def test_validate(spark):
    df = spark.createDataFrame([("1", "x", 3)], "doc_id string, extra string, word_count long")
    with pytest.raises(ValueError, match="missing"):
        S.validate(df, S.CORPUS)
    assert S.validate(df, "doc_id string, word_count int").columns == ["doc_id", "word_count"]


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(f"d{i % 50}:{i}", f"actor {i % 9}", ["commercial", "policy", "public"][i % 3 if i % 4 else 0], i % 5 == 0) for i in range(3000)]
    return spark.createDataFrame(rows, "sentence_id string, actor string, context string, likely_none boolean").cache()


def test_quota_sample(spark, pool):
    q = {"commercial": 34, "policy": 33, "public": 33}
    for parts in (1, 7):
        s = sampling.quota(pool.repartition(parts), "context", q, "likely_none", 0.15, 3).toPandas()
        assert s.groupby("context").size().to_dict() == q
        assert (s.groupby("context").likely_none.sum() >= 5).all()
    short = sampling.quota(pool.where("likely_none"), "context", q, "likely_none", 0.15, 3)
    assert short.count() == 100  # falls back to what there is


def test_disjoint_sets(pool):
    s = sampling.disjoint_sets(pool, "context", 40, ["A", "B"], 5).toPandas()
    assert s.groupby(["context", "annotator"]).size().eq(40).all() and s.sentence_id.is_unique
    allrows = pool.toPandas()
    import hashlib

    key = lambda x: hashlib.md5(f"{x}|5".encode()).hexdigest()
    want = sorted(allrows[allrows.context == "policy"].sentence_id, key=key)[:80]
    assert set(s[s.context == "policy"].sentence_id) == set(want)
    assert sampling.disjoint_sets(pool.limit(0), "context", 4, ["A"], 5).count() == 0


def test_agreement(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    rows = [("x", int(i), int(j)) for i, j in zip(a, b)] + [("y", 0, 0)] * 20 + [("z", k % 2, k % 2) for k in range(10)]
    long = spark.createDataFrame(rows, "label string, a int, b int")
    k = {r.label: r for r in agreement.kappa(long).collect()}
    po, pe = (a == b).mean(), a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
    assert k["x"].kappa == pytest.approx((po - pe) / (1 - pe), abs=1e-6) and k["y"].kappa is None and k["z"].kappa == 1
    p = {r.label: r for r in agreement.prf(long).collect()}
    tp = ((a == 1) & (b == 1)).sum()
    assert p["x"].precision == pytest.approx(tp / b.sum(), abs=1e-6) and p["y"].f1 == 0 and p["z"].f1 == 1


class Flaky:
    calls = 0

    def __call__(self, batch):
        if any("bad" in x["text"] for x in batch):
            raise TimeoutError
        return "```json\n" + json.dumps([{"id": x["id"], "labels": ["Risk/Harm", "Nonsense"] if "risk" in x["text"] else []} for x in batch if "lost" not in x["text"]]) + "\n```"


def test_labeler(spark):
    rows = [(f"s{i}", "a risk") for i in range(20)] + [("t1", "lost"), ("t2", "plain"), ("t3", None)]
    df = spark.createDataFrame(rows, "sentence_id string, sentence_text string").coalesce(1)
    got = labeling.one_hot(labeling.label(df, Flaky, batch=5))
    assert got.agg(F.sum("risk"), F.sum("is_none")).first()[:] == (20, 3)
    bad = labeling.label(spark.createDataFrame([("b1", "bad"), ("b2", "risk")], df.schema).coalesce(1), Flaky, batch=5)
    assert {(r.sentence_id, tuple(r.labels), r.error) for r in bad.collect()} == {("b1", ("None",), "TimeoutError"), ("b2", ("None",), "TimeoutError")}
    assert labeling.dead_letters(bad).first().n == 2 and len(labeling.dead_letters(bad).first().first_ids) == 2
    with pytest.raises(KeyError):
        labeling.labeler_for("unknown")
    assert labeling.parse_response("[]", ["a"]) == {"a": ["None"]}
    with pytest.raises(json.JSONDecodeError):
        labeling.parse_response("", ["a"])


def test_one_hot_none_only_alone(spark):
    df = spark.createDataFrame([(["None"],), (["None", "Risk/Harm"],), (["Risk/Harm"],)], "labels array<string>")
    assert [r.is_none for r in labeling.one_hot(df).collect()] == [1, 0, 0]


def test_doc_scores(spark):
    meta = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    lab = spark.createDataFrame([("a", 1, 0, 0, 0, 0), ("a", 0, 0, 0, 0, 0)], "doc_id string, innovation int, economic int, risk int, regulation int, existential int")
    got = {r.doc_id: (r.n_sentences, r.innovation_score, r.none_pct) for r in rollup.doc_scores(meta, lab).collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (0, None, None)}


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(2)
    n = 500
    p = pd.DataFrame({"context": rng.choice(["commercial", "policy", "public"], n), "actor_type": rng.choice(["company", "individual"], n), "post": rng.integers(0, 2, n)})
    p["y"] = 0.3 + 0.2 * (p.context == "policy") - 0.1 * p.post + rng.normal(0, 0.1, n)
    f = statistics.fit(spark.createDataFrame(p), "y", ["context", "actor_type", "post"], numeric=("post",))
    x = np.column_stack([np.ones(n), p.context == "policy", p.context == "public", p.actor_type == "individual", p.post]).astype(float)
    b, sse, *_ = np.linalg.lstsq(x, p.y, rcond=None)
    assert np.allclose(f.beta, b) and f.sse == pytest.approx(sse[0])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse[0] / (n - 5))
    assert np.allclose(np.sqrt(np.diag(f.cov)), se)
    assert np.allclose(x.T @ (p.y - x @ b), 0, atol=1e-8)
    r2, *_ , count = f.summary()
    assert 0 < r2 < 1 and count == n


def test_aliased_columns_are_reported(spark):
    rows = [("company", "capability", 0.1), ("company", "safety", 0.3), ("policymaker", "regulator", 0.5), ("policymaker", "regulator", 0.7), ("company", "safety", 0.2)]
    f = statistics.fit(spark.createDataFrame(rows, "actor_type string, positioning string, y double"), "y", ["actor_type", "positioning"])
    by = {r[0]: r for r in f.table()}
    assert by["positioning[regulator]"][-1] is True and by["positioning[regulator]"][1] is None and f.rank == 3


def test_saturated_model_is_cell_means(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"actor": rng.choice(["a", "b", "c"], 400), "context": rng.choice(["commercial", "policy"], 400), "y": rng.random(400)})
    f = statistics.fit(spark.createDataFrame(p), "y", ["actor", "context"], interactions=[("actor", "context")])
    m = p.groupby(["actor", "context"]).y.mean()
    beta = dict(zip(f.terms, f.beta))
    assert beta["Intercept"] == pytest.approx(m["a", "commercial"])
    assert beta["actor[b]:context[policy]"] == pytest.approx(m["b", "policy"] - m["b", "commercial"] - m["a", "policy"] + m["a", "commercial"])
    stat, q, pv = statistics.wald(f, [i for i, t in enumerate(f.terms) if ":" in t])
    assert q == 2 and 0 <= pv <= 1 and stat >= 0


def test_welch_refuses_single_groups(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0), (0.3, 0)], "v double, g int")
    assert statistics.welch(df, "v", "g").first().t is None
    df = spark.createDataFrame([(0.1, 1), (0.4, 1), (0.2, 0), (0.3, 0), (None, 0)], "v double, g int")
    assert statistics.welch(df, "v", "g").first().t == pytest.approx(0.0)


def test_stars():
    assert [statistics.stars(p) for p in (0.0005, 0.005, 0.03, 0.2, None)] == ["***", "**", "*", "", ""]


def test_reason_histogram(spark):
    df = spark.createDataFrame([("d", "Too short. The model is one of them and it counts here.")], "doc_id string, text string")
    h = {r.reason: r.n for r in sentences.reason_histogram(sentences.explode(df, ["doc_id"])).collect()}
    assert h == {"too_short": 1, "kept": 1, "junk_fragment": 0, "off_topic": 0, "no_ai_relevance": 0, "non_english": 0}


# -- sources and sinks
def test_raw_json(spark, tmp_path):
    d = tmp_path / "acme" / "policy"
    d.mkdir(parents=True)
    (tmp_path / "_excluded").mkdir()
    (d / "a.json").write_text(json.dumps({"url": "u1", "date": "2024-01-01", "text": 'a "b"\nc', "actor": "A", "context": "policy", "platform": "blog"}))
    (d / "b.json").write_text("{broken")
    (tmp_path / "_excluded" / "c.json").write_text(json.dumps({"url": "u2"}))
    rows = readers.raw_documents(spark, str(tmp_path)).collect()
    assert [(r.url, r.text) for r in rows] == [("u1", 'a "b"\nc')]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'quote "q"\nnew, line'), ("2", "")], "sentence_id string, t string")
    sinks.csv(df, str(tmp_path / "x"))
    back = readers.csv(spark, str(tmp_path / "x"))
    assert {(r.sentence_id, r.t or "") for r in back.collect()} == {("1", 'quote "q"\nnew, line'), ("2", "")}
    assert readers.done_ids(spark, str(tmp_path / "x")).count() == 2


def test_append_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("1", 0), ("2", 0)], "sentence_id string, x int")
    assert sinks.append_new(df, p, "sentence_id") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([("3", 1)], df.schema)), p, "sentence_id") == 1
    assert spark.read.parquet(p).count() == 3
    sinks.swap_column(spark, p, spark.createDataFrame([("1", 9)], df.schema), "sentence_id", "x")
    assert {r.sentence_id: r.x for r in spark.read.parquet(p).collect()} == {"1": 9, "2": None, "3": None}


def test_sheet(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>s1</t></is></c><c r="C2"><v>1</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>sentence_id</t></si><si><t>Risk_Harm</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    r = readers.sheets(spark, str(tmp_path / "*.xlsx")).collect()
    assert [(x.sentence_id, x.Risk_Harm, x.Notes) for x in r] == [("s1", "1", None)]


def test_pdf(spark, tmp_path):
    body = zlib.compress(b"BT (Hello \\(big\\) world) Tj T* [(wide) -20 (r) 3 ( text)] TJ ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>stream\n" + body + b"\nendstream endobj")
    m = spark.createDataFrame([("a.pdf", "A")], "filename string, actor string")
    assert readers.pdfs(spark, str(tmp_path / "*.pdf"), m, 3).first().text == "Hello (big) world wider text"


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>http://x.example/abs/1v3</id><title>A\n b</title><summary> s </summary><published>2024-01-02T00:00:00Z</published></entry><entry><id>q</id><title>t</title></entry></feed>")
    assert [tuple(r) for r in readers.feed(spark, str(tmp_path / "f.xml")).collect()] == [("http://x.example/abs/1", "A b", "s", "2024-01-02")]
    (tmp_path / "c.json").write_text(json.dumps([["urlkey", "timestamp", "original", "status"], ["k", "2", "u2", "200"], ["k", "1", "u1", "200"], ["z", "1", "u3", "404"]]))
    assert [tuple(r) for r in readers.archive_index(spark, str(tmp_path / "c.json")).collect()] == [("k", "1", "u1", "200")]


WEB = {"http://a.example/": (200, '<a href="/x">x</a>'), "https://a.example/x": (200, '<a href="/y">y</a><a href="/gone">g</a>'), "https://a.example/y": (200, ""), "https://a.example/gone": (404, "no")}


def test_crawl(spark):
    seeds = spark.createDataFrame([("http://a.example/",)], "url string")
    got = {r.url: r.html for r in readers.crawl(seeds, lambda u: WEB[u], 5).collect()}
    assert set(got) == set(WEB) and got["https://a.example/gone"] is None


def test_archive_range_and_snapshots(spark, tmp_path):
    rows = [["original", "timestamp"], ["u1", "20200101000000"], ["u1", "20210101000000"], ["u2", "20220101000000"], ["u3", "20230101000000"], ["short"]]
    (tmp_path / "i.json").write_text(json.dumps(rows))
    read = lambda **k: {(r.original, r.timestamp) for r in readers.archive_index(spark, str(tmp_path / "i.json"), **k).collect()}
    assert read() == {("u1", "20200101000000"), ("u2", "20220101000000"), ("u3", "20230101000000")}
    assert read(first="2021", last="2022060100") == {("u1", "20210101000000"), ("u2", "20220101000000")} and len(read(most=2)) == 2
    (tmp_path / "e.json").write_text("[]")
    assert readers.archive_index(spark, str(tmp_path / "e.json")).count() == 0
    got = readers.snapshots(readers.archive_index(spark, str(tmp_path / "i.json")), lambda u: (404, "") if u.endswith("u3") else (200, u), "https://a.example/web")
    assert {(r.original, r.date, r.html) for r in got.collect()} == {("u1", "2020-01-01", "https://a.example/web/20200101000000/u1"), ("u2", "2022-01-01", "https://a.example/web/20220101000000/u2"), ("u3", "2023-01-01", None)}


SITE = {
    "https://a.example/blog": '<a href="/p1">1</a><a href="/tag/x">t</a><a href="/blog">self</a><a href="/f.pdf">f</a><a href="https://b.example/q">other</a>',
    "https://a.example/blog/page/2": '<a href="/p2?x=1">2</a><a href="/p1">1</a>', "https://a.example/blog/page/4": '<a href="/p4#c">4</a>',
    "https://c.example": '<a href="/n1">1</a>', "https://c.example?page=2": '<a href="/n2">2</a>', "https://c.example?page=3": '<a href="/n3">3</a>', "https://c.example?page=4": '<a href="/n4">4</a>',
}


def test_listings_turn_pages(spark):
    sites = spark.createDataFrame([("https://a.example/blog",), ("https://c.example",)], "url string")
    get = lambda u: (200, SITE[u]) if u in SITE else (404, "")
    got = {(r.site[8], r.link.rsplit("/")[-1]) for r in readers.listings(sites, get, 1).collect()}
    assert got == {("a", "p1"), ("a", "p2"), ("a", "p4"), ("c", "n1"), ("c", "n2"), ("c", "n3")}  # c ends with three times what is wanted


def test_search_and_news_pages(spark):
    def get(url):
        start = int(url.rsplit("=")[-1])
        return 200, json.dumps({"total": {"value": 5}, "results": [{"link": f"/r{i}", "public_timestamp": "2024-01-02T00:00:00Z"} for i in range(start, min(start + 2, 5))] + [{"title": "no link"}]})

    assert sorted(tuple(r) for r in readers.search(spark, get, "https://a.example/s?start={start}", "https://a.example", 2).collect()) == [(f"https://a.example/r{i}", "2024-01-02") for i in range(5)]
    page = lambda n, items, status="ok", total=9: (n, json.dumps({"status": status, "totalResults": total, "articles": [{"url": u, "title": "T", "publishedAt": "2024-01-02T01:00:00Z"} for u in items]}))
    read = lambda *pages: {r.url for r in readers.news_pages(spark.createDataFrame(list(pages), "page int, body string"), size=2).collect()}
    assert read(page(1, ["u1?x", "u2/"]), page(2, ["u2", "u3"]), page(3, ["u4"]), page(4, ["u5", "u6"])) == {"u1", "u2", "u3", "u4"}  # ends after a page that is not full
    assert read(page(1, ["u1", "u2"]), page(2, [], "error"), page(3, ["u3", "u4"])) == {"u1", "u2"}
    assert read(page(1, ["u1", "u2"], total=2), page(2, ["u3", "u4"])) == {"u1", "u2"} and read(page(6, ["u1", "u2"])) == set()


def test_talks_registry_and_dispatch(spark):
    page = '<ul><li>Ada Vane on rivers <a href="/talks/rivers?x">see</a></li><li>Nobody <a href="/talks/none">see</a></li><li>Ada Vane <a href="/talks/rivers/transcript">t</a></li></ul>'
    pages = spark.createDataFrame([("https://t.example/s", page), ("https://t.example/e", None)], "url string, html string")
    got = readers.talks(pages, spark.createDataFrame([("Ada Vane",), ("Bo Lee",)], "speaker string")).collect()
    assert [tuple(r) for r in got] == [("https://t.example/talks/rivers/transcript", "Ada Vane")]
    r = readers.registry(spark, [("2024-01-02", "x")], "date string, actor string", "https://p.example/{date}/debate").first()
    assert r.url == "https://p.example/2024-01-02/debate" and readers.dispatch({"news": 1, "blog": 2}, "A Blog") == 2 and readers.dispatch({}, "x") is None


def test_fetched_pdfs(spark):
    body = b"%PDF-1.4\nstream\nBT (Hello wider world) Tj ET\nendstream\n%%EOF"
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")

    def get(u):
        return (200, body) if u == "a" else (404, b"") if u == "b" else (200, b"nothing")

    assert [tuple(r) for r in readers.fetched_pdfs(urls, get, 3).collect()] == [("a", "Hello wider world")]
    assert readers.fetched_pdfs(urls, get, 4).count() == 0


def test_two_readers(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 0), ("3", "z", 1)], "sentence_id string, note string, risk int")
    b = spark.createDataFrame([("1", "p", 0), ("2", "q", 0), ("9", "r", 1)], "sentence_id string, note string, risk int")
    j = agreement.join_readers(a, b, ["risk"])
    assert j.columns == ["sentence_id", "note_a", "risk_a", "note_b", "risk_b"] and j.count() == 2
    assert tuple(agreement.overlap(a, b).first()) == (2, 1, 1)
    p = agreement.with_predictions(a, spark.createDataFrame([("1", ["Risk/Harm"])], "sentence_id string, labels array<string>"))
    assert {r.sentence_id: r.predicted for r in p.collect()} == {"1": ["Risk/Harm"], "2": ["None"], "3": ["None"]}


def test_welch_verdict(spark):
    df = spark.createDataFrame([(float(x), 1) for x in (5, 6, 7, 8)] + [(float(x), 0) for x in (1, 2, 3, 3)] + [(None, 0)], "v double, f int")
    r = statistics.welch_verdict(statistics.welch(df, "v", "f")).first()
    assert r.supported and 0.001 < r.p < 0.01
    r = statistics.welch_verdict(statistics.welch(df.where("f = 1"), "v", "f")).first()
    assert r.p is None and not r.supported


# -- streams
def test_label_stream_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    df = spark.createDataFrame([("1", "a risk"), ("2", "none")], "sentence_id string, sentence_text string")
    df.write.parquet(src)
    pipelines.label_stream(pipelines.read_parquet_stream(spark, src, df.schema), out, checkpoint=ck)
    spark.createDataFrame([("2", "none"), ("3", "risk again")], df.schema).write.mode("append").parquet(src)
    pipelines.label_stream(pipelines.read_parquet_stream(spark, src, df.schema), out, checkpoint=ck)
    assert {r.sentence_id: r.risk for r in spark.read.parquet(out).collect()} == {"1": 1, "2": 0, "3": 1}


def test_checkpoint_dir_is_the_sessions(spark):
    assert ensure_checkpoint_dir(spark) and os.path.sep in ensure_checkpoint_dir(spark)


# -- registry against DuckDB
def test_entry_and_oracles(spark):
    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    for name in ("corpus_enriched", "filter_reason_histogram", "overlap_sample", "kappa_by_label", "m1_coef", "page_links", "coverage_gaps"):
        a, b = q[name](spark, sf).toPandas(), con.execute(o[name]).df()
        assert sorted(a.columns) == sorted(b.columns), name
        key = sorted(a.columns)
        f = lambda d: d[key].round(5).astype(str).replace({"None": "", "nan": "", "<NA>": ""}).sort_values(key).reset_index(drop=True)
        assert f(a).equals(f(b)), name
    assert e.entry(spark).count() > 0
