import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import answers, books, chunking, evaluate, jobs, lexical, records, rules, search, structure
from lectern.sources.catalogue_store import Conflict
from lectern.sources.retrieval_store import HintStore, VectorStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    texts = {"element_10": "the scheduler wakes a task", "element_2": "the scheduler wakes a task", "a": "interrupts and the scheduler", "B": "nothing of that", "empty": "", "none": None}
    elements = spark.createDataFrame(list(texts.items()), "element_id string, text string")
    folder = str(tmp_path_factory.mktemp("index"))
    lexical.build(elements, f"{folder}/i")
    return elements, lexical.opened(spark, f"{folder}/i")


def test_ranks_follow_full_scores_and_unicode_order(spark, collection):
    _, index = collection
    assert index.stats.first()["n"] == 6
    queries = spark.createDataFrame([(0, "scheduler scheduler task"), (1, "nothing"), (2, "!")], "query_id long, text string")
    got = {(r["query_id"], r["rank"]): r["element_id"] for r in lexical.top(lexical.bm25(index, queries), 10, "query_id").collect()}
    assert [got[0, k] for k in (1, 2, 3)] == ["element_10", "element_2", "a"] and got[1, 1] == "B" and len(got) == 4


def test_search_reserves_hints_and_refuses(spark, collection):
    elements, index = collection
    hints = spark.createDataFrame([("pic", "a scheduler diagram"), ("other", "unrelated")], "image_id string, description string")
    links = spark.createDataFrame([("pic", "B", 0, False), ("other", "a", 0, False)], "image_id string, element_id string, image_pos int, ocr boolean")
    find = lambda query, limit, **more: [(r["element_id"], r["hint"]) for r in search.search(index, elements, hints, links, query, limit, **more).orderBy("ord").collect()]
    assert find("scheduler", 10) == [("a", False), ("element_10", False), ("element_2", False), ("B", True)]
    assert find("scheduler", 1) == [("B", True)]  # the hint takes the only place
    backwards = lambda c: c.select("element_id", F.col("rank").cast("double").alias("score"))
    assert [e for e, _ in find("scheduler", 2, rerank=backwards)] == ["B", "element_2"]
    with pytest.raises(search.NoEvidence):
        find("absent", 10)
    some = search.embedded(elements.where("element_id <> 'B'"))
    with pytest.raises(search.Incomplete):
        find("scheduler", 10, vectors=some, query_vector=[1.0] * 17)
    for query, limit in ((" ", 5), ("x" * 8001, 5), ("x", 0), ("x", 11)):
        with pytest.raises(ValueError):
            find(query, limit)


def test_images_beyond_the_cap(spark):
    hits = spark.createDataFrame([("x", 1), ("y", 2)], "element_id string, ord int")
    links = spark.createDataFrame([(f"i{k}", "x", k, k == 7) for k in range(8)] + [("i0", "y", 0, False), ("late", "y", 1, True)], "image_id string, element_id string, image_pos int, ocr boolean")
    got = search.linked_images(hits, links)
    assert [r["image_id"] for r in got.orderBy("seq").collect()] == ["i0", "i1", "i2", "i3", "i4", "i7", "late"]
    bundle = search.bundle(hits, spark.createDataFrame([("x", "ä😀"), ("y", None)], "element_id string, text string"), got, "s")
    assert {(r["kind"], r["stop"]) for r in bundle.collect()} == {("text", 3), ("text", 0), ("figure", None)}
    assert search.answer_context(bundle, links, "s").where("size(linked_text_ids) > 0").count() == 7


def test_vectors(spark, tmp_path):
    store, ddl = VectorStore(spark, str(tmp_path)), "document_id string, revision string, element_id string, vector array<double>"
    active = spark.createDataFrame([("d", "1")], "document_id string, revision string")
    of = lambda *r: spark.createDataFrame(list(r), ddl)
    assert store.read("s").count() == 0
    store.save(of(("d", "1", "a", [1.0, 0.0]), ("d", "1", "b", [0.0, 1.0])), "s", 2, active, 1)
    store.save(of(("d", "1", "a", [3.0, 4.0])), "s", 2, active, 2)
    assert {(r["element_id"], *r["vector"]) for r in store.read("s").collect()} == {("a", 3.0, 4.0), ("b", 0.0, 1.0)} and store.read("other").count() == 0
    for bad in ([("d", "1", "c", [1.0])], [("d", "1", "c", [0.0, 0.0])], [("d", "1", "c", [float("nan"), 1.0])], [("d", "2", "c", [1.0, 1.0])], [("d", "1", "c", [1.0, 1.0])] * 2, [("d", "1", None, [1.0, 1.0])], [("d", "1", "c", None)]):
        with pytest.raises(Conflict):
            store.save(of(*bad), "s", 2, active, 3)
    assert rows(store.missing(of(("d", "1", "a", None), ("d", "1", "z", None)).drop("vector"), "s")) == [("d", "1", "z")]
    pairs = spark.createDataFrame([([1e300, 0.0], [1e300, 1e300]), ([1e-300, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [None if x is None else round(x, 6) for (x,) in pairs.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, -1.0, None, None]


def test_hints(spark, tmp_path):
    store, ddl = HintStore(spark, str(tmp_path)), "document_id string, revision string, source_hash string, image_id string, blob_hash string, model_fingerprint string, prompt_fingerprint string, description string"
    hint = lambda text, image="i": spark.createDataFrame([("d", "1", "s", image, "b", "m", "p", text)], ddl)
    assert store.read().count() == 0 and store.save(hint("seen")) == 1 and store.save(hint("seen")) == 0 and store.save(hint("seen", "j")) == 1
    with pytest.raises(Conflict):
        store.save(hint("otherwise"))
    with pytest.raises(Conflict):
        store.save(hint("one", "k").unionByName(hint("two", "k")))
    assert store.active(spark.createDataFrame([("d", "2")], "document_id string, revision string")).count() == 0 and store.read().count() == 2


def test_rules(spark):
    place = "kind string, page int, start int, stop int, anchor string"
    documents = spark.createDataFrame([("doc_" + "a" * 64, "b" * 64, "x", "p"), ("doc_1", None, "y" * 1001, None)], "document_id string, source_hash string, label string, parser string")
    elements = spark.createDataFrame([("d", "e", "t", "page", 1, None, None, None), ("d", "f", None, "lines", None, 3, 2, None), ("d", "f", "t", "anchor", None, None, None, "x")], f"document_id string, element_id string, text string, {place}")
    images = spark.createDataFrame([("d", "i", "c" * 64, "", "page_render", ["e", "gone"], "page", 0, None, None, None)], f"document_id string, image_id string, blob_hash string, caption string, origin string, element_ids array<string>, {place}")
    got = rows(rules.counted(rules.capture_rules(documents, elements, images)))
    assert got == [("document_id", 1), ("duplicate", 1), ("label", 1), ("locator", 2), ("parser", 1), ("source_hash", 1), ("text", 1), ("unknown_element", 1)]
    assert rules.capture_rules(documents.limit(0), elements.limit(0), images.limit(0)).count() == 0
    assert rows(structure.refused_texts(spark.createDataFrame([(1, "a\0b"), (2, "x" * 31_000), (3, None), (4, "ok\n")], "document_id long, text string"))) == [(1, "nul"), (2, "element")]
    with pytest.raises(structure.OverBudget):
        structure.within_budget(elements, "document_id", "start", "start", 2)


def test_answers(spark):
    need = spark.createDataFrame([(1, "r", "supported", ["t"]), (2, "r", "missing", []), (3, "r", "supported", ["t"]), (3, "q", "conflicting", ["t"]), (4, "r", "supported", [])], "answer_id long, requirement_id string, status string, evidence_ids array<string>")
    texts = spark.createDataFrame([(i, "t") for i in (1, 2, 3)], "answer_id long, text_id string")
    said = spark.createDataFrame([(1, 0, ["t"], ["r"]), (3, 0, ["t", "u"], ["r"])], "answer_id long, ord long, evidence_ids array<string>, requirement_ids array<string>")
    got = {r["answer_id"]: (r["reasons"], r["status"], r["empty_blocks"], r["uncovered"]) for r in answers.diagnostics(need, texts, said).collect()}
    assert got == {1: ("", "answered", 0, 0), 2: ("missing-support", "insufficient-evidence", 1, 1), 3: ("conflicting-evidence", "insufficient-evidence", 0, 1), 4: ("no-candidates", "insufficient-evidence", 1, 1)}
    assert rows(answers.violations(need, texts, said)) == [(3, "conflict_of_one"), (3, "false_mapping"), (3, "unknown_evidence"), (4, "unsupported")]


def test_books_are_found_by_reference_or_title(spark):
    own = spark.createDataFrame([("aa1" + "0" * 61, "Ｂｏｏｋ Ⅳ", True), ("aa2" + "0" * 61, "book iv", False), ("b" * 64, "Straße", False)], "book_id string, title string, active boolean")
    asked = {"B-aa": "ambiguous", "b-AA1": "found", "title: BOOK IV": "ambiguous", "straße": "found", "bbbb": "found", "B-": "invalid", " ": "invalid", "none": "missing", "title: aa1": "missing"}
    selectors = spark.createDataFrame(list(enumerate(asked)), "selector_id long, selector string")
    got = {r["selector_id"]: r["status"] for r in books.resolved(selectors, own).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())
    assert [(r["place"], r["ref"]) for r in books.listed(own).orderBy("place").collect()] == [(1, "B-aa1"), (2, "B-bbb"), (3, "B-aa2")]


def test_jobs(spark):
    plan = jobs.batch_plan(spark.createDataFrame([("x", 0, 5), ("x", 1, 0), ("x", 2, 4)], "book_id string, window_no int, items int"))
    assert rows(plan) == [("x", 0, 0, 0, 4), ("x", 0, 1, 1, 1), ("x", 2, 0, 2, 4)]
    events = spark.createDataFrame([(1, 1, 0, "w", "claim"), (1, 2, 50, "w", "result"), (1, 3, 55, "v", "claim"), (1, 4, 56, "w", "result"), (1, 5, 116, "v", "result"), (2, 6, 0, "w", "result")], "job_id int, seq int, s int, worker string, kind string")
    fenced = jobs.fenced(events.withColumn("ts", F.timestamp_seconds("s")))
    assert rows(fenced) == [(1, 2, True), (1, 4, False), (1, 5, False), (2, 6, False)]
    asked = spark.createDataFrame([(1, 1, "parsed"), (1, 2, "parsing"), (1, 3, "indexing"), (1, 4, "parsed"), (2, 1, "ready")], "job_id int, seq long, state string")
    assert rows(jobs.states(asked)) == [(1, "parsed", 4), (2, None, -1)]
    requests = spark.createDataFrame([("x", 1, 0, "bad"), ("x", 2, 0, "g"), ("x", 3, 0, "h"), ("x", 4, 1, "h"), ("x", 5, 3, "g")], "book_id string, seq int, expected int, generation string")
    assert rows(jobs.activations(requests, spark.createDataFrame([("x", "g"), ("x", "h")], "book_id string, generation string"))) == [("x", "h", 2)]


def test_texts(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert value(T.title_key(F.lit("Ｂｏｏｋ Ⅳ"))) == unicodedata.normalize("NFKC", "Ｂｏｏｋ Ⅳ").lower() == "book iv"
    assert [tuple(p) for p in value(T.pieces(F.lit("ab😀c"), 3))] == [(0, 2, "ab"), (2, 5, "😀c")] and [tuple(p) for p in value(T.pieces(F.lit("abcd"), 3))] == [(0, 3, "abc"), (3, 4, "d")]
    assert value(T.percent_decoded(F.lit("a+b%20c"))) == "a+b c" and value(T.percent_decoded(F.lit("%zz"))) is None
    assert [value(T.safe_resource(F.lit(x))) for x in ("img/a.png", "../a", "a/%2e%2e/b", "http:x", "/a", "a\\b", "")] == [True] + [False] * 6
    assert value(T.job_title(F.lit("/x/.pdf"), F.lit("--\n 12 Rules\n"), F.lit("f" * 64))) == "12 Rules" and value(T.job_title(F.lit("/x/A.PDF"), F.lit(None), F.lit("f"))) == "A"
    assert [value(T.base64_exact(F.lit(x))) for x in ("YQ==", "YQ", "Y Q==", "YR==")] == [True, False, False, False]
    assert value(T.exact_keys(F.lit('{"b":1,"a":2}'), ["a", "b"])) and not value(T.exact_keys(F.lit('{"a":2}'), ["a", "b"])) and not value(T.exact_keys(F.lit("[]"), ["a"]))
    assert value(T.collapsed(F.lit(" a  b\n"))) == "a b" and value(T.escape_markdown(F.lit("a*é 1"))) == "a&#42;é 1"
    assert [value(T.source_allowed(F.lit(x))) for x in ("/d/a.TXT", "/d/.ssh/a.txt", "/d/my_token.md", "/d/a.exe")] == [True, False, False, False]


def test_totals_and_percentiles(spark):
    data = [("k" if i % 3 else "j", i, i * 7 % 11) for i in range(500)] + [(None, 1, 5)]
    df = spark.createDataFrame(data, "key string, n long, v long")
    got = {(r["key"], r["n"]): r["running"] for r in structure.running_total(df, "key", "n", "v", stretch=16).collect()}
    assert all(got[k, n] == sum(v for key, m, v in data if key == k and m <= n) for k, n, _ in data) and len(got) == len(data)
    values = {k: sorted(v for key, _, v in data if key == k) for k in ("k", "j")}
    found = {r["key"]: (r["nearest_rank"], r["n"]) for r in evaluate.nearest_rank(df.where("key is not null"), "key", "v", 0.95).collect()}
    assert found == {k: (v[-(-len(v) * 95 // 100) - 1], len(v)) for k, v in values.items()}
    nulls = spark.createDataFrame([("z", None)], "key string, v double")
    assert rows(evaluate.nearest_rank(nulls, "key", "v", 0.5)) == [("z", None, 0)]


def test_too_many_chunks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(chunking, "MOST", 3)
    with pytest.raises(chunking.TooLong):
        list(chunking._cut(iter([spark.createDataFrame([(1, "x" * 9000)], "document_id long, text string").toArrow().to_batches()[0]])))


def test_records(spark):
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    blobs = spark.createDataFrame([(sha, bytearray(b"x")), (sha, bytearray(b"y")), (sha, None)], "hash string, content binary")
    assert rows(records.verified(blobs).select("state")) == [("corrupt",), ("ok",), ("unavailable",)]
    windows = spark.createDataFrame([("b", 0, "x", sha), ("b", 1, "y", sha), ("b", 2, "x" * 9, hashlib.sha256(b"x" * 9).hexdigest()), ("b", 3, None, None)], "book_id string, window_no int, payload string, checksum string")
    assert [r["window_no"] for r in records.checked_windows(windows, 8).collect()] == [0]
    manifests = spark.createDataFrame([(1, "ready", 5, 5, 1, 1), (2, "parsing", 5, 2, 1, 1), (3, "ready", 5, 4, 2, 1), (4, None, 1, 2, 0, 0)], "job_id long, state string, pages int, parsed int, windows int, indexed int")
    assert rows(records.manifest_rules(manifests)) == [("early", "2"), ("parsed", "4"), ("ready", "3"), ("state", "4"), ("whole", "3"), ("whole", "4")]
    blocks = spark.createDataFrame([(1, 1, "figure", "a<b", "f"), (1, 0, "paragraph", "x*y", "p")], "d long, o long, kind string, text string, id string")
    assert rows(records.exported(blocks, "d", "o")) == [(1, "x&#42;y\n\n![a&#60;b](assets/f.png)", '<p>x*y</p>\n<figure id="f"><figcaption>a&lt;b</figcaption></figure>')]
    assert records.exported(blocks.limit(0), "d", "o").count() == 0


def test_page_texts_of_odd_pages(spark, tmp_path):
    """Long urls, white space beyond SQL's, a line end after .pdf, nulls, numbers below zero: as the query's SQL has them."""
    import duckdb

    from lectern.plans import books  # noqa: F401
    from lectern.plans.catalogue import ORACLE_SQL, QUERIES

    urls = ["https://x.example/" + "a" * 90, "u/x.pdf\n", "u/\u00a0a\u3000.PDF", "u/\t.pdf", "u/", "", None, "u/\u00a0.pdf", "u/" + "é" * 200]
    texts = ["a\u00a0b", "\u00a0a\x0bb\u2003", "\u2028a\u0085", " \t\n\f\r ", "", None, "\n\u3000a\r\n\r\nb"]
    pages = [(k - 4, url, html) for k, (url, html) in enumerate((u, t) for u in urls for t in texts)] + [(None, "u/n", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["page_texts"]).fetchall()
    assert rows(QUERIES["page_texts"](spark, str(tmp_path))) == sorted(want, key=str)


def test_books_are_counted_before_they_meet_selectors(spark):
    """Many selectors of many books: a row a prefix or title meets them, and books that share an id count each."""
    own = spark.createDataFrame([(f"{k % 7:02x}" + "0" * 62, "Title Ⅳ" if k % 2 else f"t{k}", True) for k in range(40)] + [("ff" + "1" * 62, "One", True)], "book_id string, title string, active boolean")
    asked = [(k, s) for k, s in enumerate(["B-00", "b-0", "B-FF1", "title: title iv", "title:one", "ff", "B-ab", "t2", "B-x"] * 50)] + [(0, "B-ff")]
    found = books.resolved(spark.createDataFrame(asked, "selector_id long, selector string"), own)
    got = {(r["selector_id"], r["status"], r["book_id"]) for r in found.collect()}
    one = "ff" + "1" * 62
    want = [("ambiguous", None), ("ambiguous", None), ("found", one), ("ambiguous", None), ("found", one), ("found", one), ("missing", None), ("found", f"{2:02x}" + "0" * 62), ("invalid", None)]
    assert got == {(k, *want[k % 9]) for k, _ in asked} and len(found.collect()) == len(asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [prefix#" in plan and "Aggregate [key#" in plan


def test_a_batch_meets_queries_after_postings_have_met_by_element(spark, monkeypatch):
    """Both ways give the same scores; two rows of one query count a term once, a null query_id is a query."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 11}" for j in range(k % 7 + 1))) for k in range(60)] + [(60, None)], "element_id long, text string")
    tokens = lexical.tokenized(docs)
    index = lexical.Index(lexical.postings(tokens), lexical.corpus_stats(tokens))
    asked = spark.createDataFrame([(1, "w0 w1 w1"), (2, "w2 w10 none"), (None, "w3"), (1, "w1 w4")], "query_id long, text string")
    once = spark.createDataFrame([(1, "w0 w1 w4"), (2, "w2 w10 none"), (None, "w3")], "query_id long, text string")
    want = rows(lexical.bm25(index, once))
    assert len(want) > 30 and rows(lexical.bm25(index, asked)) == want
    monkeypatch.setattr(lexical, "LITERALS", 0)
    monkeypatch.setattr(lexical, "TASK_ROWS", 5)
    for most in (500_000, 0):
        monkeypatch.setattr(lexical, "BROADCAST", most)
        found = lexical.bm25(index, asked)
        assert rows(found) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert most == 0 or "hashpartitioning(query_id" not in plan and "REPARTITION_BY_NUM" in plan
    assert lexical.bm25(index, asked.limit(0)).count() == 0


def test_metrics_compute_hits_once_and_counts_keep_no_rows(spark, monkeypatch):
    from lectern.operators import telemetry
    from lectern.plans import audits, catalogue  # noqa: F401

    seen, top = [], catalogue._batch
    monkeypatch.setattr(catalogue, "_batch", lambda *a: seen.append(top(*a).observe("hits", F.count(F.lit(1)).alias("n"))) or seen[-1])
    sf = "/root/testdata/sf0.001"
    plan = catalogue.QUERIES["hit_at_k"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "CollectMetrics" not in plan
    monkeypatch.setattr(telemetry, "stored", lambda *a: pytest.fail("rows were stored"))
    assert catalogue.QUERIES["search_metrics"](spark, sf).first()["hits"] > 0
