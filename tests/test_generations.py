"""Generations of vectors, and one epoch over catalogue, vectors and hints."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.embedding import Lengths, Space
from lectern.sources.catalogue_store import Conflict
from lectern.sources.generation_store import GenerationStore, planned
from lectern.sources.library import Library
from lectern.sources.retrieval_store import VectorStore

SPACE, OTHER = Space("local", "lengths", "1", 17), Space("local", "lengths", "2", 17)
ELEMENT = "book_id string, window_no int, pos int, page int, text string"


def elements(spark, *rows):
    return spark.createDataFrame(list(rows), ELEMENT)


@pytest.fixture
def books(spark):
    return elements(spark, *[("a", w, k, w, f"alpha page {w} item {k}") for w, n in ((1, 9), (6, 0), (11, 5)) for k in range(n)], ("b", 1, 0, 1, "beta gamma"), ("b", 1, 1, 2, None))


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "book_id string, generation string, expected string, expected_epoch int")


def test_batches_are_numbered_over_the_book(books):
    got = {(r["book_id"], r["ordinal"]): len(r["elements"]) for r in planned(books).collect()}
    assert got == {("a", 0): 4, ("a", 1): 4, ("a", 2): 1, ("a", 3): 4, ("a", 4): 1, ("b", 0): 2}


def test_generations(spark, books, tmp_path):
    store = GenerationStore(spark, str(tmp_path))
    assert store.search(books, "alpha", 3).count() == 0 and store.pointers().count() == 0
    store.reindex("one", SPACE)
    with pytest.raises(Conflict):
        store.reindex("one", SPACE)
    with pytest.raises(Conflict):
        store.resume("none", books, SPACE, Lengths(SPACE), "0")
    with pytest.raises(Conflict, match="drift"):
        store.resume("one", books, OTHER, Lengths(OTHER), "0")
    # half of it, then what is left; a commit that is repeated leaves the same rows
    store.resume("one", books.where("book_id = 'b'"), SPACE, Lengths(SPACE), "0")
    assert {(r["book_id"], r["valid"], r["missing"]) for r in store.state("one", books).collect()} == {("a", False, 5), ("b", True, 0)}
    for _ in range(2):
        store.resume("one", books, SPACE, Lengths(SPACE), "1")
    assert store.stored("one").count() == 6 and {r["valid"] for r in store.state("one", books).collect()} == {True}
    first = requests(spark, ("a", "one", None, 0), ("b", "one", None, 0))
    assert {r["taken"] for r in store.activate(first, books).collect()} == {True}
    assert {r["why"] for r in store.activate(first, books).collect()} == {"moved"}
    hits = store.search(books, " alpha 11 ", 2, SPACE, Lengths(SPACE)).collect()
    assert [(r["page"], r["pos"], r["rank"]) for r in sorted((r for r in hits if r["book_id"] == "a"), key=lambda r: r["rank"])] == [(11, 0, 1), (11, 1, 2)]
    # a shadow in another space changes nothing until it is active
    store.reindex("two", OTHER)
    store.resume("two", books.where("book_id = 'a' and window_no < 11"), OTHER, Lengths(OTHER), "0")
    assert {r["generation"] for r in store.search(books, "alpha", 2, SPACE, Lengths(SPACE)).collect()} == {"one"}
    assert {(r["taken"], r["why"]) for r in store.activate(requests(spark, ("a", "two", "one", 1)), books).collect()} == {(False, "not valid")}
    store.resume("two", books.where("book_id = 'a'"), OTHER, Lengths(OTHER), "1")
    with pytest.raises(Conflict):
        store.activate(requests(spark, ("a", "two", "one", 1), ("a", "one", "one", 1)), books)
    assert store.activate(requests(spark, ("a", "two", "one", 1)), books).first()["taken"]
    with pytest.raises(Conflict, match="drift"):
        store.search(books, "alpha", 2, SPACE, Lengths(SPACE))
    # back, and the epoch tells it from the first time
    assert store.activate(requests(spark, ("a", "one", "two", 2)), books).first()["taken"]
    assert store.activate(requests(spark, ("a", "two", "one", 1)), books).first()["why"] == "moved"
    assert {(r["book_id"], r["generation"], r["epoch"]) for r in store.pointers().collect()} == {("a", "one", 3), ("b", "one", 1)}
    # vectors of texts as they were fail every search, a lexical one too
    changed = books.withColumn("text", F.when((F.col("page") == 1) & (F.col("pos") == 3), "other").otherwise(F.col("text")))
    assert {(r["book_id"], r["drifted"], r["valid"]) for r in store.state("one", changed).collect()} == {("a", 1, False), ("b", 0, True)}
    with pytest.raises(Exception, match="binding drift"):
        store.search(changed, "alpha", 2).collect()
    assert store.search(books.limit(0), "alpha", 2).count() == 0


def test_point_reads_and_replacement(spark, tmp_path):
    store, ddl = VectorStore(spark, str(tmp_path), buckets=4), "document_id string, revision string, element_id string, vector array<double>"
    rows = spark.createDataFrame([(f"d{k % 20}", "1", f"e{k}", [float(k), 1.0]) for k in range(200)], ddl)
    active = rows.select("document_id", "revision").distinct()
    store.save(rows, "s", 2, active, 1)
    store.save(rows.where("document_id = 'd3'").withColumn("vector", F.array(F.lit(0.0), F.lit(2.0))), "s", 2, active, 5)
    store.save(rows.limit(0), "s", 2, active, 6)
    one = store.document("s", "d3", "1")
    assert {tuple(r["vector"]) for r in one.collect()} == {(0.0, 2.0)} and one.count() == 10 and store.read("s").count() == 200
    # no row is left behind in the files, and one folder of them is read
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 200
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(space_key" in plan and "bucket" in plan and "EqualTo(document_id,d3)" in plan
    assert len({f.split("bucket=")[1][0] for f in one.inputFiles()}) >= 1
    assert store.read("s", 0).count() == 0 and store.read("s", 1).count() == 200 and store.document("s", "none", "1").count() == 0


def test_one_epoch(spark, tmp_path):
    library = Library(spark, str(tmp_path), "document_id string, revision string, element_id string")
    of = lambda *r: spark.createDataFrame(list(r), library.catalogue.schema)
    vectors = lambda *r: of(*r).withColumn("vector", F.array(F.lit(1.0)))
    hint = lambda d, r: spark.createDataFrame([(d, r, "s", "i", "b", "m", "p", "text")], "document_id string, revision string, source_hash string, image_id string, blob_hash string, model_fingerprint string, prompt_fingerprint string, description string")
    assert library.snapshot("s").epoch == 0 and library.snapshot("s").elements.count() == 0
    library.catalogue.publish(of(("b", "1", "e"), ("a", "1", "e")), 0)
    library.save_vectors(vectors(("a", "1", "e"), ("b", "1", "e")), "s", 1, 1)
    assert library.save_hints(hint("a", "1"), 1) == 2 and library.save_hints(hint("a", "1"), 2) == 2
    library.catalogue.publish(of(("a", "2", "e")), 2)
    for stale in (lambda: library.save_vectors(vectors(("a", "1", "e")), "s", 1, 1), lambda: library.save_hints(hint("b", "1"), 2), lambda: library.save_vectors(vectors(("a", "1", "e")), "s", 1, 3)):
        with pytest.raises(Conflict):
            stale()
    library.save_vectors(vectors(("a", "2", "e")), "s", 1, 3)
    library.catalogue.remove(of(("b", "", "")), 3)
    size = lambda s: (s.documents.count(), s.elements.count(), s.vectors.count(), s.hints.count())
    assert [size(library.snapshot("s", e)) for e in (0, 1, 2, 3, 4)] == [(0, 0, 0, 0), (2, 2, 2, 0), (2, 2, 2, 1), (2, 2, 2, 0), (1, 1, 1, 0)]
    assert [r["document_id"] for r in library.snapshot(None, 1).ordered().documents.collect()] == ["a", "b"]
    # work that ends at another epoch than it was planned at is refused
    assert library.dispatched(4, lambda: "done") == "done"
    with pytest.raises(Conflict, match="planned at epoch 4"):
        library.dispatched(4, lambda: library.catalogue.touch(4))
    with pytest.raises(Conflict):
        library.dispatched(4, lambda: pytest.fail("must not start"))
