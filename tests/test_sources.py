import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.sources import markdown
from lectern.sources.catalogue_store import CatalogueStore, Conflict
from lectern.streaming import ingest


@pytest.mark.parametrize("separator", ["\n\n", "\n", "。", ". "])
def test_chunk_ends_at_a_boundary(separator):
    text = "x" * 790 + separator + "y" * 2000
    assert next(chunking.spans(text)) == (0, 790 + len(separator))
    assert next(chunking.spans("x" * 3000)) == (0, 800)


def test_chunks_cover_the_text(spark):
    texts = [None, "", "short", " ", "😀中 " * 2000, "x" * 9000, "Paragraph.\n\nNext sentence。\n" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").withColumn("pos", F.lit(1))
    found = {}
    for r in chunking.retrieval_chunks(docs).orderBy("document_id", "pos").collect():
        found.setdefault(r.document_id, []).append(r)
    assert set(found) == {2, 3, 4, 5, 6}
    for key, chunks in found.items():
        units = chunking.code_units(texts[key])
        assert chunks[0].start == 0 and chunks[-1].stop == len(units)
        assert all(chunking.code_units(c.text) == units[c.start : c.stop] for c in chunks)
        assert all(a.start < b.start <= a.stop for a, b in zip(chunks, chunks[1:]))
    assert chunking.retrieval_chunks(docs.limit(0)).count() == 0


def test_markdown_images(spark):
    text = "![a](x.png) `![b](y.png)`\n```\n![c](z.png)\n~~~\n```\n![d](../e.png) ![](f.webp)\n<IMG src=q>\n![bad] (x)\n~~~\n![g](h.png)"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, "plain")], "document_id long, text string")
    got = {(r.line, r.pos, r.caption, r.target, r.allowed) for r in markdown.images(docs).collect()}
    assert got == {(1, 0, "a", "x.png", True), (6, 0, "d", "../e.png", False), (6, 1, "", "f.webp", True)}
    assert {r.line for r in markdown.unsupported(docs).collect()} == {7, 8}


def test_catalogue_commits(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), "document_id string, revision string, text string")
    rows = lambda *r: spark.createDataFrame(list(r), store.schema)
    assert store.snapshot().count() == 0
    assert store.publish(rows(("a", "1", "x"), ("b", "1", "y")), 0) == 1
    with pytest.raises(Conflict):
        store.publish(rows(("a", "2", "z")), 0)
    assert store.publish(rows(("a", "2", "z"), ("b", "1", "y")), 1, batch="k") == 2
    assert store.publish(rows(("a", "2", "z")), 2, batch="k") == 2
    assert sorted(map(tuple, store.snapshot().collect())) == [("a", "2", "z"), ("b", "1", "y")]
    assert store.remove(rows(("a", "", "")), 2) == 3 and store.remove(rows(), 3) == 4
    assert [tuple(r) for r in store.snapshot().collect()] == [("b", "1", "y")]
    assert store.history().count() == 3
    assert sorted(map(tuple, store.snapshot(1).collect())) == [("a", "1", "x"), ("b", "1", "y")] and store.epoch() == 4
    for bad in ([("a", "7", "x"), ("a", "8", "x")], [(None, "7", "x")], [("a", None, "x")]):
        with pytest.raises(Conflict):
            store.publish(rows(*bad), 4)


def test_ingest_takes_each_file_once(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), ingest.SCHEMA)
    for k in range(2):
        spark.createDataFrame([(str(k), "line\n" * 25), (f"n{k}", None)], "document_id string, text string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
        ingest.ingest(stream, store, str(tmp_path / "state"))
    assert store.epoch() == 2
    assert store.snapshot().groupBy("document_id").count().orderBy("document_id").collect() == [("0", 2), ("1", 2), ("n0", 1), ("n1", 1)]
