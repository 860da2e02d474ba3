"""Streams that stop and go on, bounded provider calls, live jobs."""

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lectern.operators import embedding
from lectern.operators.embedding import BadReply, Lengths, Space
from lectern.sources.catalogue_store import CatalogueStore, Conflict
from lectern.sources.window_store import OverBudget, WindowStore
from lectern.streaming import indexing, ingest, job_state

SPACE = Space("local", "lengths", "1", 17, document_instruction="d: ")


def logged(folder, bad=None):
    """A provider that notes each text that it embeds, and fails on one; made here so that workers need no test module."""
    own = Lengths(SPACE)

    def provider(texts):
        if bad in texts:
            raise RuntimeError("provider is down")
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.writelines(f"{len(texts)} {t}\n" for t in texts)
        return own(texts)

    return provider


def embedded_texts(folder):
    return sorted(line.rstrip("\n").split(" ", 1)[1] for name in os.listdir(folder) for line in open(f"{folder}/{name}"))


def test_index_goes_on_where_it_stopped(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "c"), ingest.SCHEMA)
    log = tmp_path / "log"
    log.mkdir()
    rows = lambda d, r, n: spark.createDataFrame([(d, r, k, 0, 0, f"{d}{r} {k}" if k != 2 else None) for k in range(n)], ingest.SCHEMA)
    for k, (d, r, n) in enumerate([("a", "1", 9), ("b", "1", 4), ("c", "1", 6), ("d", "1", 0)]):
        store.publish(rows(d, r, n), k)
    index = lambda bad=None: indexing.VectorIndex(store, str(tmp_path / "i"), SPACE, logged(str(log), bad))
    with pytest.raises(StreamingQueryException, match="provider is down"):
        index("d: c1 4").run(str(tmp_path / "cursor"))
    assert index().vectors().count() == 13 and {r["document_id"]: r["state"] for r in index().progress().collect()} == {"a": "ready", "b": "ready", "c": "parsed"}
    index().run(str(tmp_path / "cursor"))
    # what was committed before the failure is not computed again; a batch of the failed micro-batch may be
    done = [t for t in embedded_texts(log) if t != "d: " and not t.startswith("d: c")]
    assert len(done) == len({*done}) == 8 + 3
    assert {r["state"] for r in index().progress().collect()} == {"ready"} and index().vectors().count() == 19
    before = len(embedded_texts(log))
    # a removal, the same revision again, and a new one
    epoch = store.remove(rows("b", "1", 1), store.epoch())
    epoch = store.publish(rows("a", "1", 9).unionByName(rows("b", "2", 1)), epoch)
    index().run(str(tmp_path / "cursor"))
    assert len(embedded_texts(log)) == before + 1
    got = {(r["document_id"], r["revision"]): r["n"] for r in index().vectors().groupBy("document_id", "revision").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "1"): 9, ("b", "1"): 4, ("b", "2"): 1, ("c", "1"): 6}
    # a micro-batch that is committed again leaves the same rows
    pointers = spark.read.schema("document_id string, revision string, part string, batch string, epoch bigint").parquet(f"{store.root}/active").where("document_id = 'c'")
    index().commit(pointers, 2, "index")
    assert index().vectors().count() == 20


def test_half_written_epochs_are_not_read(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path), "document_id string, revision string, text string")
    rows = spark.createDataFrame([("a", "1", "x")], store.schema)
    store.publish(rows, 0)
    spark.createDataFrame([("a", None, None, None)], "document_id string, revision string, part string, batch string").write.parquet(f"{tmp_path}/active/epoch=2")
    os.remove(f"{tmp_path}/active/epoch=2/_SUCCESS")
    assert store.epoch() == 1 and store.snapshot().count() == 1
    # another writer has the claim
    files, path = store._path("claims/2")
    files.createNewFile(path)
    with pytest.raises(Conflict):
        store.publish(rows, 1)
    with pytest.raises(Conflict):
        store.abandon(1)
    store.abandon(2)
    assert store.publish(rows, 1) == 2 and store.snapshot().count() == 1 and store.touch(2) == 3


def reply(vectors, model="lengths", index=None):
    return lambda texts: {"model": model, "data": [{"index": k, "embedding": v} for k, v in zip(index or range(len(vectors)), vectors)]}


GOOD = [1.0] + [0.0] * 16


@pytest.mark.parametrize(("provider", "why"), [
    (reply([GOOD], model="other"), "model identity"), (lambda t: {"model": "lengths"}, "missing embedding data"), (reply([GOOD]), "count mismatch"), (reply([GOOD, GOOD], index=[1, 2]), "indices"),
    (reply([GOOD, GOOD[:3]]), "dimension 3"), (reply([GOOD, [float("nan")] * 17]), "not finite"), (reply([GOOD, [0.0] * 17]), "zeros"), (reply([GOOD, ["x"] * 17]), "not finite"),
])
def test_wrong_replies_fail_the_task(spark, provider, why, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").coalesce(1)
    with pytest.raises(Exception, match=why):
        embedding.embedded(rows, SPACE, provider).write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out" / "_SUCCESS")
    with pytest.raises(BadReply, match=why):
        embedding.called(provider, SPACE, ["a", "b"])


def test_calls_are_bounded(spark):
    assert list(embedding.filled(["x"] * 70)) == [(0, 32), (32, 64), (64, 70)]
    assert list(embedding.filled(["x" * 20_000, "y" * 12_768, "z"])) == [(0, 2), (2, 3)] and list(embedding.filled([])) == []
    assert embedding.units("a😀") == 3
    with pytest.raises(ValueError, match="beyond"):
        list(embedding.filled(["😀" * 16_385]))
    rows = spark.createDataFrame([(k, "word " * (k % 5) if k % 7 else None, "x") for k in range(100)], "id long, text string, vector string").drop("vector")
    got = {r["id"]: r["vector"] for r in embedding.embedded(rows, SPACE, Lengths(SPACE)).collect()}
    assert len(got) == 100 and all(v[4] == (k % 5 if k % 7 else 0) and v[1] == 1 and v[16] == 1 for k, v in got.items())
    batches = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id long, texts array<string>")
    assert [len(r["vectors"]) for r in embedding.embedded_batches(batches, SPACE, Lengths(SPACE)).orderBy("id").collect()] == [2, 0, 0]
    assert embedding.embedded(rows.limit(0), SPACE, Lengths(SPACE)).count() == 0


LOG = "job_id string, seq long, at long, kind string, value string"
SECOND = 1_000_000


def test_job_rules(spark, tmp_path):
    events = [
        ("a", 1, 0, "claim", "w1"), ("a", 2, 10 * SECOND, "claim", "w2"), ("a", 3, 50 * SECOND, "result", "w1"), ("a", 4, 100 * SECOND, "result", "w1"), ("a", 5, 170 * SECOND, "result", "w1"),
        ("b", 1, 0, "claim", "w1"), ("b", 2, 1, "pause", None), ("b", 3, 2, "result", "w1"), ("b", 4, 3, "claim", "w1"), ("b", 5, 4, "result", "w1"), ("b", 6, 5, "cancel", None), ("b", 7, 6, "claim", "w1"),
        ("c", 1, 0, "state", "parsed"), ("c", 2, 1, "state", "parsing"), ("c", 3, 2, "state", "parsed"), ("c", 4, 3, "state", "indexing"), ("c", 5, 4, "state", "ready"), ("c", 6, 5, "pause", None), ("c", 7, None, "other", None),
    ]
    found = None
    for part in range(2):  # two runs; the state goes on
        half = [e for e in events if (e[1] > 3) == part]
        spark.createDataFrame(half, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        found = job_state.run(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["job_id"], r["seq"]): (r["accepted"], r["why"]) for r in found.where("seq is not null").collect()}
    refused = {("a", 2): "leased", ("a", 5): "late", ("b", 3): "paused", ("b", 7): "cancelled", ("c", 1): "not the next state", ("c", 6): "ready", ("c", 7): "unknown kind"}
    assert {k: v[1] for k, v in got.items() if not v[0]} == refused and len(got) == len(events)
    assert {(r["job_id"], r["state"], r["since"]) for r in job_state.current(found).collect()} == {("a", None, -1), ("b", None, -1), ("c", "ready", 5)}


def test_lease_ends_without_an_event(spark, tmp_path):
    now = int(time.time() * SECOND)
    spark.createDataFrame([("a", 1, now, "claim", "w1")], LOG).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    stream = job_state.start(log, str(tmp_path / "out"), str(tmp_path / "state"), lease=2)
    found = spark.createDataFrame([], job_state.CHANGES)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(tmp_path / "out" / "_spark_metadata"):
                found = spark.read.schema(job_state.CHANGES).parquet(str(tmp_path / "out"))
                if found.where("kind = 'expired'").count():
                    break
    finally:
        stream.stop()
    assert [r["kind"] for r in found.collect()].count("expired") == 1


def test_equal_bytes_start_one_job_across_restarts(spark, tmp_path):
    jobs = None
    for k, own in enumerate([["x", "y", None], ["x", "", "z"], ["z", "y"]]):
        rows = spark.createDataFrame([(c,) for c in own], "content string").withColumn("arrived", F.timestamp_seconds(F.lit(1000 + k)))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sources = spark.readStream.schema("content string, arrived timestamp").parquet(str(tmp_path / "in"))
        jobs = ingest.start_jobs(sources, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["bytes"] for r in jobs.collect()) == [0, 1, 1, 1] and jobs.select("job_id").distinct().count() == 4


def test_windows(spark, tmp_path):
    store = WindowStore(spark, str(tmp_path))
    assert store.read().count() == 0
    pages = lambda *r: spark.createDataFrame(list(r), "book_id string, page long, text string")
    own = ingest.windows(pages(*[("a", p, f"page {p} " * 200) for p in range(1, 8)], ("b", 1, "short"), ("b", 2, None), ("b", 3, "")))
    for _ in range(2):
        store.save(own, "0")
    got = {(r["book_id"], r["window_no"]): r["elements"] for r in store.read().collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)} and [e["pos"] for e in got["a", 0]] == list(range(len(got["a", 0])))
    assert {e["page"] for e in got["a", 1]} == {6, 7} and [(e["page"], e["text"]) for e in got["b", 0]] == [(1, "short")]
    with pytest.raises(Conflict, match="stored already"):
        store.save(own.where("book_id = 'b'"), "1")
    with pytest.raises(Conflict, match="comes twice"):
        store.save(own.unionByName(own), "0")
    with pytest.raises(Conflict, match="beyond a record"):
        store.save(spark.range(1).select(F.lit("c").alias("book_id"), F.lit(0).alias("window_no"), F.array(F.struct(F.lit(0).alias("pos"), F.lit(1).alias("page"), F.repeat(F.lit("x"), 3 << 20).alias("text"))).alias("elements")), "2")
    with pytest.raises(OverBudget, match="book a"):
        store.read(budget=1000)
    assert store.read(["b"], budget=1000).count() == 1
    # a payload that was changed
    rows = spark.read.parquet(store.path).withColumn("payload", F.replace("payload", F.lit("short"), F.lit("other")))
    changed = WindowStore(spark, str(tmp_path / "changed"))
    rows.write.partitionBy("commit").parquet(changed.path)
    assert changed.read(["a"]).count() == 2
    with pytest.raises(Exception, match="checksum mismatch: b"):
        changed.read().collect()


def test_book_windows_of_a_book_beyond_the_budget(spark, tmp_path, monkeypatch):
    """The query reads all windows of a book that is larger than what a reader of whole books may hold."""
    import __spark_entry__
    from lectern.sources import window_store

    monkeypatch.setattr(window_store.WindowStore.read, "__defaults__", (None, 5000))
    docs = [(k, "word " * 400, "long" if k else "short") for k in range(12)] + [(12, None, "long"), (13, "x", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["book_windows"](spark, str(tmp_path)).collect()
    assert sorted((r["book_id"], r["window_no"], r["first_page"], r["last_page"]) for r in found) == [("long", 0, 2, 5), ("long", 1, 6, 10), ("long", 2, 11, 12), ("short", 0, 1, 1)]
    assert all(r["elements"] >= 2 * (r["last_page"] - r["first_page"] + 1) for r in found)
