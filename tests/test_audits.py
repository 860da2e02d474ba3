"""Blobs as files, verdicts, evidence against its snapshot, projections, telemetry."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions.projection import without
from lectern.operators import answers, rules, telemetry
from lectern.sources import blob_files, markdown, packages
from lectern.sources.catalogue_store import Conflict

sha = lambda b: hashlib.sha256(b).hexdigest()


def test_blob_files(spark, tmp_path):
    root = tmp_path / "blobs"
    names = {"good": b"good", "bad": b"other", "large": b"x" * 100, "extra": b"extra"}
    (root / "deep" / "er").mkdir(parents=True)
    for k, (name, content) in enumerate(names.items()):
        own = sha(b"bad" if name == "bad" else content)
        folder = root / "deep" / "er" if k % 2 else root
        (folder / (f"{own}.png" if k % 2 else own)).write_bytes(content)
    (root / "notes.txt").write_bytes(b"no hash")
    wanted = spark.createDataFrame([(sha(x),) for x in (b"good", b"bad", b"x" * 100, b"gone", b"good")] + [(None,)], "hash string")
    got = {r["hash"]: (r["size"], r["state"]) for r in blob_files.audit(spark, str(root), wanted, 50).collect()}
    assert got == {sha(b"good"): (4, "ok"), sha(b"bad"): (5, "corrupt"), sha(b"x" * 100): (100, "too_large"), sha(b"extra"): (5, "unreferenced"), sha(b"gone"): (None, "missing")}
    # sizes come before contents: the filter is the source's
    plan = blob_files.files(spark, str(root)).where("length <= 50")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)" in plan
    assert [bytes(r["content"]) for r in blob_files.get(spark, str(root), wanted.where(F.col("hash") == sha(b"good"))).collect()] == [b"good"]
    with pytest.raises(Exception, match="blob integrity mismatch"):
        blob_files.get(spark, str(root), wanted).collect()
    assert {r["state"] for r in blob_files.audit(spark, str(tmp_path / "none"), wanted).collect()} == {"missing"}
    rows = spark.createDataFrame([(sha("é\na\n".encode()), "é\na"), (sha(b"\n"), "")], "hash string, text string")
    blob_files.put_texts(rows, str(tmp_path / "texts"))
    assert {r["state"] for r in blob_files.audit(spark, str(tmp_path / "texts"), rows).collect()} == {"ok"}
    assert os.path.isdir(tmp_path / "texts")


def test_verdict(spark):
    violations = spark.createDataFrame([("a", f"k{i:03}") for i in range(150)] + [("b", "x"), ("b", None)], "code string, key string")
    none, some = spark.createDataFrame([], "v int"), spark.createDataFrame([(1,)], "v int")
    got = {r["code"]: r for r in rules.verdict(violations, none).collect()}
    assert (got["a"]["n"], len(got["a"]["examples"]), got["a"]["examples"][-1], got["a"]["verdict"]) == (150, 100, "k099", "failed") and got["b"]["n"] == 2
    for vectors, unverified, want in ((none, None, "passed"), (some, None, "incomplete"), (none, some, "incomplete"), (none, none, "passed")):
        assert [tuple(r) for r in rules.verdict(violations.limit(0), vectors, unverified).collect()] == [(None, 0, None, want)]


def test_stale_evidence_counts_code_units(spark):
    whole = "😀 alpha beta"
    texts = [("ok", "d", "1", "e", 3, 8, "alpha"), ("points", "d", "1", "e", 2, 7, "alpha"), ("pair", "d", "1", "e", 0, 2, "😀"), ("null", "d", "1", "e", None, 8, "alpha"), ("gone", "x", "1", "e", 3, 8, "alpha"), ("old", "d", "0", "e", 3, 8, "alpha")]
    rows = spark.createDataFrame([(*t, sha(t[6].encode())) for t in texts], "id string, document_id string, revision string, element_id string, start int, stop int, text string, text_hash string")
    figures = spark.createDataFrame([("f", "d", "1", "i", "h"), ("g", "d", "1", "j", "h"), ("h", "d", "1", "i", None)], "id string, document_id string, revision string, image_id string, blob_hash string")
    documents, elements, images = (spark.createDataFrame(*a) for a in (([("d", "1")], "document_id string, revision string"), ([("d", "e", whole)], "document_id string, element_id string, text string"), ([("d", "i", "h")], "document_id string, image_id string, blob_hash string")))
    got = {tuple(r) for r in rules.stale_evidence(rows, figures, documents, elements, images).collect()}
    assert got == {("text_place", "points"), ("text_place", "null"), ("text_revision", "gone"), ("text_place", "gone"), ("text_revision", "old"), ("figure_image", "g"), ("figure_image", "h")}
    bundle = rows.select(F.lit("b").alias("bundle_id"), "id", "element_id", "text", "text_hash", "start", "stop")
    blocks = spark.createDataFrame([], "bundle_id string, block int, kind string, occurrence_id string, evidence_ids array<string>")
    found = rules.evidence_rules(bundle.where("id in ('ok', 'points', 'pair')"), elements, blocks, spark.createDataFrame([], "bundle_id string, id string"))
    assert {tuple(r) for r in found.where("code = 'excerpt'").collect()} == {("excerpt", "points")}


def test_markdown_targets_are_decoded(spark):
    targets = ["img/a.png", "img/%2e%2e/%2e%2e/x.png", "a%2Fb%20c.webp", "%2Fetc/x.png", "x%2Epng", "%zz.png", "a.png?x", "../x.png", "b.txt"]
    docs = spark.createDataFrame([(1, " ".join(f"![c]({t})" for t in targets))], "document_id long, text string")
    got = {r["target"]: r["allowed"] for r in markdown.images(docs).collect()}
    assert [t for t in targets if got[t]] == ["img/a.png", "a%2Fb%20c.webp", "x%2Epng"]


def test_projection_walks_the_schema(spark):
    kind = "id string, a struct<id:string,b:array<struct<id:int,c:int>>>, m map<string,struct<id:int,d:array<array<struct<id:int,e:int>>>>>, only struct<id:int>, `x.y` int"
    rows = spark.createDataFrame([("1", ("s", [(1, 2), None]), {"k": (1, [[(1, 2)], None])}, (1,), 5), (None, None, None, None, None)], kind)
    out = without(rows, "id")
    assert out.schema.simpleString() == "struct<a:struct<b:array<struct<c:int>>>,m:map<string,struct<d:array<array<struct<e:int>>>>>,only:boolean,x.y:int>"
    first, second = out.orderBy(F.col("`x.y`").desc()).collect()
    assert first["a"]["b"] == [(2,), None] and first["m"]["k"]["d"] == [[(2,)], None] and first["only"] and first["x.y"] == 5
    assert second["a"] is None and second["m"] is None and second["only"] is False
    assert without(rows, "none").schema == rows.schema


def test_telemetry_and_empty_answers(spark):
    rows, seen = telemetry.measured(spark.range(10), "ten", high=F.max("id"))
    assert rows.count() == 10 and (seen["rows"], seen["high"]) == (10, 9) and seen["seconds"] > 0
    (one,) = answers.empty(spark.createDataFrame([(1, None)], "question_id int, question string")).collect()
    assert one["bundle_id"] is None and one["reasons"] == ["no-candidates"] and one["figures"] == []


def test_packages(spark, tmp_path):
    blocks = [("p1", k, "figure" if k % 2 else "paragraph", f"<b> {k} é", f"f{k}", "s1" if k < 2 else "s2") for k in range(5)] + [("p2", 0, "paragraph", None, "f0", "s3"), ("p2", 0, "paragraph", None, "f0", "s3")]
    rows = spark.createDataFrame(blocks, "bundle string, ord int, kind string, text string, id string, source_id string")
    sources = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s2", "two")], "source_id string, label string")
    root = str(tmp_path / "out")
    packages.write(rows, sources, root)
    first = {tuple(r) for r in packages.read(spark, root).collect()}
    names = {"document.md", "document.html", "evidence.json", "sources.json", "manifest.json"}
    assert {(b, f) for b, f, *_ in first} == {("p1", f) for f in names} | {("p2", f) for f in names - {"sources.json"}} and packages.broken(spark, root).count() == 0
    packages.write(rows.where("bundle = 'p1'"), sources, root)
    assert {tuple(r) for r in packages.read(spark, root).collect()} == first
    (page,) = glob.glob(f"{root}/bundle=p1/file=document.md/part-*")
    assert open(page).read().startswith("&#60;b&#62; 0 é\n\n![")
    with open(page, "a") as f:
        f.write("more")
    os.remove(glob.glob(f"{root}/bundle=p1/file=document.md/.part-*.crc")[0])
    os.remove(glob.glob(f"{root}/bundle=p2/file=document.html/part-*")[0])
    assert {tuple(r) for r in packages.broken(spark, root).collect()} == {("p1", "document.md", "changed"), ("p2", "document.html", "missing")}
    many = spark.range(packages.BLOCKS + 1).select(F.lit("p").alias("bundle"), F.col("id").alias("ord"), F.lit("paragraph").alias("kind"), F.lit("x").alias("text"), F.lit("f").alias("id"), F.lit("s1").alias("source_id"))
    for bad in (many, rows.withColumn("bundle", F.lit("../x")), rows.withColumn("bundle", F.lit(None).cast("string"))):
        with pytest.raises(Conflict):
            packages.write(bad, sources, root)


def test_parsed_answers(spark):
    good = {"wireVersion": "1", "status": "answered", "requirements": [{"id": "r", "requirement": "x", "status": "supported", "evidenceIds": ["a"]}], "figures": [], "paragraphs": [{"text": "t é", "evidenceIds": ["a"], "requirementIds": ["r"]}]}
    of = lambda *docs: spark.createDataFrame(list(enumerate(docs)), "answer_id int, json string")
    (row,) = answers.parsed(of(json.dumps(good))).collect()
    assert row["answer"]["paragraphs"][0]["text"] == "t é" and row["answer"]["requirements"][0]["evidenceIds"] == ["a"] and row["answer"]["figures"] == []
    extra = good | {"more": 1}
    nested = good | {"paragraphs": [good["paragraphs"][0] | {"more": 1}]}
    less = good | {"requirements": [{"id": "r"}]}
    for doc, why in ((json.dumps(extra), "unexpected or missing"), (json.dumps(nested), "unexpected or missing"), (json.dumps(less), "unexpected or missing"), ("{", "MALFORMED|Malformed"), (None, "no document"), (json.dumps(good) + " " * (512 << 10), "beyond its bytes"), (json.dumps(good | {"figures": None}), "unexpected or missing")):
        with pytest.raises(Exception, match=why):
            answers.parsed(of(json.dumps(good), doc)).collect()
    assert answers.parsed(of(json.dumps(good)).limit(0)).count() == 0


def test_packages_that_lie_there_are_not_written_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{k}", 0, "paragraph", "x", "f", "s") for k in range(3)], "bundle string, ord int, kind string, text string, id string, source_id string")
    sources, root = spark.createDataFrame([("s", "one")], "source_id string, label string"), str(tmp_path / "out")
    packages.write(rows, sources, root)
    parts = sorted(glob.glob(f"{root}/bundle=*/file=*/part-*"))
    packages.write(rows, sources, root)
    assert len(parts) == 15 and sorted(glob.glob(f"{root}/bundle=*/file=*/part-*")) == parts
