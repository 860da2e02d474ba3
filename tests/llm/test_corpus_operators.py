import glob
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, components, decontaminate, exact_dedup, fuse_filter, language_id, near_dedup, packing, pii, repeated_spans, token_output, url_filter, warc
from lectern.llm.common import scratch_path

SCHEMA = "doc_id long, text string, n long, lang string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, an empty and a long text, ties and repeated rows, and clashing column names (n)."""
    base = prose(1, 80)
    rows = [(1, base, 1, "en"), (2, base, 1, None), (2, base, 1, None), (3, base.replace("alpha", "omega", 1), 1, "en"), (4, None, None, "en"), (5, "", 1, "en"), (None, "lonely text", 1, "en"),
            (6, prose(2, 9000), 1, "en"), (7, prose(3, 60) + " " + base[100:260] + " É", 1, "de"), (8, "Mail a.b@c.de, call +1 (555) 123-4567, card 4111 1111 1111 1111, at 10.0.0.256 or 1.2.3.4", 1, "en")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fuse_filter():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    built = fuse_filter.build(keys)
    others = np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert fuse_filter.contains(built, keys).all() and fuse_filter.contains(built, others).mean() < 0.01
    assert len(built) < 1.4 * len(keys) and fuse_filter.contains(fuse_filter.build(keys[:1]), keys[:1]).all() and fuse_filter.build(keys[:0])


def test_exact_dedup(docs, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(docs).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)} <= got
    assert exact_dedup.dedup(empty).count() == 0


def test_exact_dedup_against_an_empty_snapshot(docs, monkeypatch):
    """Buckets follow the batch where it is the larger side, and results do not depend on the cut."""
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 2)
    rows = exact_dedup.digests(docs)
    assert exact_dedup.snapshot(rows.limit(0), incoming=rows.count()).buckets == 5 and exact_dedup.snapshot(rows.limit(0)).buckets == 1
    want = by_id(exact_dedup.dedup(docs))
    assert by_id(exact_dedup.dedup(docs, cut=-1)) == by_id(exact_dedup.dedup(docs, cut=100)) == want


def test_exact_dedup_keeps(docs):
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.deduplicated(docs).collect()) == [0, 2, 2, 3, 5, 6, 7, 8]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 100_000), (2, None, "same"), (3, "http://b/", "same"), (4, "u", None), (None, "v", "é\r\n\r\nWARC/1.1"), (5, "w", "")], "page_id long, url string, html string")
    back = warc.resolved(warc.read(spark, warc.write(pages, scratch_path(spark, "w"), segment=7000)))
    got = {r["page_id"]: r for r in back.collect()}
    assert len(got) == 6 and got[3]["refers_to"] == 2 and got[3]["record_type"] == "revisit" and got[3]["payload_bytes"] == 4
    assert got[1]["payload_bytes"] == 100_000 and got[1]["payload_digest"] == warc.digest(b"x" * 100_000) and got[5]["refers_to"] == 4 and got[None]["record_type"] == "response"
    assert warc.dechunked(warc.chunked(b"a" * 20_000)) == b"a" * 20_000
    # multi-byte text cut inside a character, equal and near-equal rows, no page_id at all, another column
    long = "é日😀" * 5000
    rows = [(7, "u", long, 1), (7, "u", long, 2), (7, "v", long, 3), (8, "u", long, 4), (None, "u", long, 5), (None, "x", "same", 6), (None, "y", "same", 7), (9, None, None, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row long")
    folder = warc.write(pages, scratch_path(spark, "w"), segment=1001)
    back = warc.read(spark, folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in back if r["payload_digest"] == warc.digest(long.encode())) in (
        [(0, "revisit", 7), (7, "response", 0), (7, "response", 0), (7, "revisit", 7), (8, "revisit", 7)], [(0, "revisit", 7), (7, "response", 0), (7, "revisit", 7), (7, "revisit", 7), (8, "revisit", 7)])
    assert {r["payload"].decode() for r in back if r["page_id"] == 7 and r["payload"]} == {long} and sum(r["record_type"] == "response" for r in back if r["page_id"] is None) == 2
    raw = b"".join(gzip.open(f).read() for f in glob.glob(folder.removeprefix("file:") + "/part-*"))
    ids = set(re.findall(rb"WARC-Record-ID: (.*?)\r", raw))
    assert set(re.findall(rb"WARC-Refers-To: (.*?)\r", raw)) <= ids and len(back) == 8
    assert warc.read(spark, warc.write(pages.limit(0), scratch_path(spark, "w"))).count() == 0
    # files by bytes: filled with small records, and none beyond the bound
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).coalesce(1)
    folder = warc.write(many, scratch_path(spark, "w"), file_bytes=200_000)
    sizes = sorted(len(gzip.open(f).read()) for f in glob.glob(folder.removeprefix("file:") + "/part-*"))
    assert sizes[-1] <= 200_004 and sizes[1] > 195_000 and len(sizes) > 3
    assert sorted((r["page_id"], r["payload"].decode()) for r in warc.read(spark, folder).collect()) == [(i, f"page {i}") for i in range(3000)]


def test_packing(docs, empty):
    placed = packing.placed(packing.pack(docs.repartition(5))).collect()
    encoder = bpe.encoder(bpe.default_tokenizer())
    want = sum(len(x) // 4 + 1 for x in encoder.encode([r["text"] for r in docs.collect()]))
    spans = {}
    for r in placed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 1024
    assert sum(r["length"] for r in placed) == want and len(spans) <= -(-want // 1024) + 1
    assert packing.placed(packing.pack(empty)).count() == 0
    # short lengths over many partitions: nearly full sequences leave early, and no two that are left would fit together
    texts = docs.sparkSession.createDataFrame([(i, prose(i, 1 + i * 7 % 23), 1, "en") for i in range(200)], SCHEMA).repartition(16)
    used = sorted(r["used"] for r in packing.pack(texts, length=100).collect())
    assert used[0] + used[1] > 100 and sum(used) == sum(len(x) // 4 + 1 for x in encoder.encode([r["text"] for r in texts.collect()]))
    assert [len(packing.best_fit(s, 10)) for s in ([6, 4, 5, 5], [10], [3] * 10, [])] == [2, 1, 4, 0]


def test_encoder_agrees_with_the_library():
    encoder = bpe.encoder(bpe.default_tokenizer())
    texts = ["a  b", " a", "a ", "a \n b", "\n\n x", "", None, "it's 5's", "日本 語", "<|endoftext|> a b", "Ġ x", "a\x85 b", prose(5, 300)]
    assert list(encoder.encode(texts)) == [encoder.whole([t])[0] if t else b"" for t in texts]


def test_token_files(spark, docs, empty):
    got = token_output.read(spark, token_output.write(docs, scratch_path(spark, "t"))).collect()
    encoder = bpe.encoder(bpe.default_tokenizer())
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), list(np.frombuffer(encoder.whole([r["text"] or ""])[0], "<u4")) + [2]) for r in docs.collect())
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [k[1] if k[0] else None for k, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r["ids"] == ids
        at += len(ids)
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (token_output.decode(*token_output.encode(values), len(values)) == values).all()
    assert token_output.read(spark, token_output.write(empty, scratch_path(spark, "t"))).count() == 0
    # blocks bounded by tokens: a long document is one of its own, and the result is the same
    folder = token_output.write(docs, scratch_path(spark, "t"), block_tokens=700)
    again = token_output.read(spark, folder).collect()
    assert sorted(again, key=lambda r: r["start"]) == got
    sizes = [np.frombuffer(r["counts"], "<u4") for r in spark.read.parquet(f"{folder}/blocks").collect()]
    assert all(len(n) == 1 or n.sum() <= 700 for n in sizes) and any(len(n) == 1 and n[0] > 700 for n in sizes) and sum(map(len, sizes)) == len(got)


def test_url_filter(spark):
    urls = ["http://www.example.com/en/1", "https://x.Example.com/en/2?q=1", "ftp://y.net/es/", "nothing", None, "http://spam.org/buy/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://spam{i}.org/buy/{i}") for i in range(20)] + [(200 + i, f"http://good{i}.org/read/{i}") for i in range(20)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, True) for i in range(20)] + [(200 + i, False) for i in range(20)], "page_id long, blocked boolean")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels, url_filter.RULES).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(6)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "block")]
    assert got[1]["host"] == "x.example.com" and got[3]["host"] == got[4]["path"] == ""
    assert url_filter.judge(pages.limit(0), labels.limit(0), url_filter.RULES).count() == 0


def test_language_id(spark, docs, empty):
    draw, rows = random.Random(1), []
    for i in range(400):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join("".join(draw.choice("abcd" if lang == "xx" else "wxyz") for _ in range(5)) for _ in range(20)), 1, lang))
    data = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(data)
    got = language_id.predict(data, model).where(language_id.held_out()).collect()
    assert len(got) > 50 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    odd = language_id.predict(spark.createDataFrame([(1, None, 1, "xx"), (2, "123 !", 1, None)], SCHEMA), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in odd] == [("und", 0.0)] * 2
    assert language_id.fit(empty) is None and language_id.predict(docs, None).count() == docs.count()


def components_of(links, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_dedup(spark, docs, empty, rounds, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", rounds)
    draw, rows = random.Random(4), [(0, None, 1, ""), (1, "", 1, "")]
    for base in range(4):
        words = prose(base + 10, 120).split()
        for k in range(6):
            own = words[:]
            for _ in range(k * 2):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(999)}"
            rows.append((len(rows), " ".join(own), 1, ""))
    data = spark.createDataFrame(rows, SCHEMA)
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t, *_ in rows if (w := (t or "").split())}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(links, range(len(rows)))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(data, width=2).collect()}
    assert links and all(got[i]["component_id"] == want[i] and got[i]["n_shingles"] == len(sets.get(i, ())) for i in want)
    if rounds:
        again = near_dedup.near_duplicates(docs, width=2)
        assert again.count() == docs.count() and {r["component_id"] for r in again.where("doc_id in (1, 2, 3)").collect()} == {1}
        assert near_dedup.near_duplicates(empty).count() == 0


def test_workers_forget_other_operators(spark):
    """What an operator's tasks remember is gone when a task of another one begins in their worker, and stays for its own."""

    class Tasks:
        select = lambda self, *_: self
        join = unionByName = distinct = select
        mapInArrow = lambda self, run, _: run

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], ["doc_id", "text"])
    for made in (lambda: near_dedup.features(Tasks(), 2), lambda: near_dedup.full_sets(Tasks(), Tasks(), 2, False)):
        encoder = bpe.encoder(bpe.default_tokenizer())
        encoder.encode(["some words of a text"])
        assert bpe.encoder(bpe.default_tokenizer()) is encoder and not near_dedup._hashes
        for _ in range(2):
            assert len(list(made()(iter([batch])))) == 1
            assert not bpe._encoders and len(near_dedup._hashes) == 5
    assert bpe.encoder(bpe.default_tokenizer()).encode(["some words of a text"]) == encoder.encode(["some words of a text"])
    assert not near_dedup._hashes


def test_packing_by_small_slices(docs):
    rows = lambda df: sorted((str(r["doc_id"]), *tuple(r)[1:5], r["offset"]) for r in packing.placed(df).collect())
    assert rows(packing.pack(docs, 64, together=100)) == rows(packing.pack(docs, 64))


def test_packing_by_small_slices_looks_up_and_remembers_less(spark, monkeypatch):
    """With an eighth of the slices' bytes a task holds an eighth of the looked up bytes and remembered words, and gives the same ids."""

    class Found(Exception):
        pass

    class Docs:
        sparkSession = None
        select = lambda self, *_: self

        def mapInArrow(self, run, _):
            raise Found(run)

    held, encoded = [], bpe.WordEncoder.encoded
    monkeypatch.setattr(bpe.WordEncoder, "encoded", lambda self, slices: held.append(sum(len(t or "") for s in slices for t in s.to_pylist())) or encoded(self, slices))
    for name, most in (("TOGETHER", 8000), ("LOOKED_UP", 32_000), ("PIECES", 800), ("REMEMBERED", 800), ("HEADS", 800)):
        monkeypatch.setattr(bpe, name, most)
    with pytest.raises(Found) as found:
        packing.pack(Docs(), together=1000)
    (first,) = found.value.args
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(676)]
    texts = [None, *(f"{letters[i]}{i} " + " ".join(f"{x}{letters[i]}, {x}{i}" for x in letters[i % 60 :: 60]) for i in range(600))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    bpe._encoders.clear()
    members = [m for made in first(iter([batch])) for b in made.to_pylist() for m in b["members"]]
    (encoder,) = bpe._encoders.values()
    bpe._encoders.clear()
    assert len(held) > 10 and max(held) <= 5000
    assert max(len(encoder.spaced.texts), len(encoder.leading.texts)) <= 100
    # a lookup's new words come on top
    assert max(len(encoder.known), len(encoder.before), len(encoder.heads)) <= 100 + 500
    assert sorted((m["doc_id"], m["ids_crc32"]) for m in members) == [(i, zlib.crc32(ids + np.array([2], "<u4").tobytes())) for i, ids in enumerate(encoder.whole([t or "" for t in texts]))]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == got[300] == 100


@pytest.mark.parametrize("hot, bits", [(0, 64), (256, 64), (0, 2), (256, 2)])
def test_repeated_spans(spark, docs, empty, monkeypatch, hot, bits):
    """Against brute force; a line with varying neighbours, a text of one character, and runs whose first ranks meet by chance too."""
    monkeypatch.setattr(repeated_spans, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeated_spans, "PIECE_BYTES", 3000)
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    line = "all rights are reserved by whoever wrote these lines first, and by no one else"
    more = [(20 + i, f"{prose(50 + i, 8)} {line}{' ' if i % 2 else ''}{prose(70 + i, 9)}", 1, "en") for i in range(12)]
    more += [(40, "a" * 400, 1, "en"), (41, "b" + "a" * 300 + "c", 1, "en"), (42, "ab" * 90, 1, "en"), (43, "xab" * 3 + "ab" * 60, 1, "en"), (43, "\u00e9" * 60, 1, "en"), (43, "\u00e9" * 70, 1, "en")]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    rows = sorted([(r["doc_id"] if r["doc_id"] is not None else 1 << 70, (r["text"] or "").encode()) for r in docs.collect()])
    seen, want = {}, []
    for k, b in rows:
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(k, seen.get(b[i : i + 50], k))
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        want.append((k if k < 1 << 70 else None, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [(*r[:5], bytes(r[5])) for r in repeated_spans.repeated_spans(docs, bits=bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert repeated_spans.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("bound", [0, 8 << 20])
def test_decontaminate(spark, docs, empty, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    text = docs.where("doc_id = 1").first()["text"]
    items = spark.createDataFrame([(1, " ".join(text.split()[5:17])), (1, " ".join(text.split()[5:17])), (2, "LONELY, text!"), (3, None), (None, "alpha1"), (4, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[None]["items"], got[4]["n_words"], got[6]["n_hit"]) == (12, ["1"], ["2"], 0, 0)
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == docs.count()
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}.isdisjoint({1, 2, None})


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.detect(docs).select("doc_id", *[F.transform(k, lambda x: x["value"]).alias(k) for k in pii.KINDS]).collect()}
    assert (got[8]["email"], got[8]["ip"], got[8]["card"], got[8]["phone"]) == (["a.b@c.de"], ["1.2.3.4"], ["4111 1111 1111 1111"], ["+1 (555) 123-4567"])
    assert got[4]["email"] == [] and pii.detect(empty).count() == 0


def test_pii_adds_what_the_base_patterns_miss(spark):
    """A few spelled-out addresses, local phone numbers and cards in other notations among many look-alikes and base spans."""
    pad = "lorem ipsum dolor sit amet consectetur "
    planted = [f"{pad}write to jane.doe{i} [at] host{i} [dot] com today" for i in range(3)] + [f"{pad}or to joe{i}(at)mail.example.org" for i in range(3)]
    planted += [f"{pad}please call 030 1234 56{i}7 soon" for i in range(3)] + [f"{pad}Tel. (0555) 123-45{i}7 ok" for i in range(3)] + [f"{pad}paid by 4111.1111.1111.1111 then" for _ in range(2)]
    values = [f"jane.doe{i} [at] host{i} [dot] com" for i in range(3)] + [f"joe{i}(at)mail.example.org" for i in range(3)] + [f"030 1234 56{i}7" for i in range(3)] + [f"0555) 123-45{i}7" for i in range(3)] + ["4111.1111.1111.1111"] * 2
    others = [f"{pad}order 030 1234 5{i:03} shipped, see (at) 10.{i % 60:02}" for i in range(400)] + [f"{pad}recall 2019-2020, call 2024-01-{i % 28 + 1:02}, paid 4111.1111.1111.{1000 + i % 100 * 10 + 2}" for i in range(100)]
    base = [f"{pad}me{i}@example.org or +49 30 123 45{i:03}, 4111 1111 1111 1111, 10.0.0.{i % 255}" for i in range(200)]
    rows = [(i, x) for i, x in enumerate(planted + others + base)]
    got = {r["doc_id"]: r["more"] or [] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = ["email"] * 6 + ["phone"] * 6 + ["card"] * 2
    for i, (kind, value) in enumerate(zip(kinds, values, strict=True)):
        start = planted[i].index(value)
        assert [tuple(m) for m in got[i]] == [(kind, start, start + len(value))], planted[i]
    luhn_by_chance = {i for i, x in rows if "paid 4111." in x and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(x[-19:].replace(".", "")))) % 10 == 0}
    assert {i for i, m in got.items() if m and i >= len(planted)} <= luhn_by_chance
    # the same without look-alikes, where all candidates have evidence
    alone = {r["doc_id"]: len(r["more"] or []) for r in pii.detect(spark.createDataFrame(rows[:14], "doc_id long, text string")).collect()}
    assert alone == dict.fromkeys(range(14), 1)


def test_url_filter_mines_rules_of_any_size_digits_and_age(spark):
    def verdicts(labelled, asked):
        urls = [u for u, _ in labelled] + asked
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(labelled)], "page_id long, blocked boolean")
        got = {r["page_id"]: r for r in url_filter.judge(pages, labels, []).collect()}
        return [got[len(labelled) + i] for i in range(len(asked))]

    # blocked only where all five tokens meet: any four of them are as often good
    five = ["aa", "bb", "cc", "dd", "ee"]
    url = lambda t: "http://{}.{}.{}/{}?{}=1".format(*t)
    four = [five[:i] + ["zz"] + five[i + 1 :] for i in range(5)]
    got = verdicts([(url(five), True)] * 20 + [(url(f), False) for f in four for _ in range(20)], [url(five).replace("=1", "=2"), url(four[0]).replace("=1", "=2")])
    assert [r["verdict"] for r in got] == ["block", "allow"] and got[0]["confidence"] == 1.0 and len(got[0]["mined_rule"].split()) == 5
    # hosts that differ by a number only
    got = verdicts([(f"http://spam{1 + i % 2}.org/read/{i}", i % 2 == 0) for i in range(40)], ["http://spam1.org/read/x", "http://spam2.org/read/x"])
    assert [(r["verdict"], r["mined_rule"]) for r in got] == [("block", "host:spam1"), ("allow", None)]
    # a host of 12 labelled pages stays a rule as the table grows
    got = verdicts([(f"http://rare.org/read/{i}", True) for i in range(12)] + [(f"http://good.org/read/{i}", False) for i in range(4000)], ["http://rare.org/read/x", "http://good.org/read/x"])
    assert [(r["verdict"], r["mined_rule"]) for r in got] == [("block", "host:rare"), ("allow", None)]


def test_url_filter_drops_only_rules_that_a_part_of_them_covers(spark):
    rows = [(1, ["a"], 0.9), (2, ["a", "b"], 0.9), (3, ["a", "c"], 0.95), (4, ["b", "d"], 0.8), (5, ["a", "b", "d"], 0.85)]
    rules = spark.createDataFrame(rows, "rule_id long, antecedent array<string>, confidence double")
    assert {r["rule_id"] for r in url_filter.needed_only(rules).collect()} == {1, 3, 4}


def test_near_duplicates_of_other_percents(spark):
    """Pairs from 0.7 to 0.75 with sizes a fifth to three tenths apart or equal: all are found at 70, none at 80."""
    rows, near = [], []
    for i in range(120):
        words = [f"w{i}x{k}" for k in range(200)]
        cut = 200 - 51 - i % 5  # a part of 145 to 149 words
        swap = words[: 200 - 30 - i % 3] + [f"v{i}x{k}" for k in range(30 + i % 3)]  # as long, 0.73 or more
        near.append(swap if i % 2 else words[:cut])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near[-1]))]
        whole = set(words)
        assert 0.7 <= len(whole & set(near[-1])) / len(whole | set(near[-1])) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, kept in ((70, 120), (80, 240)):
        assert near_dedup.near_duplicates(docs, width=1, percent=percent).where("kept").count() == kept
    for percent in (49, 101):
        with pytest.raises(ValueError):
            near_dedup.near_duplicates(docs, percent=percent)
    assert (near_dedup.band_rows(80), near_dedup.least_estimate(80)) == (5, 0.65)


def test_url_filter_equal_tokens_are_one_item(spark):
    """Forty equal query keys (2^40 subsets) on twelve blocked pages, and on good ones with another key each; keys are mixed, so FP-growth sees them."""
    keys = "&".join(f"k{i}=1" for i in range(40))
    rows = [(i, f"http://shop.org/list?{keys}&sale=1", True) for i in range(12)] + [(100 + i, f"http://shop.org/list?{keys}", False) for i in range(30)]
    rows += [(200 + i, f"http://good.org/a?sale={i}", False) for i in range(30)] + [(300, f"http://new.org/?{keys}&sale=2", None), (301, "http://new.org/?k3=1&sale=2", None), (302, "http://new.org/?sale=2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    labels = pages.where("blocked is not null").select("page_id", "blocked")
    got = {r["page_id"]: r for r in url_filter.judge(pages.drop("blocked"), labels, []).collect()}
    assert all((got[k]["verdict"] == "block") == bool(b) for k, _, b in rows if k < 300)
    assert got[300]["verdict"] == "block" and got[300]["confidence"] == 1.0 and "query:sale" in got[300]["mined_rule"]
    assert got[301]["verdict"] == "block" and set(got[301]["mined_rule"].split()) == {"query:k3", "query:sale"} and got[302]["verdict"] == "allow"
    # however many other pages are labelled, twelve pages are enough
    more = spark.range(1000, 60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 997, F.lit(".com/p"), "id").alias("url"))
    every = pages.drop("blocked").unionByName(more)
    again = url_filter.judge(every, labels.unionByName(more.select("page_id", F.lit(False).alias("blocked"))), [])
    assert {r["page_id"] for r in again.where("verdict = 'block'").collect()} == {*range(12), 300, 301}


def test_representatives_of_many_blocks_with_few_runs_are_not_dealt_by_string(spark, monkeypatch):
    """300 blocks have one run each of a phrase: such runs are opened after the exchange, not sent as strings; many runs are."""
    monkeypatch.setattr(repeated_spans, "BLOCK_BYTES", 100)
    seen, met_before = [], repeated_spans.met_before
    monkeypatch.setattr(repeated_spans, "met_before", lambda sent, length: (seen.append(sent.groupBy("hot").count().collect()), met_before(sent, length))[1])
    texts = [f"{k:05d}" * 6 + "the same phrase of forty bytes, no more!" + f"{k * 7:05d}" * 6 for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (None, 100):
        if hot:
            monkeypatch.setattr(repeated_spans, "HOT", hot)
        assert {r["n_removed"] for r in repeated_spans.repeated_spans(docs, texts=False).collect()} == {0}
    sent = [{r["hot"]: r["count"] for r in rows} for rows in seen]
    assert sent[0][False] >= 300 and True not in sent[0] and sent[1][True] >= 300
