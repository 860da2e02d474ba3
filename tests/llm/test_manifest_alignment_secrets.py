"""Operators 11 to 13 against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import alignment, merkle, secrets
from lectern.llm.common import stored


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def merkle_rows(docs):
    """By plain recursion: one tuple a row."""

    def leaf(row, text):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])

    def tree(level):
        """The root, and for each leaf the runs on its way as (siblings left, right)."""
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(at):
                run = level[p // 8 * 8 : p // 8 * 8 + 8]
                ways[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at = [p // 8 for p in at]
            level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
        return level[0], ways

    def fold(digest, way):
        for left, right in way:
            digest = sha(left, digest, right)
        return digest

    by_lang = collections.defaultdict(list)
    for r in docs:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    below = {n: tree([x[2] for x in sorted(by_lang[n], key=lambda x: x[:3])]) for n in names}
    root, above = tree([below[n][0] for n in names])
    out = []
    for n, way in zip(names, above):
        for (_, _, digest, r), own in zip(sorted(by_lang[n], key=lambda x: x[:3]), below[n][1]):
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = fold(leaf(r, lowered(r[1])) if bad else digest, own + way)
            out.append((r[0], digest, below[n][0], root, sha(*[a + b for a, b in own + way]), folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows, tmp_path):
    # columns with the names of the operator's own
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, pos long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_merkle_manifest(spark, tmp_path):
    draw = random.Random(13)
    rows = [(k, f"Text {k} É", draw.choice(["en", "de", "é", "z"]), draw.choice([None, "web"]), k * 7) for k in range(700)]
    rows += [(i, "Alone", f"l{i:02}", "s", None) for i in range(70)]  # more languages than one run has
    rows += [(None, "No id", "en", None, 1), (None, None, None, None, None), (5, "Tie", "en", "s", 1), (5, "Tie", "en", "s", 1), (6, "", None, "s", 0), (9, "Ab" * 40_000, None, "s", 0)]
    got = manifest(spark, rows, tmp_path)
    assert got == merkle_rows(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_merkle_sizes(spark, n, tmp_path):
    rows = [(k, "T", "en", "s", 1) for k in range(n)]
    got = manifest(spark, rows, tmp_path)
    assert got == (merkle_rows(rows) if n else [])
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


TEXTS = [
    "The quick brown fox.", "naïve café — 東京 😀😀", "  two spaces", "ends with space ", "\ttabs\n\nand lines", "a▁b", "<|endoftext|> <s> </s> <unk>", "", None, " ", "x" * 300, "1234567890" * 30, "deadbeef" * 50,
    "don't can't won't", "ﬁ ligature", " nbsp", "Á combining", "\u0000 zero", "repeat repeat repeat repeat", "repeat repeat repeat repeat", "unwahrscheinlichkeitstheoretisch " * 5, "日本語のテキスト" * 20,
]


def alignment_rows(texts):
    a_path, b_path = alignment.default_vocabularies()
    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    vocabulary = {i: t for t, i in a_model.get_vocab().items()}
    a_bytes = lambda i: bytes(back[c] for c in vocabulary[i])
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        raw = f" {text}".encode()
        a = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append(([], [], []))
            continue
        places = [[0], [0]]
        for ids, size, at in ((a, a_bytes, places[0]), (b, b_bytes, places[1])):
            for i in ids:
                at.append(at[-1] + len(size(i)))
        cuts = sorted(set(places[0]) & set(places[1]))
        inside = lambda ids, at, s, e: [i for i, x, y in zip(ids, at, at[1:]) if s <= x and y <= e]
        docs.append((a, b, [(inside(a, places[0], s, e), inside(b, places[1], s, e)) for s, e in zip(cuts, cuts[1:])]))
    linked = [collections.Counter((x, y) for own_a, own_b in groups for x in own_a for y in own_b) for _, _, groups in docs]
    count = collections.Counter(p for own_pairs in linked for p in own_pairs)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (a, b, groups), pairs in zip(docs, linked):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in pairs.items() if count[p] == most[p[0]])
        out.append((len(a), len(b), len(groups), sum(pairs.values()), best, sum(n * count[p] for p, n in pairs.items()), sha(text) if groups else ""))
    return out


@pytest.mark.parametrize(("block", "wide"), [(8 << 20, 4096), (40, 2)])
def test_alignment(spark, block, wide, monkeypatch):
    """One block and many, and groups counted by ids; the workers get the bounds with the function."""
    draw = random.Random(12)
    words = ["alpha", "Beta's", "gämma", "x9z", "日本", "ﬂow", "end.", "\n", "co-op", "ABCdef"]
    texts = TEXTS + [" ".join(draw.choice(words) for _ in range(draw.randrange(40))) for _ in range(60)]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, block long").repartition(3)
    if block == 40:
        # small bounds, in this process, on the parts that make them matter
        monkeypatch.setattr(alignment, "WIDE", wide)
        shared = alignment.aligner(alignment.default_vocabularies())
        import pyarrow as pa

        column = pa.array(texts, pa.string())
        a, b = shared.tokens(shared.encoded(column), 0, len(texts))
        groups = alignment.grouped(a, b)
        doc, pair, times = alignment.links(a, b, groups)
        got = collections.Counter()
        for d, p, n in zip(doc.tolist(), pair.tolist(), times.tolist()):
            got[d, p] += n
        monkeypatch.setattr(alignment, "WIDE", 1 << 40)
        doc, pair, times = alignment.links(a, b, groups)
        assert got == collections.Counter(zip(doc.tolist(), pair.tolist()))
        slices = list(alignment.batches_of(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), column], ["a", "b"])]), block))
        assert len(slices) > 10 and [x for s in slices for x in s.column(1).to_pylist()] == texts
        return
    got = alignment.alignment(docs).collect()
    want = alignment_rows(texts)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r["doc_id"]), *[r[c] for c in order]) for r in got) == sorted((str(k if k % 9 else None), *w) for k, w in enumerate(want))
    assert sum(r["n_groups"] > 0 for r in got) > 60 and sum(r["n_links"] > r["n_a"] for r in got) > 20
    assert alignment.alignment(docs.limit(0)).count() == 0


def test_alignment_overlaps(spark):
    docs = spark.createDataFrame([(1, "unwahrscheinlich, naïve 😀"), (2, None), (3, "The end.")], "doc_id long, text string")
    rows = alignment.overlaps(docs).collect()
    for key, text in ((1, " unwahrscheinlich, naïve 😀"), (3, " The end.")):
        own = sorted((r["start"], r["stop"]) for r in rows if r["doc_id"] == key)
        # what two tokens have in common covers the text without gaps
        assert own[0][0] == 0 and own[-1][1] == len(text.encode()) and all(x[1] == y[0] for x, y in zip(own, own[1:]))
        assert [r["grp"] for r in rows if r["doc_id"] == key] == sorted(r["grp"] for r in rows if r["doc_id"] == key)
    assert {r["doc_id"] for r in rows} == {1, 3}


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_rows(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_base_columns(spark):
    draw = random.Random(11)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abcdef", "x", "12345", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef0123", "é", "😀", "\n", ".", "-"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 16))) for _ in range(3000)] + [None, ""]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = secrets.detect(docs).collect()
    kinds = len(secrets.KINDS) - 1
    have = sorted((str(r["doc_id"]), str([(s["start"], s["kind"], s["stop"]) for s in r["spans"] if s["kind"] < kinds])) for r in got)
    assert have == sorted((str(k if k % 7 else None), str(base_rows(t or ""))) for k, t in enumerate(texts))
    assert all(sum(any(s["kind"] == k for s in r["spans"]) for r in got) > 20 for k in range(kinds))
    # what is added overlaps no base span
    for r in got:
        base = [s for s in r["spans"] if s["kind"] < kinds]
        assert all(s["stop"] <= b["start"] or b["stop"] <= s["start"] for s in r["spans"] if s["kind"] == kinds for b in base)


def test_secret_query_columns(spark, tmp_path):
    """The query's own columns: spans of one kind at any place among the others, several of a kind, none."""
    assign, access, code = 'Token: "abc.def"', "AKIA" + "Z9" * 10, "0123456789abcdef" * 2
    texts = [assign, access, code, f"{assign} {assign}", f"{code} {access} {assign}", f"é {access}, {access}; {code} {code} {code} {assign}", "token=short AKIA 0123", "", None]
    draw = random.Random(5)
    texts += [" ".join(draw.choice([assign, access, code, "ſecret: 123456", "word", "😀"]) for _ in range(draw.randrange(9))) for _ in range(200)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in secrets.op11_secrets(spark, str(tmp_path)).collect())
    want = []
    for k, t in enumerate(texts):
        base = base_rows(t or "")
        joined = ",".join(f"{secrets.KINDS[kind]}:{start}:{stop}" for start, kind, stop in base)
        want.append((k, *(sum(kind == x for _, kind, _ in base) for x in range(3)), sha(joined)))
    assert got == want


def test_secret_models(spark, tmp_path):
    """Planted keys of an alphabet that no pattern knows are found by the model, long words and identifiers are not."""
    draw = random.Random(7)
    syllables = "ver schei nung keit ten lich get ele ment by class name data frame read er opt ion in ter nat al iz ing user _ index value".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(2, 9)))
    secret = lambda: base64.b64encode(draw.randbytes(24)).decode()
    rows, planted = [], {}
    for k in range(1500):
        text = " ".join(word() for _ in range(60))
        if k % 4 == 0:
            text += f" token = \"{draw.randbytes(20).hex()}\""
        if k % 10 == 3:
            planted[k] = secret()
            text = f"É {text} use {planted[k]} now"
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["spans"] for r in secrets.op11_secrets(spark, str(tmp_path)).collect()}
    caught = 0
    for k, text in rows:
        added = [tuple(map(int, s.split(":")[1:])) for s in found[k].split(",") if s.startswith("random:")]
        if k in planted:
            caught += any(planted[k].startswith(text[a:b]) and b > a for a, b in added)
        else:
            assert not added
    assert caught >= 0.95 * len(planted)
    scanned = stored(secrets.scan(docs), "scanned")
    ratio = secrets.fit(scanned)
    _, precision, recall = secrets.quality(scanned, ratio)
    assert precision >= secrets.PRECISION and recall > 0.95
    # the same model whatever the partitions
    assert abs(ratio - secrets.fit(stored(secrets.scan(docs.repartition(7)), "again"))).max() == 0
    # the score of one value, by the definition
    value = planted[3].rstrip("=")
    places = [0, 0, *[secrets.ALPHABET.index(c) + 1 for c in value]]
    each = [ratio[(a * secrets.SIZE + b) * secrets.SIZE + c] for a, b, c in zip(places, places[1:], places[2:])]
    assert abs(secrets.scores([value], ratio)[0] - sum(each) / len(each)) < 1e-9


def test_secrets_without_labels(spark):
    none = spark.createDataFrame([(1, "wJalrXUtnFEMIK7MDENGbPxRfiCY"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in secrets.detect(none).orderBy("doc_id").collect()] == [[], []]
    assert secrets.detect(none.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "ab12 " * 400_000 + "token: " + "f" * 50_000)], "doc_id long, text string")
    assert [s["kind"] for s in secrets.detect(long).select(F.explode("spans").alias("s")).select("s.kind").collect()] == [0, 2]


def test_pairs_are_never_broadcast(spark):
    """Pairs lie in lists, whose number of entries Spark doesn't know: even few of them are joined by sorting."""
    docs = spark.createDataFrame([(k, f"the cat {k} sat on the mat") for k in range(20)], "doc_id long, text string")
    found = alignment.alignment(docs)
    assert len(found.collect()) == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
