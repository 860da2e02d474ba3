"""Queries held against plain Python on random and planted rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bpe, decontaminate, packing, pii, url_filter

#: The base patterns as the contract has them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out[kind].append((m.start(), m.end()))
    return out


def test_pii_base_columns(spark):
    draw = random.Random(11)
    parts = ["a.b@c.de", "x@y", "@", "..", "1.2.3.4", "300.1.1.1", "0001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (555) 123-4567", "+49", "++12 34 5", "(030) 123.45-67", " ", ", ",
             "-", ".", "\n", "é", "😀", "\u0001", "\u0002", "日本", "7", "12", "word", "jane [at] host [dot] org", "2024-01-02", "(at)", "+1234567890123456"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(3000)] + [None, "", "a@b.c", "a@b.c"]
    rows = [(i // 2 if i % 50 == 1 else i, t, i) for i, t in enumerate(texts)] + [(None, "m@n.op", 0)]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string, row long"))
    got = found.collect()
    want = sorted((str(k), str(base_spans(t or ""))) for k, t, _ in rows)
    assert sorted((str(r["doc_id"]), str({k: [(x["start"], x["stop"]) for x in r[k]] for k in BASE})) for r in got) == want
    assert sum(len(r["card"]) for r in got) > 50 and sum(len(r["ip"]) for r in got) > 50
    digest = found.where("doc_id = 7").select(pii.joined_spans(False).alias("s")).first()["s"]
    assert digest == ",".join(f"{k}:{a}:{b}" for k, own in base_spans(texts[7]).items() for a, b in own)


def test_pii_is_linear(spark):
    """A table of 100,000 numbers and one of 20,000 addresses and phone numbers; minutes, where work would grow with the square."""
    numbers = ", ".join(str(i * 7919 % 10**6) for i in range(100_000))
    people = "; ".join(f"p{i}@host.org +49 30 {100000 + i}" for i in range(20_000))
    got = pii.detect(spark.createDataFrame([(1, numbers), (2, people)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in got}
    assert len(got[2]["email"]) == len(got[2]["phone"]) == 20_000 and not got[1]["email"]
    last = got[2]["email"][-1]
    assert people[last["start"] : last["stop"]] == "p19999@host.org"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("bound", [0, 8 << 20])
def test_decontamination(spark, bound, monkeypatch):
    """Few different words, so that windows overlap and repeat; items of one word and of several windows; repeated documents."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    draw = random.Random(5)
    words = lambda n: draw.choice([" ", ", ", "--"]).join(draw.choice(["a", "B", "c", "É", "\u212a", "d"]) for _ in range(n))
    items = [(i, words(draw.choice([2, 4, 5, 9, 10, 12]))) for i in range(40)] + [(100, "lone"), (101, ""), (102, None), (None, "a b c"), (3, "a b c d")]
    docs = [(i, words(draw.randrange(60)), "x") for i in range(150)] + [(200, "a LONE wolf", "x"), (201, None, "x"), (202, "", None), (None, "lone", "x"), (5, "a b c d e f", "x"), (5, "a b c d e f", "x")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for k, t, _ in docs:
        own, hit, ids = WORD.findall(lowered(t)), set(), set()
        for item, text in items:
            w = WORD.findall(lowered(text))
            for g in ({tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w and item is not None else ()):
                for i in range(len(own) - len(g) + 1):
                    if tuple(own[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        ids.add(str(item))
        want.append((k, len(own), len(hit), sorted(ids)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got)
    assert sum(1 for w in want if w[2]) > 50


def test_packed_pieces_hold_the_library_s_ids(spark):
    """doc_id, piece, start, length and ids_crc32 of every piece, rebuilt from the library's ids; several later rounds."""
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["alpha", "beta", "é日", "x  y", "12,5", "\n"]) for _ in range(draw.choice([0, 3, 50, 400, 2500]))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", packing.F.lit("clash")).repartition(24)
    got = packing.placed(packing.pack(docs)).collect()
    tokenizer, want = bpe.encoder(bpe.default_tokenizer()).tokenizer, {}
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, piece] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    # five documents a partition: at most 2 % and one more than best fit over all pieces at once needs
    assert len(bins) <= 1.02 * len(packing.best_fit([n for _, n, _ in want.values()], 1024)) + 1


def test_url_verdicts(spark):
    """Host, path and the longest list rule in plain Python; mined rules by counting every combination of tokens."""
    draw = random.Random(3)
    hosts = ["www.Example.com", "example.com", "a.b.net", "NET", "x.org", "com", "examplecom", "b.example.com", ""]
    urls = [f"{draw.choice(['http', 'ftp', ''])}{draw.choice(['://', '://', ':'])}{draw.choice(hosts)}{draw.choice(['', '/', '/en/', '/en', '/es/a', '/fr/b/c', '/EN/'])}{draw.choice(['', '?q=1', '#en/', '?a://b/'])}" for _ in range(600)] + [None, "", "x" * 100_000 + "://y.net/es/"]
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls)] + [(5, urls[5], "n")], "page_id long, url string, host string")
    labels = url_filter.listed_labels(pages, url_filter.RULES)
    got = url_filter.judge(pages, labels, url_filter.RULES).collect()

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def listed(host, path):
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    assert len(got) == len(urls) + 1
    for r in got:
        host, path = parts(urls[r["page_id"]])
        rule, verdict = listed(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if r["mined_rule"] else "allow"))
    mined = {r["mined_rule"]: r["confidence"] for r in got if r["mined_rule"]}
    tokens = {r["page_id"]: {*r["t"]} for r in pages.select("page_id", url_filter.url_tokens(*url_filter.host_and_path(), url_filter.F.col("url")).alias("t")).collect()}
    blocked = {r["page_id"]: r["blocked"] for r in labels.collect()}
    rows = [(tokens[i], blocked[i]) for i in [*range(len(urls)), 5] if i in blocked]
    for rule, confidence in mined.items():
        held = [b for t, b in rows if {*rule.split(" ")} <= t]
        assert held and abs(sum(held) / len(held) - confidence) < 1e-9 and confidence >= url_filter.MIN_CONFIDENCE
    # of the single tokens that reach the confidence often enough, none is overlooked
    for token in {t for own, _ in rows for t in own}:
        held = [b for t, b in rows if token in t]
        if sum(held) >= url_filter.MIN_PAGES and sum(held) / len(held) >= url_filter.MIN_CONFIDENCE:
            assert all(r["verdict"] == "block" for r in got if token in tokens[r["page_id"]] and r["rule"] is None)


def test_language_decisions(spark, monkeypatch):
    """Scores and decisions recomputed with numpy from the fitted weights; texts longer than what is hashed together."""
    import numpy as np

    from lectern.llm import language_id

    draw, rows = random.Random(8), []
    for i in range(300):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append((i, " ".join("".join(draw.choice({"xx": "abcd", "yy": "wxyz", "zz": "klmn"}[lang]) for _ in range(5)) for _ in range(draw.randrange(1, 30))), lang))
    rows += [(900, "", "xx"), (901, None, "xx"), (902, "12 !", None), (903, "abcd", None), (None, "wxyz wxyz", "yy"), (904, "ABCD é 日本", "xx"), (905, "abcd " * 700, None)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    monkeypatch.setattr(language_id, "TOGETHER", 1000)
    got = {r["doc_id"]: r for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    monkeypatch.setattr(language_id, "TOGETHER", 1 << 20)
    for key, text, _ in rows:
        found = [g for g in language_id.grams(text or "")]
        if not found:
            assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
            continue
        features = np.concatenate(found)
        logits = (model["weights"][features].sum(0, dtype=np.float64) / len(features) + model["bias"]) / model["temperature"]
        p = np.exp(logits - logits.max())
        assert got[key]["lang_pred"] == model["classes"][int(p.argmax())] and abs(got[key]["score"] - p.max() / p.sum()) < 1e-6
    assert np.mean([got[k]["lang_pred"] == lang for k, t, lang in rows[:300]]) > 0.95


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Planted copies, near copies, benchmark passages and letterless rows; each stage against plain Python on what the stage before kept."""
    import corpus_pipeline

    draw = random.Random(21)
    vocabulary = {"xx": [f"ba{a}{b}do" for a in "aeiou" for b in "klmnp"], "yy": [f"z{a}w{b}x" for a in "aeiou" for b in "qrstv"]}
    prose = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) + draw.choice(vocabulary[lang]) for _ in range(n))
    texts = [(prose(lang, draw.randrange(60, 200)), lang) for lang in ("xx", "yy") * 60]
    texts += [texts[3], texts[3], texts[10], (None, "xx"), ("", None), ("12 34 !", "yy"), ("12 34 !", "yy")]
    for k in (5, 6, 7):
        words = texts[k][0].split()
        words[len(words) // 2] = "changed"
        texts.append((" ".join(words), texts[k][1]))
    passage = prose("xx", 14)
    texts += [(prose("xx", 40) + " " + passage + " " + prose("xx", 30), "xx"), (prose("yy", 50) + ", " + passage.upper(), "yy")]
    rows = [(i, t, lang, "web", len(t or ""), "own") for i, (t, lang) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _predicted string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "nothing of the kind is to be found in here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if number < 5 else {}
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{number}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        seen.append((before, after))
        if number < 4:
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    (all_, known), (_, single), (_, apart), (_, clean), (_, packed) = seen
    assert known == {i for i, t in all_.items() if t and any(c.isalpha() for c in t)}
    assert single == {max(i for i in known if all_[i] == all_[k]) for k in known}

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = {i: shingles(all_[i]) for i in single}, {i: i for i in single}
    for _ in range(3):
        for a in single:
            for b in single:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert apart == {i for i in single if root[i] == i} and len(apart) < len(single)
    flat = lambda t: " ".join(WORD.findall(lowered(t)))
    items = [flat(passage).split(), "nothing of the kind is to be found in here at all".split()]
    windows = [" ".join(w[i : i + 10]) for w in items for i in range(len(w) - 9)]
    assert clean == {i for i in apart if not any(f" {w} " in f" {flat(all_[i])} " for w in windows)} and len(clean) == len(apart) - 2
    assert packed == clean
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == clean
    tokenizer = bpe.encoder(bpe.default_tokenizer()).tokenizer
    assert sum(r["length"] for r in final.collect()) == sum(len(tokenizer.encode(all_[i], add_special_tokens=False).ids) + 1 for i in clean)


def test_secrets(spark):
    """Assigned and issued keys among long words, numbers and mixed runs without a clue."""
    texts = [f'mine is password={i:04x}7aa4a5fcc78305 ok' for i in range(20)] + [f'a token = "{i:04x}641917ea4e9feb9cda83477b57" b' for i in range(20)] + [f"key AKIAMD62HKU6VBLCC{i:03d} c" for i in range(20)]
    others = [f"order x{i:04}abcdefghijklm1 shipped" for i in range(60)] + ["donaudampfschifffahrtsgesellschaft", "1234567890123456789012", None, "", "password=short1", "user1234567890123456@host.org"]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")).select("doc_id", pii.secrets().alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in found}
    for i, text in enumerate(texts):
        value = max(re.findall("[A-Za-z0-9]+", text), key=len)
        assert got[i] == [f"secret:{text.index(value)}:{text.index(value) + len(value)}"], text
    assert not any(got[i] for i in range(len(texts), len(texts + others)))


def test_encoder_agrees_with_the_library_on_odd_texts():
    """Runs of white space of every kind, signs, added tokens and letters of several scripts."""
    draw = random.Random(1)
    parts = ["a", "b", "É", " ", " ", "  ", "\n", "\t", "\u00a0", "\x85", "\x1c", "1", "23", ".", ",", "'s", "'", "日", "\u3000", "<|endoftext|>", "\u0120", "\u200b", "é", "😀"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(8000)]
    encoder = bpe.encoder(bpe.default_tokenizer())
    assert encoder.encode(texts) == encoder.whole(texts)


def test_encoder_agrees_with_the_library_on_lines_and_signs(monkeypatch):
    """Words with signs and ends of lines, letters beside the ranges of common ones, many slices, and pieces that are forgotten."""
    monkeypatch.setattr(bpe, "PIECES", 50)
    draw = random.Random(2)
    letters = ["a", "b", "th", "É", "ß", "ñ", "\u00aa", "\u00b5", "\u00d7", "\u00f7", "\u01c0", "\u024f", "\u0250", "e\u0301"]
    word = lambda: "".join(draw.choice(letters[: draw.choice([3, 6, 14])]) for _ in range(draw.randrange(1, 5)))
    parts = [word, word, word, word, lambda: " ", lambda: " ", lambda: " ", lambda: "\n", lambda: draw.choice(".,;:!?"), lambda: draw.choice(["...", "'s", "\t", "7", "-", "\r\n", "\n\n", "<|endoftext|>"])]
    encoder = bpe.WordEncoder(bpe.default_tokenizer())
    for _ in range(20):
        texts = ["".join(draw.choice(parts)() for _ in range(draw.randrange(40))) for _ in range(300)]
        want = encoder.whole(texts)
        assert encoder.encode(texts) == want
        assert max(len(encoder.spaced.texts), len(encoder.leading.texts)) <= 50
        batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
        monkeypatch.setattr(bpe, "LOOKED_UP", draw.choice([1, 2000, 1 << 20]))
        found = [x[:-1].tobytes() for _, ids, ends in bpe.documents(encoder, iter([batch]), draw.choice([1, 500, 1 << 20])) for x in np.split(ids, ends)[:-1]]
        assert found == want


def test_encoder_knows_words_with_signs_and_beside_ends_of_lines():
    """What the library is given of a text whose words are known, with other signs and lines."""
    given = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

    draw = random.Random(3)
    words = ["".join(draw.choice("aeioubdgklmnrst") for _ in range(8)) for _ in range(2000)]
    encoder = bpe.WordEncoder(bpe.default_tokenizer())
    encoder.encode(["a " + " ".join(words) + ".", "a\n" + "\n".join(words) + ".\na"])
    encoder.tokenizer, encoder.pieces, whole = Counted(encoder.tokenizer), Counted(encoder.pieces), encoder.tokenizer
    text = "a " + "".join(f"{a}{draw.choice(['', ',', '.', ';'])}{draw.choice('  \n')}{b}! " for a, b in zip(words, words[1:])) + "a"
    assert encoder.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(map(len, given)) < 100, sum(map(len, given))
