import math
import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import fusion, lexical, structure


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tokenize_is_order_sensitive(spark):
    df = spark.createDataFrame([("任务abc",), ("abc任务",), ("Hello, W_1 É",), (None,)], "t string")
    got = [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()]
    assert got == [["任", "务", "任务", "abc"], ["abc任务"], ["hello", "w_1", "é"], None]


def test_utf16_length_and_escapes(spark):
    df = spark.createDataFrame([("😀中",)], "t string")
    assert rows(df.select(T.utf16_length(F.col("t")), T.escape_html(F.lit("<a&'\">")))) == [(3, "&lt;a&amp;&#39;&quot;&gt;")]


def test_cosine(spark):
    df = spark.createDataFrame([([1e200, 0.0], [1e200, 1e200]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and got[1] is None


def test_bm25_against_plain_python(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "element_id long, text string")
    tokens = lexical.tokenized(df)
    index = lexical.Index(lexical.postings(tokens), lexical.corpus_stats(tokens))
    got = dict(rows(lexical.bm25(index, spark.createDataFrame([(0, "fox red fox")], "query_id long, text string")).select("element_id", "score")))
    toks = {k: re.findall(r"\w+", v) for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for k, t in toks.items():
        for term in {"fox", "red"}:
            df_ = sum(term in x for x in toks.values())
            if tf := t.count(term):
                want[k] = want.get(k, 0) + math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hint_takes_the_only_slot(spark):
    ranked = spark.createDataFrame([(7, 1)], "element_id long, rank int")
    hints = spark.createDataFrame([(9, 2)], "element_id long, score int")
    assert rows(fusion.reserve_hints(ranked, hints, 1)) == [(9, 1, True)]


def test_line_elements_and_gaps(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(41)))), (2, None)], "document_id long, text string")
    got = rows(structure.line_elements(df).select("document_id", "pos", "start", "stop").orderBy("document_id", "pos"))
    assert got == [(1, 0, 1, 20), (1, 1, 21, 40), (1, 2, 41, 41), (2, 0, 1, 1)]
    turns = spark.createDataFrame([(1, 0), (1, 1), (1, 3)], "c long, t int")
    assert [r["t"] for r in structure.gaps(turns, "c", "t", F.col("t") + 1).collect()] == [3]


def test_entry_points_import():
    import __spark_entry__ as e

    assert len(e.queries()) > 80 and set(e.oracle_sql()) <= set(e.queries())
