"""Operator 9: personal data by candidate gradient boosting, in DataFrame functions and Spark's own boosted trees.

Four base patterns (email, ip, card, phone) with their checks always count. Beside them, generators with high recall
propose spans that may overlap: digit groups in any notation, addresses with spelled-out signs, and the base patterns'
failing matches, and long runs of mixed letters and digits as secrets (a kind without a base pattern, reported beside
the others). Boosted trees, one model a kind, score each candidate from its format and the words before it. Base
spans are positives; so is a candidate beside them that has evidence of its own (``evidence``): an address that is valid
once its signs are written out, a card number by Luhn's check in card notation or after a clue word, 8 to 15 digits after
a clue word that are no date, four numbers to 255 after a clue word, a mixed run that is assigned to a word such as
password or token, or has the form of an issued key. Candidates that cut a base span are not learnt from.
A model learns on at most about ``TRAINING_CANDIDATES`` candidates (a documented bound, drawn by hash, in equal parts of
base spans, candidates with evidence and candidates without, which weigh the same). The redaction threshold of a kind is
the lowest score whose precision is at least ``PRECISION`` over all its candidates that overlap no base span, those
learnt from included; all of these at or above it are added.

Spans are start and end in code points, end exclusive. Matching is linear in the text, a few passes a pattern; texts
without the characters that a pattern needs are skipped. What overlaps is found by running maxima over a document's
spans in order, so a document with very many of them costs a sort.

Defined results: null and empty texts have no span; repeated rows get a result each; to a kind of which no candidate
beside the base spans has evidence nothing is added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty

TRAINING_CANDIDATES = 20_000
PRECISION = 0.98
#: Code points before a candidate, and not before the match that precedes it, that count as its context.
CONTEXT = 24
#: Put before each match to find its place; stands for no sign of a pattern. Texts that have it already get another control sign there.
MARK, OTHER = "\u0001", "\u0002"
KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the trees may add.
ADDED = (*KINDS, "secret")

# The patterns are those of the contract, written so that they never go back: a run of characters is entered at its
# start only (or where the last match ended) and taken whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDED = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
GENERATORS = {
    "digits": r"(?<![0-9])[0-9]++(?:[\x20()./-]{1,2}[0-9]++)++|(?<![0-9])[0-9]{7,}+",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?:\x20?\[at\]\x20?|\x20?\(at\)\x20?)[A-Za-z0-9-]++(?:(?:\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\.)[A-Za-z0-9-]++)++",
}
GENERATORS["secret"] = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+"
GENERATOR_NEEDS = {"secret": r"[A-Za-z][0-9]|[0-9][A-Za-z]", "digits": r"[0-9]{7}|[0-9][\x20()./-]{1,2}[0-9]", "spelled": r"[\[(]at[\])]"}
CLUES = {"call": "phone", "tel": "phone", "mail": "email", "card": "card", "visa": "card", "server": "ip", "host": "ip"}
#: Clue words as whole words, in the languages of the corpus.
CLUE_WORDS = {
    "phone": r"call|tel|telephone|phone|mobile|cell|fax|dial|sms|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|t[eé]l|handy|mobil|m[oó]vil|portable|ruf|anruf|llama|appelez",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta",
    "ip": r"server|host|ip|address|serveur|servidor|adresse",
    "secret": r"password|passwd|pwd|token|secret|key|apikey|auth|bearer|passwort|kennwort|clave|contrase[nñ]a",
}
#: What stands between such a word and the secret, and forms of issued keys.
ASSIGNED, ISSUED = r"\s{0,2}[=:]\s{0,2}[\"']?$", r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{20,})$"
DATE = r"^(?:(?:19|20)[0-9]{2}[ ./-]{1,2}[0-9]{1,2}[ ./-]{1,2}[0-9]{1,2}|[0-9]{1,2}[ ./-]{1,2}[0-9]{1,2}[ ./-]{1,2}(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ ./-]{1,2}(?:19|20)[0-9]{2})$"

def spans(text: Column, pattern: str, needed: str) -> Column:
    """Leftmost non-overlapping matches: their places, what stands before them and the sign after them."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = F.split(text, pattern, -1)
    signs = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0"), "")
    marks = F.filter(F.transform(signs, lambda c, i: F.when(c == MARK, i)), lambda i: i.isNotNull())
    start = F.transform(marks, lambda place, i: place - i)  # less the marks before it
    # the lambdas see their own element only, so that nothing is computed again for each
    each = F.arrays_zip(value.alias("value"), start.alias("start"), gap.alias("gap"), F.concat(F.array(F.lit("")), value).alias("former"), F.slice(gap, 2, F.size(gap)).alias("next"))
    found = F.transform(
        F.filter(each, lambda x: x["value"].isNotNull()),
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value"),
            F.lower(F.right(F.concat(x["former"], x["gap"]), F.lit(CONTEXT))).alias("context"), F.substring(x["next"], 1, 1).alias("after"),
        ),
    )
    return F.when(text.rlike(needed), found).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string,context:string,after:string>>"))


def luhn(digits: Column) -> Column:
    def step(s: Column, d: Column) -> Column:
        doubled = d.cast("int") * F.when(s["odd"], F.lit(2)).otherwise(F.lit(1))
        return F.struct((s["sum"] + doubled - F.when(doubled > 9, F.lit(9)).otherwise(F.lit(0))).alias("sum"), (~s["odd"]).alias("odd"))

    places = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda s: s["sum"] % 10 == 0)


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def scan(documents: DataFrame) -> DataFrame:
    """row, doc_id, text_key, and by kind the base spans; ``candidates``: all that was proposed, with its context."""
    text = F.col("t")
    own = documents.select("doc_id", text_or_empty().alias("t"))
    raw = own.select("doc_id", "t", *[spans(text, PATTERNS[k], NEEDED[k]).alias(f"raw_{k}") for k in KINDS], *[spans(text, GENERATORS[g], GENERATOR_NEEDS[g]).alias(g) for g in GENERATORS])

    def checked(kind: str) -> Column:
        return F.filter(F.col(f"raw_{kind}"), lambda x: holds(kind, x["value"]))

    def proposed(source: str, name: str) -> Column:
        return F.transform(F.col(source), lambda x: F.struct(F.lit(name).alias("source"), *[x[c].alias(c) for c in ("start", "stop", "value", "context", "after")]))

    every = F.concat(*[proposed(f"raw_{k}", k) for k in KINDS], *[proposed(g, g) for g in GENERATORS])
    base = [F.transform(checked(k), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "stop", "value")])).alias(k) for k in KINDS]
    return raw.select(F.monotonically_increasing_id().alias("row"), "doc_id", *base, F.filter(every, lambda c: F.length(c["value"]) >= 6).alias("candidates"))


FEATURES = [
    "length", "digits", "groups", "longest", "dots", "dashes", "spaces", "plus", "paren", "at", "luhn_ok", "small_parts", "glued_before", "glued_after", *[f"clue_{c}" for c in CLUES],
    "letters", "capitals", "turns", "assigned", "issued", "address", "date", "card_notation", *[f"word_{k}" for k in CLUE_WORDS],
]


def address(value: Column) -> Column:
    """Whether ``value``, its signs written out, is a mail address under a top-level name of letters."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")
    return plain.rlike(r"^[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+$")


def evidence(kind: Column, f: dict[str, Column]) -> Column:
    """Whether format and context say that a candidate is personal data, whatever the base patterns found."""
    card = f["luhn_ok"] & ((f["digits"].between(16, 19) & f["card_notation"]) | (f["digits"].between(13, 19) & f["word_card"]))
    phone = f["digits"].between(8, 15) & f["word_phone"] & ~f["date"] & ~f["glued_before"] & ~f["glued_after"]
    ip = (f["groups"] == 4) & (f["dots"] == 3) & f["small_parts"] & f["word_ip"] & ~f["glued_before"] & ~f["glued_after"]
    return F.when(kind == "email", f["address"]).when(kind == "card", card).when(kind == "phone", phone).when(kind == "secret", f["issued"] | f["assigned"]).otherwise(ip)


def met(scanned: DataFrame) -> DataFrame:
    """The candidates, each with whether it overlaps a base span, and by kind whether it is one."""
    candidates = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*", F.lit(None).cast("string").alias("base"))
    kinds = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*KINDS))
    base = scanned.select("row", F.explode(kinds).alias("base", "found")).select("row", "base", F.explode("found").alias("c")).select("row", "base", "c.start", "c.stop")
    every = candidates.unionByName(base, allowMissingColumns=True).repartition("row")
    is_base, own = F.col("base").isNotNull(), Window.partitionBy("row")
    reach = F.max(F.when(is_base, F.col("stop"))).over(own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(is_base, F.col("start"))).over(own.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    same = [F.max(F.coalesce(F.col("base") == k, F.lit(False))).over(Window.partitionBy("row", "start", "stop")).alias(f"same_{k}") for k in KINDS]
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("stop"), F.lit(False))
    return every.select("*", overlaps.alias("overlaps"), *same).where(~is_base).drop("base")


def featured(scanned: DataFrame) -> DataFrame:
    """One row for each candidate: row, kind, start, stop, label, whether it is a base span of its kind, whether it overlaps one of any, features."""
    c = met(scanned)
    digits = F.regexp_replace("value", "[^0-9]", "")
    groups = F.filter(F.split("value", "[^0-9]+"), lambda x: x != "")
    many = lambda chars: F.length(F.regexp_replace("value", f"[^{chars}]", ""))
    numbers = {
        "length": F.length("value"), "digits": F.length(digits), "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "dots": many("."), "dashes": many("-"), "spaces": many(" "),
        "plus": F.col("value").startswith("+"), "paren": F.col("value").contains("("), "at": F.col("value").rlike("@|[\\[(]at"),
        "luhn_ok": F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False)), "small_parts": F.forall(groups, lambda g: (F.length(g) <= 3) & (F.substring(g, 1, 3).cast("int") <= 255)),
        "glued_before": F.col("context").rlike(r"[\p{L}\p{N}+]$"), "glued_after": F.col("after").rlike(r"^[\p{L}\p{N}]"),
    } | {f"clue_{w}": F.col("context").contains(w) for w in CLUES} | {
        "letters": many("A-Za-z"), "capitals": many("A-Z"), "turns": F.regexp_count("value", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")), "issued": F.col("value").rlike(ISSUED),
        "assigned": F.col("context").rlike(rf"(?<!\p{{L}})(?:{CLUE_WORDS['secret']}){ASSIGNED}"),
        "address": address(F.col("value")), "date": F.col("value").rlike(DATE), "card_notation": F.col("value").rlike(r"^[0-9]{4}(?:[^0-9]{1,2}[0-9]{4})*+(?:[^0-9]{1,2}[0-9]{1,4})?$"),
    } | {f"word_{k}": F.col("context").rlike(rf"(?<!\p{{L}})(?:{w})(?!\p{{L}})") for k, w in CLUE_WORDS.items()}
    dotted = (F.size(groups) == 4) & (many(".") == 3)
    # what a candidate would be: by its signs, the number of its digits and the words before it
    kind = (
        F.when(F.col("source").isin(*ADDED), F.col("source")).when(F.col("source") == "spelled", "email")
        .when(numbers["word_phone"] & F.length(digits).between(8, 15) & ~(dotted & numbers["small_parts"]), "phone")
        .when((F.length(digits) >= 13), "card").when(dotted, "ip").otherwise("phone")
    )
    out = c.select("row", kind.alias("kind"), "start", "stop", "overlaps", *[f"same_{k}" for k in KINDS], *[v.alias(k) for k, v in numbers.items()])
    same = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"same_{k}")) for k in KINDS], F.lit(False))
    label = same | evidence(F.col("kind"), {k: F.col(k) for k in numbers})
    out = out.select("row", "kind", "start", "stop", label.cast("double").alias("label"), same.alias("same"), "overlaps", *[F.col(k).cast("double").alias(k) for k in numbers])
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(out)


def taught(candidates: DataFrame, kind: str, strata: dict[tuple[bool, float], int]) -> DataFrame:
    """(row, kind, start, stop, label, score) of the candidates of ``kind`` that overlap no base span; ``strata``: how many there are by same and label."""
    own = candidates.where(F.col("kind") == kind)
    bound = TRAINING_CANDIDATES / len(strata)
    draw = F.pmod(F.xxhash64("row", "start", "stop", "kind"), F.lit(1 << 30)) / F.lit(1 << 30)
    share = weight = F.lit(None).cast("double")
    for (same, label), n in strata.items():
        here = (F.col("same") == same) & (F.col("label") == label)
        share, weight = F.when(here, bound / n).otherwise(share), F.when(here, bound / min(n, bound)).otherwise(weight)
    sample = stored(own.where(draw < share).select("label", "features", weight.alias("weight")), "pii-sample")
    trees = GBTClassifier(maxIter=6, maxDepth=3, seed=7, featuresCol="features", labelCol="label", weightCol="weight", cacheNodeIds=False).fit(sample)
    score = F.round(vector_to_array("probability")[1], 3)
    return trees.transform(own.where("not overlaps")).select("row", "kind", "start", "stop", "label", score.alias("score"))


def added(scanned: DataFrame) -> DataFrame:
    """(row, more): spans that the trees add, as sorted kind:start:end strings' parts."""
    spark = scanned.sparkSession
    candidates = featured(scanned).where("same or not overlaps")
    strata: dict[str, dict[tuple[bool, float], int]] = {}
    for r in candidates.groupBy("kind", "same", "label").count().collect():
        strata.setdefault(r["kind"], {})[r["same"], r["label"]] = r["count"]
    # where no candidate beside the base spans has evidence, no score reaches the precision
    scored = [taught(candidates, kind, strata[kind]) for kind in ADDED if (False, 1.0) in strata.get(kind, {})]
    if not scored:
        return spark.createDataFrame([], "row long, more array<struct<kind:string,start:int,stop:int>>")
    every = stored(functools.reduce(DataFrame.unionByName, scored), "pii-scored")
    # precision of all candidates at or above each of at most 1001 scores a kind
    by_score = every.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    above = by_score.select("kind", "score", F.expr("sum(good) over (partition by kind order by score desc) / sum(n) over (partition by kind order by score desc)").alias("precision"))
    thresholds = above.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("score").alias("threshold"))
    chosen = every.join(F.broadcast(thresholds), "kind").where(F.col("score") >= F.col("threshold"))
    return chosen.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("more"))


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, ``more`` (what the trees add), for each row of ``documents``."""
    scanned = stored(scan(documents), "pii-scan")
    return scanned.drop("candidates").join(added(scanned), "row", "left").drop("row")


def joined_spans(with_more: bool) -> Column:
    def places(found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    def of(kind: str) -> Column:
        own = places(F.col(kind))
        if with_more:
            more = places(F.filter("more", lambda x: x["kind"] == kind))
            own = F.array_sort(F.concat(own, F.coalesce(more, F.array().cast("array<struct<start:int,stop:int>>"))))
        return F.transform(own, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in KINDS]), ",")


def secrets() -> Column:
    found = F.filter(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,stop:int>>")), lambda x: x["kind"] == "secret")
    return F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract; after them the secrets, which are none of its kinds."""
    out = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined_spans(False), 256).alias("base_sha256"), joined_spans(True).alias("spans"), F.size(secrets()).cast("long").alias("n_secret"), F.array_join(secrets(), ",").alias("secrets"))
