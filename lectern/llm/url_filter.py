"""Operator 4: URL filtering by a rule list and by association rules mined with FP-growth.

List rules come first: (action, host, path), a rule fits its host and all subdomains when the url's path starts with
its path, the longest wins. What no list rule decides is judged by mined rules: combinations of url tokens, of any size,
that go with the label *block* on labelled pages. A rule needs ``MIN_PAGES`` blocked pages, a plain count that is the same
however large the table, and ``MIN_CONFIDENCE``. A token with digits counts as it is and with each run of digits as one #.

Mining. Tokens are counted first, in one aggregation. A token that reaches the confidence alone is a rule; what contains it
fits nowhere else, so it goes no further. The others, if on enough blocked pages, are items of Spark's FP-growth over
blocked pages, where tokens that lie on the same labelled pages (by their counts and a 128-bit sum over the pages) are one
item: a page with dozens of equal query keys has one item for them, and not their subsets. The confidence of what FP-growth
finds is counted on all labelled pages. Of these rules only those go that have one item more than a rule of at least their
confidence: that one fits wherever they do. FP-growth keeps its items on the driver: those that are mixed (blocked pages
and others) and differ in where they occur; tokens of wholly blocked hosts are none of them.

Matching goes through an inverted index: a url's tokens become items, every rule is listed under its rarest item (by
counts over all urls), urls look up their items there, and the candidates' other items are checked. A url has an item when
it has one of its tokens. Urls are judged once each; of several rules the one with the highest confidence is named, of
those the last by its tokens.

Defined results: a null url, or one without ``://``, has empty host and path and no tokens, and is allowed; repeated
pages keep a row each, and page_ids with several urls give each url their labels; with fewer blocked pages than
``MIN_PAGES`` no rule is mined; a very long url is one row with all its tokens; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

MIN_CONFIDENCE = 0.8
MIN_PAGES = 10

#: The rule list of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
RULE, MEMBER = "rule_id long, antecedent array<string>, confidence double, n long", "token string, item string"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def list_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(action).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: host labels, path segments, query keys; those of host and path also with digits written as one #."""
    plain = lambda c: F.regexp_replace(c, r"[0-9]+", "#")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    parts = F.concat(
        *[F.transform(F.split(c, r"\."), lambda x: F.concat(F.lit("host:"), x)) for c in (host, plain(host))],
        *[F.transform(F.split(c, "/"), lambda x: F.concat(F.lit("path:"), x)) for c in (path, plain(path))],
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^[^=]*", 0))),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~x.endswith(":"))))


def needed_only(rules: DataFrame) -> DataFrame:
    """``rules`` without those that one token less makes a rule of at least the same confidence."""
    less = rules.select("rule_id", "confidence", F.explode("antecedent").alias("token"), "antecedent").where(F.size("antecedent") > 1).select("rule_id", "confidence", F.array_remove("antecedent", F.col("token")).alias("less"))
    parts = rules.select(F.col("antecedent").alias("less"), F.col("confidence").alias("reached"))
    spare = less.join(parts, "less").where("reached >= confidence").select("rule_id").distinct()
    return rules.join(spare, "rule_id", "left_anti")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, antecedent of items, confidence, n blocked pages) from (tokens, blocked) rows, and (token, item)."""
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "url-labelled")
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    place = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20)")).alias(f"place{seed}") for seed in (0, 1)]
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("b"), *place).where(F.col("b") >= min_pages)
    counts = stored(counts.withColumn("confidence", F.col("b") / F.col("n")), "url-tokens")
    alone = counts.where(F.col("confidence") >= min_confidence).select(F.array("token").alias("antecedent"), "confidence", F.col("b").alias("n"), F.col("token").alias("item"), "token")
    mixed = counts.where(F.col("confidence") < min_confidence)
    item = mixed.groupBy("n", "b", "place0", "place1").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    members = stored(item.select(F.explode("tokens").alias("token"), "item"), "url-items")
    # a page's items; its tokens are one row's, so a page is a small group
    baskets = stored(each.join(members, "token").groupBy("row", "blocked").agg(F.collect_set("item").alias("items")).where(F.size("items") > 1), "url-baskets")
    blocked = baskets.where("blocked").select("items")
    found, size = spark.createDataFrame([], RULE), blocked.count()
    if size >= min_pages:
        # half a page less, so that rounding doesn't ask for one more
        sets = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / size).fit(blocked).freqItemsets.where(F.size("items") > 1)
        sets = stored(sets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("b")), "url-sets")
        rarity = counts.select(F.col("token").alias("item"), "n")
        met = indexed(sets, rarity).join(baskets.select("row", "items", F.explode("items").alias("item")), "item").where(F.size(F.array_except("antecedent", "items")) == 0)
        confidence = met.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n")).join(sets, "antecedent").withColumn("confidence", F.col("b") / F.col("n"))
        found = confidence.where(F.col("confidence") >= min_confidence).select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "confidence", F.col("b").alias("n"))
        found = needed_only(stored(found, "url-rules-found"))
    rules = found.unionByName(alone.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "confidence", "n"))
    return stored(rules, "url-rules"), members.unionByName(alone.select("token", "item"))


def indexed(rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """``rules`` with ``item``: of each antecedent the rarest by ``rarity`` (item, n), its place in the index."""
    each = rules.select("antecedent", F.explode("antecedent").alias("item")).join(rarity, "item", "left")
    first = each.groupBy("antecedent").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    return rules.join(first, "antecedent")


def match(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """(url, confidence, mined_rule) for the urls that a rule fits, by the strongest rule."""
    met = urls.select("url", F.explode("tokens").alias("token")).join(members, "token")
    own = met.groupBy("url", "item").agg(F.min("token").alias("token")).groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("has"))
    own = stored(own, "url-has")
    items = own.select("url", "has", F.explode(F.map_keys("has")).alias("item"))
    index = indexed(rules, items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))).select("item", "antecedent", "confidence")
    fits = items.join(index, "item").where(F.size(F.array_except("antecedent", F.map_keys("has"))) == 0)
    # named by the tokens that the url has
    named = F.array_join(F.array_sort(F.transform("antecedent", lambda i: F.element_at("has", i))), " ")
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", named.alias("mined_rule"))).alias("best"))
    return best.select("url", "best.confidence", "best.mined_rule")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages: (page_id, url), labels: (page_id, blocked) -> page_id, host, path, rule, verdict, mined_rule, confidence."""
    host, path = host_and_path()
    urls = pages.select("url").where("url is not null").distinct().select("url", url_tokens(host, path, F.col("url")).alias("tokens"))
    labelled = pages.join(labels, "page_id").select("url", "blocked").where("blocked is not null").select(url_tokens(host, path, F.col("url")).alias("tokens"), "blocked")
    mined = match(urls, *mine(labelled))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("listed", list_rule(rules, F.col("host"), F.col("path")))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.join(mined, "url", "left").select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", method).alias("verdict"), "mined_rule", "confidence"
    )


def listed_labels(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, blocked) of the pages that a list rule decides."""
    listed = list_rule(rules, *host_and_path())["verdict"]
    return pages.select("page_id", (listed == "block").alias("blocked")).where("blocked is not null").distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_labels(pages, RULES), RULES)
