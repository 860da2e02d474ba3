"""Answers against their evidence: references, statuses, coverage, and what makes an answer insufficient.

requirements: (answer_id, requirement_id, status, evidence_ids); texts: (answer_id, text_id); paragraphs: (answer_id, ord,
evidence_ids, requirement_ids). All are keyed by answer, so the shuffles are on it and on its references.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("supported", "missing", "conflicting", "unassessed")
#: Statuses of requirements in the order of the reasons they give.
REASONS = {"missing": "missing-support", "conflicting": "conflicting-evidence", "unassessed": "unassessed"}


def violations(requirements: DataFrame, texts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(answer_id, code) for each broken rule of form: statuses, duplicate requirements, references, mappings."""
    rule = lambda df, code: df.select("answer_id", F.lit(code).alias("code"))
    needs = F.col("status").isin("supported", "conflicting")
    known = texts.select("answer_id", F.col("text_id").alias("id"))
    ids = requirements.select("answer_id", F.explode("evidence_ids").alias("id")).unionByName(paragraphs.select("answer_id", F.explode("evidence_ids").alias("id")))
    mapped = paragraphs.select("answer_id", "ord", "evidence_ids", F.explode("requirement_ids").alias("requirement_id"))
    own = requirements.select("answer_id", "requirement_id", F.col("evidence_ids").alias("of"))
    met = mapped.join(own, ["answer_id", "requirement_id"], "left")
    # each reference of a paragraph belongs to one of its requirements, and each of these has one of them
    per = met.groupBy("answer_id", "ord").agg(F.first("evidence_ids").alias("ids"), F.flatten(F.collect_list(F.coalesce("of", F.array().cast("array<string>")))).alias("of"))
    return (
        rule(requirements.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "status")
        .unionByName(rule(requirements.groupBy("answer_id", "requirement_id").count().where("count > 1"), "duplicate_requirement"))
        .unionByName(rule(requirements.where(needs & (F.size("evidence_ids") == 0)), "unsupported"))
        .unionByName(rule(requirements.where((F.col("status") == "conflicting") & (F.size(F.array_distinct("evidence_ids")) < 2)), "conflict_of_one"))
        .unionByName(rule(ids.join(known, ["answer_id", "id"], "left_anti"), "unknown_evidence"))
        .unionByName(rule(met.where("of is null"), "unknown_requirement"))
        .unionByName(rule(met.where("of is not null and size(array_intersect(of, evidence_ids)) = 0"), "false_mapping"))
        .unionByName(rule(per.where("size(array_except(ids, of)) > 0"), "false_mapping"))
    )


def diagnostics(requirements: DataFrame, texts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(answer_id, empty_blocks, uncovered, missing_mappings, reasons, status): one row for each answer that has requirements."""
    shown = paragraphs.select("answer_id", F.explode("requirement_ids").alias("requirement_id"), "evidence_ids")
    used = shown.groupBy("answer_id", "requirement_id").agg(F.array_distinct(F.flatten(F.collect_set("evidence_ids"))).alias("used"))
    need = requirements.join(used, ["answer_id", "requirement_id"], "left")
    none = F.array().cast("array<string>")
    has = [F.max(F.when(F.col("status") == s, F.lit(r))).alias(s) for s, r in REASONS.items()]
    per = need.groupBy("answer_id").agg(F.count_if(F.col("used").isNull()).alias("uncovered"), F.sum(F.size(F.array_except("evidence_ids", F.coalesce("used", none)))).alias("missing_mappings"), *has)
    blocks = paragraphs.groupBy("answer_id").agg(F.count(F.lit(1)).alias("blocks"))
    found = texts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("texts"))
    every = per.join(blocks, "answer_id", "left").join(found, "answer_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("texts").isNull(), F.lit("no-candidates")), *REASONS))
    empty = F.when(F.col("blocks").isNull(), 1).otherwise(0)
    whole = (F.size(reasons) == 0) & (empty == 0) & (F.col("uncovered") == 0) & (F.col("missing_mappings") == 0)
    return every.select("answer_id", empty.alias("empty_blocks"), "uncovered", "missing_mappings", F.array_join(reasons, ",").alias("reasons"), F.when(whole, "answered").otherwise("insufficient-evidence").alias("status"))


def empty(questions: DataFrame) -> DataFrame:
    """The answer to questions whose search found nothing: no bundle, no document, one reason. questions: (question_id, question)."""
    none = F.lit(None).cast("string")
    return questions.select(
        "question_id", "question", F.lit("insufficient-evidence").alias("status"), none.alias("document"), F.array(F.lit("no-candidates")).alias("reasons"), none.alias("bundle_id"),
        F.lit("deterministic").alias("provenance"), F.lit(False).alias("semantic_proof"), F.array().cast("array<string>").alias("requirements"), F.array().cast("array<string>").alias("figures"),
    )


# The fields of an answer as it comes over the wire, and its most bytes.
FIELDS = {
    "requirements": {"id": "string", "requirement": "string", "status": "string", "evidenceIds": "array<string>"},
    "figures": {"occurrenceId": "string", "requirementId": "string", "evidenceIds": "array<string>", "justification": "string"},
    "paragraphs": {"text": "string", "evidenceIds": "array<string>", "requirementIds": "array<string>"},
}
TOP = ("wireVersion", "status", *FIELDS)
BYTES = 512 << 10


def parsed(documents: DataFrame, most: int = BYTES) -> DataFrame:
    """(answer_id, answer) from (answer_id, json); a document that is none fails the job, with the reason.

    It must be JSON of the fields' types (FAILFAST), of at most ``most`` bytes, with these fields and no others at the top and
    in every element. Null documents and null fields count as missing ones.
    """
    inner = {k: "array<struct<" + ",".join(f"{n}:{t}" for n, t in own.items()) + ">>" for k, own in FIELDS.items()}
    kind = "wireVersion string, status string, " + ", ".join(f"{k} {t}" for k, t in inner.items())
    loose = ", ".join(f"{k} array<map<string,string>>" for k in FIELDS)
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: answer "), F.coalesce(F.col("answer_id").cast("string"), F.lit("null"))))
    fast = {"mode": "FAILFAST"}
    size = F.coalesce(F.octet_length("json"), F.lit(0))
    text = F.when(size == 0, fail("no document").cast("string")).when(size > most, fail("beyond its bytes").cast("string")).otherwise(F.col("json"))
    rows = documents.select("answer_id", text.alias("json")).select("answer_id", "json", F.from_json("json", kind, fast).alias("answer"), F.from_json("json", loose, fast).alias("maps"))
    same = lambda keys, names: F.array_sort(keys) == F.array(*map(F.lit, sorted(names)))

    def whole(k: str) -> Column:
        named = F.forall(F.col(f"maps.{k}"), lambda m: same(F.map_keys(m), FIELDS[k]))
        given = F.forall(F.col(f"answer.{k}"), lambda x: functools.reduce(operator.and_, [x[n].isNotNull() for n in FIELDS[k]]))
        return F.coalesce(named & given, F.lit(False))

    exact = functools.reduce(operator.and_, map(whole, FIELDS), same(F.json_object_keys("json"), TOP))
    kept = F.when(F.coalesce(exact, F.lit(False)), F.col("answer")).otherwise(fail("unexpected or missing fields").cast("struct<" + kind.replace(", ", ",").replace(" ", ":") + ">"))
    return rows.select("answer_id", kept.alias("answer"))
