"""Operator 13: a Merkle manifest of a dataset, by slot pivots.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 length, ``:`` and its value. Leaves of one
language, in order of doc_id, are hashed eight at a time, level by level, to the language's subroot; the subroots, in
order of the languages' bytes (null first), likewise to the root.

A level is one aggregation: conditional aggregates spread a parent's children into ``FANOUT`` columns. Their
concatenation gives the parent's digest; leaving out a child's own column gives its siblings. Siblings come down from
the root with one join a level, of one row a parent, so that leaves are shuffled twice only: to their order and to the
first pivot. Places in a language are counted from the sizes of sorted ranges; no language lies in one task.

Defined results: rows that share a doc_id are ordered by their leaf's digest (null doc_ids first), rows that are equal
throughout are a leaf each; a null doc_id is never tampered with; an empty table gives an empty result; a table of one
row has its leaf as root and an empty list of siblings; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: More levels than any table has: FANOUT ** LEVELS exceeds a 64-bit place.
LEVELS = 21


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return sha256(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def tampered_text() -> Column:
    """A-Z in lower case where 3 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(tree, doc_id, hash, claimed): the languages as trees, whose names sort as the languages do.

    ``claimed``: the text that is claimed for a row; its leaf is null where it equals the row's own.
    """
    own = leaf_digest(F.col("text"))
    other = F.lit(None).cast("string") if claimed is None else F.when(~claimed.eqNullSafe(F.col("text")), leaf_digest(claimed))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("hash"), other.alias("claimed"))


@dataclass
class Forest:
    """``nodes``: (tree, height, pos, item) of the leaves; ``levels``: (tree, height, pos, c0 .. c7, hash) of the parents, from below."""

    nodes: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, height, hash), one row a tree."""
        own = [self.nodes.where("height = 0").select("tree", "height", F.col("item.hash").alias("hash"))]
        own += [level.where(F.col("height") == h).select("tree", "height", "hash") for h, level in enumerate(self.levels, 1)]
        return functools.reduce(DataFrame.unionByName, own)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, hash, ...) with ``pos`` in their tree, by ``order``, and the tree's ``height``."""
    # the last key tells equal rows apart, so that a range may end between them
    keyed = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    by = [F.asc_nulls_first(c) for c in ("tree", *order, "hash", "salt")]
    ranges = stored(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    # one row for each part of a tree in a range
    part = F.shiftright("at", 33)
    sizes = ranges.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("tree")
    height = functools.reduce(lambda e, h: F.when(F.col("all") <= FANOUT**h, F.lit(h)).otherwise(e), reversed(range(LEVELS)), F.lit(LEVELS))
    sizes = sizes.select("tree", "part", "first", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("all"))
    sizes = sizes.select("tree", "part", (F.col("before") - F.col("first")).alias("shift"), height.alias("height"))
    return ranges.withColumn("part", part).join(sizes, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("salt", "at", "part", "shift")


def pivot(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes`` (tree, height, pos, item): a column for each child's slot, and their digest."""
    slots = [F.max(F.when(F.col("pos") % FANOUT == k, F.col("item"))).alias(f"c{k}") for k in range(FANOUT)]
    parents = nodes.groupBy("tree", "height", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(*slots)
    return parents.withColumn("hash", F.sha2(F.concat_ws("", *[F.col(f"c{k}.hash") for k in range(FANOUT)]), 256))


def build(rows: DataFrame, order: list[str], carried: list[str]) -> Forest:
    """Hash ``rows`` (tree, hash, ...), in ``order``, to a root for each tree; ``carried`` columns stay with the leaves."""
    item = F.struct("hash", *carried).alias("item")
    nodes = leaf_nodes = stored(placed(rows, order).select("tree", "height", "pos", item), "merkle-nodes")
    highest = nodes.agg(F.max("height")).first()[0] or 0
    levels = []
    for h in range(1, highest + 1):
        levels.append(stored(pivot(nodes.where(F.col("height") >= h)), "merkle-level"))
        nodes = levels[-1].select("tree", "height", "pos", F.struct("hash").alias("item"))
    return Forest(leaf_nodes, levels)


def descended(forest: Forest, tops: DataFrame) -> DataFrame:
    """(item, path, top) for each leaf: its siblings as an array of (left, right) from below; ``tops``: (tree, height, path, top)."""

    def children() -> Column:
        hashes = [F.col(f"c{k}.hash") for k in range(FANOUT)]
        each = [
            F.when(F.col(f"c{k}").isNotNull(), F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("item"), F.concat_ws("", *hashes[:k]).alias("left"), F.concat_ws("", *hashes[k + 1 :]).alias("right")))
            for k in range(FANOUT)
        ]
        return F.explode(F.array_compact(F.array(*each)))

    entries = None
    for h in range(len(forest.levels), 0, -1):
        own = tops.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("pos"), "path", "top")
        entries = own if entries is None else own.unionByName(entries.drop("item"))
        found = forest.levels[h - 1].join(entries, ["tree", "pos"]).select("tree", "pos", "path", "top", children().alias("c"))
        path = F.concat(F.array(F.struct("c.left", "c.right")), F.col("path"))
        entries = found.select("tree", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), path.alias("path"), "top", F.col("c.item").alias("item"))
    alone = forest.nodes.where("height = 0").join(tops.where("height = 0").drop("height"), "tree").select("item", "path", "top")
    return alone if entries is None else alone.unionByName(entries.select("item", "path", "top"))


NO_PATH = "array<struct<left:string,right:string>>"


def proofs(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, claimed, subroot, root, path) for each row of ``docs``."""
    forest = build(leaves(docs, claimed), ["doc_id"], ["doc_id", "claimed"])
    roots = stored(forest.roots(), "merkle-subroots")
    # the subroots are the leaves of one more tree
    above = build(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("height").alias("depth"), "hash"), ["name"], ["name", "depth"])
    whole = above.roots().select("tree", "height", F.array().cast(NO_PATH).alias("path"), F.col("hash").alias("top"))
    named = descended(above, whole).select(
        F.col("item.name").alias("tree"), F.col("item.depth").alias("height"), "path", F.struct(F.col("item.hash").alias("subroot"), F.col("top").alias("root")).alias("top")
    )
    found = descended(forest, stored(named, "merkle-tops"))
    return found.select("item.doc_id", F.col("item.hash").alias("leaf"), "item.claimed", "top.subroot", "top.root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, level: sha256(level["left"], digest, level["right"]))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proofs(table(spark, sf_dir, "documents"), tampered_text())
    siblings = F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(prefix: str, tree: str, count: int) -> str:
    """SQL: nodes of each level and, for each, what stands left and right of it among its run; a lone node is carried on."""
    run = f"PARTITION BY {tree}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
    out = []
    for k in range(count):
        out.append(f"""{prefix}s{k} AS (SELECT *, coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {prefix}{k})""")
        out.append(f"""{prefix}{k + 1} AS (SELECT {tree}, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n,
            CASE WHEN any_value(n) > 1 THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE any_value(hash) END AS hash
            FROM {prefix}{k} GROUP BY {tree}, pos // {FANOUT})""")
    return ",\n".join(out)


def _folds(prefix: str, start: str, levels: str, tree: str, place: str, count: int) -> str:
    out = [f"{prefix}0 AS (SELECT * FROM {start})"]
    for k in range(count):
        out.append(f"""{prefix}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.v || s.r) ELSE f.v END AS v, f.proof || s.l || s.r AS proof)
            FROM {prefix}{k} f JOIN {levels}s{k} s ON f.{tree} = s.{tree} AND f.{place} // {FANOUT**k} = s.pos)""")
    return ",\n".join(out)


def _sql(count: int = 10) -> str:
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    before = " || ".join(field.format(c) for c in FIELDS[:-1])
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(range(8), lambda c, i: {step}, xor(c0, b))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c0, b: {byte}, 4294967295::BIGINT), 4294967295)"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({before} || {field.format('text')}) AS leaf,
           CASE WHEN {crc} % 3 = 0 THEN sha256({before} || {field.format(lower)}) END AS claimed FROM documents),
a0 AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels("a", "tree", count)},
b0 AS (SELECT '' AS one, tree AS name, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM a{count}),
{_levels("b", "one", count)},
start AS (SELECT a0.doc_id, a0.tree, a0.leaf, a0.pos AS place, '' AS one, b0.pos AS top_place, b0.hash AS subroot, b{count}.hash AS root, coalesce(a0.claimed, a0.leaf) AS v, '' AS proof
          FROM a0 JOIN b0 ON a0.tree = b0.name CROSS JOIN b{count}),
{_folds("f", "start", "a", "tree", "place", count)},
{_folds("g", f"f{count}", "b", "one", "top_place", count)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified FROM g{count}
"""


SQL = _sql()
