"""Images in Markdown, outside fenced and inline code.

Only documents that hold an image mark are folded; the fold keeps the open fence and the few lines that matter, so it
is linear in the text. Defined results: null and empty texts have no image; an unclosed fence runs to the end; a fence
is closed by a marker of its own character only; repeated rows give their images again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import percent_decoded, safe_resource

# Patterns of fences, code and images.
FENCE, INLINE_CODE, IMAGE = r"^\s*(`{3,}|~{3,})", "`[^`]*`", r"!\[([^\]]*)\]\(([^\s()]+)\)"
HTML_IMAGE = r"(?i)<img\b"
SUFFIX = r"(?i)\.(png|jpe?g|webp)$"


def _outside_fences(text: Column) -> Column:
    """array<struct<line int, text string>>: lines with an image mark, inline code removed."""
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        mark = F.substring(F.regexp_extract(line, FENCE, 1), 1, 1)
        fence = F.when(mark == "", state["fence"]).when(state["fence"] == "", mark).when(state["fence"] == mark, "").otherwise(state["fence"])
        plain = F.regexp_replace(line, INLINE_CODE, "")
        wanted = (mark == "") & (state["fence"] == "") & (plain.contains("![") | plain.rlike(HTML_IMAGE))
        number = state["line"] + 1
        found = F.when(wanted, F.concat(state["found"], F.array(F.struct(number.alias("line"), plain.alias("text"))))).otherwise(state["found"])
        return F.struct(fence.alias("fence"), number.alias("line"), found.alias("found"))

    return F.aggregate(F.split(text, "\n"), start, step)["found"]


def _lines(documents: DataFrame) -> DataFrame:
    marked = documents.select("document_id", "text").where(F.col("text").contains("![") | F.col("text").rlike(HTML_IMAGE))
    return marked.select("document_id", F.inline(_outside_fences(F.col("text"))))


def images(documents: DataFrame) -> DataFrame:
    """(document_id, line, pos, caption, target, allowed): ``allowed`` for paths that, percent escapes decoded, stay below the document's folder, of a known image type."""
    whole = F.regexp_extract_all("text", F.lit(IMAGE), F.lit(0))
    each = _lines(documents).select("document_id", "line", F.posexplode(whole).alias("pos", "image"))
    target = F.regexp_extract("image", IMAGE, 2)
    allowed = F.coalesce(percent_decoded(target).rlike(SUFFIX), F.lit(False)) & safe_resource(target)
    return each.select("document_id", "line", "pos", F.regexp_extract("image", IMAGE, 1).alias("caption"), target.alias("target"), allowed.alias("allowed"))


def unsupported(documents: DataFrame) -> DataFrame:
    """(document_id, line): image marks that are no plain image, and HTML images."""
    rest = F.regexp_replace("text", IMAGE, "")
    return _lines(documents).where(rest.contains("![") | F.col("text").rlike(HTML_IMAGE)).select("document_id", "line")
