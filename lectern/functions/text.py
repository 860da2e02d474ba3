"""Scalar text functions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What tokens and Han characters are, as classes of characters.
#: A run that starts in Han stops where Han ends; any other run of letters, digits and underscores goes on into Han.
TOKEN = r"\p{IsHan}+|[\p{L}\p{N}_]+"
HAN = r"^\p{IsHan}+$"
WITHOUT_HAN = r"[\p{L}\p{N}_]+"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens; a Han run gives its characters, then its pairs of neighbours."""

    def expand(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.concat(chars, F.when(F.length(run) > 1, pairs).otherwise(F.array().cast("array<string>")))

    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    plain = F.transform(runs, lambda w: F.when(w.rlike(HAN), expand(w)).otherwise(F.array(w)))
    # texts without Han, by far the most, skip the nested arrays and need one class of characters only
    simple = F.regexp_extract_all(F.lower(text), F.lit(WITHOUT_HAN), F.lit(0))
    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(plain)).otherwise(simple)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


# Characters and what stands for them in HTML, the ampersand first.
def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_markdown(text: Column) -> Column:
    """Everything that is not a letter, a number or a space as a numeric character reference."""
    one = lambda c: F.when(c.rlike(r"^[\p{L}\p{N} ]$"), c).otherwise(F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";")))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def clean_title(path: Column, default: str = "Untitled") -> Column:
    """Base name without control, format and separator characters, spaces collapsed."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, r"[\p{Cc}\p{Cf}  ]+", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\s+", " ")), F.lit("")), F.lit(default))


def locator_label(kind: Column, page: Column, start: Column, end: Column, anchor: Column) -> Column:
    return (
        F.when(kind == "page", F.concat(F.lit("page "), page.cast("string")))
        .when(kind == "lines", F.concat(F.lit("lines "), start.cast("string"), F.lit("–"), end.cast("string")))
        .otherwise(anchor)
    )


def hashed_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the SHA-256 of the parts one after the other."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(*parts), 256))


SPACES = r"(?U)\s+"
#: What ``\s`` of SQL's patterns stands for: no vertical tab, and no space beyond ASCII.
SQL_SPACES = r"[\t\n\f\r ]+"


def stripped(text: Column) -> Column:
    """Without the space separators (those of all scripts, no tabs or line ends) at the ends."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def collapsed(text: Column, spaces: str = SPACES) -> Column:
    """White space (of any script, if not given) as single spaces, none at the ends."""
    return stripped(F.regexp_replace(text, spaces, " "))


def title_key(title: Column) -> Column:
    """Lower-cased compatibility form (NFKC) for comparing titles; ASCII titles, by far the most, stay in the JVM."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower())

    plain = F.when(title.rlike(r"^\p{ASCII}*$"), F.lower(title))
    return F.coalesce(plain, folded(F.when(plain.isNull(), title)))


def job_title(path: Column, first_page: Column, source_hash: Column) -> Column:
    """A book's title: its file name without .pdf (160 characters at most), else its first line with a letter or digit, else its hash."""
    name = stripped(F.substring(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf\z", ""), 1, 160))
    lines = F.filter(F.split(first_page, "\n"), lambda line: line.rlike(r"[\p{L}\p{N}]"))
    return F.coalesce(F.nullif(name, F.lit("")), F.substring(F.trim(F.get(lines, F.lit(0))), 1, 160), F.concat(F.lit("PDF "), F.substring(source_hash, 1, 12)))


def percent_decoded(resource: Column) -> Column:
    """Percent escapes decoded, a plus sign kept; null where they are not valid UTF-8."""
    return F.try_url_decode(F.replace(resource, F.lit("+"), F.lit("%2B")))


def safe_resource(resource: Column) -> Column:
    """Whether a decoded path stays below its folder: no scheme, root, backslash, control sign, or step upwards."""
    decoded = percent_decoded(resource)
    bad = decoded.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^/|\\|\p{Cc}|(^|/)\.\.(/|$)|[?#]")
    return F.coalesce(~bad & (decoded != ""), F.lit(False))


def source_allowed(path: Column) -> Column:
    """Whether a source may be read: a known suffix, no hidden part, no name that says credentials."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    known = name.rlike(r"\.(txt|md|markdown|html?|docx|pdf|png|jpe?g|webp)$")
    return known & ~path.rlike(r"(^|/)\.[^/]") & ~name.rlike(r"credential|secret|password|private[-_]?key|id_rsa|token")


def pieces(text: Column, size: int) -> Column:
    """array<struct<start, stop, text>>: parts of at most ``size`` UTF-16 code units that split no surrogate pair.

    Texts without characters beyond the basic plane are cut where they stand; for others a cut that would fall into a
    pair comes one unit earlier, which a fold over the cuts keeps track of.
    """
    units = utf16_length(text)
    even = F.transform(F.sequence(F.lit(0), F.greatest(units - 1, F.lit(0)), F.lit(size)), lambda a: F.struct(a.alias("start"), F.least(a + size, units).alias("stop"), F.substring(text, a + 1, F.lit(size)).alias("text")))
    astral = text.rlike(r"[\x{10000}-\x{10FFFF}]")

    @F.pandas_udf("array<struct<start:int,stop:int,text:string>>")
    def cut(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> list[dict] | None:
            if value is None:
                return None
            raw, out, at = value.encode("utf-16-le"), [], 0
            while at < len(raw) // 2:
                stop = min(at + size, len(raw) // 2)
                if stop < len(raw) // 2 and 0xD8 <= raw[2 * stop - 1] <= 0xDB and stop - 1 > at:
                    stop -= 1
                out.append({"start": at, "stop": stop, "text": raw[2 * at : 2 * stop].decode("utf-16-le", "surrogatepass")})
                at = stop
            return out

        return values.map(one)

    return F.when(astral, cut(F.when(astral, text))).otherwise(even)


def base64_line(content: Column) -> Column:
    """Base 64 in one line; Spark's has a line end after every 76 signs."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def base64_exact(encoded: Column) -> Column:
    """Whether decoding and encoding again gives the same string."""
    return F.coalesce(F.replace(F.base64(F.try_to_binary(encoded, F.lit("base64"))), F.lit("\r\n"), F.lit("")) == encoded, F.lit(False))


def instructed(instruction: Column, text: Column) -> Column:
    return F.concat(F.coalesce(instruction, F.lit("")), text)


def exact_keys(document: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(document)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))
