"""Scalar functions as columns: they stay in the JVM, inside generated code."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P



def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the plain letters that they are made of."""
    letters = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.isalpha() and c.lower() == c]
    parts = {c: unicodedata.normalize("NFD", c) for c in letters}
    marked = [c for c in letters if len(parts[c]) > 1 and parts[c][0] in string.ascii_lowercase]
    return "".join(marked), "".join(parts[c][0] for c in marked)


#: Letters that a token is folded by, and what they become.
ACCENTS, PLAIN = _folding()
#: A token is a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """In lower case and without marks; a text of plain letters is not looked at letter by letter."""
    lower = F.lower(text)
    return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, ACCENTS, PLAIN))


def tokens(text: Column) -> Column:
    """array<string>: lower-cased, accents removed, no stemming."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalize_symbol(symbol: Column) -> Column:
    return F.btrim(F.lower(symbol), F.lit("()"))


def defined_names(content: Column, pattern: str, groups: int) -> Column:
    """array<string>: what the groups of a pattern hold, match by match."""
    found = F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), F.lit(g + 1)).alias(f"g{g}") for g in range(groups)))
    return F.filter(F.flatten(F.transform(found, lambda m: F.array(*(m[f"g{g}"] for g in range(groups))))), lambda name: name != "")


def documented_names(content: Column, pattern: str) -> Column:
    """array<string>: the last parts of the dotted names of directives."""
    last = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: F.substring_index(F.ltrim(x, F.lit("~")), ".", -1))
    return F.filter(last, lambda name: name != "")


def parse_json_list(text: Column) -> Column:
    """A JSON list as an array; anything else is an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def unit_id(framework: Column, source_file: Column, hierarchy: Column, content: Column) -> Column:
    """As :func:`siltstone.functions.documents.unit_id`, for ASCII headings without quotes and backslashes."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform(hierarchy, lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", "), F.lit("]"))
    own = F.substring(F.sha2(content, 256), 1, 8)
    return F.substring(F.sha2(F.concat_ws(":", framework, source_file, quoted, own), 256), 1, 16)


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def relevance_decay(source_file: Column) -> Column:
    return F.when(F.lower(source_file).rlike("|".join(P.DECAYED_PATHS)), F.lit(P.DECAY)).otherwise(F.lit(1.0))


def module_path(framework: Column, source_file: Column) -> Column:
    bare = F.regexp_replace(source_file, "^(?:" + "|".join(P.PATH_PREFIXES) + ")", "")
    parts = F.split(F.translate(F.regexp_replace(bare, r"\.(?:md|rst)\z", ""), "\\", "/"), "/")
    named = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\d+-", "")), lambda p: ~F.lower(p).isin("index", "readme", ""))
    return F.array_join(F.concat(F.array(framework), named), ".")


def url_to_filepath(url: Column, url_filter: str = "") -> Column:
    """A page's place in a source: without host, from the filter on, with a suffix; the query string stays."""
    path = F.regexp_replace(F.regexp_replace(url, r"^(?s:.*?)//", ""), r"^[^/]*/", "")
    cut = url_filter.strip("/")
    if cut:
        at = F.instr(path, cut)
        path = F.when(at > 0, F.substr(path, at + F.lit(len(cut)))).otherwise(path)
    bare = F.btrim(path, F.lit("/"))
    bare = F.when(bare == "", F.lit("index")).otherwise(bare)
    return F.when(bare.rlike(r"\.(?:md|html|rst)\z"), bare).otherwise(F.concat(bare, F.lit(".md")))


def embedding_document(hierarchy: Column, content: Column) -> Column:
    return F.concat(F.array_join(hierarchy, " > "), F.lit("\n\n"), content)


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def http_version(etag: Column, modified: Column) -> Column:
    return F.coalesce(F.concat(F.lit("etag:"), F.nullif(etag, F.lit(""))), F.concat(F.lit("mod:"), F.nullif(modified, F.lit(""))))


def short_version(key: Column) -> Column:
    hashed = F.left(F.sha2(key, 256), F.lit(12))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("-")).when(key.rlike("^(?:etag|mod):"), hashed).otherwise(F.left(key, F.lit(12)))


def short_date(moment: Column) -> Column:
    return F.date_format(moment, "MM-dd")


def human_size(size: Column) -> Column:
    """In steps of 1024, with one decimal from KB on."""
    shown = lambda k: F.format_string("%.1f", F.bround(size / F.lit(1024.0**k), 1))
    out = F.concat(shown(4), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < F.lit(1024.0 ** (k + 1)), F.concat(shown(k), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def snippet(content: Column, width: int = 80) -> Column:
    """The first line that is not blank, cut to ``width`` (four at least) with an ellipsis."""
    width = max(4, width)
    line = F.coalesce(F.get(F.filter(F.transform(F.split(content, "\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(line) > width, F.concat(F.rtrim(F.substring(line, 1, width - 1)), F.lit("…"))).otherwise(line)


def description(content: Column) -> Column:
    return F.substring(F.get(F.split(content, "\n"), F.lit(0)), 1, 120)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").when(score >= 30, "D").otherwise("F")


def percent(ratio: Column) -> Column:
    """As text, half rounded to even."""
    return F.concat(F.bround(ratio * 100.0).cast("int").cast("string"), F.lit("%"))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of two arrays, in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
