"""Column functions for text; all are Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values

#: White space in the sense of Python's strip(): Unicode's, and the four information separators.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def trim_affixes(c: Column) -> Column:
    """Cut the trimming strings off both ends until none is left."""
    return F.regexp_replace(c, rf"^{values.AFFIX}|{values.AFFIX}\z", "")


def basename(c: Column) -> Column:
    """Last part of a path with either slash; trailing slashes do not count."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/+\z", ""), "/", -1)


def path_segments(c: Column) -> Column:
    """Trimmed parts of a path, the empty ones, the root and single dots dropped; none for null, '' and '.'."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), "/")
    return F.filter(F.transform(F.filter(parts, lambda p: p != "."), trim_affixes), lambda p: p != "")


def path_group(c: Column) -> Column:
    return let(path_segments(c), lambda s: F.try_element_at(s, F.lit(-1)))


def split_path(c: Column) -> Column:
    """(filename, path, separator) at the last slash of either kind; path and separator null without one."""
    found = r"(?s)^(.*)([/\\])([^/\\]*)\z"
    has = c.rlike(r"[/\\]")
    return F.struct(
        F.when(has, F.regexp_extract(c, found, 3)).otherwise(c).alias("filename"),
        F.when(has, F.regexp_extract(c, found, 1)).alias("path"),
        F.when(has, F.regexp_extract(c, found, 2)).alias("separator"),
    )


def _compositions() -> dict[str, str]:
    found = {}
    for mark in range(0x300, 0x370):
        for base in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
            pair = chr(base) + chr(mark)
            if len(one := unicodedata.normalize("NFC", pair)) == 1:
                found[pair] = one
    return found


def compose(c: Column) -> Column:
    """Canonical composition of Latin, Greek and Cyrillic letters with up to two combining marks; other text is kept.
    The table is built from Unicode's rules when the plan is made; rows without marks skip it."""
    pairs = _compositions()
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))

    def once(s: Column) -> Column:
        pieces = F.regexp_extract_all(s, F.lit("(?s)[^̀-ͯ][̀-ͯ]|."), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) < 2, p).otherwise(F.coalesce(F.try_element_at(table, p), p))), "")

    return F.when(c.rlike("[̀-ͯ]"), once(once(c))).otherwise(c)


def replace_characters(c: Column) -> Column:
    """Plain quotes, dashes and blanks for their typographic kin; strings that stand for a dash become one."""
    one = {k: v for k, v in values.CHARACTERS.items() if len(v) <= 1}
    order = sorted(one, key=lambda k: one[k] == "")  # translate() deletes what has no counterpart
    c = F.translate(compose(c), "".join(order), "".join(one[k] for k in order))
    for k, v in values.CHARACTERS.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    for s in values.DASHED:
        c = F.replace(c, F.lit(s), F.lit(" - "))
    c = F.regexp_replace(c, r"(?U)\s*-\s*-\s*", " - ")
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def has_loose_underscore(c: Column) -> Column:
    return c.rlike(r"(?U)\s_|_\s")


def replace_underscores(c: Column) -> Column:
    """Underscores beside white space go; the others become a blank where no white space is beside them."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<=\s)_|_(?=\s)", ""), r"(?U)(?<!\s)_(?!\s)", " ")


def strip_extension(c: Column) -> Column:
    """Without the last suffix if it is a known extension; a leading dot begins no suffix."""
    suffix = F.lower(F.regexp_extract(c, r"(?s)^.+\.([^.]+)\z", 1))
    return F.when(suffix.isin(values.EXTENSIONS), F.regexp_extract(c, r"(?s)^(.+)\.[^.]+\z", 1)).otherwise(c)


def clean_text(c: Column) -> Column:
    """Single blanks, no affixes, no commas, semicolons or colons at the ends; '' for null."""
    c = strip(trim_affixes(strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " "))))
    return strip(F.regexp_replace(strip(F.regexp_replace(c, "^[,;:]+", "")), r"[,;:]+\z", ""))


def meaningful(c: Column) -> Column:
    """Has a word of two ASCII letters or more."""
    return c.rlike(r"(?U)\b[a-zA-Z]{2,}\b")


def numeric(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+\z")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 if equal, 0 if one is empty."""
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def normalize_studio(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"(?U)\b(studio|productions|entertainment)\b", "")
    return F.regexp_replace(c, "[^a-z0-9]", "")


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " "), r"(?U)[^\w\s]", "")


def normalize_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"(?U)\s+", "")


def normalize_lightly(c: Column, field: str) -> Column:
    c = F.lower(strip(c))
    if field == "studio":
        return F.replace(F.replace(c, F.lit(" studio"), F.lit("")), F.lit(" productions"), F.lit(""))
    return F.translate(c, "_-", "  ") if field == "title" else c


def literal(s: str) -> str:
    """A regex for exactly this text that Java and RE2 read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", s)
