"""Stage 1: clean a file name and list what was removed.

All occurrences of a marker are removed (one pass each is enough, as markers do not overlap). Positions are offsets in
the base name for all classes but misc, whose markers are sought in what the other classes left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from .barrier import add

REMOVED = "array<struct<value:string,category:string,position:int,confidence:double>>"


def _apart(markers: list[str]) -> str:
    """Any of the markers, not touching ASCII letters or digits."""
    return "(?<![a-zA-Z0-9])(?:" + "|".join(text.literal(m) for m in markers) + ")(?![a-zA-Z0-9])"


_FIRST = [(c, m, conf) for c, ms, conf in values.MARKERS if c != "misc" for m in ms]
_LAST = [("misc", m, conf) for c, ms, conf in values.MARKERS if c == "misc" for m in ms]
FIRST_MARKERS = [m for _, m, _ in _FIRST]
FIRST = _apart(FIRST_MARKERS)


#: Names without any misc marker, most of them, skip the passes for these.
ANY_LAST = "|".join(text.literal(m) for _, m, _ in _LAST)


def strip_markers(base: Column) -> Column:
    """A base name without its markers."""

    def passes(c: Column) -> Column:
        rest = c
        for _, m, _ in _LAST:
            rest = text.strip(F.regexp_replace(rest, _apart([m]), ""))
        return F.when(c.rlike(ANY_LAST), rest).otherwise(c)

    return text.let(text.strip(F.regexp_replace(base, FIRST, "")), passes)


def _hits(c: Column, pattern: str, rank: dict[str, int], rows: list[tuple[str, str, float]]) -> Column:
    """Structs (rank, n, value, category, position, confidence) of the matches in c."""
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    ranks = F.create_map(*(x for m, r in rank.items() for x in (F.lit(m), F.lit(r))))
    names = F.array(*(F.lit(f"{k}_{m}") for k, m, _ in rows))
    sure = F.array(*(F.lit(p) for _, _, p in rows))

    def row(v: Column, i: Column) -> Column:
        r = F.element_at(ranks, v)
        at = F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        return F.struct(r.alias("rank"), i.alias("n"), v.alias("value"), F.get(names, r).alias("category"), at.alias("position"), F.get(sure, r).alias("confidence"))

    return F.when(F.size(found) > 0, F.array_sort(F.transform(found, row)))


def removed_markers(base: Column) -> Column:
    """What strip_markers() removes: by class and marker in their order, then by place."""
    none = F.array().cast("array<struct<rank:int,n:int,value:string,category:string,position:int,confidence:double>>")

    def last(c: Column) -> Column:
        lists, rest = [], c
        for row in _LAST:
            lists.append(F.coalesce(_hits(rest, _apart([row[1]]), {row[1]: 0}, [row]), none))
            rest = text.strip(F.regexp_replace(rest, _apart([row[1]]), ""))
        return F.when(c.rlike(ANY_LAST), F.concat(*lists)).otherwise(none)

    first = F.when(base.rlike(FIRST), _hits(base, FIRST, {m: i for i, (_, m, _) in enumerate(_FIRST)}, _FIRST)).otherwise(none)
    every = F.concat(first, text.let(text.strip(F.regexp_replace(base, FIRST, "")), last))
    return F.transform(every, lambda x: F.struct(x.value.alias("value"), x.category.alias("category"), x.position.alias("position"), x.confidence.alias("confidence")))


def after_markers(c: Column) -> Column:
    """Trim, replace characters and dashes: what underscores are then handled in."""
    return text.replace_characters(text.trim_affixes(c))


def finish(c: Column) -> Column:
    """Underscores, extension, affixes."""
    return text.trim_affixes(text.strip_extension(text.replace_underscores(c)))


def clean_name(name: Column) -> Column:
    """The cleaned file name as one expression."""
    return finish(after_markers(strip_markers(text.basename(name))))


def with_clean(df: DataFrame, name: str = "name") -> DataFrame:
    """Add cleaned and removed (null name: cleaned null, nothing removed)."""
    df = add(df, __base=text.basename(F.col(name)))
    df = add(df, __found=removed_markers(F.col("__base")), __dashed=after_markers(strip_markers(F.col("__base"))))
    flag = F.array(F.struct(F.lit("REVIEW_FLAG").alias("value"), F.lit("whitespace_handling").alias("category"), F.lit(0).alias("position"), F.lit(1.0).alias("confidence")))
    removed = F.when(text.has_loose_underscore(F.col("__dashed")), F.concat("__found", flag)).otherwise(F.col("__found"))
    return add(df, cleaned=finish(F.col("__dashed")), removed=F.coalesce(removed, F.array().cast(REMOVED)).cast(REMOVED)).drop("__base", "__found", "__dashed")
