"""Stage 2: cut a cleaned name into tokens.

A token is (value, type, position, lead). position is the 0-based code point of its first character; lead is the
literal text of the structural pattern before its placeholder, so the pattern is never stored: render() makes it from
the tokens and the text behind the last (tail). Stages that split or relabel tokens leave the rest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from .barrier import add, unpack

TOKEN = "struct<value:string,type:string,position:int,lead:string>"
TOKENS = f"array<{TOKEN}>"
#: Wrapped runs, runs without wrappers, stray wrapper characters; nothing is left over, so lengths give offsets.
SEGMENT = r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|[^{}\[\]()]+|[{}\[\]()]"
DASH = r"(?U)\s-\s|\s-|-\s"
#: Types whose placeholder shows the type itself.
NAMED = ["date", "studio", "studio_code", "performers", "title"]


def segments(cleaned: Column) -> Column:
    return F.regexp_extract_all(cleaned, F.lit(SEGMENT), F.lit(0))


def _piece(tok: Column | bool, value: Column, kind: Column | str, at: Column, pre: Column | str, post: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(tok).alias("tok"), value.alias("value"), lit(kind).alias("kind"), at.cast("int").alias("at"), lit(pre).alias("pre"), lit(post).alias("post"))


def _run(part: Column, at: Column, wrap: tuple[str, str] | None, kind: str) -> Column:
    """A wrapped or plain run: a token, or for plain blanks a literal."""
    value = text.strip(part)
    lead = F.length(part) - F.length(text.lstrip(part))
    if wrap:
        return _piece(value != "", value, kind, at + 1 + lead, wrap[0], wrap[1])
    return F.when(value != "", _piece(True, value, kind, at + lead, F.repeat(F.lit(" "), lead), F.repeat(F.lit(" "), F.length(part) - F.length(text.rstrip(part))))).otherwise(
        _piece(False, part, "lit", at, "", "")
    )


def pieces(cleaned: Column) -> Column:
    """Tokens, dashes and blanks of a name in order, as structs (tok, value, kind, at, pre, post)."""

    def of_segment(segs: Column):
        def make(seg: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(segs, 1, i), F.lit(0), lambda a, s: a + F.length(s))
            inner = F.substring(seg, F.lit(2), F.length(seg) - 2)
            parts, dashes = F.split(seg, DASH, -1), F.regexp_extract_all(seg, F.lit(DASH), F.lit(0))

            def plain(p: Column, k: Column) -> Column:
                at = start + F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice(dashes, 1, k), F.lit(0), lambda a, s: a + F.length(s))
                dash = F.coalesce(F.get(dashes, k), F.lit(""))
                return F.array(_run(p, at, None, "text"), _piece(False, dash, "lit", at, "", ""))

            wrapped = lambda w, kind: F.array(_run(inner, start, w, kind))
            return (
                F.when(F.length(seg) < 2, F.when(seg.rlike(r"^[^{}\[\]()]"), F.flatten(F.transform(parts, plain))))
                .when(seg.startswith("[") & seg.endswith("]"), wrapped(("[", "]"), "bracket"))
                .when(seg.startswith("(") & seg.endswith(")"), wrapped(("(", ")"), "parenthesis"))
                .when(seg.startswith("{") & seg.endswith("}"), wrapped(("{", "}"), "curly"))
                .otherwise(F.flatten(F.transform(parts, plain)))
            )

        return F.filter(F.flatten(F.filter(F.transform(segs, make), lambda x: x.isNotNull())), lambda p: p.tok | ((p.kind == "lit") & (p.value != "")))

    return text.let(segments(cleaned), of_segment)


def fold(found: Column) -> Column:
    """Pieces to (tokens, tail): literals go to the lead of the next token; junk becomes the literal {junk}."""
    junk = F.array(*(F.lit(j) for j in values.JUNK))
    start = F.struct(F.array().cast(TOKENS).alias("tokens"), F.lit("").alias("tail"))

    def step(acc: Column, p: Column) -> Column:
        token = F.struct(text.trim_affixes(p.value).alias("value"), p.kind.alias("type"), p["at"].alias("position"), F.concat(acc.tail, p.pre).alias("lead"))
        return (
            F.when(~p.tok, F.struct(acc.tokens.alias("tokens"), F.concat(acc.tail, p.value).alias("tail")))
            .when(F.array_contains(junk, p.value), F.struct(acc.tokens.alias("tokens"), F.concat(acc.tail, p.pre, F.lit("{junk}"), p.post).alias("tail")))
            .otherwise(F.struct(F.concat(acc.tokens, F.array(token)).alias("tokens"), p.post.alias("tail")))
        )

    return F.aggregate(F.coalesce(found, F.array().cast("array<struct<tok:boolean,value:string,kind:string,at:int,pre:string,post:string>>")), start, step)


def tokenize(cleaned: Column) -> Column:
    """(tokens, tail) of a cleaned name, the pattern's ends stripped."""

    def ends(x: Column) -> Column:
        first = F.get(x.tokens, F.lit(0))
        kept = F.concat(F.array(first.withField("lead", text.lstrip(first.lead))), F.slice(x.tokens, 2, F.greatest(F.size(x.tokens) - 1, F.lit(0))))
        return F.struct(F.when(F.size(x.tokens) > 0, kept).otherwise(x.tokens).alias("tokens"), F.when(F.size(x.tokens) > 0, text.rstrip(x.tail)).otherwise(text.strip(x.tail)).alias("tail"))

    return text.let(fold(pieces(cleaned)), ends)


def with_tokens(df: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    """Add tokens and tail; a path in front becomes a path token (names that went through stage 1 have none)."""
    df = unpack(df, text.split_path(F.col(cleaned)), "__name", "__path", "__separator")
    df = unpack(df, tokenize(F.col("__name")), "__tokens", "__tail")
    path = F.struct(F.col("__path").alias("value"), F.lit("path").alias("type"), F.lit(0).alias("position"), F.lit("").alias("lead")).cast(TOKEN)
    after = F.transform("__tokens", lambda t, i: t.withField("lead", F.when(i == 0, F.concat("__separator", t.lead)).otherwise(t.lead)))
    has = F.coalesce(F.col("__path") != "", F.lit(False))
    tail = F.when(has & (F.size("__tokens") == 0), F.concat("__separator", "__tail")).otherwise(F.col("__tail"))
    return add(df, tokens=F.when(has, F.concat(F.array(path), after)).otherwise(F.col("__tokens")).cast(TOKENS), tail=tail).drop("__name", "__path", "__separator", "__tokens", "__tail")


def placeholder(token: Column, index: Column) -> Column:
    return F.when(token.type == "path", "{path}").when(token.type.isin(NAMED), F.concat(F.lit("{"), token.type, F.lit("}"))).otherwise(F.concat(F.lit("{token"), index.cast("string"), F.lit("}")))


def render(tokens: Column, tail: Column) -> Column:
    """The structural pattern: leads and placeholders; numbers count all tokens but the path, named ones included."""
    shift = F.when(F.get(tokens, F.lit(0)).type == "path", 1).otherwise(0)
    return text.let(shift, lambda s: F.concat(F.array_join(F.transform(tokens, lambda t, i: F.concat(t.lead, placeholder(t, i - s))), ""), tail))


def show(tokens: Column) -> Column:
    """type:value@position, joined by pipes; for reports and comparisons."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t.type, F.lit(":"), t.value, F.lit("@"), t.position.cast("string"))), "|")
