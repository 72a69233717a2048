"""Catalogue records: files, existing values, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, values

RECORD = (
    "id string, title string, date string, code string, studio struct<id:string,name:string,aliases:array<string>>, "
    "files array<struct<id:string,path:string,basename:string,parent_folder_path:string>>, performers array<struct<id:string,name:string>>, "
    "tags array<map<string,string>>, organized boolean"
)


def decode(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON records to columns; what is missing gets its default: empty lists, not organized."""
    df = df.select(*(c for c in df.columns if c != payload), F.from_json(payload, RECORD).alias("__r")).select(*(c for c in df.columns if c != payload), "__r.*")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    empty = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("files", "performers", "tags") if isinstance(kinds[c], T.ArrayType)}
    return df.withColumns(empty | {"organized": F.coalesce("organized", F.lit(False))})


def primary_file(files: Column, first: bool = True) -> Column:
    """The first file, or the best: of known video files the one of the shortest name, the first of ties; else the
    first."""
    if first:
        return F.try_element_at(files, F.lit(1))
    video = lambda f: F.lower(f.basename).rlike("(?:" + "|".join(text.literal(e) for e in values.VIDEO_ENDINGS) + r")\z")
    ranked = F.array_min(F.transform(F.filter(F.transform(files, lambda f, i: F.struct(F.length(f.basename).alias("n"), i.alias("i"), video(f).alias("v"))), lambda x: x.v), lambda x: F.struct(x.n.alias("n"), x.i.alias("i"))))
    return F.coalesce(F.get(files, ranked.i), F.try_element_at(files, F.lit(1)))


def file_name(file: Column, with_path: bool = False) -> Column:
    has = F.coalesce(file.parent_folder_path, F.lit("")) != ""
    return F.when(has, F.concat(file.parent_folder_path, F.lit("/"), file.basename)).otherwise(file.basename) if with_path else file.basename


def file_names(df: DataFrame, with_path: bool = False, first: bool = True) -> DataFrame:
    """(id, filename) of the records that have a file with a name."""
    return df.select("id", file_name(primary_file(F.col("files"), first), with_path).alias("filename")).where(F.coalesce("filename", F.lit("")) != "")


def existing_or_parsed(existing: Column, parsed: Column) -> Column:
    return F.when(text.blank(existing), parsed).otherwise(existing)


REPORT = ["id", "filename", "cleaned", "pattern", "studio", "title", "performers", "date", "studio_code", "sequence", "group"]


def report_rows(df: DataFrame) -> DataFrame:
    """The eleven report columns and bold_mask, which marks values that the record already had. df: a parsed frame
    (see plans.parse) with id, filename and the record's own_studio, own_title, own_date, own_code and own_performers
    (an array of names). Blank values count as absent."""
    own_people = F.array_join(F.filter("own_performers", lambda p: ~text.blank(p)), ", ")
    own = {"studio": F.col("own_studio"), "title": F.col("own_title"), "performers": own_people, "date": F.col("own_date"), "studio_code": F.col("own_code")}
    parsed = {"studio": F.col("studio"), "title": F.col("title"), "performers": F.col("performers"), "date": _first_date(), "studio_code": F.col("studio_code")}
    shown = {k: existing_or_parsed(own[k], parsed[k]).alias(k) for k in own}
    bold = F.array(*(~text.blank(own[c]) if c in own else F.lit(False) for c in REPORT)).alias("bold_mask")
    plain = {"sequence": F.to_json("sequence").alias("sequence")}
    return df.select(*(shown.get(c, plain.get(c, F.col(c))) for c in REPORT), bold)


def _first_date() -> Column:
    return F.get(F.filter("tokens", lambda t: t.type == "date"), F.lit(0)).value


def cleaned_json() -> Column:
    """A cleaned name as JSON: original, cleaned, removed_tokens."""
    return F.to_json(F.struct(F.col("name").alias("original"), "cleaned", F.col("removed").alias("removed_tokens")), {"ignoreNullFields": "false"})


def _joined(*objects: Column) -> Column:
    """Flat JSON objects as one; empty and null ones add nothing."""
    inner = F.transform(F.array(*objects), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
    return F.concat(F.lit("{"), F.array_join(F.filter(inner, lambda x: x != ""), ","), F.lit("}"))


def parsed_json() -> Column:
    """A parse as JSON: original, cleaned, pattern, tokens, each token's value under tokenN (a path's under path), and
    the studio if there is one. Title, sequence, group and code are columns, not part of it."""
    shift = F.when(F.get("tokens", F.lit(0)).type == "path", 1).otherwise(0)
    listed = F.transform("tokens", lambda t: F.struct(t.value.alias("value"), t.type.alias("type"), t.position.alias("position")))
    base = F.to_json(F.struct(F.col("name").alias("original"), "cleaned", "pattern", listed.alias("tokens")), {"ignoreNullFields": "false"})
    named = F.transform("tokens", lambda t, i: F.struct(F.when(t.type == "path", "path").otherwise(F.concat(F.lit("token"), (i - shift).cast("string"))).alias("k"), t.value.alias("v")))
    studio = F.when(~text.blank(F.col("studio")), F.to_json(F.struct("studio")))
    return _joined(base, F.to_json(F.map_from_entries(named)), studio)


def observed(df: DataFrame, name: str = "progress"):
    """(df, observation): rows, and rows without a title, counted as a job over df runs; for logs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("title").isNull()).alias("without_title")), seen


def export_row(df: DataFrame) -> DataFrame:
    """All columns as text for a sheet: null becomes '', maps, structs and arrays JSON."""
    flat = (T.MapType, T.StructType, T.ArrayType)
    return df.select(*(F.coalesce(F.to_json(f.name) if isinstance(f.dataType, flat) else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields))


def scene_list(df: DataFrame, by: str = "filename") -> DataFrame:
    """Rows in order of filename, studio or date, absent values first as ''; ties by id."""
    return df.orderBy(F.coalesce(by if by in ("studio", "date") else "filename", F.lit("")), "id")


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cards(df: DataFrame, fields: list[str]) -> DataFrame:
    """(id, html): a review card per row, values escaped; the class of a cell is its field's comparison status."""
    cell = lambda f: F.concat(F.lit(f'<td class="{f} '), F.coalesce(F.col(f"cmp_{f}").status, F.lit("none")), F.lit('">'), escape(F.coalesce(F.col(f), F.lit(""))), F.lit("</td>"))
    return df.select("id", F.concat(F.lit('<tr class="card" data-id="'), escape(F.col("id")), F.lit('">'), *(cell(f) for f in fields), F.lit("</tr>")).alias("html"))


