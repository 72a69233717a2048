"""A catalogue server as a Spark data source: one input partition a page, filters and limit pushed to the server.

Options: scheme, host, port, cookie, api_key; kind (scenes or studios); studio_ids (comma list; what is no integer is
dropped), organized (true, false, which is the default, or any), ids (comma list of whole numbers, read PER_CALL at a
time, a partition each), name and modifier (of studios: EQUALS or INCLUDES), per_page, limit, query and variables (a
raw query, one row); transport, a `module:function` that gets (query, variables, options) and returns the `data` part
of an answer, in place of HTTP. Of filters on columns, `id = ...`, `id IN (...)`, `organized` and `NOT organized` of
scenes and `name = ...` of studios go to the server.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, Not, WriterCommitMessage

from ..operators import records

# Connection defaults and page size.
DEFAULTS = {"scheme": "http", "host": "localhost", "port": "9999", "cookie": "", "api_key": "", "per_page": "100"}
SCENES = "query($filter: FindFilterType, $where: SceneFilterType) { findScenes(filter: $filter, scene_filter: $where) { count scenes { id title date code organized studio { id name aliases } files { id path basename parent_folder { path } } performers { id name } tags { id name } } } }"
STUDIOS = "query($filter: FindFilterType, $where: StudioFilterType) { findStudios(filter: $filter, studio_filter: $where) { count studios { id name aliases } } }"
STUDIO = "id string, name string, aliases array<string>"
#: Ids that one call asks for.
PER_CALL = 100
UPDATE = "mutation($input: [BulkUpdateInput!]!) { updateScenes(input: $input) { id } }"


def call(query: str, variables: dict, options: dict):
    """The data of an answer, by the transport or over HTTP."""
    if options.get("transport"):
        module, _, name = options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)(query, variables, options)
    o = DEFAULTS | options
    headers = {"Content-Type": "application/json"} | ({"ApiKey": o["api_key"]} if o["api_key"] else {}) | ({"Cookie": f"session={o['cookie']}"} if o["cookie"] else {})
    request = urllib.request.Request(f"{o['scheme']}://{o['host']}:{o['port']}/graphql", json.dumps({"query": query, "variables": variables}).encode(), headers)
    with urllib.request.urlopen(request, timeout=60) as answer:
        got = json.load(answer)
    if got.get("errors"):
        raise RuntimeError(str(got["errors"]))
    return got["data"]


def _numbers(given: str) -> list[int]:
    return [int(x) for x in given.split(",") if x.strip().isdigit()]


def _where(options: dict) -> dict:
    """The server's filter. Records are asked for by id whether organized or not."""
    if options.get("kind") == "studios":
        return {"name": {"value": options["name"], "modifier": options.get("modifier", "EQUALS")}} if options.get("name") else {}
    where: dict = {}
    if "ids" in options:
        where["ids"] = {"value": _numbers(options["ids"]), "modifier": "INCLUDES"}
    if (organized := options.get("organized") or ("any" if "ids" in options else "false")) != "any":
        where["organized"] = organized == "true"
    if studios := _numbers(options.get("studio_ids", "")):
        where["studios"] = {"value": list(map(str, studios)), "modifier": "INCLUDES"}
    return where


def page(options: dict, number: int, size: int) -> dict:
    """{count, rows} of a page, pages counted from 1, ordered on the server."""
    kind = options.get("kind", "scenes")
    sort = {"page": number, "per_page": size, "sort": "title" if kind == "scenes" else "name", "direction": "ASC"}
    if kind == "studios":
        got = call(STUDIOS, {"filter": sort, "where": _where(options)}, options)["findStudios"]
        return {"count": got["count"], "rows": got["studios"]}
    got = call(SCENES, {"filter": sort, "where": _where(options)}, options)["findScenes"]
    for s in got["scenes"]:
        for f in s.get("files") or []:
            f["parent_folder_path"] = f.get("parent_folder_path") or (f.pop("parent_folder", None) or {}).get("path")
    return {"count": got["count"], "rows": got["scenes"]}


class Page(InputPartition):
    def __init__(self, number: int, take: int, ids: str | None = None):
        self.number, self.take, self.ids = number, take, ids


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def pushFilters(self, filters):
        studios, ids = self.options.get("kind") == "studios", None
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, EqualTo) and inner.attribute == ("organized",) and not studios:
                self.options["organized"] = str(bool(inner.value) != isinstance(f, Not)).lower()
            elif isinstance(f, EqualTo) and f.attribute == ("name",) and studios:
                self.options |= {"name": str(f.value), "modifier": "EQUALS"}
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("id",) and not studios:
                found = [f.value] if isinstance(f, EqualTo) else list(f.value)
                ids = found if ids is None else [x for x in ids if x in found]
            yield f  # Spark filters again: the server's reading of a filter need not be ours
        if ids is not None:
            given = self.options.get("ids")
            self.options["ids"] = ",".join(str(x) for x in ids if given is None or str(x) in given.split(","))

    def partitions(self):
        if self.options.get("query"):
            return [Page(0, 1)]
        limit = int(self.options.get("limit", 0) or 0)
        if "ids" in self.options:
            ids = list(dict.fromkeys(_numbers(self.options["ids"])))[: limit if limit > 0 else None]
            return [Page(1, PER_CALL, ",".join(map(str, ids[i : i + PER_CALL]))) for i in range(0, len(ids), PER_CALL)] or [Page(1, 0)]
        size = int(self.options.get("per_page", DEFAULTS["per_page"]))
        total = page(self.options, 1, 1)["count"]
        total = min(total, limit) if limit > 0 else total
        return [Page(i + 1, min(size, total - i * size)) for i in range(-(-total // size))] or [Page(1, 0)]

    def read(self, part):
        if self.options.get("query"):
            yield (json.dumps(call(self.options["query"], json.loads(self.options.get("variables", "{}")), self.options)),)
            return
        options, size = self.options, int(self.options.get("per_page", DEFAULTS["per_page"]))
        if part.ids is not None:
            options, size = options | {"ids": part.ids}, PER_CALL
        if part.take:
            for row in page(options, part.number, size)["rows"][: part.take]:
                yield (json.dumps(row), *(str(row[c]) if isinstance(row.get(c), int) and c == "id" else row.get(c) for c in self.columns))


class Message(WriterCommitMessage):
    def __init__(self, sent: int, failed: list[tuple[str, str]]):
        self.sent, self.failed = sent, failed


class Writer(DataSourceWriter):
    """Sends rows (id, and any of title, date, code, studio_id, organized) in batches with a pause between; nulls are not
    sent. A batch that fails stops no other; a row without an answer has failed; failures are reported when all is
    sent."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, rows):
        size, pause = int(self.options.get("batch", "20")), float(self.options.get("pause", "0.5"))
        sent, failed, batch, first = 0, [], [], True

        def send() -> int:
            nonlocal first
            if not first and pause:
                time.sleep(pause)
            first = False
            try:
                answers = call(UPDATE, {"input": batch}, self.options)["updateScenes"] or []
            except Exception as e:  # noqa: BLE001  the batch fails, the others go on
                failed.extend((str(r.get("id")), f"bulk update failed: {e}") for r in batch)
                return 0
            got = {str(x["id"]) for x in answers if x}
            failed.extend((str(r.get("id")), "no result for the row") for r in batch if str(r.get("id")) not in got)
            return sum(str(r.get("id")) in got for r in batch)

        for r in rows:
            batch.append({k: v for k, v in r.asDict().items() if v is not None})
            if len(batch) == size:
                sent, batch = sent + send(), []
        if batch:
            sent += send()
        return Message(sent, failed)

    def commit(self, messages):
        failed = [x for m in messages if m for x in m.failed]
        if failed:
            told = "; ".join(f"{i}: {why}" for i, why in failed[:20])
            raise RuntimeError(f"{len(failed)} of {len(failed) + sum(m.sent for m in messages if m)} updates failed: {told}")


class Catalogue(DataSource):
    """format("filemeta_catalogue"): a JSON payload a row, and beside it the columns that filters are pushed by."""

    @classmethod
    def name(cls):
        return "filemeta_catalogue"

    def schema(self):
        if self.options.get("query"):
            return "payload string"
        return "payload string, id string, name string" if self.options.get("kind") == "studios" else "payload string, id string, organized boolean"

    def reader(self, schema):
        return Reader(self.options, [f.name for f in schema.fields][1:])

    def writer(self, schema, overwrite):
        return Writer(self.options)


def read(spark: SparkSession, **options: str) -> DataFrame:
    """Records of a catalogue, decoded; kind="studios" gives (id, name, aliases)."""
    spark.dataSource.register(Catalogue)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader with pushFilters() is refused
    df = spark.read.format("filemeta_catalogue").options(**options).load()
    if options.get("query"):
        return df
    # The pushed columns stay the source's own, so that filters on them reach it.
    if options.get("kind") == "studios":
        return df.select("id", "name", F.from_json("payload", STUDIO).aliases.alias("aliases"))
    found = records.decode(df.select(F.col("id").alias("__id"), F.col("organized").alias("__organized"), "payload"))
    own = {"id": F.col("__id").alias("id"), "organized": F.col("__organized").alias("organized")}
    return found.select(*(own.get(c, F.col(c)) for c in found.columns if not c.startswith("__")))


def write(df: DataFrame, **options: str) -> None:
    """Send updates; RuntimeError, with the first failures, if any failed. update.send() gives an outcome a row."""
    df.sparkSession.dataSource.register(Catalogue)
    df.write.format("filemeta_catalogue").options(**options).mode("append").save()


def find(spark: SparkSession, id: str, **options: str) -> DataFrame:
    """The record of an id, organized or not; none if there is none or the catalogue cannot be read."""
    try:
        rows = read(spark, ids=id, **options).where(F.col("id") == id).limit(1).collect()  # one row, read here so that errors show here
    except Exception:  # noqa: BLE001
        rows = []
    return spark.createDataFrame(rows, records.RECORD)


def find_many(spark: SparkSession, ids: list[str], **options: str) -> DataFrame:
    """The records of these ids, organized or not; the server is asked for them alone. What is no whole number is no id."""
    return read(spark, ids=",".join(dict.fromkeys(map(str, ids))), **options)


def studio_by_name(spark: SparkSession, name: str, exact: bool = True, **options: str) -> DataFrame:
    """The studio of a name, or with exact off the first by name that holds it; the server looks for it."""
    found = read(spark, kind="studios", name=name, modifier="EQUALS" if exact else "INCLUDES", **options)
    hit = F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower()))
    return found.where(hit).orderBy("name", "id").limit(1)


def studios_or_static(spark: SparkSession, static: list[tuple], log=print, **options: str) -> DataFrame | list[tuple]:
    """The catalogue's studios as a dimension; the static rows if it cannot be read."""
    from ..operators import studios

    try:
        found = read(spark, kind="studios", **options)
        found.limit(1).collect()  # an error shows here
        return studios.from_catalogue(found)
    except Exception as e:  # noqa: BLE001
        log(f"studios are static: {e}")
        return static


#: Comparisons that a filter on a column may use, an extension of equality and inclusion.
MODIFIERS = {
    "EQUALS": lambda c, v: c == v, "NOT_EQUALS": lambda c, v: c != v, "INCLUDES": lambda c, v: F.contains(F.lower(c), F.lower(F.lit(v))),
    "EXCLUDES": lambda c, v: ~F.contains(F.lower(c), F.lower(F.lit(v))), "IS_NULL": lambda c, v: c.isNull(), "NOT_NULL": lambda c, v: c.isNotNull(),
    "MATCHES_REGEX": lambda c, v: c.rlike(v), "NOT_MATCHES_REGEX": lambda c, v: ~c.rlike(v),
}


def where(df: DataFrame, column: str, modifier: str, value: str | None = None) -> DataFrame:
    return df.where(MODIFIERS[modifier](F.col(column), value))
