"""The catalogue source: what the server is asked for, by a transport that notes each call in a file."""

import json
import os

import pytest
from pyspark.sql import functions as F

from filemeta.operators import studios
from filemeta.sources import catalog

ROWS = [{"id": str(i), "title": f"T{i:03}", "organized": i % 2 == 1, "files": [], "performers": [], "studio": {"id": "1", "name": "Acme"}} for i in range(250)]
STUDIOS = [{"id": "1", "name": "Acme", "aliases": ["ACM", None]}, {"id": "2", "name": "Acme Gold", "aliases": None}, {"id": "3", "name": "Bolt", "aliases": ["acm"]}]


def server(query, variables, options):
    with open(options["notes"], "a") as f:
        f.write(json.dumps(variables) + "\n")
    if "updateScenes" in query:
        if any(r["id"] == "13" for r in variables["input"]):
            raise OSError("down")
        return {"updateScenes": [{"id": r["id"]} for r in variables["input"] if r["id"] != "7"]}
    where, f = variables["where"], variables["filter"]
    if "findStudios" in query:
        name = where.get("name")
        rows = [s for s in STUDIOS if not name or (s["name"] == name["value"] if name["modifier"] == "EQUALS" else name["value"].lower() in s["name"].lower())]
        return {"findStudios": {"count": len(rows), "studios": rows[(f["page"] - 1) * f["per_page"] : f["page"] * f["per_page"]]}}
    rows = [r for r in ROWS if where.get("organized") in (None, r["organized"]) and ("ids" not in where or int(r["id"]) in where["ids"]["value"])]
    return {"findScenes": {"count": len(rows), "scenes": [dict(r) for r in rows[(f["page"] - 1) * f["per_page"] : f["page"] * f["per_page"]]]}}


@pytest.fixture
def source(tmp_path):
    log = tmp_path / "calls"
    log.touch()
    options = {"transport": "tests.test_catalogue:server", "notes": str(log)}

    def calls():
        found = [json.loads(x) for x in log.read_text().splitlines()]
        os.truncate(log, 0)
        return found

    return options, calls


def test_any_record_is_found_by_id(spark, source):
    options, calls = source
    for i in ("7", "8"):
        row = catalog.find(spark, i, **options).first()
        assert (row.id, row.organized, row.studio.name) == (i, i == "7", "Acme")
        assert [c["where"] for c in calls()] == [{"ids": {"value": [int(i)], "modifier": "INCLUDES"}}]
    assert catalog.find(spark, "999", **options).count() == 0 and catalog.find(spark, "x", **options).count() == 0
    assert catalog.find(spark, "7", transport="tests.test_catalogue:gone", notes="").count() == 0


def test_ids_are_pushed_in_blocks(spark, source, monkeypatch):
    options, calls = source
    assert {r.id for r in catalog.find_many(spark, ["3", "8", "x", "3", "999"], **options).collect()} == {"3", "8"}
    assert [c["where"] for c in calls()] == [{"ids": {"value": [3, 8, 999], "modifier": "INCLUDES"}}]
    assert catalog.find_many(spark, [str(i) for i in range(230)], **options).count() == 230
    assert sorted(len(c["where"]["ids"]["value"]) for c in calls()) == [30, 100, 100]
    assert catalog.find_many(spark, [], **options).count() == 0 and calls() == []


def test_filters_on_columns_are_pushed(spark, source):
    options, calls = source
    df = catalog.read(spark, organized="any", **options)
    assert df.count() == 250 and all("organized" not in c["where"] for c in calls())
    assert [r.title for r in df.where("id = '7'").collect()] == ["T007"]
    assert {tuple(c["where"]["ids"]["value"]) for c in calls()} == {(7,)}
    assert df.where(F.col("id").isin("4", "5", "6")).count() == 3
    assert {tuple(sorted(c["where"]["ids"]["value"])) for c in calls()} == {(4, 5, 6)}
    assert df.where("organized").count() == 125
    assert all(c["where"]["organized"] is True for c in calls())
    assert df.where("not organized").count() == 125
    assert catalog.read(spark, **options).count() == 125
    named = catalog.read(spark, kind="studios", **options)
    calls()
    assert [r.id for r in named.where("name = 'Bolt'").collect()] == ["3"]
    assert all(c["where"] == {"name": {"value": "Bolt", "modifier": "EQUALS"}} for c in calls())


def test_studios_by_name(spark, source):
    options, calls = source
    assert catalog.studio_by_name(spark, "Acme Gold", **options).first().id == "2"
    assert catalog.studio_by_name(spark, "cme", exact=False, **options).first().id == "1"
    assert catalog.studio_by_name(spark, "none", **options).count() == 0
    assert {c["where"]["name"]["modifier"] for c in calls()} == {"EQUALS", "INCLUDES"}


def test_dimension_from_the_catalogue(spark, source):
    options, _ = source
    dim = studios.last_wins(catalog.studios_or_static(spark, [], **options))
    got = sorted((r.key, r.canonical) for r in dim.collect())
    assert got == sorted((k, c) for k, c, *_ in studios.rows_from_catalogue(STUDIOS))


def test_a_failed_batch_stops_no_other_and_is_told(spark, source):
    options, calls = source
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(20)], "id string, title string").coalesce(1)
    with pytest.raises(Exception, match=r"6 of 20 updates failed: .*7: no result for the row; 10: bulk update failed: down"):
        catalog.write(rows, batch="5", pause="0", **options)
    assert [len(c["input"]) for c in calls()] == [5, 5, 5, 5]
    catalog.write(rows.where("id < 7"), pause="0.01", batch="3", **options)
