"""Comparison, updates, records, evaluation, sources and entry points."""

import json
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from filemeta.operators import checks, compare, evaluate, records, resolve, update
from filemeta.plans import app, parse
from filemeta.sources import catalog, sinks
from filemeta.sources import text as scans


def one(spark, field, parsed, original, confidence=None):
    df = spark.createDataFrame([(parsed, original)], "p string, o string")
    return df.select(compare.compare_field(field, F.col("p"), F.col("o"), F.lit(confidence).cast("double")).alias("c")).first().c


@pytest.mark.parametrize(
    "field, p, o, status, advice",
    [
        ("studio", None, None, "no_change", "accept_parsed"), ("studio", None, "x", "no_data", "keep_original"), ("studio", "x", None, "new_data", "accept_parsed"), ("title", "x", None, "new_data", "manual_review"),
        ("studio", "Acme Studio", "ACME Productions", "match", "keep_original"), ("studio", "x", "", "conflict", "manual_review"), ("title", "The Big Blue Bolt", "the big  blue bolt!", "match", "keep_original"),
        ("title", "abcdefghijk", "abcdefghij", "minor_diff", "accept_parsed"), ("studio_code", "ab 12", "AB12", "match", "keep_original"),
        ("date", "2020-01-02", "1/2/2020", "match", "keep_original"), ("date", "2020-1-2", "2020-01-03", "minor_diff", "accept_parsed"), ("date", "2020-01-02", "2020-01-08", "major_diff", "manual_review"),
        ("date", "2020-01-02", "2021", "conflict", "manual_review"), ("date", "soon", "sooner", "conflict", "manual_review"), ("date", "2020-01-02", "2.1.2020", "match", "keep_original"),
    ],
)
def test_compare(spark, field, p, o, status, advice):
    c = one(spark, field, p, o)
    assert (c.status, c.recommendation) == (status, advice)


def test_compare_confidence(spark):
    assert one(spark, "studio", "abcd", "abce", 0.6).confidence == 0.6
    assert one(spark, "date", "soon", "2020-01-01").confidence == 0.0
    assert one(spark, "title", "x", None, 0.9).recommendation == "accept_parsed"


def test_update_never_overwrites(spark):
    df = spark.createDataFrame([("S", "T", "2020-01-01", "C", "own", "  ", None, "x"), ("S", None, None, None, None, None, None, None), (None, "", None, None, None, "t", "d", "c")], "ps string, pt string, pd string, pc string, os string, ot string, od string, oc string")
    cols = lambda x: dict(zip(compare.FIELDS, (F.col(f"{x}s"), F.col(f"{x}t"), F.col(f"{x}d"), F.col(f"{x}c"))))
    rows = [r.u for r in df.select(update.build_update(cols("p"), cols("o"), mark_organized=True).alias("u")).collect()]
    assert [tuple(r) for r in rows] == [(None, "T", "2020-01-01", None, True), ("S", None, None, None, None), (None, None, None, None, None)]
    only = df.select(update.build_update(cols("p"), cols("o"), approved=F.array(F.lit("title"))).alias("u")).first().u
    assert tuple(only) == (None, "T", None, None, None)


def test_resolve_validate_send(spark):
    u = spark.createDataFrame([("1", "Acme", None, None), ("2", "bolt", "x" * 501, None), ("3", "none", None, None), ("4", None, "t", "2020"), ("5", None, "t", "2020-02-01"), (None, None, "t", None)], "id string, studio_name string, title string, date string")
    u = u.withColumns({"code": F.lit(None).cast("string"), "organized": F.lit(None).cast("boolean")})
    s = spark.createDataFrame([("10", "Acme"), ("11", "Acme Two"), ("12", "The Bolt")], "id string, name string")
    v = update.validate(update.resolve_studios(u, s))
    got = {r.id: (r.studio_id, r.outcome) for r in v.collect()}
    assert got == {"1": ("10", "ready"), "2": ("12", "failed"), "3": (None, "skipped"), "4": (None, "failed"), "5": (None, "ready"), None: (None, "failed")}
    assert update.totals(v).first().asDict() == {"processed": 6, "successful": 2, "failed": 3, "skipped": 1}
    assert update.errors(v).count() == 3
    loose = {r.id: r.outcome for r in update.validate(update.resolve_studios(u, s), strict=False).collect()}
    assert loose["4"] == "ready"
    sent = update.send(v.coalesce(1), lambda rows: [r["id"] != "1" for r in rows], pause=0)
    assert {r.id: r.outcome for r in sent.collect() if r.id in ("1", "5")} == {"1": "failed", "5": "done"}

    def broken(rows):
        raise OSError("down")

    assert {r.error for r in update.send(v, broken, pause=0, workers=2).where("id in ('1', '5')").collect()} == {"Bulk update failed: down"}


def test_path_merge(spark):
    df = spark.createDataFrame([("g", "p", 0.5), ("g", "p", 0.9), (None, "p", None), ("g", None, 0.1), ("", "", None)], "g string, p string, c double")
    rows = df.select(resolve.choose(F.col("g"), F.col("p"), F.col("c")).alias("x")).collect()
    assert [(r.x.value, r.x.source, r.x.confidence) for r in rows] == [("p", "path", 0.6), ("g", "filename", 0.9), ("p", "path", 0.6), ("g", "filename", 0.1), (None, None, 0.0)]
    whole = df.select(resolve.resolve({"studio": F.col("g"), "group": F.lit(None).cast("string")}, F.col("p")).alias("x")).collect()[2].x
    assert whole["values"] == {"group": "p"} and whole.sources == {"group": "path"}


def test_default_confidence(spark):
    n = F.lit(None).cast("string")
    r = spark.range(1).select(update.default_confidence(F.lit("s"), n, F.lit(""), F.lit("d")).alias("c")).first()
    assert r.c == {"studio": 0.9, "date": 0.8}


def test_decode_and_files(spark):
    payload = json.dumps({"id": "1", "files": [{"basename": "a.txt"}, {"basename": "long.MP4", "parent_folder_path": "M"}, {"basename": "b.mkv"}], "studio": {"name": "S"}})
    df = records.decode(spark.createDataFrame([(payload,), ('{"id": "2"}',)], "payload string"))
    rows = {r.id: r for r in df.collect()}
    assert rows["2"].files == [] and rows["2"].organized is False and rows["1"].studio.name == "S"
    assert [r.filename for r in records.file_names(df, first=False).collect()] == ["b.mkv"]
    assert [r.filename for r in records.file_names(df).collect()] == ["a.txt"]


def test_report_and_cards(spark):
    df = spark.createDataFrame([("1", "Acme - Big Day.mp4", "<Own>")], "id string, filename string, own_studio string").withColumns({"name": F.col("filename"), "own_title": F.lit(""), "own_date": F.lit(None).cast("string"), "own_code": F.lit(None).cast("string"), "own_performers": F.array(F.lit("A"), F.lit("B"))})
    r = records.report_rows(parse.parse_names(df)).first()
    assert (r.studio, r.title, r.performers) == ("<Own>", "Big Day", "A, B") and r.bold_mask == [False] * 4 + [True, False, True] + [False] * 4
    page = records.cards(spark.createDataFrame([("1", "<Own>")], "id string, studio string").withColumn("cmp_studio", F.struct(F.lit("match").alias("status"))), ["studio"]).first().html
    assert "&lt;Own&gt;" in page and 'class="studio match"' in page
    told = json.loads(parse.parse_names(df).select(records.parsed_json().alias("j")).first().j)
    assert told["token0"] == "Acme" and told["token1"] == "Big Day" and told["tokens"][0]["position"] == 0 and "studio" not in told
    none = json.loads(parse.parse_names(spark.createDataFrame([(None,)], "name string")).select(records.parsed_json().alias("j")).first().j)
    assert none == {"original": None, "cleaned": None, "pattern": "", "tokens": []}
    assert json.loads(parse.parse_names(df).select(records.cleaned_json().alias("j")).first().j)["removed_tokens"] == []
    watched, seen = records.observed(parse.parse_names(df))
    assert watched.count() == 1 and seen.get == {"rows": 1, "without_title": 0}
    assert records.export_row(parse.parse_names(df).select("studio", "sequence", "tokens")).first().sequence == ""


def test_checks(spark):
    d = spark.createDataFrame([(0, "A", "x"), (1, "a", "y"), (2, "b", "X")], "idx int, canonical_name string, alias string")
    assert [tuple(r) for r in checks.duplicate_names(d).collect()] == [("a", 2, 0)]
    assert [tuple(r) for r in checks.alias_collisions(d, "alias", "canonical_name").collect()] == [("x", 2, "A")]
    assert checks.unknown_targets(d, d, "alias", "canonical_name").count() == 3


def test_empty_evaluation(spark):
    none = spark.createDataFrame([], "row_id long, studio string, performers string, date string, studio_code string, title string, sequence string, `group` string, match_rate double")
    assert evaluate.coverage(none).first().asDict()["studio"] == 0.0
    with pytest.raises(ValueError):
        evaluate.pair(none, spark.createDataFrame([(1,)], "row_id long"))


def test_text_scan(spark, tmp_path):
    p = tmp_path / "n.txt"
    p.write_text(" a.mp4 \n\nexceptions\nb.mp4\nc.mp4\n")
    assert [r.name for r in scans.names(spark, str(p), 2).collect()] == ["a.mp4", "b.mp4"]
    assert scans.names(spark, str(p), -1).count() == 3
    (tmp_path / "d.json").write_bytes('{"a": ["é"]}'.encode("cp1252"))
    assert scans.section(spark, str(tmp_path / "d.json"), "a") == ["é"]
    assert scans.dictionary(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "bad.json").write_text("{")
    assert scans.preload(spark, str(tmp_path / "bad.json")) == {str(tmp_path / "bad.json"): False}
    scans.clear()
    (tmp_path / "m.json").write_text('{"key_metrics": {"pattern_match_rate": 24.6}}')
    assert scans.metrics(spark, str(tmp_path / "m.json")) == {"pattern_match_rate": 25}
    (tmp_path / "l.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        scans.labelled(spark, str(tmp_path / "l.csv"))


SCENES = [{"id": str(i), "title": f"T{i:03}", "organized": False, "files": [{"basename": f"Acme - Big Day {i}.mp4", "parent_folder_path": "M"}], "performers": [{"name": "P"}], "studio": None} for i in range(250)]


def fake(query, variables, options):
    if "updateScenes" in query:
        return {"updateScenes": [{"id": r["id"]} for r in variables["input"]]}
    f = variables["filter"]
    rows = SCENES if "findScenes" in query else [{"id": "1", "name": "Acme", "aliases": []}]
    part = rows[(f["page"] - 1) * f["per_page"] : f["page"] * f["per_page"]]
    return {"findScenes": {"count": len(rows), "scenes": [dict(r) for r in part]}} if "findScenes" in query else {"findStudios": {"count": len(rows), "studios": part}}


TRANSPORT = {"transport": "tests.test_records:fake"}


def test_catalogue_source(spark):
    df = catalog.read(spark, **TRANSPORT)
    assert df.count() == 250 and catalog.read(spark, limit="130", **TRANSPORT).count() == 130
    assert catalog.where(df, "title", "EXCLUDES", "t0").count() == 150
    assert catalog.studios_or_static(spark, [("s", "S", False, 0)], log=lambda *_: None, transport="tests.test_records:gone") == [("s", "S", False, 0)]
    catalog.write(df.select("id", "title").limit(30), pause="0", **TRANSPORT)


def test_plugin(spark, tmp_path):
    out = app.run({"config": {"catalogue": TRANSPORT, "report": {"path": str(tmp_path / "r.xlsx"), "limit": 20}}, "args": {"mode": "report"}}, spark)
    assert out["output"]["rows"] == 20
    assert len(app.run({"config": {"catalogue": TRANSPORT, "report": {"limit": "5"}}, "args": {"mode": "list"}}, spark)["output"]) == 5
    assert "error" in app.run({"args": {"mode": "nope"}}, spark)
    assert app.row_limit("x") is None and app.row_limit(-1) is None and app.row_limit("3") == 3


def test_evaluate_cli(spark, tmp_path, capsys):
    (tmp_path / "n.txt").write_text("[Acme] Big Day - 2020-01-02.mp4\nFoo Scene 3.mp4\n")
    assert app.evaluate_cli([str(tmp_path / "n.txt"), "--output", str(tmp_path / "m.json")], spark) == 0
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["total_rows"] == 2 and m["field_coverage"]["date"] == 0.5 and m["field_coverage"]["sequence"] == 0.5
    head = ",".join(scans.LABELLED)
    (tmp_path / "l.csv").write_text(head + "\n" + "a,,,[{token0}] {title} - {date},,Big Day,,2020-01-02,,,,,\nb,,,{token0},,\"Foo, Scene 3\",,,,\"{\"\"scene\"\":3}\",Foo,,\n")
    assert app.evaluate_cli([str(tmp_path / "n.txt"), "--reference", str(tmp_path / "l.csv"), "--output", str(tmp_path / "r.json")], spark) == 0
    key = json.loads((tmp_path / "r.json").read_text())["key_metrics"]
    names, labels = scans.names(spark, str(tmp_path / "n.txt")), scans.labelled(spark, str(tmp_path / "l.csv"))
    sheets = app.evaluation_sheets(*app._by_place(parse.evaluation_rows(names), labels, None))
    assert [x.name for x in sheets] == ["Reference", "Results", "Diff"] and sum(sheets[2].highlight(v) for v in sinks.sheet_rows(sheets[2])[1][0]) == 3
    (tmp_path / "s.json").write_text('[{"canonical_name": "A"}, {"canonical_name": "a"}]')
    assert app.check_cli([str(tmp_path / "s.json")], spark) == 1
    assert key["metadata_false_negative_rate"] == 0.0 and key["pattern_match_rate"] == 100.0


def test_dictionary_checks(spark):
    found = app.check_dictionaries(spark, [{"canonical_name": "A", "aliases": ["x"]}, {"canonical_name": "B^", "aliases": '["X"]'}], [{"studio": "C", "code_patterns": ["(x"]}], {"q": "A"})
    assert len(found["alias_collisions"]) == 1 and len(found["unknown_code_studios"]) == 1 and len(found["bad_rules"]) == 1 and not found["unknown_alias_targets"]


def test_sinks(spark, tmp_path):
    assert str(sinks.report_path(folder="f", now=datetime(2020, 1, 2))) == "f/report-20200102-000000.xlsx"
    with pytest.raises(ValueError):
        sinks.write_workbook("x", [])
    df = spark.createDataFrame([("1", "x" * 99, [True, False])], "a string, b string, m array<boolean>")
    header, cells, bold = sinks.sheet_rows(sinks.Sheet("s", df, bold="m"))
    assert header == ["a", "b"] and bold == [[True, False]] and sinks.widths(header, cells) == [3, 50]
    sinks.write_cards(spark.createDataFrame([("1", "<tr></tr>")], "id string, html string"), str(tmp_path / "c.html"))
    assert "<tr></tr>" in (tmp_path / "c.html").read_text()
    sinks.write_json(df, str(tmp_path / "j"))


def test_merge_config():
    c = app.merge_config({"report": {"limit": 3}, "new": {"a": 1}}, {"batch": 5, "limit": None, "other": 1})
    assert c["report"]["limit"] == 3 and c["update"]["batch"] == 5 and c["new"] == {"a": 1}
    assert SimpleNamespace(**c["catalogue"]).port == "9999"
