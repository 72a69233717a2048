"""Workbooks, labelled sheets, date dictionaries, schema checks."""

import json
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from filemeta.operators import checks, dates
from filemeta.plans import app, parse
from filemeta.sources import sinks, workbook
from filemeta.sources import text as scans


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "d" / "w.xlsx")
    df = spark.createDataFrame([("1", "a < b & \"c\"\n é\x01", 3, None, [True, False, False, False]), ("2", "=1+1 ", -4, 1.5, [])], "id string, b string, n int, x double, bold array<boolean>")
    sinks.write_workbook(path, [sinks.Sheet("One [x]", df, bold="bold", highlight=lambda v: v == -4), sinks.Sheet("Two", df.where("id = '9'").drop("bold"))])
    book = workbook.read(path)
    assert list(book) == ["One  x ", "Two", None]
    assert book["One  x "] == [["id", "b", "n", "x"], ["1", "a < b & \"c\"\n é", 3, None], ["2", "=1+1 ", -4, 1.5]] and book["Two"] == [["id", "b", "n", "x"]] and book[None] is book["One  x "]
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert re.search(r'r="A2" s="1"', sheet) and re.search(r'r="C3" s="2"', sheet) and 'r="B2" t=' in sheet
        assert 'ref="A1:D3"' in z.read("xl/tables/table1.xml").decode() and "xl/tables/table2.xml" not in z.namelist()


def test_column_letters():
    assert [workbook.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook._number(workbook.letters(i) + "7") == i for i in range(2000))


def test_shared_strings_and_gaps(tmp_path):
    path, main = tmp_path / "s.xlsx", workbook.MAIN
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{workbook.OFFICE}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="A" sheetId="1" r:id="x"/><sheet name="B" sheetId="2" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", workbook._relations([]).replace("</Rel", '<Relationship Id="x" Target="/xl/a.xml"/><Relationship Id="y" Target="b.xml"/></Rel'))
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Input</t></si><si><r><t>a.</t></r><r><t>mp4</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/a.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/b.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c><c r="D3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    assert workbook.read(str(path))[None] == [[None, "Input"], [], [None, "a.mp4", 2.5, True]]


def test_names_and_labelled_rows_of_a_workbook(spark, tmp_path, capsys):
    path = str(tmp_path / "l.xlsx")
    rows = [["[Acme] Big Day - 2020-01-02.mp4", None, None, "[{token0}] {title} - {date}", None, "Big Day", None, "2020-01-02"], ["Foo Scene 3.mp4", "", "", "{token0}", None, "Foo, Scene 3", None, None, None, '{"scene":3}', "Foo"]]
    workbook.write(path, [workbook.Grid("Names", ["x", " INPUT "], [[1, r[0]] for r in rows] + [[2, " "]]), workbook.Grid("Reference", scans.LABELLED, rows)])
    assert [r.name for r in scans.workbook_names(spark, path).collect()] == [r[0] for r in rows]
    assert scans.workbook_names(spark, path, "Reference", 1).count() == 1
    found = scans.labelled(spark, path).orderBy("row_id").collect()
    assert [(r.title, r.date, r.sequence, r.studio) for r in found] == [("Big Day", "2020-01-02", None, None), ("Foo, Scene 3", None, {"scene": 3}, None)]
    with pytest.raises(ValueError):
        scans.workbook_names(spark, path, "none")
    with pytest.raises(ValueError):
        scans.labelled(spark, path, "Names")
    out = str(tmp_path / "out.xlsx")
    assert app.evaluate_cli([path, "--reference", path, "--workbook", out], spark) == 0
    key = json.loads(capsys.readouterr().out)["key_metrics"]
    assert key["metadata_false_negative_rate"] == 0.0
    book = workbook.read(out)
    assert [n for n in book if n] == ["Reference", "Results", "Diff"] and book["Results"][1][0] == rows[0][0]


def test_report_is_a_workbook(spark, tmp_path):
    path = tmp_path / "r.xlsx"
    out = app.run({"config": {"catalogue": {"transport": "tests.test_records:fake"}, "report": {"path": str(path), "limit": 3}}, "args": {"mode": "report"}}, spark)
    assert out["output"] == {"report": str(path), "rows": 3} and len(workbook.read(str(path))["Report"]) == 4


DATES = {
    "month_pattern": "(Jan(?:uar)?|Mai)", "month_names": {"jan": "01", "januar": "01", "mai": "05"},
    "patterns": [{"regex": "(?P<day>\\d{1,2})\\. (?P<month_name>MONTH_PATTERN) (?P<year>\\d{4})", "type": "de"}, {"regex": "(", "type": "bad"}, {"regex": "(?P<day>\\d)", "type": "no year"}, {}, {"regex": "Y(?P<year>\\d{4})", "type": "y"}],
}


def test_date_shapes_of_a_dictionary(spark):
    shapes = dates.compile_shapes(DATES)
    assert [s[0] for s in shapes] == ["de", "y"]
    df = spark.createDataFrame([("am 3. Januar 2020 hier",), ("14. mai 1850",), ("in Y3021",), ("2020-01-02",), (None,)], "v string")
    assert [r.d for r in df.select(dates.iso_date(F.col("v"), shapes).alias("d")).collect()] == ["2020-01-03", "1850-05-14", "3021", None, None]
    parsed = parse.parse_names(spark.createDataFrame([("Foo am 3. Januar 2020 hier.mp4",)], "name string"), shapes=shapes).first()
    assert [t.value for t in parsed.tokens if t.type == "date"] == ["2020-01-03"]
    assert dates.compile_shapes(None) == [] and df.select(dates.iso_date(F.col("v"), []).alias("d")).where("d is not null").count() == 0


def test_encodings_in_order(spark, tmp_path):
    (tmp_path / "d.json").write_bytes(b'["\x80\xe9"]')
    assert scans.dictionary(spark, str(tmp_path / "d.json"), cache=False) == ["\x80é"]


def test_schema_errors_in_order_of_paths():
    rows = [{"canonical_name": "A", "aliases": ["x", 3]}, {"canonical_name": ""}, "B", {"url": 4, "more": 1}] + [{"canonical_name": "C"}] * 7 + [{"canonical_name": None}]
    found = checks.schema_errors(rows, checks.STUDIO_SCHEMA, "studios")
    assert [x.split(": ")[1] for x in found] == ["0 > aliases", "1 > canonical_name", "2", "3", "3", "3 > url", "11 > canonical_name"]
    assert checks.schema_errors({}, checks.STUDIO_SCHEMA, "s") == ["s: root: {} is not of type array"] and checks.schema_errors([], checks.STUDIO_SCHEMA, "s") == []
    rich = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 2}, "s": {"pattern": "^a"}, "e": {"enum": [1]}, "l": {"maxItems": 1}, "o": {"anyOf": [{"type": "null"}, {"type": "string", "minLength": 2}]}}, "additionalProperties": {"type": "boolean"}}
    assert checks.schema_errors({"n": 2, "s": "ab", "e": 1, "l": [1], "o": None, "z": True}, rich, "r") == []
    assert len(checks.schema_errors({"n": 1, "s": "b", "e": 2, "l": [1, 2], "o": "x", "z": 1}, rich, "r")) == 6


def test_check_cli_reads_schemas(spark, tmp_path, capsys):
    for name, value in (("s", [{"canonical_name": "A", "x": 1}]), ("d", {"a": 1}), ("schema", {"required": ["b"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert app.check_cli([str(tmp_path / "s.json"), "--dictionary", str(tmp_path / "d.json"), "--schema", str(tmp_path / "schema.json")], spark) == 1
    told = capsys.readouterr().out
    assert "'x' is not allowed" in told and "'b' is missing" in told
