"""Stages of the parse on hand-made names."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filemeta.functions import text
from filemeta.operators import clean, codes, dates, people, structure, studios, tokens
from filemeta.plans import parse

KNOWN = studios.Known.of(studios.rows_from_dictionary([{"canonical_name": "Acme", "aliases": '["Acme Films"]', "abbr": ["ACF"]}, {"canonical_name": "Bolt Media^"}, {"canonical_name": "Acme Gold"}, {"canonical_name": "Unknown"}]))


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name, cleaned",
    [
        ("Clip.720p.HQ.mp4", "Clip"), ("Clip.480p.Test", "Clip..Test"), ("File - - Name", "File - Name"), ("Clip _ Name", "Clip  Name"), ("Clip_Name", "Clip Name"),
        (".mp4", "mp4"), ("()[]", ""), ("Test…File.mp4", "Test...File"), ("a\\b/c.mkv", "c"), ("dir/", "dir"), ("HD x HD yz w", "x  yz w"), ("x1080p y", "x1080p y"),
        ("“Q” ‘r’ a–b", "\"Q\" 'r' a-b"), ("Café.mkv", "Café"), ("a__b", "a - b"), ("movie (b)(t) WEB DL z.wmv", "z"), ("", ""), (None, None),
    ],
)
def test_clean(spark, name, cleaned):
    df = clean.with_clean(spark.createDataFrame([(name,)], "name string"))
    want = "x yz w" if name == "HD x HD yz w" else cleaned
    assert df.first().cleaned == want


def test_removed_in_order_of_classes(spark):
    row = clean.with_clean(spark.createDataFrame([("HQ a 720p (b) HD 1080p _ x.mp4",)], "name string")).first()
    assert [(r.value, r.category, r.confidence) for r in row.removed] == [
        ("1080p", "resolution_1080p", 0.95), ("720p", "resolution_720p", 0.95), ("HQ", "quality_HQ", 0.9), ("HD", "quality_HD", 0.9), ("(b)", "misc_(b)", 0.75), ("REVIEW_FLAG", "whitespace_handling", 1.0),
    ]


@pytest.mark.parametrize(
    "name, want, pattern",
    [
        ("[Acme] Blue Bolt - Part 2", [("Acme", "bracket", 1), ("Blue Bolt", "text", 7), ("Part 2", "text", 19)], "[{token0}] {token1} - {token2}"),
        ("{c} x- y -z w-v", [("c", "curly", 1), ("x", "text", 4), ("y", "text", 7), ("z w-v", "text", 10)], "{{token0}} {token1}- {token2} -{token3}"),
        ("(a [b]", [("a", "text", 1), ("b", "bracket", 4)], "{token0} [{token1}]"),
        ("😀 (é )", [("😀", "text", 0), ("é", "parenthesis", 3)], "{token0} ({token1})"),
        ("a - Collection - b", [("a", "text", 0), ("b", "text", 17)], "{token0} - {junk} - {token1}"),
        ("[] ()", [], ""),
        ("p/q.r", [("p", "path", 0), ("q.r", "text", 0)], "{path}/{token0}"),
    ],
)
def test_tokens(spark, name, want, pattern):
    df = tokens.with_tokens(spark.createDataFrame([(name,)], "cleaned string"))
    row = df.select("tokens", tokens.render(F.col("tokens"), F.col("tail")).alias("p")).first()
    assert [(t.value, t.type, t.position) for t in row.tokens] == want and row.p == pattern


def test_dates(spark):
    names = ["2020-01-15", "(January 15th, 2020)", "01.15.2010", "14th Dec 2012", "20200115", "x 15June2011", "made 2019", "2019_02_30", "none", "1 of May 1999", "Sept 3, 2001"]
    want = ["2020-01-15", "2020-01-15", "2010-01-15", "2012-12-14", "2020-01-15", "2011-06-15", "2019", "2019-02-30", None, "1999", "2001"]
    assert column(spark, names, dates.iso_date) == want


def test_stress_names(spark):
    long = "a" * 10_000 + "2020-01-15" + "b" * 10_000
    many = " - ".join(["x"] * 99 + ["2020-01-15"])
    rows = parse.parse_names(spark.createDataFrame([(long,), (many,), ("Vol " + "9" * 26,), ("a\x00b 😀",)], "name string")).collect()
    assert [t.value for t in rows[0].tokens if t.type == "date"] == ["2020-01-15"] and rows[0].tokens[2].position == 10_010
    assert len(rows[1].tokens) == 100 and rows[1].tokens[-1].type == "date"
    assert rows[2].sequence is None and rows[3].pattern


def test_code_patterns():
    assert codes.compile_pattern("ACM####") == r"ACM\d{4}"
    assert codes.compile_pattern("(##)### ##") == r"\d{0,2}\d{3} \d{2}"
    assert codes.compile_pattern("a(b)c\\#") == r"a(?:b)?c\#"
    assert codes.compile_pattern("(a") is None and codes.compile_pattern("a\\") is None
    assert codes.compile_pattern("a)") == r"a\)"
    assert len(codes.compile_rules([{"code_patterns": ["re:[", "(x", "", 3]}, "no", {"code_patterns": 5}])) == 0


def test_code_rules(spark):
    rules = codes.compile_rules()
    df = spark.createDataFrame([("ACM0042", None), ("sc-0007 x", None), ("123 45", "Scary Fuckers"), ("123 45", None), ("FX123a", None), ("Incident # 012", None), ("0000", None), ("MK0012345", None)], "v string, s string")
    got = [(r.c.code, r.c.studio) if r.c else None for r in df.select(codes.match_code(F.col("v"), F.col("s"), rules).alias("c")).collect()]
    assert got[:5] == [("42", "Corbin Fisher"), ("7", "Sean Cody"), ("0012345", "Scary Fuckers"), None, None]
    assert got[5][1] == "Boys Halfway House" and got[6] is None and got[7] == ("12345", None)


def test_performers(spark):
    names = ["Ann and Bo", "Ann, Bo &Cy", "Ann", "Ann and The", "Igor C, Bo", "I C, Bo", "Ann &amp; Bo Lee", "ann,bo", "Ann B C, Bo", "A" * 21 + ", Bo"]
    want = ["Ann, Bo", "Ann, Bo, Cy", None, None, "Igor C, Bo", None, "Ann, Bo Lee", "ann, bo", None, None]
    assert column(spark, names, people.performer_list) == want


@pytest.mark.parametrize(
    "name, group, title, sequence, pattern, studio",
    [
        ("Media/[Acme] 1080p Blue Bolt, Scene #02 (Ann Lee & Bo Ray) 2019.05.07.mkv", "Blue Bolt", "Blue Bolt, Scene 2", {"scene": 2}, "[{studio}] {token1} ({performers}) {date}", "Acme"),
        ("Series A - 3 - Big Day", "Series A", "Big Day", {"scene": 3}, "{token0} - {token1} - {title}", None),
        ("Foo Part 2 Bar.mp4", None, "Bar", {"part": 2}, "{title}", None),
        ("Foo Part 2.mp4", None, "Foo", {"part": 2}, "{title}", None),
        ("Foo Vol. 3 Scene 4", "Foo", "Foo, Scene 4", {"scene": 4, "volume": 3}, "{token0}", None),
        ("Scene 3 - Foo", None, "Foo", {"scene": 3}, "{token0} - {title}", None),
        ("Acme-Big Day", None, "Big Day", None, "{studio}-{title}", "Acme"),
        ("TheAcme Gold Show", "The", "Show", None, "{token0}{studio}{title}", "Acme Gold"),
        ("acf - x", None, None, None, "{studio} - {token1}", "Acme"),
        ("ABolt Mediab zz", None, "ABolt Mediab zz", None, "{title}", None),
        ("Big Part2 S01E02", None, "Big Part2 S01E02", None, "{title}", None),
        ("Ann, Bo and Cy.mp4", None, "Ann, Bo & Cy", None, "{performers}", None),
        (None, None, None, None, "", None),
    ],
)
def test_parse(spark, name, group, title, sequence, pattern, studio):
    r = parse.parse_names(spark.createDataFrame([(name,)], "name string"), known=KNOWN).first()
    assert (r.group, r.title, r.sequence, r.pattern, r.studio) == (group, title, sequence, pattern, studio)


def test_existing_studio_fills_unknown(spark):
    df = spark.createDataFrame([("Unknown - 123 45 x", "Scary Fuckers"), ("Acme - x y", "Other"), ("foo bar", "Own"), ("foo bar", " ")], "name string, own string")
    rows = parse.parse_names(df, known=KNOWN, existing="own").collect()
    assert [r.studio for r in rows] == ["Scary Fuckers", "Acme", "Own", None] and rows[0].studio_code == "0012345"


def test_old_operators(spark):
    v = ["Part2", "sc1234", "x e-5", "S 3", "vol12", "none"]
    got = column(spark, v, lambda c: structure.old_sequence(c))
    assert [(r.key, r.number) if r else None for r in got] == [("part", 2), None, ("episode", 5), ("scene", 3), ("volume", 12), None]


def test_dimension_order_and_overrides(spark):
    rows = studios.rows_from_catalogue([{"name": "One", "aliases": ["x", None]}, {"name": "", "aliases": ["y"]}, {"name": "Two", "aliases": ["X"]}])
    assert {r[0]: r[1] for r in rows} == {"one": "One", "x": "Two", "two": "Two"}
    assert studios.collect_dimension(studios.dimension(spark, rows), 2) is None
    assert len(studios.collect_dimension(studios.dimension(spark, rows))) == 3


NAMES = st.lists(st.text(alphabet="aB1 -_.()[]{}é́#&,20SscenePart", max_size=40), min_size=30, max_size=30)


@settings(max_examples=5, deadline=None)
@given(NAMES)
def test_properties(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = parse.parse_names(df, known=KNOWN).withColumn("again", text.trim_affixes(text.trim_affixes(F.col("name")))).withColumn("once", text.trim_affixes(F.col("name"))).collect()
    for r in rows:
        assert r.again == r.once
        holes = sum(r.pattern.count("{" + k) for k in ("token", "date", "studio", "performers", "title"))
        literal = sum(r.cleaned.count(k) for k in ("token", "date", "studio", "performers", "title"))
        assert holes == len(r.tokens) or literal
        for t in r.tokens:
            assert 0 <= t.position <= len(r.cleaned)
