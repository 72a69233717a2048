"""Large studio dimensions are joined, and give what the literal ones give."""

import pytest

from filemeta.operators import studios, update
from filemeta.plans import parse

NAMES = [
    "Acme - Big Day.mp4", "[Bolt Media] Foo.mp4", "xxAcme Goldyy.mp4", "Acme-Foo.mp4", "Foo-Acme Films.mp4", "ab - cd.mp4", "Unknown - Foo.mp4", "Studio 17 Foo Scene 2.mp4", "the studio 1 and studio 12 here.mp4",
    "studio 9-bar.mp4", "[studio 3] x - 2020-01-02.mp4", "q.mp4", "", None, "ab.mp4", "prefix ab suffix.mp4", "Studio 17 Foo Scene 2.mp4", "2020-01-02.mp4",
]


def dimension(n):
    own = [{"canonical_name": "Acme", "aliases": ["Acme Films"], "abbr": ["ab"]}, {"canonical_name": "Bolt Media^"}, {"canonical_name": "Acme Gold"}, {"canonical_name": "Unknown"}]
    return studios.rows_from_dictionary(own + [{"canonical_name": f"Studio {i}"} for i in range(n)])


@pytest.mark.parametrize("n", [10, 2000, 200_000])
def test_join_equals_literals(spark, n):
    """A dimension too large for literals is compared with those of its keys that are in a name at all."""
    rows = dimension(n)
    low = [(x or "").lower() for x in NAMES]
    known = studios.Known.of([r for r in rows if any(r[0] in x for x in low)])
    df = spark.createDataFrame(list(enumerate(NAMES)), "row_id long, name string")
    columns = ["row_id", "name", "studio", "pattern", "title", "tokens"]
    want = sorted(parse.parse_names(df, known=known).select(*columns).collect())
    joined = parse.parse_names(df, known=studios.last_wins(studios.dimension(spark, rows)) if n > studios.LITERAL_KEYS else studios.dimension(spark, rows).repartition(3))
    assert sorted(joined.select(*columns).collect()) == want
    assert {r.studio for r in want} >= {"Acme", "Bolt Media", "Acme Gold", "Studio 9"}


def test_both_ways_on_the_same_keys(spark, monkeypatch):
    rows = dimension(30)
    df = spark.createDataFrame(list(enumerate(NAMES)), "row_id long, name string")
    want = sorted(parse.parse_names(df, known=rows).select("row_id", "studio", "pattern", "title", "tokens").collect())
    monkeypatch.setattr(studios, "LITERAL_KEYS", 3)
    made = parse.parse_names(df, known=rows)
    assert "__hits" not in made.columns and "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(made.select("row_id", "studio", "pattern", "title", "tokens").collect()) == want
    assert parse.parse_names(df.where("row_id < 0"), known=rows).count() == 0


def test_resolving_studios_meets_no_nested_loop(spark):
    known = spark.createDataFrame([("10", "Acme"), ("11", "Acme Two"), ("12", "The Bolt"), ("13", "x"), ("14", None), ("15", "Q7")], "id string, name string")
    rows = spark.createDataFrame([(1, "Acme"), (2, "bolt"), (3, "none"), (4, None), (5, " "), (6, "acme t"), (7, "X"), (8, "q"), (9, "ACME"), (10, "acme")], "k int, studio_name string")
    out = update.resolve_studios(rows, known)
    assert {r.k: r.studio_id for r in out.collect()} == {1: "10", 2: "12", 3: None, 4: None, 5: None, 6: "11", 7: "13", 8: "15", 9: "10", 10: "10"}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
