"""Stage 4: studios, by exact name, by a part before or after a dash, by substring.

The dimension is a table (key, canonical, exact_only, ord), key in lower case. A dimension of up to LITERAL_KEYS keys
goes into the plan as a literal map, so names are matched in place without an exchange. A larger one is joined
(with_hits): each distinct text of tokens gets the keys that occur in it, found by a key's rarest three letters, and
the same expressions look in these few.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from .barrier import add
from .tokens import TOKENS

DIM = "key string, canonical string, exact_only boolean, ord int"
LITERAL_KEYS = 2000


def rows_from_catalogue(studios: list[dict]) -> list[tuple]:
    """Dimension rows of catalogue studios {name, aliases}; a later key overrides an earlier one."""
    found: dict[str, list] = {}
    for s in studios:
        for name in [s.get("name"), *(s.get("aliases") or [])] if s.get("name") else []:
            if name:
                found.setdefault(name.lower(), [None, False, len(found)])[0] = s["name"]
    return [(k, c, e, o) for k, (c, e, o) in found.items()]


def from_catalogue(found: DataFrame) -> DataFrame:
    """rows_from_catalogue() of studios(name, aliases) in their order, as a table; see last_wins()."""
    named = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = found.where(F.coalesce("name", F.lit("")) != "").select("name", F.explode(named).alias("key")).where("key <> ''")
    return rows.select(F.lower("key").alias("key"), F.col("name").alias("canonical"), F.lit(False).alias("exact_only"), F.monotonically_increasing_id().alias("ord"))


def _listed(v) -> list:
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return []
    return v if isinstance(v, list) else []


def rows_from_dictionary(studios: list[dict], overrides: dict[str, str] | None = None) -> list[tuple]:
    """Dimension rows of static studios {canonical_name, aliases, abbr}. A trailing ^ marks a name that only matches
    whole; "unknown" always does. Aliases may be JSON text. Overrides come last."""
    found: dict[str, list] = {}

    def put(key: str, canonical: str, exact: bool) -> None:
        row = found.setdefault(key.lower(), [canonical, False, len(found)])
        row[0], row[1] = canonical, row[1] or exact or key.lower() == "unknown"

    for s in studios:
        name = s.get("canonical_name") or ""
        if not name:
            continue
        canonical = name.removesuffix("^")
        put(canonical, canonical, name.endswith("^"))
        for a in _listed(s.get("aliases")):
            if a:
                put(a.removesuffix("^"), canonical, a.endswith("^"))
        for a in _listed(s.get("abbr")):
            if a:
                put(a, canonical, False)
    for a, canonical in (values.STUDIO_ALIASES if overrides is None else overrides).items():
        if canonical:
            put(a, canonical, False)
    return [(k, c, e, o) for k, (c, e, o) in found.items()]


def dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DIM)


def last_wins(dim: DataFrame) -> DataFrame:
    """One row per key, the last; its place in the order is that of the first."""
    return dim.groupBy("key").agg(F.max_by("canonical", "ord").alias("canonical"), F.bool_or("exact_only").alias("exact_only"), F.min("ord").alias("ord"))


@dataclass
class Known:
    """A dimension small enough for the plan."""

    canonical: dict[str, str]
    partial: list[str]  # keys for substring matches, longest first, then in order

    @classmethod
    def of(cls, rows: list[tuple]) -> "Known":
        order = sorted((r for r in rows if len(r[0]) >= 3 and not r[2]), key=lambda r: (-len(r[0]), r[3]))
        return cls({r[0]: r[1] for r in rows}, [r[0] for r in order])

    def find(self, v: Column) -> Column:
        if not self.canonical:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in self.canonical.items() for x in kv)), F.lower(v))

    def within(self, v: Column) -> Column:
        """The key that occurs in the value, or null."""
        if not self.partial:
            return F.lit(None).cast("string")
        return F.get(F.filter(F.array(*(F.lit(k) for k in self.partial)), lambda k: F.contains(F.lower(v), k)), F.lit(0))


@dataclass
class Hits:
    """A dimension by the keys that may occur in a row, a column of it, in the order of Known.partial."""

    column: str

    def find(self, v: Column) -> Column:
        return F.get(F.filter(self.column, lambda h: h.key == F.lower(v)), F.lit(0)).canonical

    def within(self, v: Column) -> Column:
        return F.get(F.filter(self.column, lambda h: (h.n <= -3) & ~h.exact_only & F.contains(F.lower(v), h.key)), F.lit(0)).key


def grams(c: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many letters of a text."""
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
    return F.array_distinct(F.concat(*map(runs, lengths)))


def blocked(keys: DataFrame, key: str = "key", gram: int = 3) -> DataFrame:
    """keys, unique, with the run of gram letters in each that fewest of them have; a shorter key is its own run."""
    runs = keys.select(key, F.explode(grams(F.col(key), [gram])).alias("gram"))
    often = runs.groupBy("gram").agg(F.count("*").alias("n"))
    best = runs.join(often, "gram").groupBy(key).agg(F.min(F.struct("n", "gram")).gram.alias("gram"))
    return keys.join(best, key)


def with_hits(df: DataFrame, dim: DataFrame) -> DataFrame:
    """df with __hits, the dimension's rows whose key occurs in a token, the longest first. Texts meet keys by an equi
    join on a run of letters, each distinct text once."""
    values = F.transform(F.filter("tokens", lambda t: (t.type != "path") & t.value.isNotNull()), lambda t: t.value)
    df = add(df, __text=F.lower(F.array_join(values, "\n")))
    lengths = sorted(r[0] for r in dim.select(F.least(F.length("key"), F.lit(3))).where("key <> ''").distinct().collect())
    texts = df.select("__text").where("__text <> ''").distinct()
    spots = texts.select("__text", F.explode(grams(F.col("__text"), lengths or [3])).alias("gram"))
    found = spots.join(blocked(dim.where("key <> ''")), "gram").where(F.contains("__text", F.col("key")))
    row = F.struct((-F.length("key")).alias("n"), "ord", "key", "canonical", "exact_only")
    hits = found.groupBy("__text").agg(F.array_sort(F.collect_list(row)).alias("__hits"))
    return df.join(hits, "__text", "left").drop("__text").withColumn("__hits", F.coalesce("__hits", F.array().cast(dict(hits.dtypes)["__hits"])))


def known_of(dim: "Known | DataFrame | list[tuple]", spark: SparkSession, most: int | None = None) -> "Known | DataFrame":
    """A dimension as literals where it has at most so many keys (LITERAL_KEYS), else as a table of unique keys."""
    if isinstance(dim, Known):
        return dim
    most = LITERAL_KEYS if most is None else most
    if isinstance(dim, DataFrame):
        rows = collect_dimension(dim, most)
        return last_wins(dim) if rows is None else Known.of(rows)
    return Known.of(dim) if len(dim) <= most else last_wins(dimension(spark, dim))


def collect_dimension(dim: DataFrame, most: int = LITERAL_KEYS) -> list[tuple] | None:
    """The dimension's rows, or None if it has more than so many."""
    rows = last_wins(dim).limit(most + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= most else None


def _token(value: Column, kind: Column | str, position: Column, lead: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("value"), lit(kind).alias("type"), position.alias("position"), lit(lead).alias("lead"))


def first_of_type(tokens: Column, kind: str) -> Column:
    return F.get(F.filter(tokens, lambda t: t.type == kind), F.lit(0)).value


def mark_exact(tokens: Column, known: Known) -> Column:
    """Tokens that are a studio's name; all that match are marked."""

    def one(t: Column) -> Column:
        return text.let(known.find(t.value), lambda c: F.when((t.type != "path") & c.isNotNull(), _token(c, "studio", t.position, t.lead)).otherwise(t))

    return F.transform(tokens, one).cast(TOKENS)


def split_dash(tokens: Column, known: Known) -> Column:
    """Text tokens split at their first dash where a part is a studio; the parts keep the token's place."""

    def one(t: Column) -> Column:
        def parts(p: Column) -> Column:
            found = F.transform(p, lambda x: F.when(F.length(x) >= 2, known.find(x)))
            first = F.when(F.get(found, F.lit(0)).isNotNull(), 0).when(F.get(found, F.lit(1)).isNotNull(), 1)
            made = F.transform(p, lambda x, i: _token(F.when(i == first, F.get(found, i)).otherwise(x), F.when(i == first, "studio").otherwise("text"), t.position, t.lead))
            kept = F.filter(made, lambda x: x.value != "")
            return F.when(first.isNotNull(), F.transform(kept, lambda x, i: x.withField("lead", F.when(i == 0, t.lead).otherwise(F.lit("-")))))

        split = F.transform(F.split(t.value, "-", 2), text.strip)
        usable = (t.type == "text") & t.value.contains("-") & ~t.value.contains(" - ")
        return F.when(usable, F.coalesce(text.let(split, parts).cast(TOKENS), F.array(t))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one)).cast(TOKENS)


def split_substring(tokens: Column, known: Known) -> Column:
    """Text tokens that have a studio's name inside: the longest key wins, ties by the dimension's order; its first
    occurrence is cut out."""

    def one(t: Column) -> Column:
        def cut(k: Column) -> Column:
            at = F.instr(F.lower(t.value), k) - 1
            three = F.array(
                _token(text.strip(F.substring(t.value, F.lit(1), at)), "text", t.position, ""),
                _token(known.find(k), "studio", t.position, ""),
                _token(text.strip(F.substring(t.value, at + F.length(k) + 1, F.length(t.value))), "text", t.position, ""),
            )
            kept = F.filter(three, lambda x: x.value != "")
            return F.when(k.isNotNull(), F.transform(kept, lambda x, i: x.withField("lead", F.when(i == 0, t.lead).otherwise(F.lit("")))))

        return F.when(t.type == "text", F.coalesce(text.let(known.within(t.value), cut).cast(TOKENS), F.array(t))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one)).cast(TOKENS)


def with_studio(df: DataFrame, known: Known | DataFrame | list[tuple], existing: str | None = None) -> DataFrame:
    """Exact, then by dash, then by substring, each only while no studio is known; then a record's own studio fills
    an empty or unknown one. Adds studio."""
    known = known_of(known, df.sparkSession)
    if isinstance(known, DataFrame):
        return with_studio_by(with_hits(df, known), Hits("__hits"), existing).drop("__hits")
    return with_studio_by(df, known, existing)


def with_studio_by(df: DataFrame, known: Known | Hits, existing: str | None = None) -> DataFrame:
    df = add(df, tokens=mark_exact(F.col("tokens"), known))
    for step in (split_dash, split_substring):
        df = add(df, tokens=F.when(F.exists("tokens", lambda t: t.type == "studio"), F.col("tokens")).otherwise(step(F.col("tokens"), known)))
    found = first_of_type(F.col("tokens"), "studio")
    if existing:
        found = F.when(F.lower(F.coalesce(text.strip(found), F.lit(""))).isin("", "unknown") & ~text.blank(F.col(existing)), F.col(existing)).otherwise(found)
    return add(df, studio=found)


def match_exact(tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """tokens(id, pos, value) joined to the dimension on the lower-case value; canonical is null without a match."""
    return tokens.join(dim.select("key", "canonical"), F.lower("value") == F.col("key"), "left").drop("key")


def match_dash(tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """(id, pos, part, canonical) of the first part of each dashed value that is a studio."""
    usable = tokens.where(F.col("value").contains("-") & ~F.col("value").contains(" - "))
    parts = usable.select("id", "pos", F.posexplode(F.transform(F.split("value", "-", 2), text.strip)).alias("part", "value")).where(F.length("value") >= 2)
    found = parts.join(dim.select("key", "canonical"), F.lower("value") == F.col("key"))
    return found.groupBy("id", "pos").agg(F.min(F.struct("part", "canonical")).alias("m")).select("id", "pos", "m.part", "m.canonical")


def match_substring(tokens: DataFrame, dim: DataFrame, gram: int = 3) -> DataFrame:
    """(id, pos, key, canonical, start) of the longest key inside each value. A value meets only the keys whose rarest
    run of three letters it has, by an equi join, not every key."""
    keys = blocked(dim.where((F.length("key") >= gram) & ~F.col("exact_only")), gram=gram)
    spots = tokens.select("id", "pos", "value", F.explode(grams(F.lower("value"), [gram])).alias("gram"))
    found = spots.join(keys, "gram").where(F.contains(F.lower("value"), F.col("key")))
    best = found.groupBy("id", "pos").agg(F.max(F.struct(F.length("key").alias("n"), (-F.col("ord")).alias("o"), "key", "canonical", (F.instr(F.lower("value"), F.col("key")) - 1).alias("start"))).alias("m"))
    return best.select("id", "pos", "m.key", "m.canonical", "m.start")
