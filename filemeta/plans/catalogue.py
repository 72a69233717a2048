"""All queries over the driver's tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import checks, clean, codes, compare, dates, evaluate, people, records, resolve, structure, studios, tokens, update
from ..operators.barrier import add
from . import names, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- SQL for the parts of a parse, for names of ASCII text ---------------------------------------------------------


def sql_markers(c: str) -> str:
    """Markers removed. RE2 has no look-around, so the characters beside a marker are kept as groups, in two passes,
    as two markers can share one."""
    for group in (clean.FIRST_MARKERS, *([m] for m in values.MISC)):
        regex = "(^|[^a-zA-Z0-9])(?:" + "|".join(text.literal(m) for m in group) + ")([^a-zA-Z0-9]|$)"
        for _ in range(2):
            c = f"regexp_replace({c}, '{regex}', '\\1\\2', 'g')"
        c = f"trim({c})"
    return c


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{values.AFFIX}|{values.AFFIX}$', '', 'g')"


def sql_dashes(c: str) -> str:
    for s in values.DASHED:
        c = f"replace({c}, '{s}', ' - ')"
    return f"trim(regexp_replace(regexp_replace({c}, '\\s*-\\s*-\\s*', ' - ', 'g'), '\\s+', ' ', 'g'))"


def sql_underscores(c: str) -> str:
    return f"replace(regexp_replace(regexp_replace({c}, '(\\s)_', '\\1', 'g'), '_(\\s)', '\\1', 'g'), '_', ' ')"


def sql_extension(c: str) -> str:
    return f"regexp_replace({c}, '(?i)^(.+)\\.(?:{'|'.join(values.EXTENSIONS)})$', '\\1')"


def sql_basename(c: str) -> str:
    return f"regexp_extract(regexp_replace(replace({c}, '\\', '/'), '/+$', ''), '([^/]*)$', 1)"


def sql_clean(c: str) -> str:
    return sql_trim(sql_extension(sql_underscores(sql_dashes(sql_trim(sql_markers(sql_basename(c)))))))


SQL_CLEANED = f"cleaned AS (SELECT row_id, name, {sql_clean('name')} AS c FROM ({names.SQL_PART}))"
SQL_SEGMENTS = f"{SQL_CLEANED}, split AS (SELECT row_id, c, regexp_extract_all(c, '{tokens.SEGMENT}') AS segs FROM cleaned), seg AS (SELECT row_id, unnest(segs) AS s, generate_subscripts(segs, 1) AS k FROM split), spot AS (SELECT *, sum(length(s)) OVER (PARTITION BY row_id ORDER BY k) - length(s) AS off FROM seg)"
#: Tokens of part names: their dashes all have blanks on both sides.
SQL_TOKENS = f"""{SQL_SEGMENTS}, part_list AS (
  SELECT row_id, k, off, s, CASE WHEN s[1] IN ('[', '(') THEN [substr(s, 2, length(s) - 2)] ELSE string_split(s, ' - ') END AS parts FROM spot),
cut AS (SELECT row_id, k, off, s, unnest(parts) AS p, generate_subscripts(parts, 1) AS j FROM part_list),
placed AS (SELECT *, off + CASE WHEN s[1] IN ('[', '(') THEN 1 ELSE 0 END + sum(length(p) + 3) OVER (PARTITION BY row_id, k ORDER BY j) - length(p) - 3 AS start FROM cut),
token AS (
  SELECT row_id, k, j, CASE s[1] WHEN '[' THEN 'bracket' WHEN '(' THEN 'parenthesis' ELSE 'text' END AS type,
    {sql_trim("trim(p)")} AS value, CAST(start + length(p) - length(ltrim(p)) AS INT) AS position
  FROM placed WHERE trim(p) <> '')"""


def _cleaned(spark, sf_dir) -> DataFrame:
    df = names.part_names(spark, sf_dir)
    return add(df, cleaned=clean.clean_name(F.col("name")))


def _tokens(spark, sf_dir) -> DataFrame:
    return tokens.with_tokens(_cleaned(spark, sf_dir))


def _lines(spark, sf_dir) -> DataFrame:
    return names.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents"


# --- stage 1 ----------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {sql_basename('url')} AS base FROM pages")
def q02_basename(spark, sf_dir):
    return names.table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


@query(
    f"""WITH p AS (SELECT page_id, unnest(string_split(url, '/')) AS s, generate_subscripts(string_split(url, '/'), 1) AS k FROM pages),
t AS (SELECT page_id, k, {sql_trim('s')} AS s FROM p WHERE s <> '.')
SELECT page_id, count(*) AS n, string_agg(s, '|' ORDER BY k) AS segments, arg_max(s, k) AS grp FROM t WHERE s <> '' GROUP BY page_id"""
)
def q03_path_segments(spark, sf_dir):
    df = add(names.table(spark, sf_dir, "pages").select("page_id", "url"), s=text.path_segments(F.col("url")))
    return df.select("page_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("segments"), F.try_element_at("s", F.lit(-1)).alias("grp"))


@query(f"SELECT row_id, {sql_extension('name')} AS stem FROM ({names.SQL_PART})")
def q04_extension(spark, sf_dir):
    return names.part_names(spark, sf_dir).select("row_id", text.strip_extension(F.col("name")).alias("stem"))


@query(f"SELECT row_id, {sql_markers('name')} AS stripped FROM ({names.SQL_PART})")
def q05_marker_strip(spark, sf_dir):
    return names.part_names(spark, sf_dir).select("row_id", clean.strip_markers(F.col("name")).alias("stripped"))


@query(
    f"""SELECT row_id, CASE row_id % 5 WHEN 0 THEN '1080p(resolution_1080p)@' || (length(name) - 9)
  WHEN 1 THEN '720p(resolution_720p)@' || (length(name) - 11) || '|HQ(quality_HQ)@' || (length(name) - 6) ELSE '' END AS removed FROM ({names.SQL_PART})"""
)
def q06_removed_tokens(spark, sf_dir):
    found = add(names.part_names(spark, sf_dir), r=clean.removed_markers(F.col("name")))
    shown = F.transform("r", lambda r: F.concat(r.value, F.lit("("), r.category, F.lit(")@"), r.position.cast("string")))
    return found.select("row_id", F.array_join(shown, "|").alias("removed"))


@query(f"SELECT doc_id, pos, {sql_trim('line')} AS trimmed FROM ({SQL_LINES})")
def q07_trim_affixes(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", text.trim_affixes(F.col("line")).alias("trimmed"))


_UNDER = "replace(replace(name, ' - ', ' _ '), ' ', CASE WHEN row_id % 2 = 0 THEN '_' ELSE ' ' END)"


@query(f"SELECT row_id, regexp_matches(u, '\\s_|_\\s') AS flagged, {sql_underscores('u')} AS spaced FROM (SELECT row_id, {_UNDER} AS u FROM ({names.SQL_PART}))")
def q08_underscore(spark, sf_dir):
    df = names.part_names(spark, sf_dir).selectExpr("row_id", f"{_UNDER} AS u")
    return df.select("row_id", text.has_loose_underscore(F.col("u")).alias("flagged"), text.replace_underscores(F.col("u")).alias("spaced"))


@query(f"SELECT doc_id, pos, {sql_dashes('nfc_normalize(line)')} AS dashed FROM ({SQL_LINES})")
def q09_dash_replace(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", text.replace_characters(F.col("line")).alias("dashed"))


# --- stage 2 ----------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_CLEANED} SELECT row_id, c AS cleaned, array_to_string(regexp_extract_all(c, '{tokens.SEGMENT}'), '|') AS segments FROM cleaned")
def q10_segments(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("row_id", "cleaned", F.array_join(tokens.segments(F.col("cleaned")), "|").alias("segments"))


@query(f"WITH {SQL_TOKENS} SELECT row_id, value, type, position FROM token")
def q11_token_positions(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("row_id", F.explode("tokens").alias("t"))
    return rows.select("row_id", "t.value", "t.type", "t.position")


_JUNK_NAME = "'[' || p_brand || '] Collection - ' || p_name || ' (movie) - 720P'"


@query("SELECT p_partkey AS row_id, p_brand || '|' || p_name AS kept, '[{token0}] {junk} - {token1} ({junk}) - {junk}' AS pattern FROM part")
def q12_junk_filter(spark, sf_dir):
    df = names.table(spark, sf_dir, "part").selectExpr("p_partkey AS row_id", f"{_JUNK_NAME} AS cleaned")
    df = tokens.with_tokens(df)
    return df.select("row_id", F.array_join(F.transform("tokens", lambda t: t.value), "|").alias("kept"), tokens.render(F.col("tokens"), F.col("tail")).alias("pattern"))


@query(
    """SELECT p_partkey AS row_id, '[{token0}] {token1} - {token2}' || CASE WHEN p_partkey % 5 = 2 THEN ' ({token3})' || CASE WHEN p_partkey % 3 = 2 THEN '{token4}' ELSE '' END ELSE '' END AS pattern FROM part"""
)
def q13_pattern(spark, sf_dir):
    return _tokens(spark, sf_dir).select("row_id", tokens.render(F.col("tokens"), F.col("tail")).alias("pattern"))


# --- stage 3 ----------------------------------------------------------------------------------------------------

SQL_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"


@query("SELECT CAST(year(l_shipdate) AS STRING) AS year, count(*) AS n FROM lineitem GROUP BY ALL")
def q01_year_histogram(spark, sf_dir):
    df = add(names.ship_names(spark, sf_dir), cleaned=clean.clean_name(F.col("name")))
    df = add(df, iso=dates.iso_date(F.col("cleaned")))
    return df.groupBy(F.substring("iso", 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey AS row_id, l_linenumber AS line, {SQL_DAY} AS iso FROM lineitem")
def q14_date_iso(spark, sf_dir):
    return names.ship_names(spark, sf_dir).select("row_id", "line", dates.iso_date(F.col("name")).alias("iso"))


#: A day in each of the shapes that a name may have it in, by the row's number; the last has the year alone.
SHAPED_DAYS = ["yyyy.MM.dd", "yyyy_MM_dd", "d MMMM yyyy", "(MMMM d, yyyy)", "MMM d yyyy", "yyyyMMdd", "dMMMyyyy", "MM/dd/yyyy", "MM.dd.yyyy", "yyyy"]


@query(
    f"""SELECT l_orderkey AS row_id, l_linenumber AS line, CASE WHEN (l_orderkey + l_linenumber) % {len(SHAPED_DAYS)} = {len(SHAPED_DAYS) - 1}
  THEN CAST(year(l_shipdate) AS STRING) ELSE {SQL_DAY} END AS iso FROM lineitem"""
)
def q14b_date_shapes(spark, sf_dir):
    """The day itself is the yardstick: SQL never sees the text that the shapes are found in."""
    df = names.table(spark, sf_dir, "lineitem").withColumn("at", (F.col("l_orderkey") + F.col("l_linenumber")) % len(SHAPED_DAYS))
    day = F.array(*(F.date_format("l_shipdate", x) for x in SHAPED_DAYS))
    name = F.concat(F.lit("Clip n"), F.col("l_linenumber").cast("string"), F.lit(" at "), F.get(day, F.col("at").cast("int")), F.lit(" end.mkv"))
    return names.spread(df.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), name.alias("name"))).select("row_id", "line", dates.iso_date(F.col("name")).alias("iso"))


@query(
    f"""SELECT l_orderkey AS row_id, l_linenumber AS line, 'text:Order n' || l_orderkey || ' at@0|date:' || {SQL_DAY} || '@' || (11 + length(CAST(l_orderkey AS STRING)))
  || '|text:Scene ' || l_linenumber || '@' || (CASE WHEN l_linenumber % 3 = 1 THEN 19 ELSE 21 END + length(CAST(l_orderkey AS STRING))) AS shown, '{{token0}} {{date}} {{token2}}' AS pattern FROM lineitem"""
)
def q15_date_split(spark, sf_dir):
    df = add(names.ship_names(spark, sf_dir), cleaned=clean.clean_name(F.col("name")))
    df = dates.with_dates(tokens.with_tokens(df))
    return df.select("row_id", "line", tokens.show(F.col("tokens")).alias("shown"), tokens.render(F.col("tokens"), F.col("tail")).alias("pattern"))


# --- stage 4 ----------------------------------------------------------------------------------------------------


@query(f"SELECT v.id, v.value, k.canonical FROM ({names.SQL_VALUES}) v LEFT JOIN ({names.SQL_STUDIOS}) k ON lower(v.value) = k.key")
def q16_studio_exact(spark, sf_dir):
    return studios.match_exact(names.studio_values(spark, sf_dir), names.studio_keys(spark, sf_dir)).select("id", "value", "canonical")


@query(
    f"""WITH v AS ({names.SQL_VALUES}), p AS (
  SELECT id, 0 AS part, trim(string_split(value, '-')[1]) AS s FROM v WHERE contains(value, '-') AND NOT contains(value, ' - ')
  UNION ALL SELECT id, 1, trim(substr(value, strpos(value, '-') + 1)) FROM v WHERE contains(value, '-') AND NOT contains(value, ' - '))
SELECT id, CAST(min(part) AS INT) AS part, arg_min(canonical, part) AS canonical FROM p JOIN ({names.SQL_STUDIOS}) k ON lower(s) = key WHERE length(s) >= 2 GROUP BY id"""
)
def q17_studio_dash(spark, sf_dir):
    return studios.match_dash(names.studio_values(spark, sf_dir), names.studio_keys(spark, sf_dir)).select("id", "part", "canonical")


@query(
    f"""SELECT id, arg_max(key, length(key) * 1000000 - ord) AS key, arg_max(canonical, length(key) * 1000000 - ord) AS canonical,
  CAST(arg_max(strpos(lower(value), key) - 1, length(key) * 1000000 - ord) AS INT) AS start
FROM ({names.SQL_VALUES}) v JOIN ({names.SQL_STUDIOS}) k ON contains(lower(value), key) AND length(key) >= 3 AND NOT exact_only GROUP BY id"""
)
def q18_studio_substring(spark, sf_dir):
    return studios.match_substring(names.studio_values(spark, sf_dir), names.studio_keys(spark, sf_dir)).select("id", "key", "canonical", "start")


# --- stage 5 ----------------------------------------------------------------------------------------------------

_CODE = "CASE s_suppkey % 6 WHEN 0 THEN 'ACM' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') || ' - x' WHEN 1 THEN 'sc-' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') WHEN 2 THEN 'FX' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') || '.hd' WHEN 3 THEN 'Part ' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') WHEN 4 THEN lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') || ' 07' ELSE s_name END"
_OWN = "CASE WHEN s_suppkey % 12 = 4 THEN 'scary fuckers' END"


SQL_PARSED_STUDIO = f"""WITH k AS (SELECT replace(key, '_', ' ') AS key, canonical, exact_only, ord FROM ({names.SQL_STUDIOS})), v AS (SELECT id, replace(value, '_', ' ') AS value FROM ({names.SQL_VALUES})),
part_of AS (SELECT id, unnest(string_split(value, ' - ')) AS p, generate_subscripts(string_split(value, ' - '), 1) AS j FROM v),
exact AS (SELECT id, arg_min(canonical, j) AS c FROM part_of JOIN k ON lower(trim(p)) = key GROUP BY id),
half AS (SELECT id, j, unnest([trim(split_part(p, '-', 1)), trim(substr(p, instr(p, '-') + 1))]) AS h, unnest([0, 1]) AS o FROM part_of WHERE contains(p, '-')),
dash AS (SELECT id, arg_min(canonical, j * 2 + o) AS c FROM half JOIN k ON lower(h) = key AND length(h) >= 2 GROUP BY id),
inside AS (SELECT id, j, arg_max(canonical, length(key) * 1000 - ord) AS c FROM part_of JOIN k ON contains(lower(p), key) AND NOT exact_only AND length(key) >= 3 GROUP BY id, j),
sub AS (SELECT id, arg_min(c, j) AS c FROM inside GROUP BY id)
SELECT v.id, coalesce(e.c, d.c, s.c) AS studio FROM v LEFT JOIN exact e ON e.id = v.id LEFT JOIN dash d ON d.id = v.id LEFT JOIN sub s ON s.id = v.id"""


def _studio_names(spark, sf_dir) -> DataFrame:
    return names.studio_values(spark, sf_dir).select("id", F.concat(F.replace("value", F.lit("_"), F.lit(" ")), F.lit(".mp4")).alias("name"))


def _spaced_keys(spark, sf_dir) -> DataFrame:
    """The dimension with blanks in place of underscores, as cleaning a name puts them there."""
    return names.studio_keys(spark, sf_dir).withColumn("key", F.replace("key", F.lit("_"), F.lit(" ")))


@query(SQL_PARSED_STUDIO)
def q53_parse_known(spark, sf_dir):
    """The whole parse with a dimension, which is small and so a literal of the plan."""
    return parse.parse_names(_studio_names(spark, sf_dir), known=_spaced_keys(spark, sf_dir)).select("id", "studio")


@query(SQL_PARSED_STUDIO)
def q53b_parse_known_joined(spark, sf_dir):
    """The same stages with the dimension joined, as a large one is."""
    df = dates.with_dates(tokens.with_tokens(clean.with_clean(_studio_names(spark, sf_dir), "name")))
    df = studios.with_hits(df, studios.last_wins(_spaced_keys(spark, sf_dir)))
    return studios.with_studio_by(df, studios.Hits("__hits")).select("id", "studio")


@query(
    f"""WITH c AS (SELECT s_suppkey, {_CODE} AS v, {_OWN} AS own FROM supplier)
SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN coalesce(nullif(ltrim(v[4:7], '0'), ''), '0') WHEN 1 THEN coalesce(nullif(ltrim(v[4:7], '0'), ''), '0') WHEN 2 THEN v[1:5]
  WHEN 3 THEN v WHEN 4 THEN CASE WHEN own IS NOT NULL THEN lpad(v[1:3], 5, '0') || '07' END END AS code,
  CASE s_suppkey % 6 WHEN 0 THEN 'Corbin Fisher' WHEN 1 THEN 'Sean Cody' WHEN 2 THEN 'FratX' WHEN 4 THEN CASE WHEN own IS NOT NULL THEN 'Scary Fuckers' END END AS studio FROM c"""
)
def q19_code_rules(spark, sf_dir):
    df = names.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", f"{_CODE} AS v", f"{_OWN} AS own")
    df = add(df, m=codes.match_code(F.col("v"), F.col("own"), codes.compile_rules()))
    return df.select("id", F.col("m.code").alias("code"), F.col("m.studio").alias("studio"))


# --- evaluation without labels --------------------------------------------------------------------------------------


def _parsed_parts(spark, sf_dir) -> DataFrame:
    """Parsed part names with the columns that coverage needs."""
    df = parse.parse_names(names.part_names(spark, sf_dir))
    free = F.transform(F.filter("tokens", lambda t: ~t.type.isin(parse.LABELLED) & ~text.blank(t.value)), lambda t: t.value)
    matched = F.size(F.filter("tokens", lambda t: t.type.isin(parse.LABELLED)))
    return df.select("row_id", "pattern", "studio", "performers", parse.last_of("tokens", "date").alias("date"), "studio_code", "title", F.to_json("sequence").alias("sequence"), "group", F.array_distinct(free).alias("unlabeled"), (matched / F.size("tokens")).alias("match_rate"))


_N = "CAST(count(*) AS DOUBLE)"


@query(
    f"""SELECT count(*) AS total_rows, 0.0 AS studio, 0.0 AS performers, count(*) FILTER (p_partkey % 5 = 2) / {_N} AS date, 0.0 AS studio_code, 1.0 AS title,
  count(*) FILTER (p_partkey % 5 = 3) / {_N} AS sequence, 1.0 AS "group", 1.0 AS avg_match_rate FROM part"""
)
def q20_field_coverage(spark, sf_dir):
    return evaluate.coverage(_parsed_parts(spark, sf_dir))


SQL_PATTERN = "'[{token0}] {title} - {title}' || CASE WHEN p_partkey % 5 = 2 THEN ' ({date})' || CASE WHEN p_partkey % 3 = 2 THEN '{title}' ELSE '' END ELSE '' END"


@query(f"SELECT {SQL_PATTERN} AS pattern, count(*) AS n, min(p_partkey) AS first_row FROM part GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 20")
def q21_pattern_topk(spark, sf_dir):
    return evaluate.top_patterns(_parsed_parts(spark, sf_dir))


@query("SELECT 0 AS rows_with_unlabeled_tokens, 0 AS total_unlabeled_tokens")
def q22_unlabeled_stats(spark, sf_dir):
    return evaluate.anomalies(_parsed_parts(spark, sf_dir))


@query(
    """SELECT count(*) FILTER (n > 0) AS rows_with_unlabeled_tokens, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_unlabeled_tokens
FROM (SELECT len(list_distinct(list_filter(string_split(p_type || ' ' || p_name, ' '), lambda x: length(x) > 5 AND contains(lower(x), 'e')))) AS n FROM part)"""
)
def q22b_unlabeled_counts(spark, sf_dir):
    words = F.filter(F.split(F.concat("p_type", F.lit(" "), "p_name"), " "), lambda x: (F.length(x) > 5) & F.contains(F.lower(x), F.lit("e")))
    return evaluate.anomalies(names.table(spark, sf_dir, "part").select(words.alias("unlabeled")))


# --- stage 6 ----------------------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '(?i)&amp;', '&', 'g'), '(?i)\\s+and\\s+', ', ', 'g'), '\\s*&\\s*', ', ', 'g'),
  '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,'), '^$', '') AS listed FROM conversations"""
)
def q23_performers_normalize(spark, sf_dir):
    return names.table(spark, sf_dir, "conversations").select("conv_id", "turn", people.normalize_list(F.col("text")).alias("listed"))


_PEOPLE = "CASE c_custkey % 8 WHEN 0 THEN 'Ann Lee & Bo' WHEN 1 THEN 'Ann, Bo and Cy Dee' WHEN 2 THEN 'Ann' WHEN 3 THEN 'Ann and The' WHEN 4 THEN 'Igor C, Bo' WHEN 5 THEN 'Igor c, Bo' WHEN 6 THEN lower(c_mktsegment) || ',' || c_mktsegment ELSE c_name || ', Bo' END"


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Ann Lee, Bo' WHEN 1 THEN 'Ann, Bo, Cy Dee' WHEN 4 THEN 'Igor C, Bo'
  WHEN 6 THEN lower(c_mktsegment) || ', ' || c_mktsegment END AS performers FROM customer"""
)
def q24_performers_valid(spark, sf_dir):
    df = names.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_PEOPLE} AS v")
    return df.select("id", people.performer_list(F.col("v")).alias("performers"))


# --- stage 7 ----------------------------------------------------------------------------------------------------

_LABELS = "CASE l_linenumber % 5 WHEN 0 THEN 'Vol. ' || CAST(l_orderkey AS STRING) || ' Scene #2' WHEN 1 THEN 'x Pt-3 ep ' || CAST(l_orderkey AS STRING) WHEN 2 THEN 'Part2 s 4' WHEN 3 THEN 'scene 1 scene ' || CAST(l_linenumber AS STRING) ELSE 'Disc 1cd 2' END"


@query(
    """SELECT l_orderkey AS row_id, l_linenumber AS line, CASE l_linenumber % 5 WHEN 0 THEN 'scene=2 volume=' || l_orderkey WHEN 1 THEN 'episode=' || l_orderkey || ' part=3' WHEN 2 THEN 'scene=4'
  WHEN 3 THEN 'scene=' || l_linenumber ELSE '' END AS found FROM lineitem"""
)
def q25_sequence_labels(spark, sf_dir):
    df = names.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "l_linenumber AS line", f"{_LABELS} AS v")
    return df.select("row_id", "line", structure.sequence_of(F.col("v")).alias("found"))


_BARE = "CASE l_linenumber % 4 WHEN 0 THEN 'Blue - ' || CAST(l_linenumber AS STRING) || ' - Bolt' WHEN 1 THEN CAST(l_linenumber AS STRING) || ' - Bolt' WHEN 2 THEN 'Blue - 1 - 2 - Bolt' ELSE 'Blue - ' || CAST(l_orderkey + 1000 AS STRING) || ' - Bolt' END"


@query("SELECT l_orderkey AS row_id, l_linenumber AS line, CASE WHEN l_linenumber % 4 = 0 THEN 1 END AS place FROM lineitem")
def q26_bare_number(spark, sf_dir):
    df = names.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "l_linenumber AS line", f"{_BARE} AS cleaned")
    return tokens.with_tokens(df).select("row_id", "line", structure.bare_number(F.col("tokens")).alias("place"))


@query("SELECT l_orderkey AS row_id, l_linenumber AS line, 'Order n' || l_orderkey || ' at' AS title, CAST(NULL AS STRING) AS \"group\", CAST(l_linenumber AS BIGINT) AS scene FROM lineitem")
def q27_group_title(spark, sf_dir):
    df = parse.parse_names(names.ship_names(spark, sf_dir))
    return df.select("row_id", "line", "title", "group", F.try_element_at("sequence", F.lit("scene")).alias("scene"))


@query("SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN 'Blue Bolt, Scene 3' WHEN 1 THEN 'Ann Lee & Bo' WHEN 2 THEN 'Ann, Bo & Cy' END AS title FROM orders")
def q28_title_synth(spark, sf_dir):
    made = "CASE o_orderkey % 4 WHEN 0 THEN 'Blue Bolt Scene 3.mp4' WHEN 1 THEN 'Ann Lee and Bo.mkv' WHEN 2 THEN 'Ann, Bo, Cy' ELSE '12 34' END"
    df = names.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", f"{made} AS name")
    return parse.parse_names(df).select("row_id", "title")


@query(
    f"""SELECT p_partkey AS row_id, {SQL_PATTERN} AS pattern, CASE WHEN p_partkey % 5 = 2 THEN '2019' END AS date, p_brand AS "group",
  CASE WHEN p_partkey % 5 = 3 THEN '{{"part":' || p_size || '}}' END AS sequence,
  p_name || ' ' || CASE WHEN p_partkey % 3 <> 2 THEN p_type WHEN p_partkey % 5 = 3 THEN 'txt' WHEN p_partkey % 5 = 2 THEN p_type || ' txt' WHEN p_partkey % 5 = 4 THEN p_type || '.txt' ELSE p_type || ' .txt' END AS title FROM part"""
)
def q29_full_parse(spark, sf_dir):
    df = parse.parse_names(names.part_names(spark, sf_dir))
    return df.select("row_id", "pattern", parse.first_date().alias("date"), "group", F.to_json("sequence").alias("sequence"), "title")


# --- comparison -------------------------------------------------------------------------------------------------

SQL_SIM = "CASE WHEN a = b THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END"
_NORMAL_SQL = {
    "studio": lambda c: f"regexp_replace(regexp_replace(lower({c}), '\\b(studio|productions|entertainment)\\b', '', 'g'), '[^a-z0-9]', '', 'g')",
    "title": lambda c: f"regexp_replace(regexp_replace(trim(lower({c})), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g')",
    "studio_code": lambda c: f"regexp_replace(upper({c}), '\\s+', '', 'g')",
}


def _compare_sql(f: str) -> str:
    base = compare.CONFIDENCE[f]
    return f"""WITH v AS (SELECT id, p_{f} AS p, r_{f} AS r, {_NORMAL_SQL[f](f'p_{f}')} AS a, {_NORMAL_SQL[f](f'r_{f}')} AS b FROM ({names.SQL_PAIRS})),
s AS (SELECT *, {SQL_SIM} AS sim FROM v)
SELECT id, CASE WHEN p IS NULL AND r IS NULL THEN 'no_change' WHEN p IS NULL THEN 'no_data' WHEN r IS NULL THEN 'new_data' WHEN sim >= 1 THEN 'match' WHEN sim >= 0.9 THEN 'minor_diff' WHEN sim >= 0.5 THEN 'major_diff' ELSE 'conflict' END AS status,
  CASE WHEN p IS NULL AND r IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 WHEN r IS NULL THEN 1.0 ELSE sim END AS similarity,
  CASE WHEN p IS NULL AND r IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 WHEN r IS NULL THEN {base} ELSE least({base}, sim) END AS confidence,
  CASE WHEN p IS NULL AND r IS NULL THEN 'accept_parsed' WHEN p IS NULL THEN 'keep_original' WHEN r IS NULL THEN '{"accept_parsed" if base >= 0.8 else "manual_review"}'
    WHEN sim >= 1 THEN 'keep_original' WHEN sim >= 0.9 THEN CASE WHEN length(p) > length(r) THEN 'accept_parsed' ELSE 'keep_original' END ELSE 'manual_review' END AS recommendation FROM s"""


def _compared(f: str):
    def run(spark, sf_dir):
        df = add(names.pairs(spark, sf_dir), c=compare.compare_field(f, F.col(f"p_{f}"), F.col(f"r_{f}")))
        return df.select("id", "c.status", "c.similarity", "c.confidence", "c.recommendation")

    return run


@query(f"SELECT id, {SQL_SIM} AS similarity FROM (SELECT id, p_title AS a, r_title AS b FROM ({names.SQL_PAIRS}) WHERE p_title IS NOT NULL AND r_title IS NOT NULL)")
def q30_similarity(spark, sf_dir):
    df = names.pairs(spark, sf_dir).where("p_title IS NOT NULL AND r_title IS NOT NULL")
    return df.select("id", text.similarity(F.col("p_title"), F.col("r_title")).alias("similarity"))


for _name, _field in (("q31_studio_compare", "studio"), ("q32_title_compare", "title"), ("q34_code_compare", "studio_code")):
    QUERIES[_name], ORACLE_SQL[_name] = _compared(_field), _compare_sql(_field)

SQL_STAMP = "coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%Y/%m/%d'), try_strptime({0}, '%m/%d/%Y'), try_strptime({0}, '%Y'))"
SQL_DATES = f"""v AS (SELECT id, p_date AS a, r_date AS b, {SQL_STAMP.format('p_date')} AS x, {SQL_STAMP.format('r_date')} AS y FROM ({names.SQL_PAIRS})),
g AS (SELECT *, abs(date_diff('day', x, y)) AS days, {SQL_SIM} AS sim FROM v),
d AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'no_change' WHEN a IS NULL THEN 'no_data' WHEN b IS NULL THEN 'new_data' WHEN x IS NULL OR y IS NULL THEN CASE WHEN sim < 0.8 THEN 'conflict' ELSE 'major_diff' END
  WHEN x = y THEN 'match' WHEN days <= 1 THEN 'minor_diff' WHEN days <= 7 THEN 'major_diff' ELSE 'conflict' END AS status FROM g)"""


@query(
    f"""WITH {SQL_DATES}, s AS (SELECT *, CASE status WHEN 'no_change' THEN 1.0 WHEN 'no_data' THEN 0.0 WHEN 'new_data' THEN 1.0 ELSE
  CASE WHEN x IS NULL OR y IS NULL THEN sim WHEN x = y THEN 1.0 WHEN days <= 1 THEN 0.95 WHEN days <= 7 THEN 0.8 ELSE 0.3 END END AS similarity FROM d)
SELECT id, status, similarity, CASE status WHEN 'no_change' THEN 1.0 WHEN 'no_data' THEN 0.0 WHEN 'new_data' THEN 0.8 ELSE CASE WHEN x IS NULL THEN 0.0 ELSE least(0.8, similarity) END END AS confidence,
  CASE status WHEN 'no_change' THEN 'accept_parsed' WHEN 'no_data' THEN 'keep_original' WHEN 'new_data' THEN 'accept_parsed' WHEN 'match' THEN 'keep_original' WHEN 'minor_diff' THEN 'accept_parsed' ELSE 'manual_review' END AS recommendation FROM s"""
)
def q33_date_compare(spark, sf_dir):
    return _compared("date")(spark, sf_dir)


#: Texts of a day in the formats that a comparison reads, padded and not, and others; the same in both languages.
DATE_TEXTS = [
    "{y}-{m}-{d}", "{y}/{m}/{d}", "{m}/{d}/{y}", "{d}-{m}-{y}", "{d}.{m}.{y}", "{y}-{m}-{d} 04:05:06", "{y}-{m}-{d}T04:05:06", "{y}", "{m}-{y}", "{y}.{m}.{d}", "{y}-{m}", " {y}-{m}-{d} ", "{y}-13-{d}", "{m}/{y}", "x {y}-{m}-{d}",
]
_PARTS = {False: {"y": "CAST(year(o_orderdate) AS STRING)", "m": "CAST(month(o_orderdate) AS STRING)", "d": "CAST(day(o_orderdate) AS STRING)"}}
_PARTS[True] = {k: v if k == "y" else f"lpad({v}, 2, '0')" for k, v in _PARTS[False].items()}


def _date_text(form: str, padded: bool) -> str:
    return "'" + form.format(**{k: f"' || {v} || '" for k, v in _PARTS[padded].items()}) + "'"


_CASES = [_date_text(f, p) for f in DATE_TEXTS for p in (True, False)]
SQL_DATE_TEXT = f"CASE o_orderkey % {len(_CASES)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CASES)) + " END"
SQL_STRPTIME = "coalesce(" + ", ".join(f"try_strptime(trim(t), '{f}')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y", "%m-%Y")) + ")"


@query(f"SELECT id, t, strftime({SQL_STRPTIME}, '%Y-%m-%d %H:%M:%S') AS read FROM (SELECT o_orderkey AS id, {SQL_DATE_TEXT} AS t FROM orders)")
def q33b_date_formats(spark, sf_dir):
    df = names.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{SQL_DATE_TEXT} AS t")
    return df.select("id", "t", F.date_format(compare.parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("read"))


def _status_sql(f: str) -> str:
    return f"SELECT id, status FROM ({_compare_sql(f)})"


@query(
    f"""WITH {SQL_DATES}, every AS (SELECT id, status FROM d UNION ALL {_status_sql('studio')} UNION ALL {_status_sql('title')} UNION ALL {_status_sql('studio_code')}),
o AS (SELECT id, bool_or(status IN ('major_diff', 'conflict')) AS major, bool_or(status = 'minor_diff') AS minor FROM every GROUP BY id)
SELECT id, CASE WHEN major THEN 'major_conflicts' WHEN minor THEN 'minor_conflicts' ELSE 'no_conflicts' END AS overall_status, NOT major AND NOT minor AS auto_approve, major OR minor AS requires_review FROM o"""
)
def q35_overall_status(spark, sf_dir):
    df = compare.compare_rows(names.pairs(spark, sf_dir), {f: f"p_{f}" for f in compare.FIELDS}, {f: f"r_{f}" for f in compare.FIELDS})
    return df.select("id", "overall_status", "auto_approve", "requires_review")


_LIGHT = "CASE WHEN a = b THEN 'match' WHEN sim > 0.9 THEN 'minor_diff' WHEN sim > 0.5 THEN 'major_diff' ELSE 'conflict' END"


@query(
    f"""WITH v AS (SELECT id, p_title AS p, r_title AS r, translate(lower(trim(p_title)), '_-', '  ') AS a, translate(lower(trim(r_title)), '_-', '  ') AS b FROM ({names.SQL_PAIRS})), s AS (SELECT *, {SQL_SIM} AS sim FROM v)
SELECT id, CASE WHEN p IS NULL AND r IS NULL THEN 'no_change' WHEN p IS NULL THEN 'no_data' WHEN r IS NULL THEN 'new_data' ELSE {_LIGHT} END AS status,
  CASE WHEN p IS NULL AND r IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 WHEN r IS NULL THEN 0.8 WHEN a = b THEN 1.0 ELSE sim END AS confidence FROM s"""
)
def q35b_light_compare(spark, sf_dir):
    df = add(names.pairs(spark, sf_dir), c=compare.compare_lightly("title", F.col("p_title"), F.col("r_title")))
    return df.select("id", "c.status", "c.confidence")


# --- updates ----------------------------------------------------------------------------------------------------

SQL_UPDATE = f"""SELECT id, CASE WHEN r_studio IS NULL AND p_studio <> '' THEN p_studio END AS studio_name, CASE WHEN trim(coalesce(r_title, '')) = '' AND p_title <> '' THEN p_title END AS title,
  CASE WHEN trim(coalesce(r_date, '')) = '' AND p_date <> '' THEN p_date END AS date, CASE WHEN trim(coalesce(r_studio_code, '')) = '' AND p_studio_code <> '' THEN p_studio_code END AS code,
  CASE WHEN p_studio IS NOT NULL AND (p_title IS NOT NULL OR p_date IS NOT NULL OR p_studio_code IS NOT NULL) THEN true END AS organized FROM ({names.SQL_PAIRS})"""


def _updates(spark, sf_dir) -> DataFrame:
    cols = lambda p: {f: F.col(f"{p}_{f}") for f in compare.FIELDS}
    df = add(names.pairs(spark, sf_dir), u=update.build_update(cols("p"), cols("r"), mark_organized=True))
    return df.select("id", "u.*")


@query(SQL_UPDATE)
def q36_update_build(spark, sf_dir):
    return _updates(spark, sf_dir)


SQL_SEGMENT_IDS = "SELECT 'S' || CAST(row_number() OVER (ORDER BY c_mktsegment) AS STRING) AS id, c_mktsegment || CASE WHEN c_mktsegment < 'C' THEN ' Studio' WHEN c_mktsegment < 'H' THEN ' Studio and More' ELSE ' Works' END AS name FROM (SELECT DISTINCT c_mktsegment FROM customer)"


def _segment_studios(spark, sf_dir) -> DataFrame:
    """A handful of studios from the market segments: some whose names match whole, some in part, some not."""
    from pyspark.sql import Window

    seg = names.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    name = F.concat("c_mktsegment", F.when(F.col("c_mktsegment") < "C", " Studio").when(F.col("c_mktsegment") < "H", " Studio and More").otherwise(" Works"))
    return seg.select(F.concat(F.lit("S"), F.row_number().over(Window.orderBy("c_mktsegment")).cast("string")).alias("id"), name.alias("name"))


SQL_RESOLVED = f"""u AS ({SQL_UPDATE}), st AS ({SQL_SEGMENT_IDS}), n AS (SELECT DISTINCT trim(studio_name) AS n FROM u WHERE trim(studio_name) <> ''),
ids AS (SELECT n, coalesce((SELECT min(id) FROM st WHERE name = n), (SELECT arg_min(id, name) FROM st WHERE contains(lower(name), lower(n)))) AS studio_id FROM n),
res AS (SELECT u.*, ids.studio_id FROM u LEFT JOIN ids ON trim(u.studio_name) = n)"""
SQL_OUTCOME = f"""{SQL_RESOLVED}, chk AS (SELECT *, coalesce(studio_id, title, date, code, CAST(organized AS STRING)) IS NULL AS nothing,
  date IS NOT NULL AND coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%Y/%m/%d'), try_strptime(date, '%m/%d/%Y')) IS NULL AS bad FROM res)"""


@query(f"WITH {SQL_OUTCOME} SELECT id, CASE WHEN nothing THEN 'skipped' WHEN length(title) > 500 OR bad THEN 'failed' ELSE 'ready' END AS outcome, CASE WHEN NOT nothing AND bad THEN 'Invalid date format: ' || date END AS error FROM chk")
def q37_update_validate(spark, sf_dir):
    df = update.resolve_studios(_updates(spark, sf_dir), _segment_studios(spark, sf_dir))
    return update.validate(df).select("id", "outcome", "error")


@query(f"WITH {SQL_RESOLVED} SELECT id, studio_name, studio_id FROM res")
def q38_studio_resolve(spark, sf_dir):
    return update.resolve_studios(_updates(spark, sf_dir), _segment_studios(spark, sf_dir)).select("id", "studio_name", "studio_id")


@query(
    f"""WITH v AS (SELECT id, p_title AS name_value, r_studio AS path_value, CASE WHEN length(id) % 2 = 0 THEN 0.5 END AS conf FROM ({names.SQL_PAIRS})),
f AS (SELECT id, name_value, path_value, coalesce(conf, 1.0) AS conf, coalesce(name_value, '') <> '' AS hn, coalesce(path_value, '') <> '' AS hp FROM v)
SELECT id, CASE WHEN hp AND (NOT hn OR conf < 0.6) THEN path_value WHEN hn THEN name_value END AS value, CASE WHEN hp AND (NOT hn OR conf < 0.6) THEN 'path' WHEN hn THEN 'filename' END AS source,
  CASE WHEN hp AND (NOT hn OR conf < 0.6) THEN 0.6 WHEN hn THEN conf ELSE 0.0 END AS confidence FROM f"""
)
def q39_path_merge(spark, sf_dir):
    df = names.pairs(spark, sf_dir).withColumn("conf", F.when(F.length("id") % 2 == 0, 0.5))
    return add(df, x=resolve.choose(F.col("p_title"), F.col("r_studio"), F.col("conf"))).select("id", "x.value", "x.source", "x.confidence")


@query(f"WITH {SQL_OUTCOME}, o AS (SELECT CASE WHEN nothing THEN 'skipped' WHEN length(title) > 500 OR bad THEN 'failed' ELSE 'ready' END AS outcome FROM chk) SELECT count(*) AS processed, count(*) FILTER (outcome = 'ready') AS successful, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM o")
def q39b_update_totals(spark, sf_dir):
    return update.totals(update.validate(update.resolve_studios(_updates(spark, sf_dir), _segment_studios(spark, sf_dir))))


# --- evaluation against labels ----------------------------------------------------------------------------------------

#: Parsed and expected values of each field, with gaps and errors at known places.
_LABELLED = {"row_id": "p_partkey", "p_pattern": "'[{token0}] {title}'", "r_pattern": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[{token0}] {title}' ELSE '{title}' END"}
for _i, _f in enumerate(values.FIELDS):
    _k = _i + 3
    _LABELLED[f"p_{_f}"] = f"CASE WHEN p_partkey % {_k} = 0 THEN NULL WHEN p_partkey % {_k} = 1 THEN '' ELSE p_name END"
    _LABELLED[f"r_{_f}"] = f"CASE WHEN p_partkey % {_k + 2} = 0 THEN NULL WHEN p_partkey % {_k + 2} = 1 THEN p_type ELSE p_name END"
SQL_LABELLED = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _LABELLED.items()) + " FROM part"
SQL_LONG = " UNION ALL ".join(f"SELECT row_id, {i} AS ord, '{f}' AS field, p_{f} AS parsed, r_{f} AS expected FROM lab" for i, f in enumerate(values.FIELDS))
_P, _R = "coalesce(parsed, '') <> ''", "coalesce(expected, '') <> ''"


def _labelled(spark, sf_dir) -> DataFrame:
    return names.table(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in _LABELLED.items()))


def _sql_rate(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0) * 100, 0.0), 2)"


@query(
    f"""WITH lab AS ({SQL_LABELLED}), long AS ({SQL_LONG}), m AS (SELECT coalesce(field, 'overall') AS field, count(*) FILTER ({_R} AND NOT {_P}) AS fn, count(*) FILTER ({_R}) AS fn_of,
  count(*) FILTER (NOT {_R} AND {_P}) AS fp, count(*) FILTER (NOT {_R}) AS fp_of, count(*) FILTER ({_R} AND parsed = expected) AS acc, count(*) FILTER ({_R}) AS acc_of FROM long GROUP BY ROLLUP (field))
SELECT field, fn, fn_of, {_sql_rate('fn', 'fn_of')} AS fn_rate, fp, fp_of, {_sql_rate('fp', 'fp_of')} AS fp_rate, acc, acc_of, {_sql_rate('acc', 'acc_of')} AS acc_rate FROM m"""
)
def q40_labelled_metrics(spark, sf_dir):
    return evaluate.field_metrics(evaluate.long_form(_labelled(spark, sf_dir)))


_PERFECT = " AND ".join(f"p_{f} IS NOT DISTINCT FROM r_{f}" for f in values.FIELDS)


@query(
    f"""WITH lab AS ({SQL_LABELLED}), c AS (SELECT count(*) AS files, count(*) FILTER (coalesce(r_pattern, '') <> '' AND p_pattern = r_pattern) AS pattern_matches, count(*) FILTER (coalesce(r_pattern, '') <> '') AS pattern_of, count(*) FILTER ({_PERFECT}) AS perfect FROM lab)
SELECT files, pattern_matches, pattern_of, {_sql_rate('pattern_matches', 'pattern_of')} AS pattern_rate, perfect, {_sql_rate('perfect', 'files')} AS perfect_rate FROM c"""
)
def q40b_file_metrics(spark, sf_dir):
    return evaluate.file_metrics(_labelled(spark, sf_dir))


@query(
    f"""WITH lab AS ({SQL_LABELLED}), long AS ({SQL_LONG}), t AS (SELECT *, CASE WHEN {_R} AND NOT {_P} THEN 'false_negative' WHEN NOT {_R} AND {_P} THEN 'false_positive' WHEN {_R} AND parsed <> expected THEN 'incorrect' END AS type FROM long),
n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY row_id) AS k FROM t WHERE type IS NOT NULL)
SELECT row_id, field, type, parsed, expected FROM n WHERE k <= 10 ORDER BY ord, row_id LIMIT 30"""
)
def q41_mismatch_samples(spark, sf_dir):
    return evaluate.mismatches(evaluate.long_form(_labelled(spark, sf_dir))).select("row_id", "field", "type", "parsed", "expected")


@query(
    f"""SELECT row_id, CASE WHEN p_title IS NOT DISTINCT FROM r_title THEN p_title ELSE '{{"expected":' || coalesce('"' || r_title || '"', 'null') || ',"returned":' || coalesce('"' || p_title || '"', 'null') || '}}' END AS title, p_title IS DISTINCT FROM r_title AS differs FROM ({SQL_LABELLED})"""
)
def q42_diff(spark, sf_dir):
    df = evaluate.diff_rows(_labelled(spark, sf_dir), ["title"])
    return df.select("row_id", "title", evaluate.is_discrepancy(F.col("title")).alias("differs"))


@query(f"SELECT DISTINCT r_studio AS value FROM ({SQL_LABELLED}) WHERE coalesce(r_studio, '') <> '' AND coalesce(p_studio, '') = ''")
def q43_suggestions(spark, sf_dir):
    return evaluate.missing_values(_labelled(spark, sf_dir), "studio")


@query(f"SELECT p_group AS value, count(*) AS n FROM ({SQL_LABELLED}) WHERE coalesce(p_group, '') <> '' AND coalesce(r_group, '') = '' GROUP BY 1")
def q43b_false_groups(spark, sf_dir):
    return evaluate.false_groups(_labelled(spark, sf_dir))


@query("SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first_idx FROM part GROUP BY 1 HAVING count(*) > 1")
def q44_duplicate_names(spark, sf_dir):
    return checks.duplicate_names(names.table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT lower(p_name) AS alias, count(DISTINCT p_brand) AS n, min(p_brand) AS first_canonical FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def q45_alias_collision(spark, sf_dir):
    return checks.alias_collisions(names.table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("SELECT s_suppkey, 'NATION_' || (s_suppkey % 40) AS target FROM supplier WHERE ('NATION_' || (s_suppkey % 40)) NOT IN (SELECT n_name FROM nation)")
def q46_referential_anti(spark, sf_dir):
    df = names.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'NATION_' || CAST(s_suppkey % 40 AS STRING) AS target")
    return checks.unknown_targets(df, names.table(spark, sf_dir, "nation"), "target", "n_name")


@query(
    f"""WITH lab AS ({SQL_LABELLED}), long AS ({SQL_LONG}), m AS (SELECT coalesce(field, 'overall') AS field, count(*) FILTER ({_R} AND NOT {_P}) AS fn, count(*) FILTER ({_R}) AS fn_of,
  count(*) FILTER (NOT {_R} AND {_P}) AS fp, count(*) FILTER ({_R} AND parsed = expected) AS acc FROM long GROUP BY ROLLUP (field)),
s AS (SELECT field, round(coalesce(CAST(acc AS DOUBLE) / nullif(fn_of - fn + fp, 0), 0), 6) AS "precision", round(coalesce(CAST(acc AS DOUBLE) / nullif(fn_of, 0), 0), 6) AS recall FROM m)
SELECT field, "precision", recall, round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 6) AS f1 FROM s"""
)
def q46b_scores(spark, sf_dir):
    return evaluate.scores(evaluate.field_metrics(evaluate.long_form(_labelled(spark, sf_dir))))


# --- reports ----------------------------------------------------------------------------------------------------


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Own' END AS studio, CASE WHEN p_partkey % 4 = 0 THEN 'T' ELSE q.title END AS title, CASE WHEN p_partkey % 5 = 2 THEN '2019' END AS date,
  CASE WHEN p_partkey % 6 = 0 THEN 'Ann, Bo' END AS performers, (p_partkey % 2 = 0) || '|' || (p_partkey % 4 = 0) || '|' || (p_partkey % 6 = 0) AS bold FROM part JOIN ({ORACLE_SQL["q29_full_parse"]}) q ON q.row_id = p_partkey"""
)
def q47_report_rows(spark, sf_dir):
    df = parse.parse_names(names.part_names(spark, sf_dir)).withColumns({"id": F.col("row_id"), "filename": F.col("name")})
    own = {"own_studio": "CASE WHEN id % 2 = 0 THEN 'Own' WHEN id % 3 = 0 THEN '  ' END", "own_title": "CASE WHEN id % 4 = 0 THEN 'T' END", "own_date": "CAST(NULL AS STRING)", "own_code": "''", "own_performers": "CASE WHEN id % 6 = 0 THEN array('Ann', ' ', 'Bo') END"}
    df = records.report_rows(df.withColumns({k: F.expr(v) for k, v in own.items()}))
    flag = lambda i: F.get("bold_mask", F.lit(i)).cast("string")
    return df.select("id", "studio", "title", "date", "performers", F.concat_ws("|", flag(4), flag(5), flag(6)).alias("bold"))


@query(f"SELECT id, p_studio AS studio, p_date AS date, p_title AS filename FROM ({names.SQL_PAIRS}) ORDER BY coalesce(p_studio, ''), id")
def q48_scene_list_sorted(spark, sf_dir):
    df = names.pairs(spark, sf_dir).select("id", F.col("p_studio").alias("studio"), F.col("p_date").alias("date"), F.col("p_title").alias("filename"))
    return records.scene_list(df, "studio")


_FILES = "array(named_struct('id', '1', 'path', '', 'basename', p_name || '.txt', 'parent_folder_path', 'Media'), named_struct('id', '2', 'path', '', 'basename', p_name || '-long.MP4', 'parent_folder_path', CASE WHEN p_partkey % 2 = 0 THEN 'Media/' || p_brand END), named_struct('id', '3', 'path', '', 'basename', CASE WHEN p_partkey % 3 = 0 THEN 'x.mkv' ELSE p_name || '.nfo' END, 'parent_folder_path', ''))"


@query("SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'x.mkv' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Media/' || p_brand || '/' ELSE '' END || p_name || '-long.MP4' END AS filename FROM part")
def q49_primary_file(spark, sf_dir):
    df = names.table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS id", f"{_FILES} AS files")
    return records.file_names(df, with_path=True, first=False)


@query(
    """SELECT l_orderkey AS row_id, l_linenumber AS line, CASE l_linenumber % 3 WHEN 0 THEN 'part=' || l_orderkey WHEN 1 THEN 'scene=4' END AS old FROM lineitem"""
)
def q50_old_sequence(spark, sf_dir):
    made = "CASE l_linenumber % 3 WHEN 0 THEN 'Foo Part' || CAST(l_orderkey AS STRING) WHEN 1 THEN 'sc4 x' ELSE 'sc-1234' END"
    df = add(names.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row_id", "l_linenumber AS line", f"{made} AS v"), s=structure.old_sequence(F.col("v")))
    return df.select("row_id", "line", F.concat(F.col("s.key"), F.lit("="), F.col("s.number").cast("string")).alias("old"))


@query("SELECT p_partkey AS row_id, p_name AS title, CAST(p_size AS BIGINT) AS number FROM part")
def q51_old_title(spark, sf_dir):
    df = names.table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("v"))
    return add(df, t=structure.old_title(F.col("v"))).select(F.col("p_partkey").alias("row_id"), "t.title", "t.number")


@query("SELECT o_orderkey AS n, CAST(ceil(o_orderkey / 20.0) AS BIGINT) AS batches, o_orderkey / 2.0 + ceil(o_orderkey / 20.0) * 0.6 AS seconds FROM orders")
def q52_cost_estimate(spark, sf_dir):
    return add(names.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")), e=update.estimate(F.col("n"))).select("n", "e.batches", "e.seconds")


@query(
    """SELECT date_trunc('hour', ts) AS start, CASE WHEN user_id BETWEEN 100 AND 99999 THEN '[{title}] {studio_code} - {date} {token3}' ELSE '[{token0}] {title} - {date} {token3}' END AS pattern, CAST(CAST(ts AS DATE) AS STRING) AS date, count(*) AS n FROM events GROUP BY ALL"""
)
def s01_stream_parse(spark, sf_dir):
    from ..streaming import names as stream

    return stream.run_events(spark, sf_dir)
