"""Names and records made from the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Names of a few files dealt to all cores, as parsing takes far longer than reading; a scan that has a task for
    each core already, as any large one has, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


PART = {
    "row_id": "p_partkey",
    "name": "'[' || p_brand || '] ' || p_name || ' - ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' 1080p' WHEN 1 THEN ' 720p HQ' WHEN 2 THEN ' (2019)' WHEN 3 THEN ' Part ' || CAST(p_size AS STRING) ELSE '' END || CASE p_partkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' ELSE '.txt' END",
}
_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
SHIP = {
    "row_id": "l_orderkey",
    "line": "l_linenumber",
    "name": f"'Order n' || CAST(l_orderkey AS STRING) || ' at ' || CASE l_linenumber % 3 WHEN 0 THEN {_DAY} WHEN 1 THEN replace({_DAY}, '-', '') ELSE substr({_DAY}, 6, 5) || '-' || substr({_DAY}, 1, 4) END || ' Scene ' || CAST(l_linenumber AS STRING) || '.mkv'",
}
_ORDER_DAY = "CAST(o_orderdate AS DATE)"
#: Parsed values and what a record has already, with nulls, edits and other formats at known places.
PAIRS = {
    "id": "CAST(o_orderkey AS STRING)",
    "p_studio": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE c_mktsegment || ' Studio' END",
    "r_studio": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment || ' Productions' WHEN 2 THEN 'Elsewhere' WHEN 3 THEN c_mktsegment || 'X' WHEN 4 THEN '' ELSE lower(c_mktsegment) END",
    "p_title": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_name || ' Part ' || CAST(o_orderkey AS STRING) END",
    "r_title": "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN c_name || ' part ' || CAST(o_orderkey AS STRING) || '!' WHEN 2 THEN c_name WHEN 3 THEN 'zzz' WHEN 4 THEN '  ' ELSE c_name || ' Parts ' || CAST(o_orderkey AS STRING) END",
    "p_date": f"CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN substr(CAST({_ORDER_DAY} AS STRING), 1, 4) ELSE CAST({_ORDER_DAY} AS STRING) END",
    "r_date": f"CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN CAST({_ORDER_DAY} + 1 AS STRING) WHEN 2 THEN CAST({_ORDER_DAY} + 5 AS STRING) WHEN 3 THEN CAST({_ORDER_DAY} + 30 AS STRING) WHEN 4 THEN 'sooner' WHEN 5 THEN replace(CAST({_ORDER_DAY} AS STRING), '-', '/') ELSE CAST({_ORDER_DAY} AS STRING) END",
    "p_studio_code": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'AB ' || CAST(o_orderkey AS STRING) END",
    "r_studio_code": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ab' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'AB' || CAST(o_orderkey + 1 AS STRING) WHEN 3 THEN '' ELSE 'Q' END",
}


def _columns(spec: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in spec.items())


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in PART.items())))


def ship_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in SHIP.items())))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer; the customers are joined by key, Spark chooses how."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey)
    return both.selectExpr(*(f"{v} AS {k}" for k, v in PAIRS.items()))


SQL_PART = f"SELECT {_columns(PART)} FROM part"
SQL_SHIP = f"SELECT {_columns(SHIP)} FROM lineitem"
SQL_PAIRS = f"SELECT {_columns(PAIRS)} FROM orders JOIN customer ON o_custkey = c_custkey"

_KEYS = "SELECT lower(n_name) AS key, n_name AS canonical, n_nationkey % 5 = 0 AS exact_only, CAST(n_nationkey * 2 AS INT) AS ord FROM nation UNION ALL SELECT 'region' || CAST(n_regionkey AS STRING) || '_' || lower(n_name), n_name, false, CAST(n_nationkey * 2 + 1 AS INT) FROM nation"
SQL_STUDIOS = _KEYS


def studio_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A studio dimension from the nations: an alias with the region's number; every fifth name only matches whole."""
    n = table(spark, sf_dir, "nation")
    own = n.selectExpr("lower(n_name) AS key", "n_name AS canonical", "n_nationkey % 5 = 0 AS exact_only", "CAST(n_nationkey * 2 AS INT) AS ord")
    alias = n.selectExpr("'region' || CAST(n_regionkey AS STRING) || '_' || lower(n_name) AS key", "n_name AS canonical", "false AS exact_only", "CAST(n_nationkey * 2 + 1 AS INT) AS ord")
    return own.unionByName(alias)


#: Values that hold, name or only resemble a studio.
STUDIO_VALUES = {
    "id": "s_suppkey",
    "pos": "0",
    "value": "CASE s_suppkey % 6 WHEN 0 THEN upper(n_name) WHEN 1 THEN n_name || '-Scene' WHEN 2 THEN 'Scene - ' || n_name WHEN 3 THEN 'The' || n_name || 'Show' WHEN 4 THEN 'region' || CAST(n_regionkey AS STRING) || '_' || n_name || ' x' ELSE s_name END",
}
SQL_VALUES = f"SELECT {_columns(STUDIO_VALUES)} FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def studio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr(*(f"{v} AS {k}" for k, v in STUDIO_VALUES.items()))
