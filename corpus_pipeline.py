"""The corpus pipeline: language ID, quality, line dedup, near-dedup, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is the Parquet that its
predecessor's result was written to, and returns a DataFrame. A stage may keep tables in the shared folder until its
result is written; the next stage deletes them, and run() the results that it has no more need of. No SQL expresses the whole, so ORACLE_SQL is None; tests hold run()
against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filemeta.llm import common, langid, line_dedup, near_dedup, packing, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the identifier accepts."""
    common.ship(spark)
    return _columns(langid.predict(docs, langid.fit(docs)).where("not rejected"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good."""
    common.ship(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, model).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing but blanks is left goes."""
    cut = line_dedup.dedup_lines(docs)
    return _columns(cut.where("n_removed = 0 or trim(text) <> ''").withColumn("n_chars", F.length("text").cast("long")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; one row of those that share id and
    text."""
    keep = near_dedup.near_groups(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.count("*").alias("__rows"))
    keep = common.stored(spark, keep, "kept")
    rows = docs.withColumn("__own", F.xxhash64("text"))
    rows = rows.join(keep, rows.doc_id.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")))
    out = _columns(rows.where("__rows = 1"))
    repeated = rows.where("__rows > 1")
    return out if keep.where("__rows > 1").isEmpty() else out.unionByName(_columns(repeated.dropDuplicates(["doc_id", "__own"])))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    import public_tokenizers

    common.ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Tables that a stage keeps until its result is written: application id -> paths.
_KEPT: dict[str, list[str]] = {}


def _stage(function: Stage) -> Stage:
    """The stage, which first deletes the tables that the stage before it kept, and no others."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        common.drop(spark, *_KEPT.pop(app, []))
        with common.noted() as paths:
            result = function(spark, docs, sf_dir)
        _KEPT[app] = paths
        return result

    return stage


STAGES = [
    ("language_id", _stage(identify_language)),
    ("quality", _stage(classify_quality)),
    ("line_dedup", _stage(dedup_lines)),
    ("near_dedup", _stage(dedup_near)),
    ("packing", _stage(pack_sequences)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        written = common.stored(spark, result, f"stage-{name}")
        if k:
            common.drop(spark, docs)
        docs = written
    return docs
