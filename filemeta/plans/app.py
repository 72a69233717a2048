"""Entry points: a request in JSON, an evaluation of a list of names, a check of dictionaries."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, codes, dates, evaluate, records, studios
from ..sources import catalog, sinks
from ..sources import text as scans
from . import parse

DEFAULTS = {
    "catalogue": {"scheme": "http", "host": "localhost", "port": "9999", "cookie": "", "api_key": ""},
    "report": {"path": "", "folder": "", "limit": 0, "studio_ids": "", "with_path": False},
    "update": {"batch": 20, "pause": 0.5, "dry_run": True, "mark_organized": False},
}


def merge_config(file: dict | None = None, args: dict | None = None) -> dict:
    """Defaults, over them the file's sections key by key, over them flat arguments by key. Unknown sections are kept."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    for k, v in (file or {}).items():
        out[k] = {**out.get(k, {}), **v} if isinstance(v, dict) else v
    for k, v in (args or {}).items():
        for part in out.values():
            if isinstance(part, dict) and k in part and v is not None:
                part[k] = v
    return out


def row_limit(v) -> int | None:
    """A positive whole number, or None for anything else."""
    try:
        return n if (n := int(v)) > 0 else None
    except (TypeError, ValueError):
        return None


def session() -> SparkSession:
    return SparkSession.builder.appName("filemeta").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def report(spark: SparkSession, scenes: DataFrame, dimension: DataFrame | list[tuple], with_path: bool = False) -> DataFrame:
    """Report rows of catalogue records: a record's own values before parsed ones. A record whose name cannot be
    parsed has null fields; it stops no other."""
    name = records.file_name(records.primary_file(F.col("files")), with_path)
    rows = scenes.select("id", name.alias("filename"), F.col("studio.name").alias("own_studio"), F.col("title").alias("own_title"), F.col("date").alias("own_date"), F.col("code").alias("own_code"), F.transform("performers", lambda p: p["name"]).alias("own_performers"))
    rows = rows.where(~text.blank(F.col("filename"))).withColumn("name", F.col("filename"))
    return records.report_rows(parse.parse_names(rows, known=dimension, existing="own_studio"))


def run(request: dict, spark: SparkSession | None = None, log=lambda *_: None) -> dict:
    """{args: {mode: run | report | list, ...}, config: {...}} to {output} or {error}."""
    try:
        spark = spark or session()
        args = request.get("args") or {}
        config = merge_config(request.get("config"), args)
        mode = args.get("mode", "run")
        if mode not in ("run", "report", "list"):
            return {"error": f"unknown mode {mode!r}"}
        options = {k: str(v) for k, v in config["catalogue"].items() if v not in (None, "")}
        static = studios.rows_from_dictionary(args.get("studios") or [])
        dimension = catalog.studios_or_static(spark, static, log, **options)
        more = {"limit": str(n)} if (n := row_limit(config["report"]["limit"])) else {}
        if config["report"]["studio_ids"]:
            more["studio_ids"] = str(config["report"]["studio_ids"])
        scenes = catalog.read(spark, **options, **more)
        if mode == "list":
            return {"output": [r.asDict() for r in records.file_names(scenes, bool(config["report"]["with_path"])).orderBy("id").collect()]}
        found = report(spark, scenes, dimension, bool(config["report"]["with_path"])).orderBy("id")
        path = sinks.report_path(config["report"]["path"] or None, config["report"]["folder"] or None, args.get("plugin_dir"))
        found, seen = records.observed(found)
        if path.suffix == ".xlsx":
            sinks.write_workbook(str(path), [sinks.Sheet("Report", found, bold="bold_mask")])
        else:
            found.write.mode("overwrite").parquet(str(path.absolute()))
        return {"output": {"report": str(path), "rows": seen.get["rows"]}}
    except Exception as e:  # noqa: BLE001  a request is answered, whatever happens
        return {"error": str(e)}


def main() -> int:
    """JSON from standard input, an answer on standard output; 1 on an error."""
    try:
        request = json.load(sys.stdin)
    except ValueError as e:
        print(json.dumps({"error": f"no JSON: {e}"}))
        return 1
    answer = run(request, log=lambda *a: print(*a, file=sys.stderr))
    print(json.dumps(answer, default=str))
    return int("error" in answer)


def evaluate_blind(rows: DataFrame) -> dict:
    """Coverage, match rate, the 20 most frequent patterns and anomalies of evaluation rows; computed from one stored pass."""
    rows = rows.withColumn("match_rate", F.col("match_stats.match_rate"))
    cover = evaluate.coverage(rows).first().asDict()
    total, mean = cover.pop("total_rows"), cover.pop("avg_match_rate")
    top = evaluate.top_patterns(rows, pattern="filename_pattern").collect()
    odd = evaluate.anomalies(rows, "unlabeled_filename_tokens").first().asDict()
    return {"mode": "blind", "total_rows": total, "field_coverage": cover, "avg_match_rate": mean, "pattern_histogram": [{"pattern": r.pattern, "count": r.n} for r in top], "anomalies": odd}


def labelled_pairs(rows: DataFrame, reference: DataFrame) -> DataFrame:
    side = lambda df: evaluate.as_text(df.withColumnRenamed("filename_pattern", "pattern").select("row_id", "pattern", *evaluate.values.FIELDS))
    return evaluate.pair(side(rows), side(reference))


def evaluate_labelled(rows: DataFrame, reference: DataFrame, samples: int = 10) -> dict:
    """Key metrics, counts by field, samples of mismatches and suggestions for the dictionaries, against labelled rows
    of the same row_id."""
    pairs = labelled_pairs(rows, reference)
    long = evaluate.long_form(pairs)
    fields = {r.field: r.asDict() for r in evaluate.field_metrics(long).collect()}
    files = evaluate.file_metrics(pairs).first()
    key = {"pattern_match_rate": files.pattern_rate, "metadata_false_negative_rate": fields["overall"]["fn_rate"], "metadata_false_positive_rate": fields["overall"]["fp_rate"], "metadata_accuracy_rate": fields["overall"]["acc_rate"], "parsed_perfect_rate": files.perfect_rate}
    wrong = [r.asDict() for r in evaluate.mismatches(long, samples).collect()]
    return {"mode": "reference", "key_metrics": key, "summary": files.asDict(), "field_breakdown": fields, "sample_mismatches": wrong, "suggestions": evaluate.suggestions(pairs)}


def evaluation_sheets(rows: DataFrame, reference: DataFrame | None = None) -> list[sinks.Sheet]:
    """One sheet of results; with labelled rows three: reference, results, and the differences, marked."""
    columns = scans.LABELLED
    shown = lambda df: records.export_row(df.orderBy("row_id").select(*columns))
    if reference is None:
        return [sinks.Sheet("Results", shown(rows))]
    fields = [c for c in columns if c not in ("input", "match_stats", "unlabeled_filename_tokens")]
    flat = lambda df: evaluate.as_text(df, columns).select("row_id", *columns)
    pairs = evaluate.pair(flat(rows), flat(reference))
    cells = [evaluate.diff_cell(F.col(f"p_{c}"), F.col(f"r_{c}")).alias(c) if c in fields else F.col(f"{'r' if c.startswith('unlabeled') else 'p'}_{c}").alias(c) for c in columns]
    marked = lambda v: v is not None and '"expected":' in str(v)
    return [sinks.Sheet("Reference", shown(reference)), sinks.Sheet("Results", shown(rows)), sinks.Sheet("Diff", shown(pairs.select("row_id", *cells)), highlight=marked)]


def check_dictionaries(spark: SparkSession, studio_rows: list[dict], rules: list[dict], aliases: dict[str, str]) -> dict[str, list]:
    """Failures by check; a rule that does not compile counts too."""
    known = spark.createDataFrame([(i, (s.get("canonical_name") or "").removesuffix("^")) for i, s in enumerate(studio_rows)], "idx int, canonical_name string")
    pairs = [(a.removesuffix("^"), (s.get("canonical_name") or "").removesuffix("^")) for s in studio_rows for a in studios._listed(s.get("aliases"))]
    given = spark.createDataFrame(pairs, "alias string, canonical string")
    mapped = spark.createDataFrame(list(aliases.items()), "alias string, canonical string")
    named = spark.createDataFrame([(str(r.get("code_patterns")), r.get("studio")) for r in rules], "rule string, studio string")
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "schema": checks.schema_errors(studio_rows, checks.STUDIO_SCHEMA, "studios"),
        "duplicate_names": rows(checks.duplicate_names(known)),
        "alias_collisions": rows(checks.alias_collisions(given.unionByName(mapped))),
        "unknown_alias_targets": rows(checks.unknown_targets(mapped, known, "canonical", "canonical_name")),
        "unknown_code_studios": rows(checks.unknown_targets(named, known, "studio", "canonical_name")),
        "bad_rules": [r for r in rules if len(codes.compile_rules([r])) < len([r["code_patterns"]] if isinstance(r.get("code_patterns"), str) else r.get("code_patterns") or [None])],
    }


def check_cli(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description="check dictionaries; the exit code is 1 if a check fails")
    p.add_argument("studios")
    p.add_argument("--rules")
    p.add_argument("--aliases")
    p.add_argument("--dictionary", help="a further dictionary, checked against --schema")
    p.add_argument("--schema", help="JSON schema of --dictionary")
    a = p.parse_args(argv)
    spark = spark or session()
    load = lambda path, default: (scans.dictionary(spark, path, cache=False) if path else None) or default
    found = check_dictionaries(spark, load(a.studios, []), load(a.rules, []), load(a.aliases, {}))
    if a.dictionary and a.schema:
        found["dictionary"] = checks.schema_errors(load(a.dictionary, None), load(a.schema, {}), "dictionary")
    for name, rows in found.items():
        print(f"{name}: {'ok' if not rows else json.dumps(rows, default=str)}")
    return int(any(found.values()))


def evaluate_cli(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description="evaluate the parser on a list of names")
    p.add_argument("input")
    p.add_argument("--reference", help="labelled rows in CSV, or the sheet Reference of a workbook")
    p.add_argument("--limit", type=int)
    p.add_argument("--samples", type=int, default=10)
    p.add_argument("--studios", help="JSON dictionary of studios")
    p.add_argument("--dates", help="JSON dictionary of date shapes")
    p.add_argument("--output", help="JSON file for the metrics")
    p.add_argument("--workbook", help="file for the rows")
    a = p.parse_args(argv)
    spark = spark or session()
    dim = studios.rows_from_dictionary(scans.dictionary(spark, a.studios) or [] if a.studios else [])
    names = scans.workbook_names(spark, a.input, limit=a.limit) if a.input.lower().endswith(".xlsx") else scans.names(spark, a.input, a.limit)
    shapes = dates.compile_shapes(scans.dictionary(spark, a.dates)) if a.dates else None
    rows = parse.evaluation_rows(names, known=dim, shapes=shapes).cache()
    try:
        if a.reference:
            # Rows pair by place; a limit holds for both sides.
            rows, reference = _by_place(rows, scans.labelled(spark, a.reference), a.limit)
            found = evaluate_labelled(rows, reference, a.samples)
        else:
            found, reference = evaluate_blind(rows), None
        if a.workbook:
            sinks.write_workbook(a.workbook, evaluation_sheets(rows, reference))
    finally:
        rows.unpersist()
    print(json.dumps(found, indent=2, default=str))
    if a.output:
        Path(a.output).parent.mkdir(parents=True, exist_ok=True)
        sinks.write_metrics(found, a.output)
    return 0


def _by_place(rows: DataFrame, reference: DataFrame, limit: int | None):
    """Both sides with row_id 0, 1, ... in their order; labelled lists are small, a window over all rows is fine."""
    from pyspark.sql import Window

    number = lambda df: df.withColumn("row_id", F.row_number().over(Window.orderBy("row_id")) - 1)
    reference = number(reference)
    return number(rows), reference.where(F.col("row_id") < limit) if limit and limit > 0 else reference


if __name__ == "__main__":
    sys.exit(main())
