"""Whole report files: every output file is a valid JSON document, and every script has a result object.

Rows are dealt to files; a task streams a document's head, its rows with commas, and the
tail, so memory does not grow with a file. Spark's own commit applies: files of failed
or repeated attempts never show.
"""
from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.plans import lint, score

SEVERITIES = ("critical", "high", "medium", "low")
ROWS_PER_FILE = 100_000


def script_results(scripts: DataFrame, findings: DataFrame) -> DataFrame:
    """(script_id, path, result): one JSON object per script, clean ones included, with counts by severity and its findings in order.

    Findings of one script are one array; their number is bounded by the script's text.
    A script without a path or dialect has nulls there, which JSON leaves out.
    """
    own = F.struct("line", "col", "rule_id", "severity", "title", "message", "snippet", "suggested_fix", "fixable")
    count = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    listed = findings.groupBy("script_id").agg(F.count(F.lit(1)).alias("total"), *[count(s) for s in SEVERITIES], F.array_sort(F.collect_list(own)).alias("findings"))
    kept = [c for c in ("script_id", "path", "dialect") if c in scripts.columns]
    both = scripts.select(*kept).join(listed.hint("merge"), "script_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    result = F.struct(
        *[F.col(c) for c in kept if c != "script_id"], F.when(F.coalesce("total", F.lit(0)) > 0, "findings").otherwise("ok").alias("status"),
        F.struct(number("total"), *[number(s) for s in SEVERITIES]).alias("summary"),
        F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)).alias("findings"),
    )
    return both.select("script_id", *[F.col("path") for c in kept if c == "path"], F.to_json(result).alias("result"))


def write_documents(rows: DataFrame, column: str, path: str, head: str, tail: str, files: int) -> None:
    """Write ``files`` documents of head, the rows' JSON texts with commas, and tail; null texts are left out."""

    def work(batches):
        def batch(lines):
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

        first = True
        yield batch([head])
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t is not None]
            lines = [t if first and i == 0 else "," + t for i, t in enumerate(texts)]
            first = first and not lines
            yield batch(lines)
        yield batch([tail])

    # a row without text keeps a run without rows from writing no file at all
    some = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias(column))
    rows.select(column).unionByName(some).repartition(max(1, files)).mapInArrow(work, "value string").write.text(path)


def _files(rows: DataFrame, files: int | None) -> int:
    return files or -(-rows.count() // ROWS_PER_FILE) or 1


def write_sarif(findings: DataFrame, scripts: DataFrame, path: str, rules: Sequence[lint.Rule] = lint.DEFAULT_RULES, files: int | None = None) -> None:
    """Run files in SARIF: each names the tool and its rules and holds a part of the results."""
    head, tail = score.sarif_document(findings.sparkSession, rules).first()
    rows = score.sarif_results(findings, scripts)
    write_documents(rows, "result", path, head, tail, _files(findings, files))


def write_report(scripts: DataFrame, findings: DataFrame, path: str, files: int | None = None, tool: str = "queryscope") -> None:
    """Report files with the run's summary in each and the result objects of a part of the scripts."""
    total = findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES]).first().asDict()
    n = scripts.count()
    head = json.dumps({"schema_version": score.REPORT_SCHEMA, "tool": tool, "summary": {"scripts": n, **total}})[:-1] + ', "results": ['
    write_documents(script_results(scripts, findings), "result", path, head, "]}", files or -(-n // ROWS_PER_FILE) or 1)


def read_documents(spark, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a JSON array field of all documents of a folder: ``schema`` describes one document, ``field`` names the array in it."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return whole.select(F.explode(f"d.{field}").alias("r")).select("r.*")
