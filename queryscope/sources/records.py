"""Usage logs and stored findings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE_SCHEMA = (
    "ts long, anonymous_id string, operation string, duration_ms double, dialect string, rules_triggered array<string>, "
    "violation_count int, optimized_sql_changed boolean, os string, python string"
)


def read_usage_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank and corrupt lines are skipped; ``limit`` keeps the newest."""
    df = spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("ts is not null")
    return df if limit is None else df.orderBy(F.desc("ts")).limit(limit)


def append_usage(df: DataFrame, path: str, extras: tuple[str, ...] = ()) -> None:
    """Append records in the usage schema; extra columns only when they are primitive."""
    known = T._parse_datatype_string(USAGE_SCHEMA)
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields]
    cols += [F.col(x) for x in extras if not isinstance(df.schema[x].dataType, nested)]
    df.select(*cols).withColumn("duration_ms", F.round("duration_ms", 3)).write.mode("append").json(path)


def findings_audit_rows(findings: DataFrame, scripts: DataFrame, request_id: str, created_at) -> DataFrame:
    """Findings in stored form: the text by its short hash, gaps filled with defaults."""
    short = F.substring(F.sha2("sql", 256), 1, 16)
    joined = findings.join(scripts.select("script_id", "dialect", short.alias("sql_hash")).hint("merge"), "script_id")
    return joined.select(
        F.lit(request_id).alias("request_id"), "rule_id", F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("col", F.lit(1)).alias("col"),
        F.coalesce("dialect", F.lit("duckdb")).alias("dialect"), "sql_hash", F.lit(created_at).alias("created_at"),
    )


def append_findings(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("severity").parquet(path)


def query_findings(spark: SparkSession, path: str, rule: str | None = None, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored findings, newest first; a severity reads only its own folder, ``limit`` keeps the newest."""
    df = spark.read.parquet(path)
    if severity:
        df = df.filter(F.col("severity") == severity.upper())
    if rule:
        df = df.filter(F.col("rule_id") == rule)
    df = df.orderBy(F.desc("created_at"), F.asc("sql_hash"), F.asc("line"), F.asc("col"))
    return df if limit is None else df.limit(limit)
