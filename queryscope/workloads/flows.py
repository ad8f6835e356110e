"""Queries over sources, sinks and streams; each one writes below its own new folder."""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope.operators.similarity import hash_embedding
from queryscope.plans import lint
from queryscope.session import shared_folder
from queryscope.sources import records, tabular
from queryscope.sources import scripts as files
from queryscope.streaming import queries as ST
from queryscope.workloads import corpus as C
from queryscope.workloads import inputs as I
from queryscope.workloads.registry import query, table
from queryscope.workloads.scripts import _WITH


def _folder(spark, name):
    return shared_folder(spark, name)


BATCHES = 3


def _stream(spark, df, name, batches=BATCHES):
    """Store a frame as files in the order of time and read them back as a stream, one file per micro-batch.

    Files are taken by their time of writing, so the parts are written one after the other.
    """
    path = _folder(spark, name) + "/in"
    if "ts" in df.columns:
        at = F.unix_micros(F.col("ts").cast("timestamp")) if df.schema["ts"].dataType.typeName() != "long" else F.col("ts")
        cuts = (df.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)])).first()[0] or []) if batches > 1 else []
    else:
        at, cuts = F.xxhash64(*df.columns), [-(2**62), 2**62][:batches - 1]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if low is None else at > low
        part = part if high is None else part & (at <= high)
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(spark, df, name, mode="append"):
    out, state = _folder(spark, name), _folder(spark, name + "-state")
    df.writeStream.outputMode(mode).format("parquet").option("path", out + "/out").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out + "/out")


@query("scan_scripts", _WITH + "SELECT sql, count(*) AS n FROM scripts GROUP BY 1")
def scan_scripts(spark, sf_dir):
    path = _folder(spark, "scripts") + "/models"
    c = C.corpus(spark, sf_dir)
    c.select(F.concat(F.lit("﻿"), "sql").alias("value")).write.option("lineSep", "\u0003").text(path)
    found = files.scan_scripts(spark, [path + "/**/*.txt"])
    texts = found.select(F.explode(F.split("sql", "\u0003")).alias("sql")).filter("sql <> ''")
    return texts.select(F.regexp_replace("sql", "^﻿", "").alias("sql")).groupBy("sql").agg(F.count(F.lit(1)).alias("n"))


@query("read_csv_typed", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def read_csv_typed(spark, sf_dir):
    path = _folder(spark, "csv") + "/orders"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    tabular.export(o, "csv", path)
    out = tabular.read_csv_typed(spark, path)
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("export_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def export_json(spark, sf_dir):
    path = _folder(spark, "json") + "/customer"
    c = table(spark, sf_dir, "customer")
    tabular.export(c, "json", path)
    return spark.read.schema(c.schema).json(path)


@query("infer_ddl", "SELECT 'CREATE TABLE IF NOT EXISTS part (\"p_partkey\" INTEGER, \"p_name\" TEXT, \"p_brand\" TEXT, \"p_type\" TEXT, \"p_size\" INTEGER, \"p_retailprice\" DOUBLE);' AS ddl, count(*) AS n FROM part")
def infer_ddl(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.agg(F.lit(tabular.infer_ddl(p, "part")).alias("ddl"), F.count(F.lit(1)).alias("n"))


@query(
    "render_inserts",
    "SELECT b AS batch_no, 'INSERT INTO supplier (s_suppkey, s_name, s_nationkey)' || chr(10) || 'VALUES' || chr(10) || string_agg(r, ',' || chr(10) ORDER BY s_suppkey) || ';' AS sql FROM "
    "(SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS b, '  (' || s_suppkey || ', ' || CASE WHEN s_suppkey % 5 = 0 THEN 'NULL' ELSE '''' || s_name || '''''s''' END || ', ' || s_nationkey || ')' AS r FROM supplier) GROUP BY 1",
)
def render_inserts(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 5 != 0, F.concat("s_name", F.lit("'s")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("s_name"), "s_nationkey")
    return tabular.render_inserts(s, "supplier", "s_suppkey", 7)


@query("usage_log_round_trip", f"SELECT ts, operation, dialect, round(duration_ms, 3) AS duration_ms, violation_count FROM {I.USAGE}")
def usage_log_round_trip(spark, sf_dir):
    path = _folder(spark, "usage") + "/log"
    records.append_usage(I.usage_log(spark, sf_dir), path)
    return records.read_usage_log(spark, path).select("ts", "operation", "dialect", "duration_ms", "violation_count")


@query(
    "findings_audit_rows",
    _WITH + "SELECT rule_id, severity, s.dialect, substr(sha256(s.sql), 1, 16) AS sql_hash, 'r1' AS request_id, count(*) AS n FROM found f JOIN scripts s USING (script_id) GROUP BY 1, 2, 3, 4",
)
def findings_audit_rows(spark, sf_dir):
    scripts = C.corpus(spark, sf_dir)
    rows = records.findings_audit_rows(lint.lint_corpus(scripts), scripts, "r1", 1700000000)
    return rows.groupBy("rule_id", "severity", "dialect", "sql_hash", "request_id").agg(F.count(F.lit(1)).alias("n"))


@query("query_findings", _WITH + "SELECT rule_id, severity, count(*) AS n FROM found WHERE severity = 'HIGH' AND rule_id = 'SQL-SARG-001' GROUP BY 1, 2")
def query_findings(spark, sf_dir):
    scripts = C.corpus(spark, sf_dir)
    path = _folder(spark, "findings") + "/store"
    records.append_findings(records.findings_audit_rows(lint.lint_corpus(scripts), scripts, "r1", 1700000000), path)
    found = records.query_findings(spark, path, "SQL-SARG-001", "high")
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- streams ------------------------------------------------------------------------------

@query("stream_lint", _WITH + "SELECT script_id, rule_id, count(*) AS n FROM found GROUP BY 1, 2")
def stream_lint(spark, sf_dir):
    scripts = _stream(spark, C.corpus(spark, sf_dir).select("script_id", "dialect", "sql"), "scripts")
    out = _folder(spark, "lint") + "/out"
    ST.stream_lint(scripts, out, _folder(spark, "lint-state")).start().awaitTermination()
    return spark.read.parquet(out).groupBy("script_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_volume",
    f"SELECT date_trunc('day', make_timestamp(ts * 1000000)) AS window_start, dialect, count(*) AS lints, CAST(sum(violation_count) AS BIGINT) AS violations FROM {I.USAGE} GROUP BY 1, 2",
)
def stream_volume(spark, sf_dir):
    log = I.usage_log(spark, sf_dir).withColumn("ts", F.timestamp_seconds("ts"))
    out = _complete(spark, ST.stream_volume(_stream(spark, log, "usage")), "volume")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _complete(spark, df, name):
    """Drain a windowed aggregate in update mode and keep each window's last value."""
    out, state = _folder(spark, name), _folder(spark, name + "-state")
    keys = [n for n in df.columns if n in ("window_start", "dialect", "event_type", "session_id", "started")]

    def write(batch, batch_id):
        batch.withColumn("__b", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/out/b={batch_id}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out + "/out").drop("b")
    values = [n for n in df.columns if n not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__b").alias("v")).select(*keys, "v.*")


@query(
    "stream_metrics",
    "SELECT w AS window_start, event_type, count(*) AS events, round(avg(value), 4) AS avg_value FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * i FOR i IN range(4)]) AS w FROM events) GROUP BY 1, 2",
)
def stream_metrics(spark, sf_dir):
    # one micro-batch: the rounded average of doubles follows the order they are added in
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = _complete(spark, ST.stream_metrics(_stream(spark, e, "events", batches=1), "24 hours", "6 hours", "1 day"), "metrics")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_sessions",
    f"WITH s AS {I.SESSIONS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM s), "
    "n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), x AS (SELECT session_id, k, min(ts) AS started, max(ts) + INTERVAL 8 HOUR AS ended, "
    "count(*) FILTER (WHERE step <> 'error') AS funnel_length, count(*) AS total_events FROM n GROUP BY 1, 2) "
    "SELECT session_id, started, ended, funnel_length, total_events FROM x WHERE ended <= (SELECT max(ts) FROM s) - INTERVAL 1 HOUR",
)
def stream_sessions(spark, sf_dir):
    out = _drain(spark, ST.stream_sessions(_stream(spark, I.sessions(spark, sf_dir), "sessions"), "8 hours", "1 hour"), "sessions")
    return out.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("ended", F.col("ended").cast("timestamp_ntz"))


@query("stream_rate_limit", I.limiter("3") + "SELECT CAST(user_id AS VARCHAR) AS key, event_id, allowed FROM r")
def stream_rate_limit(spark, sf_dir):
    return _drain(spark, ST.stream_rate_limit(_stream(spark, I.requests(spark, sf_dir), "requests"), 3, 6 * 3600.0), "limit")


@query("stream_dedup_alerts", f"SELECT DISTINCT logger AS dedup_key FROM {I.LOGS} WHERE level IN ('ERROR', 'CRITICAL')")
def stream_dedup_alerts(spark, sf_dir):
    logs = I.log_rows(spark, sf_dir).filter("level in ('ERROR', 'CRITICAL')").select(F.col("logger").alias("dedup_key"), "ts", "event_id")
    return _drain(spark, ST.stream_dedup_alerts(_stream(spark, logs, "alerts"), "60 days").select("dedup_key"), "alerts")


@query(
    "stream_upsert_cache",
    "SELECT sha256(CAST(p_size AS VARCHAR)) AS sql_hash, arg_max(p_name || p_partkey, p_partkey) AS output_sql, CAST(max(p_partkey) AS DOUBLE) AS created_at FROM part GROUP BY p_size",
)
def stream_upsert_cache(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entries = p.select(
        F.sha2(F.col("p_size").cast("string"), 256).alias("sql_hash"), F.concat("p_name", "p_partkey").alias("output_sql"),
        F.col("p_partkey").cast("double").alias("created_at"), hash_embedding(F.col("p_name"), 4).alias("embedding"),
    )
    path = _folder(spark, "cache") + "/versions"
    ST.stream_upsert_cache(_stream(spark, entries, "entries"), path, _folder(spark, "cache-state")).start().awaitTermination()
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == last).select("sql_hash", "output_sql", "created_at")
