"""Inputs derived from the driver tables, as Spark frames and as DuckDB text.

Both sides use the same formulas; the DuckDB texts are subqueries to select from.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope import lookups as L
from queryscope.workloads.registry import table

RULES = ["SQL-CART-001", "SQL-SARG-001", "SQL-NOTIN-001", "SQL-SORT-001"]
NOW = 1706572800  # 2024-01-30 00:00:00 UTC

_DIALECTS_SQL = "[" + ",".join(f"'{d}'" for d in L.DIALECTS) + "]"
_RULES_SQL = "[" + ",".join(f"'{r}'" for r in RULES) + "]"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def usage_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = _k() % 5
    return e.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").cast("string").alias("anonymous_id"),
        F.col("event_type").alias("operation"),
        F.col("value").alias("duration_ms"),
        F.element_at(F.array(*[F.lit(d) for d in L.DIALECTS]), (F.col("user_id") % 8).cast("int") + 1).alias("dialect"),
        F.slice(F.array(*[F.lit(r) for r in RULES]), F.lit(1), n).alias("rules_triggered"),
        n.alias("violation_count"),
    )


USAGE = (
    "(SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS operation, value AS duration_ms, "
    f"{_DIALECTS_SQL}[user_id % 8 + 1] AS dialect, "
    f"{_RULES_SQL}[1:CAST(json_extract_string(props, '$.k') AS INTEGER) % 5] AS rules_triggered, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS violation_count FROM events)"
)

_STEP = {"view": "open", "click": "scan", "signup": "fix", "purchase": "export"}


def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = F.create_map(*[F.lit(x) for kv in _STEP.items() for x in kv])
    return e.select(
        F.col("user_id").alias("session_id"), F.coalesce(steps[F.col("event_type")], F.col("event_type")).alias("step"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )


SESSIONS = (
    "(SELECT user_id AS session_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'scan' WHEN 'signup' THEN 'fix' "
    "WHEN 'purchase' THEN 'export' ELSE event_type END AS step, ts, event_id FROM events)"
)


def conversion_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", F.col("event_type").alias("event"),
        F.when(F.col("user_id") % 3 == 0, "team").when(F.col("user_id") % 3 == 1, "pro").otherwise("enterprise").alias("plan"),
        "value", F.col("event_type").isin("signup", "purchase").alias("is_conversion"),
    )


def toggles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("rule_"), F.col("user_id") % 20).alias("rule_id"), (_k() % 2 == 0).alias("enabled"), "ts", "event_id"
    )


def history(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 1009).alias("ts"), F.col("lang").alias("dialect"),
        F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.col("text")).alias("sql"),
    )


HISTORY = "(SELECT doc_id AS id, doc_id * 7 % 1009 AS ts, lang AS dialect, CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE text END AS sql FROM documents)"


def http_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
    )


HTTP = (
    "(SELECT CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || event_type AS path, "
    "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms FROM events)"
)


def log_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 10 == 0, "CRITICAL").otherwise("ERROR")).otherwise("INFO")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), level.alias("level"), F.concat(F.lit("app."), F.col("user_id") % 7).alias("logger"),
        F.repeat(F.concat_ws(" ", "event_type", "props"), 40).alias("message"),
    )


LOGS = (
    "(SELECT event_id, ts, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 10 = 0 THEN 'CRITICAL' ELSE 'ERROR' END ELSE 'INFO' END AS level, "
    "'app.' || user_id % 7 AS logger, repeat(event_type || ' ' || props, 40) AS message FROM events)"
)


def requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def claims(spark, sf_dir):
    """Customers as signed-in users: one role, two roles, comma text, an unknown role, none."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    roles = (
        F.when(key % 5 == 0, ',"roles":["ADMIN"]').when(key % 5 == 1, ',"roles":["billing","developer"]')
        .when(key % 5 == 2, ',"roles":"developer, BILLING"').when(key % 5 == 3, ',"roles":["guest"]').otherwise("")
    )
    org = F.when(key % 2 == 0, F.concat(F.lit(',"org_id":"o'), key % 13, F.lit('"'))).otherwise(F.concat(F.lit(',"org":"p'), key % 13, F.lit('"')))
    tier = F.when(key % 4 == 0, ',"tier":"gold"').otherwise("")
    paths = F.array(*[F.lit(p) for p in [*L.ENDPOINT_POLICY, "/health"]])
    actions = F.array(*[F.lit(a) for a in ("read", "write", "delete", "admin")])
    return c.select(
        key.alias("request_id"),
        F.concat(F.lit('{"sub":"u'), key, F.lit('","email":"'), F.lower("c_mktsegment"), F.lit('@x.org","scope":"read  lint"'), roles, org, tier, F.lit("}")).alias("claims"),
        F.element_at(paths, (F.col("c_nationkey") % (len(L.ENDPOINT_POLICY) + 1)).cast("int") + 1).alias("path"),
        F.element_at(actions, (key % 4).cast("int") + 1).alias("action"),
    )


_PATHS_SQL = "[" + ",".join(f"'{p}'" for p in [*L.ENDPOINT_POLICY, "/health"]) + "]"
_NEEDED_SQL = "[" + ",".join(f"'{r}'" for r in L.ENDPOINT_POLICY.values()) + ", NULL]"
CLAIMS = (
    "(SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN ['ADMIN', 'BILLING', 'DEVELOPER'] WHEN 1 THEN ['BILLING', 'DEVELOPER'] "
    "WHEN 2 THEN ['BILLING', 'DEVELOPER'] ELSE [] END AS held, "
    f"{_PATHS_SQL}[c_nationkey % 10 + 1] AS path, {_NEEDED_SQL}[c_nationkey % 10 + 1] AS required_role, "
    "['read', 'write', 'delete', 'admin'][c_custkey % 4 + 1] AS action FROM customer)"
)


def limiter(cap: str) -> str:
    """Start of a DuckDB text with r(user_id, rn, ts, event_id, cap, held, allowed): each request after the one before it, and the accepted times still in its window of six hours."""
    return (
        f"WITH RECURSIVE e AS (SELECT user_id, ts, event_id, {cap} AS cap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
        "r(user_id, rn, ts, event_id, cap, held, allowed) AS (SELECT user_id, rn, ts, event_id, cap, [ts], true FROM e WHERE rn = 1 UNION ALL "
        "SELECT user_id, rn, ts, event_id, cap, CASE WHEN len(k) < cap THEN list_append(k, ts) ELSE k END, len(k) < cap FROM "
        "(SELECT e.user_id, e.rn, e.ts, e.event_id, e.cap, list_filter(r.held, lambda t: t > e.ts - INTERVAL 6 HOUR) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)) "
    )
