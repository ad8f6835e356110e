"""Queries over usage, history, metrics, access and experiments."""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope import lookups as L
from queryscope.operators import access as A
from queryscope.operators import experiment as X
from queryscope.operators import limiter
from queryscope.operators import usage as U
from queryscope.workloads import inputs as I
from queryscope.workloads.registry import query, table


@query(
    "usage_totals",
    f"SELECT count(*) AS total, CAST(coalesce(sum(violation_count), 0) AS BIGINT) AS violations, round(coalesce(avg(duration_ms), 0), 2) AS avg_latency_ms FROM {I.USAGE} WHERE ts >= {I.NOW} - 7 * 86400",
)
def usage_totals(spark, sf_dir):
    return U.usage_totals(I.usage_log(spark, sf_dir), I.NOW, 7)


@query("top_rules", f"SELECT r AS rule_id, count(*) AS \"count\" FROM (SELECT unnest(rules_triggered) AS r FROM {I.USAGE}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_rules(spark, sf_dir):
    return U.top_rules(I.usage_log(spark, sf_dir), 20)


@query(
    "dialect_stats",
    f"SELECT dialect, count(*) AS \"count\", round(avg(duration_ms), 2) AS avg_latency_ms, round(sum(violation_count) / count(*), 3) AS violation_rate FROM {I.USAGE} GROUP BY 1",
)
def dialect_stats(spark, sf_dir):
    return U.dialect_stats(I.usage_log(spark, sf_dir))


@query(
    "daily_volume",
    f"SELECT CAST(make_timestamp(ts * 1000000) AS DATE) AS day, count(*) AS lints, CAST(sum(violation_count) AS BIGINT) AS violations FROM {I.USAGE} GROUP BY 1 ORDER BY 1 DESC LIMIT 14",
)
def daily_volume(spark, sf_dir):
    return U.daily_volume(I.usage_log(spark, sf_dir), 14)


@query(
    "session_funnel",
    f"SELECT session_id, count(*) FILTER (WHERE step <> 'error') AS funnel_length, count(DISTINCT step) FILTER (WHERE step <> 'error') AS distinct_steps, "
    "count(*) AS total_events, CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) - CAST(floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS duration_ms, "
    f"arg_max(step, (ts, event_id)) FILTER (WHERE step <> 'error') AS last_step FROM {I.SESSIONS} GROUP BY 1",
)
def session_funnel(spark, sf_dir):
    return U.session_funnel(I.sessions(spark, sf_dir))


@query(
    "session_steps",
    f"SELECT event_id, session_id, ts, step, CAST(coalesce(list_position(['open', 'scan', 'fix', 'export'], step), 0) - 1 AS INTEGER) AS step_index FROM {I.SESSIONS}",
)
def session_steps(spark, sf_dir):
    return U.session_steps(I.sessions(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "funnel_conversion",
    f"WITH s AS {I.SESSIONS}, a AS (SELECT session_id, min(ts) AS t FROM s WHERE step = 'open' GROUP BY 1), "
    "b AS (SELECT s.session_id, min(s.ts) AS t FROM s JOIN a USING (session_id) WHERE step = 'scan' AND s.ts >= a.t GROUP BY 1), "
    "c AS (SELECT s.session_id, min(s.ts) AS t FROM s JOIN b USING (session_id) WHERE step = 'fix' AND s.ts >= b.t GROUP BY 1), "
    "d AS (SELECT s.session_id, min(s.ts) AS t FROM s JOIN c USING (session_id) WHERE step = 'export' AND s.ts >= c.t GROUP BY 1) "
    "SELECT 0 AS step_no, 'open' AS step, (SELECT count(*) FROM a) AS sessions UNION ALL SELECT 1, 'scan', (SELECT count(*) FROM b) "
    "UNION ALL SELECT 2, 'fix', (SELECT count(*) FROM c) UNION ALL SELECT 3, 'export', (SELECT count(*) FROM d)",
)
def funnel_conversion(spark, sf_dir):
    return U.funnel_conversion(I.sessions(spark, sf_dir))


@query(
    "conversions",
    "SELECT event_type AS event, CASE user_id % 3 WHEN 0 THEN 'team' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan, count(*) AS conversions, "
    "round(sum(value), 2) AS value FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2",
)
def conversions(spark, sf_dir):
    return U.conversions(I.conversion_events(spark, sf_dir))


@query(
    "latest_state",
    "SELECT 'rule_' || user_id % 20 AS rule_id, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0, (ts, event_id)) AS enabled FROM events GROUP BY 1",
)
def latest_state(spark, sf_dir):
    return U.latest_state(I.toggles(spark, sf_dir))


@query("recent_history", f"SELECT id, ts, dialect FROM {I.HISTORY} ORDER BY ts DESC, id DESC LIMIT 50")
def recent_history(spark, sf_dir):
    return U.recent_history(I.history(spark, sf_dir)).select("id", "ts", "dialect")


@query(
    "search_history",
    f"SELECT id, ts, dialect FROM {I.HISTORY} WHERE trim(sql) <> '' AND contains(lower(sql), 'tion')",
)
def search_history(spark, sf_dir):
    return U.search_history(I.history(spark, sf_dir), " TION ").select("id", "ts", "dialect")


@query(
    "http_metrics",
    "SELECT method, path, status, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors, quantile_disc(duration_ms, 0.5) AS p50, "
    f"quantile_disc(duration_ms, 0.95) AS p95 FROM {I.HTTP} GROUP BY 1, 2, 3",
)
def http_metrics(spark, sf_dir):
    return U.http_metrics(I.http_log(spark, sf_dir))


@query(
    "latency_histogram",
    "SELECT path, CAST(CASE " + " ".join(f"WHEN duration_ms <= {b} THEN {b}" for b in U.LATENCY_BOUNDS)
    + f" ELSE -1 END AS INTEGER) AS le, count(*) AS requests FROM {I.HTTP} GROUP BY 1, 2",
)
def latency_histogram(spark, sf_dir):
    return U.latency_histogram(I.http_log(spark, sf_dir))


@query("log_counts", f"SELECT level, logger, count(*) AS \"count\" FROM {I.LOGS} GROUP BY 1, 2")
def log_counts(spark, sf_dir):
    return U.log_counts(I.log_rows(spark, sf_dir))


@query(
    "log_alerts",
    "SELECT event_id, ts, CASE level WHEN 'CRITICAL' THEN 'critical' ELSE 'error' END AS severity, logger, substr(message, 1, 96) AS summary, "
    f"substr(message, 1, 500) AS detail FROM {I.LOGS} WHERE level IN ('ERROR', 'CRITICAL')",
)
def log_alerts(spark, sf_dir):
    return U.log_alerts(I.log_rows(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "dedup_alerts",
    "SELECT logger AS dedup_key, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS opened_at, "
    f"count(*) AS alerts FROM {I.LOGS} WHERE level IN ('ERROR', 'CRITICAL') GROUP BY 1, 2",
)
def dedup_alerts(spark, sf_dir):
    alerts = U.log_alerts(I.log_rows(spark, sf_dir)).withColumnRenamed("logger", "dedup_key")
    out = U.dedup_alerts(alerts, window="6 hours")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))


@query("rate_limit", I.limiter("CASE WHEN user_id = 7 THEN 1 ELSE 3 END") + "SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, allowed, CAST(cap - len(held) AS INTEGER) AS remaining FROM r")
def rate_limit(spark, sf_dir):
    out = limiter.rate_limit(I.requests(spark, sf_dir), limit=3, window_s=6 * 3600.0, overrides={"7": 1})
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "offered_load",
    "SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts "
    "RANGE BETWEEN INTERVAL 21599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS offered FROM events",
)
def offered_load(spark, sf_dir):
    return U.offered_load(I.requests(spark, sf_dir), 6 * 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("audit_recent", "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_recent(spark, sf_dir):
    return U.audit_recent(table(spark, sf_dir, "events")).select("event_id", "ts", "user_id", "event_type")


@query(
    "audit_retained",
    "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def audit_retained(spark, sf_dir):
    return U.audit_retained(table(spark, sf_dir, "events").select("event_id", "ts"), days=7)


@query(
    "audit_capped",
    "SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM events) "
    "WHERE rn <= CASE WHEN n <= 400 THEN n ELSE 201 + (n - 401) % 200 END",
)
def audit_capped(spark, sf_dir):
    return U.audit_capped(table(spark, sf_dir, "events").select("event_id", "ts"), most=400)


_HASH = "sha256('duckdb|' || o_orderpriority || o_orderstatus || o_custkey % 50)"
_CACHED = f"SELECT {_HASH} AS sql_hash, CAST(o_orderkey % 5000 AS DOUBLE) AS created_at FROM orders WHERE o_orderkey % 4 = 0"


def _cache(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.sha2(F.concat(F.lit("duckdb|"), "o_orderpriority", "o_orderstatus", F.col("o_custkey") % 50), 256)
    keyed = o.select("o_orderkey", key.alias("sql_hash"))
    cache = keyed.filter("o_orderkey % 4 = 0").select("sql_hash", (F.col("o_orderkey") % 5000).cast("double").alias("created_at"))
    return keyed, cache


@query(
    "cache_lookup",
    f"SELECT o_orderkey, q.sql_hash, created_at, coalesce(8000.0 - created_at < 3600, false) AS hit FROM (SELECT o_orderkey, {_HASH} AS sql_hash FROM orders) q "
    f"LEFT JOIN (SELECT sql_hash, max(created_at) AS created_at FROM ({_CACHED}) GROUP BY 1) c ON q.sql_hash = c.sql_hash",
)
def cache_lookup(spark, sf_dir):
    keyed, cache = _cache(spark, sf_dir)
    return U.cache_lookup(keyed, cache, F.lit(8000.0))


@query(
    "cache_hit_rate",
    f"SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate FROM "
    f"(SELECT coalesce(8000.0 - created_at < 3600, false) AS hit FROM (SELECT {_HASH} AS sql_hash FROM orders) q "
    f"LEFT JOIN (SELECT sql_hash, max(created_at) AS created_at FROM ({_CACHED}) GROUP BY 1) c ON q.sql_hash = c.sql_hash)",
)
def cache_hit_rate(spark, sf_dir):
    keyed, cache = _cache(spark, sf_dir)
    return U.hit_rate(U.cache_lookup(keyed, cache, F.lit(8000.0)))


@query(
    "token_cost",
    "SELECT lang AS engine, count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS total_tokens, round(sum(n_chars) * 0.00001, 6) AS usd FROM documents GROUP BY 1",
)
def token_cost(spark, sf_dir):
    return U.token_cost(table(spark, sf_dir, "documents").select(F.col("lang").alias("engine"), F.col("n_chars").alias("total_tokens")))


# --- access ----------------------------------------------------------------------------

_MAY = (
    "(list_contains(held, 'ADMIN') AND action IN ('read', 'write', 'delete', 'admin') OR list_contains(held, 'BILLING') AND action IN ('read', 'write') "
    "OR list_contains(held, 'DEVELOPER') AND action = 'read')"
)


@query(
    "access_decisions",
    f"SELECT request_id, path, action, required_role, required_role IS NULL OR list_contains(held, required_role) AS endpoint_ok, {_MAY} AS action_ok, "
    f"(required_role IS NULL OR list_contains(held, required_role)) AND {_MAY} AS granted FROM {I.CLAIMS}",
)
def access_decisions(spark, sf_dir):
    return A.access_decisions(I.claims(spark, sf_dir)).drop("claims", "effective")


@query(
    "claims_summary",
    "SELECT 'u' || c_custkey AS sub, lower(c_mktsegment) || '@x.org' AS email, "
    "CASE c_custkey % 5 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'BILLING,DEVELOPER' WHEN 2 THEN 'DEVELOPER,BILLING' ELSE '' END AS roles, 'read,lint' AS scope, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'p' END || c_custkey % 13 AS org, CASE WHEN c_custkey % 4 = 0 THEN 'gold' ELSE 'free' END AS tier FROM customer",
)
def claims_summary(spark, sf_dir):
    out = I.claims(spark, sf_dir).select(*A.claims_summary(F.col("claims")))
    return out.withColumn("roles", F.array_join("roles", ",")).withColumn("scope", F.array_join("scope", ","))


# --- experiments ---------------------------------------------------------------------------

def _bucket_sql(user, salt):
    return f"CAST(CAST('0x' || substr(sha256({user} || ':{salt}'), 1, 8) AS BIGINT) % 1000 AS INTEGER)"


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


_SALT = L.DEFAULT_SALT
_ASSIGNED = " UNION ALL ".join(
    f"SELECT c_custkey AS user_id, '{f['key']}' AS flag, [" + ",".join(f"'{v}'" for v in f["variants"]) + f"][{_bucket_sql('c_custkey', _SALT + ':' + f['key'])} % {len(f['variants'])} + 1] AS variant FROM customer"
    for f in L.FLAGS
)


@query("stable_bucket", f"SELECT c_custkey AS user_id, {_bucket_sql('c_custkey', _SALT)} AS bucket FROM customer")
def stable_bucket(spark, sf_dir):
    return _users(spark, sf_dir).withColumn("bucket", X.stable_bucket(F.col("user_id"), _SALT))


@query("assign_variant", _ASSIGNED)
def assign_variant(spark, sf_dir):
    return X.assign_variant(_users(spark, sf_dir))


_COHORT = (
    f"SELECT c_custkey AS user_id, c_custkey % 50 = 0 OR {_bucket_sql('c_custkey', _SALT + ':ast.rule.nested_loop_join')} % 2 = 1 AS enabled FROM customer"
)


def _cohort(spark, sf_dir):
    users = _users(spark, sf_dir)
    return X.rule_cohort(users, "nested_loop_join", users.filter("user_id % 50 = 0"))


@query("rule_cohort", _COHORT)
def rule_cohort(spark, sf_dir):
    return _cohort(spark, sf_dir)


@query("cohort_distribution", f"SELECT CASE WHEN enabled THEN 'treatment' ELSE 'control' END AS variant, count(*) AS users FROM ({_COHORT}) GROUP BY 1")
def cohort_distribution(spark, sf_dir):
    return X.distribution(_cohort(spark, sf_dir))


@query("exposures", f"SELECT a.*, {_bucket_sql('user_id', _SALT)} AS bucket FROM ({_ASSIGNED}) a")
def exposures(spark, sf_dir):
    return X.exposures(X.assign_variant(_users(spark, sf_dir)))


@query(
    "experiment_readout",
    f"SELECT flag, variant, count(*) AS users, count(v) AS converters, round(count(v) / count(*), 6) AS rate, round(coalesce(sum(v), 0), 2) AS value FROM ({_ASSIGNED}) a "
    "LEFT JOIN (SELECT user_id, sum(value) AS v FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1) e ON a.user_id = e.user_id GROUP BY 1, 2",
)
def experiment_readout(spark, sf_dir):
    return X.experiment_readout(X.assign_variant(_users(spark, sf_dir)), I.conversion_events(spark, sf_dir))
