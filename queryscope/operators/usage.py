"""Usage, history, metrics and alert analytics over event tables.

Hot keys are folded on the map side wherever the result allows. The limiter is in ``limiter``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queryscope import lookups as L
from queryscope.operators.quantiles import exact_quantiles

DAY = 86400


def _count() -> Column:
    return F.count(F.lit(1))


def usage_totals(log: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Requests, violations and mean latency of the last days."""
    recent = log.filter(F.col("ts") >= now - days * DAY)
    return recent.agg(
        _count().alias("total"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("violations"),
        F.coalesce(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"),
    )


def top_rules(log: DataFrame, k: int = 20) -> DataFrame:
    hits = log.select(F.explode("rules_triggered").alias("rule_id")).groupBy("rule_id").agg(_count().alias("count"))
    return hits.orderBy(F.desc("count"), F.asc("rule_id")).limit(k)


def dialect_stats(log: DataFrame, dialect: str | None = None) -> DataFrame:
    rows = log if dialect is None else log.filter(F.col("dialect") == dialect)
    return (
        rows.groupBy("dialect")
        .agg(_count().alias("count"), F.round(F.avg("duration_ms"), 2).alias("avg_latency_ms"), F.round(F.sum("violation_count") / _count(), 3).alias("violation_rate"))
        .orderBy(F.desc("count"), F.asc("dialect"))
    )


def daily_volume(log: DataFrame, days: int = 30) -> DataFrame:
    """The latest ``days`` days that have rows, oldest first."""
    day = F.to_date(F.timestamp_seconds("ts"))
    per_day = log.groupBy(day.alias("day")).agg(_count().alias("lints"), F.sum("violation_count").alias("violations"))
    return per_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def step_index(step: Column) -> Column:
    """Place of a step in the funnel, -1 when it is not one of its steps."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in L.FUNNEL_STEPS]), step).cast("int") - 1, F.lit(-1))


def session_steps(events: DataFrame) -> DataFrame:
    """Each event with its funnel index; the order within a session is its ``ts``."""
    return events.withColumn("step_index", step_index(F.col("step")))


def session_funnel(events: DataFrame) -> DataFrame:
    """Per session: funnel steps taken, steps reached, all events and duration in ms.

    Plain aggregates, so a session of any length is folded before the shuffle; the
    ordered step list itself is ``session_steps`` sorted by ts.
    """
    known = F.col("step").isin(L.FUNNEL_STEPS)
    millis = F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))
    return events.groupBy("session_id").agg(
        F.count_if(known).alias("funnel_length"),
        F.count_distinct(F.when(known, F.col("step"))).alias("distinct_steps"),
        _count().alias("total_events"),
        millis.alias("duration_ms"),
        F.max_by(F.when(known, F.col("step")), F.when(known, F.struct("ts", "event_id"))).alias("last_step"),
    )


def funnel_conversion(events: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """Sessions that reach each step after the step before it.

    The earliest time of a step is a map-side minimum per session; the next step
    joins only its own events to these times.
    """
    steps = steps or L.FUNNEL_STEPS
    reached, parts = None, []
    for i, step in enumerate(steps):
        mine = events.filter(F.col("step") == step).select("session_id", "ts")
        if reached is not None:
            mine = mine.join(reached, "session_id").filter(F.col("ts") >= F.col("reached_at"))
        reached = mine.groupBy("session_id").agg(F.min("ts").alias("reached_at"))
        parts.append(reached.agg(_count().alias("sessions")).select(F.lit(i).alias("step_no"), F.lit(step).alias("step"), "sessions"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conversions(events: DataFrame) -> DataFrame:
    return (
        events.filter("is_conversion")
        .groupBy("event", "plan")
        .agg(_count().alias("conversions"), F.round(F.sum("value"), 2).alias("value"))
    )


def latest_state(toggles: DataFrame, key: str = "rule_id") -> DataFrame:
    """The last toggle per key wins; equal times go to the later event."""
    return toggles.groupBy(key).agg(F.max_by("enabled", F.struct("ts", "event_id")).alias("enabled"))


def recent_history(history: DataFrame, n: int | None = 50) -> DataFrame:
    """Entries from the newest on; the first ``n`` of them, or all."""
    newest = history.orderBy(F.desc("ts"), F.desc("id"))
    return newest if n is None else newest.limit(n)


def history_preview(sql: Column) -> Column:
    """First 80 characters on one line; ``(empty query)`` for blank text."""
    flat = F.trim(F.regexp_replace(sql, r"\s+", " "))
    return F.when(flat == "", "(empty query)").when(F.length(flat) > 80, F.concat(F.substring(flat, 1, 77), F.lit("..."))).otherwise(flat)


def search_history(history: DataFrame, text: str = "", keep: int | None = None) -> DataFrame:
    """All non-blank entries whose sql, preview or dialect holds the text, newest first; ``keep`` shows only the first hits."""
    found = history.filter(F.trim("sql") != "").withColumn("preview", history_preview(F.col("sql")))
    needle = text.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in ("sql", "preview", "dialect"):
            hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(needle)), F.lit(False))
        found = found.filter(hit)
    return recent_history(found, keep)


# --- fixed values: upper bounds of the latency histogram in milliseconds
LATENCY_BOUNDS = [5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]


def http_metrics(requests: DataFrame) -> DataFrame:
    """Requests, server errors and exact latency quantiles by method, path and status.

    A quantile is the first value whose running count reaches its share; it is found by
    narrowing ranges (``quantiles``), so a path with most of the requests is no task of its own.
    """
    by = ["method", "path", "status"]
    found = exact_quantiles(requests, by, "duration_ms", (0.5, 0.95)).withColumnsRenamed({c: f"__{c}" for c in by})
    counts = requests.groupBy(*by).agg(_count().alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return counts.join(found, same, "left").select(*by, "requests", "errors", F.col("q0").alias("p50"), F.col("q1").alias("p95"))


def http_metrics_sketch(requests: DataFrame, accuracy: int = 10000) -> DataFrame:
    """As ``http_metrics``, with quantiles from a sketch of bounded size: approximate wherever a group has more values than ``accuracy``."""
    return requests.groupBy("method", "path", "status").agg(
        _count().alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.percentile_approx("duration_ms", F.array(F.lit(0.5), F.lit(0.95)), accuracy).alias("q"),
    ).select("method", "path", "status", "requests", "errors", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def latency_histogram(requests: DataFrame) -> DataFrame:
    """Requests per latency bound and path; -1 stands for above the last bound."""
    bound = F.lit(-1)
    for b in reversed(LATENCY_BOUNDS):
        bound = F.when(F.col("duration_ms") <= b, b).otherwise(bound)
    return requests.groupBy("path", bound.alias("le")).agg(_count().alias("requests"))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level", "logger").agg(_count().alias("count"))


def log_alerts(logs: DataFrame, summary: int = 96, detail: int = 500) -> DataFrame:
    """Error and critical log rows as alerts; an alert shows the first ``summary`` and ``detail`` characters of its message."""
    severity = F.when(F.col("level") == "CRITICAL", "critical").when(F.col("level") == "ERROR", "error")
    return logs.filter(F.col("level").isin("ERROR", "CRITICAL")).select(
        "event_id", "ts", severity.alias("severity"), "logger",
        F.substring("message", 1, summary).alias("summary"), F.substring("message", 1, detail).alias("detail"),
    )


def dedup_alerts(alerts: DataFrame, key: str = "dedup_key", window: str = "10 minutes") -> DataFrame:
    """The first alert per key and window, with the number it stands for."""
    return alerts.groupBy(key, F.window("ts", window).alias("w")).agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("opened_at"), _count().alias("alerts")
    ).select(key, F.col("w.start").alias("window_start"), "event_id", "opened_at", "alerts")


def offered_load(requests: DataFrame, window_s: int = 60) -> DataFrame:
    """Requests of the key in ``(t - window, t]`` at each request.

    Each key's timeline is cut into slices of one window. A row also visits the
    next slice, where it only counts, so a hot key spreads over many tasks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = window_s * 1_000_000
    slot = F.floor(micros / span)
    marked = requests.withColumn("__us", micros).withColumn("__slot", slot)
    visits = marked.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__shift")).withColumn("__at", F.col("__slot") + F.col("__shift"))
    recent = W.partitionBy("key", "__at").orderBy("__us").rangeBetween(-(span - 1), 0)
    return visits.withColumn("offered", _count().over(recent)).filter("__shift = 0").drop("__us", "__slot", "__shift", "__at")


def audit_recent(audit: DataFrame, n: int = 50) -> DataFrame:
    return audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def audit_capped(audit: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows a log of at most ``most`` entries still has when each overflow drops its older half.

    Rows are appended in order of time and event_id; what stays is a bounded number of the latest.
    """
    n, half = audit.count(), most // 2
    left = n if n <= most else most + 1 - half + (n - most - 1) % half
    return audit.orderBy(F.desc("ts"), F.desc("event_id")).limit(left)


def audit_retained(audit: DataFrame, days: int = 90) -> DataFrame:
    """The rows of the last ``days`` days up to the newest one."""
    newest = audit.agg(F.max("ts")).scalar()
    return audit.filter(F.col("ts") > newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """Mark each request hit or miss: the key is stored and younger than ``ttl`` seconds."""
    newest = cache.groupBy("sql_hash").agg(F.max("created_at").alias("created_at"))
    joined = requests.join(newest, "sql_hash", "left")
    return joined.withColumn("hit", F.coalesce(now - F.col("created_at") < ttl, F.lit(False)))


def hit_rate(lookups: DataFrame) -> DataFrame:
    return lookups.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.coalesce(F.round(F.avg(F.col("hit").cast("int")), 6), F.lit(0.0)).alias("hit_rate"),
    )


def token_cost(calls: DataFrame) -> DataFrame:
    return calls.groupBy("engine").agg(
        _count().alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("total_tokens") * L.USD_PER_AI_TOKEN, 6).alias("usd")
    )
