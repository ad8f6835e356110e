"""Streaming forms of the operators: rules, volumes, sessions, limits, alerts, cache."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queryscope import lookups as L
from queryscope.operators.similarity import upsert
from queryscope.plans import lint


def _event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def stream_lint(scripts: DataFrame, out_path: str, checkpoint: str, rules: Sequence[lint.Rule] = lint.DEFAULT_RULES):
    """Lint arriving scripts. Each batch writes its own folder, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lint.lint_corpus(batch, rules).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_volume(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and violations per window and dialect; rows later than ``late`` are dropped."""
    e = _event_time(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "dialect").agg(F.count(F.lit(1)).alias("lints"), F.sum("violation_count").alias("violations")).select(
        F.col("w.start").alias("window_start"), "dialect", "lints", "violations"
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user by inactivity gap, with their funnel length."""
    e = _event_time(events).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(
        F.count_if(F.col("step").isin(L.FUNNEL_STEPS)).alias("funnel_length"), F.count(F.lit(1)).alias("total_events")
    ).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "funnel_length", "total_events")


def stream_rate_limit(requests: DataFrame, limit: int = 100, window_s: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The sliding limiter as state per key: the accepted times still in the window.

    Rows of a batch are read in event order. A key's state ends when the watermark
    passes its last request by one window, when it would be empty anyway.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one micro-batch of one key
        seconds = pd.to_datetime(rows["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64") / 1e6
        allowed = []
        for at in seconds:
            held = [t for t in held if t > at - window_s]
            ok = len(held) < limit
            if ok:
                held.append(float(at))
            allowed.append(ok)
        state.update((held,))
        state.setTimeoutTimestamp(max(int((seconds.max() + window_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    return _event_time(requests).withWatermark("ts", late).groupBy("key").applyInPandasWithState(
        decide, "key string, event_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_dedup_alerts(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One open alert per key while its watermark lasts."""
    return _event_time(alerts).withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedup_key"])


def stream_upsert_cache(entries: DataFrame, cache_path: str, checkpoint: str, read_cache: Callable[[], DataFrame | None] | None = None):
    """Fold arriving entries into versions of the cache: batch n writes version n from version n-1.

    A replayed batch rewrites the same version from the same base, so it is safe to repeat.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{cache_path}/version={batch_id - 1}") if batch_id > 0 else batch.limit(0)
        merged = upsert(base.select(*batch.columns), batch).drop("point_id")
        merged.write.mode("overwrite").parquet(f"{cache_path}/version={batch_id}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_metrics(events: DataFrame, window: str = "60 seconds", slide: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding counts per event type."""
    e = _event_time(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 4).alias("avg_value")).select(
        F.col("w.start").alias("window_start"), "event_type", "events", "avg_value"
    )
