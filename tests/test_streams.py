"""Streams over several micro-batches, with late rows on either side of the watermark."""
import pytest
from pyspark.sql import functions as F

from queryscope.streaming import queries as ST

DAY = "2024-01-01 "


def streamed(spark, tmp_path, batches, schema):
    """A stream of one file per micro-batch, in the order given."""
    path = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, tmp_path, df, mode="append"):
    out = f"{tmp_path}/out"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), [p["numInputRows"] for p in query.recentProgress]


def at(hour, minute=0):
    return f"{DAY}{hour:02d}:{minute:02d}:00"


VOLUME = "ts string, dialect string, violation_count int"


def test_late_rows_count_until_the_watermark_passes(spark, tmp_path):
    batches = [
        [(at(1), "a", 1), (at(1, 30), "a", 2)],
        [(at(3), "a", 4), (at(2, 10), "b", 8)],  # moves the watermark to 2:00; a batch drops by the one its forerunner began with
        [(at(2, 30), "b", 16)],  # late, within an hour of 3:00
        [(at(9), "c", 64), (at(1, 45), "a", 32)],  # the second is beyond it
        [(at(9, 1), "c", 1)],
        [(at(2, 40), "b", 128)],  # far too late
    ]
    found, sizes = drained(spark, tmp_path, ST.stream_volume(streamed(spark, tmp_path, batches, VOLUME), "1 hour", "1 hour"))
    got = {(str(r.window_start)[11:13], r.dialect): (r.lints, r.violations) for r in found.collect()}
    assert [n for n in sizes if n] == [2, 2, 1, 2, 1, 1], sizes
    assert got[("01", "a")] == (2, 3) and got[("02", "b")] == (2, 24) and got[("03", "a")] == (1, 4)


def test_limiter_keeps_its_state_between_batches(spark, tmp_path):
    batches = [[("k", at(1, m), m) for m in range(3)], [("k", at(1, m), m) for m in (4, 3)] + [("z", at(1, 5), 50)], [("k", at(2, 30), 90), ("k", at(2, 31), 91), ("k", at(2, 32), 92)]]
    df = ST.stream_rate_limit(streamed(spark, tmp_path, batches, "key string, ts string, event_id long"), 2, 3600.0, "10 minutes")
    found, _ = drained(spark, tmp_path, df)
    assert {r.event_id: r.allowed for r in found.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 50: True, 90: True, 91: True, 92: False}


def test_one_alert_per_key_across_batches(spark, tmp_path):
    batches = [[("a", at(1), 1), ("a", at(1, 1), 2)], [("a", at(1, 2), 3), ("b", at(1, 2), 4)], [("z", at(5), 5)], [("z", at(5, 1), 6)], [("a", at(9), 7)]]
    df = ST.stream_dedup_alerts(streamed(spark, tmp_path, batches, "dedup_key string, ts string, event_id long"), "10 minutes")
    found, _ = drained(spark, tmp_path, df)
    ids = sorted(r.event_id for r in found.collect())
    # the alert of a ends in the batch after the one that moved the watermark past it
    assert len(ids) == 4 and ids[0] in (1, 2) and ids[1:] == [4, 5, 7]


def test_sessions_span_batches(spark, tmp_path):
    batches = [[("u", at(1), "open"), ("u", at(1, 10), "scan")], [("u", at(1, 20), "fix"), ("v", at(1, 25), "open")], [("u", at(4), "open")], [("w", at(9), "open")]]
    df = ST.stream_sessions(streamed(spark, tmp_path, batches, "session_id string, ts string, step string"), "30 minutes", "1 hour")
    found, _ = drained(spark, tmp_path, df)
    got = {(r.session_id, str(r.started)[11:16]): r.total_events for r in found.collect()}
    assert got[("u", "01:00")] == 3 and got[("v", "01:25")] == 1 and got[("u", "04:00")] == 1


@pytest.mark.parametrize("batches", [1, 3])
def test_queries_run_several_batches(spark, sf, tmp_path, batches):
    from queryscope.workloads import flows
    from queryscope.workloads import inputs as I

    stream = flows._stream(spark, I.requests(spark, sf), "test", batches)
    _, sizes = drained(spark, tmp_path, stream)
    assert len([n for n in sizes if n]) == batches and sum(sizes) == I.requests(spark, sf).count()
