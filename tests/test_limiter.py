"""The limiter's slices against a plain loop, whatever the sizes and the load."""
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from queryscope.operators import limiter as L

START = 1_700_000_000


def plain(rows, limit, span, overrides=None):
    held, out = defaultdict(deque), {}
    for key, at, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        cap, h = (overrides or {}).get(key, limit), held[key]
        while h and h[0] <= at - span:
            h.popleft()
        ok = len(h) < cap
        if ok:
            h.append(at)
        out[event] = (ok, max(0, cap - len(h)))
    return out


def drawn(seed):
    rnd, rows, event = random.Random(seed), [], 0
    for key, n, gap in (("full", 700, 2), ("easy", 500, 40), ("mixed", 600, 0), (None, 300, 5), ("one", 1, 1), ("few", 9, 3)):
        at = START
        for i in range(n):
            at += rnd.choice([0, 0, 1, 1, 2, 90]) if gap == 0 else rnd.randint(0, gap)
            rows.append((key, at, event := event + 1))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at long, event_id long").select("key", F.timestamp_seconds("at").alias("ts"), "event_id")


def got(df):
    return {r.event_id: (r.allowed, r.remaining) for r in df.collect()}


@pytest.mark.parametrize("bits, rounds", [(3, 0), (3, 2), (5, 100), (13, 6)])
def test_slices_equal_a_plain_loop(spark, bits, rounds):
    rows = drawn(bits)
    out = L.rate_limit(frame(spark, rows), 5, 30.0, {"mixed": 8}, hot=100, slice_bits=bits, rounds=rounds)
    assert out.columns == ["key", "ts", "event_id", "allowed", "remaining"]
    want = plain(rows, 5, 30, {"mixed": 8})
    assert got(out) == want and 0.1 < sum(ok for ok, _ in want.values()) / len(want) < 0.9


def test_few_requests_take_one_shuffle(spark):
    rows = drawn(1)
    out = L.rate_limit(frame(spark, rows), 5, 30.0)
    assert got(out) == plain(rows, 5, 30)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert L.rate_limit(frame(spark, rows).limit(0)).count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    rows = [("hot", START + i // 3, i) for i in range(4000)]
    marked = L._marked(frame(spark, rows), 5, None)
    order = ["key", "ts", "event_id"]
    ordered = marked.repartitionByRange(8, *order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id())
    parts = L.slices(L.stored(ordered, "test"), 6).withColumn("task", F.spark_partition_id()).collect()
    assert len(parts) > 60 and max(len(p.times) for p in parts) <= 64 and sorted(p.idx for p in parts) == list(range(1, len(parts) + 1))
    assert [t for p in sorted(parts, key=lambda p: p.idx) for t in p.times] == [(START + i // 3) * 1_000_000 for i in range(4000)]


def test_light_load_settles_in_rounds(spark):
    rows = [("k", START + 20 * i, i) for i in range(2000)]
    ordered = L.stored(L._marked(frame(spark, rows), 5, None).coalesce(1).sortWithinPartitions("ts").withColumn("__pos", F.monotonically_increasing_id()), "test")
    now = L.settled(L.slices(ordered, 4), 30_000_000, rounds=2)
    assert "limiter-round" in now.inputFiles()[0] and now.count() == 125  # no slice had to be carried on
