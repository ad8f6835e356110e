"""A sliding-window limiter whose hot keys are decided by many tasks.

Whether a request passes depends on the accepted ones before it. Keys with few requests
are streamed, one key after the other. The requests of a hot key are put in order by
range, so they lie in many partitions, and are cut into slices. A slice is a function
from the accepted times it inherits to its decisions and to what it hands on: all slices
are first decided from an empty inheritance, then again from what the slice before hands
on, in parallel rounds, until no slice hands on anything new. Wherever the load falls
below the limit for one window, a slice hands on the same whatever it inherits, so a
round or two settle it. What is still open after ``ROUNDS`` rounds (a key that is over
its limit without a pause) is finished in order, slice by slice, from the last settled one.
"""
from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queryscope.session import stored

HOT = 1 << 16  # requests from which a key is cut into slices
SLICE_BITS = 13  # a slice has at most 2 to this power requests
ROUNDS = 6
_TIMES = pa.list_(pa.int64())


def decide(times: Iterable[int], cap: int, span: int, held: deque) -> Iterator[tuple[bool, int]]:
    """(allowed, remaining) of each request; ``held`` are the accepted times, which go on changing."""
    for at in times:
        while held and held[0] <= at - span:
            held.popleft()
        ok = len(held) < cap
        if ok:
            held.append(at)
        yield ok, max(0, cap - len(held))


def handed_on(times: list[int], cap: int, span: int, inherited: list[int]) -> list[int]:
    """The accepted times that can still matter behind a slice."""
    held = deque(inherited)
    for _ in decide(times, cap, span, held):
        pass
    kept = list(held)
    return kept[bisect_right(kept, times[-1] - span):]


def matters(inherited: list[int] | None, first: int, span: int) -> list[int]:
    """What of an inheritance a slice that starts at ``first`` sees."""
    return [] if not inherited else inherited[bisect_right(inherited, first - span):]


def _marked(requests: DataFrame, limit: int, overrides: Mapping[str, int] | None) -> DataFrame:
    caps = F.create_map(*[F.lit(x) for k, v in overrides.items() for x in (str(k), int(v))]) if overrides else F.lit(None).cast("map<string,int>")
    own = F.coalesce(F.try_element_at(caps, F.col("key").cast("string")), F.lit(limit)).cast("int")
    return requests.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__cap", own)


def _streamed(marked: DataFrame, schema: T.StructType, span: int) -> DataFrame:
    """Keys of bounded size: each task reads its keys in order and holds at most ``limit`` times."""
    columns = len(schema) - 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = deque(), object()
        for b in batches:
            allowed, remaining = [], []
            for key, at, cap in zip(b.column("key").to_pylist(), b.column("__us").to_pylist(), b.column("__cap").to_pylist()):
                if key != last:
                    held, last = deque(), key
                ok, left = next(decide((at,), cap, span, held))
                allowed.append(ok)
                remaining.append(left)
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int32())], names=schema.names)

    return marked.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInArrow(work, schema)


def slices(ordered: DataFrame, bits: int) -> DataFrame:
    """(k, idx, cap, pos, times): the slices of every key in order. ``ordered`` has rows numbered in order in ``__pos``."""
    part = F.shiftright("__pos", bits)
    times = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__us"))), lambda x: x["__us"])
    whole = ordered.groupBy(F.col("key").alias("k"), part.alias("part")).agg(F.first("__cap").alias("cap"), F.min("__pos").alias("pos"), times.alias("times"))
    # numbered over one short row per slice, without the times
    order = ordered.groupBy(F.col("key").alias("k2"), part.alias("p2")).agg(F.count(F.lit(1)).alias("n")).select("k2", "p2", F.row_number().over(W.partitionBy("k2").orderBy("p2")).alias("idx"))
    return whole.join(order, F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("p2"))).select("k", "idx", "cap", "pos", "times")


def settled(parts: DataFrame, span: int, rounds: int = ROUNDS) -> DataFrame:
    """(k, idx, cap, pos, times, inherited) with what every slice truly inherits; stored round by round."""
    key = parts.schema["k"].dataType.simpleString()
    schema = f"k {key}, idx int, cap int, pos long, times array<long>, inherited array<long>, out array<long>, changed boolean"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for cap, times, old, out, before in zip(*[b.column(c).to_pylist() for c in ("cap", "times", "inherited", "out", "before")]):
                new = matters(before, times[0], span)
                if out is not None and new == old:
                    found.append((old, out, False))
                else:
                    now = handed_on(times, cap, span, new)
                    found.append((new, now, now != out))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:5]], pa.array([f[0] for f in found], _TIMES), pa.array([f[1] for f in found], _TIMES), pa.array([f[2] for f in found], pa.bool_())], names=names)

    none = F.lit(None).cast("array<long>")
    now = stored(parts.select("*", none.alias("inherited"), none.alias("out"), none.alias("before")).mapInArrow(again, schema), "limiter-round")
    for _ in range(rounds):
        behind = now.select(F.col("k").alias("k2"), (F.col("idx") + 1).alias("i2"), F.col("out").alias("before"))
        now = stored(now.join(behind, F.col("k").eqNullSafe(F.col("k2")) & (F.col("idx") == F.col("i2")), "left").drop("changed", "k2", "i2").mapInArrow(again, schema), "limiter-round")
        if now.filter("changed").isEmpty():
            return now.select(*names[:6])
    # what is open is carried on in order from the first slice that still changed; its own inheritance is settled in turn
    first = now.filter("changed").groupBy(F.col("k").alias("k2")).agg(F.min("idx").alias("first"))
    rest = now.join(first, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    done = rest.filter("first is null or idx < first").select(*names[:6])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = object(), []
        for b in batches:
            found = []
            for k, cap, times, inherited in zip(*[b.column(c).to_pylist() for c in ("k", "cap", "times", "inherited")]):
                own = inherited if k != last else matters(out, times[0], span)
                last, out = k, handed_on(times, cap, span, own)
                found.append(own)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:5]], pa.array(found, _TIMES)], names=names[:6])

    open_ones = rest.filter("idx >= first").select(*names[:6]).repartition("k").sortWithinPartitions("k", "idx")
    return done.unionByName(open_ones.mapInArrow(carried, ", ".join(schema.split(", ")[:6])))


def _sliced(marked: DataFrame, schema: T.StructType, span: int, bits: int, rounds: int) -> DataFrame:
    """Hot keys: decided slice by slice, the decisions joined to the requests by their number."""
    order = ["key", "ts", "event_id"]
    ordered = stored(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id()), "limiter")
    parts = settled(stored(slices(ordered, bits), "limiter-slices"), span, rounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cap, pos, times, inherited in zip(*[b.column(c).to_pylist() for c in ("cap", "pos", "times", "inherited")]):
                found = list(decide(times, cap, span, deque(inherited)))
                yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(times)), pa.int64()), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.int32())], names=["__at", "allowed", "remaining"])

    made = parts.mapInArrow(work, "__at long, allowed boolean, remaining int")
    return ordered.join(made, F.col("__pos") == F.col("__at")).select(*schema.names)


def rate_limit(
    requests: DataFrame, limit: int = 100, window_s: float = 60.0, overrides: Mapping[str, int] | None = None,
    hot: int = HOT, slice_bits: int = SLICE_BITS, rounds: int = ROUNDS,
) -> DataFrame:
    """Allow a request while fewer than ``limit`` accepted ones lie in the last window.

    Requests of a key are taken by time and event_id. A key with more than ``hot``
    requests, found by one count per key, is cut into slices; all others are hashed by
    key, sorted with spilling and streamed. A null key is a key.
    """
    schema = T.StructType(requests.schema.fields + [T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.IntegerType())])
    span = round(window_s * 1_000_000)
    marked = _marked(requests, limit, overrides)
    keys = stored(requests.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(F.col("key").alias("__hot")), "limiter-hot")
    if keys.isEmpty():
        return _streamed(marked, schema, span)
    same = F.col("key").eqNullSafe(F.col("__hot"))
    few, many = marked.join(keys, same, "left_anti"), marked.join(keys, same, "left_semi")
    return _streamed(few, schema, span).unionByName(_sliced(many, schema, span, slice_bits, rounds))
