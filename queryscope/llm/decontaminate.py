"""Benchmark passages in documents, by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. An item of length L
may differ from a passage by ``budget(L)`` edits; cut into one piece more than that,
at least one piece occurs unchanged. One automaton finds the pieces, Myers'
bit-parallel distance verifies the text around each hit.

Items are taken in blocks of bounded size that are handed to all tasks, and every
block runs over all documents, so the benchmark may grow. Equal items are matched
once and reported under each id. A null or blank item matches nothing, nor does a
null or blank text; repeated documents are each reported. Other columns are not read.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# share of an item's characters that may be edited
ERROR_RATE = 0.08
# characters of items in one block; what a task holds for it is some ten times that
BLOCK_CHARS = 4_000_000

_SPACE = re.compile(r"\s+")


def plain(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 parts of nearly equal length."""
    n = budget(len(item), rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item as bit vectors for Myers' distance to any part of a text."""

    def __init__(self, item: str):
        self.length, self.at = len(item), {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> int | None:
        """The smallest number of edits that makes a part of ``text`` the item, or None beyond ``most``."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score, best = full, 0, self.length, self.length
        for c in text:
            eq = self.at.get(c, 0)
            x = eq | minus
            d = (((x & plus) + plus) ^ plus) | x
            up, down = minus | (~(d | plus) & full), plus & d
            score += bool(up & top) - bool(down & top)
            up, down = (up << 1) & full, (down << 1) & full  # a part may start anywhere
            plus, minus = down | (~(d | up) & full), up & d
            best = min(best, score)
        return best if best <= most else None


def _spans(hits: list[int], reach: int, size: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of text around places where the item may start, joined where they meet."""
    out: list[list[int]] = []
    for at in sorted(set(hits)):
        a, b = max(0, at - reach), min(limit, at + size + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Matcher:
    """One block of distinct items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.rate, self.patterns = items, rate, {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item, rate):
                where.setdefault(piece, []).append((n, offset))
        self.search = ahocorasick.Automaton()
        for piece, at in where.items():
            self.search.add_word(piece, (len(piece), at))
        self.search.make_automaton()

    def found(self, text: str | None):
        """(item id, distance) of the items in a text."""
        text, hits = plain(text), {}
        for end, (size, at) in self.search.iter(text):
            for n, offset in at:
                hits.setdefault(n, []).append(end + 1 - size - offset)
        for n, starts in hits.items():
            key, item = self.items[n]
            most = budget(len(item), self.rate)
            if n not in self.patterns:
                self.patterns[n] = Pattern(item)
            edits = [self.patterns[n].best(text[a:z], most) for a, z in _spans(starts, most, len(item), len(text))]
            edits = [d for d in edits if d is not None]
            if edits:
                yield key, min(edits)


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    """(k, item, distance) of documents (k, text) against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches):
        matcher = Matcher(shared.value, rate)
        for b in batches:
            rows, ids, edits = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for item, d in matcher.found(text):
                    rows.append(i)
                    ids.append(item)
                    edits.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(edits, pa.int64())], names=["k", "item", "distance"])

    return docs.mapInArrow(work, "k long, item long, distance long")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item; no shuffle, one pass for each block of items."""
    at = docs.columns.index(text)

    def passing(shared):
        def work(batches):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                kept = [not any(True for _ in matcher.found(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(kept, pa.bool_()))

        return work

    schema = docs.schema
    for block in blocks(benchmark, item, item_text, chars):
        docs = docs.mapInArrow(passing(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return docs


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS):
    """Distinct items as lists of (smallest id, plain text), each of about ``chars`` characters; one block is on the driver at a time."""
    block, size = [], 0
    spark_rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).filter("trim(t) <> ''").groupBy("t").agg(F.min("i").alias("i"))
    for r in spark_rows.select("i", "t").toLocalIterator(prefetchPartitions=True):
        if line := plain(r.t):
            block.append((r.i, line))
            size += len(line)
            if size >= chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, distance) of every document that holds an item within its budget; clean documents have no row."""
    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null")
    found = docs.sparkSession.createDataFrame([], "k long, item long, distance long")
    for block in blocks(benchmark, item, item_text, chars):
        found = found.unionByName(_scan(given, block, rate))
    # items that share a text are reported under each id
    same = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    ids = same.join(same.groupBy("t").agg(F.min("i").alias("first")), "t").select(F.col("first"), "i")
    return found.join(ids, F.col("item") == F.col("first")).select(F.col("k").alias(key), F.col("i").alias(item), "distance")
