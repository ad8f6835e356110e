"""SimHash groups: fingerprints, and links between fingerprints by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two
fingerprints within the radius share a variant, and two that share a variant are
within the radius, so each bucket holds few fingerprints (65 at radius 2, whatever
the table's size) and a chain through a bucket keeps all of its links.

A null or blank text has the fingerprint zero and is linked like any other. Equal
texts fold to one fingerprint before anything is shuffled by variant. A null id is
kept; it never is the smallest. Columns other than the id and the text are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm.common import stored, unused
from queryscope.llm.components import components

BITS = 64


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lowered and joined by one space; a shorter text is one shingle."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    one = xxhash.xxh64_intdigest
    return np.array([one(line[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) of every row, in one pass over the texts."""

    def work(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((majority(shingle_hashes(t or b"", words)) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["k", "fp"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(work, "k long, fp long")


def _ball(radius: int) -> list[int]:
    """XOR masks of up to ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b), a > b, between the distinct values of ``fp``: a chain through each bucket.

    Every two members of a bucket are within ``radius``, so the chain reaches what
    all pairs would reach. ``radius`` must be even for that.
    """
    if radius % 2:
        raise ValueError("ball hashing takes an even radius")
    variants = distinct.select("fp", F.explode(F.transform(F.array(*[F.lit(m) for m in _ball(radius // 2)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    chained = variants.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("b")).filter("b is not null")
    return chained.select(F.col("fp").alias("a"), "b").distinct().filter(distance(F.col("a"), F.col("b")) <= radius)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id) of every row; the component is the smallest key that links reach."""
    marked = stored(fingerprints(docs, key, text, words), "fingerprints")
    folded = stored(marked.groupBy("fp").agg(F.min("k").alias("first")), "folded")
    roots = components(links(folded.select("fp"), radius), "fingerprint-stars")
    rooted = folded.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    of = rooted.join(whole, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    # a fingerprint with a third of all rows is on the side that the skew join splits
    return marked.join(of, F.col("fp") == F.col("f")).select(F.col("k").alias(key), "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) that come first in their group; of repeated rows one stays.

    Rows are numbered as they are read, so ``docs`` must be a stored table.
    """
    row = unused(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    first = groups(numbered.select(row, text), row, text, words, radius).filter(F.col(row) == F.col("component_id")).select(row)
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
