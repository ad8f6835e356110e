"""Near duplicates by circulant MinHash: two permutations make every coordinate, bands propose, whole sets decide.

A document's set holds the hashes of its distinct runs of ``words`` words. One permutation
of the 64-bit numbers is applied once; the other is applied after a circular shift, and
each shift gives one coordinate of the signature. Bands of ``ROWS`` coordinates put
documents into buckets.

Equal sets fold to one class before anything is compared, so copies cost one row. Then
1. every member of a bucket is compared with the bucket's first member, which joins
   families of near copies with one comparison each;
2. a bucket that still holds several groups is compared in full, in blocks of bounded
   size that are dealt to tasks. A task reports at most one link per pair of groups, so
   no list of all pairs exists.
All comparisons are exact, on whole sets. A pair of similarity 0.8 shares no band with a
probability of 7e-6, and less if it is more similar.

Null, empty and blank texts have an empty set and are linked with nothing. A null id is
kept and never is the smallest. Repeated rows are linked as copies. Columns other than
the id and the text are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import stored, unused
from queryscope.llm.components import components
from queryscope.llm.simhash import shingle_hashes
from queryscope.llm.urls import passing

BANDS, ROWS = 30, 5
# a block holds about so many sets or hashes; two blocks are compared in one task
BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 20
_STEP = 0x9E3779B97F4A7C15  # the circular shift from one coordinate to the next
_FIRST, _SECOND = 0x2545F4914F6CDD1D, 0xD1342543DE82EF95  # keys of the two permutations


def _permuted(x: np.ndarray, key: int) -> np.ndarray:
    """A permutation of the 64-bit numbers, in place: every step can be undone."""
    x += np.uint64(key)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of words."""
    return np.unique(shingle_hashes((text or "").encode(), words))


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set that is not empty."""
    first = _permuted(found.copy(), _FIRST)
    shifts = np.arange(size, dtype=np.uint64) * np.uint64(_STEP)
    least = None
    for a in range(0, len(first), 1024):
        part = _permuted(first[a:a + 1024, None] + shifts, _SECOND).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One number per band, which also tells the bands apart."""
    bands = coordinates.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        key = _permuted(key ^ bands[:, i], _FIRST)
    return key.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, k, n, h0, h1, keys, t) of every row: its number, size and two hashes of its set, band keys (empty for an empty set), text."""
    import xxhash

    def work(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                s = shingles(t, words)
                if len(s):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    out.append((len(s), *np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64).tolist(), band_keys(signature(s, bands * rows), rows)))
                else:
                    out.append((0, 0, 0, np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([
                *b.columns[:2], *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([o[3] for o in out], pa.list_(pa.int64())), b.column(2)],
                names=["row", "k", "n", "h0", "h1", "keys", "t"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return numbered.mapInArrow(work, "row long, k long, n long, h0 long, h1 long, keys array<long>, t string")


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """(node, s) from rows (node, t): sorted distinct hashes."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["node", "s"])

    return rows.select("node", "t").mapInArrow(work, "node long, s array<long>")


def similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * inter >= F.lit(percent) * (a + b - inter)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; a set that many pairs name is split by the skew join."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.filter(similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def links_within(members: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, as many as join them; every pair is compared by its whole sets."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    values, place = np.unique(np.concatenate(members), return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    inter = np.zeros((len(members), len(members)), np.float32)
    for a in range(0, len(values), 4096):
        lo, hi = np.searchsorted(place, (a, a + 4096))
        has = np.zeros((len(members), min(4096, len(values) - a)), np.float32)
        has[owner[lo:hi], place[lo:hi] - a] = 1
        inter += has @ has.T
    size = np.array([len(m) for m in members], np.float32)
    enough = (100 * inter >= percent * (size[:, None] + size[None, :] - inter)) & (groups[:, None] != groups[None, :])
    root = {g: g for g in groups.tolist()}

    def top(g):
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    out = []
    for i, j in zip(*np.nonzero(np.triu(enough))):
        x, y = top(int(groups[i])), top(int(groups[j]))
        if x != y:
            root[x] = y
            out.append((int(i), int(j)))
    return out


def _crossed(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups of the buckets in ``open_rows`` (key, node, n, g, members, hashes).

    A bucket is cut into blocks; every pair of blocks is one piece of work that holds both blocks' sets.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("hashes") / BLOCK_HASHES))
    dealt = open_rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "node", "g", "mine", other).select("key", "node", "g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def work(t: pa.Table) -> pa.Table:
        nodes, groups = t.column("node").to_numpy(), t.column("g").to_numpy()
        found = []
        if len(set(groups.tolist())) > 1:
            lists = t.column("s").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            found = links_within([flat[a:b] for a, b in zip(ends, ends[1:])], groups, percent)
        return pa.table({"a": pa.array([int(nodes[i]) for i, _ in found], pa.int64()), "b": pa.array([int(nodes[j]) for _, j in found], pa.int64())})

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(work, "a long, b long")


def unlike_buckets(grouped: DataFrame) -> DataFrame:
    """Keys of the buckets (key, node, g) that hold several groups; of buckets with the same members, as near copies make in many bands, one."""
    who = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"who{i}") for i in range(2)]
    several = grouped.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count(F.lit(1)).alias("size"), *who).filter("low <> high")
    return several.groupBy("size", "who0", "who1").agg(F.min("key").alias("key")).select("key")


def wanted_texts(numbered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, t) of the rows that ``wanted`` (row) names; a filter keeps most texts of the others out of the shuffle."""
    texts = passing(numbered.select("row", "t"), "row", wanted, "row")
    return texts.join(wanted, "row", "left_semi").select(F.col("row").alias("node"), "t")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component is the smallest key that links reach."""
    numbered = stored(sketches(docs, key, text, words), "sketches", compression="zstd")
    classes = numbered.filter("n > 0").groupBy("h0", "h1").agg(F.min("row").alias("node"), F.min("k").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes, "set-classes")

    # dealt by key once, for the buckets' heads and for their members
    slots = classes.select("node", "n", F.explode("keys").alias("key")).repartition("key")
    heads = slots.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("hashes")).filter("members > 1")
    slots = stored(slots.join(heads, "key"), "buckets")
    wanted = stored(slots.select(F.col("node").alias("row")).distinct(), "wanted")
    sets = stored(sets_of(wanted_texts(numbered, wanted), words), "sets")

    near = (F.lit(100) * F.least("n", "head.n") >= F.lit(percent) * F.greatest("n", "head.n")) & (F.col("node") != F.col("head.node"))
    pairs = slots.filter(near).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()
    first = stored(_compared(pairs, sets, percent), "first-links")
    roots = components(first, "first-stars")

    grouped = slots.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("g", F.coalesce("root", "node"))
    several = unlike_buckets(grouped.filter("members > 2"))
    open_rows = grouped.filter("members > 2").join(several, "key", "left_semi").select("key", "node", "n", "g", "members", "hashes")
    more = stored(_crossed(open_rows, sets, percent), "more-links")
    if not more.isEmpty():
        roots = components(first.unionByName(more), "all-stars")

    rooted = classes.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("h0", "h1", "first", F.coalesce("root", "node").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(whole, "root").select("h0", "h1", "component_id")
    # a set with a third of all rows is on the side that the skew join splits
    out = numbered.drop("keys", "t").join(of.select(F.col("h0").alias("x0"), F.col("h1").alias("x1"), "component_id"), (F.col("n") > 0) & (F.col("h0") == F.col("x0")) & (F.col("h1") == F.col("x1")), "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) that come first in their group; ``docs`` must be a stored table."""
    row = unused(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    first = groups(numbered.select(row, text), row, text, words, percent).filter(F.col(row) == F.col("component_id")).select(row)
    return numbered.join(first, row, "left_semi").select(*docs.columns)
