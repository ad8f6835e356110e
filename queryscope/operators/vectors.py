"""Vector search: the exact k best over a grid of blocks, and a stored inverted-list index for the approximate route.

Queries are dealt to rows of a grid and the index to its columns. A cell holds one block
of queries and one block of the index, both of bounded size, and is one matrix product
with the k best per query. The plan has the same few nodes at every size and no vector
passes through the driver.

Rows without an id or a whole vector match nothing, and vectors of different lengths
never match each other. Scores are rounded to 12 places, so equal vectors tie wherever
they were compared; ties go to the smaller id.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# rows of a block: each side is repeated for every block of the other, so equal blocks shuffle least;
# at 64 floats each 4 MB a side and cell
QUERY_BLOCK, INDEX_BLOCK = 16_384, 16_384
SCORES = 2_000_000  # of a cell that are held at once, a slice of its queries against all of its index rows
# centroids are trained on at most so many rows of the index, chosen by a hash of the id
SAMPLE, ROUNDS = 65_536, 8


def _usable(df: DataFrame, key: str, vector: str, narrow: bool = False) -> DataFrame:
    """(id, v) of the rows with a whole vector; ``narrow`` leaves floats as they are, which halves what is shuffled."""
    whole = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    kind = "array<float>" if narrow and df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return df.filter(whole).select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of equally long lists; a zero vector stays zero."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def best_of_cell(queries: pa.Table, index: pa.Table, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, score) of the k best of each query among the rows of a cell, and of all that tie with the last of them."""
    q, rows, found = _matrix(queries["v"]), _matrix(index["v"]), []
    step = max(1, SCORES // max(1, len(rows)))
    for start in range(0, len(q), step):
        score = np.round(q[start:start + step] @ rows.T, 12)
        least = np.full(len(score), threshold)
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
        i, j = np.nonzero(score >= least[:, None])
        found.append((i + start, j, score[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cell(k: int, threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(queries: pa.Table, index: pa.Table) -> pa.Table:
        if len(queries) and len(index):
            i, j, score = best_of_cell(queries, index, k, threshold)
        else:
            i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        names, keys = queries["id"].combine_chunks().take(pa.array(i)), index["id"].combine_chunks().take(pa.array(j))
        # the k best by score, then by id; only ties reach beyond k before this cut
        out = pa.table({"q": pa.array(i), "query_id": names, "match_id": keys, "score": score}).sort_by([("q", "ascending"), ("score", "descending"), ("match_id", "ascending")])
        row = out["q"].to_numpy()
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return out.filter(pa.array(rank < k)).drop_columns(["q"])

    return work


def _ranked(queries: DataFrame, index: DataFrame, by: list[str], k: int, threshold: float) -> DataFrame:
    """The k best per query over all cells; both sides have (id, v) and the columns ``by`` that name a cell."""
    q_type, i_type = queries.schema["id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    hits = queries.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(_cell(k, threshold), f"query_id {q_type}, match_id {i_type}, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("match_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def vector_topk(
    queries: DataFrame, index: DataFrame, k: int = 1, threshold: float = 0.9,
    query_id: str = "query_id", index_id: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK,
) -> DataFrame:
    """The k best index rows per query by cosine, none below ``threshold``: (query_id, match_id, score, rank).

    Exact at any size. Every query block meets every index block in one cell of the
    grid; a cell keeps k rows per query, so what is ranked at the end is k rows per query and column.
    """
    q, i = _usable(queries, query_id, vector, narrow=True), _usable(index, index_id, vector, narrow=True)
    rows = _blocks(q.count(), query_block)
    columns = max(_blocks(i.count(), index_block), _blocks(queries.sparkSession.sparkContext.defaultParallelism, rows))
    dim = F.size("v").alias("dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    q = q.select("id", "v", dim, mine(rows).alias("r"), every(columns).alias("c"))
    i = i.select("id", "v", dim, mine(columns).alias("c"), every(rows).alias("r"))
    return _ranked(q, i, ["dim", "r", "c"], k, threshold)


def train_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; the first ones are drawn from the vectors."""
    rnd = np.random.default_rng(seed)
    centroids = vectors[rnd.choice(len(vectors), min(lists, len(vectors)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
    return centroids


def _nearest_lists(df: DataFrame, centroids, count: int) -> DataFrame:
    """The rows once for each of their ``count`` nearest lists of their dimension."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    kind = df.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            sizes = pa.compute.list_value_length(t["v"]).to_numpy()
            for dim in sorted(set(sizes.tolist()) & set(shared.value)):
                part = t.filter(pa.array(sizes == dim))
                score = _matrix(part["v"]) @ shared.value[dim].T
                near = np.argsort(-score, axis=1, kind="stable")[:, :count]
                at = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                out = part.take(at).append_column("list", pa.array(near.ravel().astype(np.int32)))
                yield from out.append_column("dim", pa.array(np.full(len(out), dim, np.int32))).combine_chunks().to_batches()

    return df.select("id", "v").mapInArrow(work, f"id {kind}, v array<double>, list int, dim int")


def build_lists(index: DataFrame, path: str, lists: int | None = None, index_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> None:
    """Write an inverted-list index of every usable row: ``path``/lists by dimension and list, ``path``/centroids.

    Centroids come from at most ``sample`` rows (a documented bound: they shape the lists, each row is in one).
    The number of lists is the root of the number of rows unless stated, at most 4096, so centroids have a bound too.
    """
    rows = _usable(index, index_id, vector)
    drawn = rows.select(F.size("v").alias("dim"), "v").orderBy(F.xxhash64("id")).limit(sample).toArrow()
    centroids = {}
    for dim in sorted(set(drawn["dim"].to_pylist())):
        own = drawn.filter(pa.compute.equal(drawn["dim"], dim))
        n = lists or min(4096, max(1, round(len(own) ** 0.5)))
        centroids[dim] = train_centroids(_matrix(own["v"]), n)
    spark = index.sparkSession
    kept = [(d, n, c.tolist()) for d, m in centroids.items() for n, c in enumerate(m)]
    spark.createDataFrame(kept, "dim int, list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    # rows of a dimension that the sample missed go to list -1, which every search of that dimension reads
    found = _nearest_lists(rows, centroids, 1)
    missed = rows.filter(~F.size("v").isin([*centroids, -1])).select("id", "v", F.lit(-1).alias("list"), F.size("v").alias("dim"))
    found.unionByName(missed).write.mode("overwrite").partitionBy("dim", "list").parquet(f"{path}/lists")


def search_lists(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 1, threshold: float = 0.9, probes: int = 8,
    query_id: str = "query_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK,
) -> DataFrame:
    """As ``vector_topk`` over the ``probes`` nearest lists of a stored index: approximate, only these lists are compared.

    A list or a crowd of queries of any size is cut into blocks, as in the exact route.
    """
    kept = spark.read.parquet(f"{path}/centroids").orderBy("dim", "list").toArrow()
    centroids = {d: _matrix(kept.filter(pa.compute.equal(kept["dim"], d))["centroid"]) for d in sorted(set(kept["dim"].to_pylist()))}
    index = spark.read.parquet(f"{path}/lists")
    q = _usable(queries, query_id, vector)
    near = _nearest_lists(q, centroids, probes).unionByName(q.filter(~F.size("v").isin([*centroids, -1])).select("id", "v", F.lit(-1).alias("list"), F.size("v").alias("dim")))
    sizes = lambda df, block, name: df.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    # one row per list, at most 4096 lists a dimension
    grid = sizes(near, query_block, "rows").join(sizes(index, index_block, "columns"), ["dim", "list"])
    mine = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = near.join(grid, ["dim", "list"]).select("id", "v", "dim", "list", mine("rows").alias("r"), every("columns").alias("c"))
    index = index.join(grid, ["dim", "list"]).select("id", "v", "dim", "list", mine("columns").alias("c"), every("rows").alias("r"))
    return _ranked(near, index, ["dim", "list", "r", "c"], k, threshold)
