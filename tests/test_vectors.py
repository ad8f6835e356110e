"""Vector search: every grid against a plain product, odd rows, and the recall of the stored lists."""
import numpy as np
import pyarrow as pa
import pytest

from queryscope.operators import vectors as V
from queryscope.workloads.registry import table

SMALL = "/root/testdata/sf0.01"


def plain(queries, index, k, threshold):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit(np.array([v for _, v in queries], float)) @ unit(np.array([v for _, v in index], float)).T, 9)
    out = set()
    for (name, _), row in zip(queries, score):
        best = sorted((-s, i) for (i, _), s in zip(index, row) if s >= threshold)[:k]
        out |= {(name, i, n + 1) for n, (_, i) in enumerate(best)}
    return out


def got(df):
    return {(r.query_id, r.match_id, r.rank) for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.vec_id, list(map(float, r.embedding))) for r in table(spark, SMALL, "embeddings").collect()]


@pytest.mark.parametrize("blocks", [(2048, 32_768), (60, 50)])
def test_grids_give_the_same_rows(spark, rows, blocks):
    e = table(spark, SMALL, "embeddings")
    found = V.vector_topk(e.withColumnRenamed("vec_id", "query_id"), e, 3, 0.2, query_block=blocks[0], index_block=blocks[1])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Join" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    assert got(found) == plain(rows, rows, 3, 0.2)


def test_many_equal_vectors_tie_by_id(spark):
    index = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500, 0, -1)] + [(0, [2.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([("q", [2.0, 4.0])], "query_id string, embedding array<double>")
    for block in (7, 1000):
        assert got(V.vector_topk(queries, index, 4, 0.5, index_block=block)) == {("q", i, i) for i in range(1, 5)}


def odd(spark):
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 0.0, 0.0]), ("d", []), ("e", [None, 1.0]), (None, [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    index = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0, 3.0]), (4, [5.0, 0.0, 0.0]), (None, [2.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (8, [None, 1.0])], "vec_id long, embedding array<double>")
    return queries, index


def test_missing_and_odd_vectors(spark, tmp_path):
    queries, index = odd(spark)
    found = V.vector_topk(queries, index)
    assert got(found) == {("a", 1, 1), ("c", 4, 1)}
    assert [f.dataType.simpleString() for f in V.vector_topk(queries.limit(0), index).schema][:2] == ["string", "bigint"]
    assert V.vector_topk(queries.limit(0), index).count() == V.vector_topk(queries, index.limit(0)).count() == 0
    V.build_lists(index, f"{tmp_path}/odd")
    assert got(V.search_lists(spark, f"{tmp_path}/odd", queries)) == {("a", 1, 1), ("c", 4, 1)}


def test_stored_lists_reach_their_recall(spark, rows, tmp_path):
    e, path = table(spark, SMALL, "embeddings"), f"{tmp_path}/lists"
    V.build_lists(e, path, lists=16)
    assert spark.read.parquet(f"{path}/lists").count() == len(rows)
    queries = e.withColumnRenamed("vec_id", "query_id")
    exact = plain(rows, rows, 3, 0.2)
    for probes, least in ((16, 1.0), (10, 0.9)):
        near = got(V.search_lists(spark, path, queries, 3, 0.2, probes=probes, query_block=40, index_block=30))
        share = len({x[:2] for x in near} & {x[:2] for x in exact}) / len(exact)
        assert share >= least, (probes, share)


def test_list_of_a_dimension_the_sample_missed(spark, tmp_path):
    index = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)] + [(99, [3.0, 3.0, 3.0])], "vec_id long, embedding array<double>")
    V.build_lists(index, f"{tmp_path}/lists", sample=1)
    queries = spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("b", [1.0, 5.0])], "query_id string, embedding array<double>")
    assert got(V.search_lists(spark, f"{tmp_path}/lists", queries)) == {("a", 99, 1), ("b", 5, 1)}


def test_a_full_cell_holds_few_scores_and_floats_stay_floats(spark):
    import tracemalloc

    rnd = np.random.default_rng(5)
    side = lambda n: pa.table({"id": pa.array(range(n)), "v": pa.array(list(rnd.standard_normal((n, 8)).astype(np.float32)), pa.list_(pa.float32()))})
    queries, index = side(2048), side(16_384)
    tracemalloc.start()
    i, j, score = V.best_of_cell(queries, index, 3, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 3 * 2048 and sorted(set(np.diff(i).tolist())) == [0, 1] and peak < 100e6
    e = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert "array<double>" not in V._usable(e, "vec_id", "embedding", narrow=True).schema.simpleString()
    # a side is repeated once per block of the other: equal blocks shuffle the least
    assert V.QUERY_BLOCK == V.INDEX_BLOCK
