"""Bucket checksums against a plain comparison, and searches over stored copies."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queryscope.operators import compare as C
from queryscope.operators import searchcopy as S
from queryscope.workloads.registry import table


def drawn(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice([None, rnd.randrange(40)]), rnd.choice(["a", "b", None, ""]), rnd.choice([0.0, -0.0, 1.5, float("nan"), None])) for _ in range(n)]


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_differing_rows(spark, buckets):
    rows = drawn(1, 3000)
    other = rows[5:] + drawn(2, 7) + rows[100:103]
    schema = "k int, `s x` string, v double"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(random.Random(3).sample(other, len(other)), schema)
    key = lambda r: str((r[0], r[1], abs(r[2]) if r[2] is not None else None))
    want, here, there = {}, Counter(map(key, rows)), Counter(map(key, other))
    for k in here.keys() | there.keys():
        if here[k] != there[k]:
            want[k] = (here[k], there[k])
    got = {key(r): (r.n_a, r.n_b) for r in C.differing_rows(a, b, buckets).collect()}
    assert got == want and len(want) > 5
    assert not C.equal_tables(a, b, buckets) and C.equal_tables(a, a.orderBy(F.rand()), buckets)
    assert C.differing_rows(a, a.repartition(3), buckets).count() == 0 and C.equal_tables(a.limit(0), b.limit(0))


def test_equal_tables_shuffle_sums_only(spark, sf):
    orders = table(spark, sf, "orders")
    sums = C.checksums(C._signed(orders, 1).unionByName(C._signed(orders, -1)), F.pmod("__h", F.lit(64)))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    with pytest.raises(ValueError):
        C.differing_rows(orders, orders.drop("o_comment", "o_custkey"))


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("copies"))
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 != 7, F.concat(F.lit("Name "), F.sha2(F.col("id").cast("string"), 256))).alias("name"))
    for form in S.FORMS:
        S.write_copy(df, "name", form, f"{path}/{form}", files=8)
    return df, path


def rows_read(df):
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan]
    while stack:
        node = stack.pop()
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_suffix_reads_its_files_only(spark, names):
    df, path = names
    found = S.ends_with(spark, f"{path}/reversed", "name", ["abc"])
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in df.filter("name LIKE '%abc'").collect())
    assert found.columns == df.columns and "StringStartsWith(name_reversed,cba)" in found._jdf.queryExecution().executedPlan().toString()
    assert rows_read(found) < 20_000 / 3
    assert S.ends_with(spark, f"{path}/reversed", "name", ["0f", "11"]).count() == df.filter("name LIKE '%0f' OR name LIKE '%11'").count()
    assert S.ends_with(spark, f"{path}/reversed", "name", []).count() == 0 and S.ends_with(spark, f"{path}/reversed", "name", [""]).count() == df.filter("name IS NOT NULL").count()


def test_a_form_reads_its_files_only(spark, names):
    df, path = names
    wanted = df.filter("id = 42").first().name
    found = S.equals(spark, f"{path}/upper", "name", "upper", wanted.swapcase())
    assert [r.id for r in found.collect()] == [42] and rows_read(found) < 20_000 / 3
    assert S.equals(spark, f"{path}/trim", "name", "trim", f"  {wanted} ").count() == 1
