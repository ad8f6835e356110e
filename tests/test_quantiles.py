"""Exact quantiles against sorting, with brackets of every size."""
import math
import random

import pytest
from pyspark.sql import functions as F

from queryscope.operators import quantiles as Q

SHARES = (0.0, 0.01, 0.5, 0.95, 1.0)


def plain(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    key = lambda v: (math.isnan(v), v)
    return {g: [sorted(vs, key=key)[max(math.ceil(len(vs) * s), 1) - 1] for s in SHARES] for g, vs in groups.items()}


def drawn():
    rnd = random.Random(6)
    rows = [("wide", rnd.lognormvariate(0, 6)) for _ in range(9000)] + [("flat", float(rnd.randrange(7))) for _ in range(6000)] + [("one", 4.5)] * 5000
    rows += [(None, rnd.random()) for _ in range(300)] + [("none", None), ("signs", -0.5), ("signs", 2.0), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", float("-inf"))]
    return rows


@pytest.mark.parametrize("pick", [50_000, 400, 3])
def test_every_bracket_size_gives_the_same(spark, pick):
    rows = drawn()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [r[f"q{i}"] for i in range(len(SHARES))] for r in Q.exact_quantiles(df, ["g"], "v", SHARES, pick).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for g in want:
        assert [str(x) for x in got[g]] == [str(x) for x in want[g]], g


def test_passes_narrow_the_brackets(spark):
    rows = drawn()
    df = spark.createDataFrame(rows, "g string, v double").filter("v is not null").withColumnRenamed("v", "__v")
    df = df.filter("not isnan(__v)")
    state = Q._state(df.groupBy("g").agg(F.count("*").alias("n"), F.count("*").alias("numbers")), ["g"], (0.5,))
    after = {r.g: r for r in Q.narrowed(df, state, ["g"]).collect()}
    assert after["wide"].inside < 9000 / 40 and after["wide"].below < after["wide"].rank <= after["wide"].below + after["wide"].inside


def test_no_window_and_empty_table(spark):
    df = spark.createDataFrame(drawn(), "g string, v double")
    out = Q.exact_quantiles(df, ["g"], "v", (0.5,))
    assert "Window" not in out._jdf.queryExecution().toString()
    assert Q.exact_quantiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0
