"""Mixing: marginals, a plain fit, and odd rows."""
from collections import defaultdict

import pytest
from oracle import compare

from pyspark.sql import functions as F

from queryscope.llm import mixing, queries


def plain_fit(cells, targets, keep, rounds=400):
    """Weights raked to the targets, none above its cell's tokens over the sample's size."""
    whole = sum(cells.values())
    full = {c: n / whole / keep for c, n in cells.items()}
    free = {c: n / whole for c, n in cells.items()}
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums = defaultdict(float)
            for c, x in free.items():
                sums[c[axis]] += min(x, full[c])
            free = {c: x * target[c[axis]] / sums[c[axis]] for c, x in free.items()}
    return {c: min(x, full[c]) for c, x in free.items()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    assert compare(spark, folder, queries.QUERIES["op10_mixture"], queries.ORACLES["op10_mixture"]) is None


@pytest.mark.parametrize("keep", [0.05, 0.3])
def test_fit_and_marginals(spark, keep):
    cells = {(s, g, t): float((30 + 7 * i + 5 * j * j + 11 * k) ** 2) for i, s in enumerate("abc") for j, g in enumerate("xy") for k, t in enumerate("pq") if (i, j, k) != (1, 1, 1)}
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()], "s0 string, s1 string, s2 string, tokens double")
    shares = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.4, "y": 0.6}, {"p": 0.7, "q": 0.3}]
    targets = {f"s{i}": mixing.given(table, f"s{i}", t) for i, t in enumerate(shares)}
    fitted = mixing.rake(table, targets, keep, rounds=32, tolerance=1e-10)
    got = {(r.s0, r.s1, r.s2): r for r in fitted.collect()}
    want = plain_fit(cells, shares, keep)
    assert all(abs(got[c].weight - want[c]) < 1e-8 for c in cells)
    p = {(r.s0, r.s1, r.s2): r.p for r in mixing.probabilities(fitted).collect()}
    whole = sum(cells.values())
    assert max(p.values()) <= 1.0 and (keep < 0.1 or max(p.values()) > 0.9999)
    assert abs(sum(cells[c] * p[c] for c in cells) - keep * whole) < 1e-7 * whole
    for axis, target in enumerate(shares):
        for v, share in target.items():
            assert abs(sum(cells[c] * p[c] for c in cells if c[axis] == v) / whole / keep - share) < 1e-7


def test_a_stray_source_does_not_shrink_the_sample(spark):
    cells = [("hot", "en", "p", 9e9), ("cool", "en", "q", 1e9), ("cool", "de", "p", 2e9), ("hot", "de", "q", 1e9), ("stray", "", "p", 100.0)]
    table = spark.createDataFrame(cells, "s0 string, s1 string, s2 string, tokens double")
    targets = {f"s{i}": mixing.temperature(table, f"s{i}", p) for i, p in enumerate((0.8, 0.9, 0.95))}
    fitted = mixing.rake(table, targets)
    p = {(r.s0, r.s1, r.s2): r.p for r in mixing.probabilities(fitted).collect()}
    whole = sum(c[3] for c in cells)
    assert abs(sum(p[c[:3]] * c[3] for c in cells) / whole / mixing.KEEP - 1) < 0.02
    assert p["stray", "", "p"] == 1.0


def test_plans_hold_no_broadcast(spark, sf):
    out, _ = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"), F.lit("t"), {"source": 0.8, "lang": 0.9})
    table = spark.createDataFrame([("a", "b", "c", 1.0)], "s0 string, s1 string, s2 string, tokens double")
    seen, write = [], mixing.stored
    try:
        mixing.stored = lambda df, name: (seen.append(df._jdf.queryExecution().toString()), write(df, name))[1]
        mixing.rake(table, {"s0": mixing.temperature(table, "s0", 0.5)})
    finally:
        mixing.stored = write
    assert seen and not any("Broadcast" in plan for plan in seen) and out.count() == 200


def test_given_leaves_out_what_is_absent(spark):
    table = spark.createDataFrame([("a", "x", "p", 4.0), ("b", "x", "p", 0.0)], "s0 string, s1 string, s2 string, tokens double")
    assert [(r.value, r.share) for r in mixing.given(table, "s0", {"a": 0.2, "b": 0.4, "z": 0.4}).collect()] == [("a", 1.0)]


def test_sample_follows_probabilities(spark):
    rows = [(i, "w " * 10, "big" if i % 10 else "small", "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out, (_, n, _, p, s) = mixing.mixed(df, F.lit("t"), {"source": 0.5, "lang": 1.0, "topic": 1.0}, keep=0.4)
    got = {r.source: r for r in out.groupBy("source").agg(F.avg(p).alias("p"), F.avg(F.col(s).cast("int")).alias("share"), F.count("*").alias("n")).collect()}
    # targets 3/4 and 1/4 of 16000 tokens: the small source has 4000 tokens, just what it should give
    assert abs(got["small"].p - 1) < 1e-5 and got["small"].share > 0.99
    assert abs(got["big"].p - 1 / 3) < 1e-5 and abs(got["big"].share - 1 / 3) < 0.03
    assert got["big"].n + got["small"].n == 4000


def test_clashing_names(spark):
    columns = ["doc_id", "text", "source", "lang", "S0", "topic", "Weight", "probability", "c0", "cell_0_s0", "Sampled"]
    df = spark.createDataFrame([(1, "a b", "x", "en", 1, 2, 3, 4, 5, 6, 7)], "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} int" for c in columns[4:]))
    out, names = mixing.mixed(df, F.lit("t"), {"source": 0.8, "lang": 0.9, "topic": 0.95})
    row = out.collect()[0]
    assert out.columns == [*columns, *names] and [row[c] for c in columns[4:]] == [1, 2, 3, 4, 5, 6, 7] and names[0] == "topic_"


def test_odd_rows(spark):
    rows = [(1, None, None, None, 1), (2, "", "a", "en", 1), (None, "one two", "a", None, 1), (3, "w " * 20000, "b", "en", 1), (3, "w " * 20000, "b", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    out, names = mixing.mixed(df, F.lit(None), {"source": 0.8, "lang": 0.9, "topic": 0.95})
    got = out.collect()
    assert len(got) == 5 and out.columns[:5] == df.columns and names[1] == "tokens_"
    assert [r[names[3]] for r in got if r.doc_id == 1] == [1.0] and sorted(r["tokens_"] for r in got) == [0, 0, 2, 20000, 20000]
    assert len({r[names[4]] for r in got if r.doc_id == 3}) == 1
    assert mixing.mixed(df.limit(0), F.lit("t"), {"source": 0.8})[0].count() == 0
