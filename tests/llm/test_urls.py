"""URL filters: rules, the list, the filter's errors and odd rows."""
from oracle import compare

from pyspark.sql import functions as F

from queryscope.llm import queries, urls
from queryscope.llm.queries_urls import RULES

SMALL = "/root/testdata/sf0.01"


def frame(spark, found):
    return spark.createDataFrame([(i, u, "extra") for i, u in enumerate(found)], "page_id long, url string, host string")


def judged(spark, found, listed, **kw):
    rows = urls.judge(frame(spark, found), spark.createDataFrame([(u,) for u in listed], "url string"), RULES, **kw).collect()
    assert len(rows) == len(found)
    return [r for r in sorted(rows, key=lambda r: r.page_id)]


def test_query(spark):
    assert compare(spark, SMALL, queries.QUERIES["op3_url_filter"], queries.ORACLES["op3_url_filter"]) is None


def test_rules(spark):
    found = [None, "", "no scheme", "http://NET/", "http://a.example.net/en/x", "http://example.net/fr/", "http://xexample.com/de/", "https://www.example.com/de/1?x#y",
             "http://example.com", "http://a.org/fr/", "http://net?x", "http://x.net", "a://b://c", "http://É.NET/", "http://h.net/\nen"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in judged(spark, found, [])]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/", "net/", "block"), ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.net", "/fr/", "net/", "block"), ("xexample.com", "/de/", None, "allow"), ("www.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "", None, "allow"),
        ("a.org", "/fr/", "org/fr/", "allow"), ("net", "", None, "allow"), ("x.net", "", None, "allow"), ("b:", "//c", None, "allow"), ("É.net", "/", "net/", "block"), ("h.net", "/\nen", "net/", "block"),
    ]


def test_list_by_canonical_url(spark):
    found = ["https://www.bad.com/a/?utm_source=x&b=2&a=1#f", "http://bad.com:80/a?a=1&b=2", "http://bad.com/a?a=1", "http://good.com/a", None, "http://bad.com/a?a=1&b=2"]
    listed = ["http://bad.com/a?b=2&a=1", "http://bad.com/a?b=2&a=1", None, "nothing"]
    assert [r.listed for r in judged(spark, found, listed)] == [True, True, False, False, False, True]


def test_filter_errors_never_show(spark):
    """One block for thousands of URLs passes nearly every page; the join still decides."""
    listed = [f"http://l{i}.com/p" for i in range(3000)]
    found = [f"http://l{i}.com/p" for i in range(0, 3000, 7)] + [f"http://o{i}.com/p" for i in range(500)]
    rows = judged(spark, found, listed, max_blocks=1)
    assert [r.listed for r in rows] == [True] * len(range(0, 3000, 7)) + [False] * 500
    names = spark.createDataFrame([(u,) for u in listed], "c string")
    assert urls.bloom_blocks(names, "c", 64).count() <= 64
    passed = urls.bloom_blocks(names, "c", 256).agg(F.sum(F.bit_count("w0"))).first()[0]
    assert passed < 256 * 32


def test_empty_tables(spark):
    assert judged(spark, [], ["http://a.com"]) == []


def test_filter_passes_what_is_listed_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('t', id) AS t")
    listed = spark.range(0, 20_000, 20).withColumnRenamed("id", "wanted")
    got = urls.passing(rows, "id", listed, "wanted")
    kept = {r.id for r in got.collect()}
    assert got.columns == ["id", "t"] and kept >= set(range(0, 20_000, 20)) and len(kept) < 1100
    assert urls.passing(rows, "id", listed.limit(0), "wanted").count() == 0
    assert urls.passing(rows, "id", listed, "wanted", max_blocks=1).filter("id % 20 = 0").count() == 1000
