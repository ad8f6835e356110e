"""Rows that earlier versions lost or got wrong."""
import os

from pyspark.sql import functions as F

from queryscope.functions.text import detect_dialect
from queryscope.operators import limiter, remedies, usage
from queryscope.plans import lint, score
from queryscope.plans.lineage import statement_at
from queryscope.sources.scripts import scan_scripts


def test_signature_after_the_first_characters(spark):
    df = spark.createDataFrame([("SELECT 1 " * 2000 + "QUALIFY x",)], "sql string")
    assert df.select(detect_dialect(F.col("sql"))).first()[0] == "snowflake"


def test_trigram_search_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, "abcdef"), (1, "xabcdefx"), (2, "abc def")], "k int, t string")
    assert remedies.trigram_search(df, "k", "t", "abcdef").count() == 2


def test_equal_points_and_other_columns_stay(spark):
    points = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (1, 90, "c")], "script_id long, off int, who string")
    statements = spark.createDataFrame([(1, 0, 0, 8, "SELECT 1")], "script_id long, stmt_no int, start_off int, end_off int, stmt string")
    scripts = spark.createDataFrame([(1, "SELECT 1; -- end")], "script_id long, sql string")
    got = sorted((r.who, r.stmt) for r in statement_at(points, statements, scripts).collect())
    assert got == [("a", "SELECT 1"), ("b", "SELECT 1"), ("c", "SELECT 1; -- end")]


def test_globs(spark, tmp_path):
    for name in ("a/x/stg/one.sql", "a/stg/two.sql", "a/x/stg/deep/three.sql", "a/x/stay.txt", "a/x/star.sql", "a/x/other.sql"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text("SELECT 1")
    found = lambda t: sorted(r.path.removeprefix(f"{tmp_path}/") for r in scan_scripts(spark, [f"{tmp_path}/{t}"]).collect())
    assert found("a/**/stg/*.sql") == ["a/stg/two.sql", "a/x/stg/one.sql"]
    assert found("a/x/st*.sql") == ["a/x/star.sql"]
    assert found("a/x/*.txt") == ["a/x/stay.txt"]
    assert len(found("a/**/*.sql")) == 5


def test_history_search_reads_all_entries(spark):
    rows = [(i, i, "needle" if i == 0 else "x", "duckdb") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, ts int, sql string, dialect string")
    assert [r.id for r in usage.search_history(df, "Needle").collect()] == [0]


def test_limiter_keys(spark):
    rows = [(k, f"2024-01-01 00:00:{s:02d}", i) for i, (k, s) in enumerate([(None, 1), (None, 2), (None, 3), (7, 1), (7, 2), (9, 1), (9, 2), (9, 3)])]
    df = spark.createDataFrame(rows, "key long, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.allowed for r in limiter.rate_limit(df, 2, 60.0, {"7": 1}).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, True, False, True, True, False]


def test_exact_quantiles(spark):
    rows = [("GET", "/" + "p" * 200 + str(i % 2), 200 + 300 * (i % 2), float(i)) for i in range(1, 101)] + [("GET", "/none", 200, None)]
    df = spark.createDataFrame(rows, "method string, path string, status int, duration_ms double")
    got = {r.path[-1]: r for r in usage.http_metrics(df).collect()}
    assert (got["0"].requests, got["0"].errors, got["0"].p50, got["0"].p95) == (50, 0, 50.0, 96.0)
    assert (got["1"].errors, got["1"].p50, got["1"].p95) == (50, 49.0, 95.0) and got["e"].p50 is None


def test_empty_scripts_have_a_score(spark):
    df = spark.createDataFrame([(1, "duckdb", ""), (2, "duckdb", None), (3, "duckdb", "SELECT * FROM a CROSS JOIN b"), (4, "duckdb", "SELECT * FROM a CROSS JOIN b")], "script_id long, dialect string, sql string")
    for dedup in (True, False):
        got = {r.script_id: (r.risk_score, r.risk_level, r.scan_complexity) for r in score.score_corpus(df, dedup).collect()}
        assert got == {1: (0, "LOW", "O(N)"), 2: (0, "LOW", "O(N)"), 3: (50, "HIGH", "O(N*M)"), 4: (50, "HIGH", "O(N*M)")}


def test_copies_of_a_hot_text_are_dealt(spark):
    ids = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("fp"), F.col("id").alias("script_id"))
    found = ids.select("fp").distinct().withColumn("n", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lint.to_copies(ids, found).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in out.filter("script_id < 1000").groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1000 and max(sizes) < 600


def test_columns_behind_an_alias_are_checked(spark):
    from queryscope.plans.lineage import check_schema

    df = spark.createDataFrame([(1, "duckdb", "SELECT o.nope, O.id FROM orders o"), (2, "duckdb", "SELECT o.id FROM orders AS o")], "script_id long, dialect string, sql string")
    catalog = spark.createDataFrame([("public", "orders", "id")], "schema string, table string, column string")
    got = [(r.script_id, r.kind, r.column) for r in check_schema(lint.annotate_scripts(df), catalog).collect()]
    assert got == [(1, "column", "nope")]


def test_rewriting_twice_changes_nothing(spark):
    from queryscope.plans.rewrite import rewrite_corpus

    df = spark.createDataFrame([(1, "duckdb", "WITH a AS (SELECT * FROM t ORDER BY YEAR(d) = 1996) SELECT * FROM a")], "script_id long, dialect string, sql string")
    once = spark.createDataFrame(rewrite_corpus(df)[0].select("script_id", "dialect", "sql").collect(), df.schema)
    assert "ORDER BY" not in once.first().sql
    assert rewrite_corpus(once)[0].first().sql == once.first().sql


def test_health_tiers(spark):
    tiers = {}
    for n, name in ((0, "GRADE A"), (2, "NEEDS AUDIT"), (9, "CRITICAL RISK")):
        found = spark.createDataFrame([("MEDIUM",)] * n, "severity string")
        tiers[name] = score.health_score(found).first().tier
    assert all(k == v for k, v in tiers.items())


def test_sarif_document_is_whole(spark):
    import json

    df = spark.createDataFrame([(1, "duckdb", "SELECT * FROM a CROSS JOIN b", "x/one.sql")], "script_id long, dialect string, sql string, path string")
    head, tail = score.sarif_document(spark, lint.DEFAULT_RULES).first()
    rows = [r.result for r in score.sarif_results(lint.lint_corpus(df), df).collect()]
    run = json.loads(head + ",".join(rows) + tail)["runs"][0]
    assert {r["ruleId"] for r in run["results"]} <= {r["id"] for r in run["tool"]["driver"]["rules"]} and run["results"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["snippet"]["text"]
