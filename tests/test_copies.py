"""Texts that differ only in what trails them are read once, and every script keeps its own places."""
import random

from conftest import scripts_frame
from pyspark.sql import functions as F

from queryscope.plans import lint, score

HEADS = [
    "SELECT * FROM a, b", "SELECT (x FROM a", "SELECT 'open FROM a, b", "SELECT \"open FROM a", "SELECT x FROM a /* open", "SELECT FROM a;", "SELECT (a;\nSELECT * FROM a, b",
    "SELECT a - -1 FROM t -- c\n, u", "SELECT 1e--5\n FROM a, b", "SELECT ';--' FROM a, b;", "SELECT '''/*' FROM a, b", "SELECT a->'b', c->>'d' FROM a, b", "", "-- only", "SELECT a/2 FROM a, b /* x */ ;", "SELECT [a'b] FROM a, b",
]
TRAILS = ["", " ", "\n", "-- run 7", "\n-- run 81", " /* a\nb */ -- c", "\n\n  -- ; x\n", ";", "; -- x", " # it's; c", "'", "/* open"]


def test_findings_are_those_of_every_script_read_by_itself(spark):
    texts = [h + t for h in HEADS for t in TRAILS]
    for dialect in ("duckdb", "mysql", "tsql", None):
        frame = scripts_frame(spark, texts, dialect)
        rows = lambda dedup: sorted(map(tuple, lint.lint_corpus(frame, lint.ALL_RULES, dedup).select(*lint.lint_corpus(frame, lint.ALL_RULES, False).columns).collect()), key=repr)  # noqa: B023,E731
        assert rows(True) == rows(False)
        scores = lambda dedup: sorted(map(tuple, score.score_corpus(frame, dedup).collect()), key=repr)  # noqa: B023,E731
        assert scores(True) == scores(False)


def test_trailing_comments_do_not_make_texts_differ(spark):
    rnd = random.Random(3)
    frame = scripts_frame(spark, [f"SELECT * FROM a, b{' ' * rnd.randrange(1, 4)}-- run {i}" for i in range(50)] + [f"SELECT 'it\n-- run {i}" for i in range(5)])
    ids, texts = lint.folded(frame)
    assert ids.count() == 55 and texts.count() == 6  # an open literal goes on to the end


def test_findings_are_never_sent_to_the_driver_whole(spark):
    frame = scripts_frame(spark, ["SELECT * FROM a, b"] * 40)
    for df in (lint.lint_corpus(frame), score.score_corpus(frame)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_read_the_tokens_once(spark):
    from queryscope.plans.lineage import check_schema, column_refs

    tokens = lint.annotate_scripts(scripts_frame(spark, ["SELECT o.id, x FROM orders o, Orders p; SELECT y", "SELECT O.a, b FROM s.t AS o"]))
    catalog = spark.createDataFrame([("main", "orders", "id"), ("s", "t", "b")], "schema string, table string, column string")
    for df in (column_refs(tokens), check_schema(tokens, catalog)):
        assert _plan(df).count("regexp_extract_all") <= 4  # statements, and tokens by dialect
    refs = {(r.script_id, r.name, r.column) for r in column_refs(tokens).collect()}
    assert refs == {(0, "orders", "id"), (0, "orders", "x"), (1, "t", "a"), (1, "t", "b")}
    found = {(r.script_id, r.kind, r.name, r.column) for r in check_schema(tokens, catalog).collect()}
    assert found == {(0, "column", "orders", "x"), (1, "column", "t", "a")}


def test_statements_are_cut_out_of_scripts_joined_once(spark):
    from queryscope.plans.lineage import statement_at
    from queryscope.plans.tokens import split_statements

    scripts = scripts_frame(spark, ["﻿ SELECT 1; SELECT 2 ", "x"])
    points = spark.createDataFrame([(0, 0), (0, 3), (0, 12), (0, 99), (1, 0)], "script_id long, off int")
    df = statement_at(points, split_statements(scripts), scripts)
    assert _plan(df).count("Join") == 3
    got = {(r.script_id, r.off): (r.stmt_no, r.stmt) for r in df.collect()}
    assert got[0, 3] == (1, "SELECT 1") and got[0, 12] == (2, "SELECT 2 ") and got[0, 99] == (None, "﻿ SELECT 1; SELECT 2 ") and got[1, 0] == (1, "x")


def test_the_head_is_read_once_on_each_side(spark):
    """Null filters of the join copied the head's pattern into every condition and use."""
    frame = scripts_frame(spark, ["SELECT 1 -- a", "SELECT 1 -- b"]).repartition(2)
    rows = lint.per_text(frame, lambda texts: texts.select("script_id", F.length("sql").alias("n")))
    assert _plan(rows).count("regexp_extract(") == 2
    assert rows.count() == 2
