"""Rules on the hand-written scripts, malformed text and plug-in rules."""
from pyspark.sql import functions as F

from conftest import scripts_frame
from queryscope.plans import lint
from queryscope.plans import score as S
from queryscope.workloads import corpus as C

EXTRA = {
    "SELECT * FROM t WHERE name LIKE '%abc%'": {"SQL-LIKE-001": 1},
    "SELECT * FROM t WHERE name ILIKE '%x'": {"SQL-LIKE-001": 1},
    "SELECT * FROM t WHERE name LIKE '_abc'": {},
    "﻿SELECT * FROM a CROSS JOIN b": {"SQL-CART-001": 1},
    "SELECT * FROM a JOIN b ON (CAST(a.k AS INT) = b.k2)": {"SQL-CAST-001": 1},
    "SELECT x FROM t WHERE d > CURRENT_DATE - INTERVAL '7' DAY": {},
    "SELECT x FROM t WHERE a = -1": {},
    "SELECT x FROM t WHERE a = 'it''s -- not a comment'": {},
    "SELECT x FROM t WHERE NOT a.k IN (SELECT k FROM u)": {"SQL-NOTIN-001": 1},
    "SELECT x FROM a LEFT JOIN b ON a.i = b.i JOIN c USING (i)": {},
    "SELECT x FROM a, UNNEST(a.items) u": {},
    "SELECT COUNT(*) FROM (SELECT a FROM t) s": {},
    "SELECT ] FROM t": {"PARSER-001": 1},
    "SELECT FROM WHERE": {"PARSER-001": 1},
    "((((": {"PARSER-001": 1},
    "SELECT 1; SELECT FROM t; SELECT * FROM a, b": {"PARSER-001": 1, "SQL-CART-001": 1},
    "": {},
    "\x00\x00": {},
}


def _counts(df, key="ruleset"):
    rows = df.groupBy("script_id", key, "rule_id").count().collect()
    return {(r.script_id, r[key], r.rule_id): r["count"] for r in rows}


def test_templates_and_scores(spark):
    texts = [t.sql.replace("#S", "7") for t in C.TEMPLATES]
    tokens = lint.annotate_scripts(scripts_frame(spark, texts)).cache()
    got = _counts(lint.find(tokens, lint.ALL_RULES))
    for i, t in enumerate(C.TEMPLATES):
        for ruleset, fields in (("core", C.COUNTS), ("pro", C.PRO_COUNTS)):
            for rule, field in fields.items():
                assert got.get((i, ruleset, rule), 0) == getattr(t, field), (t.sql, ruleset, rule)
    for r in S.risk_score(tokens).collect():
        t = C.TEMPLATES[r.script_id]
        assert (r.risk_score, r.risk_level, r.scan_complexity) == (t.score, t.level, t.complexity), t.sql
    tokens.unpersist()


def test_more_shapes(spark):
    got = _counts(lint.lint_corpus(scripts_frame(spark, list(EXTRA)), dedup=False))
    for i, (sql, want) in enumerate(EXTRA.items()):
        mine = {rule: n for (sid, _, rule), n in got.items() if sid == i}
        assert mine == want, sql


def test_positions(spark):
    sql = "SELECT a\nFROM t\n  CROSS JOIN u"
    row = lint.lint_corpus(scripts_frame(spark, [sql]), dedup=False).first()
    assert (row.line, row.col) == (3, 9)


def test_a_bad_rule_does_not_lose_the_others(spark):
    broken = lint.Rule("X-1", "LOW", "bad", lambda: F.col("no_such_column"), "m")
    mine = lint.Rule("X-2", "LOW", "drop", lambda: F.col("utok") == "DROP", "m")
    got = _counts(lint.lint_corpus(scripts_frame(spark, ["DROP TABLE t", "SELECT * FROM a, b"]), [broken, mine, *lint.DEFAULT_RULES], dedup=False))
    assert got == {(0, "core", "X-2"): 1, (1, "core", "SQL-CART-001"): 1}


def test_copies_are_read_once_and_joined_back(spark):
    frame = scripts_frame(spark, ["SELECT * FROM a, b"] * 40 + ["SELECT 1"])
    assert lint.lint_corpus(frame).select("script_id").distinct().count() == 40


def test_one_shuffle(spark):
    frame = scripts_frame(spark, ["SELECT 1"])
    plan = lint.lint_corpus(frame, dedup=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
