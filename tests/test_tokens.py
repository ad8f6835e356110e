from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import scripts_frame
from queryscope.plans import lint
from queryscope.plans import tokens as T

TEXT = st.lists(st.text(alphabet="aZ_9'\"`;()-/*\n\t ,.=<>|:[]%é一", max_size=40), min_size=5, max_size=40)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXT)
def test_any_text_comes_back_whole(spark, texts):
    frame = scripts_frame(spark, texts)
    pieces = T.split_pieces(frame)
    raw = F.regexp_extract_all("piece", F.lit(T._token_pattern()), 0)
    back = pieces.select("script_id", "stmt_no", F.array_join(raw, "").alias("t"))
    got = {}
    for r in back.orderBy("script_id", "stmt_no").collect():
        got[r.script_id] = got.get(r.script_id, "") + r.t
    assert [got.get(i, "") for i in range(len(texts))] == texts
    assert lint.lint_corpus(frame).count() >= 0


def test_long_literals_and_comments(spark):
    sql = "'" + "''" * 50000 + "'; /* " + "*" * 50000 + " */ select ';'"
    rows = T.split_statements(scripts_frame(spark, [sql])).orderBy("stmt_no").collect()
    assert [r.stmt for r in rows] == ["'" + "''" * 50000 + "'", "select ';'"]


def test_statements_follow_single_quotes_only_by_default(spark):
    frame = scripts_frame(spark, ['SELECT "a;b"; SELECT 2 -- x;y\n;', ";;", "  "])
    assert T.split_statements(frame).filter("script_id = 0").count() == 3
    assert T.split_statements(frame, quoted_identifiers=True).filter("script_id = 0").count() == 2
    assert T.split_statements(frame).filter("script_id > 0").count() == 0


def test_dialect_variants(spark):
    my = scripts_frame(spark, ["SELECT 1 # note\n, 2"], "mysql")
    assert [r.tok for r in T.tokenize(my).filter("kind <> 'end'").orderBy("pos").collect()] == ["SELECT", "1", ",", "2"]
    ms = scripts_frame(spark, ["SELECT [a b] FROM t"], "tsql")
    assert "[a b]" in [r.tok for r in T.tokenize(ms).collect()]
