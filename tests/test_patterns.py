"""Patterns against the hand-written rules, and the automaton against Python's re."""
import re
from collections import Counter

import pytest

from conftest import scripts_frame
from queryscope.plans import lint
from queryscope.plans import patterns as P
from queryscope.workloads import corpus as C


def letters(spark, texts):
    """Each letter is a token."""
    rows = [(i, 1, "word", False, n, ch, 1, n) for i, t in enumerate(texts) for n, ch in enumerate(t)]
    return spark.createDataFrame(rows, "script_id int, stmt_no int, kind string, stmt_broken boolean, pos int, tok string, line int, col int")


CASES = [
    (P.seq(P.tok("a"), P.tok("b")), "ab"), (P.seq(P.tok("a"), P.gap(2), P.tok("c")), "a.{0,2}?c"), (P.seq(P.tok("a"), P.many(P.tok("b", "c")), P.tok("d")), "a[bc]*?d"),
    (P.alt(P.seq(P.tok("a"), P.tok("b")), P.tok("d")), "ab|d"), (P.seq(P.opt(P.tok("a")), P.tok("b"), P.opt(P.tok("c")), P.tok("d")), "a?bc?d"),
    (P.seq(P.tok("a"), P.many(P.seq(P.tok("b"), P.tok("c"))), P.any_token()), "a(bc)*?."), (P.text("[bd]"), "[bd]"),
]


@pytest.mark.parametrize("pattern, plain", CASES)
def test_automaton_finds_what_re_finds(spark, pattern, plain):
    texts = ["", "ab", "aab", "abcd", "acbcbcd", "dabdabab", "abcbcbc", "aaaaabbbbccccdddd", "cabbage", "bcdabcd", "adcb" * 5]
    got = {}
    for r in P.find_patterns(letters(spark, texts), [P.PatternRule("R", "LOW", "", pattern, "")]).collect():
        got.setdefault(r.script_id, []).append(r.matched.replace(" ", ""))
    for i, t in enumerate(texts):
        assert [m for m in got.get(i, [])] == [m.group() for m in re.finditer(plain, t)], t


def test_empty_patterns_are_refused():
    for pattern in (P.opt(P.tok("a")), P.many(P.tok("a")), P.gap(3)):
        with pytest.raises(ValueError):
            P.compiled(pattern)


def test_rules_as_patterns_count_as_the_rules_do(spark):
    scripts = scripts_frame(spark, [t.sql.replace("#S", "7") for t in C.TEMPLATES])
    tokens = lint.annotate_scripts(scripts)
    found = P.find_patterns(tokens, P.PATTERNS)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(found) == exchanges(tokens) == 1
    ids = {r.rule_id for r in P.PATTERNS}
    known = [r for r in lint.ALL_RULES if r.rule_id in ids]
    count = lambda df: Counter((r.script_id, r.rule_id) for r in df.collect())
    assert count(found) == count(lint.find(tokens, known)) and {k for _, k in count(found)} == ids
    one = found.filter("rule_id = 'SQL-NOTIN-001' AND script_id = 20").first()
    assert one.matched == "NOT IN ( SELECT" and one.line == 1 and one.col > 1
