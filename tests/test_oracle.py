"""Named queries against their DuckDB texts on the smallest tables.

The corpus queries plan large expressions, so by default one of each kind runs;
``QUERYSCOPE_ALL=1`` runs every query, as ``python tests/oracle.py`` does.
"""
import os

import pytest

import __spark_entry__ as entry
from oracle import compare

QUERIES, TEXTS = entry.queries(), entry.oracle_sql()
_SLOW = ("queryscope.workloads.scripts", "queryscope.workloads.flows")
_ALWAYS = {"tokenize", "split_statements", "lint_corpus", "risk_score", "check_schema", "lineage", "rewrite_corpus", "scan_scripts", "render_inserts", "stream_sessions"}
NAMES = [n for n in TEXTS if os.environ.get("QUERYSCOPE_ALL") or n in _ALWAYS or QUERIES[n].__module__ not in _SLOW]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], TEXTS[name]) is None


def test_every_text_has_a_query():
    assert set(TEXTS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
