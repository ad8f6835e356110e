"""Incremental lint: equal to a full run, reading only what is new."""
from pyspark.sql import functions as F

from conftest import scripts_frame
from queryscope.plans import findings_store as S
from queryscope.plans import lint

TEXTS = ["SELECT * FROM a CROSS JOIN b", "SELECT a FROM t WHERE YEAR(d) = 2020", "SELECT 1", "SELECT x FROM t WHERE x NOT IN (SELECT y FROM u)", "", "SELECT * FROM a CROSS JOIN b"]


def rows(df):
    return sorted(tuple(str(v) for v in (r.script_id, r.rule_id, r.line, r.col, r.message)) for r in df.select("script_id", "rule_id", "line", "col", "message").collect())


def test_a_second_run_reads_only_new_texts(spark, tmp_path, monkeypatch):
    first = scripts_frame(spark, TEXTS[:3])
    every = scripts_frame(spark, [*TEXTS, None, *(f"SELECT {i} FROM a, b" for i in range(40))])
    store = S.FindingsStore(spark, f"{tmp_path}/store")
    assert store.update(first) == 3 and rows(store.findings(first)) == rows(lint.lint_corpus(first))
    read, tokenize = [], lint.annotate_scripts
    monkeypatch.setattr(lint, "annotate_scripts", lambda scripts, rules=None: (read.append(scripts.count()), tokenize(scripts, rules))[1])
    found = S.lint_incremental(every, f"{tmp_path}/store")
    monkeypatch.undo()
    assert read == [42] and rows(found) == rows(lint.lint_corpus(every)) and len(rows(found)) > 40
    assert store.update(every) == 0 and len(store.versions()) == 2


def test_a_full_filter_stays_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCKS", 1)
    store, texts = S.FindingsStore(spark, f"{tmp_path}/store"), [f"SELECT {i} FROM a, b" for i in range(300)]
    assert store.update(scripts_frame(spark, texts[:200])) == 200
    blocks = store._read("filter", store.versions())
    marked = S.maybe_known(scripts_frame(spark, texts).select(lint.fingerprint(F.col("dialect"), F.col("sql")).alias("fp"), "sql"), blocks, "maybe")
    assert marked.filter("maybe").count() == 300  # every text looks known
    assert store.update(scripts_frame(spark, texts)) == 100


def test_failed_runs_and_other_rules(spark, tmp_path):
    path, scripts = f"{tmp_path}/store", scripts_frame(spark, TEXTS)
    lint.distinct_scripts(scripts).select(F.col("script_id").alias("fp")).write.parquet(f"{path}/known/lost")  # a run that never finished
    store = S.FindingsStore(spark, path)
    assert store.versions() == [] and store.update(scripts) == 5
    other = S.FindingsStore(spark, path, lint.ALL_RULES, "all")
    assert other.update(scripts) == 5 and rows(other.findings(scripts)) == rows(lint.lint_corpus(scripts, lint.ALL_RULES))
    assert rows(store.findings(scripts)) == rows(lint.lint_corpus(scripts))
    empty = S.FindingsStore(spark, f"{tmp_path}/none")
    assert empty.update(scripts.limit(0)) == 0 and empty.findings(scripts.limit(0)).count() == 0
