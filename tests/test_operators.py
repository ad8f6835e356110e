import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import scripts_frame
from queryscope.functions import text as X
from queryscope.operators import limiter
from queryscope.operators import query as Q
from queryscope.operators import remedies as R
from queryscope.operators import stages as S
from queryscope.operators import usage as U
from queryscope.plans import rewrite
from queryscope.sources import records, tabular
from queryscope.sources import scripts as files
from queryscope.workloads import inputs as I
from queryscope.workloads import load
from queryscope.workloads.registry import table


def _limiter(rows, limit, window, overrides):
    held, out = defaultdict(list), {}
    for key, at, event in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        cap = overrides.get(key, limit)
        kept = [t for t in held[key] if t > at - window]
        ok = len(kept) < cap
        held[key] = kept + ([at] if ok else [])
        out[event] = (ok, max(0, cap - len(held[key])))
    return out


def _seconds(ts):
    return ts.replace(tzinfo=dt.timezone.utc).timestamp()


def test_rate_limit_equals_brute_force(spark, sf):
    req = I.requests(spark, sf)
    rows = [(r.key, _seconds(r.ts), r.event_id) for r in req.withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]
    want = _limiter(rows, 3, 6 * 3600.0, {"7": 1})
    got = {r.event_id: (r.allowed, r.remaining) for r in limiter.rate_limit(req, 3, 6 * 3600.0, {"7": 1}).collect()}
    assert got == want and not all(ok for ok, _ in got.values())


def test_streaming_limiter_equals_batch(spark, sf):
    batch = {r.event_id: r.allowed for r in limiter.rate_limit(I.requests(spark, sf), 3, 6 * 3600.0).collect()}
    stream = {r.event_id: r.allowed for r in load()[0]["stream_rate_limit"](spark, sf).collect()}
    assert stream == batch


def test_filter_year_reaches_the_scan(spark, sf):
    plan = R.filter_year(table(spark, sf, "orders"), "o_orderdate", 1996)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_not_in_stays_an_equi_join(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    plan = R.anti_join(c, o, [("c_custkey", "o_custkey")], nulls="not_in")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_safe_run_reports_errors(spark):
    bad = Q.run_sql_safe(spark, "SELECT * FROM nowhere_at_all")
    assert not bad["ok"] and bad["error_type"] == "AnalysisException"
    good = Q.run_sql_safe(spark, "SELECT id FROM range(9)")
    assert good["ok"] and good["row_count"] == 9 and len(good["rows"]) == 5


def test_grid_order(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 1)], "k int, v int")
    assert [r.k for r in Q.grid_sort(df, "v").collect()] == [3, 1, 2]
    assert [r.k for r in Q.grid_sort(df, "v", False).collect()] == [2, 1, 3]


def test_unknown_stage_or_predicate(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        S.run_stages(df, [{"$lookup": {}}])
    with pytest.raises(ValueError):
        S.match(df, {"id": {"$regex": "x"}})


def test_rewrites_keep_the_rest_and_settle(spark):
    cases = {
        "SELECT * FROM o WHERE 2026 = YEAR(o.d) AND NOT DATE(x) = '2026-01-15';":
            "SELECT * FROM o WHERE o.d >= CAST('2026-01-01' AS DATE) AND o.d < CAST('2027-01-01' AS DATE) AND NOT (x >= CAST('2026-01-15' AS DATE) AND x < CAST('2026-01-16' AS DATE));",
        "SELECT * FROM o WHERE o.customer_id NOT IN (SELECT id FROM blocked WHERE active = 1)":
            "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM blocked WHERE (active = 1) AND id = o.customer_id)",
        "SELECT * FROM o WHERE o.k NOT IN (SELECT id FROM b WHERE YEAR(d) = 2020)":
            "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE (d >= CAST('2020-01-01' AS DATE) AND d < CAST('2021-01-01' AS DATE)) AND id = o.k)",
        "SELECT * FROM o WHERE k NOT IN (SELECT id FROM b)": None,
        "SELECT * FROM b WHERE b.k NOT IN (SELECT id FROM b)": None,
        "SELECT * FROM o WHERE o.k NOT IN (SELECT k FROM t GROUP BY k)": None,
        "SELECT 'YEAR(d) = 2026' FROM t WHERE YEAR(d) = 2026 + 1": None,
        "SELECT * FROM t WHERE MONTH(d) = 1": None,
        "SELECT * FROM t WHERE YEAR(d) = 2020 -- tail\n": "SELECT * FROM t WHERE d >= CAST('2020-01-01' AS DATE) AND d < CAST('2021-01-01' AS DATE) -- tail\n",
    }
    new, _ = rewrite.rewrite_corpus(scripts_frame(spark, list(cases)))
    rows = {r.script_id: r.sql for r in new.collect()}
    for i, (old, want) in enumerate(cases.items()):
        assert rows[i] == (want or old)
    assert rewrite.rewrite_patches(spark.createDataFrame([(k, "duckdb", v) for k, v in rows.items()], "script_id long, dialect string, sql string")).count() == 0


def test_templates(spark):
    df = spark.createDataFrame([("SELECT 1\n\nFROM {{ ref('a.b') }}{% if x %} y{% endif %}",)], "s string")
    row = df.select(X.strip_templates(F.col("s")).alias("o"), X.template_count(F.col("s")).alias("n")).first()
    assert (row.o, row.n) == ("SELECT 1\nFROM __dbt_ref_a__b__ y", 1)


def test_scripts_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_bytes("﻿SELECT 1".encode())
    (tmp_path / "sub" / "b.sql").write_bytes(b"SELECT '\xff'")
    (tmp_path / "sub" / "skip_me.sql").write_text("SELECT 3")
    (tmp_path / "note.txt").write_text("no")
    root = str(tmp_path)
    found = files.scan_scripts(spark, [root, f"{root}/a.sql"], excludes=["skip_*"])
    got = {r.path.rsplit("/", 1)[1]: r.sql for r in found.collect()}
    assert got == {"a.sql": "SELECT 1", "b.sql": "SELECT '�'"}
    assert files.scan_scripts(spark, [f"{root}/**/*.sql"]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.scan_scripts(spark, [f"{root}/none"])
    with pytest.raises(FileNotFoundError):
        files.scan_compiled_models(spark, root)
    (tmp_path / "compiled").mkdir()
    (tmp_path / "dbt_project.yml").write_text("name: x")
    assert files.scan_compiled_models(spark, root).count() == 0
    assert files.project_root(spark, f"{root}/sub") == root


def test_csv_hint_needs_every_value(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("width,created_at,day\nwide,2024-01-01 10:00:00,soon\nslim,2024-01-02 10:00:00,2024-01-01\n")
    types = dict(tabular.read_csv_typed(spark, str(path)).dtypes)
    assert types == {"width": "string", "created_at": "timestamp", "day": "string"}
    with pytest.raises(ValueError):
        tabular.export(spark.range(1), "xlsx", str(tmp_path / "y"))
    assert tabular.export(spark.range(7), "parquet", str(tmp_path / "z"))["rows_written"] == 7


def test_usage_log_skips_bad_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"ts": 1, "operation": "a"}\n\nnot json\n{"ts": 2, "operation": "b"}\n')
    assert [r.operation for r in records.read_usage_log(spark, str(path), 1).collect()] == ["b"]
    assert records.read_usage_log(spark, str(path)).count() == 2


def test_one_decimal_rounds_like_the_exact_value(spark):
    from queryscope.operators.profile import one_decimal

    values = [499705.05, 0.25, 0.35, -0.25, -0.01, 2.0, 1e6 + 0.05, 0.05, 0.15, 123.449999, -7.65, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.s for r in df.select(one_decimal(F.col("x")).alias("s")).collect()] == [f"{v:.1f}" for v in values]
