"""Report files are whole JSON documents, and every script has its object."""
import glob
import json

from pyspark.sql import functions as F

from conftest import scripts_frame
from queryscope.operators import usage
from queryscope.plans import lint
from queryscope.plans import reports as R

TEXTS = ["SELECT * FROM a CROSS JOIN b", "SELECT 1", None, "", 'SELECT "q\n\\" FROM t WHERE x NOT IN (SELECT y FROM u)'] + [f"SELECT {i} FROM a, b" for i in range(30)]


def documents(path):
    return [json.loads(open(f, encoding="utf-8").read()) for f in sorted(glob.glob(f"{path}/part-*"))]


def made(spark):
    scripts = scripts_frame(spark, TEXTS).withColumn("path", F.when(F.col("script_id") != 1, F.concat(F.lit("é/"), "script_id", F.lit(".sql"))))
    return scripts, lint.lint_corpus(scripts)


def test_script_objects(spark):
    scripts, findings = made(spark)
    got = {r.script_id: json.loads(r.result) for r in R.script_results(scripts, findings).collect()}
    counts = {r.script_id: r["count"] for r in findings.groupBy("script_id").count().collect()}
    assert len(got) == len(TEXTS) and "path" not in got[1] and got[0]["path"] == "é/0.sql"
    for k, o in got.items():
        assert o["summary"]["total"] == len(o["findings"]) == counts.get(k, 0) and (o["status"] == "ok") == (k not in counts)
        assert sum(o["summary"][s] for s in R.SEVERITIES) == o["summary"]["total"]
        assert [(f["line"], f["col"]) for f in o["findings"]] == sorted((f["line"], f["col"]) for f in o["findings"])


def test_every_file_is_a_document(spark, tmp_path):
    scripts, findings = made(spark)
    R.write_sarif(findings, scripts, f"{tmp_path}/s", files=3)
    R.write_report(scripts, findings, f"{tmp_path}/r", files=50)
    sarif, report = documents(f"{tmp_path}/s"), documents(f"{tmp_path}/r")
    assert len(sarif) == 3 and sum(len(d["runs"][0]["results"]) for d in sarif) == findings.count() and all(d["runs"][0]["tool"]["driver"]["rules"] for d in sarif)
    assert len(report) == 50 and sum(len(d["results"]) for d in report) == len(TEXTS)  # more files than rows: some have no results
    assert all(d["summary"] == report[0]["summary"] for d in report) and report[0]["summary"]["total"] == findings.count()
    back = R.read_documents(spark, f"{tmp_path}/r", "results", "results array<struct<path: string, status: string>>")
    assert back.count() == len(TEXTS)


def test_empty_run(spark, tmp_path):
    scripts, findings = made(spark)
    R.write_sarif(findings.limit(0), scripts.limit(0), f"{tmp_path}/s")
    R.write_report(scripts.limit(0), findings.limit(0), f"{tmp_path}/r")
    assert documents(f"{tmp_path}/s")[0]["runs"][0]["results"] == documents(f"{tmp_path}/r")[0]["results"] == []


def test_log_of_bounded_length(spark):
    for n in (0, 1, 10, 11, 15, 16, 30):
        log = []
        for i in range(n):
            log.append(i)
            if len(log) > 10:
                del log[:5]
        rows = spark.createDataFrame([(i, float(i // 2)) for i in range(n)], "event_id long, ts double")
        assert sorted(r.event_id for r in usage.audit_capped(rows, 10).collect()) == log
