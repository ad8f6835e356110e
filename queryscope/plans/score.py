"""Risk scores, cost estimates and report aggregates over findings."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope import lookups as L
from queryscope.plans import lineage as G
from queryscope.plans import lint
from queryscope.plans.tokens import table_names

c = F.col


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _weighted(n: Column, base: int, step: int, cap: int) -> Column:
    return F.when(n > 0, base + F.least(n - 1, F.lit(cap)) * step).otherwise(0)


def band(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


SCORE_ANCHORS = sorted({a for r in lint.CORE_RULES[:4] if r.rule_id != "SQL-NOTIN-001" for a in r.anchors} | {"("})


def risk_score(tokens: DataFrame) -> DataFrame:
    """``scores`` per script, folded straight from the tokens it is already partitioned by."""
    n = tokens.groupBy("script_id").agg(
        F.count_if(F.coalesce(lint.cartesian(), F.lit(False)) & ~c("stmt_broken")).alias("cart"),
        F.count_if(F.coalesce(lint.unsargable(), F.lit(False)) & ~c("stmt_broken")).alias("sarg"),
        F.count_if(F.coalesce(lint.nested_sort(), F.lit(False)) & ~c("stmt_broken")).alias("sort"),
        F.max(F.when(~c("stmt_broken"), G.depth_here()).otherwise(0)).alias("depth"),
        F.bool_or(table_names(tokens) & ~c("stmt_broken")).alias("has_table"),
        F.bool_and("stmt_broken").alias("unread"),
    )
    parts = n.select(
        "script_id", "cart", "sarg", "sort", "depth", "has_table", "unread",
        _weighted(c("cart"), 50, 5, 2).cast("int").alias("join_risk"),
        _weighted(c("sort"), 20, 5, 2).cast("int").alias("sort_risk"),
        _weighted(c("sarg"), 25, 2, 5).cast("int").alias("sarg_risk"),
        F.when(c("depth") > 1, F.least((c("depth") - 1) * 5, F.lit(10))).otherwise(0).cast("int").alias("depth_bonus"),
    )
    total = c("join_risk") + c("sort_risk") + c("sarg_risk") + c("depth_bonus")
    parts = parts.withColumn("risk_score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    complexity = F.when(~c("unread") & ~c("has_table"), "O(1)").when(c("cart") > 0, "O(N*M)").otherwise("O(N)")
    why = F.concat_ws(
        "; ",
        F.when(c("cart") > 0, F.format_string("%d join(s) without a condition (+%d)", "cart", "join_risk")),
        F.when(c("sarg") > 0, F.format_string("%d hidden column(s) (+%d)", "sarg", "sarg_risk")),
        F.when(c("sort") > 0, F.format_string("%d unbounded nested sort(s) (+%d)", "sort", "sort_risk")),
        F.when(c("depth_bonus") > 0, F.format_string("nesting depth %d (+%d)", "depth", "depth_bonus")),
    )
    return parts.select(
        "script_id", "risk_score", band(c("risk_score")).alias("risk_level"), complexity.alias("scan_complexity"),
        "join_risk", "sort_risk", "sarg_risk", "depth_bonus", F.when(why == "", "no risk found").otherwise(why).alias("explanation"),
    )


def score_corpus(scripts: DataFrame, dedup: bool = True) -> DataFrame:
    """Scores of every script, an empty one too; each distinct text is read once."""
    if not dedup:
        return _for_all(scripts.select("script_id").join(risk_score(lint.annotate_scripts(scripts)), "script_id", "left"))
    return _for_all(lint.per_text(scripts, lambda texts: risk_score(lint.annotate_scripts(texts)), "left"))


def _for_all(scores: DataFrame) -> DataFrame:
    """Scripts without a token have no risk."""
    texts = {"risk_level": "LOW", "scan_complexity": "O(N)", "explanation": "no risk found"}
    numbers = {n: 0 for n in ("risk_score", "join_risk", "sort_risk", "sarg_risk", "depth_bonus")}
    return scores.fillna({**texts, **numbers})


# --- cost ---------------------------------------------------------------------------

def table_counts(tokens: DataFrame) -> DataFrame:
    """Distinct table names per script, in lower case, zero kept."""
    names = G.table_refs(tokens).select("script_id", F.lower("name").alias("name")).distinct()
    n = names.groupBy("script_id").agg(F.count(F.lit(1)).alias("tables"))
    return tokens.select("script_id").distinct().join(n, "script_id", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))


def _ladder(need: Column, value: int) -> Column:
    out = F.lit(L.WAREHOUSE_LADDER[-1][value])
    for step in reversed(L.WAREHOUSE_LADDER):
        out = F.when(F.lit(step[1]) >= need, step[value]).otherwise(out)
    return out


def cloud_cost(counts: DataFrame, scan_bytes: int = L.SCAN_BYTES_HINT) -> DataFrame:
    """On-demand scan cost and the smallest warehouse that fits, from (script_id, tables)."""
    total = F.greatest(c("tables"), F.lit(1)) * F.lit(scan_bytes)
    billed = F.greatest(total, c("tables") * F.lit(L.MIN_SCAN_BYTES))
    return counts.select(
        "script_id", "tables",
        F.round(total / 2.0**40, 6).alias("scan_tib"),
        F.round(billed / 2.0**40 * L.SCAN_USD_PER_TIB, 4).alias("scan_usd"),
        _ladder(c("tables"), 0).alias("warehouse"),
        _ladder(c("tables"), 1).alias("credits_per_hour"),
        F.round(_ladder(c("tables"), 1) * L.USD_PER_CREDIT, 2).alias("usd_per_hour"),
    )


def _base_usd(platform: str, scan_bytes: int) -> Column:
    if platform == "bigquery":
        total = F.greatest(c("tables"), F.lit(1)) * F.lit(scan_bytes)
        return F.greatest(total, c("tables") * F.lit(L.MIN_SCAN_BYTES)) / 2.0**40 * L.SCAN_USD_PER_TIB
    return _ladder(F.greatest(c("tables"), F.lit(1)), 1) * L.USD_PER_CREDIT / 3600.0


def finops(findings: DataFrame, counts: DataFrame, platform: str = "snowflake", scan_bytes: int = L.SCAN_BYTES_HINT, runs: int = L.MONTHLY_RUNS) -> DataFrame:
    """Cost now, cost after the rewrites, and monthly savings per script."""
    weight = F.coalesce(_map(L.SEVERITY_WEIGHT)[F.upper("severity")], F.lit(1.0))
    unit = F.coalesce(_map(L.RULE_SAVINGS_WEIGHT)[c("rule_id")], F.lit(0.0)) * F.coalesce(_map(L.SEVERITY_WEIGHT)[F.upper("severity")], F.lit(2.0))
    folded = findings.groupBy("script_id").agg(F.max(weight).alias("worst"), F.sum(unit).alias("units"))
    j = counts.join(folded, "script_id", "left").withColumn("base_usd", _base_usd(platform, scan_bytes))
    as_is = F.round(c("base_usd") * F.greatest(F.coalesce("worst", F.lit(1.0)), F.lit(1.0)), 6)
    j = j.withColumn("as_is_usd", as_is)
    cut = F.least(F.coalesce("units", F.lit(0.0)) / 12.0, F.lit(0.85))
    j = j.withColumn("post_fix_usd", F.round(F.greatest(F.lit(0.0), c("as_is_usd") - c("as_is_usd") * cut), 6))
    j = j.withColumn("savings_usd", F.round(c("as_is_usd") - c("post_fix_usd"), 6))
    pct = F.when(c("as_is_usd") > 0, F.round(c("savings_usd") / c("as_is_usd") * 100.0, 2)).otherwise(0.0)
    return j.select("script_id", "tables", "as_is_usd", "post_fix_usd", "savings_usd", pct.alias("savings_pct"), F.round(c("savings_usd") * runs, 2).alias("monthly_savings"))


def rule_cost_breakdown(findings: DataFrame, base_usd: float) -> DataFrame:
    """Per rule with a savings weight: count, severity of the first finding, unit and cost."""
    first = F.min_by(F.upper("severity"), F.struct("script_id", "line", "col"))
    rows = findings.filter(c("rule_id").isin(list(L.RULE_SAVINGS_WEIGHT)))
    out = rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("count"), first.alias("severity"))
    unit = F.round(_map(L.RULE_SAVINGS_WEIGHT)[c("rule_id")] * F.coalesce(_map(L.SEVERITY_WEIGHT)[c("severity")], F.lit(2.0)), 4)
    return out.withColumn("unit", unit).withColumn("usd", F.round(F.lit(base_usd) * c("unit") / 12.0, 6))


# --- reports ----------------------------------------------------------------------------

def _by_severity() -> list[Column]:
    return [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in L.SEVERITY_RANK]


def run_summary(scripts: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: files, findings by severity (zeros kept), worst score and its level."""
    files = scripts.agg(F.count(F.lit(1))).scalar()
    top = scores.agg(F.max("risk_score").alias("s")).select(F.coalesce("s", F.lit(0)).alias("s"))
    out = findings.agg(F.count(F.lit(1)).alias("total"), *_by_severity())
    return out.withColumns({"files": files, "max_risk_score": top.scalar()}).withColumn("max_risk_level", band(c("max_risk_score"))).withColumn(
        "has_critical", c("critical") > 0
    )


def quality_gate(findings: DataFrame, scores: DataFrame, min_severity: str | None = None, fail_on: str = "critical") -> DataFrame:
    """Exit code 1 when the worst visible finding reaches the threshold; the score is unfiltered."""
    seen = lint.filter_findings(findings, min_severity=min_severity)
    rank = F.max(lint.severity_rank(c("severity")))
    score = scores.agg(F.coalesce(F.max("risk_score"), F.lit(0))).scalar()
    return seen.agg(
        F.when(rank >= L.GATE_RANK[fail_on], 1).otherwise(0).alias("exit_code"),
        F.count(F.lit(1)).alias("issues_found"),
        F.coalesce(F.bool_or(F.upper("severity") == "CRITICAL"), F.lit(False)).alias("has_critical"),
    ).withColumn("risk_score", score)


def health_score(findings: DataFrame) -> DataFrame:
    """100 minus at most 50 for the findings, with the letter, the gauge cut and its tier."""
    penalty = F.coalesce(F.sum(F.coalesce(_map(L.HEALTH_PENALTY)[F.upper("severity")], F.lit(0))), F.lit(0))
    out = findings.agg((100 - F.least(penalty, F.lit(50))).cast("int").alias("health"))
    h = c("health")
    letter = F.when(h >= 90, "A").when(h >= 80, "B").when(h >= 65, "C").when(h >= 50, "D").otherwise("F")
    gauge = F.when(h >= 90, "A").when(h >= 80, "B").when(h >= 70, "C").when(h >= 60, "D").otherwise("F")
    tier = F.lit(None).cast("string")
    for least, name in reversed(L.HEALTH_TIERS):
        tier = F.when(h >= least, name).otherwise(tier)
    return out.withColumns({"letter": letter, "gauge": gauge, "tier": tier})


def model_summary(models: DataFrame, findings: DataFrame) -> DataFrame:
    linted = models.agg(F.count(F.lit(1))).scalar()
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("rule_id") == "SQL-CART-001").alias("cartesian"), F.count_distinct("script_id").alias("models_with_issues")
    ).withColumn("models_linted", linted)


def count_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("rule_id"))


def sarif_results(findings: DataFrame, scripts: DataFrame) -> DataFrame:
    """One SARIF result per finding as JSON text."""
    f = findings.join(scripts.select("script_id", "path").hint("merge"), "script_id")
    place = F.struct(F.struct(F.struct(c("path").alias("uri")).alias("artifactLocation"), F.struct(c("line").alias("startLine"), c("col").alias("startColumn"), F.when(c("snippet") != "", F.struct(c("snippet").alias("text"))).alias("snippet")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        c("rule_id").alias("ruleId"), F.coalesce(_map(L.SARIF_LEVEL)[F.upper("severity")], F.lit("warning")).alias("level"),
        F.struct(c("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.concat_ws(":", "rule_id", "path", c("line").cast("string"), c("col").cast("string")).alias("primaryLocationLineHash")).alias("partialFingerprints"),
    )
    return f.select("script_id", "path", F.to_json(result).alias("result"))


def sarif_document(spark, rules, tool: str = "queryscope") -> DataFrame:
    """One row (head, tail) of JSON text: a document is the head, result rows joined by commas, and the tail.

    The head names the tool and describes each rule once, so results of any number of
    output parts make valid documents of their own.
    """
    described = [{"id": r.rule_id, "name": r.title, "shortDescription": {"text": r.title}, "defaultConfiguration": {"level": L.SARIF_LEVEL.get(r.severity, "warning")}} for r in {r.rule_id: r for r in rules}.values()]
    driver = json.dumps({"name": tool, "rules": described})
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + driver + '}, "results": ['
    return spark.createDataFrame([(head, "]}]}")], "head string, tail string")


REPORT_SCHEMA = "1.0.0"


def report_rows_json(findings: DataFrame, scripts: DataFrame) -> DataFrame:
    """Versioned audit rows, one JSON text per finding; written as JSON lines."""
    f = findings.join(scripts.select("script_id", "path").hint("merge"), "script_id")
    row = F.struct(F.lit(REPORT_SCHEMA).alias("schema_version"), "path", "rule_id", "severity", "title", "message", "line", "col", "snippet", "suggested_fix")
    return f.select("script_id", F.to_json(row).alias("row"))


def batch_summary(scripts: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings and status of every script, clean ones included."""
    n = findings.groupBy("script_id").agg(F.count(F.lit(1)).alias("findings"))
    out = scripts.select("script_id").join(n.hint("merge"), "script_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return out.withColumn("status", F.when(c("findings") > 0, "findings").otherwise("ok"))


EDUCATION = {
    "SQL-CART-001": ("Every row meets every row, so the result grows with the product of both sides.", "State the key the tables share.", "joins"),
    "SQL-SARG-001": ("The engine has to compute the expression for each row before it can compare.", "Leave the column bare and change the other side.", "predicates"),
    "SQL-NOTIN-001": ("A NULL among the values turns the whole test unknown.", "Use NOT EXISTS or filter the NULLs.", "nulls"),
    "SQL-SORT-001": ("The order of a nested block is not kept by the query around it.", "Sort once, outside.", "sorting"),
    "SQL-STAR-001": ("Columns nobody reads are still carried along.", "Name the columns.", "projection"),
    "SQL-CAST-001": ("A converted key cannot use what is stored about the column.", "Align the types in the tables.", "types"),
    "SQL-LIKE-001": ("Without a prefix there is nothing to look up.", "Search a reversed or trigram copy.", "text search"),
    "PARSER-001": ("A statement that does not parse was not checked.", "Repair it and run again.", "syntax"),
}


def with_education(findings: DataFrame) -> DataFrame:
    """Add why, how to fix and the topic to read about; the texts are literals of the plan."""
    texts = F.create_map(*[x for k, v in EDUCATION.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("why"), F.lit(v[1]).alias("fix"), F.lit(v[2]).alias("learn")))])
    return findings.withColumn("__e", texts[c("rule_id")]).select("*", "__e.why", c("__e.fix").alias("how_to_fix"), "__e.learn").drop("__e")


def nearest_finding(stages: DataFrame, findings: DataFrame, radius: int = 5) -> DataFrame:
    """The highest-severity finding within ``radius`` lines of each stage.

    Lines are cut into slices as wide as the reach, so a stage meets only the
    findings of one or two slices of its script.
    """
    width = 2 * radius + 1
    s = stages.withColumn("slice", F.explode(F.array_distinct(F.array(F.floor((c("line") - radius) / width), F.floor((c("line") + radius) / width)))))
    f = findings.filter("line > 0").select(
        "script_id", F.floor(c("line") / width).alias("slice"), c("line").alias("f_line"), c("col").alias("f_col"), "rule_id", "severity", lint.severity_rank(c("severity")).alias("rank")
    )
    hits = s.join(f, ["script_id", "slice"]).filter(F.abs(c("f_line") - c("line")) <= radius)
    best = hits.groupBy("script_id", "stmt_no", "kind").agg(
        F.max_by(F.struct("rule_id", "severity", "f_line"), F.struct("rank", -c("f_line"), -c("f_col"), "rule_id")).alias("b")
    )
    return stages.join(best, ["script_id", "stmt_no", "kind"], "left").select(*stages.columns, "b.rule_id", "b.severity", c("b.f_line").alias("finding_line"))


def validate_rewrites(before: DataFrame, after: DataFrame, scripts: DataFrame) -> DataFrame:
    """Findings of each script before and after, and whether the rewrite removed some."""
    b = before.groupBy("script_id").agg(F.count(F.lit(1)).alias("baseline"))
    a = after.groupBy("script_id").agg(F.count(F.lit(1)).alias("remaining"))
    out = scripts.select("script_id").join(b.hint("merge"), "script_id", "left").join(a.hint("merge"), "script_id", "left").na.fill(0, ["baseline", "remaining"])
    note = F.when(c("remaining") < c("baseline"), "reduced").when(c("remaining") == c("baseline"), "unchanged").otherwise("increased")
    return out.withColumn("validated", c("remaining") < c("baseline")).withColumn("note", note)
