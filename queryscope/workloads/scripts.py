"""Queries over the SQL corpus: preparation, rules, scores, reports and rewrites."""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope import lookups as L
from queryscope.functions import text as X
from queryscope.operators import query as Q
from queryscope.operators import usage as U
from queryscope.plans import lineage as G
from queryscope.plans import lint, patterns, rewrite
from queryscope.plans import reports as R
from queryscope.plans import score as S
from queryscope.plans import tokens as T
from queryscope.plans.findings_store import FindingsStore
from queryscope.plans.findings_store import lint_incremental as lint_incremental_run
from queryscope.session import shared_folder
from queryscope.sources.catalog import catalog_from
from queryscope.workloads import corpus as C
from queryscope.workloads.registry import query, table

_CTE = C.corpus_sql()
_SEVERITY = {"SQL-CART-001": "CRITICAL", "SQL-SARG-001": "HIGH", "SQL-NOTIN-001": "HIGH", "SQL-SORT-001": "HIGH", "SQL-STAR-001": "MEDIUM",
             "SQL-CAST-001": "MEDIUM", "SQL-LIKE-001": "MEDIUM", "PARSER-001": "HIGH", "SQL-WILD-001": "MEDIUM"}


def _found(counts):
    return " UNION ALL ".join(
        f"SELECT script_id, t, path, dialect, '{rule}' AS rule_id, '{_SEVERITY[rule]}' AS severity FROM scripts, unnest(range(x_{field}))" for rule, field in counts.items()
    )


_WITH = f"WITH {_CTE}, found AS ({_found(C.COUNTS)}), pro AS ({_found(C.PRO_COUNTS)}) "
_RULE_COUNTS = "SELECT script_id, rule_id, severity, count(*) AS n FROM {src} GROUP BY 1, 2, 3"


def _counts(findings):
    return findings.groupBy("script_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _scripts(spark, sf_dir):
    return C.corpus(spark, sf_dir)


def _per_text(spark, sf_dir, work):
    """What ``work`` reads off the annotated tokens of a text, for every script that holds it."""
    return lint.per_text(_scripts(spark, sf_dir), lambda texts: work(lint.annotate_scripts(texts)))


def _core(spark, sf_dir):
    return lint.lint_corpus(_scripts(spark, sf_dir), lint.DEFAULT_RULES)


# --- preparation ------------------------------------------------------------------------

_RX = (
    r"--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*[\s\S]*|''(?:[^'']|'''')*''?|\"[^\"]*\"?|`[^`]*`?|[\p{L}_][\p{L}\p{N}_$]*|"
    r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|->>|->|=>|:=|<=>|<=|>=|<>|!=|==|\|\||::|<<|>>|\s+|[\s\S]"
)


def _token_sql(source):
    return (
        f"WITH {source}, r AS (SELECT script_id, regexp_extract_all(sql, '{_RX}') AS a FROM scripts), "
        "x AS (SELECT script_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS tok FROM r), "
        "o AS (SELECT *, coalesce(sum(length(tok)) OVER w, 0) AS off, coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER w, 0) + 1 AS line FROM x "
        "WINDOW w AS (PARTITION BY script_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "b AS (SELECT *, coalesce(max(CASE WHEN contains(tok, chr(10)) THEN off + length(tok) - length(regexp_extract(tok, '[^\\n]*$')) END) OVER "
        "(PARTITION BY script_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bol FROM o) "
        "SELECT script_id, tok, CAST(off AS INTEGER) AS off, CAST(line AS INTEGER) AS line, CAST(off - bol + 1 AS INTEGER) AS col FROM b "
        "WHERE NOT regexp_full_match(tok, '\\s+') AND NOT starts_with(tok, '--') AND NOT (starts_with(tok, '/*') AND ends_with(tok, '*/'))"
    )


@query("tokenize", _token_sql(_CTE))
def tokenize(spark, sf_dir):
    return T.tokenize(_scripts(spark, sf_dir)).filter("kind <> 'end'").select("script_id", "tok", "off", "line", "col")


@query("tokenize_documents", _token_sql("scripts AS (SELECT doc_id AS script_id, text AS sql FROM documents)"))
def tokenize_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), F.lit("duckdb").alias("dialect"), F.col("text").alias("sql"))
    return T.tokenize(d).filter("kind <> 'end'").select("script_id", "tok", "off", "line", "col")


_STATEMENTS = (
    "SELECT script_id, 1 AS stmt_no, 0 AS start_off, CASE WHEN t = 30 THEN strpos(sql, ';') - 1 ELSE length(sql) END AS end_off, "
    "CASE WHEN t = 30 THEN substr(sql, 1, strpos(sql, ';') - 1) ELSE sql END AS stmt FROM scripts "
    "UNION ALL SELECT script_id, 2, strpos(sql, '; S') + 1, strpos(sql, 'nation;') + 5, 'SELECT n_name FROM nation' FROM scripts WHERE t = 30"
)


@query("split_statements", f"WITH {_CTE} {_STATEMENTS}")
def split_statements(spark, sf_dir):
    return T.split_statements(_scripts(spark, sf_dir), quoted_identifiers=True)


@query(
    "statement_at",
    f"WITH {_CTE}, s AS ({_STATEMENTS}) SELECT c.script_id, c.off, s.stmt_no, coalesce(s.stmt, c.sql) AS stmt FROM (SELECT *, p_size * 3 AS off FROM scripts JOIN part ON p_partkey = script_id) c "
    "LEFT JOIN s ON s.script_id = c.script_id AND c.off BETWEEN s.start_off AND s.end_off",
)
def statement_at(spark, sf_dir):
    scripts = _scripts(spark, sf_dir)
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("script_id"), (F.col("p_size") * 3).alias("off"))
    return G.statement_at(points, T.split_statements(scripts, quoted_identifiers=True), scripts)


def _detect_sql(col):
    whens = " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{n}'".replace("N'[^']*'", "N''[^'']*''") for n, p in L.DIALECT_SIGNATURES)
    return f"CASE WHEN trim({col}) = '' THEN 'duckdb' {whens} ELSE 'duckdb' END"


@query("detect_dialect", f"WITH {_CTE} SELECT script_id, {_detect_sql('sql')} AS dialect FROM scripts")
def detect_dialect(spark, sf_dir):
    return _scripts(spark, sf_dir).select("script_id", X.detect_dialect(F.col("sql")).alias("dialect"))


@query("detect_dialect_pages", f"SELECT page_id, {_detect_sql('html')} AS dialect FROM pages")
def detect_dialect_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.detect_dialect(F.col("html")).alias("dialect"))


_NAMES = [" PostgreSQL ", "pg", "BQ", "mssql", "T-SQL", "spark", "DuckDB", "oracle", "snowflake", ""]
_CANON = ["postgres", "postgres", "bigquery", "tsql", "tsql", "databricks", "duckdb", None, "snowflake", None]


@query(
    "normalize_dialect",
    "SELECT c_custkey, [" + ",".join("NULL" if n is None else f"'{n}'" for n in _CANON) + f"][c_custkey % {len(_NAMES)} + 1] AS dialect FROM customer",
)
def normalize_dialect(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("c_custkey") % len(_NAMES)).cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_dialect(names).alias("dialect"))


@query(
    "strip_templates",
    "SELECT p_partkey, 'SELECT a.x' || chr(10) || 'FROM __dbt_ref_stg__m' || p_size || '__ a, __dbt_ref_raw__ b' || chr(10) || 'WHERE x > __dbt_macro__' AS sql, 4 AS replaced FROM part",
)
def strip_templates(spark, sf_dir):
    text = F.concat(
        F.lit("{{ config(materialized='table') }}\n{% set a = 1 %}\n\nSELECT a.x\nFROM {{ ref('stg.m"), F.col("p_size"), F.lit("') }} a, {{ref(\"raw\")}} b\n  \n{# note\n{{ x }} #}\nWHERE x > {{ var(\n'k') }}"),
    )
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(text, r"\{\{ config.*?\}\}\n", ""), r"\{\{ x \}\}", "x").alias("raw"), text.alias("full"))
    return p.select("p_partkey", X.strip_templates(F.col("raw")).alias("sql"), (X.template_count(F.col("full")) - 1).alias("replaced"))


@query("fingerprint", "SELECT doc_id, sha256(lang || '::' || text) AS fp, sha256(lang || '|' || text) AS cache_key FROM documents")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", lint.fingerprint(F.col("lang"), F.col("text")).alias("fp"), lint.fingerprint(F.col("lang"), F.col("text"), "|").alias("cache_key"))


@query("distinct_scripts", "SELECT DISTINCT sha256(lang || '::' || text) AS script_id, lang AS dialect, length(text) AS n FROM documents")
def distinct_scripts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("dialect"), F.col("text").alias("sql"))
    return lint.distinct_scripts(d).select("script_id", "dialect", F.length("sql").alias("n"))


@query("unfence_sql", f"WITH {_CTE} SELECT script_id, sql FROM scripts")
def unfence_sql(spark, sf_dir):
    key = F.col("script_id") % 3
    fenced = F.when(key == 0, F.concat(F.lit("\n```sql\n"), "sql", F.lit("\n```  \n"))).when(key == 1, F.concat(F.lit("```\n"), "sql")).otherwise(F.concat(F.lit("  "), "sql"))
    return _scripts(spark, sf_dir).select("script_id", X.unfence_sql(fenced).alias("sql"))


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("snippet", f"SELECT doc_id, CASE WHEN length(s) > 72 THEN substr(s, 1, 69) || '...' ELSE s END AS snippet FROM (SELECT doc_id, {_FLAT} AS s FROM documents)")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query(
    "history_preview",
    f"SELECT doc_id, CASE WHEN s = '' THEN '(empty query)' WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END AS preview FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_FLAT} END AS s FROM documents)",
)
def history_preview(spark, sf_dir):
    text = F.when(F.col("doc_id") % 11 == 0, " \n ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", U.history_preview(text).alias("preview"))


@query(
    "find_params",
    f"WITH {_CTE} SELECT script_id, CASE WHEN t = 35 THEN ['low', 'k9', 'tag'] ELSE ['low', 'k9', 'tag'] END AS params FROM scripts",
)
def find_params(spark, sf_dir):
    sql = F.concat("sql", F.lit("\n AND a > :low AND b = x::int AND c < :k9 AND d = {{ tag }} AND e = :low"))
    return _scripts(spark, sf_dir).select("script_id", Q.find_params(sql).alias("params"))


@query("bind_text", f"WITH {_CTE} SELECT script_id, sql || ' AND a > ''it''''s'' AND b < :low2 AND d = ''7'' AND e = :empty' AS sql FROM scripts")
def bind_text(spark, sf_dir):
    sql = F.concat("sql", F.lit(" AND a > :low AND b < :low2 AND d = {{ tag }} AND e = :empty"))
    return _scripts(spark, sf_dir).select("script_id", Q.bind_text(sql, {"low": "it's", "tag": "7", "empty": ""}).alias("sql"))


# --- lineage -----------------------------------------------------------------------------

def _lineage_values():
    rows = []
    for t, text in C.LINEAGE.items():
        parts = text.replace(" JOIN", "_JOIN").split(" ")
        for i, part in enumerate(parts):
            name, _, kind = part.partition(":")
            rows.append(f"({t}, {i}, '{name}', '{kind.rstrip('!').replace('_', ' ') or 'FROM'}', {str(kind.endswith('!')).lower()})")
    return "lin(t, ord, name, join_kind, problem) AS (VALUES " + ", ".join(rows) + ")"


_LIN = f"WITH {_CTE}, {_lineage_values()} "


@query("table_refs", _LIN + "SELECT DISTINCT script_id, name FROM scripts JOIN lin USING (t)")
def table_refs(spark, sf_dir):
    return _per_text(spark, sf_dir, G.table_refs).select("script_id", "name")


def _column_values():
    return "cols(t, name, col) AS (VALUES " + ", ".join(f"({t}, '{n}', '{c}')" for t, named in C.COLUMNS.items() for n, _, cs in (x.partition(".") for x in named) for c in cs.split(",")) + ")"


@query("column_refs", f"WITH {_CTE}, {_column_values()} SELECT script_id, name, col AS \"column\" FROM scripts JOIN cols USING (t)")
def column_refs(spark, sf_dir):
    return _per_text(spark, sf_dir, G.column_refs).select("script_id", "name", "column")


@query("lineage", _LIN + "SELECT script_id, name, join_kind, problem FROM scripts JOIN lin USING (t)")
def lineage(spark, sf_dir):
    return _per_text(spark, sf_dir, G.lineage).select("script_id", "name", "join_kind", "problem")


@query("table_usage", _LIN + "SELECT name, count(*) AS uses, count(*) FILTER (WHERE problem) AS problems FROM scripts JOIN lin USING (t) GROUP BY 1")
def table_usage(spark, sf_dir):
    return G.table_usage(_per_text(spark, sf_dir, G.lineage))


@query(
    "join_pairs",
    _LIN + "SELECT a.name AS left_name, b.name AS right_name, count(*) AS uses FROM scripts JOIN lin b USING (t) JOIN lin a ON a.t = b.t AND a.ord = b.ord - 1 WHERE b.join_kind <> 'FROM' GROUP BY 1, 2",
)
def join_pairs(spark, sf_dir):
    return G.join_pairs(_per_text(spark, sf_dir, G.lineage))


def _stage_values():
    rows = []
    for t in range(len(C.TEMPLATES)):
        for stmt, text in enumerate(C.STAGES.get(t, C.STAGES_DEFAULT).split(";")):
            rows += [f"({t}, {stmt}, '{k}', {G.STAGES.index(k)})" for k in text.split(",") if k]
    return "st(t, stmt_no, kind, ord) AS (VALUES " + ", ".join(rows) + ")"


_ST = f"WITH {_CTE}, {_stage_values()} "


@query("query_stages", _ST + "SELECT script_id, stmt_no, kind, ord FROM scripts JOIN st USING (t)")
def query_stages(spark, sf_dir):
    return _per_text(spark, sf_dir, G.query_stages).select("script_id", "stmt_no", "kind", "ord")


@query(
    "stage_edges",
    _ST + "SELECT script_id, stmt_no, kind AS source, target FROM (SELECT *, lead(kind) OVER (PARTITION BY script_id, stmt_no ORDER BY ord) AS target FROM scripts JOIN st USING (t)) WHERE target IS NOT NULL",
)
def stage_edges(spark, sf_dir):
    return _per_text(spark, sf_dir, lambda t: G.stage_edges(G.query_stages(t)))


def _fact_values():
    rows = []
    for t, tpl in enumerate(C.TEMPLATES):
        scans = len(C.LINEAGE[t].replace(" JOIN", "_JOIN").split(" ")) if t in C.LINEAGE else 0
        rows.append(f"({t}, {scans}, {C.FILTERS.get(t, 0)}, {C.JOINS.get(t, 0)}, {int(t == 42)}, {C.PROJECTIONS.get(t, 1)}, {str(t in C.SORTED).lower()})")
    return "facts(t, scans, filters, joins, aggs, projs, sorted) AS (VALUES " + ", ".join(rows) + ")"


_FACTS = f"WITH {_CTE}, {_fact_values()} "


@query("operator_counts", _FACTS + "SELECT script_id, scans AS table_scans, filters, joins, aggs AS aggregates, projs AS projections FROM scripts JOIN facts USING (t)")
def operator_counts(spark, sf_dir):
    return _per_text(spark, sf_dir, G.operator_counts)


_USAGE = "SELECT script_id, joins > 0 AS has_join, filters > 0 AS has_where, sorted AS has_orderby, aggs > 0 AS has_groupby, projs > 0 AS has_select FROM scripts JOIN facts USING (t)"


@query("clause_usage", _FACTS + _USAGE)
def clause_usage(spark, sf_dir):
    return _per_text(spark, sf_dir, G.clause_usage)


@query(
    "clause_totals",
    _FACTS + "SELECT " + ", ".join(f"count(*) FILTER (WHERE has_{n}) AS \"{n}\"" for n in ("join", "where", "orderby", "groupby", "select")) + f" FROM ({_USAGE})",
)
def clause_totals(spark, sf_dir):
    return G.clause_totals(_per_text(spark, sf_dir, G.clause_usage))


@query("nesting_depth", f"WITH {_CTE} SELECT script_id, CAST(x_depth AS INTEGER) AS depth FROM scripts")
def nesting_depth(spark, sf_dir):
    return _per_text(spark, sf_dir, G.nesting_depth)


def _missing_values():
    rows = []
    for t, names in C.MISSING.items():
        for n in names:
            name, dot, col = n.partition(".")
            rows.append(f"({t}, '{'column' if dot else 'table'}', '{name}', {repr(col) if dot else 'NULL'}, '{'MEDIUM' if dot else 'HIGH'}')")
    return "miss(t, kind, name, col, severity) AS (VALUES " + ", ".join(rows) + ")"


def _catalog(spark, sf_dir):
    return catalog_from(spark, {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


@query("check_schema", f"WITH {_CTE}, {_missing_values()} SELECT script_id, 'SCHEMA-001' AS rule_id, severity, kind, name, col AS \"column\" FROM scripts JOIN miss USING (t)")
def check_schema(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return _per_text(spark, sf_dir, lambda t: G.check_schema(t, catalog)).drop("stmt_no").select("script_id", "rule_id", "severity", "kind", "name", "column")


@query(
    "catalog_from",
    "SELECT 'main' AS schema, lower(table_name) AS \"table\", lower(column_name) AS \"column\" FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')",
)
def catalog_rows(spark, sf_dir):
    return _catalog(spark, sf_dir)


# --- rules -------------------------------------------------------------------------------

def _register_rule(name, rules, src, rule_id):
    @query(name, _WITH + _RULE_COUNTS.format(src=f"(SELECT * FROM {src} WHERE rule_id = '{rule_id}')"))
    def run(spark, sf_dir, rules=rules):
        return _counts(lint.lint_corpus(_scripts(spark, sf_dir), rules))


for _name, _rule in zip(("cartesian", "sargable", "not_in", "nested_sort", "nested_star", "join_cast", "leading_wildcard", "malformed"), lint.DEFAULT_RULES):
    _register_rule(f"rule_{_name}", [_rule], "found", _rule.rule_id)
for _name, _rule in zip(("any_star", "pro_cartesian", "pro_sargable"), lint.PRO_RULES):
    _register_rule(f"rule_{_name}", [_rule], "pro", _rule.rule_id)


@query("lint_corpus", _WITH + _RULE_COUNTS.format(src="found"))
def lint_corpus(spark, sf_dir):
    return _counts(lint.lint_corpus(_scripts(spark, sf_dir)))


@query("lint_incremental", _WITH + _RULE_COUNTS.format(src="found"))
def lint_incremental(spark, sf_dir):
    """Two runs on one store: the second reads only the texts that the first has not seen."""
    path, scripts = shared_folder(spark, "findings-store"), _scripts(spark, sf_dir)
    FindingsStore(spark, path).update(scripts.filter("script_id % 50 <> 0"))
    return _counts(lint_incremental_run(scripts, path))


@query("pattern_rules", _WITH + "SELECT script_id, rule_id, severity, count(*) AS n FROM (SELECT * FROM found WHERE rule_id IN ('SQL-LIKE-001', 'SQL-NOTIN-001') UNION ALL SELECT * FROM pro WHERE rule_id = 'SQL-WILD-001') GROUP BY 1, 2, 3")
def pattern_rules(spark, sf_dir):
    return _counts(_per_text(spark, sf_dir, lambda t: patterns.find_patterns(t, patterns.PATTERNS)))


@query("lint_pro", _WITH + "SELECT script_id, rule_id, severity, count(*) AS n, count(*) FILTER (WHERE rule_id = 'SQL-SARG-001' AND t IN (9, 12, 29)) AS fixable FROM pro GROUP BY 1, 2, 3")
def lint_pro(spark, sf_dir):
    found = lint.lint_corpus(_scripts(spark, sf_dir), lint.PRO_RULES)
    return found.groupBy("script_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("fixable").alias("fixable"))


@query(
    "filter_findings",
    _WITH + "SELECT script_id, rule_id, severity, count(*) AS n FROM (SELECT script_id, rule_id, CASE rule_id WHEN 'SQL-LIKE-001' THEN 'HIGH' WHEN 'SQL-SARG-001' THEN 'LOW' ELSE severity END AS severity "
    "FROM found WHERE rule_id <> 'SQL-CAST-001') WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY 1, 2, 3",
)
def filter_findings(spark, sf_dir):
    keep = [r.rule_id for r in lint.DEFAULT_RULES if r.rule_id != "SQL-CAST-001"]
    return _counts(lint.filter_findings(_core(spark, sf_dir), keep, {"SQL-LIKE-001": "HIGH", "SQL-SARG-001": "LOW"}, "high"))


# --- scores and reports ------------------------------------------------------------------

@query("risk_score", f"WITH {_CTE} SELECT script_id, CAST(x_score AS INTEGER) AS risk_score, x_level AS risk_level, x_complexity AS scan_complexity FROM scripts")
def risk_score(spark, sf_dir):
    return S.score_corpus(_scripts(spark, sf_dir)).select("script_id", "risk_score", "risk_level", "scan_complexity")


_SIZE = "CASE " + " ".join(f"WHEN {v} >= greatest(n, 0) THEN '{k}'" for k, v in L.WAREHOUSE_LADDER) + " END"
_CREDITS = "CASE " + " ".join(f"WHEN {v} >= greatest(n, 0) THEN {v}" for _, v in L.WAREHOUSE_LADDER) + " END"


@query(
    "cloud_cost",
    f"WITH {_CTE} SELECT script_id, n AS tables, round(greatest(n, 1) * 104857600 / 1099511627776.0, 6) AS scan_tib, round(greatest(n, 1) * 104857600 / 1099511627776.0 * 6.25, 4) AS scan_usd, "
    f"{_SIZE} AS warehouse, {_CREDITS} AS credits_per_hour, {_CREDITS} * 3.0 AS usd_per_hour FROM (SELECT *, x_tables AS n FROM scripts)",
)
def cloud_cost(spark, sf_dir):
    return _per_text(spark, sf_dir, lambda t: S.cloud_cost(S.table_counts(t)))


_W = "CASE severity WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 2.0 WHEN 'HIGH' THEN 3.5 ELSE 6.0 END"
_U = "CASE rule_id WHEN 'SQL-CART-001' THEN 3.0::DOUBLE WHEN 'SQL-SARG-001' THEN 2.5 WHEN 'SQL-WILD-001' THEN 1.5 ELSE 0 END"


@query(
    "finops",
    _WITH + f"SELECT script_id, tables, as_is_usd, post_fix_usd, round(as_is_usd - post_fix_usd, 6) AS savings_usd, round(round(as_is_usd - post_fix_usd, 6) / as_is_usd * 100, 2) AS savings_pct, "
    f"round(round(as_is_usd - post_fix_usd, 6) * 1000, 2) AS monthly_savings FROM (SELECT *, round(as_is_usd - as_is_usd * least(units / 12.0, 0.85), 6) AS post_fix_usd FROM "
    f"(SELECT s.script_id, n AS tables, round(({_CREDITS}) * 3.0::DOUBLE / 3600 * greatest(coalesce(worst, 1), 1), 6) AS as_is_usd, coalesce(units, 0) AS units FROM (SELECT script_id, x_tables AS n FROM scripts) s "
    f"LEFT JOIN (SELECT script_id, max({_W}) AS worst, sum(({_U}) * ({_W})) AS units FROM found GROUP BY 1) f ON f.script_id = s.script_id))",
)
def finops(spark, sf_dir):
    return _per_text(spark, sf_dir, lambda t: S.finops(lint.find(t), S.table_counts(t)))


@query(
    "rule_cost_breakdown",
    _WITH + f"SELECT rule_id, count(*) AS \"count\", any_value(severity) AS severity, any_value(round(({_U}) * ({_W}), 4)) AS unit, any_value(round(0.5 * ({_U}) * ({_W}) / 12, 6)) AS usd FROM found "
    "WHERE rule_id IN ('SQL-CART-001', 'SQL-SARG-001') GROUP BY 1",
)
def rule_cost_breakdown(spark, sf_dir):
    return S.rule_cost_breakdown(_core(spark, sf_dir), 0.5)


@query(
    "run_summary",
    _WITH + "SELECT (SELECT count(*) FROM scripts) AS files, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in L.SEVERITY_RANK)
    + ", (SELECT CAST(max(x_score) AS INTEGER) FROM scripts) AS max_risk_score, 'CRITICAL' AS max_risk_level, count(*) FILTER (WHERE severity = 'CRITICAL') > 0 AS has_critical FROM found",
)
def run_summary(spark, sf_dir):
    scripts = _scripts(spark, sf_dir)
    return S.run_summary(scripts, lint.lint_corpus(scripts), S.score_corpus(scripts))


@query(
    "quality_gate",
    _WITH + "SELECT 1 AS exit_code, count(*) AS issues_found, true AS has_critical, 100 AS risk_score FROM found WHERE severity IN ('HIGH', 'CRITICAL')",
)
def quality_gate(spark, sf_dir):
    scripts = _scripts(spark, sf_dir)
    return S.quality_gate(lint.lint_corpus(scripts), S.score_corpus(scripts), min_severity="high", fail_on="critical")


@query("health_score", _WITH + "SELECT CAST(100 - least(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 18 WHEN 'MEDIUM' THEN 9 ELSE 0 END), 50) AS INTEGER) AS health, 'D' AS letter, 'F' AS gauge, 'CRITICAL RISK' AS tier FROM found")
def health_score(spark, sf_dir):
    return S.health_score(_core(spark, sf_dir))


@query(
    "model_summary",
    _WITH + "SELECT (SELECT count(*) FROM scripts) AS models_linted, count(*) AS total, count(*) FILTER (WHERE rule_id = 'SQL-CART-001') AS cartesian, count(DISTINCT script_id) AS models_with_issues FROM found",
)
def model_summary(spark, sf_dir):
    return S.model_summary(_scripts(spark, sf_dir), _core(spark, sf_dir))


@query("count_by_rule", _WITH + "SELECT rule_id, count(*) AS \"count\" FROM found GROUP BY 1")
def count_by_rule(spark, sf_dir):
    return S.count_by_rule(_core(spark, sf_dir))


@query(
    "sarif_results",
    _WITH + "SELECT script_id, rule_id, CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END AS level, path AS uri, count(*) AS n FROM found GROUP BY 1, 2, 3, 4",
)
def sarif_results(spark, sf_dir):
    out = S.sarif_results(_core(spark, sf_dir), _scripts(spark, sf_dir))
    get = lambda p: F.get_json_object("result", p)
    return out.groupBy("script_id", get("$.ruleId").alias("rule_id"), get("$.level").alias("level"), get("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri")).agg(F.count(F.lit(1)).alias("n"))


_OBJECT = "status string, summary struct<total: bigint, critical: bigint, high: bigint, medium: bigint, low: bigint>, findings array<struct<rule_id: string>>"
_OBJECT_SQL = (
    "SELECT s.script_id, s.path, CASE WHEN n > 0 THEN 'findings' ELSE 'ok' END AS status, coalesce(n, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, "
    "coalesce(medium, 0) AS medium, coalesce(n, 0) AS listed FROM scripts s LEFT JOIN (SELECT script_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, "
    "count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium FROM found GROUP BY 1) f ON f.script_id = s.script_id"
)


@query("script_results", _WITH + _OBJECT_SQL)
def script_results(spark, sf_dir):
    rows = R.script_results(_scripts(spark, sf_dir), _core(spark, sf_dir)).withColumn("o", F.from_json("result", _OBJECT))
    return rows.select("script_id", "path", "o.status", "o.summary.total", "o.summary.critical", "o.summary.high", "o.summary.medium", F.size("o.findings").cast("long").alias("listed"))


_SARIF = "runs array<struct<results: array<struct<ruleId: string, level: string>>>>"


@query("sarif_files", _WITH + "SELECT rule_id, CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END AS level, count(*) AS n FROM found GROUP BY 1, 2")
def sarif_files(spark, sf_dir):
    path = shared_folder(spark, "sarif")
    R.write_sarif(_core(spark, sf_dir), _scripts(spark, sf_dir), path, files=4)
    found = R.read_documents(spark, path, "runs", _SARIF).select(F.explode("results").alias("x"))
    return found.groupBy(F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("report_rows_json", _WITH + "SELECT path, rule_id, severity, '1.0.0' AS schema_version, count(*) AS n FROM found GROUP BY 1, 2, 3")
def report_rows_json(spark, sf_dir):
    rows = S.report_rows_json(_core(spark, sf_dir), _scripts(spark, sf_dir))
    get = lambda p: F.get_json_object("row", f"$.{p}")
    keys = ("path", "rule_id", "severity", "schema_version")
    return rows.groupBy(*[get(k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


@query("batch_summary", _WITH + "SELECT s.script_id, coalesce(n, 0) AS findings, CASE WHEN n > 0 THEN 'findings' ELSE 'ok' END AS status FROM scripts s LEFT JOIN (SELECT script_id, count(*) AS n FROM found GROUP BY 1) f ON f.script_id = s.script_id")
def batch_summary(spark, sf_dir):
    return S.batch_summary(_scripts(spark, sf_dir), _core(spark, sf_dir))


_LEARN = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in S.EDUCATION.items()) + " END"


@query("with_education", _WITH + f"SELECT script_id, rule_id, {_LEARN} AS learn, count(*) AS n FROM found GROUP BY 1, 2, 3")
def with_education(spark, sf_dir):
    return S.with_education(_core(spark, sf_dir)).groupBy("script_id", "rule_id", "learn").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_finding",
    f"WITH {_CTE}, {_stage_values()}, found AS ({_found(C.COUNTS)}), best AS (SELECT script_id, arg_max(severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS severity FROM found WHERE t <> 29 GROUP BY 1) "
    "SELECT s.script_id, kind, best.severity FROM scripts s JOIN st USING (t) LEFT JOIN best ON best.script_id = s.script_id WHERE t <> 29 "
    "UNION ALL SELECT script_id, kind, 'CRITICAL' FROM scripts JOIN st USING (t) WHERE t = 29",
)
def nearest_finding(spark, sf_dir):
    stages = _per_text(spark, sf_dir, G.query_stages)
    return S.nearest_finding(stages, _core(spark, sf_dir)).select("script_id", "kind", "severity")


# --- rewrites ------------------------------------------------------------------------------

_PATCHES = "CASE t WHEN 9 THEN 1 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 20 THEN 1 WHEN 22 THEN 1 WHEN 29 THEN 3 ELSE 0 END"
_R1 = "o_orderdate >= CAST(''{0}'' AS DATE) AND o_orderdate < CAST(''{1}'' AS DATE)"
_NEW_SQL = (
    "CASE t WHEN 9 THEN replace(sql, 'YEAR(o_orderdate) = 1996', '" + _R1.format("1996-01-01", "1997-01-01") + "') "
    "WHEN 12 THEN replace(sql, 'EXTRACT(year FROM o_orderdate) = 1997', '" + _R1.format("1997-01-01", "1998-01-01") + "') "
    "WHEN 13 THEN replace(sql, 'DATE(o_orderdate) = ''1996-01-15''', '" + _R1.format("1996-01-15", "1996-01-16") + "') "
    "WHEN 20 THEN replace(sql, 'o.o_custkey NOT IN (SELECT c.c_custkey FROM customer c)', 'NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)') "
    "WHEN 22 THEN replace(sql, 'ORDER BY p_size', '') "
    "WHEN 29 THEN replace(replace(replace(sql, 'ORDER BY o_orderdate' || chr(10), chr(10)), 'YEAR(a.o_orderdate) = 1996', 'a.o_orderdate >= CAST(''1996-01-01'' AS DATE) AND a.o_orderdate < CAST(''1997-01-01'' AS DATE)'), "
    "'a.o_custkey NOT IN (SELECT s_suppkey FROM supplier)', 'NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = a.o_custkey)') ELSE sql END"
)


@query("rewrite_corpus", f"WITH {_CTE} SELECT script_id, {_NEW_SQL} AS sql FROM scripts")
def rewrite_corpus(spark, sf_dir):
    return rewrite.rewrite_corpus(_scripts(spark, sf_dir))[0].select("script_id", "sql")


@query("rewrite_patches", f"WITH {_CTE} SELECT script_id, {_PATCHES} AS n FROM scripts WHERE {_PATCHES} > 0")
def rewrite_patches(spark, sf_dir):
    return rewrite.rewrite_patches(_scripts(spark, sf_dir)).groupBy("script_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "validate_rewrites",
    _WITH + "SELECT s.script_id, coalesce(n, 0) AS baseline, coalesce(n, 0) - fixed AS remaining, fixed > 0 AS validated, CASE WHEN fixed > 0 THEN 'reduced' ELSE 'unchanged' END AS note FROM "
    f"(SELECT script_id, {_PATCHES} AS fixed FROM scripts) s LEFT JOIN (SELECT script_id, count(*) AS n FROM found GROUP BY 1) f ON f.script_id = s.script_id",
)
def validate_rewrites(spark, sf_dir):
    def work(texts):
        after = lint.lint_corpus(rewrite.rewrite_corpus(texts)[0], dedup=False)
        return S.validate_rewrites(lint.lint_corpus(texts, dedup=False), after, texts)

    return lint.per_text(_scripts(spark, sf_dir), work)
