"""Column expressions over SQL text: dialects, templates, fences and previews."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queryscope import lookups as L


def detect_dialect(sql: Column) -> Column:
    """The first dialect whose signature occurs, else duckdb."""
    out = F.lit("duckdb")
    for name, pattern in reversed(L.DIALECT_SIGNATURES):
        out = F.when(sql.rlike("(?i)" + pattern), name).otherwise(out)
    return F.when(F.trim(sql) == "", "duckdb").otherwise(out)


def normalize_dialect(name: Column) -> Column:
    """The canonical dialect name, null when it is not one of the supported ones."""
    clean = F.lower(F.trim(name))
    alias = F.create_map(*[F.lit(x) for kv in L.DIALECT_ALIASES.items() for x in kv])
    known = F.coalesce(alias[clean], clean)
    return F.when(known.isin(L.DIALECTS), known)


_EXPR = r"(?s)\{\{.*?\}\}"
_REF = r"(?i)\{\{\s*ref\(\s*['\"]([\w.]+)['\"]\s*\)\s*\}\}"


def strip_templates(sql: Column) -> Column:
    """SQL with template tags neutralised: references become table names, other
    expressions a placeholder, statements and comments vanish, blank lines go."""
    out = F.regexp_replace(sql, _REF, "\u0001$1\u0002")
    out = F.regexp_replace(out, "\\.(?=[\\w.]*\u0002)", "__")
    out = F.regexp_replace(out, _EXPR, "__dbt_macro__")
    out = F.regexp_replace(F.regexp_replace(out, "\u0001", "__dbt_ref_"), "\u0002", "__")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)\{%.*?%\}", ""), r"(?s)\{#.*?#\}", "")
    lines = F.filter(F.split(out, r"\r\n|\n|\r", -1), lambda x: ~x.rlike(r"^\s*$"))
    return F.array_join(lines, "\n")


def template_count(sql: Column) -> Column:
    """Template expressions found; statements and comments do not count."""
    return F.regexp_count(sql, F.lit(_EXPR))


def unfence_sql(text: Column) -> Column:
    """Text without a leading code fence line and a closing fence."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(clean, r"^```[^\n]*(?:\n|$)", ""), r"(?:^|\n)[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(clean, F.lit("```")), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(clean)


def snippet(sql: Column, n: int = 72) -> Column:
    """Blanks collapsed; longer than n becomes n-3 characters and dots."""
    flat = F.trim(F.regexp_replace(sql, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)
