"""Rule lists, price ladders, weights and policies.

These are values the results depend on. They are kept together and plain, so
they can be read and checked in one place.
"""
from __future__ import annotations

# --- fixed values: severities ------------------------------------------------
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_WEIGHT = {"LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.5, "CRITICAL": 6.0}
HEALTH_PENALTY = {"CRITICAL": 25, "HIGH": 18, "MEDIUM": 9, "ERROR": 20}
HEALTH_TIERS = [(90, "GRADE A"), (70, "NEEDS AUDIT"), (0, "CRITICAL RISK")]
GATE_RANK = {"any": 1, "low": 1, "medium": 2, "high": 3, "critical": 4}
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}

# --- fixed values: functions that hide a column from an index ------------------
DATE_FUNCTIONS = ["YEAR", "QUARTER", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE", "TIME", "TIMESTAMP", "EXTRACT"]
TEXT_FUNCTIONS = ["UPPER", "LOWER", "TRIM", "LTRIM", "RTRIM", "BTRIM", "INITCAP", "SUBSTR", "SUBSTRING", "LEFT", "RIGHT", "REPLACE", "TRANSLATE"]
OTHER_FUNCTIONS = ["CONCAT_WS", "ABS", "ROUND", "FLOOR", "CEIL", "CEILING"]
DIRECT_DATE_FUNCTIONS = ["YEAR", "QUARTER", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE", "TIMESTAMP", "EXTRACT"]
COMPARISONS = ["=", "<>", "!=", ">", ">=", "<", "<=", "=="]

# --- fixed values: dialects -----------------------------------------------------
DIALECTS = ["snowflake", "bigquery", "postgres", "duckdb", "databricks", "mysql", "sqlite", "tsql"]
DIALECT_ALIASES = {
    "postgresql": "postgres",
    "pg": "postgres",
    "postgres15": "postgres",
    "bq": "bigquery",
    "mssql": "tsql",
    "t-sql": "tsql",
    "transactsql": "tsql",
    "spark": "databricks",
    "sparksql": "databricks",
}
DIALECT_SIGNATURES = [
    ("tsql", r"\[[\w\s]+\]|SET\s+IDENTITY_INSERT|GETDATE\(\)|@@\w+|sys\.\w+|N'[^']*'"),
    ("postgres", r"::[a-zA-Z_]+|ILIKE|RETURNING\s|NOW\(\)|GENERATE_SERIES"),
    ("snowflake", r"\bQUALIFY\b|\bIFF\b|\bFLATTEN\b|STAGE\s*=\s*|METADATA\$"),
    ("mysql", r"`[^`]+`|\bAUTO_INCREMENT\b|\bLIMIT\s+\d+,\s*\d+|\bNOW\(\)\b"),
    ("duckdb", r"read_csv(_auto)?|read_parquet|INSTALL\s+\w+|LOAD\s+\w+"),
    ("bigquery", r"`[\w-]+\.[\w-]+\.[\w-]+`|SAFE_CAST|STRUCT|STRING_AGG"),
]
DEFAULT_SCHEMAS = ["public", "main", "default", "dbo"]

# --- fixed values: cost models -----------------------------------------------------
SCAN_USD_PER_TIB = 6.25
MIN_SCAN_BYTES = 10 * 1024 * 1024
SCAN_BYTES_HINT = 100 * 1024 * 1024
USD_PER_CREDIT = 3.0
WAREHOUSE_LADDER = [("XS", 1), ("S", 2), ("M", 4), ("L", 8), ("XL", 16), ("2XL", 32), ("3XL", 64)]
RULE_SAVINGS_WEIGHT = {"SQL-CART-001": 3.0, "SQL-SARG-001": 2.5, "SQL-WILD-001": 1.5, "SCHEMA-001": 0.5}
MONTHLY_RUNS = 1000
USD_PER_AI_TOKEN = 0.00001

# --- fixed values: access control ------------------------------------------------------
ROLES = ["ADMIN", "BILLING", "DEVELOPER"]
ENDPOINT_POLICY = {
    "/api/licenses/revoke": "ADMIN",
    "/api/licenses/provision": "ADMIN",
    "/api/licenses/list": "BILLING",
    "/api/billing/invoices": "BILLING",
    "/api/lint": "DEVELOPER",
    "/api/lint/batch": "DEVELOPER",
    "/api/admin/audit-log": "ADMIN",
    "/api/admin/seats": "ADMIN",
    "/graphql": "DEVELOPER",
}
ACTION_PERMISSIONS = {"ADMIN": ["read", "write", "delete", "admin"], "BILLING": ["read", "write"], "DEVELOPER": ["read"]}

# --- fixed values: experiment flags -------------------------------------------------------
FLAGS = [
    {"key": "ast.rule.premium_join_hint", "default": "control", "variants": ["control", "treatment"], "enabled": True},
    {"key": "ast.rule.cte_inlining", "default": "control", "variants": ["control", "treatment"], "enabled": True},
    {"key": "ast.rule.vector_projection", "default": "control", "variants": ["control", "treatment"], "enabled": True},
    {"key": "api.batch_concurrency", "default": "4", "variants": ["4", "16"], "enabled": True},
]
BETA_RULE_FLAGS = {"nested_loop_join": "ast.rule.nested_loop_join", "index_hint": "ast.rule.index_hint"}
DEFAULT_SALT = "queryscope-v1"

# --- fixed values: plans and licence tiers --------------------------------------------------
PLAN_TIER = {"enterprise": 3, "team": 2, "pro": 1}

# --- fixed values: usage funnel ---------------------------------------------------------------
FUNNEL_STEPS = ["open", "scan", "fix", "export"]

# --- fixed values: message routing ---------------------------------------------------------------
FAQ_KEYWORDS = [
    ["install", "pip", "setup", "install"],
    ["license", "key", "activate", "activation", "mit"],
    ["gui", "ui", "dashboard", "desktop", "open"],
    ["check", "lint", "scan", "cli"],
    ["sarif", "github", "code scanning", "report"],
    ["lease", "offline", "30", "day", "grace", "hardware"],
    ["build", "exe", "nuitka", "windows", "binary"],
    ["mongo", "mongodb", "csv", "convert", "polyglot", "pandas"],
    ["keyboard", "shortcut", "ctrl", "hotkey", "hot key"],
    ["high", "dpi", "scale", "4k", "blurry"],
]
INTENTS = [
    ("sarg", r"sarg|non[- ]?sargable"),
    ("cartesian", r"cart[ée]sian|cross join|cart"),
    ("ast", r"\bast\b|parse|parsing|abstract syntax"),
    ("syntax", r"syntax error|failed to parse|parse error"),
    ("notin", r"\bnot in\b|anti[- ]?join"),
    ("sort", r"\border by\b|sort|filesort"),
    ("star", r"select \*|select star|wildcard"),
    ("cast", r"\bcast\b|join key"),
    ("like", r"\blike\b|leading.*wildcard|substring"),
]
INTENT_RULE = {
    "sarg": "SQL-SARG-001",
    "cartesian": "SQL-CART-001",
    "notin": "SQL-NOTIN-001",
    "sort": "SQL-SORT-001",
    "star": "SQL-STAR-001",
    "cast": "SQL-CAST-001",
    "like": "SQL-LIKE-001",
    "syntax": "PARSER-001",
}
