"""A SQL corpus built from the part table, with hand-written expected findings.

Each part row yields one script: template number ``p_partkey % n``, its size as a
literal and its key in a trailing comment. The same text can be built in Spark
and in DuckDB, and the expected counts are written by hand, so a check does not
repeat the token logic.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    sql: str
    cart: int = 0
    sarg: int = 0
    notin: int = 0
    sort: int = 0
    star: int = 0
    cast: int = 0
    like: int = 0
    parser: int = 0
    wild: int = 0
    pcart: int = 0
    psarg: int = 0
    score: int = 0
    level: str = "LOW"
    complexity: str = "O(N)"
    tables: int = 1
    statements: int = 1
    depth: int = 0


# --- fixed values: scripts and the findings expected of them; #S is the part size ------
TEMPLATES = [
    Template("SELECT #S", complexity="O(1)", tables=0),
    Template("SELECT p_name FROM part WHERE p_size > #S"),
    Template("SELECT * FROM nation CROSS JOIN region", cart=1, wild=1, pcart=1, score=50, level="HIGH", complexity="O(N*M)", tables=2),
    Template("SELECT * FROM orders JOIN customer WHERE orders.o_custkey = #S", cart=1, wild=1, pcart=1, score=50, level="HIGH", complexity="O(N*M)", tables=2),
    Template("SELECT * FROM orders, lineitem WHERE orders.o_orderkey = lineitem.l_orderkey", cart=1, wild=1, pcart=1, score=50, level="HIGH", complexity="O(N*M)", tables=2),
    Template("SELECT * FROM part, supplier, nation", cart=2, wild=1, pcart=2, score=55, level="HIGH", complexity="O(N*M)", tables=3),
    Template("SELECT * FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", wild=1, tables=2),
    Template("SELECT * FROM nation NATURAL JOIN region", wild=1, tables=2),
    Template("SELECT * FROM nation JOIN region USING (regionkey)", wild=1, tables=2),
    Template("SELECT * FROM orders WHERE YEAR(o_orderdate) = 1996", sarg=1, wild=1, psarg=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM part WHERE UPPER(p_brand) = 'BRAND#S'", sarg=1, wild=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM part WHERE p_size + 1 > #S", sarg=1, wild=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM orders WHERE EXTRACT(year FROM o_orderdate) = 1997", sarg=1, wild=1, psarg=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM orders WHERE DATE(o_orderdate) = '1996-01-15'", sarg=1, wild=1, psarg=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM orders WHERE MONTH(o_orderdate) = 1", sarg=1, wild=1, psarg=1, score=25, level="MEDIUM"),
    Template("SELECT * FROM part WHERE p_brand = UPPER('brand#S')", wild=1),
    Template("SELECT * FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-12-31'", wild=1),
    Template("WITH x AS (SELECT * FROM part) SELECT * FROM x", star=1, wild=2, tables=2),
    Template("SELECT * FROM (SELECT * FROM part) s", star=1, wild=2, depth=1),
    Template("WITH x AS (SELECT part.* FROM part) SELECT * FROM x", star=1, wild=2, tables=2),
    Template("SELECT * FROM orders o WHERE o.o_custkey NOT IN (SELECT c.c_custkey FROM customer c)", notin=1, wild=1, tables=2, depth=1),
    Template("SELECT * FROM orders o WHERE o.o_orderkey NOT IN (1, 2, #S)", wild=1),
    Template("WITH x AS (SELECT * FROM part ORDER BY p_size) SELECT * FROM x", sort=1, star=1, wild=2, score=20, tables=2),
    Template("WITH x AS (SELECT * FROM part ORDER BY p_size LIMIT #S) SELECT * FROM x", star=1, wild=2, tables=2),
    Template("SELECT ROW_NUMBER() OVER (ORDER BY p_size) AS rn FROM part"),
    Template("SELECT * FROM orders a JOIN customer b ON CAST(a.o_custkey AS INT) = b.c_custkey", cast=1, wild=1, tables=2),
    Template("SELECT * FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey WHERE CAST(a.o_totalprice AS INT) > #S", wild=1, tables=2),
    Template("SELECT * FROM part WHERE p_name LIKE '%steel#S'", like=1, wild=1),
    Template("SELECT * FROM part WHERE p_name LIKE 'steel%'", wild=1),
    Template(
        "WITH a AS (\n  SELECT * FROM orders ORDER BY o_orderdate\n)\nSELECT x.k\nFROM (\n  SELECT a.o_custkey AS k FROM a, customer c\n"
        "  WHERE YEAR(a.o_orderdate) = 1996\n    AND LOWER(c.c_name) = 'n#S'\n    AND a.o_custkey NOT IN (SELECT s_suppkey FROM supplier)\n) x",
        cart=1, sarg=2, notin=1, sort=1, star=1, wild=1, pcart=1, psarg=1, score=100, level="CRITICAL", complexity="O(N*M)", tables=4, depth=2,
    ),
    Template("SELECT p_name FROM part WHERE p_size = #S; SELECT n_name FROM nation;", tables=2, statements=2),
    Template("SELECT FROM part WHERE p_size = #S", parser=1, tables=0),
    Template("SELECT (p_size + #S FROM part", parser=1, tables=0),
    Template("SELECT 'open string FROM part", parser=1, tables=0),
    Template("SELECT ';', \"a;b\" FROM part -- tail ; here\nWHERE p_size /* ; */ = #S"),
    Template("SELECT count(*) FROM lineitem l LEFT JOIN part p ON l.l_partkey::int = p.p_partkey", cast=1, tables=2),
    Template("SELECT a.* FROM orders a WHERE EXISTS (SELECT * FROM lineitem b WHERE b.l_orderkey = a.o_orderkey)", wild=2, tables=2),
    Template("SELECT p_size * 2 AS d FROM part WHERE p_retailprice > 10 * #S AND ABS(p_size) < 5", sarg=1, score=25, level="MEDIUM"),
    Template("SELECT n_name FROM nation, LATERAL (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) r", tables=2, depth=1),
    Template("SELECT a FROM (SELECT b FROM (SELECT c FROM (SELECT p_size AS c FROM part) t3) t2) t1", depth=3, score=10),
    Template("SELECT o_orderkey FROM orders WHERE o_totalprice IS DISTINCT FROM #S ORDER BY o_orderkey"),
    Template("(SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier ORDER BY 1)", tables=2, depth=1),
    Template("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > #S ORDER BY n LIMIT 5"),
]

# --- fixed values: columns read by each template, by the table they stand for; a bare column counts to the statement's first table ---
COLUMNS = {
    1: ["part.p_name,p_size"], 3: ["orders.o_custkey"], 4: ["orders.o_orderkey", "lineitem.l_orderkey"], 6: ["orders.o_custkey", "customer.c_custkey"],
    9: ["orders.o_orderdate"], 10: ["part.p_brand"], 11: ["part.p_size"], 12: ["orders.o_orderdate"], 13: ["orders.o_orderdate"], 14: ["orders.o_orderdate"],
    15: ["part.p_brand"], 16: ["orders.o_orderdate"], 20: ["orders.o_custkey", "customer.c_custkey"], 21: ["orders.o_orderkey"], 22: ["part.p_size"], 23: ["part.p_size"],
    24: ["part.p_size"], 25: ["orders.o_custkey", "customer.c_custkey"], 26: ["orders.o_custkey,o_totalprice", "customer.c_custkey"], 27: ["part.p_name"], 28: ["part.p_name"],
    29: ["a.o_custkey,o_orderdate", "customer.c_name", "orders.o_orderdate,s_suppkey"], 30: ["part.p_name,p_size", "nation.n_name"], 34: ["part.a;b,p_size"],
    35: ["lineitem.l_partkey", "part.p_partkey"], 36: ["orders.o_orderkey", "lineitem.l_orderkey"], 37: ["part.p_size,p_retailprice"],
    38: ["nation.n_name,n_regionkey,r_name,r_regionkey"], 39: ["part.a,b,c,p_size"], 40: ["orders.o_orderkey,o_totalprice"], 41: ["part.p_partkey,s_suppkey"],
    42: ["orders.o_orderstatus,n"],
}


# --- fixed values: what each template reads and does, by its place in the list
LINEAGE = {
    1: "part", 2: "nation region:CROSS JOIN!", 3: "orders customer:INNER JOIN!", 4: "orders lineitem:INNER JOIN!", 5: "part supplier:INNER JOIN! nation:INNER JOIN!",
    6: "orders customer:INNER JOIN", 7: "nation region:INNER JOIN!", 8: "nation region:INNER JOIN!", 9: "orders", 10: "part", 11: "part", 12: "orders", 13: "orders",
    14: "orders", 15: "part", 16: "orders", 17: "part x", 18: "part", 19: "part x", 20: "orders customer", 21: "orders", 22: "part x", 23: "part x", 24: "part",
    25: "orders customer:INNER JOIN", 26: "orders customer:INNER JOIN", 27: "part", 28: "part", 29: "orders a customer:INNER JOIN! supplier", 30: "part nation", 34: "part",
    35: "lineitem part:LEFT JOIN", 36: "orders lineitem", 37: "part", 38: "nation region", 39: "part", 40: "orders", 41: "part supplier", 42: "orders",
}
STAGES = {
    0: "SELECT", 2: "FROM,JOIN,SELECT", 3: "FROM,JOIN,WHERE,SELECT", 4: "FROM,JOIN,WHERE,SELECT", 5: "FROM,JOIN,SELECT", 6: "FROM,JOIN,SELECT", 7: "FROM,JOIN,SELECT",
    8: "FROM,JOIN,SELECT", 17: "FROM,SELECT", 18: "FROM,SELECT", 19: "FROM,SELECT", 22: "FROM,SELECT", 23: "FROM,SELECT", 24: "FROM,SELECT", 25: "FROM,JOIN,SELECT",
    26: "FROM,JOIN,WHERE,SELECT", 29: "FROM,SELECT", 30: "FROM,WHERE,SELECT;FROM,SELECT", 31: "", 32: "", 33: "", 35: "FROM,JOIN,SELECT", 38: "FROM,JOIN,SELECT",
    39: "FROM,SELECT", 40: "FROM,WHERE,SELECT,ORDER BY", 41: "", 42: "FROM,GROUP BY,HAVING,SELECT,ORDER BY,LIMIT",
}
STAGES_DEFAULT = "FROM,WHERE,SELECT"
FILTERS = {i: 1 for i in (1, 3, 4, 9, 10, 11, 12, 13, 14, 15, 16, 20, 21, 26, 27, 28, 29, 30, 34, 37, 38, 40)} | {36: 2}
JOINS = {i: 1 for i in (2, 3, 4, 6, 7, 8, 25, 26, 29, 35, 38)} | {5: 2}
PROJECTIONS = {17: 2, 18: 2, 19: 2, 20: 2, 22: 2, 23: 2, 29: 4, 30: 2, 31: 0, 32: 0, 33: 0, 36: 2, 38: 2, 39: 4, 41: 2}
SORTED = [22, 23, 24, 29, 40, 41, 42]
MISSING = {
    17: ["x"], 19: ["x"], 22: ["x"], 23: ["x"], 29: ["a", "orders.s_suppkey"], 34: ["part.a;b"], 38: ["nation.r_name", "nation.r_regionkey"],
    39: ["part.a", "part.b", "part.c"], 41: ["part.s_suppkey"], 42: ["orders.n"],
}

COUNTS = {
    "SQL-CART-001": "cart", "SQL-SARG-001": "sarg", "SQL-NOTIN-001": "notin", "SQL-SORT-001": "sort",
    "SQL-STAR-001": "star", "SQL-CAST-001": "cast", "SQL-LIKE-001": "like", "PARSER-001": "parser",
}
PRO_COUNTS = {"SQL-WILD-001": "wild", "SQL-CART-001": "pcart", "SQL-SARG-001": "psarg"}
DIALECT_CYCLE = ["duckdb", "postgres", "snowflake"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scripts`` for every part row."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    texts = F.array(*[F.lit(t.sql) for t in TEMPLATES])
    pick = (F.col("p_partkey") % len(TEMPLATES)).cast("int") + 1
    body = F.replace(F.element_at(texts, pick), F.lit("#S"), F.col("p_size").cast("string"))
    dialects = F.array(*[F.lit(d) for d in DIALECT_CYCLE])
    return part.select(
        F.col("p_partkey").alias("script_id"),
        F.concat(F.lit("models/m"), F.col("p_partkey"), F.lit(".sql")).alias("path"),
        F.element_at(dialects, (F.col("p_partkey") % len(DIALECT_CYCLE)).cast("int") + 1).alias("dialect"),
        F.concat(body, F.lit("\n-- part "), F.col("p_partkey").cast("string")).alias("sql"),
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def corpus_sql() -> str:
    """DuckDB text of the same scripts, as CTEs ``templates`` and ``scripts``."""
    fields = ["cart", "sarg", "notin", "sort", "star", "cast", "like", "parser", "wild", "pcart", "psarg", "score", "level", "complexity", "tables", "statements", "depth"]
    rows = []
    for i, t in enumerate(TEMPLATES):
        values = [sql_text(v) if isinstance(v, str) else str(v) for v in (getattr(t, f) for f in fields)]
        rows.append(f"({i}, {sql_text(t.sql)}, {', '.join(values)})")
    names = ", ".join(f"x_{f}" for f in fields)
    dialects = "[" + ", ".join(sql_text(d) for d in DIALECT_CYCLE) + "]"
    return (
        f"templates(t, body, {names}) AS (VALUES {', '.join(rows)}), "
        f"scripts AS (SELECT p_partkey AS script_id, 'models/m' || p_partkey || '.sql' AS path, "
        f"{dialects}[p_partkey % {len(DIALECT_CYCLE)} + 1] AS dialect, "
        f"replace(body, '#S', CAST(p_size AS VARCHAR)) || chr(10) || '-- part ' || p_partkey AS sql, "
        f"templates.* FROM part JOIN templates ON t = p_partkey % {len(TEMPLATES)})"
    )
