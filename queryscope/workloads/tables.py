"""Queries over the plain tables: running SQL, profiling, remedies and stages."""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope.operators import compare, gramindex
from queryscope.operators import profile as P
from queryscope.operators import query as Q
from queryscope.operators import remedies as R
from queryscope.operators import searchcopy
from queryscope.operators import stages as S
from queryscope.session import shared_folder
from queryscope.workloads.registry import query, table

_STAR = """
SELECT n_name, o_orderpriority, count(*) AS n_lines,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1996-01-01'
GROUP BY n_name, o_orderpriority
"""


def _views(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


@query("run_sql_star_join", _STAR)
def run_sql_star_join(spark, sf_dir):
    _views(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    return Q.run_sql(spark, _STAR)


@query("bind_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000.0 AND o_orderstatus = 'F'")
def bind_params(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    text = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = {{ status }}"
    return Q.bind_params(spark, text, {"low": 150000.0, "status": "F"})


_NULL_ORDERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders"


def _null_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_custkey"))
    return o.select("o_orderkey", key.cast("long").alias("o_custkey"), "o_totalprice")


@query("grid_sort", f"SELECT * FROM ({_NULL_ORDERS}) ORDER BY o_custkey ASC NULLS LAST, o_orderkey")
def grid_sort(spark, sf_dir):
    return Q.grid_sort(_null_orders(spark, sf_dir), "o_custkey", True, key="o_orderkey")


@query("grid_sort_desc_page", f"SELECT * FROM ({_NULL_ORDERS}) ORDER BY o_custkey DESC NULLS FIRST, o_orderkey LIMIT 200")
def grid_sort_desc_page(spark, sf_dir):
    return Q.grid_sort(_null_orders(spark, sf_dir), "o_custkey", False, key="o_orderkey").limit(200)


@query("normalize_columns", "SELECT s_suppkey AS col1, s_name AS col2, s_nationkey AS col3, s_acctbal AS col4 FROM supplier")
def normalize_columns(spark, sf_dir):
    return Q.normalize_columns(table(spark, sf_dir, "supplier"))


@query(
    "chart_series",
    "SELECT o_orderstatus AS label, v AS value, round(v * 100 / sum(v) OVER (), 6) AS share FROM "
    "(SELECT o_orderstatus, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)",
)
def chart_series(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return Q.chart_series(totals).withColumn("share", F.round("share", 6))


# --- profiling ------------------------------------------------------------------------

def _profile_sql(cols):
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) AS \"count\", CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) AS \"unique\", '{t}' AS type FROM {src}"
        for c, t, src in cols
    ]
    return " UNION ALL ".join(parts)


_ORDER_COLS = [
    ("o_orderkey", "number", "orders"), ("o_custkey", "number", "orders"), ("o_orderstatus", "text", "orders"),
    ("o_totalprice", "number", "orders"), ("o_orderdate", "text", "orders"), ("o_orderpriority", "text", "orders"),
]


@query("profile_columns", _profile_sql(_ORDER_COLS))
def profile_columns(spark, sf_dir):
    return P.profile_columns(table(spark, sf_dir, "orders"))


@query(
    "profile_columns_with_nulls",
    _profile_sql([(c, "number", f"({_NULL_ORDERS})") for c in ("o_orderkey", "o_custkey", "o_totalprice")]),
)
def profile_columns_with_nulls(spark, sf_dir):
    return P.profile_columns(_null_orders(spark, sf_dir))


@query(
    "uniqueness_tier",
    'SELECT *, round(CASE WHEN "count" > 0 THEN "unique" / "count" ELSE 0 END, 6) AS ratio, '
    "CASE WHEN \"unique\" / \"count\" >= 0.5 THEN 'high' WHEN \"unique\" / \"count\" >= 0.15 THEN 'medium' ELSE 'low' END AS tier "
    f"FROM ({_profile_sql(_ORDER_COLS)})",
)
def uniqueness_tier(spark, sf_dir):
    return P.uniqueness_tier(P.profile_columns(table(spark, sf_dir, "orders"))).withColumn("ratio", F.round("ratio", 6))


@query(
    "numeric_histogram",
    """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
s AS (SELECT lo, CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS span FROM b),
c AS (SELECT least(7, CAST(floor((o_totalprice - lo) / span * 8) AS INTEGER)) AS bucket, count(*) AS n FROM orders, s GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bucket,
       printf('%.1f', lo + span * r.i / 8) || '-' || printf('%.1f', lo + span * (r.i + 1) / 8) AS label,
       coalesce(n, 0) AS "count"
FROM range(8) r(i) JOIN s ON true LEFT JOIN c ON c.bucket = r.i
""",
)
def numeric_histogram(spark, sf_dir):
    return P.numeric_histogram(table(spark, sf_dir, "orders"), "o_totalprice", 8)


@query(
    "fixed_width_bucket",
    "SELECT CASE WHEN v IS NULL THEN 'other' ELSE '[' || CAST(floor(v / 10) * 10 AS BIGINT) || ', ' || CAST(floor(v / 10) * 10 + 10 AS BIGINT) || ')' END AS bucket, "
    "count(*) AS n FROM (SELECT TRY_CAST(CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS v FROM part) GROUP BY 1",
)
def fixed_width_bucket(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 9 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").groupBy(P.fixed_width_bucket(raw, 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_letter_histogram",
    "SELECT CASE WHEN p_name = '' THEN '(blank)' ELSE upper(substr(p_name, 1, 1)) || '-group' END AS label, count(*) AS \"count\" "
    "FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4",
)
def first_letter_histogram(spark, sf_dir):
    return P.first_letter_histogram(table(spark, sf_dir, "part"), "p_name", 4)


# --- remedies --------------------------------------------------------------------------

@query("filter_year", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1996")
def filter_year(spark, sf_dir):
    return R.filter_year(table(spark, sf_dir, "orders"), "o_orderdate", 1996).select("o_orderkey", "o_orderdate")


@query("filter_date", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1997-03-14'")
def filter_date(spark, sf_dir):
    return R.filter_date(table(spark, sf_dir, "lineitem"), "l_shipdate", "1997-03-14").select("l_orderkey", "l_linenumber")


def _anti_sides(spark, sf_dir):
    buyers = _null_orders(spark, sf_dir).filter("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    people = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_custkey")).cast("long").alias("ck"), "c_name"
    )
    return people, buyers


_PEOPLE = "SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS ck, c_name FROM customer"
_BUYERS = f"SELECT o_custkey AS k FROM ({_NULL_ORDERS}) WHERE o_totalprice > 250000"


@query("anti_join_exists", f"SELECT * FROM ({_PEOPLE}) p WHERE NOT EXISTS (SELECT 1 FROM ({_BUYERS}) b WHERE b.k = p.ck)")
def anti_join_exists(spark, sf_dir):
    people, buyers = _anti_sides(spark, sf_dir)
    return R.anti_join(people, buyers, [("ck", "k")], nulls="exists")


@query("anti_join_not_in_nulls", f"SELECT count(*) AS n, count(ck) AS known FROM ({_PEOPLE}) WHERE ck NOT IN (SELECT k FROM ({_BUYERS}))")
def anti_join_not_in_nulls(spark, sf_dir):
    people, buyers = _anti_sides(spark, sf_dir)
    kept = R.anti_join(people, buyers, [("ck", "k")], nulls="not_in")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count("ck").alias("known"))


@query("anti_join_not_in", f"SELECT * FROM ({_PEOPLE}) WHERE ck NOT IN (SELECT k FROM ({_BUYERS}) WHERE k IS NOT NULL)")
def anti_join_not_in(spark, sf_dir):
    people, buyers = _anti_sides(spark, sf_dir)
    return R.anti_join(people, buyers.filter("k is not null"), [("ck", "k")], nulls="not_in")


@query("anti_join_not_in_empty", f"SELECT * FROM ({_PEOPLE}) WHERE ck NOT IN (SELECT k FROM ({_BUYERS}) WHERE k < 0)")
def anti_join_not_in_empty(spark, sf_dir):
    people, buyers = _anti_sides(spark, sf_dir)
    return R.anti_join(people, buyers.filter("k < 0"), [("ck", "k")], nulls="not_in")


@query("block_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def block_top_n(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.block(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query("block_unbounded", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def block_unbounded(spark, sf_dir):
    rows = R.block(table(spark, sf_dir, "orders"), [F.desc("o_totalprice")])
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "verify_equivalence",
    "WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0) "
    "SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, "
    "(SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b, "
    "NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AS equal",
)
def verify_equivalence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select("o_custkey", "o_orderstatus")
    return R.verify_equivalence(a, o.filter("o_orderkey % 13 <> 0").select("o_custkey", "o_orderstatus"))


@query(
    "verify_equivalence_ordered",
    "WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_quantity AS q FROM lineitem), "
    "b AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_quantity + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS q FROM lineitem) "
    "SELECT count(*) AS only_a, count(*) AS only_b, count(*) = 0 AS equal FROM a JOIN b USING (pos) WHERE a.q IS DISTINCT FROM b.q",
)
def verify_equivalence_ordered(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = li.select("pos", F.col("l_quantity").alias("q"))
    b = li.select("pos", (F.col("l_quantity") + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)).alias("q"))
    return R.verify_equivalence(a, b, position="pos")


_FANOUT_KEYS = (
    "l AS (SELECT l_suppkey AS key, count(*) AS nl FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1), "
    "r AS (SELECT c_nationkey AS key, count(*) AS nr FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1)"
)


@query(
    "join_fanout",
    f"WITH {_FANOUT_KEYS} SELECT (SELECT count(*) FROM lineitem) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, "
    "CAST((SELECT count(*) FROM lineitem) * (SELECT count(*) FROM customer) AS BIGINT) AS pair_rows, "
    "CAST(coalesce(sum(nl * nr), 0) AS BIGINT) AS output_rows, CAST(coalesce(max(nl * nr), 0) AS BIGINT) AS largest_product, "
    "sum(nl * nr) / ((SELECT count(*) FROM lineitem) * (SELECT count(*) FROM customer)) > 0.01 OR max(nl * nr) > 1000000 AS flagged "
    "FROM l JOIN r USING (key)",
)
def join_fanout(spark, sf_dir):
    return R.join_fanout(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer"), "l_suppkey", "c_nationkey")


@query(
    "skew_keys",
    f"WITH {_FANOUT_KEYS} SELECT key, nl AS n_left, nr AS n_right, CAST(nl * nr AS BIGINT) AS product FROM l JOIN r USING (key) ORDER BY product DESC, key LIMIT 10",
)
def skew_keys(spark, sf_dir):
    return R.skew_keys(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer"), "l_suppkey", "c_nationkey", 10)


@query(
    "aligned_join",
    "SELECT o_orderstatus, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM orders JOIN customer "
    "ON CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) = c_custkey GROUP BY 1",
)
def aligned_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cust_text", F.col("o_custkey").cast("string"))
    joined = R.aligned_join(o, table(spark, sf_dir, "customer"), "cust_text", "c_custkey")
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("suffix_search", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%3' OR c_name LIKE '%77'")
def suffix_search(spark, sf_dir):
    return R.suffix_search(table(spark, sf_dir, "customer"), "c_name", ["3", "77"]).select("c_custkey", "c_name")


@query(
    "suffix_join",
    "SELECT c_custkey, s.suffix FROM customer JOIN (SELECT DISTINCT CAST(s_suppkey % 100 AS VARCHAR) AS suffix FROM supplier) s ON c_name LIKE '%' || s.suffix",
)
def suffix_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).cast("string").alias("suffix"))
    return R.suffix_join(table(spark, sf_dir, "customer"), "c_name", s).select("c_custkey", "suffix")


def _edited_orders(spark, sf_dir):
    """Orders with some prices changed, some rows left out and some repeated."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey") % 100
    changed = o.filter(k != 8).withColumn("o_totalprice", F.when(k == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return o, changed.unionByName(o.filter(k == 9))


@query(
    "differing_rows",
    "WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), "
    "b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM a WHERE o_orderkey % 100 <> 8 "
    "UNION ALL SELECT * FROM a WHERE o_orderkey % 100 = 9) "
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, sum(x) AS n_a, sum(y) AS n_b FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2, 3, 4 HAVING sum(x) <> sum(y)",
)
def differing_rows(spark, sf_dir):
    return compare.differing_rows(*_edited_orders(spark, sf_dir))


@query("suffix_search_stored", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%3' OR c_name LIKE '%77'")
def suffix_search_stored(spark, sf_dir):
    path = shared_folder(spark, "reversed")
    searchcopy.write_copy(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "reversed", path)
    return searchcopy.ends_with(spark, path, "c_name", ["3", "77"])


@query("normalized_equals_stored", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def normalized_equals_stored(spark, sf_dir):
    path = shared_folder(spark, "lowered")
    searchcopy.write_copy(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "lower", path)
    return searchcopy.equals(spark, path, "c_mktsegment", "lower", "Building")


_INDEXES: dict[tuple[str, str], str] = {}


def gram_index(spark, sf_dir):
    """The index of all documents, built once per session and folder."""
    made = spark.sparkContext.applicationId, sf_dir
    if made not in _INDEXES:
        path = shared_folder(spark, "grams")
        gramindex.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
        _INDEXES[made] = path
    return _INDEXES[made]


@query("trigram_search", "SELECT doc_id, n_chars FROM documents WHERE text LIKE '%ation%'")
def trigram_search(spark, sf_dir):
    return R.trigram_search(table(spark, sf_dir, "documents"), "doc_id", "text", "ation", gram_index(spark, sf_dir)).select("doc_id", "n_chars")


@query("normalized_equals", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def normalized_equals(spark, sf_dir):
    return R.normalized_equals(table(spark, sf_dir, "customer"), "c_mktsegment", "Building").select("c_custkey", "c_mktsegment")


@query("shift_literal", "SELECT p_partkey, p_size FROM part WHERE p_size + 5 > 30")
def shift_literal(spark, sf_dir):
    return R.shift_literal(table(spark, sf_dir, "part"), "p_size", ">", 5, 30).select("p_partkey", "p_size")


# --- stages ---------------------------------------------------------------------------------

@query(
    "stage_match",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' "
    "AND o_totalprice >= 1000 AND o_totalprice < 200000 AND o_custkey IS NOT NULL",
)
def stage_match(spark, sf_dir):
    stages = [
        {"$match": {"o_orderstatus": "O", "o_orderpriority": {"$ne": "1-URGENT"}, "o_totalprice": {"$gte": 1000, "$lt": 200000}, "o_custkey": {"$exists": True}}},
        {"$project": {"o_orderkey": 1, "o_totalprice": 1}},
    ]
    return S.run_stages(table(spark, sf_dir, "orders"), stages)


@query(
    "stage_group",
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS \"count\", round(sum(l_quantity), 2) AS sum_qty, "
    "round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS min_tax, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2",
)
def stage_group(spark, sf_dir):
    stages = [
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "count": {"$sum": 1}, "sum_qty": {"$sum": "$l_quantity"},
                    "avg_disc": {"$avg": "$l_discount"}, "min_tax": {"$min": "$l_tax"}, "max_price": {"$max": "$l_extendedprice"}}},
        {"$project": {"flag": "$_id.flag", "status": "$_id.status", "count": 1, "sum_qty": 1, "avg_disc": 1, "min_tax": 1, "max_price": 1}},
    ]
    out = S.run_stages(table(spark, sf_dir, "lineitem"), stages)
    return out.withColumn("sum_qty", F.round("sum_qty", 2)).withColumn("avg_disc", F.round("avg_disc", 6))


@query("stage_group_global", f"SELECT count(*) AS \"count\", max(o_totalprice) AS top FROM ({_NULL_ORDERS})")
def stage_group_global(spark, sf_dir):
    return S.run_stages(_null_orders(spark, sf_dir), [{"$group": {"_id": None, "count": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}])


@query("stage_sort_limit", f"SELECT o_custkey, o_orderkey FROM ({_NULL_ORDERS}) ORDER BY o_custkey ASC NULLS FIRST, o_orderkey DESC NULLS LAST LIMIT 75")
def stage_sort_limit(spark, sf_dir):
    stages = [{"$project": {"o_custkey": 1, "o_orderkey": 1}}, {"$sort": {"o_custkey": 1, "o_orderkey": -1}}, {"$limit": 75}]
    return S.run_stages(_null_orders(spark, sf_dir), stages)
