"""Queries over billing events, support texts, vectors and content hashes."""
from __future__ import annotations

from pyspark.sql import functions as F

from queryscope import lookups as L
from queryscope.operators import billing as B
from queryscope.operators import integrity as N
from queryscope.operators import similarity as M
from queryscope.operators import support as S
from queryscope.operators import vectors
from queryscope.workloads.registry import query, table

_KINDS = ["invoice.paid", "customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted", "customer.created", "charge.failed"]
_KINDS_SQL = "[" + ",".join(f"'{k}'" for k in _KINDS) + "]"


def billing_payloads(spark, sf_dir):
    """Orders as billing events; their line items are the lines, in line order."""
    li = table(spark, sf_dir, "lineitem")
    plan = F.when(F.col("l_returnflag") == "A", "team").when(F.col("l_returnflag") == "N", "pro")
    seats = F.when(F.col("l_quantity") % 5 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string"))
    meta = F.struct(F.struct(F.struct(plan.alias("plan"), seats.alias("seats")).alias("metadata")).alias("price"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", meta.alias("line")))).alias("x"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 6).cast("int") + 1)
    data = F.transform("x", lambda v: v["line"])
    sub = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"id":"sub_'), "o_orderkey", F.lit('"}'))).otherwise(F.concat(F.lit('"sub_'), "o_orderkey", F.lit('"')))
    body = F.concat(
        F.lit('{"type":"'), kind, F.lit('","data":{"object":{"customer":"c'), F.col("o_custkey"), F.lit('","subscription":'), sub,
        F.lit(',"lines":{"data":'), F.coalesce(F.to_json(data), F.lit("[]")), F.lit('},"items":{"data":'), F.coalesce(F.to_json(data), F.lit("[]")), F.lit("}}}}"),
    )
    return o.select("o_orderkey", body.alias("payload"))


_LINES = (
    "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, "
    "CASE l_returnflag WHEN 'A' THEN 'team' WHEN 'N' THEN 'pro' END AS plan, "
    "CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS seats FROM lineitem)"
)


@query(
    "billing_events",
    f"WITH p AS (SELECT l_orderkey, arg_min(plan, n) FILTER (WHERE plan IS NOT NULL) AS p1, arg_max(plan, n) FILTER (WHERE plan IS NOT NULL) AS p2, "
    f"arg_min(seats, n) FILTER (WHERE seats IS NOT NULL) AS s1, arg_max(seats, n) FILTER (WHERE seats IS NOT NULL) AS s2 FROM {_LINES} GROUP BY 1) "
    f"SELECT o_orderkey, {_KINDS_SQL}[o_orderkey % 6 + 1] AS event_type, "
    "['provisioned', 'provisioned', 'updated', 'revoked', 'customer_registered', 'ignored'][o_orderkey % 6 + 1] AS status, o_orderkey % 6 < 2 AS provisioned, "
    "CASE o_orderkey % 6 WHEN 0 THEN coalesce(p1, 'enterprise') WHEN 1 THEN coalesce(p2, 'enterprise') END AS plan, "
    "CASE o_orderkey % 6 WHEN 0 THEN coalesce(s1, 1) WHEN 1 THEN coalesce(s2, 1) END AS seats, "
    "CASE WHEN o_orderkey % 6 < 2 THEN 'c' || o_custkey END AS customer_id, CASE WHEN o_orderkey % 6 = 0 THEN 'sub_' || o_orderkey END AS subscription_id "
    "FROM orders LEFT JOIN p ON o_orderkey = l_orderkey",
)
def billing_events(spark, sf_dir):
    return B.billing_events(billing_payloads(spark, sf_dir)).drop("payload")


@query("event_status", f"SELECT {_KINDS_SQL}[o_orderkey % 6 + 1] AS event_type, ['provisioned', 'provisioned', 'updated', 'revoked', 'customer_registered', 'ignored'][o_orderkey % 6 + 1] AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def event_status(spark, sf_dir):
    out = B.billing_events(billing_payloads(spark, sf_dir))
    return out.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


def second_payloads(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    addon = F.struct(F.when(F.col("l_returnflag") == "R", "storage").otherwise("seats").alias("addon_id"), F.col("l_quantity").cast("int").alias("quantity"))
    addons = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(addon)).alias("addons"))
    o = table(spark, sf_dir, "orders").join(addons, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = F.element_at(F.array(F.lit("invoice_generated"), F.lit("subscription_created"), F.lit("payment_failed")), (F.col("o_orderkey") % 3).cast("int") + 1)
    customer = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"id":"c'), "o_custkey", F.lit('"}'))).otherwise("{}")
    plan = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit('"plan_id":"'), F.lower("o_orderstatus"), F.lit('",')))
    body = F.concat(
        F.lit('{"event_type":"'), kind, F.lit('","content":{"customer":'), customer, F.lit(',"subscription":{"customer_id":"s'), F.col("o_custkey"), F.lit('",'),
        plan, F.lit('"addons":'), F.coalesce("addons", F.lit("[]")), F.lit("}}}"),
    )
    return o.select("o_orderkey", body.alias("payload"))


@query(
    "second_provider_events",
    "WITH a AS (SELECT l_orderkey, max(CAST(l_quantity AS INTEGER)) FILTER (WHERE l_returnflag <> 'R') AS s FROM lineitem GROUP BY 1) "
    "SELECT o_orderkey, ['invoice_generated', 'subscription_created', 'payment_failed'][o_orderkey % 3 + 1] AS event_type, "
    "CASE WHEN o_orderkey % 3 < 2 THEN 'provisioned' ELSE 'ignored' END AS status, "
    "CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'enterprise' ELSE lower(o_orderstatus) END END AS plan, "
    "CASE WHEN o_orderkey % 3 < 2 THEN greatest(1, coalesce(s, 1)) END AS seats, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'c' ELSE 's' END || o_custkey AS customer_id FROM orders LEFT JOIN a ON o_orderkey = l_orderkey",
)
def second_provider_events(spark, sf_dir):
    return B.second_provider_events(second_payloads(spark, sf_dir)).drop("payload")


@query(
    "checkout_completed",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '@x.org' WHEN c_custkey % 5 = 0 THEN '' ELSE 'd' || c_custkey || '@y.org' END AS customer_email, "
    "CASE WHEN c_nationkey % 3 = 0 THEN 'pro' ELSE 'team' END AS plan, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE c_nationkey END AS seats "
    "FROM customer WHERE c_custkey % 3 <> 0",
)
def checkout_completed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    email = F.when(key % 2 == 0, F.concat(F.lit('"customer_email":"a'), key, F.lit('@x.org",'))).when(key % 5 == 0, "").otherwise(
        F.concat(F.lit('"customer_email":"","customer_details":{"email":"d'), key, F.lit('@y.org"},'))
    )
    plan = F.when(nat % 3 == 0, "").otherwise('"plan":"team",')
    seats = F.when(nat % 4 == 0, "several").otherwise(nat.cast("string"))
    kind = F.when(key % 3 == 0, "checkout.session.expired").otherwise("checkout.session.completed")
    body = F.concat(F.lit('{"type":"'), kind, F.lit('","data":{"object":{'), email, F.lit('"metadata":{'), plan, F.lit('"seats":"'), seats, F.lit('"}}}}'))
    return B.checkout_completed(c.select("c_custkey", body.alias("payload"))).drop("payload")


@query(
    "license_state",
    "SELECT c_custkey, tier, expires_at, expires_at > 0 AND 1700000000 > expires_at AS expired, c_custkey % 7 <> 0 AND seats >= 1 AND NOT (expires_at > 0 AND 1700000000 > expires_at) AS valid FROM "
    "(SELECT c_custkey, c_nationkey % 3 AS seats, ['enterprise', 'team', 'pro', 'trial'][c_nationkey % 4 + 1] AS plan, [3, 2, 1, 0][c_nationkey % 4 + 1] AS tier, "
    "1690000000 + c_custkey * 1000 + (c_nationkey * 10) * 86400 AS expires_at FROM customer)",
)
def license_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    plans = F.array(*[F.lit(p) for p in ("enterprise", "team", "pro", "trial")])
    rows = c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("customer_id"),
        F.element_at(plans, (F.col("c_nationkey") % 4).cast("int") + 1).alias("plan"),
        (F.col("c_nationkey") % 3).alias("seats"),
        (F.lit(1690000000) + F.col("c_custkey") * 1000).alias("issued_at"),
        (F.col("c_nationkey") * 10).alias("duration_days"),
    )
    return B.license_state(rows, 1700000000).select("c_custkey", "tier", "expires_at", "expired", "valid")


@query(
    "provision_seats",
    "SELECT c_custkey, ok AS success, CASE WHEN ok THEN CASE WHEN c_custkey % 6 = 0 THEN '***' ELSE 'C***@x.org' END END AS email_masked, "
    "CASE WHEN ok THEN r END AS role, CASE WHEN ok THEN 'pending' ELSE 'rejected' END AS status FROM "
    "(SELECT c_custkey, upper(['admin', 'Developer', 'BILLING', 'owner'][c_custkey % 4 + 1]) AS r, c_custkey % 4 <> 3 AS ok FROM customer)",
)
def provision_seats(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    roles = F.array(*[F.lit(r) for r in ("admin", "Developer", "BILLING", "owner")])
    email = F.when(F.col("c_custkey") % 6 == 0, "no-at-sign").otherwise(F.concat("c_name", F.lit("@x.org")))
    return B.provision_seats(c.select("c_custkey", email.alias("email"), F.element_at(roles, (F.col("c_custkey") % 4).cast("int") + 1).alias("role")))


# --- support texts ---------------------------------------------------------------------

_LINES_OF = "string_split(text, chr(10))"


@query(
    "redact_steps",
    f"SELECT conv_id, turn, list_transform(list_slice(s, greatest(1, len(s) - 19), len(s)), lambda x: CASE WHEN regexp_matches(x, '(?i)select|insert|drop|sql=') THEN '(redacted)' ELSE substr(x, 1, 200) END) AS steps, "
    f"substr(text, 1, 500) AS message FROM (SELECT conv_id, turn, text, {_LINES_OF} AS s FROM conversations)",
)
def redact_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.redact_steps(F.split("text", "\n", -1)).alias("steps"), S.short_message(F.col("text")).alias("message"))


@query(
    "crash_rows",
    "SELECT doc_id, CASE WHEN t = '' THEN '<no trace>' ELSE substr(t, greatest(1, length(t) - 399), 400) END AS tail FROM "
    "(SELECT doc_id, regexp_replace(CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS t FROM documents)",
)
def crash_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    trace = F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text"))
    return d.select("doc_id", S.crash_tail(trace).alias("tail"))


@query("primitive_only", "SELECT event_id, 'k:' || json_extract_string(props, '$.k') || ',t:' || event_type AS kept FROM events")
def primitive_only(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"t":"'), "event_type", F.lit('","nested":{"a":[1,2]},"list":[1]}'))
    kept = S.primitive_only(body)
    return e.select("event_id", F.array_join(F.transform(F.map_entries(kept), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("kept"))


_PHRASES = [
    "please install with pip", "my license key", "open the gui dashboard", "how to scan from cli", "what is sarg", "about cross join", "the AST parser",
    "explain SQL-LIKE-001", "use order by", "the hot key is ctrl", "is it a cast", "",
]
_PHRASES_SQL = "[" + ",".join(f"'{p}'" for p in _PHRASES) + "]"


def messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    add = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("conv_id") % len(_PHRASES)).cast("int") + 1)
    return c.select("conv_id", "turn", F.concat_ws(" ", "text", add).alias("text"))


def _re2_word(w):
    return f"(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])"


def _re2(pattern):
    return pattern.replace(r"\bast\b", _re2_word("ast")).replace(r"\bnot in\b", _re2_word("not in")).replace(r"\border by\b", _re2_word("order by")).replace(r"\bcast\b", _re2_word("cast")).replace(r"\blike\b", _re2_word("like"))


def _route_sql():
    hits = ", ".join(
        " + ".join(f"CAST(regexp_matches(low, '{_re2_word(w)}') AS INTEGER)" for w in words) + f" AS h{i}" for i, words in enumerate(L.FAQ_KEYWORDS)
    )
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(L.FAQ_KEYWORDS))) + ")"
    topic = "CASE " + " ".join(f"WHEN h{i} = best THEN '{w[0]}'" for i, w in enumerate(L.FAQ_KEYWORDS)) + " END"
    intent = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9])(ast|parsing|parser)($|[^a-z0-9])') THEN 'ast' " + " ".join(
        f"WHEN regexp_matches(low, '{_re2(p)}') THEN '{n}'" for n, p in L.INTENTS
    ) + " END"
    rule = "CASE intent0 " + " ".join(f"WHEN '{i}' THEN '{r}'" for i, r in L.INTENT_RULE.items()) + " END"
    named = "CASE " + " ".join(f"WHEN contains(low, '{r.lower()}') THEN '{r}'" for r in L.INTENT_RULE.values()) + " END"
    return (
        f"WITH m AS (SELECT conv_id, turn, lower(text || ' ' || {_PHRASES_SQL}[conv_id % {len(_PHRASES)} + 1]) AS low FROM conversations), "
        f"h AS (SELECT *, {hits} FROM m), b AS (SELECT *, {best} AS best, {intent} AS intent0, {named} AS named FROM h) "
        f"SELECT conv_id, turn, best AS hits, CASE WHEN best > 0 THEN {topic} WHEN intent0 IS NULL AND named IS NULL THEN 'general' END AS topic, "
        f"CASE WHEN best = 0 THEN intent0 END AS intent, CASE WHEN best = 0 AND intent0 IS NOT NULL THEN {rule} WHEN best = 0 THEN named END AS rule_id FROM b"
    )


@query("route_message", _route_sql())
def route_message(spark, sf_dir):
    return S.route_message(messages(spark, sf_dir)).drop("text")


# --- vectors ------------------------------------------------------------------------------

@query(
    "vector_topk",
    "SELECT query_id, match_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rn FROM "
    "(SELECT a.vec_id AS query_id, b.vec_id AS match_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b) WHERE score >= 0.2) WHERE rn <= 3",
)
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = vectors.vector_topk(e.withColumnRenamed("vec_id", "query_id"), e, k=3, threshold=0.2)
    return out.withColumn("score", F.round("score", 6))


@query(
    "hash_embedding",
    "SELECT doc_id, list_transform(range(64), lambda i: CAST('0x' || substr(sha256(text || ':' || i), 1, 8) AS BIGINT) / 4294967296.0) AS v FROM documents",
)
def hash_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.hash_embedding(F.col("text")).alias("v"))


def _cache_entries(spark, sf_dir, part):
    """Even rows are the cache, odd rows are new; three rows share a hash, so half of the hashes are on both sides more than once."""
    e = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == part)
    return e.select(
        F.sha2(F.floor(F.col("vec_id") / 3).cast("string"), 256).alias("sql_hash"), F.concat(F.lit("out"), "vec_id").alias("output_sql"),
        (F.col("vec_id") * 37 % 211).cast("double").alias("created_at"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"),
    )


@query(
    "upsert",
    "SELECT sql_hash, arg_max(output_sql, (created_at, new)) AS output_sql, max(created_at) AS created_at, substr(sql_hash, 1, 16) AS point_id FROM "
    "(SELECT sha256(CAST(vec_id // 3 AS VARCHAR)) AS sql_hash, 'out' || vec_id AS output_sql, CAST(vec_id * 37 % 211 AS DOUBLE) AS created_at, vec_id % 2 AS new FROM embeddings WHERE vec_id % 9 <> 0) GROUP BY 1",
)
def upsert(spark, sf_dir):
    return M.upsert(_cache_entries(spark, sf_dir, 0), _cache_entries(spark, sf_dir, 1)).drop("embedding")


_BEST = (
    "SELECT a.vec_id AS script_id, arg_max(b.vec_id, (list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), -b.vec_id)) AS match_id, "
    "max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY 1"
)


def _plan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scripts = e.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "script_id")
    return M.refactor_plan(scripts, e.filter("vec_id % 5 <> 0").withColumnRenamed("vec_id", "entry_id"), threshold=0.35)


@query(
    "refactor_plan",
    f"SELECT script_id, CASE WHEN score >= 0.35 THEN match_id END AS match_id, CASE WHEN score >= 0.35 THEN 'vector' ELSE 'queued' END AS engine, score >= 0.35 AS cached, "
    f"CASE WHEN score >= 0.35 THEN round(score, 6) END AS confidence, CASE WHEN score >= 0.35 THEN 0.0 END AS cost FROM ({_BEST})",
)
def refactor_plan(spark, sf_dir):
    return _plan(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(
    "refactor_plan_stats",
    f"SELECT count(*) FILTER (WHERE score >= 0.35) AS cache_hits, count(*) FILTER (WHERE score < 0.35) AS cache_misses, round(avg(CAST(score >= 0.35 AS INTEGER)), 6) AS cache_hit_rate FROM ({_BEST})",
)
def refactor_plan_stats(spark, sf_dir):
    return M.plan_stats(_plan(spark, sf_dir))


def _fuzzy_sql(query, cols):
    ctes, outs = [], []
    for c in cols:
        prev = f"SELECT p_partkey, lower({c}) AS t, 0 AS pa, 0 AS score FROM part"
        for ch in query:
            prev = (
                f"SELECT p_partkey, t, pa + f AS pa, score + f - 1 + CASE WHEN f > 1 THEN 3 ELSE 0 END AS score FROM "
                f"(SELECT *, instr(substr(t, pa + 1), '{ch}') AS f FROM ({prev})) WHERE f > 0"
            )
        outs.append(f"SELECT p_partkey, score FROM ({prev})")
    return f"SELECT p_partkey, CAST(min(score) AS INTEGER) AS score FROM ({' UNION ALL '.join(outs)}) GROUP BY 1"


@query("fuzzy_rank", _fuzzy_sql("rbt", ["p_name", "p_type", "p_brand"]))
def fuzzy_rank(spark, sf_dir):
    return M.fuzzy_rank(table(spark, sf_dir, "part"), " >RBT ", ["p_name", "p_type", "p_brand"]).select("p_partkey", "score")


# --- integrity -------------------------------------------------------------------------------

_CANON = "'{\"p_brand\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || ',\"p_size\":' || coalesce(CAST(s AS VARCHAR), 'null') || '}'"
_SIZED = "(SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS s FROM part)"


def _sized(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")).alias("p_size"))


@query("canonical_hash", f"SELECT p_partkey, sha256({_CANON}) AS row_hash FROM {_SIZED}")
def canonical_hash(spark, sf_dir):
    return N.canonical_hash(_sized(spark, sf_dir), ["p_size", "p_partkey", "p_brand"]).select("p_partkey", "row_hash")


@query("verify_hash", f"SELECT p_partkey, p_partkey % 8 <> 0 AS intact FROM part")
def verify_hash(spark, sf_dir):
    stored = N.canonical_hash(_sized(spark, sf_dir), ["p_size", "p_partkey", "p_brand"])
    tampered = stored.withColumn("p_brand", F.when(F.col("p_partkey") % 8 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")))
    return N.verify_hash(tampered, ["p_brand", "p_partkey", "p_size"], "row_hash").select("p_partkey", "intact")
