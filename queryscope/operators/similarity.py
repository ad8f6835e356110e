"""Hashed embeddings, cache upserts, refactoring plans and fuzzy ranking; vector search is in ``vectors``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.operators.vectors import vector_topk

REFACTOR_THRESHOLD = 0.92


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic vector: v[i] = first 32 bits of sha256(text:i) / 2^32."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0,
    )


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry per hash; entries without an embedding are left out.

    Equal times go to the row from ``new``, between equal rows of one side to the one
    with the larger hash of its columns. The aggregate folds on the map side,
    so a hash written a million times reaches the reducer as one row per task.
    """
    usable = (F.col("embedding").isNotNull()) & (F.size("embedding") > 0)
    cols = cache.columns
    rows = cache.withColumn("__new", F.lit(0)).unionByName(new.select(*cols).withColumn("__new", F.lit(1))).filter(usable)
    best = rows.groupBy("sql_hash").agg(F.max_by(F.struct(*[c for c in cols if c != "sql_hash"]), F.struct("created_at", "__new", F.xxhash64(*cols))).alias("__e"))
    return best.select("sql_hash", "__e.*").select(*cols).withColumn("point_id", F.substring("sql_hash", 1, 16))


def refactor_plan(scripts: DataFrame, cache: DataFrame, threshold: float = REFACTOR_THRESHOLD) -> DataFrame:
    """Per script: answered from the cache, or queued for the model."""
    best = vector_topk(scripts, cache, 1, threshold, query_id="script_id", index_id="entry_id")
    hits = best.select(F.col("query_id").alias("script_id"), "match_id", F.col("score").alias("confidence"))
    return scripts.join(hits, "script_id", "left").select(
        "script_id", "match_id",
        F.when(F.col("match_id").isNotNull(), "vector").otherwise("queued").alias("engine"),
        F.col("match_id").isNotNull().alias("cached"),
        "confidence",
        F.when(F.col("match_id").isNotNull(), 0.0).alias("cost"),
    )


def plan_stats(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"),
        F.coalesce(F.round(F.avg(F.col("cached").cast("int")), 6), F.lit(0.0)).alias("cache_hit_rate"),
    )


def fuzzy_score(query: str, text: Column) -> Column:
    """Gaps skipped plus 3 per gap when the query is a subsequence, else null."""
    low = F.lower(text)
    step = F.lit(query.lower())
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(True).alias("ok"))

    def advance(acc: Column, char: Column) -> Column:
        found = F.call_function("locate", char, low, acc["at"] + 1)
        skipped = found - 1 - acc["at"]
        return F.when(acc["ok"] & (found > 0), F.struct(found.alias("at"), (acc["score"] + skipped + F.when(skipped > 0, 3).otherwise(0)).alias("score"), F.lit(True).alias("ok"))).otherwise(
            F.struct(acc["at"].alias("at"), acc["score"].alias("score"), F.lit(False).alias("ok"))
        )

    done = F.aggregate(F.filter(F.split(step, ""), lambda ch: ch != ""), start, advance)
    return F.when(done["ok"], done["score"])


def fuzzy_rank(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows that match in some column, best (lowest) score first, equal scores by the searched columns."""
    cleaned = query.strip().strip(">").strip().lower()
    if not cleaned:
        return df.withColumn("score", F.lit(0))
    scores = [fuzzy_score(cleaned, F.col(c)) for c in columns]
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return df.withColumn("score", best).filter("score is not null").orderBy("score", *columns)
