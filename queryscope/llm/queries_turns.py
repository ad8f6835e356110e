"""op11: damaged conversations repaired. A cheapest path makes no SQL text; a plain version in the tests does."""
import hashlib

from pyspark.sql import functions as F

from queryscope.llm.registry import query
from queryscope.llm.turn_repair import Repair
from queryscope.workloads.registry import table


def damaged(rows):
    """Rows as a hash of conversation and turn damages them: dropped, emptied, without ends, repeated, or set to user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(fault == 4, "user").otherwise(name("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("copy", "fault")


@query("op11_turn_repair")
def op11_turn_repair(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))


def repaired(rows):
    """The summary of every conversation of the table; one that the damage leaves without rows has zeros."""
    found = Repair(damaged(rows)).summary().withColumnRenamed("conv_id", "own")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
