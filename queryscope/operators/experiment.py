"""Deterministic experiment bucketing and its readouts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope import lookups as L

BUCKETS = 1000


def stable_bucket(user: Column, salt: str | Column) -> Column:
    """0..999 from the first 8 hex digits of sha256(user:salt)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat(user.cast("string"), F.lit(":"), salt), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def _variants(flag: dict) -> list[str]:
    return flag["variants"] if flag["default"] in flag["variants"] else [flag["default"]] + flag["variants"]


def variant(user: Column, flag_key: str, flags: Sequence[dict] = L.FLAGS, salt: str = L.DEFAULT_SALT) -> Column:
    """The user's variant: unknown flag gives control, disabled gives the default."""
    flag = next((f for f in flags if f["key"] == flag_key), None)
    if flag is None:
        return F.lit("control")
    if not flag["enabled"]:
        return F.lit(flag["default"])
    names = _variants(flag)
    return F.element_at(F.array(*[F.lit(n) for n in names]), stable_bucket(user, f"{salt}:{flag_key}") % len(names) + 1)


def assign_variant(users: DataFrame, user: str = "user_id", flags: Sequence[dict] = L.FLAGS, salt: str = L.DEFAULT_SALT) -> DataFrame:
    """One row per user and flag. The flags are plan literals, so nothing is joined."""
    rows = F.array(*[F.struct(F.lit(f["key"]).alias("flag"), variant(F.col(user), f["key"], flags, salt).alias("variant")) for f in flags])
    return users.select(user, F.inline(rows))


def rule_cohort(users: DataFrame, rule: str, allow: DataFrame | None = None, user: str = "user_id", salt: str = L.DEFAULT_SALT) -> DataFrame:
    """Whether a beta rule is on for each user; listed users always have it."""
    key = L.BETA_RULE_FLAGS.get(rule)
    if key is None:
        return users.withColumn("enabled", F.lit(False))
    flag = {"key": key, "default": "control", "variants": ["control", "treatment"], "enabled": True}
    treated = variant(F.col(user), key, [flag], salt) == "treatment"
    if allow is None:
        return users.withColumn("enabled", treated)
    listed = allow.select(F.col(user)).distinct().withColumn("__listed", F.lit(True))
    return users.join(listed, user, "left").withColumn("enabled", F.coalesce("__listed", treated)).drop("__listed")


def distribution(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy(F.when(F.col("enabled"), "treatment").otherwise("control").alias("variant")).agg(F.count(F.lit(1)).alias("users"))


def exposures(assigned: DataFrame, user: str = "user_id", salt: str = L.DEFAULT_SALT) -> DataFrame:
    """Exposure rows; their bucket leaves the flag key out of the salt."""
    return assigned.withColumn("bucket", stable_bucket(F.col(user), salt))


def experiment_readout(assigned: DataFrame, events: DataFrame, user: str = "user_id") -> DataFrame:
    """Users, converters, rate and value per flag and variant.

    Conversions are folded per user before the join, so a user with a third of all
    events is one row there.
    """
    won = events.filter("is_conversion").groupBy(user).agg(F.sum("value").alias("value"))
    joined = assigned.join(won, user, "left")
    return joined.groupBy("flag", "variant").agg(
        F.count(F.lit(1)).alias("users"),
        F.count("value").alias("converters"),
        F.round(F.count("value") / F.count(F.lit(1)), 6).alias("rate"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("value"),
    )
