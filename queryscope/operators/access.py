"""Access decisions and claim summaries from signed-in users' claims."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope import lookups as L

ROLE_CLAIM = "roles"


def claimed_roles(claims: Column) -> Column:
    """Known roles in a claims text: a JSON list or a comma separated string, any case."""
    raw = F.get_json_object(claims, f"$.{ROLE_CLAIM}")
    listed = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.split(F.coalesce(raw, F.lit("")), ","))
    names = F.transform(listed, lambda r: F.upper(F.trim(r)))
    return F.array_intersect(names, F.array(*[F.lit(r) for r in L.ROLES]))


def effective_roles(roles: Column) -> Column:
    """ADMIN stands for every role."""
    return F.when(F.array_contains(roles, "ADMIN"), F.array(*[F.lit(r) for r in L.ROLES])).otherwise(roles)


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def access_decisions(requests: DataFrame) -> DataFrame:
    """Role and action checks per request, with the audit row's fields.

    Policies are a handful of fixed values, so they are literals in the plan and
    nothing is joined.
    """
    held = effective_roles(claimed_roles(F.col("claims")))
    needed = _lookup(L.ENDPOINT_POLICY)[F.col("path")]
    may = F.lit(False)
    for role, actions in L.ACTION_PERMISSIONS.items():
        may = may | (F.array_contains("effective", role) & F.col("action").isin(actions))
    out = requests.withColumn("effective", held).withColumn("required_role", needed)
    endpoint = F.coalesce(F.array_contains("effective", F.col("required_role")), F.lit(True))
    out = out.withColumn("endpoint_ok", F.when(F.col("required_role").isNull(), F.lit(True)).otherwise(endpoint))
    return out.withColumn("action_ok", may).withColumn("granted", F.col("endpoint_ok") & F.col("action_ok"))


def claims_summary(claims: Column) -> list[Column]:
    """Columns of the reduced claims: sub, email, roles, scope, org, tier."""
    def text(path: str, default: str = "") -> Column:
        return F.coalesce(F.get_json_object(claims, f"$.{path}"), F.lit(default))

    scope = F.filter(F.split(text("scope"), r"\s+"), lambda s: s != "")
    return [
        text("sub").alias("sub"),
        text("email").alias("email"),
        claimed_roles(claims).alias("roles"),
        scope.alias("scope"),
        F.coalesce(F.get_json_object(claims, "$.org_id"), F.get_json_object(claims, "$.org"), F.lit("")).alias("org"),
        text("tier", "free").alias("tier"),
    ]
