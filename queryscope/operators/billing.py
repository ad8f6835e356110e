"""Billing events, checkouts and licence state as JSON column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope import lookups as L

_LINE = "struct<price:struct<metadata:struct<plan:string,seats:string>>>"
EVENT_SCHEMA = (
    "struct<type:string,data:struct<object:struct<customer:string,subscription:string,customer_email:string,"
    "customer_details:struct<email:string>,metadata:struct<plan:string,seats:string>,"
    f"lines:struct<data:array<{_LINE}>>,items:struct<data:array<{_LINE}>>>>>"
)
SECOND_SCHEMA = (
    "struct<event_type:string,content:struct<customer:struct<id:string>,subscription:struct<customer_id:string,plan_id:string,"
    "addons:array<struct<addon_id:string,quantity:int>>>>>"
)

# --- fixed values: event type to status
STATUS = {
    "invoice.paid": "provisioned",
    "customer.subscription.created": "provisioned",
    "customer.subscription.updated": "updated",
    "customer.subscription.deleted": "revoked",
    "customer.created": "customer_registered",
}
SECOND_PAID = ["invoice_generated", "subscription_created"]


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def event_status(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(known[kind], F.lit("ignored"))


def _values(lines: Column, field: str) -> Column:
    """Non-empty metadata values of the lines, in order."""
    all_values = F.transform(F.coalesce(lines, F.array().cast(f"array<{_LINE}>")), lambda x: x["price"]["metadata"][field])
    return F.filter(all_values, lambda v: v.isNotNull() & (v != ""))


def _seat_counts(lines: Column) -> Column:
    return F.filter(F.transform(_values(lines, "seats"), lambda v: F.trim(v).try_cast("int")), lambda n: n.isNotNull())


def billing_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Status, plan, seats, customer and subscription of each event.

    An invoice takes the first line with a plan and the first readable seat count;
    a new subscription takes the last of each. A subscription is a text id or an
    object that holds one.
    """
    e = events.withColumn("__e", F.from_json(payload, EVENT_SCHEMA))
    kind, obj = F.col("__e.type"), "__e.data.object"
    lines, items = F.col(f"{obj}.lines.data"), F.col(f"{obj}.items.data")
    invoice, created = kind == "invoice.paid", kind == "customer.subscription.created"
    plan = F.when(invoice, F.get(_values(lines, "plan"), F.lit(0))).when(created, F.try_element_at(_values(items, "plan"), F.lit(-1)))
    first_seats = F.get(_seat_counts(lines), F.lit(0))
    seats = F.when(invoice, F.when(first_seats != 0, first_seats)).when(created, F.try_element_at(_seat_counts(items), F.lit(-1)))
    sub = F.col(f"{obj}.subscription")
    sub_id = F.when(F.startswith(sub, F.lit("{")), F.coalesce(F.get_json_object(sub, "$.id"), F.lit(""))).otherwise(F.coalesce(sub, F.lit("")))
    paid = invoice | created
    return e.select(
        *events.columns,
        F.coalesce(kind, F.lit("")).alias("event_type"),
        event_status(kind).alias("status"),
        F.coalesce(paid, F.lit(False)).alias("provisioned"),
        F.when(paid, F.coalesce(plan, F.lit("enterprise"))).alias("plan"),
        F.when(paid, F.coalesce(seats, F.lit(1))).alias("seats"),
        F.when(paid, F.coalesce(F.col(f"{obj}.customer"), F.lit(""))).alias("customer_id"),
        F.when(invoice, sub_id).alias("subscription_id"),
    )


def second_provider_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The other provider's events: plan id, and the largest count of the seats add-on."""
    e = events.withColumn("__e", F.from_json(payload, SECOND_SCHEMA))
    kind, sub = F.col("__e.event_type"), "__e.content.subscription"
    paid = F.coalesce(kind.isin(SECOND_PAID), F.lit(False))
    extra = F.filter(F.col(f"{sub}.addons"), lambda a: a["addon_id"] == "seats")
    most = F.array_max(F.transform(extra, lambda a: F.coalesce(a["quantity"], F.lit(1))))
    customer = F.coalesce(_filled(F.col("__e.content.customer.id")), F.col(f"{sub}.customer_id"), F.lit(""))
    return e.select(
        *events.columns,
        F.coalesce(kind, F.lit("")).alias("event_type"),
        F.when(paid, "provisioned").otherwise("ignored").alias("status"),
        F.when(paid, F.coalesce(F.col(f"{sub}.plan_id"), F.lit("enterprise"))).alias("plan"),
        F.when(paid, F.greatest(F.lit(1), F.coalesce(most, F.lit(1)))).alias("seats"),
        customer.alias("customer_id"),
    )


def checkout_completed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Completed checkouts: email from either place, plan (pro) and seats (1)."""
    e = events.withColumn("__e", F.from_json(payload, EVENT_SCHEMA)).filter(F.col("__e.type") == "checkout.session.completed")
    obj = "__e.data.object"
    return e.select(
        *events.columns,
        F.coalesce(_filled(F.col(f"{obj}.customer_email")), F.col(f"{obj}.customer_details.email"), F.lit("")).alias("customer_email"),
        F.coalesce(F.col(f"{obj}.metadata.plan"), F.lit("pro")).alias("plan"),
        F.coalesce(F.trim(F.col(f"{obj}.metadata.seats")).try_cast("int"), F.lit(1)).alias("seats"),
    )


def license_state(licenses: DataFrame, now: int) -> DataFrame:
    """Tier, expiry and validity of ``(customer_id, plan, seats, issued_at, duration_days)``."""
    tier = F.coalesce(F.create_map(*[F.lit(x) for kv in L.PLAN_TIER.items() for x in kv])[F.col("plan")], F.lit(0))
    expires = F.col("issued_at") + F.col("duration_days") * 86400
    usable = (F.coalesce("customer_id", F.lit("")) != "") & (F.col("seats") >= 1)
    out = licenses.withColumn("tier", tier).withColumn("expires_at", expires)
    out = out.withColumn("expired", (F.col("expires_at") > 0) & (F.lit(now) > F.col("expires_at")))
    return out.withColumn("valid", usable & ~F.col("expired"))


def provision_seats(requests: DataFrame) -> DataFrame:
    """Accept the three roles in any case, and mask the email."""
    role = F.upper("role")
    ok = role.isin(L.ROLES)
    parts = F.split("email", "@")
    good = (F.size(parts) == 2) & (F.length(parts[0]) > 0)
    masked = F.when(good, F.concat(F.substring(parts[0], 1, 1), F.lit("***@"), parts[1])).otherwise("***")
    return requests.select(
        *[c for c in requests.columns if c not in ("email", "role")],
        ok.alias("success"),
        F.when(ok, masked).alias("email_masked"),
        F.when(ok, role).alias("role"),
        F.when(ok, "pending").otherwise("rejected").alias("status"),
    )
