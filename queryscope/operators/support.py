"""Support texts: redaction, crash rows, primitive values and message routing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope import lookups as L

_SENSITIVE = r"(?i)select|insert|drop|sql="


def redact_steps(steps: Column, keep: int = 20) -> Column:
    """The last steps; one that looks like SQL becomes ``(redacted)``, others keep 200 characters."""
    size = F.size(steps)
    last = F.slice(steps, F.greatest(F.lit(1), size - (keep - 1)), F.lit(keep))
    return F.transform(last, lambda s: F.when(s.rlike(_SENSITIVE), "(redacted)").otherwise(F.substring(s, 1, 200)))


def short_message(message: Column) -> Column:
    return F.substring(message, 1, 500)


def crash_tail(trace: Column) -> Column:
    """The last 400 characters of the trimmed trace, or ``<no trace>``."""
    clean = F.regexp_replace(F.coalesce(trace, F.lit("")), r"^\s+|\s+$", "")
    return F.when(clean == "", "<no trace>").otherwise(F.substring(clean, F.greatest(F.lit(1), F.length(clean) - 399), F.lit(400)))


def primitive_only(payload: Column) -> Column:
    """The entries of a JSON object whose values are not nested."""
    entries = F.from_json(payload, "map<string,string>")
    return F.map_filter(entries, lambda _, v: v.isNull() | ~F.substring(v, 1, 1).isin("{", "["))


def _word(text: str) -> str:
    import re

    return rf"(?<![\p{{L}}\p{{N}}_]){re.escape(text)}(?![\p{{L}}\p{{N}}_])"


def route_message(messages: DataFrame, text: str = "text", titles: dict[str, str] | None = None) -> DataFrame:
    """Where a message goes: topic, intent or rule.

    The topic with most keywords present as whole words wins, the earlier one on a
    tie; then the first intent; then a rule named in the text; else the fallback.
    The keyword lists are fixed and small, so they are expressions of the row and
    nothing is joined.
    """
    low = F.lower(F.col(text))
    scored = []
    for i, words in enumerate(L.FAQ_KEYWORDS):
        hits = sum((F.when(low.rlike(_word(w)), 1).otherwise(0) for w in words), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("ord"), F.lit(words[0]).alias("topic")))
    best = F.array_max(F.array(*scored))
    out = messages.withColumn("__low", low).withColumn("__best", best)
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(L.INTENTS):
        intent = F.when(F.col("__low").rlike("(?iU)" + pattern), name).otherwise(intent)
    out = out.withColumn("__intent", F.when(F.col("__low").rlike(r"(?<![a-z0-9])(?:ast|parsing|parser)(?![a-z0-9])"), "ast").otherwise(intent))
    rules = F.create_map(*[F.lit(x) for kv in L.INTENT_RULE.items() for x in kv])
    named = F.lit(None).cast("string")
    for rule, title in reversed(list((titles or dict.fromkeys(L.INTENT_RULE.values(), "")).items())):
        hit = F.contains(F.col("__low"), F.lit(rule.lower()))
        if title:
            hit = hit | F.contains(F.col("__low"), F.lit(title.lower()))
        named = F.when(hit, rule).otherwise(named)
    by_topic, by_intent = F.col("__best.hits") > 0, F.col("__intent").isNotNull()
    return out.withColumns(
        {
            "topic": F.when(by_topic, F.col("__best.topic")).when(~by_intent & named.isNull(), "general"),
            "intent": F.when(~by_topic, F.col("__intent")),
            "rule_id": F.when(~by_topic & by_intent, rules[F.col("__intent")]).when(~by_topic, named),
            "hits": F.col("__best.hits"),
        }
    ).drop("__low", "__best", "__intent")
