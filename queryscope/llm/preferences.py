"""Preference records: the common turns of a chosen and a rejected conversation as prompt, the rest as two masked completions.

Turns are put in order in one shuffle; a conversation is one record and everything
after that is a column expression over it. A mask lists the code points of a
completion that are trained on: each assistant text with its end mark.

A null role or text is empty; turns with equal numbers are ordered by role and text.
A pair whose conversations are equal has empty completions and is not usable; where one
side is missing the prompt is empty. Marks inside texts are broken up, so that a record
can be read in one way only. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.llm.pii import running_sum

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def assemble(turns: DataFrame, key: str, name: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, name): the (role, text) of each conversation's turns in order."""
    rows = turns.select(F.col(key).alias("k"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("k").agg(ordered.alias(name)).select(F.col("k").alias(key), name)


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    return F.when(n > 0, F.coalesce(F.get(differ, 0) - 1, n)).otherwise(0)


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _rendered(turns: Column) -> Column:
    """Each turn as text."""
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n"), _plain(t["text"]), F.lit(CLOSE)))


def _mask(turns: Column, texts: Column, ends: Column) -> Column:
    """``start:end`` of what is trained on in the joined texts."""
    def span(t, i):
        end = F.get(ends, i)
        begin = end - F.length(F.get(texts, i)) + F.length(_plain(t["role"])) + len(OPEN) + 1
        return F.when(t["role"] == TRAINED, F.concat_ws(":", begin, end - 1))

    return F.array_join(F.filter(F.transform(turns, span), lambda s: s.isNotNull()), ",")


def format_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """Records of rows (key, chosen, rejected): prompt, completions, masks, numbers of turns and whether the record is usable."""
    rest = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    d = pairs.select(key, *[F.coalesce(F.col(c), F.array().cast(_TURNS)).alias(c) for c in ("chosen", "rejected")])
    d = d.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    d = d.select(key, "n", F.slice("chosen", 1, F.col("n")).alias("p"), rest(F.col("chosen"), F.col("n")).alias("c"), rest(F.col("rejected"), F.col("n")).alias("r"))
    d = d.select("*", *[_rendered(F.col(x)).alias(f"{x}_texts") for x in "pcr"])
    d = d.select("*", *[running_sum(F.transform(f"{x}_texts", F.length)).alias(f"{x}_ends") for x in "cr"])
    joined = lambda x: F.array_join(f"{x}_texts", "")
    return d.select(
        key, joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"),
        _mask(F.col("c"), F.col("c_texts"), F.col("c_ends")).alias("chosen_mask"), _mask(F.col("r"), F.col("r_texts"), F.col("r_ends")).alias("rejected_mask"),
        F.col("n").alias("prompt_turns"), ((F.size("c") > 0) & (F.size("r") > 0)).alias("usable"),
    )


def preference_records(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Records of two tables of turns (key, turn, role, text); a pair may be missing from either."""
    other = assemble(rejected, key, "rejected").withColumnRenamed(key, "other_key")
    a = assemble(chosen, key, "chosen")
    both = a.join(other, a[key].eqNullSafe(F.col("other_key")), "full")
    return format_pairs(both.select(F.coalesce(a[key], F.col("other_key")).alias(key), "chosen", "rejected"), key)


def degraded(turns: Column) -> Column:
    """A worse version of a conversation: its last answer repeats the first one, or breaks off half-way where it is the only one.

    What follows the last answer is left out; a conversation without an answer stays as it is.
    """
    at = F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i + 1))
    at = F.filter(at, lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    own = F.get(turns, last - 1)["text"]
    worse = F.when(first < last, F.get(turns, first - 1)["text"]).otherwise(F.left(own, F.floor(F.length(own) / 2).cast("int")))
    changed = F.concat(F.slice(turns, F.lit(1), last - 1), F.array(F.struct(F.lit(TRAINED).alias("role"), worse.alias("text"))))
    return F.when(last.isNotNull(), changed).otherwise(turns)
