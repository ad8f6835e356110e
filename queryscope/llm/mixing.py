"""Mixing to target weights: token weights raked to marginals, then documents sampled by calibrated probabilities.

Token counts per (source, language, topic) are summed before anything is shuffled.
Iterative proportional fitting scales the cells to one marginal after the other. The
sample has a stated size, ``keep`` of all tokens, and a cell can give no more than it
has: its weight stops at its tokens over the sample's size, and what it cannot give is
raked onto the other cells. A document's probability is its cell's weight over that
limit, so every marginal of the expected sample has its target share, the expected
tokens have the stated size, and no document is taken twice. A tiny cell with a large
target becomes full; it does not shrink the others.

Where marginals contradict each other, or ask for more than there is, the last of
``ROUNDS`` rounds counts: such values stay full, and the marginal named last has its
target shares as far as its cells allow.

A null source, language or topic is a value of its own, a null text has no tokens. A
cell without tokens has probability one. Whether a document is taken follows from a
hash of its id, so repeated rows share their fate and a lost task decides alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm.common import stored, unused

# rounds at most; the cells are stored and the last round's largest change is looked at after every STEP rounds
ROUNDS, STEP, TOLERANCE = 24, 4, 1e-6
KEEP = 0.75
MARGINS = ("source", "lang", "topic")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(key: Column, salt: str) -> Column:
    """A number from 0 to below 1 that only the id decides."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}"))), 1, 13), 16, 10).cast("double") / float(16**13)


def cells(docs: DataFrame) -> DataFrame:
    """Stored (s0, s1, s2, tokens) of rows (s0, s1, s2, tokens); equal cells are added up in each task first."""
    return stored(docs.groupBy("s0", "s1", "s2").agg(F.sum("tokens").cast("double").alias("tokens")), "mix-cells")


def temperature(table: DataFrame, column: str, power: float) -> DataFrame:
    """Target shares (value, share) in proportion to the token counts to a power below one, which lifts the rare."""
    sums = table.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    whole = sums.agg(F.sum(F.pow("n", F.lit(power)))).first()[0] or 1.0
    return sums.select("value", (F.pow("n", F.lit(power)) / whole).alias("share"))


def given(table: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Target shares as stated, for values that have tokens, scaled to add up to one."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "value string, share double")
    there = table.filter("tokens > 0").select(F.col(column).alias("v")).distinct()
    found = there.join(wanted, F.col("v") == F.col("value")).select("value", "share")
    whole = found.agg(F.sum("share")).first()[0] or 1.0
    return found.select("value", (F.col("share") / whole).alias("share"))


def rake(table: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(s0, s1, s2, tokens, weight, full): weights whose marginals are the targets and that never pass ``full``.

    Targets join the cells once. A round is one sum per marginal over the folded
    cells, so no plan holds a broadcast, and each stored step starts a new plan.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep is a share of all tokens")
    whole = table.agg(F.sum("tokens")).first()[0] or 1.0
    now = table.withColumns({"full": F.col("tokens") / (whole * keep), "free": F.col("tokens") / whole, "moved": F.lit(0.0)})
    for column, target in targets.items():
        t = target.select(F.col("value").alias("v"), F.col("share").alias(f"t_{column}")).hint("shuffle_hash")
        now = now.join(t, F.col(column) == F.col("v"), "left").drop("v")
    for done in range(0, rounds, STEP):
        for _ in range(min(STEP, rounds - done)):
            now = now.withColumn("moved", F.lit(0.0))
            for column in targets:
                has = F.sum(F.least("free", "full")).over(Window.partitionBy(column))
                now = now.withColumn("by", F.coalesce(F.try_divide(F.coalesce(f"t_{column}", F.lit(0.0)), has), F.lit(1.0)))
                now = now.withColumns({"free": F.col("free") * F.col("by"), "moved": F.greatest("moved", F.abs(F.col("by") - 1))}).drop("by")
        now = stored(now, "mix-step")
        if (now.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return now.select("s0", "s1", "s2", "tokens", F.least("free", "full").alias("weight"), "full")


def probabilities(fitted: DataFrame) -> DataFrame:
    """(s0, s1, s2, weight, p) of every cell."""
    return fitted.select("s0", "s1", "s2", "weight", F.coalesce(F.try_divide("weight", "full"), F.lit(1.0)).alias("p"))


def mixed(docs: DataFrame, topic: Column, powers: dict[str, float], text: str = "text", source: str = "source", lang: str = "lang", salt: str = "mix", key: str = "doc_id", keep: float = KEEP) -> tuple[DataFrame, list[str]]:
    """All rows with their columns, then topic, tokens, weight, probability and whether they are sampled; the names of these five.

    ``powers`` gives each of ``MARGINS`` the power of its temperature, ``keep`` the sample's share of all tokens.
    Names that ``docs`` has, in any case, get underscores.
    """
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names: list[str] = []
    for wanted in ("s0", "s1", "topic", "tokens", "weight", "probability", "sampled", "c0", "c1", "c2"):
        names.append(unused(docs, wanted, names))
    own, more, other = names[:4], names[4:7], names[7:]
    marked = docs.withColumns(dict(zip(own, (value(F.col(source)), value(F.col(lang)), value(topic), words(F.col(text))))))
    table = cells(marked.select(*[F.col(a).alias(b) for a, b in zip(own, ("s0", "s1", "s2", "tokens"))]))
    columns = dict(zip(MARGINS, ("s0", "s1", "s2")))
    fitted = probabilities(rake(table, {columns[m]: temperature(table, columns[m], p) for m, p in powers.items()}, keep))
    fitted = fitted.select(*[F.col(f"s{i}").alias(other[i]) for i in range(3)], F.col("weight").alias(more[0]), F.col("p").alias(more[1]))
    out = marked.join(fitted, [F.col(a) == F.col(b) for a, b in zip(own, other)])
    out = out.withColumn(more[2], chance(F.col(key), salt) < F.col(more[1]))
    return out.select(*docs.columns, own[2], own[3], *more), [own[2], own[3], *more]
