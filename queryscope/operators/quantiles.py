"""Exact quantiles of groups by distributed selection: narrow the range that holds a rank, then pick.

A quantile is the first value whose running count reaches its share of the group's
values. A pass makes a sketch of bounded size per group, whose cuts bracket every wanted
rank; the next pass counts what lies below the bracket and what is in it. Each pass
leaves about a hundredth of a group's values, so two or three do at any size. When no
bracket holds more than ``PICK`` values they are folded, sorted in an array of that bound
and picked. No window runs over a group and no group is gathered whole.

Null values count for nothing, NaN is the largest value. A group without values has null
quantiles. Null group columns are groups. Values are numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.session import stored

PICK = 50_000  # values that may be picked from in one array
CUTS, ACCURACY = 256, 10_000  # brackets of a sketch, and its accuracy: the error of a rank is far below the width of a bracket


_BOUNDS = ("below", "inside", "low", "high")


def _same(by: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def _named(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{i}" for i, c in enumerate(by)})


def _state(counts: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, q, rank, below, inside, low, high) with whole groups as brackets; null bounds are open. Ranks beyond ``inside`` are NaN."""
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.greatest(F.ceil(F.col("n") * float(s)), F.lit(1)).alias("rank")) for i, s in enumerate(shares)])).alias("s")
    none = F.lit(None).cast("double")
    return counts.select(*by, ranks, "numbers").select(*by, "s.q", "s.rank", F.lit(0).cast("long").alias("below"), F.col("numbers").alias("inside"), none.alias("low"), none.alias("high"))


def _inside(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the state of each bracket they lie in; the state is one row per group and share, the rows are the side that a skew join splits."""
    own = _named(state, by, "__s")
    within = (F.col("low").isNull() | (F.col("__v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("__v") <= F.col("high")))
    return rows.join(own, _same(by, "__s")).filter(within)


def narrowed(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state after one pass: a sketch of what lies in each bracket, then exact counts of the narrower brackets."""
    inside = _inside(rows, state, by)
    cuts = F.percentile_approx("__v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), ACCURACY).alias("cuts")
    sketch = _named(inside.groupBy(*by, "q").agg(cuts), by, "__c").withColumnRenamed("q", "__q")
    at = ((F.col("rank") - F.col("below")) * CUTS / F.col("inside")).cast("int")
    joined = state.join(sketch, _same(by, "__c") & (F.col("q") == F.col("__q")))
    closer = joined.select(*by, "q", "rank", *[F.col(c).alias(f"{c}0") for c in _BOUNDS], F.get("cuts", F.greatest(at - 2, F.lit(0))).alias("low"), F.get("cuts", F.least(at + 2, F.lit(CUTS))).alias("high"))
    closer = stored(closer, "quantile-brackets")
    counts = rows.join(_named(closer, by, "__s"), _same(by, "__s")).groupBy(*by, "q").agg(
        F.count_if(F.col("__v") < F.col("low")).alias("below"), F.count_if((F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))).alias("inside"))
    both = closer.join(_named(counts, by, "__c").withColumnRenamed("q", "__q"), _same(by, "__c") & (F.col("q") == F.col("__q")))
    # a bracket that missed its rank would be seen here, and the wider one stays
    hit = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("inside"))
    return stored(both.select(*by, "q", "rank", *[F.when(hit, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in _BOUNDS]), "quantile-state")


def _picked(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, q, value): equal values are folded in the tasks, then at most ``PICK`` of a bracket are sorted and counted up."""
    folded = _inside(rows, state, by).groupBy(*by, "q", "rank", "below", "__v").agg(F.count(F.lit(1)).alias("n"))
    listed = folded.groupBy(*by, "q", "rank", "below").agg(F.array_sort(F.collect_list(F.struct("__v", "n"))).alias("l"))
    start = F.struct(F.col("below").alias("upto"), F.lit(None).cast("double").alias("value"))
    step = lambda acc, x: F.struct((acc["upto"] + x["n"]).alias("upto"), F.when(acc["upto"] >= F.col("rank"), acc["value"]).otherwise(x["__v"]).alias("value"))
    return listed.select(*by, "q", F.aggregate("l", start, step, lambda acc: acc["value"]).alias("value"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], pick: int = PICK) -> DataFrame:
    """(by, q0, q1, ..) with the exact quantile of each share for every group that has values.

    A bracket that cannot be narrowed (one value makes up all of it) is one folded
    value, so it is picked whatever its count.
    """
    given = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    rows = given.filter(~F.isnan("__v"))
    counts = given.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("__v")).alias("numbers"))
    whole = stored(_state(counts, by, shares), "quantile-state")
    last = whole.filter("rank > inside").select(*by, "q", F.lit(float("nan")).alias("value"))
    state = whole.filter("rank <= inside")
    wide = (F.col("inside") > pick) & (F.col("low").isNull() | (F.col("low") < F.col("high")))
    while not state.filter(wide).isEmpty():
        before = state.agg(F.sum("inside")).first()[0]
        state = narrowed(rows, state, by)
        if state.agg(F.sum("inside")).first()[0] >= before:  # few distinct values: folding them is the rest of the work
            break
    found = _picked(rows, state, by).unionByName(last)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, F.col("value"))).alias(f"q{i}") for i in range(len(shares))])
