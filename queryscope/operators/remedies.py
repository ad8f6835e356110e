"""The data-side form of each lint remedy."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.operators import gramindex


def filter_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """A half-open range on the bare column, which reaches the file scan."""
    col = F.col(column)
    return df.filter((col >= F.lit(dt.date(year, 1, 1))) & (col < F.lit(dt.date(year + 1, 1, 1))))


def filter_date(df: DataFrame, column: str, day: str) -> DataFrame:
    """One day as a half-open range."""
    start = dt.date.fromisoformat(day)
    col = F.col(column)
    return df.filter((col >= F.lit(start)) & (col < F.lit(start + dt.timedelta(days=1))))


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], nulls: str = "exists") -> DataFrame:
    """Rows of ``left`` without a match.

    ``exists``: NOT EXISTS, where NULL keys never match and so are kept.
    ``not_in``: SQL NOT IN on one key. A NULL on the right empties the result, and
    a NULL on the left is kept only if the right side is empty. Both stay equi
    anti joins, so neither side has to fit in memory; the two facts about the
    right side come from a one-row aggregate.
    """
    r = right.select(*[F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(keys)])
    on = [left[a] == r[f"__r{i}"] for i, (a, _) in enumerate(keys)]
    kept = left.join(r, on, "left_anti")
    if nulls == "exists":
        return kept
    if nulls != "not_in" or len(keys) != 1:
        raise ValueError("nulls must be 'exists', or 'not_in' with one key")
    facts = r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__r0").isNull()).alias("holes"))
    allowed = facts.select(
        F.when(F.col("n") == 0, "all").when(F.col("holes") > 0, "none").otherwise("known")
    ).scalar()
    return kept.filter((allowed == "all") | ((allowed == "known") & F.col(keys[0][0]).isNotNull()))


def block(df: DataFrame, order_by: Sequence[Column] | None = None, limit: int | None = None) -> DataFrame:
    """A nested block that sorts only when it is bounded."""
    if limit is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def verify_equivalence(a: DataFrame, b: DataFrame, position: str | None = None) -> DataFrame:
    """One row: rows only in a, rows only in b, equal.

    Without ``position`` the two are compared as multisets: one shuffle, folded on
    the map side, where equal rows cancel. With ``position`` (a row number column)
    row i is compared to row i.
    """
    if position is None:
        cols = a.columns
        tagged = a.select(*cols, F.lit(1).alias("__n")).unionByName(b.select(*cols, F.lit(-1).alias("__n")))
        diff = tagged.groupBy(*cols).agg(F.sum("__n").alias("__n"))
        only_a = F.coalesce(F.sum(F.when(F.col("__n") > 0, F.col("__n"))), F.lit(0))
        only_b = F.coalesce(F.sum(F.when(F.col("__n") < 0, -F.col("__n"))), F.lit(0))
    else:
        cols = [x for x in a.columns if x != position]
        left = a.select(position, F.struct(*cols).alias("__a"))
        right = b.select(position, F.struct(*cols).alias("__b"))
        diff = left.join(right, position, "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b")))
        only_a, only_b = F.count("__a"), F.count("__b")
    return diff.agg(only_a.alias("only_a"), only_b.alias("only_b")).withColumn(
        "equal", (F.col("only_a") == 0) & (F.col("only_b") == 0)
    )


def key_products(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Per key: rows on each side and the rows their join yields."""
    ln = left.filter(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("key")).agg(F.count(F.lit(1)).alias("n_left"))
    rn = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("key")).agg(F.count(F.lit(1)).alias("n_right"))
    return ln.join(rn, "key").withColumn("product", F.col("n_left") * F.col("n_right"))


def join_fanout(left: DataFrame, right: DataFrame, left_key: str, right_key: str, max_ratio: float = 0.01, max_product: int = 1_000_000) -> DataFrame:
    """One row that says how many rows a join would yield, found without running it."""
    n_left = left.agg(F.count(F.lit(1))).scalar()
    n_right = right.agg(F.count(F.lit(1))).scalar()
    out = key_products(left, right, left_key, right_key).agg(
        F.coalesce(F.sum("product"), F.lit(0)).alias("output_rows"), F.coalesce(F.max("product"), F.lit(0)).alias("largest_product")
    )
    pairs = n_left * n_right
    ratio = F.try_divide(F.col("output_rows").cast("double"), pairs.cast("double"))
    return out.select(
        n_left.alias("left_rows"),
        n_right.alias("right_rows"),
        pairs.alias("pair_rows"),
        "output_rows",
        "largest_product",
        F.coalesce((ratio > max_ratio) | (F.col("largest_product") > max_product), F.lit(False)).alias("flagged"),
    )


def skew_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int = 10) -> DataFrame:
    """The k keys whose join yields most rows."""
    return key_products(left, right, left_key, right_key).orderBy(F.desc("product"), F.asc("key")).limit(k)


def aligned_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, dtype: str = "bigint", how: str = "inner") -> DataFrame:
    """Cast both keys once, then join on equal types with no cast in the condition."""
    a = left.withColumn("__lk", F.col(left_key).try_cast(dtype))
    b = right.withColumn("__rk", F.col(right_key).try_cast(dtype))
    return a.join(b, a["__lk"] == b["__rk"], how).drop("__lk", "__rk")


def suffix_search(df: DataFrame, column: str, suffixes: Sequence[str]) -> DataFrame:
    """``LIKE '%s'`` as a prefix test on the reversed column."""
    backwards = F.reverse(F.col(column))
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.startswith(backwards, F.lit(s[::-1]))
    return df.filter(hit)


def suffix_join(df: DataFrame, column: str, suffixes: DataFrame, suffix: str = "suffix") -> DataFrame:
    """Many suffixes: an equi join on (length, last n characters), one row per match."""
    s = suffixes.select(suffix, F.length(suffix).alias("__n"), F.reverse(suffix).alias("__tail")).distinct()
    lengths = s.agg(F.collect_set("__n")).scalar()  # distinct lengths, bounded by the longest suffix
    probe = df.withColumn("__n", F.explode(lengths)).filter(F.col("__n") <= F.length(column))
    probe = probe.withColumn("__tail", F.substring(F.reverse(F.col(column)), F.lit(1), F.col("__n")))
    return probe.join(s, ["__n", "__tail"]).drop("__n", "__tail")


def trigram_search(df: DataFrame, key: str, column: str, needle: str, path: str | None = None) -> DataFrame:
    """``LIKE '%needle%'`` through the stored index at ``path`` (see ``gramindex``); without one a plain scan, which no index made on the spot beats."""
    if path is None:
        return df.filter(F.contains(F.col(column), F.lit(needle)))
    return gramindex.search(df, key, column, needle, path)


_FORMS = {"upper": (F.upper, str.upper), "lower": (F.lower, str.lower), "trim": (F.trim, str.strip)}


def normalized_column(df: DataFrame, column: str, form: str = "lower") -> DataFrame:
    """Add the normalised copy that a table would store."""
    return df.withColumn(f"{column}_{form}", _FORMS[form][0](F.col(column)))


def normalized_equals(df: DataFrame, column: str, literal: str, form: str = "lower") -> DataFrame:
    """Compare the stored normalised column with the literal normalised once."""
    stored = f"{column}_{form}"
    prepared = df if stored in df.columns else normalized_column(df, column, form)
    return prepared.filter(F.col(stored) == _FORMS[form][1](literal))


def shift_literal(df: DataFrame, column: str, op: str, delta: float, literal: float) -> DataFrame:
    """``column + delta <op> literal`` with the arithmetic moved to the literal."""
    value, col = literal - delta, F.col(column)
    tests = {"=": col == value, "<>": col != value, ">": col > value, ">=": col >= value, "<": col < value, "<=": col <= value}
    return df.filter(tests[op])
