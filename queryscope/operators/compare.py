"""Two tables compared by bucket checksums: only rows of buckets that differ are shuffled whole.

Rows fall into buckets by a hash of all their columns. A bucket's checksum is the number
of its rows and the sums of two 64-bit hashes in halves, so the order of rows does not
matter and repeated rows count. Both tables are added up in one pass, b with a minus
sign: equal tables leave zeros everywhere after a shuffle of at most ``BUCKETS`` rows per
task. Rows of buckets that differ are split once more by further bits, and what still
differs is compared row by row, by value.

That a bucket with a difference has zero sums has a chance of about 2 to the minus 120.
Nulls equal nulls, NaN equals NaN, and -0.0 equals 0.0. Both tables need the same columns; maps cannot be compared.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryscope.session import stored

BUCKETS = 1 << 12


def _normal(df: DataFrame) -> list[Column]:
    return [(F.col(f"`{f.name}`") + F.lit(0.0)).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]


def _signed(df: DataFrame, sign: int) -> DataFrame:
    values = _normal(df)
    return df.withColumns({"__h": F.xxhash64(*values), "__g": F.xxhash64(F.lit(17), *values), "__sign": F.lit(sign)})


def _halves(column: str) -> list[Column]:
    h = F.col(column)
    return [F.sum(F.col("__sign") * h.bitwiseAND(0xFFFFFFFF)).alias(f"{column}_lo"), F.sum(F.col("__sign") * F.shiftrightunsigned(h, 32)).alias(f"{column}_hi")]


def checksums(rows: DataFrame, bucket: Column) -> DataFrame:
    """(bucket) of the buckets whose count or sums differ; equal buckets fold in the tasks first."""
    sums = rows.groupBy(bucket.alias("bucket")).agg(F.sum("__sign").alias("n"), *_halves("__h"), *_halves("__g"))
    zero = F.lit(True)
    for c in sums.columns[1:]:
        zero = zero & (F.col(c) == 0)
    return sums.filter(~zero).select("bucket")


def differing_rows(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose number differs, with ``n_a`` and ``n_b``, how often each side has them."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    both = _signed(a, 1).unionByName(_signed(b.select(*[f"`{c}`" for c in a.columns]), -1))
    first = F.pmod("__h", F.lit(buckets))
    # numbers below ``buckets``, so this list is bounded
    wide = stored(checksums(both, first), "compare-buckets")
    rows = both.join(F.broadcast(wide), first == F.col("bucket"), "left_semi")
    finer = F.pmod("__h", F.lit(buckets * buckets))
    narrow = stored(checksums(rows, finer), "compare-buckets")
    rows = rows.join(narrow, finer == F.col("bucket"), "left_semi")
    times = lambda sign: F.count_if(F.col("__sign") == sign)
    counted = rows.groupBy(*[f"`{c}`" for c in a.columns]).agg(times(1).alias("n_a"), times(-1).alias("n_b"))
    return counted.filter("n_a <> n_b")


def equal_tables(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> bool:
    """Whether both hold the same rows as often; one pass over each and one small shuffle."""
    both = _signed(a, 1).unionByName(_signed(b.select(*[f"`{c}`" for c in a.columns]), -1))
    return checksums(both, F.pmod("__h", F.lit(buckets))).isEmpty()
