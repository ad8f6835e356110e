"""Column profiling and histograms over whole tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.NumericType,)


def type_label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _NUMERIC):
        return "number"
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return "struct/list"
    return "text"


def _as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(F.col(field.name))
    return F.col(field.name).cast("string")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: count, nulls, unique (distinct values in text form), type.

    Exact form: the cells are folded per (column, value) before the shuffle, so a
    value that fills a third of a column moves as one row per task. The
    approximate form is a single pass with sketches and no shuffle of values.
    """
    fields = df.schema.fields
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f.name, type_label(f.dataType))])
    if approximate:
        aggs = []
        for f in fields:
            text = _as_text(f)
            aggs.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("count"), F.count_if(F.col(f.name).isNull()).alias("nulls"), F.approx_count_distinct(text).alias("unique")))
        row = df.agg(F.array(*aggs).alias("cells"))
        return row.select(F.inline("cells")).withColumn("type", kinds[F.col("column")])
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), _as_text(f).alias("value")) for f in fields])
    folded = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return folded.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("unique"),
    ).withColumn("type", kinds[F.col("column")])


def one_decimal(x: Column) -> Column:
    """A double with one decimal, rounded by its exact binary value, ties to even.

    Ten times x is formed as 8x + 2x with its rounding error kept, because the
    formatter rounds the printed digits, which differs where they end in 5.
    """
    a, b = x * 8, x * 2
    s = a + b
    err = (a - (s - (s - a))) + (b - (s - a))
    low = F.floor(s)
    part = s - low
    up = (part > 0.5) | ((part == 0.5) & ((err > 0) | ((err == 0) & (F.abs(low) % 2 == 1))))
    n = low + F.when(up, 1).otherwise(0)
    digits = F.abs(n)
    sign = F.when((n < 0) | ((n == 0) & (x < 0)), "-").otherwise("")
    return F.concat(sign, F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"))


def numeric_histogram(df: DataFrame, column: str, buckets: int = 4) -> DataFrame:
    """Equal-width buckets with empty ones kept: bucket, label ``lo-hi``, count.

    Text that is not a number is left out. A column without any number gives one
    row labelled ``N/A``.
    """
    nums = df.select(F.col(column).try_cast("double").alias("x")).filter("x is not null")
    bounds = nums.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spread = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    lo = bounds.select("lo").scalar()
    span = bounds.select(spread).scalar()
    idx = F.least(F.lit(buckets - 1), F.floor((F.col("x") - lo) / span * buckets).cast("int"))
    counts = nums.groupBy(idx.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    shape = bounds.select(
        F.explode(F.when(F.col("lo").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))).alias("bucket"),
        "lo",
        spread.alias("span"),
    )
    left = F.col("lo") + F.col("span") * F.col("bucket") / buckets
    right = F.col("lo") + F.col("span") * (F.col("bucket") + 1) / buckets
    shape = shape.withColumns({"left": left, "right": right})
    label = F.when(F.col("lo").isNull(), "N/A").otherwise(F.concat(one_decimal(F.col("left")), F.lit("-"), one_decimal(F.col("right"))))
    # counts has at most `buckets` rows
    return shape.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", label.alias("label"), F.coalesce("count", F.lit(0)).alias("count")
    )


def fixed_width_bucket(column: str | Column, width: int) -> Column:
    """Label ``[lo, lo + width)`` of a value; ``other`` when it is not a number."""
    col = F.col(column) if isinstance(column, str) else column
    lo = F.floor(col.try_cast("double") / width).cast("long") * width
    return F.when(col.try_cast("double").isNull(), "other").otherwise(F.format_string("[%d, %d)", lo, lo + width))


def first_letter_histogram(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    """The k most frequent first letters; ties go to the smaller label."""
    text = F.col(column).cast("string")
    label = F.when(text == "", "(blank)").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lit("-group")))
    counts = df.filter(F.col(column).isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("label")).limit(k)


def uniqueness_tier(profile: DataFrame) -> DataFrame:
    """Add the ratio of distinct values and its tier to a column profile."""
    ratio = F.when(F.col("count") > 0, F.col("unique") / F.col("count")).otherwise(0.0)
    tier = F.when(ratio >= 0.5, "high").when(ratio >= 0.15, "medium").otherwise("low")
    return profile.withColumn("ratio", ratio).withColumn("tier", tier)
