"""Stored copies of a column for searches the column itself cannot serve: by its end, or regardless of form.

A copy of the table is written with the derived column, dealt by range and sorted by it,
so every file and row group holds a narrow range of values. A search becomes a range or
an equality on the stored column, which Parquet's statistics answer: files and row groups
outside the range are not read. Rows whose column is null are kept and match nothing.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# how a value is derived in a table, and the same for a search text
FORMS = {
    "reversed": (F.reverse, lambda s: s[::-1]),
    "lower": (F.lower, str.lower),
    "upper": (F.upper, str.upper),
    "trim": (F.trim, lambda s: s.strip(" ")),
}


def derived(column: str, form: str) -> str:
    return f"{column}_{form}"


def write_copy(df: DataFrame, column: str, form: str, path: str, files: int | None = None, row_group_bytes: int | None = None) -> None:
    """Write ``df`` with the derived column, in its order. Values of which there are very many are split over files."""
    name = derived(column, form)
    marked = df.withColumn(name, FORMS[form][0](F.col(column)))
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    dealt = marked.repartitionByRange(files, F.col(name), rest) if files else marked.repartitionByRange(F.col(name), rest)
    out = dealt.sortWithinPartitions(name).write
    (out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out).parquet(path)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = t if out is None else out | t
    return out


def ends_with(spark: SparkSession, path: str, column: str, suffixes: Sequence[str]) -> DataFrame:
    """The rows whose column ends with one of the suffixes, without the stored copy's own column."""
    name = derived(column, "reversed")
    tests = [F.startswith(F.col(name), F.lit(s[::-1])) if s else F.col(name).isNotNull() for s in suffixes]
    found = spark.read.parquet(path)
    return (found.filter(tests[0] if len(tests) == 1 else _any(tests)) if tests else found.limit(0)).drop(name)


def equals(spark: SparkSession, path: str, column: str, form: str, literal: str) -> DataFrame:
    """The rows whose column equals the literal in the stored form."""
    name = derived(column, form)
    return spark.read.parquet(path).filter(F.col(name) == FORMS[form][1](literal)).drop(name)
