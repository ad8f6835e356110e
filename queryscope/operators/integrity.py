"""Content hashes over rows in a canonical form."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_hash(df: DataFrame, columns: Sequence[str], name: str = "row_hash") -> DataFrame:
    return df.withColumn(name, F.sha2(canonical_json(columns), 256))


def verify_hash(df: DataFrame, columns: Sequence[str], stored: str) -> DataFrame:
    """Add ``intact``: the stored hash equals the row's own."""
    return df.withColumn("intact", F.coalesce(F.sha2(canonical_json(columns), 256) == F.col(stored), F.lit(False)))
