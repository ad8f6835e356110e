"""The catalog of known columns, read from schemas."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

CATALOG_SCHEMA = "schema string, `table` string, `column` string"


def catalog_from(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "main") -> DataFrame:
    """(schema, table, column) in lower case for the given frames; no data is read."""
    rows = [(schema.lower(), t.lower(), col.lower()) for t, df in tables.items() for col in df.columns]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def session_catalog(spark: SparkSession) -> DataFrame:
    """The same for every table and view the session knows."""
    rows = [
        ((t.namespace or ["main"])[-1].lower(), t.name.lower(), col.name.lower())
        for t in spark.catalog.listTables()
        for col in spark.catalog.listColumns(t.name)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
