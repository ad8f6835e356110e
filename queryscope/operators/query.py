"""Running SQL, binding parameters and shaping results for a grid or a chart."""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREVIEW_ROWS = 5


def run_sql(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """The relational surface: any Spark SQL text over the session's views."""
    return spark.sql(sql, args=dict(args)) if args else spark.sql(sql)


def run_sql_safe(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, preview: int = PREVIEW_ROWS) -> dict[str, Any]:
    """Run and never raise: columns, types, a short preview and the row count, or the error."""
    try:
        df = run_sql(spark, sql, args)
        rows = [r.asDict(recursive=True) for r in df.limit(preview).collect()]
        return {"ok": True, "columns": df.columns, "types": [t for _, t in df.dtypes], "rows": rows, "row_count": df.count(), "error": None, "error_type": None}
    except PySparkException as err:
        return {"ok": False, "columns": [], "types": [], "rows": [], "row_count": 0, "error": str(err), "error_type": type(err).__name__}


_COLON = r"(?<!:):([A-Za-z_][A-Za-z0-9_]*)"
_BRACES = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"


def find_params(sql: str | Column) -> Column:
    """Distinct parameter names: ``:name`` first, then ``{{name}}``, in order of first use."""
    return F.array_distinct(F.concat(F.regexp_extract_all(sql, F.lit(_COLON), 1), F.regexp_extract_all(sql, F.lit(_BRACES), 1)))


def bind_params(spark: SparkSession, sql: str, values: Mapping[str, Any]) -> DataFrame:
    """Bind by name in the plan; the values never become SQL text."""
    import re

    return spark.sql(re.sub(_BRACES, r":\1", sql), args={k: v for k, v in values.items() if v != ""})


def bind_text(sql: Column, values: Mapping[str, str]) -> Column:
    """Fill placeholders in a column of SQL texts; an empty value leaves its placeholder."""
    out = sql
    for name, value in values.items():
        if value == "":
            continue
        literal = "'" + value.replace("'", "''") + "'"
        safe = literal.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, rf"(?<!:):{name}(?![A-Za-z0-9_])", safe)
        out = F.regexp_replace(out, rf"\{{\{{\s*{name}\s*\}}\}}", safe)
    return out


def grid_sort(df: DataFrame, column: str, ascending: bool = True, key: str | None = None) -> DataFrame:
    """Ascending puts nulls last, descending puts them first; ``key`` settles ties."""
    col = F.col(column)
    order = [col.asc_nulls_last() if ascending else col.desc_nulls_first()]
    return df.orderBy(*order, *([F.col(key)] if key else []))


def normalize_columns(df: DataFrame, limit: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Give unnamed results the names col1..colN and cap the rows shown."""
    out = df.toDF(*(names or [f"col{i + 1}" for i in range(len(df.columns))]))
    return out if limit is None else out.limit(limit)


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def chart_series(df: DataFrame) -> DataFrame:
    """Label, value and share of the total, from the first fitting columns.

    The total is a one-row aggregate read as a scalar, so no global window pulls
    the rows into one task.
    """
    numeric = [f.name for f in df.schema.fields if _numeric(f.dataType)]
    if not numeric:
        raise ValueError("no numeric column to chart")
    label = next((f.name for f in df.schema.fields if f.name not in numeric), df.columns[0])
    points = df.select(
        F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"),
        F.coalesce(F.col(numeric[0]).try_cast("double"), F.lit(0.0)).alias("value"),
    )
    total = points.agg(F.sum("value")).scalar()
    return points.withColumn("share", F.try_divide(F.col("value") * 100, total))
