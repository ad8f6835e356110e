"""CSV and JSON in; CSV, JSON, Parquet and INSERT statements out."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from queryscope.session import shared_folder

# --- fixed values: column names that hint at a time
TIME_HINTS = ["date", "dt", "day", "created_at", "updated_at", "timestamp"]
_BARE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def sql_type(dtype: T.DataType) -> str:
    """INTEGER, DOUBLE, BOOLEAN, TIMESTAMP or TEXT."""
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, (T.FractionalType,)):
        return "DOUBLE"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMP"
    return "TEXT"


def _hinted(name: str) -> bool:
    return any(part in re.split(r"[^a-z0-9]+", name.lower()) or name.lower() == part for part in TIME_HINTS) or any(
        name.lower().endswith(h) for h in TIME_HINTS
    )


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types; a time hint in a name counts when every value casts."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    hinted = [f.name for f in df.schema.fields if _hinted(f.name) and isinstance(f.dataType, T.StringType)]
    if not hinted:
        return df
    bad = df.agg(*[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("timestamp").isNull()).alias(n) for n in hinted]).first()
    return df.withColumns({n: F.col(n).cast("timestamp") for n in hinted if bad[n] == 0})


def quote_name(name: str) -> str:
    return name if _BARE.match(name) else f'"{name}"'


def infer_ddl(df: DataFrame, name: str = "data") -> str:
    """``CREATE TABLE`` text for the columns of a frame."""
    if not df.columns:
        return f"CREATE TABLE IF NOT EXISTS {name} (empty INT);"
    cols = ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in df.schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols});"


def export(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists") -> dict:
    """Write once and count the rows on the way."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = watched.write.mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
    return {"format": fmt, "rows_written": seen.get["rows"], "path": path}


def literal(field: T.StructField) -> Column:
    """A value as SQL text."""
    col, kind = F.col(f"`{field.name}`"), sql_type(field.dataType)
    if kind in ("INTEGER", "DOUBLE"):
        text = col.cast("string")
    elif kind == "BOOLEAN":
        text = F.when(col, "TRUE").otherwise("FALSE")
    elif kind == "TIMESTAMP":
        text = F.concat(F.lit("'"), col.cast("string"), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(col.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(col.isNull(), "NULL").otherwise(text)


def render_inserts(df: DataFrame, name: str, key: str, batch: int = 500) -> DataFrame:
    """One INSERT per ``batch`` rows in key order: (batch_no, sql).

    Rows are range-partitioned by key and numbered inside their part; a part's
    first batch starts where the counts of the parts before it end, so no task
    sees more than its own rows. ``key`` must be unique. The parts are stored in the
    shared folder because their two readers must see the same ones.
    """
    cols = ", ".join(quote_name(f.name) for f in df.schema.fields)
    row = F.concat(F.lit("  ("), F.concat_ws(", ", *[literal(f) for f in df.schema.fields]), F.lit(")"))
    rows = df.select(F.col(key).alias("__k"), row.alias("__row"))
    ranged = rows.repartitionByRange("__k").withColumn("__part", F.spark_partition_id())
    path = shared_folder(df.sparkSession, "inserts")
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    placed = ranged.join(starts, "__part")  # one row per part
    at = F.col("__start") + F.row_number().over(W.partitionBy("__part").orderBy("__k")) - 1
    numbered = placed.withColumn("__at", at).withColumn("batch_no", F.floor(F.col("__at") / batch))
    packed = numbered.groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("__at", "__row"))).alias("x"))  # `batch` rows each
    body = F.array_join(F.transform("x", lambda v: v["__row"]), ",\n")
    return packed.select("batch_no", F.concat(F.lit(f"INSERT INTO {quote_name(name)} ({cols})\nVALUES\n"), body, F.lit(";")).alias("sql"))
