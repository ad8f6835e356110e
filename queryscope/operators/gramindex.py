"""A stored trigram index for ``LIKE '%needle%'``: posting lists by gram, probed by the rarest grams of a needle.

The index is a folder of segments, one per batch of rows. A segment has ``postings``
(gram, key) under the folder of the gram's bucket and sorted by gram within files, and
``counts`` (gram, n). A search reads the counts of the needle's grams, then the postings
of the rarest of them only: other buckets are never listed, other grams of a bucket are
skipped by the files' statistics. Rows that have all these grams are checked against the
text, so the result is that of ``LIKE``.

A needle of fewer than three characters has no gram and scans. Null texts match nothing;
rows that share a key are found together and checked one by one. A segment that failed
while being written has no mark and is not read.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 128
SPLITS = 4  # files that share a bucket's grams by the key; fixed, so no rows are sampled to find ranges
PROBES = 3  # grams whose lists are intersected; more lists cost more than the checks they save


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of a text; one linear scan, however long it is."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), 1))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def append_segment(df: DataFrame, key: str, column: str, path: str) -> str:
    """Index the rows of ``df`` as a new segment; returns its name. Existing segments stay as they are."""
    name = uuid.uuid4().hex
    grams = df.select(F.col(key).alias("key"), F.explode(trigrams(F.col(column))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    # a gram that most texts have is split over files by the key; each file is sorted, so its statistics tell its grams;
    # ranges would need a sample, for which the grams of all texts are made a second time
    dealt = grams.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPLITS))).sortWithinPartitions("bucket", "gram", "key")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings/segment={name}")
    spark = df.sparkSession
    postings = spark.read.schema(_schema(df.schema[key].dataType)).parquet(f"{path}/postings/segment={name}")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts/segment={name}")
    spark.createDataFrame([(name, key, column)], "segment string, key string, column string").coalesce(1).write.mode("append").parquet(f"{path}/segments")
    return name


def build_index(df: DataFrame, key: str, column: str, path: str) -> str:
    """The first segment of a new index at ``path``; a search of an index without rows finds nothing."""
    return append_segment(df, key, column, path)


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", kind), T.StructField("gram", T.StringType()), T.StructField("bucket", T.IntegerType())])


def segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished segments; one short row each."""
    return sorted(r.segment for r in spark.read.parquet(f"{path}/segments").select("segment").collect())


def rarest(spark: SparkSession, path: str, needle: str, probes: int = PROBES) -> list[tuple[str, int]]:
    """(gram, rows) of the needle's rarest grams over all segments; a gram that no row has counts zero."""
    grams = sorted({needle[i:i + 3] for i in range(len(needle) - 2)})
    counts = spark.read.schema("gram string, n long").parquet(*[f"{path}/counts/segment={s}" for s in segments(spark, path)])
    found = {r.gram: r.n for r in counts.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    return sorted(((g, found.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))[:probes]


def candidates(spark: SparkSession, path: str, needle: str, kind: T.DataType, probes: int = PROBES) -> DataFrame | None:
    """(key) of the rows that have the needle's rarest grams, or None where an empty list rules all rows out."""
    wanted = rarest(spark, path, needle, probes)
    if not wanted or wanted[0][1] == 0:
        return None
    grams = [g for g, _ in wanted]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).collect()]
    names = segments(spark, path)
    postings = spark.read.schema(_schema(kind)).option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/segment={s}" for s in names])
    hits = postings.filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("gram").isin(grams))
    if len(grams) == 1:
        return hits.select("key").distinct()
    return hits.groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("key")


def search(df: DataFrame, key: str, column: str, needle: str, path: str, probes: int = PROBES) -> DataFrame:
    """The rows of ``df`` whose text contains the needle, by the index at ``path``, which must cover them."""
    exact = F.contains(F.col(column), F.lit(needle))
    if len(needle) < 3:
        return df.filter(exact)
    found = candidates(df.sparkSession, path, needle, df.schema[key].dataType, probes)
    if found is None:
        return df.limit(0)
    return df.join(found.withColumnRenamed("key", key), key, "left_semi").filter(exact)
