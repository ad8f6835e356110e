"""The stored trigram index against LIKE, what a search reads, and appended segments."""
import pytest
from pyspark.sql import functions as F

from queryscope.operators import gramindex as G
from queryscope.workloads.registry import table


@pytest.fixture(scope="module")
def built(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    docs = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "key", "lang": "gram"})
    G.build_index(docs.filter("key % 3 <> 0"), "key", "text", path)
    G.append_segment(docs.filter("key % 3 = 0"), "key", "text", path)
    return docs, path


def keys(df):
    return sorted(r.key for r in df.collect())


@pytest.mark.parametrize("needle", ["ation", "the ", "tion.\n", "é", "", "zzzzqqq", "a%b", "Licensed under", "th"])
def test_equal_to_like(built, needle):
    docs, path = built
    assert keys(G.search(docs, "key", "text", needle, path)) == keys(docs.filter(F.contains("text", F.lit(needle))))


def test_only_the_needles_grams_are_read(spark, built):
    docs, path = built
    total = spark.read.parquet(f"{path}/postings").count()
    wanted = G.rarest(spark, path, "ntentions", 2)
    assert len(wanted) == 2 and wanted[0][1] <= wanted[1][1]
    found = G.candidates(spark, path, "ntentions", docs.schema["key"].dataType, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    read = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin([g for g, _ in wanted])).count()
    assert read == sum(n for _, n in wanted) and read < total / 100


def test_unfinished_segment_is_not_read(spark, built):
    docs, path = built
    before = G.segments(spark, path)
    docs.limit(1).select("key", F.lit("abc").alias("gram"), F.lit(1).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/postings/segment=lost")
    assert G.segments(spark, path) == before and len(before) == 2
    assert keys(G.search(docs, "key", "text", "ation", path)) == keys(docs.filter(F.contains("text", F.lit("ation"))))


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "abcabc"), (1, "xabcdx"), (2, None), (3, ""), (4, "ab"), (None, "abcd"), (5, "ABCD" * 50_000 + "abcd"), (6, "\nabcd\n")], "k long, t string")
    G.build_index(df, "k", "t", f"{tmp_path}/g")
    assert sorted((r.k, len(r.t)) for r in G.search(df, "k", "t", "abcd", f"{tmp_path}/g").collect()) == [(1, 6), (5, 200_004), (6, 6)]
    G.build_index(df.limit(0), "k", "t", f"{tmp_path}/e")
    assert G.search(df.limit(0), "k", "t", "abcd", f"{tmp_path}/e").count() == 0


def test_the_grams_of_a_text_are_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = spark.range(50).select(F.col("id"), read(F.concat(F.lit("abcdef"), F.col("id"))).alias("t"))
    G.append_segment(rows, "id", "t", str(tmp_path / "grams"))
    assert seen.value == 50
