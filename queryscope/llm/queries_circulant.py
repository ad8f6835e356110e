"""op13: near duplicates of four-word sets. The sets make no SQL text of bearable cost; a brute-force version in the tests does."""
from pyspark.sql import functions as F

from queryscope.llm import circulant
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op13_near_duplicates")
def op13_near_duplicates(spark, sf_dir):
    found = circulant.groups(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
