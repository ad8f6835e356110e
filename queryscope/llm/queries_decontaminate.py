"""op6: benchmark items in documents. Edit matching over whole texts is too slow in SQL; brute force in the tests does."""
from queryscope.llm import decontaminate
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op6_benchmark_matches")
def op6_benchmark_matches(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
