"""op8: quality rules. Perplexity makes no SQL text; brute-force versions in the tests do."""
from queryscope.llm import quality
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))
