"""op1: toxicity of every document. A learned score makes no SQL text; held-out accuracy and brute-force neighbours are tested."""
from queryscope.llm import toxicity
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
