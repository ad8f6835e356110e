"""op4: SimHash groups. The fingerprint makes no SQL text; a brute-force version in the tests does."""
from queryscope.llm import simhash
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op4_simhash_groups")
def op4_simhash_groups(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(found.fp).alias("fingerprint"), "component_id")
