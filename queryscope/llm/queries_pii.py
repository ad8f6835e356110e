"""op9: personal data. Offsets and checksums make no SQL text; a brute-force version in the tests does."""
from queryscope.llm import pii
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op9_personal_data")
def op9_personal_data(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))
