"""op12: two tokenizers aligned. Tokenizers make no SQL text; a plain version in the tests does."""
from queryscope.llm import token_align
from queryscope.llm.queries_tokens import vocabulary
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    return token_align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
