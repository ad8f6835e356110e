"""op5: token files written and read back. A tokenizer makes no SQL text; exact round trips in the tests do."""
from queryscope.llm import token_files
from queryscope.llm.registry import query
from queryscope.workloads.registry import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_files")
def op5_token_files(spark, sf_dir):
    written = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return token_files.read_files(*written).drop("ids")
