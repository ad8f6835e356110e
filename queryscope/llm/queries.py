"""All queries of this part and their DuckDB texts."""
from queryscope.llm import queries_alignment, queries_circulant, queries_decontaminate, queries_mixing, queries_pii, queries_preferences, queries_quality, queries_simhash, queries_tokens, queries_toxicity, queries_turns, queries_urls, queries_warc  # noqa: F401
from queryscope.llm.registry import ORACLES, QUERIES  # noqa: F401
