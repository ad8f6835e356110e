"""A training corpus from ``documents``: toxicity, near duplicates, benchmark leaks, mixture, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
its result is written as Parquet and read again. All but the last return the columns
of the documents they get.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscope.llm import circulant, decontaminate, mixing, simhash, token_files, toxicity
from queryscope.llm.common import stored, unused
from queryscope.llm.components import components
from queryscope.llm.queries_mixing import POWERS, topic
from queryscope.llm.queries_tokens import vocabulary
from queryscope.workloads.registry import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "toxicity_score"), unused(docs, "toxicity_neighbours")
    scored = toxicity.with_scores(docs, model, "text", names)
    return scored.filter(F.col(names[0]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within two bits, or five-word sets of similarity 0.8, link together.

    Ball hashing finds copies and the nearest copies; similarity 0.8 lies beyond its radius, so sets of words add those links.
    Rows are numbered as they are read, so ``docs`` must be a stored table.
    """
    row = unused(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    texts = numbered.select(F.col(row).alias("k"), F.col("text").alias("t"))
    linked = simhash.groups(texts, "k", "t").select("k", "component_id").unionByName(circulant.groups(texts, "k", "t", words=5, percent=80).select("k", "component_id"))
    roots = components(linked.select(F.col("k").alias("a"), F.col("component_id").alias("b")), "near-duplicates")
    return numbered.join(roots.filter("node <> root").select(F.col("node").alias(row)), row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled for the target shares of sources, languages and topics."""
    mixed, names = mixing.mixed(docs, topic(), POWERS)
    return mixed.filter(F.col(names[-1])).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read_files(*token_files.write_tokens(docs, vocabulary())).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixture", sample_mixture),
    ("tokens", write_tokens),
]

# Learned scores, fingerprints and tokens make no SQL text; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
