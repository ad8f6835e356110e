"""Findings kept by version, so that a run tokenizes only texts that no earlier run has seen.

The store is a folder. Every run that meets new texts adds a version with ``known``
(fp, the fingerprints it read), ``findings`` (fp and the finding), and ``filter``, a
blocked Bloom filter of all fingerprints so far. A version counts once its row in
``versions`` is written, which is the last thing a run does: a run that failed leaves
nothing that is read. Versions belong to a name of the rules; a change of rules takes a new name.

Texts that the filter has never seen go straight to the rules. Of the others only the
fingerprints are compared with the known ones, so known texts are never shuffled. The
filter has a fixed number of blocks; a store that outgrows it compares more fingerprints and stays exact.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscope.plans import lint

BLOCKS, WORDS = 1 << 16, 8  # of 32 used bits each: at most 65,536 rows of a block number and 8 words, about 5 MB


def _places(fp: Column) -> tuple[Column, list[Column]]:
    """The block of a fingerprint and the bit it sets in each of the block's words."""
    h = F.xxhash64(fp)
    bits = F.xxhash64(h)
    return F.pmod(h, F.lit(BLOCKS)), [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)]


def _merged(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_of(fps: DataFrame) -> DataFrame:
    """(block, w0..w7) of a list of fingerprints; equal blocks merge in the tasks first."""
    block, bits = _places(F.col("fp"))
    return _merged(fps.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]))


def maybe_known(rows: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """The rows with a flag: false where the filter has certainly not seen ``fp``. The filter has at most ``BLOCKS`` rows and is sent to all tasks."""
    block, bits = _places(F.col("fp"))
    hit = F.col("w0").isNotNull()
    for i, bit in enumerate(bits):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = rows.withColumn("__b", block).join(F.broadcast(blocks), F.col("__b") == F.col("block"), "left")
    return probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


class FindingsStore:
    """A store at ``path`` for the rules called ``rules_name``."""

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[lint.Rule] = lint.DEFAULT_RULES, rules_name: str = "default"):
        self.spark, self.path, self.rules, self.rules_name = spark, path.rstrip("/"), rules, rules_name

    def versions(self) -> list[str]:
        """Finished versions, oldest first; one short row each."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/versions").filter(F.col("rules_name") == self.rules_name).collect()
        except AnalysisException:  # no run has finished yet
            return []
        return [r.version for r in sorted(rows, key=lambda r: r.number)]

    def _read(self, part: str, versions: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{part}/{v}" for v in versions])

    def unseen(self, scripts: DataFrame) -> DataFrame:
        """(script_id as fingerprint, dialect, sql): each distinct text that no version has read."""
        versions = self.versions()
        if not versions:
            return lint.distinct_scripts(scripts)
        marked = maybe_known(scripts.select(lint.fingerprint(F.col("dialect"), F.col("sql")).alias("fp"), "dialect", "sql"), self._read("filter", versions[-1:]), "maybe")
        fps = marked.filter("maybe").select("fp").distinct()
        mistaken = fps.join(self._read("known", versions), "fp", "left_anti")
        late = marked.filter("maybe").join(mistaken, "fp", "left_semi")
        return lint.distinct_scripts(marked.filter("not maybe").unionByName(late).drop("fp", "maybe"))

    def update(self, scripts: DataFrame) -> int:
        """Lint the unseen texts and keep what was found as a new version; returns how many texts were new."""
        versions, name = self.versions(), uuid.uuid4().hex
        new = self.unseen(scripts)
        new.write.parquet(f"{self.path}/texts/{name}")
        texts = self.spark.read.parquet(f"{self.path}/texts/{name}")
        n = texts.count()
        if n == 0 and versions:
            return 0
        found = lint.find(lint.annotate_scripts(texts, self.rules), self.rules).withColumnRenamed("script_id", "fp")
        found.write.parquet(f"{self.path}/findings/{name}")
        fps = texts.select(F.col("script_id").alias("fp"))
        fps.write.parquet(f"{self.path}/known/{name}")
        blocks = filter_of(fps)
        if versions:
            blocks = _merged(blocks.unionByName(self._read("filter", versions[-1:])))
        blocks.coalesce(1).write.parquet(f"{self.path}/filter/{name}")
        mark = [(name, len(versions), self.rules_name, n)]
        self.spark.createDataFrame(mark, "version string, number int, rules_name string, texts long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return n

    def findings(self, scripts: DataFrame) -> DataFrame:
        """The findings of every script, as ``lint.lint_corpus`` gives them, from the store; all texts must have been read."""
        ids = scripts.select(lint.fingerprint(F.col("dialect"), F.col("sql")).alias("fp"), "script_id")
        return lint.to_copies(ids, self._read("findings", self.versions()))


def lint_incremental(scripts: DataFrame, path: str, rules: Sequence[lint.Rule] = lint.DEFAULT_RULES, rules_name: str = "default") -> DataFrame:
    """Findings for every script; only texts that the store at ``path`` has not seen are tokenized.

    One run writes at a time; runs that only read may go on beside it.
    """
    store = FindingsStore(scripts.sparkSession, path, rules, rules_name)
    store.update(scripts)
    return store.findings(scripts)
