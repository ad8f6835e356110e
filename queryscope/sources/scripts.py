"""Reading SQL scripts and compiled model folders."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOM = "^﻿"


def _glob_regex(glob: str) -> str:
    """A path glob as a pattern for ``rlike``: ``*`` any text, ``?`` one character, ``[..]`` a set."""
    out = []
    for part in re.split(r"(\*+|\?|\[[^\]]*\])", glob):
        if part.startswith("*"):
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part.startswith("["):
            out.append(part.replace("[!", "[^"))
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"


def _excluded(path: Column, excludes: Sequence[str]) -> Column:
    name = F.substring_index(path, "/", -1)
    hit = F.lit(False)
    for g in excludes:
        hit = hit | path.rlike(_glob_regex(g)) | name.rlike(_glob_regex(g))
    return hit


def _is_file(spark: SparkSession, target: str) -> bool | None:
    """True for a file, False for a folder, None when a plain path does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return bool(fs.getFileStatus(path).isFile())


def _glob_regex(glob: str) -> str:
    """A pattern for whole paths: ``**/`` is any number of folders, ``*`` and ``?`` stay inside one name."""
    marks = {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*|\?|\[[^]]*\])", re.sub("^file:/+", "/", glob))
    return "(^|/)" + "".join(marks.get(p) or (p if p.startswith("[") else re.escape(p)) for p in parts).lstrip("/") + "$"


def scan_scripts(spark: SparkSession, targets: Sequence[str], excludes: Sequence[str] = (), dialect: str = "duckdb") -> DataFrame:
    """``scripts`` from folders (every ``*.sql`` below), files or globs.

    Each path is read once, a byte order mark is dropped, bytes that are not UTF-8
    are replaced, and a missing target is an error. Excludes match the whole path
    or the base name.
    """
    frames = []
    for target in targets:
        reader = spark.read.format("binaryFile")
        if any(ch in target for ch in "*?["):
            root, below, _ = target.partition("**/")
            last = target.rpartition("/")[2]
            reader = reader.option("pathGlobFilter", last if "." in last else "*.sql")
            if below:  # listed below the fixed part, then the whole path must fit
                frames.append(reader.option("recursiveFileLookup", "true").load(root or ".").select("path", "content").filter(F.col("path").rlike(_glob_regex(target))))
                continue
        else:
            kind = _is_file(spark, target)
            if kind is None:
                raise FileNotFoundError(target)
            if not kind:
                reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql")
        frames.append(reader.load(target).select("path", "content"))
    files = frames[0]
    for f in frames[1:]:
        files = files.unionByName(f)
    path = F.regexp_replace("path", "^file:/+", "/")
    files = files.withColumn("path", path).filter(~_excluded(F.col("path"), excludes))
    unique = files.groupBy("path").agg(F.first("content").alias("content")) if len(targets) > 1 else files
    return unique.select(
        F.xxhash64("path").alias("script_id"), "path", F.lit(dialect).alias("dialect"),
        F.regexp_replace(F.expr("string(content)"), _BOM, "").alias("sql"),
    )


def scan_compiled_models(spark: SparkSession, target: str, dialect: str = "duckdb") -> DataFrame:
    """The compiled models below ``<target>/compiled``; the folder must exist and may be empty."""
    folder = target.rstrip("/") + "/compiled"
    if _is_file(spark, folder) is not False:
        raise FileNotFoundError(folder)
    return scan_scripts(spark, [folder], dialect=dialect)


def project_root(spark: SparkSession, path: str) -> str | None:
    """The nearest folder at or above ``path`` that holds ``dbt_project.yml``."""
    current = path.rstrip("/")
    while current:
        if _is_file(spark, f"{current}/dbt_project.yml"):
            return current
        current = current.rpartition("/")[0]
    return None
