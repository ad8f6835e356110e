"""Helpers the operators share: stored intermediates and files in the shared folder."""
from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame

from queryscope.session import shared_folder


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and lost executors cost nothing already stored."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_runs(texts: list, most: int = 2_000_000):
    """(first, after last) of runs of texts with at most ``most`` characters; a longer text is a run of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def file_system(uri: str):
    """(file system, path) of a URI, for tasks that read and write files which Spark has no format for."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def unused(df: DataFrame, name: str, taken: list[str] = ()) -> str:
    """``name``, with underscores until neither ``df`` nor ``taken`` has it in any case."""
    while name.lower() in {c.lower() for c in [*df.columns, *taken]}:
        name = f"{name}_"
    return name
