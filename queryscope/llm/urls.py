"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with listed URLs.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is not listed: it is allowed. Repeated rows stay repeated, an empty list blocks
nothing, and columns of the pages other than the id and the url are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of the filter: at most so many blocks of 256 bits (about 120 bytes each as rows of a
# broadcast table, 16 MB in all). A longer list only lets more pages through to the exact join.
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 16

# --- fixed values: query parameters that do not change a page -------------------------
TRACKING = ["utm_[^=&]*", "ref", "gclid", "fbclid"]


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*+)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*+([^?#]*+)", 1)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without ``www.`` and a usual port, path without a last ``/``, sorted query without tracking; no scheme, no fragment.

    Null where there is no host.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*+[^?#]*+\?([^#]*+)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({'|'.join(TRACKING)})(=|$)")))
    plain = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, "/$", ""), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (host, path) rule that fits, as text, or null; between equal lengths the longer host."""
    pick = F
    for h, p in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        pick = pick.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p))
    return pick.otherwise(None) if rules else F.lit(None).cast("string")


def _places(hash64: Column, n_blocks: Column) -> tuple[Column, list[Column]]:
    """The block of a hash and the one bit it sets in each of the block's eight words."""
    block = F.pmod(hash64, n_blocks)
    second = F.xxhash64(hash64)
    return block, [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(31).cast("int")) for i in range(8)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as rows of (block, w0..w7), at most ``n_blocks`` of them; equal blocks are merged before the shuffle."""
    block, bits = _places(F.xxhash64(key), F.lit(n_blocks))
    return listed.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def filter_blocks(n: int, max_blocks: int) -> int:
    """Blocks of a filter of ``n`` keys: a power of two, bounded whatever ``n``."""
    return min(max_blocks, 1 << max(0, n // KEYS_PER_BLOCK).bit_length())


def passing(rows: DataFrame, column: str, listed: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows whose ``column`` a broadcast filter of ``listed`` lets through before anything is shuffled: all that are listed, and few others.

    ``listed`` is read twice, so it should be a stored table; ``rows`` must not have columns ``block``, ``b``, ``w0`` to ``w7``.
    """
    n_blocks = filter_blocks(listed.count(), max_blocks)
    block, bits = _places(F.xxhash64(column), F.lit(n_blocks))
    found = rows.withColumn("block", block).join(F.broadcast(bloom_blocks(listed, key, n_blocks).withColumnRenamed("block", "b")), F.col("block") == F.col("b"))
    for i, bit in enumerate(bits):
        found = found.filter(F.col(f"w{i}").bitwiseAND(bit) != 0)
    return found.select(*rows.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", listed_url: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Per page: id, host, path, rule, verdict, listed.

    ``rules`` are (verdict, host, path); they are part of the plan, like any setting.
    A page that no rule fits is blocked when its canonical URL is listed. The filter
    is broadcast, its size is bounded by ``max_blocks`` whatever the list's length;
    pages it passes are joined with the list itself, so its errors never show.
    """
    verdicts = {h + p: v for v, h, p in rules}
    fit = matching_rule(F.col("host"), F.col("path"), [(h, p) for _, h, p in rules])
    parts = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("u"))
    parts = parts.select("k", "host", "path", fit.alias("rule"), canonical(F.col("u"), F.col("host"), F.col("path")).alias("canon"))

    raw = listed.select(F.col(listed_url).alias("u")).select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    names = raw.select(canonical(F.col("u"), F.col("h"), F.col("p")).alias("canon")).filter("canon is not null").distinct()
    n_blocks = filter_blocks(names.count(), max_blocks)

    block, bits = _places(F.xxhash64("canon"), F.lit(n_blocks))
    probe = parts.withColumn("block", F.when(F.col("rule").isNull() & F.col("canon").isNotNull(), block))
    probe = probe.join(F.broadcast(bloom_blocks(names, "canon", n_blocks).withColumnRenamed("block", "b")), F.col("block") == F.col("b"), "left")
    maybe = F.lit(True)
    for i, bit in enumerate(bits):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probe = probe.select("k", "host", "path", "rule", "canon", F.coalesce(F.col("b").isNotNull() & maybe, F.lit(False)).alias("maybe"))

    sure = probe.filter(~F.col("maybe")).select("k", "host", "path", "rule", F.lit(False).alias("listed"))
    hits = probe.filter("maybe").join(names.select(F.col("canon").alias("c")).hint("shuffle_hash"), F.col("canon") == F.col("c"), "left")
    hits = hits.select("k", "host", "path", "rule", F.col("c").isNotNull().alias("listed"))
    own = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])[F.col("rule")] if verdicts else F.lit(None).cast("string")
    verdict = F.coalesce(own, F.when(F.col("listed"), "block").otherwise("allow"))
    return sure.unionByName(hits).select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), "listed")
