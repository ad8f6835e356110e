"""Quality rules: counts over words and lines, and perplexity bands of a modified Kneser-Ney model per language.

The model is over characters: lower-cased words joined by one space, between
start and end marks. Spark counts the grams of all documents; discounts,
continuation counts and interpolated probabilities are joins over distinct grams.
Every gram is kept, under a hash of ``HASH_BITS`` bits. The documents scored are the
ones counted, so each of their grams is in the model and nothing backs off.

The most frequent grams, at most ``HANDED_OUT``, are sorted arrays that every task
gets. Grams of a document that are not among them are stored as (hash, count) beside
the document's own counts, joined with the rest of the model and summed per document.

A document outside its language's band is rejected. The band reaches ``WIDTH`` robust
deviations from the median log perplexity to either side, and each side has its own
deviation, measured over all documents of the language. A null text has no words; a null
language is a language of its own. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import stored, text_runs

ORDER = 4
HASH_BITS = 63
HANDED_OUT = 2**22  # grams in the tasks' memory (16 bytes each); the others are joined
WIDTH = 6.0
QUARTILE = 0.6745  # standard deviations from the median to a quartile
START, END = "\x02", "\x03"
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _line(words: list[bytes]) -> str:
    return b" ".join(words).decode().lower()


def _coded(lines: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines with their marks, and the end of each line in them."""
    marked = [START * (order - 1) + line + END for line in lines]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    return codes, np.cumsum([len(m) for m in marked])


def _grams(codes: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the gram at each predicted place, first place of each distinct gram, places in each line)."""
    import pandas as pd

    at = np.ones(len(codes) - order + 1, bool)
    for k in range(1, order):  # grams do not run over the end of a line
        at[ends[:-1] - k] = False
    at = np.flatnonzero(at)
    key = np.zeros(len(at), np.uint64)
    for k in range(order):
        key = (key ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    which, _ = pd.factorize(key)
    first = np.empty(which.max() + 1 if len(which) else 0, np.int64)
    first[which[::-1]] = at[::-1]
    return which, first, np.diff(np.concatenate([[0], ends])) - (order - 1)


def _by_lang(langs: list) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        found.setdefault(lang, []).append(i)
    return found


def slots(lang: str, codes: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each row of code points, in ``bits`` bits."""
    h = np.full(len(codes), _lang_hash(lang), np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _lang_hash(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode(), 7)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); each task adds up before the shuffle."""

    def work(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in text_runs(texts):
                lines = [_line(words_of(t)) for t in texts[a:z]]
                for lang, rows in _by_lang(langs[a:z]).items():
                    own = [lines[i] for i in rows if lines[i]]
                    if own:
                        codes, ends = _coded(own, order)
                        which, first, _ = _grams(codes, ends, order)
                        text = codes[first[:, None] + np.arange(order)].tobytes().decode("utf-32-le")
                        grams = [text[i:i + order] for i in range(0, len(text), order)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(np.bincount(which))], names=["lang", "gram", "n"])

    return docs.mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the numbers of grams seen 1 to 4 times."""
    c = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"c{k}") for k in range(1, 5)])
    y = F.try_divide("c1", F.col("c1") + 2 * F.col("c2"))
    own = [k - (k + 1) * y * F.try_divide(f"c{k + 1}", f"c{k}") for k in (1, 2, 3)]
    d = [F.when(x.isNull(), k * 0.5).otherwise(F.greatest(F.lit(0.0), F.least(x, F.lit(float(k))))) for k, x in enumerate(own, 1)]
    return c.select("lang", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)])


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(order, lang, gram, n, logp): interpolated log probabilities of all grams of the highest order."""
    counts = {order: stored(count_grams(docs, order), "grams")}
    for k in range(order - 1, 0, -1):  # how many grams a shorter one continues
        counts[k] = counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    shared = lambda: F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    size = counts[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
    below = None
    for k in range(1, order + 1):
        cut = counts[k].join(_discounts(counts[k]), "lang")
        cut = cut.select("lang", "gram", "n", shared().alias("d"), F.substring("gram", 1, k - 1).alias("ctx"), F.substring("gram", 2, k - 1).alias("suffix"))
        context = cut.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("w"))
        seen = cut.join(context, ["lang", "ctx"])
        if below is None:
            seen = seen.join(size, "lang").withColumn("lower", 1 / F.col("v"))
        else:
            seen = seen.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        below = stored(seen.select("lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("w") * F.col("lower")).alias("p")), f"kn-{k}")
    return below.select(F.lit(order).alias("order"), "lang", "gram", "n", F.log("p").alias("logp"))


def hashed(model: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """(order, slot, n, logp) with one row for each hash."""

    def work(batches):
        for b in batches:
            orders, langs, grams = (b.column(i).to_pylist() for i in range(3))
            out = np.zeros(len(orders), np.int64)
            for (k, lang), rows in _by_lang(list(zip(orders, langs))).items():
                codes = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), k)
                out[rows] = slots(lang, codes, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), b.column(3), b.column(4)], names=["order", "slot", "n", "logp"])

    rows = model.select("order", "lang", "gram", "n", "logp").mapInArrow(work, "order int, slot long, n long, logp double")
    return rows.groupBy("order", "slot").agg(F.max(F.struct("n", "logp")).alias("m")).select("order", "slot", "m.n", "m.logp")


def least_count(model: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` grams have that count or more."""
    sizes = {r.e: r["count"] for r in model.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least and (total := total + sizes.get(least - 1, 0)) <= most:
        least -= 1
    return 2**least


def arrays(model: DataFrame, bits: int = HASH_BITS) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """order -> (sorted hashes, counts, logp)."""
    return sorted_arrays(hashed(model, bits))


def sorted_arrays(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    got = rows.select("order", "slot", "n", "logp").toArrow()
    orders, slot, n, logp = (got.column(i).to_numpy() for i in range(4))
    out = {}
    for k in np.unique(orders).tolist():
        own = np.flatnonzero(orders == k)
        own = own[np.argsort(slot[own], kind="stable")]
        out[k] = (slot[own], n[own], logp[own])
    return out


def repeated_words(hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For runs of word hashes of the given lengths: words inside windows that occur twice or more in their run."""
    import pandas as pd

    n = len(hashes)
    run = np.repeat(np.arange(len(lengths)), lengths)
    if n < window:
        return np.zeros(len(lengths), np.int64)
    m = n - window + 1
    key = np.zeros(m, np.uint64)
    h = hashes.view(np.uint64)
    for k in range(window):
        key = (key ^ h[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    at = np.flatnonzero(run[:m] == run[window - 1:])
    if not len(at):
        return np.zeros(len(lengths), np.int64)
    key = (key[at] ^ run[at].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    which, _ = pd.factorize(key)
    twice = at[np.bincount(which)[which] > 1]
    edge = np.bincount(twice, minlength=n + 1) - np.bincount(twice + window, minlength=n + 1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(run[covered], minlength=len(lengths))


def measure(docs: DataFrame, table: tuple[np.ndarray, np.ndarray], order: int = ORDER, bits: int = HASH_BITS) -> DataFrame:
    """Every row of (k, lang, text) with its counts, in one pass over the texts.

    ``places`` are the predicted symbols, ``known`` is the sum of log p of those in ``table``
    (sorted hashes, logp); ``rest`` and ``times`` have the hashes and counts of the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sums(langs, lines):
        keys, logp = shared.value
        known, places = np.zeros(len(lines)), np.zeros(len(lines), np.int64)
        rest, times = [np.empty(0, np.int64)] * len(lines), [np.empty(0, np.int64)] * len(lines)
        for lang, rows in _by_lang(langs).items():
            at = [i for i in rows if lines[i]]
            if not at:
                continue
            codes, ends = _coded([lines[i] for i in at], order)
            which, first, n = _grams(codes, ends, order)
            slot = slots(lang, codes[first[:, None] + np.arange(order)], bits).astype(np.int64)
            near = np.minimum(np.searchsorted(keys, slot), max(len(keys) - 1, 0))
            hit = keys[near] == slot if len(keys) else np.zeros(len(slot), bool)
            value = np.where(hit, logp[near], 0.0) if len(keys) else np.zeros(len(slot))
            starts = np.concatenate([[0], np.cumsum(n)])
            known[at], places[at] = np.add.reduceat(value[which], starts[:-1]), n
            if not hit.all():
                for i, a, z in zip(at, starts[:-1], starts[1:]):
                    rest[i], times[i] = np.unique(slot[which[a:z][~hit[which[a:z]]]], return_counts=True)
        return known, places, rest, times

    def duplicate_lines(text):
        seen, n = set(), 0
        for line in text.split("\n"):
            if line in seen:
                n += bool(line.encode().split())
            else:
                seen.add(line)
        return n

    def work(batches):
        for b in batches:
            langs, whole = b.column(1).to_pylist(), [t or "" for t in b.column(2).to_pylist()]
            for a, z in text_runs(whole):
                texts = whole[a:z]
                words = [words_of(t) for t in texts]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                hashes = np.fromiter((hash(x) for w in words for x in w), np.int64, int(lengths.sum()))
                chars = [len(b"".join(w).decode()) for w in words]
                lines = [_line(w) for w in words]
                del words
                symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
                known, places, rest, times = sums(langs[a:z], lines)
                columns = [lengths, np.array(chars, np.int64), np.array(symbols, np.int64), np.array([duplicate_lines(t) for t in texts], np.int64), repeated_words(hashes, lengths), known, places]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *map(pa.array, columns), *(pa.array(x, pa.list_(pa.int64())) for x in (rest, times))], names=["k", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "known", "places", "rest", "times"])

    return docs.mapInArrow(work, "k long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, known double, places long, rest array<long>, times array<long>")


def perplexities(measured: DataFrame, rest: DataFrame | None) -> DataFrame:
    """Stored rows of ``measure`` with ``log_ppl``; ``rest`` is the part of the model that was not handed out."""
    logs = F.when(F.col("places") > 0, -F.col("known") / F.col("places")).otherwise(0.0)
    if rest is None:
        return measured.drop("rest", "times").select("*", logs.alias("log_ppl"))
    grams = measured.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("g")).select("row", "g.rest", "g.times")
    found = grams.join(rest.select("slot", "logp"), F.col("rest") == F.col("slot"))
    sums = found.groupBy(F.col("row").alias("r")).agg(F.sum(F.col("times") * F.col("logp")).alias("more"))
    whole = measured.drop("rest", "times").join(sums, F.col("row") == F.col("r"), "left").drop("r")
    return stored(whole.withColumn("known", F.col("known") + F.coalesce("more", F.lit(0.0))).select("*", logs.alias("log_ppl")), "measured-whole")


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang, low, high) of the log perplexity, from all documents with words; thousandths keep the exact quantiles small.

    Copies count once: a text that makes up half of a language does not set its spread to nothing.
    """
    once = measured.filter("n_words > 0").select("lang", "n_words", "word_chars", "n_symbols", F.round("log_ppl", 3).alias("x")).distinct()
    q = once.groupBy("lang").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    low, mid, high = (F.col("q")[i] for i in range(3))
    rounding = 0.0005 + 1e-9
    return q.select("lang", (mid - (mid - low) / QUARTILE * width - rounding).alias("low"), (mid + (high - mid) / QUARTILE * width + rounding).alias("high"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, bits: int = HASH_BITS, width: float = WIDTH, handed_out: int = HANDED_OUT) -> DataFrame:
    """Per row: the counts, ``base_failed``, ``log_ppl``, ``in_band`` and ``kept``."""
    docs = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    model = stored(hashed(train(docs.select("lang", "text"), order), bits), "kn-hashed")
    least = least_count(model, handed_out)
    keys, _, logp = sorted_arrays(model.filter(F.col("n") >= least)).get(order, (np.empty(0, np.int64),) * 3)
    measured = stored(measure(docs, (keys, logp), order, bits).withColumn("row", F.monotonically_increasing_id()), "measured")
    measured = perplexities(measured, model.filter(F.col("n") < least) if least > 1 else None)
    limits = bands(measured, width).select(F.col("lang").alias("l"), "low", "high")
    out = measured.join(limits, F.col("lang") == F.col("l"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", inside.alias("in_band"),
    )
