"""Quality rules against plain versions of the counts and of the Kneser-Ney model."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from queryscope.llm import quality, queries

SMALL = "/root/testdata/sf0.01"

W = re.compile("[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = W.findall(text or "")
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(W.search(line))
        seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def plain_log_ppl(texts, order=quality.ORDER):
    """Log perplexity of each text under the model of all of them, straight from the definitions."""
    lines = [" ".join(W.findall(t or "")).lower() for t in texts]
    marked = [quality.START * (order - 1) + s + quality.END if s else "" for s in lines]
    counts = {order: Counter(m[i:i + order] for m in marked for i in range(len(m) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    v, cuts, total, weight = len(counts[1]) + 1, {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = [max(0.0, min(float(j), j - (j + 1) * y * n[j + 1] / n[j])) if y is not None and n[j] else j * 0.5 for j in (1, 2, 3)]
        total[k], weight[k] = Counter(), defaultdict(float)
        for g, x in c.items():
            total[k][g[:-1]] += x
            weight[k][g[:-1]] += cuts[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / v
        lower, t = p(g[1:]), total[k][g[:-1]]
        if not t:
            return lower
        x = counts[k][g]
        return (max(0.0, x - cuts[k][min(x, 3) - 1]) if x else 0.0) / t + weight[k][g[:-1]] / t * lower

    return [-sum(math.log(p(m[i:i + order])) for i in range(len(m) - order + 1)) / (len(m) - order + 1) if m else 0.0 for m in marked]


TEXTS = [None, "", " \t\n ", "one two", "a b c d e f g h " * 30, "x\n\nx\nx \nx\n#*$%&|<>", "Les élèves ont été là. " * 3 + "fin", "nbsp here \x1c sep", "w " * 30000, "İstanbul Straße ΑΣ " * 20, "a b c d e f g h a b c d e f g h i j k l m n o p q r s t u v w x y z",
         "z" * 100000, "the quick brown fox jumps over the lazy dog and then it runs far away from the big bad wolf of the north"]


def test_counts_and_perplexity(spark):
    rows = [(i, t, "xx" if i % 2 else None, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "xx", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").repartition(3)
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    logs = {}
    for lang in (None, "xx"):
        own = [r for r in rows if r[2] == lang]
        logs.update({r[0]: x for r, x in zip(own, plain_log_ppl([r[1] for r in own]))})
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(TEXTS[r.doc_id]), r.doc_id
        assert abs(r.log_ppl - logs[r.doc_id]) < 1e-4, (r, logs[r.doc_id])


def test_query_over_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality_rules"](spark, sf).collect()}
    exact = {r.doc_id: r.log_ppl for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), bits=31).collect()}
    assert set(got) == set(docs)
    for lang in {d.lang for d in docs.values()}:
        own = [d for d in docs.values() if d.lang == lang]
        logs = plain_log_ppl([d.text for d in own])
        for d, x in zip(own, logs):
            r = got[d.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(d.text)
            assert abs(exact[d.doc_id] - x) < 1e-4 and abs(r.log_ppl - x) < 0.01 and r.kept == (not r.base_failed and r.in_band)


def test_junk_is_out_of_its_band(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, " ".join(f"{i * 2654435761 % 2**61:x}" for i in range(60)), "en"), (-2, "qzx jjv wwk xqp " * 2 + " ".join(f"zq{i}xv" for i in range(40)), "en")], docs.schema)
    out = {r.doc_id: r for r in quality.judge(docs.union(junk)).filter("not base_failed").collect()}
    assert not out[-1].kept and not out[-2].kept
    clean = [r for k, r in out.items() if k >= 0]
    assert sum(r.kept for r in clean) > 0.99 * len(clean)


def test_other_languages_and_shuffled_letters_are_out_of_the_band(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rnd, added = random.Random(5), []
    long = [r for r in docs.filter("lang is not null").orderBy("doc_id").collect() if 60 <= len((r.text or "").split()) <= 500]
    for lang in ("de", "es", "fr"):
        added += [(-1 - len(added) - i, r.text, "en") for i, r in enumerate([r for r in long if r.lang == lang][:5])]
    added += [(-101 - i, " ".join("".join(rnd.sample(w, len(w))) for w in r.text.split()), "en") for i, r in enumerate([r for r in long if r.lang == "en"][:5])]
    out = {r.doc_id: r for r in quality.judge(docs.union(spark.createDataFrame(added, docs.schema))).collect()}
    # a Spanish list in narrow columns repeats its own grams, which are in the model
    assert len(added) == 20 and sum(out[k].in_band for k, _, _ in added) <= 1


def test_bands_follow_each_side_and_copies_count_once(spark):
    rows = [("a", 300 + i, 1.0 + i / 1000) for i in range(-100, 1)] + [("a", 300 + i, 1.0 + i / 100) for i in range(1, 101)] + [("a", 500, 1.0)] * 5000 + [("b", 9, 2.3456)] * 3
    df = spark.createDataFrame(rows, "lang string, n_words int, log_ppl double").selectExpr("lang", "n_words", "n_words word_chars", "0 n_symbols", "log_ppl")
    got = {r.lang: r for r in quality.bands(df, 2.0).collect()}
    assert abs(got["a"].low - (1 - 0.05 / 0.6745 * 2)) < 0.01 and abs(got["a"].high - (1 + 0.5 / 0.6745 * 2)) < 0.05
    assert got["b"].low <= 2.3456 <= got["b"].high and got["b"].high - got["b"].low < 0.002


def test_no_gram_is_lost_beyond_what_tasks_hold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang in ('de', 'es')").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(None, "Ein Satz ohne Kennung", "de"), (None, "zwei davon", "de"), (-1, None, "es")], docs.schema))
    rows = docs.collect()
    for handed_out in (0, 500):
        got = quality.judge(docs, handed_out=handed_out).collect()
        want = [x for lang in ("de", "es") for x in plain_log_ppl([r.text for r in rows if r.lang == lang])]
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(sorted(r.log_ppl for r in got), sorted(want)))


def test_two_to_the_24_slots_do_not_mix_grams(spark):
    codes = np.arange(0x100, 0x100 + 4 * 60000, dtype=np.uint32).reshape(-1, 4)
    assert len(np.unique(quality.slots("xx", codes, quality.HASH_BITS))) == len(codes)


def test_least_count(spark):
    model = spark.createDataFrame([(n,) for n in [1] * 10 + [2, 3, 3, 5, 9]], "n long")
    assert [quality.least_count(model, m) for m in (0, 1, 2, 4, 5, 14, 15)] == [16, 8, 4, 4, 2, 2, 1]


def test_stored_hashes_are_sorted_and_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    table = quality.arrays(quality.train(docs), bits=8)
    assert all(len(k) <= 256 and (k[1:] > k[:-1]).all() for k, _, _ in table.values())


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
