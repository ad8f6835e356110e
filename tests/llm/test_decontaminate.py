"""Benchmark matches against a plain dynamic program over all pairs."""
import random

import numpy as np

from queryscope.llm import decontaminate as D
from queryscope.llm import queries

SMALL = "/root/testdata/sf0.01"


def plain_best(item, text):
    """Fewest edits between the item and any part of the text, row by row."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        base = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        new = np.empty(len(text) + 1, int)
        new[0] = i
        new[1:] = base
        steps = np.arange(len(text) + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def plain_matches(docs, items):
    out = []
    for k, t in docs:
        for i, b in items:
            p = D.plain(b)
            if p and D.plain(t):
                d = plain_best(p, D.plain(t))
                if d <= D.budget(len(p)):
                    out.append((k, i, d))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in D.matches(d, b, **kw).collect()), key=str)


def edited(rnd, s, n):
    for _ in range(n):
        at, what = rnd.randrange(len(s) or 1), rnd.randrange(3)
        s = s[:at] + rnd.choice("abc é") * (what != 1) + s[at + (what != 0):]
    return s


def test_myers_against_rows():
    rnd = random.Random(1)
    for _ in range(300):
        item = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 60))) + edited(rnd, item, rnd.randint(0, 8)) + "ba"
        assert D.Pattern(item).best(text, 99) == plain_best(item, text)


def test_edited_passages(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randint(4, 50)).capitalize()) for i in range(12)] + [(50, None), (51, " "), (52, "a"), (53, "xyzq")]
    items += [(60, items[0][1])]
    docs = [(0, None), (1, ""), (2, "xyzq"), (3, "x" * 50000)]
    for k in range(4, 60):
        i, t = items[k % 12]
        docs.append((k, f"{prose(20)}\n\n{edited(rnd, t.upper(), rnd.randint(0, D.budget(len(t)) + 2))}  {prose(15)}"))
    docs += [docs[10], docs[10], (None, items[3][1].replace(" ", "\n"))]
    assert run(spark, docs, items) == plain_matches(docs, items)
    assert run(spark, docs, items, chars=200) == plain_matches(docs, items)  # several blocks


def test_query_over_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op6_benchmark_matches"](spark, SMALL).collect())
    texts = {k: D.plain(t) for k, t in docs}
    whole = {(k, i) for k, t in texts.items() for i, b in items if D.plain(b) in t}
    assert whole == {(k, i) for k, i, d in got if d == 0} and whole
    assert all(plain_best(D.plain(dict(items)[i]), texts[k]) == d for k, i, d in got)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "some text")]) == []
    assert run(spark, [(1, "some text")], []) == []
