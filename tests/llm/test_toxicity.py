"""Toxicity: exact neighbours, calibration, held-out accuracy and odd rows."""
import math
import random
import zlib

import numpy as np

from queryscope.llm import queries, toxicity as T


def plain_nearest(counts, examples, k):
    df = {}
    for c in examples:
        for f in c:
            df[f] = df.get(f, 0) + 1
    idf = {f: math.log((1 + len(examples)) / (1 + n)) + 1 for f, n in df.items()}

    def unit(c):
        v = {f: (1 + math.log(n)) * idf[f] for f, n in c.items() if f in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()} if size else {}

    q = unit(counts)
    sims = [sum(w * q.get(f, 0) for f, w in unit(c).items()) for c in examples]
    return sorted((s for s in sims if s > 0), reverse=True)[:k]


def test_neighbours_are_exact():
    rnd = random.Random(3)
    make = lambda: {f"f{min(int(rnd.expovariate(0.08)), 60)}": rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))}
    examples = [make() for _ in range(700)]
    index = T.Index.build(list(range(700)), [rnd.randint(0, 1) for _ in examples], examples)
    skipped = 0
    for _ in range(200):
        q = make()
        at, sim = index.nearest(q, 15)
        assert np.allclose(sim, plain_nearest(q, examples, 15))
        bound = np.zeros(-(-700 // T.BLOCK))
        for f, w in T.Index._unit({f: n for f, n in q.items() if f in index.lists}, index.idf).items():
            bound[index.lists[f][2]] += w * index.lists[f][4]
        skipped += int((bound < (sim[-1] if len(sim) else 0)).sum())
    assert skipped > 0  # block maxima rule blocks out
    assert len(index.nearest({"unknown": 1})[0]) == 0


def test_isotonic_rises():
    x = np.array([0, 0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.9])
    knots, values = T.isotonic(x, np.array([0, 0, 1, 0, 0, 1, 1, 1.0]), np.ones(8))
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all() and values[0] < 0.1 < 0.9 < values[-1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    tried = [(got[k].predicted, y) for k, y in labels.items() if k in got and got[k].held_out]
    hit, flagged, toxic = sum(p and y for p, y in tried), sum(p for p, _ in tried), sum(y for _, y in tried)
    assert hit / flagged > 0.95 and hit / toxic > 0.8, (hit, flagged, toxic)
    # scores mean what they say
    for low, high in ((0, 0.1), (0.9, 1.01)):
        own = [(got[k].score, y) for k, y in labels.items() if got[k].held_out and low <= got[k].score < high]
        assert abs(np.mean([s for s, _ in own]) - np.mean([y for _, y in own])) < 0.05


def test_odd_rows(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(12))
    base = [(i, f"{prose()} you idiot and moron {prose()}" if i % 4 == 0 else f"{prose()} a fine day {prose()}", None) for i in range(400)]
    odd = [(1000, None, None), (1001, "", None), (1002, "IDIOT! moron?", None), (1003, "idiot " * 50000, None), (None, "such a moron and idiot", None), (1002, "a fine day", None)]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 0), (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = T.score(docs, labels).collect()
    assert len(got) == 406
    by = {(r.doc_id, r.score > 0.5) for r in got}
    assert (1000, False) in by and (1001, False) in by and (1002, True) in by and (1002, False) in by and (1003, True) in by and (None, True) in by
    assert sum((r.score > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400) > 395
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    assert {r.score for r in T.score(docs, one).collect()} <= {0.0, 1.0}
    assert T.score(docs.limit(0), none).count() == 0
