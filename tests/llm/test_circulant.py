"""Circulant MinHash groups against brute force over all pairs."""
import random

import numpy as np
import pytest

from queryscope.llm import circulant as C, queries

SMALL = "/root/testdata/sf0.01"


def plain_set(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def plain_groups(rows, n, percent=80):
    """rows: (id, text) -> (id, size, smallest id reachable), by union over all pairs of distinct sets."""
    sets = [plain_set(t, n) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)[:3]))
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for (k, _), s in zip(rows, sets):
        if s and k is not None:
            least[root(s)] = min(k, least.get(root(s), k))
    return sorted(((k, len(s), least.get(root(s)) if s else k) for (k, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_over_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = queries.QUERIES["op13_near_duplicates"](spark, SMALL)
    want = plain_groups(docs, 4)
    assert got(found) == want and len({w[2] for w in want}) < len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.3, 0.5, 0.8):
        cut = int(len(x) * share)
        agree = (C.signature(x[:cut], 4096) == C.signature(x, 4096)).mean()
        assert abs(agree - share) < 0.04
    one = C.signature(x[:1], 150)
    assert len(set(one.tolist())) == 150 and np.array_equal(C.signature(x[::-1].copy(), 150), C.signature(x, 150))


def test_family_whose_members_are_far_from_the_first(spark):
    # a chain of copies, each with a few more words changed: neighbours are similar, the ends are not
    rnd, texts = random.Random(8), []
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    for i in range(60):
        texts.append(" ".join(words))
        for _ in range(4):
            words[rnd.randrange(400)] = f"x{rnd.randrange(10**6)}"
    shared = " ".join(f"p{j}" for j in range(300))  # a passage that unlike documents share
    texts += [shared + " " + " ".join(f"{i}q{j}" for j in range(120)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(C.groups(df, words=5)) == plain_groups(rows, 5)


@pytest.mark.parametrize("blocks", [(7, 1 << 20), (1024, 900)])
def test_blocks_lose_no_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(C, "BLOCK_SETS", blocks[0])
    monkeypatch.setattr(C, "BLOCK_HASHES", blocks[1])
    rnd, rows = random.Random(4), []
    base = [f"b{j}" for j in range(100)]
    for i in range(80):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(100)] = f"c{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert got(C.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == plain_groups(rows, 4)


def test_links_within_compares_all_pairs():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**62, 5000, dtype=np.int64)
    members = [np.unique(base[:5000 - 150 * i]) for i in range(12)] + [np.unique(rnd.integers(0, 2**62, 50, dtype=np.int64))]
    found = C.links_within(members, np.arange(13), 80)
    assert {i for pair in found for i in pair} == set(range(12)) and len(found) == 11
    assert C.links_within(members[:3], np.array([5, 5, 5]), 80) == []


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A  B\nC d", "É ß x y z", "é ß x y z", "w " * 5000, "w w w w w", "x\x1cy one two", "v " * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (3, "one"), (None, "alone here"), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, keys int")
    assert got(C.groups(df, words=4)) == plain_groups(rows, 4)
    assert C.groups(df.limit(0)).count() == 0


def test_representatives(spark, tmp_path):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, None, 3), (None, "", 4), (3, "A B C D E F", 5), (4, "g h", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, ROW int").write.parquet(f"{tmp_path}/d")
    kept = C.representatives(spark.read.parquet(f"{tmp_path}/d"))
    assert kept.columns == ["doc_id", "text", "ROW"] and kept.count() == 4 and {r.ROW for r in kept.collect()} >= {3, 4, 6}


def test_buckets_with_the_same_members_are_compared_once(spark):
    rows = [(key, node, g) for key in (1, 2, 3) for node, g in ((10, 10), (11, 10), (12, 12))] + [(4, 10, 10), (4, 11, 10), (4, 13, 13)] + [(5, n, 10) for n in (10, 11, 14)]
    got = C.unlike_buckets(spark.createDataFrame(rows, "key long, node long, g long"))
    assert sorted(r.key for r in got.collect()) == [1, 4]


def test_texts_of_others_stay_out_of_the_shuffle(spark):
    numbered = spark.range(3000).selectExpr("id AS row", "concat('text ', id) AS t")
    wanted = spark.range(0, 3000, 30).withColumnRenamed("id", "row")
    found = C.wanted_texts(numbered, wanted)
    assert sorted(map(tuple, found.collect())) == [(i, f"text {i}") for i in range(0, 3000, 30)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and plan.index("LeftSemi") < plan.index("bit_or")
