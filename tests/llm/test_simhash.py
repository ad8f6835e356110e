"""SimHash fingerprints and groups against brute force over all pairs."""
import random

import xxhash

from queryscope.llm import queries, simhash
from queryscope.llm.components import components


def plain_fp(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, radius=2):
    """rows: (id, fp) -> smallest id reachable, by union over all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, f in rows:
        if k is not None:
            least[root(f)] = min(k, least.get(root(f), k))
    return sorted(((k, f"{f:016x}", least.get(root(f))) for k, f in rows), key=str)


def test_query_over_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op4_simhash_groups"](spark, sf).collect()), key=str)
    assert got == plain_groups([(r.doc_id, plain_fp(r.text)) for r in docs])


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A  B\nC", "É ß x y z", "é ß x y z", "w " * 5000, "nbsp stays one", "x\x1cy one two"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "one", 7), (3, "one", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.f, r.component_id) for r in simhash.groups(df).select("doc_id", simhash.hexed("fp").alias("f"), "component_id").collect()), key=str)
    assert got == plain_groups([(k, plain_fp(t)) for k, t, _ in rows])
    assert simhash.groups(df.limit(0)).count() == 0


def test_links_of_dense_balls(spark):
    rnd, fps = random.Random(5), set()
    for _ in range(30):
        seed = rnd.getrandbits(64)
        for _ in range(20):
            f = seed
            for _ in range(rnd.randint(0, 3)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = plain_groups([(signed(f), f) for f in fps])
    least = {}
    for k, _, c in want:
        least.setdefault(c, []).append(k)
    for members in least.values():
        assert len({roots.get(m, m) for m in members}) == 1
    assert len({roots.get(signed(f), signed(f)) for f in fps}) == len(least)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (601, 600), (601, 600)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 601: 600}
