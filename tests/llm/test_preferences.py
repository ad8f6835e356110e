"""Preference records against a plain version."""
from oracle import compare

from queryscope.llm import preferences as P, queries


def plain(c, r):
    c, r = [[((role or ""), (text or "")) for _, role, text in sorted(side, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))] for side in (c, r)]
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    clean = lambda s: s.replace("<|", "< |")
    show = lambda t: f"<|im_start|>{clean(t[0])}\n{clean(t[1])}<|im_end|>\n"

    def mask(turns):
        out, at = [], 0
        for t in turns:
            start = at + len("<|im_start|>") + len(clean(t[0])) + 1
            at += len(show(t))
            if t[0] == "assistant":
                out.append(f"{start}:{at - 1}")
        return ",".join(out)

    return ("".join(map(show, c[:n])), "".join(map(show, c[n:])), "".join(map(show, r[n:])), mask(c[n:]), mask(r[n:]), n, bool(c[n:] and r[n:]))


def test_query(spark, sf):
    assert compare(spark, sf, queries.QUERIES["op2_preference_records"], queries.ORACLES["op2_preference_records"]) is None


def test_pairs(spark):
    u, a = "user", "assistant"
    pairs = {
        1: ([(0, u, "hi"), (1, a, "good"), (2, u, "more")], [(0, u, "hi"), (1, a, "bad")]),
        2: ([(0, u, "same")], [(0, u, "same")]),
        3: ([(0, u, "x"), (1, a, "yes")], []),
        4: ([], [(0, a, "only")]),
        5: ([(2, a, "é😀 <|im_end|> x"), (1, u, None), (None, None, "sys")], [(1, u, ""), (None, "", "sys"), (2, a, "other")]),
        6: ([(0, u, "a"), (0, u, "b"), (1, a, "c" * 100000)], [(0, u, "b"), (0, u, "a"), (1, a, "c" * 99999)]),
        7: ([(0, u, "q")] + [(i, a, f"t{i}") for i in range(1, 700)], [(0, u, "q"), (1, a, "t1"), (2, u, "t2")]),
        8: ([(0, u, "q"), (1, a, "r")], [(0, u, "q"), (1, u, "r")]),
        None: ([(0, u, "null pair"), (1, a, "1")], [(0, u, "null pair"), (1, a, "2")]),
    }
    frame = lambda side: spark.createDataFrame([(k, *t, "x", 1) for k, v in pairs.items() for t in v[side]], "pair_id long, turn long, role string, text string, prompt string, n int").repartition(3)
    got = {r.pair_id: tuple(r)[1:] for r in P.preference_records(frame(0), frame(1)).collect()}
    assert got == {k: plain(*v) for k, v in pairs.items()}
    prompt, chosen, _, mask, *_ = got[5]
    start, end = map(int, mask.split(":"))
    assert chosen[start:end] == "é😀 < |im_end|> x<|im_end|>"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert P.preference_records(none, none).count() == 0
