"""Conversation repair against a plain search over all edits."""
import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from queryscope.llm import queries, turn_repair as R
from queryscope.llm.queries_turns import repaired

SMALL = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) in order -> counts, cost, audit, digest."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    # behind system 1, behind user 2, behind assistant 3
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    n = len(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == n and state in (0, 3) else []
        if inserts < 2:
            c, a, rest = best(i, step[state], inserts + 1)
            found.append((c + 3, "I" + a, ((names[step[state]], ""), *rest)))
        if i < n:
            _, role, text = rows[i]
            c, a, rest = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, rest))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                for to in ({"s": [1] if state == 0 else [], "u": [2] if state != 2 else [], "a": [3] if state == 2 else []}.get(role[:1], [])):
                    c, a, rest = best(i + 1, to, 0)
                    found.append((c + more, "K" + a, ((role, text), *rest)))
                c, a, rest = best(i + 1, step[state], 0)
                found.append((c + more + 3, "R" + a, ((names[step[state]], text), *rest)))
        return min(found, default=(10**9, "~", ()))

    cost, audit, lines = best(0, 0, 0)
    initials = [r[1][:1] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()), lines


def plain(rows, damage=True):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in plain_damage(rows) if damage else rows:
        by[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {k: plain_repair(sorted(v, key=order)) for k, v in by.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def drawn(seed, n, roles="suaux"):
    rnd, names = random.Random(seed), {"s": "system", "u": "user", "a": "assistant", "x": "tool", "e": "", "A": "Assistant"}
    return [(7, i if rnd.random() > 0.1 else i - 1, names[rnd.choice(roles)], rnd.choice(["", "  ", "same.", "open", f"t{i}.", f"t{i}?\n", f"t{i}"])) for i in range(n)]


def test_query_over_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_turn_repair"](spark, SMALL)) == {k: v[0] for k, v in plain(rows).items()}


@pytest.mark.parametrize("bits", [1, 12])
def test_long_conversations_in_chunks(spark, monkeypatch, bits):
    # with two rows a chunk, passes and maps run over hundreds of chunks
    monkeypatch.setattr(R, "CHUNK_BITS", bits)
    rows = [r for c in range(3) for r in [(c, *x[1:]) for x in drawn(c, 300, ("suaux", "ua", "xxxu")[c])]]
    rows += [(9, i, "user", f"q{i}.") for i in range(40)] + [(10, i, "tool", f"q{i}.") for i in range(41)] + [(11, i, "system", f"s{i}.") for i in range(9)]
    repair = R.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = plain(rows, damage=False)
    assert got(repair.summary()) == {k: v[0] for k, v in want.items()}
    lines = {k: [] for k in want}
    for r in repair.rows().orderBy("conv_id", "at").collect():
        lines[r.conv_id].append((r.role, r.text))
    assert lines == {k: list(v[1]) for k, v in want.items()}


def test_rerun_stops_where_passes_run_parallel():
    rnd = random.Random(2)
    for _ in range(300):
        codes = "".join(rnd.choice("suaxSUAX0123") for _ in range(rnd.randint(1, 30)))
        ends = [R.level(tuple(rnd.randint(0, 9) for _ in range(4))) for _ in range(2)]
        old = R.backward(codes, ends[0])[0]
        assert R.rerun(codes, ends[0], ends[1], old) == R.backward(codes, ends[1])[0]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "", "b."), (2, 1, "system", "x."), (3, 9, "Assistant", "y"),
            (4, 1, "user", "w " * 200_000), (4, 2, "assistant", "é" * 50_000 + "."), (5, 1, "user", ""), (6, 1, None, "c."), (6, 1, "user", None), (-8, 2, "user", "q?"), (-8, 4, "assistant", "r!\t")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"line {t}.") for c in range(100, 140) for t in range(5)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, c int")
    assert got(repaired(frame)) == {k: v[0] for k, v in plain(rows).items()}
    assert got(R.Repair(frame).summary()) == {k: v[0] for k, v in plain(rows, damage=False).items()}
    assert repaired(frame.limit(0)).count() == 0 and R.Repair(frame.limit(0)).rows().count() == 0
