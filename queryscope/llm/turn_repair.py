"""Conversation repair by the cheapest edits: rank-convergence parallel Viterbi over chunks of rows.

A conversation is read by turn (nulls first, then role and text). Rows are kept,
reroled to user or assistant, or deleted; rows with empty text are inserted, so that the
roles read system at most once and first, then user and assistant in turn, assistant
last, or nothing at all. Of the cheapest edits those are chosen whose initials, in
order, are least in ASCII. Roles are told by their first character; a role that is empty
or begins otherwise can be reroled or deleted.

Rows are sorted by range, so a conversation of any length lies in many partitions, and
numbered; every ``CHUNK`` row numbers make a chunk. What is left to pay behind a row is
a vector of four costs, one per state:
1. every chunk computes the vectors of its rows from the end, from a speculative end;
2. passes run again, in all chunks at once, where the next chunk's first vector differs
   from the assumed one by more than a constant, and stop within a chunk where the new
   vectors run parallel to the old, until no chunk changes;
3. every chunk is traced from each state it may begin in; these maps from first to last
   state are composed in doubling steps, which tells every chunk its state;
4. each chunk then gives its part of the edits.

Only the final reading of a conversation, which hashes or lists the repaired rows in
order, is one stream per conversation, in bounded memory; a hash has no other way.

Null roles and texts count as one space, null conversation ids as one conversation, null
turns come first. Blank rows and repeated (role, text) must go; a text that does not end
in ``. ! ?`` costs more to keep. Repeated rows are repeated rows of a conversation. Columns
other than the four are not read. A conversation without rows gives no row here.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm.common import stored

CHUNK_BITS = 12  # a chunk has at most 2 to this power rows
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# states: nothing yet, behind system, behind user, behind assistant
STATES = 4
NEXT = (2, 2, 3, 2)  # the state that the next alternating role leads to
ROLES = {2: "user", 3: "assistant"}
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = {"su", "ua", "au"}
# one character per row: role's initial (x for others), capital if truncated, digit if it must go
CLASSES, GONE = "suax", "0123"

_SPACE = r"\x20\x09-\x0D"
Vector = tuple[int, int, int, int]
END: Vector = (0, 6, 3, 0)  # what a conversation's end leaves to pay


def _closed(e: list[float]) -> Vector:
    """Costs once rows may be inserted before going on."""
    user, assistant = min(e[2], INSERT + e[3]), min(e[3], INSERT + e[2])
    return min(e[0], INSERT + user), min(e[1], INSERT + user), user, assistant


@lru_cache(1 << 16)
def before(code: str, after: Vector) -> Vector:
    """The vector before a row, from that behind it."""
    out = []
    for s in range(STATES):
        least = DELETE + after[s]
        if code not in GONE:
            more = TRUNCATED if code.isupper() else 0
            least = min(least, REROLE + more + after[NEXT[s]])
            kept = KEEPS.get((code.lower(), s))
            if kept is not None:
                least = min(least, more + after[kept])
        out.append(least)
    return _closed(out)


def level(v: Vector) -> Vector:
    """The vector less its smallest cost: two vectors that differ by a constant are then equal."""
    least = min(v)
    return tuple(x - least for x in v)


def backward(codes: str, end: Vector) -> list[Vector]:
    """The vectors before each row, and the end's as the last, each less its smallest cost."""
    out = [end]
    for code in reversed(codes):
        out.append(level(before(code, out[-1])))
    return out[::-1]


def rerun(codes: str, old_end: Vector, new_end: Vector, old_start: Vector) -> Vector:
    """The first vector for a new end; as soon as both passes run parallel the old one holds."""
    old, new = old_end, new_end
    for code in reversed(codes):
        if old == new:
            return old_start
        old, new = level(before(code, old)), level(before(code, new))
    return new


def trace(codes: str, end: Vector, state: int, last: bool) -> tuple[str, int]:
    """(initials of the edits, state at the end): at each step the least initial that costs no more than the best."""
    vectors, out, i = backward(codes, end), [], 0
    # levelled vectors hide constants, so each step compares its choices among themselves
    while i < len(codes):
        code, after, kept = codes[i], vectors[i + 1], None
        more = TRUNCATED if code.isupper() else 0
        choices = [(DELETE + after[state], "D", state)]
        if code not in GONE:
            kept = KEEPS.get((code.lower(), state))
            if kept is not None:
                choices.append((more + after[kept], "K", kept))
            choices.append((REROLE + more + after[NEXT[state]], "R", NEXT[state]))
        inserted = INSERT + before(code, after)[NEXT[state]]
        cost, edit, to = min([*choices, (inserted, "I", NEXT[state])], key=lambda c: (c[0], c[1]))
        out.append(edit)
        state = to
        i += edit != "I"
    while last and state in (1, 2):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def cost_of(codes: str, audit: str) -> int:
    """What the edits of a run of rows cost."""
    price, i = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}, 0
    total = 0
    for edit in audit:
        total += price[edit]
        if edit != "I":
            total += TRUNCATED if codes[i].isupper() and edit != "D" else 0
            i += 1
    return total


def illegal_pairs(initials: str) -> int:
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


def _initials(codes: str) -> str:
    return "".join(CLASSES[GONE.index(c)] if c in GONE else c.lower() for c in codes)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE}]")


def is_open(text: Column) -> Column:
    """Whether the last character that is not white space is none of ``. ! ?``."""
    return ~text.rlike(rf"[.!?][{_SPACE}]*+\z")


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Stored (c, turn, role, text, pos): rows in order, numbered so that a larger number is a later row."""
    c = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    plain = rows.select(c.alias("c"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    order = ["c", "turn", "role", "text"]
    return stored(plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "turns", compression="zstd")


def coded(turns: DataFrame) -> DataFrame:
    """Stored (c, turn, pos, fault, code) of every row; a row is no duplicate if it is the first of its role and text."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = turns.groupBy("c", same.alias("same")).agg(F.min("pos").alias("first")).select("first")
    seen = turns.select("c", "turn", "pos", F.substring("role", 1, 1).alias("initial"), is_blank(F.col("text")).alias("blank"), is_open(F.col("text")).alias("open"))
    seen = seen.join(firsts, F.col("pos") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(fault.isin("blank", "duplicate"), F.translate(kind, CLASSES, GONE)).when(fault == "truncated", F.upper(kind)).otherwise(kind)
    return stored(seen.select("c", "turn", "pos", fault.alias("fault"), code.alias("code")), "turn-codes")


def chunks(codes: DataFrame) -> DataFrame:
    """Stored (c, idx, last, pos, prev, codes): the chunks of each conversation in order; ``prev`` is the code before the chunk."""
    part = F.shiftright("pos", CHUNK_BITS)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    whole = codes.groupBy("c", part.alias("part")).agg(F.min("pos").alias("pos"), listed.alias("codes"))
    # the window reads one short row per chunk, without the codes
    ends = codes.groupBy("c", part.alias("p")).agg(F.max_by("code", "pos").alias("tail"))
    order = Window.partitionBy("c").orderBy("p")
    ends = ends.select(F.col("c").alias("d"), "p", F.row_number().over(order).alias("idx"), F.lead("p").over(order).isNull().alias("last"), F.coalesce(F.lag("tail").over(order), F.lit("")).alias("prev"))
    return stored(whole.join(ends, (F.col("c") == F.col("d")) & (F.col("part") == F.col("p"))).select("c", "idx", "last", "pos", "prev", "codes"), "turn-chunks")


_VECTOR = pa.list_(pa.int32())


def _mapped(df: DataFrame, fn, schema: str, kinds: list) -> DataFrame:
    """``fn`` of each row's values, in Arrow batches."""
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def work(batches):
        for b in batches:
            out = [fn(*row) for row in zip(*[col.to_pylist() for col in b.columns])]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return df.mapInArrow(work, schema)


def converged(parts: DataFrame) -> DataFrame:
    """(c, idx, last, codes, end) with end vectors that are right but for a constant; stored pass by pass."""
    schema, kinds = "c string, idx int, last boolean, codes string, end array<int>, start array<int>, changed boolean", [pa.string(), pa.int32(), pa.bool_(), pa.string(), _VECTOR, _VECTOR, pa.bool_()]
    now = stored(_mapped(parts.select("c", "idx", "last", "codes"), lambda c, i, last, codes: (c, i, last, codes, END, backward(codes, END)[0], True), schema, kinds), "turn-pass")

    def again(c, i, last, codes, end, start, true_end):
        old, new = tuple(end), tuple(true_end or end)
        if old == new:
            return c, i, last, codes, end, start, False
        found = rerun(codes, old, new, tuple(start))
        return c, i, last, codes, new, found, list(found) != start

    while True:
        behind = now.select(F.col("c").alias("d"), (F.col("idx") - 1).alias("at"), F.col("start").alias("true_end"))
        both = now.drop("changed").join(behind, (F.col("c") == F.col("d")) & (F.col("idx") == F.col("at")), "left")
        now = stored(_mapped(both.select("c", "idx", "last", "codes", "end", "start", "true_end"), again, schema, kinds), "turn-pass")
        if now.filter("changed").isEmpty():
            return now.select("c", "idx", "last", "codes", "end")


def entered(parts: DataFrame) -> DataFrame:
    """(c, idx, state): the state each chunk but a conversation's first begins in, from maps that are composed in doubling steps."""

    def exits(c, i, last, codes, end):
        starts = (0,) if i == 1 else range(STATES)
        to = [trace(codes, tuple(end), s, False)[1] for s in starts]
        return c, i, to * STATES if i == 1 else to

    now = stored(_mapped(parts, exits, "c string, idx int, to array<int>", [pa.string(), pa.int32(), _VECTOR]), "turn-maps")
    step = 1
    while not now.filter(F.array_min("to") != F.array_max("to")).isEmpty():
        earlier = now.select(F.col("c").alias("d"), (F.col("idx") + step).alias("at"), F.col("to").alias("first"))
        both = now.join(earlier, (F.col("c") == F.col("d")) & (F.col("idx") == F.col("at")), "left")
        then = F.when(F.col("first").isNull(), F.col("to")).otherwise(F.transform("first", lambda s: F.get("to", s)))
        now = stored(both.select("c", "idx", then.alias("to")), "turn-maps")
        step *= 2
    return now.select("c", (F.col("idx") + 1).alias("idx"), F.get("to", F.lit(0)).alias("state"))


def audited(parts: DataFrame) -> DataFrame:
    """Stored (c, idx, pos, state, audit, cost, illegal) of every chunk."""
    schema = "c string, idx int, pos long, state int, audit string, cost long, illegal long"
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def edits(c, i, last, pos, prev, codes, end, state):
        audit, _ = trace(codes, tuple(end), state, last)
        return c, i, pos, state, audit, cost_of(codes, audit), illegal_pairs(_initials(prev + codes))

    def whole(c, i, last, pos, prev, codes):
        return edits(c, i, last, pos, prev, codes, END, 0)

    names = ["c", "idx", "last", "pos", "prev", "codes"]
    alone = (F.col("idx") == 1) & F.col("last")
    out = _mapped(parts.filter(alone).select(*names), whole, schema, kinds)
    several = parts.filter(~alone)
    if not several.isEmpty():
        ends = converged(several)
        states = entered(ends).withColumnsRenamed({"c": "c2", "idx": "i2"})
        right = ends.select(F.col("c").alias("c1"), F.col("idx").alias("i1"), "end")
        both = several.join(right, (F.col("c") == F.col("c1")) & (F.col("idx") == F.col("i1")))
        both = both.join(states, (F.col("c") == F.col("c2")) & (F.col("idx") == F.col("i2")), "left")
        out = out.unionByName(_mapped(both.select(*names, "end", F.coalesce("state", F.lit(0)).alias("state")), edits, schema, kinds))
    return stored(out, "turn-audits")


def _edited(batches):
    """(c, edit, role, text) of every repaired row, and (c, None, None, None) where a conversation ends, from rows (c, pos, kind, state, role, text) in order.

    Chunks (kind 0) bring the edits of the rows behind them.
    """
    own, edits, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at, state = at + 1, NEXT[state]
            yield own, "I", ROLES[state], ""

    for b in batches:
        for c, _, kind, first, role, text in zip(*[col.to_pylist() for col in b.columns]):
            if kind == 0:
                if own is not None and c != own:
                    yield from inserted()
                    yield own, None, None, None
                own, edits, at, state = c, text, 0, first
                continue
            yield from inserted()
            edit = edits[at]
            at += 1
            if edit == "R":
                state = NEXT[state]
                yield own, "R", ROLES[state], text
            elif edit == "K":
                state = KEEPS[role[:1], state]
                yield own, "K", role, text
    if own is not None:
        yield from inserted()
        yield own, None, None, None


def _in_order(turns: DataFrame, audits: DataFrame) -> DataFrame:
    given = audits.select("c", "pos", F.lit(0).alias("kind"), "state", F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    rows = turns.select("c", "pos", F.lit(1).alias("kind"), F.lit(0).alias("state"), "role", "text")
    return given.unionByName(rows).repartition("c").sortWithinPartitions("c", "pos", "kind")


def _rows_of(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(c, at, edit, role, text) of all repaired rows in their new order."""

    def work(batches):
        held, at = [], 0
        for c, edit, role, text in _edited(batches):
            at = at + 1 if edit else 0
            if edit:
                held.append((c, at - 1, edit, role, text))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["c", "at", "edit", "role", "text"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["c", "at", "edit", "role", "text"])

    return _in_order(turns, audits).mapInArrow(work, "c string, at long, edit string, role string, text string")


def _digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(c, repaired_sha256) of the repaired ``role:text`` lines."""

    def work(batches):
        out, digest, more = [], hashlib.sha256(), False
        for c, edit, role, text in _edited(batches):
            if edit:
                digest.update((("\n" if more else "") + f"{role}:{text}").encode())
                more = True
            else:
                out.append((c, digest.hexdigest()))
                digest, more = hashlib.sha256(), False
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], names=["c", "repaired_sha256"])

    return _in_order(turns, audits).mapInArrow(work, "c string, repaired_sha256 string")


class Repair:
    """The repair of a table of rows; intermediates are stored once and serve both outputs."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.kind, self.conv = rows.schema[conv].dataType, conv
        self.turns = numbered(rows, conv, turn, role, text)
        self.codes = coded(self.turns)
        self.audits = audited(chunks(self.codes))

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("c", F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(self.kind)).withColumnRenamed("c", self.conv)

    def rows(self) -> DataFrame:
        """(conv, at, edit, role, text): the repaired conversations, with the initial of the edit that made each row."""
        return self._named(_rows_of(self.turns, self.audits))

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows."""
        count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
        faults = self.codes.groupBy("c").agg(count("blank"), count("duplicate"), count("truncated"))
        apart = self.codes.filter("turn is not null").groupBy("c", "turn").count().groupBy(F.col("c").alias("g")).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "audit"))), lambda x: x["audit"]), "")
        edits = self.audits.groupBy(F.col("c").alias("e")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), text.alias("audit"))
        digests = _digests(self.turns, self.audits).withColumnRenamed("c", "h")
        out = faults.join(apart, F.col("c") == F.col("g"), "left").join(edits, F.col("c") == F.col("e")).join(digests, F.col("c") == F.col("h"))
        return self._named(out.select("c", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
