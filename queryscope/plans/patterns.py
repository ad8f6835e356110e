"""Rules as data: patterns over a statement's tokens, compiled to an automaton that runs as a fold.

A pattern is built of ``tok`` (words), ``text`` (a regular expression on the token),
``any_token``, ``seq``, ``alt``, ``opt``, ``many`` and ``gap``. Every place where a pattern
names a token becomes a state. Which states a token may enter is a bit mask made by
column expressions on the token's row; the fold over a statement's masks then only
moves between states. It remembers where each state's match began, reports the leftmost
of the shortest matches and starts anew behind it, so matches do not overlap.

Tokens are already dealt by script, and a statement is a part of one script, so running
any number of patterns takes no further shuffle. A statement's masks are one array.
Malformed statements are left out, as they are for the other rules.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Node:
    """A part of a pattern: ``kind`` with the parts below it, or a token test for ``one``."""

    kind: str
    parts: tuple["Node", ...] = ()
    test: tuple[str, ...] = ()


def tok(*words: str) -> Node:
    """One of these tokens, in any case."""
    return Node("one", test=("words", *sorted(w.upper() for w in words)))


def text(pattern: str) -> Node:
    """A token whose text the regular expression finds."""
    return Node("one", test=("like", pattern))


def any_token() -> Node:
    return Node("one", test=("any",))


def seq(*parts: Node) -> Node:
    return Node("seq", parts)


def alt(*parts: Node) -> Node:
    return Node("alt", parts)


def opt(part: Node) -> Node:
    return Node("opt", (part,))


def many(part: Node) -> Node:
    """The part any number of times, also none."""
    return Node("many", (part,))


def gap(most: int) -> Node:
    """Up to ``most`` tokens of any kind."""
    return seq(*[opt(any_token())] * most)


@dataclass(frozen=True)
class Automaton:
    """States are the token places of a pattern: what each tests, which come first and last, and which may come before each."""

    tests: tuple[tuple[str, ...], ...]
    first: frozenset[int]
    last: frozenset[int]
    before: tuple[frozenset[int], ...]


def compiled(pattern: Node) -> Automaton:
    tests: list[tuple[str, ...]] = []
    pairs: set[tuple[int, int]] = set()

    def walk(node: Node) -> tuple[set[int], set[int], bool]:
        """(first places, last places, whether it may be empty) of a part."""
        if node.kind == "one":
            tests.append(node.test)
            return {len(tests) - 1}, {len(tests) - 1}, False
        found = [walk(p) for p in node.parts]
        if node.kind == "alt":
            return set().union(*(f for f, _, _ in found)), set().union(*(e for _, e, _ in found)), any(n for _, _, n in found)
        if node.kind in ("opt", "many"):
            first, last, _ = found[0]
            if node.kind == "many":
                pairs.update((a, b) for a in last for b in first)
            return first, last, True
        first, last, empty = set(), set(), True
        for f, e, n in found:
            pairs.update((a, b) for a in last for b in f)
            first = first | f if empty else first
            last = last | e if n else e
            empty = empty and n
        return first, last, empty

    first, last, empty = walk(pattern)
    if empty:
        raise ValueError("the pattern matches without a token")
    return Automaton(tuple(tests), frozenset(first), frozenset(last), tuple(frozenset(a for a, b in pairs if b == s) for s in range(len(tests))))


@dataclass(frozen=True)
class PatternRule:
    """``find`` is the pattern; the other fields are those of any rule."""

    rule_id: str
    severity: str
    title: str
    find: Node
    message: str
    fix: str | None = None


def _test(test: tuple[str, ...]) -> Column:
    kind, *args = test
    if kind == "any":
        return F.lit(True)
    return F.upper("tok").isin(args) if kind == "words" else c("tok").rlike(args[0])


def _matches(steps: Column, masks: str, automaton: Automaton, bit: dict[tuple[str, ...], int]) -> Column:
    """(first, last) token numbers of the matches in an array of (pos, masks)."""
    places = range(len(automaton.tests))
    none = F.lit(None).cast("int")
    start = F.struct(F.array(*[none for _ in places]).alias("began"), F.array().cast("array<struct<first:int,last:int>>").alias("found"))

    def step(acc: Column, token: Column) -> Column:
        entered = []
        for s in places:
            ways = [F.get(acc["began"], F.lit(q)) for q in sorted(automaton.before[s])] + ([token["pos"]] if s in automaton.first else [])
            way = F.least(*ways) if len(ways) > 1 else ways[0] if ways else none
            entered.append(F.when(token[masks].bitwiseAND(1 << bit[automaton.tests[s]]) != 0, way))
        ends = [entered[s] for s in sorted(automaton.last)]
        hit = F.least(*ends) if len(ends) > 1 else ends[0]
        began = F.when(hit.isNull(), F.array(*entered)).otherwise(F.array(*[none for _ in places]))
        found = F.when(hit.isNull(), acc["found"]).otherwise(F.array_append(acc["found"], F.struct(hit.alias("first"), token["pos"].alias("last"))))
        return F.struct(began.alias("began"), found.alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def find_patterns(annotated: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """(script_id, stmt_no, rule_id, severity, title, message, suggested_fix, line, col, matched) of every match.

    ``matched`` is the text of the match's tokens with one space between them; line and col are those of its first token.
    """
    automata = [compiled(r.find) for r in rules]
    tests = sorted({t for a in automata for t in a.tests})
    if len(tests) > 62:
        raise ValueError("more than 62 different token tests in one run")
    bit = {t: i for i, t in enumerate(tests)}
    mask = F.lit(0).cast("long")
    for t, i in bit.items():
        mask = mask + F.when(F.coalesce(_test(t), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = annotated.filter((c("kind") != "end") & ~c("stmt_broken")).select("script_id", "stmt_no", F.struct(c("pos").cast("int").alias("at"), mask.alias("m"), "tok", "line", "col").alias("t"))
    own = rows.groupBy("script_id", "stmt_no").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    steps = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t["m"].alias("m")))

    def said(rule: PatternRule, automaton: Automaton) -> Column:
        texts = {"rule_id": rule.rule_id, "severity": rule.severity, "title": rule.title, "message": rule.message, "suggested_fix": rule.fix}
        facts = [F.lit(v).cast("string").alias(n) for n, v in texts.items()]
        return F.transform(_matches(c("steps"), "m", automaton, bit), lambda m: F.struct(*facts, m["first"].alias("first"), m["last"].alias("last")))

    hits = own.withColumn("steps", steps).select("script_id", "stmt_no", "tokens", F.explode(F.flatten(F.array(*[said(r, a) for r, a in zip(rules, automata)]))).alias("h"))
    begin = F.get("tokens", c("h.first"))
    words = F.transform(F.slice("tokens", c("h.first") + 1, c("h.last") - c("h.first") + 1), lambda t: t["tok"])
    return hits.select("script_id", "stmt_no", "h.rule_id", "h.severity", "h.title", "h.message", "h.suggested_fix", begin["line"].alias("line"), begin["col"].alias("col"), F.array_join(words, " ").alias("matched"))


PATTERNS = [
    PatternRule("SQL-LIKE-001", "MEDIUM", "Pattern starts with a wildcard", seq(tok("LIKE", "ILIKE"), text("^'%")),
                "A leading % leaves no prefix to search by.", "Anchor a prefix, or search a reversed or trigram column."),
    PatternRule("SQL-NOTIN-001", "HIGH", "NOT IN over a subquery", seq(tok("NOT"), tok("IN"), tok("("), tok("SELECT", "WITH")),
                "One NULL in the subquery makes NOT IN return no rows.", "Use NOT EXISTS or an anti join."),
    PatternRule("SQL-WILD-001", "MEDIUM", "Star projection", seq(tok("SELECT", "DISTINCT", "ALL", ",", "."), tok("*")),
                "SELECT * reads every column.", "List the columns that are used."),
]
