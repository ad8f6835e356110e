"""Safe rewrites of SQL text, found on the token table and applied as patches.

Each rule finds spans of text by their tokens, then builds the new text from the
span with patterns. A span that does not have the exact shape is left alone, so a
rewrite never guesses.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queryscope.plans import lint
from queryscope.plans.tokens import annotate, tokenize

c = F.col

_COLUMN = r"((?:[A-Za-z_][A-Za-z0-9_$]*\.)?[A-Za-z_][A-Za-z0-9_$]*)"
_YEAR_OF = rf"(?:YEAR\s*\(\s*{_COLUMN}\s*\)|EXTRACT\s*\(\s*YEAR\s+FROM\s+{_COLUMN}\s*\))"
_YEAR_LEFT = rf"(?i)^{_YEAR_OF}\s*=\s*([0-9]{{1,4}})$"
_YEAR_RIGHT = rf"(?i)^([0-9]{{1,4}})\s*=\s*{_YEAR_OF}$"
_DAY_LEFT = rf"(?i)^DATE\s*\(\s*{_COLUMN}\s*\)\s*=\s*'([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})'$"
_DAY_RIGHT = rf"(?i)^'([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})'\s*=\s*DATE\s*\(\s*{_COLUMN}\s*\)$"
_NOT_IN = (
    r"(?is)^([A-Za-z_][A-Za-z0-9_$]*)\.([A-Za-z_][A-Za-z0-9_$]*)\s+NOT\s+IN\s*\(\s*SELECT\s+" + _COLUMN
    + r"\s+FROM\s+([A-Za-z_][A-Za-z0-9_$.]*)((?:\s+AS)?\s+(?!WHERE\b)[A-Za-z_][A-Za-z0-9_$]*)?(?:\s+WHERE\s+(.*?))?\s*\)$"
)
_NOT_IN_HEAD = r"(?is)^[A-Za-z_][A-Za-z0-9_$]*\.[A-Za-z_][A-Za-z0-9_$]*\s+NOT\s+IN\s*\(\s*SELECT\s+" + _COLUMN
_BLOCKED = r"(?is)\b(?:GROUP|HAVING|QUALIFY|LIMIT|OFFSET|FETCH|WINDOW|ORDER|UNION|INTERSECT|EXCEPT|JOIN|LATERAL|WITH)\b|--|/\*"


_SEP = "\u0001"


def _shapes() -> dict[str, Column]:
    """The parts of a span, each pattern read once: (column, unit, value) and the NOT IN parts."""
    norm = c("before")
    for pattern, parts in ((_YEAR_LEFT, "$1$2|Y|$3"), (_YEAR_RIGHT, "$2$3|Y|$1"), (_DAY_LEFT, "$1|D|$2"), (_DAY_RIGHT, "$2|D|$1")):
        norm = F.regexp_replace(norm, pattern, parts.replace("|", _SEP))
    sub = F.regexp_replace("before", _NOT_IN, _SEP.join(f"${i}" for i in range(1, 7)) + _SEP)
    return {"eq": F.split(norm, _SEP, -1), "sub": F.split(sub, _SEP, -1)}


def _range_patch() -> Column:
    column, value = c("eq")[0], c("eq")[2]
    first = F.when(c("eq")[1] == "Y", F.concat(F.lpad(value, 4, "0"), F.lit("-01-01"))).otherwise(value).try_cast("date")
    last = F.when(c("eq")[1] == "Y", F.add_months(first, 12)).otherwise(F.date_add(first, 1))
    text = F.format_string("%s >= CAST('%s' AS DATE) AND %s < CAST('%s' AS DATE)", column, first.cast("string"), column, last.cast("string"))
    fitted = F.when(c("negated"), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return F.when((F.size("eq") == 3) & first.isNotNull(), fitted)


def _edit(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start_off"), end.cast("int").alias("end_off"), text.alias("after"))


def _part(i: int) -> Column:
    return F.get("sub", F.lit(i - 1))


def _match() -> Column:
    return F.concat(_part(3), F.lit(" = "), _part(1), F.lit("."), _part(2))


def _exists_patch() -> Column:
    where = F.when(_part(6) == "", _match()).otherwise(F.concat(F.lit("("), _part(6), F.lit(") AND "), _match()))
    source = F.lower(F.element_at(F.split(_part(4), r"\."), -1))
    alias = F.lower(F.regexp_replace(_part(5), r"(?i)^\s*(AS\s+)?", ""))
    captured = (F.lower(_part(1)) == source) | (F.lower(_part(1)) == alias)
    safe = (F.size("sub") == 7) & ~_part(6).rlike(_BLOCKED) & ~captured
    return F.when(safe, F.concat(F.lit("NOT EXISTS (SELECT 1 FROM "), _part(4), _part(5), F.lit(" WHERE "), where, F.lit(")")))


def _exists_edits() -> Column:
    """Small edits, so that a patch inside the subquery's condition keeps its place."""
    start = c("start_off")
    head = F.length(F.regexp_extract("before", _NOT_IN_HEAD, 0))
    stop = start + F.length("before") - F.length(F.regexp_extract("before", r"\s*\)$", 0))
    begin = stop - F.length(_part(6))
    filled = _part(6) != ""
    before = F.when(filled, ") AND ").otherwise(" WHERE ")
    opened = _edit(begin, begin, F.when(filled, "(").otherwise(""))
    return F.array(_edit(start, start + head, F.lit("NOT EXISTS (SELECT 1")), opened, _edit(stop, stop, F.concat(before, _match())))


def _whole_edit() -> Column:
    return F.array(_edit(c("start_off"), c("end_off"), c("after")))


def _span(start: Column, end: Column, negated: Column) -> list[Column]:
    return [start.alias("start_off"), end.alias("end_off"), negated.alias("negated")]


def _range_spans() -> tuple[Column, list[Column]]:
    """Both operands of an equality that has a date function directly on one side."""
    shape = lint.direct_date() & (c("utok") == "=") & ~c("stmt_broken")
    return shape, _span(c("lb.off_end"), c("rb.prev_end"), c("lb.utok") == "NOT")


def _exists_spans() -> tuple[Column, list[Column]]:
    """From the outer operand ``q.c`` to the end of a NOT IN subquery."""
    shape = lint.not_in_query() & ~c("stmt_broken") & (c("p1") == "NOT") & (c("p3") == ".")
    return shape, _span(c("off_p4"), c("sub_close_off") + 1, F.lit(False))


def _sort_spans() -> tuple[Column, list[Column]]:
    """An ORDER BY directly in a CTE body that has no LIMIT, up to the closing parenthesis."""
    shape = lint.nested_sort() & ~c("stmt_broken") & (c("grp.kind") == "cte")
    return shape, _span(c("off"), c("close_off"), F.lit(False))


# rule id: description, spans, new text, edits, needs review
_RULES = {
    "OPT-SARG-RANGE": ("date function replaced by a half-open range", _range_spans, _range_patch, _whole_edit, False),
    "OPT-NOT-IN-EXISTS": ("NOT IN replaced by NOT EXISTS", _exists_spans, _exists_patch, _exists_edits, True),
    "OPT-CTE-SORT-DROP": ("ORDER BY dropped from a CTE", _sort_spans, lambda: F.lit(""), _whole_edit, False),
}
_QUICK = r"(?i)\b(?:YEAR|EXTRACT|DATE)\s*\(|\bNOT\s+IN\b|\bORDER\s+BY\b"


def _spanned(scripts: DataFrame) -> DataFrame:
    """Annotated tokens plus where the parenthesis after each token closes."""
    t = annotate(tokenize(scripts))
    pos_w = W.partitionBy("script_id", "stmt_no").orderBy("pos")
    t = t.withColumn("__own", F.when(c("tok") == "(", c("close_off")))  # at "(" the next ")" of its level is its own
    return t.withColumns({"sub_close_off": F.lead("__own", 1).over(pos_w), "off_p4": F.lag("off", 4).over(pos_w)})


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a generator, so that later steps read them and do not repeat them."""
    made = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("__s")).select("*", "__s.*").drop("__s")


def rewrite_patches(scripts: DataFrame) -> DataFrame:
    """Patch rows of all rules, found in one pass over the scripts that can match at all."""
    candidates = scripts.filter(c("sql").rlike(_QUICK)).select("script_id", "dialect", "sql")
    t = _spanned(candidates)
    hits = F.array_compact(F.array(*[F.when(shape, F.struct(F.lit(rule).alias("rule_id"), *cols)) for rule, (shape, cols) in {r: v[1]() for r, v in _RULES.items()}.items()]))
    found = t.filter(c("utok").isin("=", "IN", "ORDER")).select("script_id", "stmt_no", F.explode(hits).alias("h")).select("script_id", "stmt_no", "h.*")
    found = found.join(candidates.select("script_id", "sql").hint("merge"), "script_id")
    raw = F.substring("sql", c("start_off") + 1, c("end_off") - c("start_off"))
    keys = ["script_id", "stmt_no", "rule_id", "negated"]
    found = _settled(found.select(*keys, "start_off", raw.alias("raw")), {"before": F.regexp_replace("raw", r"^\s+|\s+$", ""), "rest": F.regexp_replace("raw", r"^\s+", "")})
    found = _settled(found, {"first_off": c("start_off") + F.length("raw") - F.length("rest")} | _shapes())
    found = found.select(*keys, c("first_off").alias("start_off"), (c("first_off") + F.length("before")).alias("end_off"), "before", "eq", "sub")
    pick = lambda i: reduce(lambda e, r: F.when(c("rule_id") == r, _RULES[r][i]()).otherwise(e), _RULES, F.lit(None))
    found = _settled(found, {"after": pick(2)}).filter("after is not null").withColumn("edits", pick(3))
    texts = F.create_map(*[F.lit(x) for r, v in _RULES.items() for x in (r, v[0])])
    review = c("rule_id").isin([r for r, v in _RULES.items() if v[4]])
    return found.select("script_id", "stmt_no", "rule_id", texts[c("rule_id")].alias("description"), "start_off", "end_off", "before", "after", review.alias("review_required"), "edits")


def apply_patches(scripts: DataFrame, patches: DataFrame) -> DataFrame:
    """Edit from the last place to the first. An edit inside a larger one is left out, since
    its place goes with that; one that overlaps a later edit in part waits for the next run.

    The edits of a script are few and smaller than its text, which is one row already.
    """
    edits = patches.groupBy("script_id").agg(F.sort_array(F.flatten(F.collect_list("edits")), asc=False).alias("edits"))
    def inside(e, o):  # an insertion at the edge of an edit is not inside it
        within = (o["start_off"] <= e["start_off"]) & (e["end_off"] <= o["end_off"])
        before, after = o["start_off"] < e["start_off"], e["end_off"] < o["end_off"]
        return within & F.when(e["start_off"] == e["end_off"], before & after).otherwise(before | after)

    edits = edits.select("script_id", F.filter("edits", lambda e: ~F.exists("edits", lambda o: inside(e, o))).alias("edits"))
    joined = scripts.join(edits.hint("merge"), "script_id", "left")
    start = F.struct(c("sql").alias("sql"), F.length("sql").alias("free"))
    kind = "struct<sql:string,free:int>"

    def step(acc: Column, e: Column) -> Column:
        done = F.concat(F.substring(acc["sql"], F.lit(1), e["start_off"]), e["after"], F.substring(acc["sql"], e["end_off"] + 1, F.length(acc["sql"])))
        return F.when(e["end_off"] <= acc["free"], F.struct(done.alias("sql"), e["start_off"].alias("free")).cast(kind)).otherwise(acc)

    text = F.when(c("edits").isNull(), c("sql")).otherwise(F.aggregate("edits", start.cast(kind), step)["sql"])
    return joined.withColumn("sql", text).drop("edits")


def rewrite_corpus(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scripts with new text, patch rows). Running it on its own output changes nothing."""
    patches = rewrite_patches(scripts)
    return apply_patches(scripts, patches), patches
