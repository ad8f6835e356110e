"""SQL text to a token table, with column expressions and window functions only.

``tokenize`` turns ``scripts(script_id, dialect, sql)`` into one row per token.
``annotate`` adds what the rules read: nesting, clause, operand boundaries and
running counters. The text is shuffled once, by script; every explode and window
after that keeps this partitioning, so no later step moves data again.

Limits against a real parser: a word counts as a column by its neighbours, CASE
bodies are not operands of their own, and ``a JOIN b JOIN c ON .. ON ..`` binds
each ON to the join just before it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queryscope import lookups as L

# Possessive quantifiers keep Java's matcher iterative, so a literal of any
# length is matched without deep recursion.
_COMMENT = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_OPEN_COMMENT = r"/\*[\s\S]*+"
_STRING = r"'(?:[^']++|'')*+'?+"
_QUOTED = r'"[^"]*+"?+|`[^`]*+`?+'
_WORD = r"[\p{L}_][\p{L}\p{N}_$]*+"
_NUMBER = r"[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_OPERATOR = r"->>|->|=>|:=|<=>|<=|>=|<>|!=|==|\|\||::|<<|>>"


def _token_pattern(dialect: str | None = None) -> str:
    comment, quoted = _COMMENT, _QUOTED
    if dialect == "mysql":
        comment = comment + r"|#[^\n]*+"
    if dialect == "tsql":
        quoted = quoted + r"|\[[^\]\n]++\]"
    trivia = rf"(?:\s++|{comment})*+"
    return rf"{trivia}(?:{_OPEN_COMMENT}|{_STRING}|{quoted}|{_WORD}|{_NUMBER}|{_OPERATOR}|[\s\S]|\z)"


def _trivia_pattern(dialect: str | None = None) -> str:
    comment = _COMMENT + (r"|#[^\n]*+" if dialect == "mysql" else "")
    return rf"^(?:\s++|{comment})*+"


def _statement_body(quoted_identifiers: bool) -> str:
    quoted = rf"|{_QUOTED}" if quoted_identifiers else ""
    plain = r"[^;'\"`/-]" if quoted_identifiers else r"[^;'/-]"
    return rf"(?:{plain}++|{_COMMENT}|{_OPEN_COMMENT}|{_STRING}{quoted}|[/-])*+"


# Everything up to the last token: what may hold a quote or open a comment is read as the tokens
# read it, so blanks and comments after that are surely no part of a literal.
_HEAD = rf"^(?:(?:\s++|{_COMMENT})*+(?:{_OPEN_COMMENT}|{_STRING}|{_QUOTED}|[^\s'\"`/-]++|[\s\S]))*+"


def head_of(sql: Column, dialect: Column) -> Column:
    """The text without the blanks and comments that trail it.

    Dialects with comments or quotes of their own keep their whole text.
    """
    own = F.coalesce(dialect.isin("mysql", "tsql"), F.lit(False))
    return F.when(own, sql).otherwise(F.regexp_extract(sql, _HEAD, 0))


def _by_dialect(build) -> Column:
    """Pick the pattern variant by the row's dialect; each variant stays a constant."""
    return (
        F.when(F.col("dialect") == "mysql", build("mysql"))
        .when(F.col("dialect") == "tsql", build("tsql"))
        .otherwise(build(None))
    )


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _by_script(scripts: DataFrame) -> DataFrame:
    """Hash the text by script into a fixed number of parts.

    The count is given outright because adaptive coalescing judges by the bytes of
    the text, while the tokens made from it take many times that. It is one more than
    the session's, because Spark drops a hash that equals the one of a grouping before
    it and would coalesce that grouping instead.
    """
    parts = int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return scripts.repartition(parts, "script_id")


def split_pieces(scripts: DataFrame, quoted_identifiers: bool = True) -> DataFrame:
    """One row per statement piece, terminator included, with its place in the script."""
    body = _statement_body(quoted_identifiers)
    by_script = W.partitionBy("script_id").orderBy("stmt_no")
    before = by_script.rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        scripts.select("script_id", "dialect", F.regexp_replace("sql", "^﻿", "").alias("sql"))
        .transform(_by_script)
        .select(
            "script_id",
            "dialect",
            F.posexplode(F.regexp_extract_all("sql", F.lit(rf"{body}(?:;|\z)"), 0)).alias("stmt_no", "piece"),
        )
        .filter("piece <> ''")
    )
    size = F.length("piece")
    tail = F.length(F.substring_index("piece", "\n", -1))
    placed = pieces.withColumn("piece_off", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return placed.withColumn("piece_line", F.coalesce(F.sum(newlines(F.col("piece"))).over(before), F.lit(0)) + 1).withColumn(
        "piece_bol",
        F.coalesce(F.max(F.when(F.contains("piece", F.lit("\n")), F.col("piece_off") + size - tail)).over(before), F.lit(0)),
    )


def split_statements(scripts: DataFrame, quoted_identifiers: bool = False) -> DataFrame:
    """Statements with 0-based offsets: first significant character to ``;`` (exclusive)."""
    pieces = split_pieces(scripts, quoted_identifiers)
    body = F.regexp_extract("piece", rf"^{_statement_body(quoted_identifiers)}", 0)
    lead = F.length(F.regexp_extract("piece", _trivia_pattern(), 0))
    found = pieces.select(
        "script_id",
        "stmt_no",
        (F.col("piece_off") + lead).alias("start_off"),
        (F.col("piece_off") + F.length(body)).alias("end_off"),
        F.substring("piece", lead + 1, F.length(body) - lead).alias("stmt"),
    ).filter("start_off < end_off")
    order = W.partitionBy("script_id").orderBy("stmt_no")
    return found.withColumn("stmt_no", F.row_number().over(order))


def tokenize(scripts: DataFrame) -> DataFrame:
    """``tokens`` rows in script order, with offset, line and column.

    Blanks and comments travel as the head of the token that follows them, which
    halves the rows that the windows sort. A closing row of kind ``end`` marks
    the end of each statement.
    """
    raw = split_pieces(scripts).select(
        "script_id",
        "dialect",
        "stmt_no",
        "piece_off",
        "piece_line",
        "piece_bol",
        F.posexplode(_by_dialect(lambda d: F.regexp_extract_all("piece", F.lit(_token_pattern(d)), 0))).alias("pos", "raw"),
    )
    raw = raw.withColumn("tok", _by_dialect(lambda d: F.regexp_replace("raw", F.lit(_trivia_pattern(d)), F.lit(""))))
    by_pos = W.partitionBy("script_id", "stmt_no").orderBy("pos")
    size, tok_size = F.length("raw"), F.length("tok")
    raw = raw.withColumn("off", F.col("piece_off") + F.sum(size).over(by_pos) - tok_size)
    raw_off = F.col("off") + tok_size - size
    head_size = size - tok_size
    head = F.substring("raw", F.lit(1), head_size)
    last_break = F.when(F.contains("raw", F.lit("\n")), raw_off + size - F.length(F.substring_index("raw", "\n", -1)))
    head_break = F.when(F.contains(head, F.lit("\n")), raw_off + head_size - F.length(F.substring_index(head, "\n", -1)))
    before = by_pos.rowsBetween(W.unboundedPreceding, -1)
    line = F.col("piece_line") + F.sum(newlines(F.col("raw"))).over(by_pos) - newlines(F.col("tok"))
    bol = F.greatest("piece_bol", F.coalesce(F.max(last_break).over(before), F.lit(0)), F.coalesce(head_break, F.lit(0)))
    first = F.substring("tok", 1, 1)
    kind = (
        F.when(F.col("raw") == "", "end")
        .when(F.col("tok") == "", "blank")
        .when(first == "'", "string")
        .when(first.isin('"', "`") | ((first == "[") & (tok_size > 1)), "ident")
        .when(F.col("tok").rlike(r"^[\p{L}_]"), "word")
        .when(F.col("tok").rlike("^[0-9]"), "number")
        .when(F.startswith("tok", F.lit("/*")), "comment")
        .otherwise("op")
    )
    return raw.select(
        "script_id",
        "stmt_no",
        "pos",
        "raw",
        "tok",
        F.when(kind == "word", F.upper("tok")).otherwise(F.col("tok")).alias("utok"),
        kind.alias("kind"),
        F.col("off").cast("int").alias("off"),
        line.cast("int").alias("line"),
        (F.col("off") - bol + 1).cast("int").alias("col"),
    ).filter("kind <> 'blank'")


# --- fixed values: words that are never a column name -----------------------------
RESERVED = (
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET FETCH QUALIFY WINDOW UNION INTERSECT EXCEPT MINUS ALL "
    "DISTINCT AS ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL SEMI ANTI ASOF POSITIONAL LATERAL UNNEST "
    "AND OR NOT IN IS NULL LIKE ILIKE BETWEEN EXISTS CASE WHEN THEN ELSE END TRUE FALSE WITH RECURSIVE MATERIALIZED "
    "INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE VIEW RETURNING ASC DESC NULLS INTERVAL CAST TRY_CAST SAFE_CAST "
    "OVER PARTITION ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT ROW FILTER WITHIN ANY SOME TOP ESCAPE "
    "CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP LOCALTIME LOCALTIMESTAMP CLUSTER DISTRIBUTE SORT MERGE "
    "TABLESAMPLE PIVOT UNPIVOT FOR"
).split()
_CALLABLE = ["LEFT", "RIGHT", "CAST", "TRY_CAST", "SAFE_CAST", "FILTER", "GROUP", "UNNEST", "VALUES", "ANY", "SOME"]
_CLAUSES = "SELECT FROM WHERE ON USING HAVING LIMIT OFFSET FETCH QUALIFY WINDOW JOIN SET VALUES INTO RETURNING".split()
_BREAKS = (
    "SELECT DISTINCT FROM WHERE ON USING HAVING GROUP ORDER BY LIMIT OFFSET FETCH QUALIFY WINDOW JOIN INNER FULL CROSS "
    "NATURAL UNION INTERSECT EXCEPT MINUS AND OR NOT IN IS LIKE ILIKE BETWEEN WHEN THEN ELSE CASE END AS SET VALUES "
    "INTO RETURNING WITH ASC DESC OVER"
).split()
_NAMED_JOINS = ["NATURAL", "ASOF", "POSITIONAL"]
_SETOPS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]
_BODY = ["SELECT", "WITH"]
_BY_POS = "(PARTITION BY script_id, stmt_no ORDER BY pos)"
_BY_LEVEL = "(PARTITION BY script_id, stmt_no, depth ORDER BY pos)"


def _next_mark(column: str, over: str = _BY_LEVEL) -> Column:
    return F.expr(f"lead({column}, 1) IGNORE NULLS OVER {over}")


def annotate(tokens: DataFrame, anchors: Sequence[str] | None = None) -> DataFrame:
    """Add nesting, clause, operand and running-count columns to the token table.

    Four window passes over one partitioning: by position, by level, by position,
    by level. A *level* is the depth of parentheses; sibling groups on one level
    are kept apart because each starts at its own ``(``, which resets the state.
    Everything that depends on neighbouring text becomes a flag in the first pass,
    so the later sorts move narrow rows. With ``anchors`` (the tokens that the
    caller will look at) the last two passes keep only those and the marks they
    depend on.
    """
    pos_w = W.partitionBy("script_id", "stmt_no").orderBy("pos")
    level = W.partitionBy("script_id", "stmt_no", "depth").orderBy("pos")
    earlier = W.unboundedPreceding, -1
    c, no, when = F.col, F.lit(False), F.when

    def sure(x: Column) -> Column:
        return F.coalesce(x, no)

    # pass 1: neighbours and the flags they decide
    t = tokens.withColumn("kind", when((c("kind") == "word") & c("utok").isin(RESERVED), "kw").otherwise(c("kind")))
    near = {f"p{i}": F.lag("utok", i).over(pos_w) for i in range(1, 5)}
    near |= {f"pk{i}": F.lag("kind", i).over(pos_w) for i in range(1, 3)}
    near |= {"pt2": F.lag("tok", 2).over(pos_w), "prev_end": F.lag(c("off") + F.length("tok"), 1).over(pos_w)}
    for i in range(1, 7):
        near[f"n{i}"] = F.lead("utok", i).over(pos_w)
        near[f"nk{i}"] = F.lead("kind", i).over(pos_w)
        near[f"nt{i}"] = F.lead("tok", i).over(pos_w)
    t = t.withColumns(near)
    is_open, is_close, at_end = c("tok") == "(", c("tok") == ")", c("kind") == "end"
    operand_before = sure(c("pk1").isin("word", "ident", "number", "string") | (c("p1") == ")"))
    is_col = (
        c("kind").isin("word", "ident")
        & ~sure(c("n1").isin("(", "=>"))
        & ~sure(c("nk1") == "string")
        & ~operand_before
        & ~sure(c("p1").isin("AS", "::", ":", "@"))
        & ~sure((c("p1") == "(") & (c("p2") == "EXTRACT"))
        & ~sure((c("n1") == "AS") & (c("n2") == "(") & c("p1").isin("WITH", "RECURSIVE", ","))
    )
    callable_before = sure(c("pk1").isin("word", "ident") | c("p1").isin(_CALLABLE))
    is_cte = sure((c("p1") == "MATERIALIZED") | ((c("p1") == "AS") & (c("p3").isin("WITH", "RECURSIVE", ",") | (c("p2") == ")"))))
    body = sure(c("n1").isin(_BODY))
    open_kind = (
        when(~is_open, F.lit(None))
        .when(body & (c("p1") == "EXISTS"), "exists")
        .when(body & (c("p1") == "IN"), "in_query")
        .when(body & is_cte, "cte")
        .when(body & callable_before, "call")
        .when(body, "derived")
        .when(c("p1") == "IN", "in_list")
        .when(c("p1") == "OVER", "window")
        .when(callable_before, "call")
        .otherwise("group")
    )
    quotes = F.length("tok") - F.length(F.replace("tok", F.lit("'"), F.lit("")))
    unclosed = (
        ((c("kind") == "string") & ((quotes % 2) == 1))
        | ((c("kind") == "ident") & ((F.length("tok") == 1) | ~F.substring("tok", -1, 1).isin('"', "`", "]")))
        | (c("kind") == "comment")
    )
    empty_list = (c("utok") == "SELECT") & (c("kind") == "kw") & (c("n1").isin("FROM", "WHERE", ")", ";", "") | c("n1").isNull())
    word_break = (
        c("tok").isin("(", ")", ",", ";") | at_end | c("utok").isin(L.COMPARISONS) | ((c("kind") == "kw") & c("utok").isin(_BREAKS))
    )
    named = sure(c("p1").isin(_NAMED_JOINS)) | sure(c("p2").isin(_NAMED_JOINS)) | sure(c("p3").isin(_NAMED_JOINS))
    by_next = sure(c("n1") == "BY")
    blank = F.lit("")
    text = F.trim(
        F.concat_ws(" ", F.coalesce("p2", blank), F.coalesce("p1", blank), "tok", F.coalesce("nt1", blank), F.coalesce("nt2", blank), F.coalesce("nt3", blank))
    )
    snippet = when(F.length(text) > 72, F.concat(F.substring(text, 1, 69), F.lit("..."))).otherwise(text)
    t = t.withColumns(
        {
            "is_col": is_col,
            "open_kind": open_kind,
            "is_break": word_break,
            "step": when(is_open, 1).when(is_close, -1).otherwise(0),
            "square": when(c("tok") == "[", 1).when(c("tok") == "]", -1).otherwise(0),
            "setop_word": c("utok").isin(_SETOPS) & sure(c("n1").isin("SELECT", "ALL", "DISTINCT", "(")),
            "clause_word": (c("utok").isin(_CLAUSES) & ~(c("utok").isin("FROM", "ON") & sure(c("p1") == "DISTINCT")))
            | (c("utok").isin("GROUP", "ORDER", "CLUSTER", "DISTRIBUTE", "SORT") & by_next),
            "star_word": (c("tok") == "*") & sure(c("p1").isin("SELECT", "DISTINCT", "ALL", ",", ".") | ((c("pk1") == "number") & (c("p2") == "TOP"))),
            "top_word": sure((c("utok") == "SELECT") & (c("n1") == "TOP")),
            "plus_word": c("tok").isin("+", "-")
            & (operand_before | sure(c("p1").isin("END", "NULL", "]", "CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_TIME"))),
            "ill_word": unclosed | empty_list,
            "named_join": (c("utok") == "JOIN") & named,
            "cross_join": (c("utok") == "JOIN") & sure(c("p1") == "CROSS"),
            "sideways": c("utok").isin("JOIN", ",") & sure(c("n1").isin("LATERAL", "UNNEST")),
            "in_query": (c("utok") == "IN") & sure((c("n1") == "(") & c("n2").isin(_BODY)),
            "order_by": (c("utok") == "ORDER") & by_next,
            "wild_like": c("utok").isin("LIKE", "ILIKE") & sure((c("nk1") == "string") & F.startswith("nt1", F.lit("'%"))),
            "snippet": snippet if anchors is None else when(c("utok").isin(list(anchors)) | unclosed | empty_list | at_end, snippet),
            "opening": when(is_open, F.struct(c("p1").alias("fn"), body.alias("body"), sure(c("p1").isin("FROM", "JOIN")).alias("joined"))),
        }
    )
    opens = F.sum(when(c("step") > 0, 1).otherwise(0)).over(pos_w)
    closes = F.coalesce(F.sum(when(c("step") < 0, 1).otherwise(0)).over(pos_w.rowsBetween(*earlier)), F.lit(0))
    t = t.withColumns(
        {
            "depth": (opens - closes).cast("int"),
            "squares": F.sum("square").over(pos_w),
            "col_seen": F.sum(when(c("is_col"), 1).otherwise(0)).over(pos_w).cast("int"),
        }
    )

    # pass 2: the enclosing group, its clause, and the operands around each token
    opened, closed = c("step") > 0, c("step") < 0
    group = F.struct(c("pos"), c("open_kind").alias("kind"), "opening.body", "opening.fn", "opening.joined", c("col_seen"))
    t = t.withColumn("grp", F.last(when(opened, group), ignorenulls=True).over(level))
    t = t.withColumn("grp", when(c("depth") > 0, c("grp")))
    t = t.withColumn("query_level", c("grp").isNull() | c("grp.body") | (c("grp.kind") == "group"))
    t = t.withColumns({"is_setop": c("query_level") & c("setop_word"), "is_clause": c("query_level") & (c("clause_word") | c("setop_word"))})
    stop = opened | closed | (c("tok") == ";") | (c("kind") == "end")
    t = t.withColumns(
        {
            "state": when(opened, F.lit("")).when(c("is_clause"), c("utok")),
            "jm": when(c("utok").isin("ON", "USING"), c("utok")).when(c("is_clause") | stop | (c("tok") == ","), "X"),
            "lm": when(c("utok").isin("LIMIT", "FETCH"), "L").when(stop | c("is_setop"), "X"),
            "sm": when(opened, F.lit(False)).when(c("is_setop"), F.lit(True)),
            "cm": when(closed, c("off")),
            "tm": when(opened, F.lit(False)).when(c("utok") == "SELECT", c("top_word")),
        }
    )
    so_far = level.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns(
        {
            "clause": F.coalesce(F.last("state", ignorenulls=True).over(so_far), F.lit("")),
            "clause_before": F.coalesce(F.last("state", ignorenulls=True).over(level.rowsBetween(*earlier)), F.lit("")),
            "after_setop": sure(F.last("sm", ignorenulls=True).over(so_far)),
            "has_top": sure(F.last("tm", ignorenulls=True).over(so_far)),
            "n_here": F.row_number().over(level),
            "casts_here": F.sum(when(c("tok") == "::", 1).otherwise(0)).over(so_far),
            "ops_here": F.sum(when(c("tok").isin("+", "-", "*", "/", "%", "||"), 1).otherwise(0)).over(so_far),
            "l1": F.lag("utok", 1).over(level),
            "r1": F.lead("utok", 1).over(level),
            "join_next": _next_mark("jm"),
            "limit_next": _next_mark("lm"),
            "close_off": _next_mark("cm"),
        }
    )
    t = t.withColumns(
        {
            "in_from": c("query_level") & c("clause").isin("FROM", "JOIN", "ON", "USING"),
            "is_star": c("star_word") & c("query_level") & (c("clause") == "SELECT"),
            "mark": when(c("is_break"), F.struct("utok", "n_here", "col_seen", "casts_here", "ops_here", "prev_end", (c("off") + F.length("tok")).alias("off_end"))),
        }
    )
    star_mark = when(c("is_star"), "*").when(c("utok") == "SELECT", "S").when(opened, "(")
    t = t.withColumns(
        {
            "star_before": F.last(star_mark, ignorenulls=True).over(level.rowsBetween(*earlier)),
            "lb": F.last("mark", ignorenulls=True).over(level.rowsBetween(*earlier)),
            "rb": _next_mark("mark"),
        }
    )
    call_close = closed & sure((c("grp.kind") == "call") & (c("col_seen") > c("grp.col_seen")))
    arith = c("plus_word") & sure(c("rb.col_seen") > F.coalesce(c("lb.col_seen"), F.lit(0)))
    broken = c("ill_word") | (closed & (c("depth") <= 0)) | ((c("tok") == "]") & (c("squares") < 0))
    broken = broken | ((c("kind") == "end") & ((c("depth") != 0) | (c("squares") != 0)))
    sub_kind = ("cte", "in_query", "derived")
    t = t.withColumns(
        {
            "bad_date": when(call_close & c("grp.fn").isin(L.DATE_FUNCTIONS), 1).otherwise(0),
            "bad_text": when(call_close & c("grp.fn").isin(L.TEXT_FUNCTIONS), 1).otherwise(0),
            "bad_other": when(call_close & c("grp.fn").isin(L.OTHER_FUNCTIONS), 1).otherwise(0),
            "bad_arith": when(arith, 1).otherwise(0),
            "broken": sure(broken),
            "sub_open": when(opened & c("open_kind").isin(*sub_kind), 1).otherwise(0),
            "sub_close": when(closed & sure(c("grp.kind").isin(*sub_kind)), 1).otherwise(0),
            "on_step": when((c("utok") == "ON") & c("is_clause"), 1).otherwise(0)
            - when((c("clause_before") == "ON") & (c("is_clause") | closed | (c("tok") == ";") | (c("kind") == "end")), 1).otherwise(0),
        }
    )

    # pass 3: counters over positions
    if anchors is not None:
        # only columns made before the windows, so that the filter stays a short test
        marks = (c("step") != 0) | c("is_break") | c("plus_word") | c("ill_word") | (c("tok") == "]")
        t = t.filter(marks | c("utok").isin(list(anchors)))
    run = pos_w.rowsBetween(W.unboundedPreceding, 0)
    before = pos_w.rowsBetween(*earlier)
    whole = pos_w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    names = ("date", "text", "other", "arith")
    t = t.withColumns(
        {
            "nest": F.sum("sub_open").over(run) - F.coalesce(F.sum("sub_close").over(before), F.lit(0)),
            "in_on": F.sum("on_step").over(run) > 0,
            "stmt_broken": F.max("broken").over(whole),
            "broken_no": F.sum(when(c("broken"), 1).otherwise(0)).over(run),
        }
        | {f"cum_{n}": F.sum(f"bad_{n}").over(run) for n in names}
    )

    # pass 4: what lies inside the two operands of a comparison
    t = t.withColumns(
        {
            "am": when(c("is_break"), F.struct(*[c(f"cum_{n}").alias(n) for n in names])),
            "bm": when(c("is_break"), F.struct(*[(c(f"cum_{n}") - c(f"bad_{n}")).alias(n) for n in names])),
        }
    )
    t = t.withColumns({"lc": F.last("am", ignorenulls=True).over(level.rowsBetween(*earlier)), "rc": _next_mark("bm")})
    compare = c("utok").isin(L.COMPARISONS) & (c("kind") == "op")
    sides = {f"left_{n}": c(f"cum_{n}") - F.coalesce(c(f"lc.{n}"), F.lit(0)) for n in names}
    sides |= {f"right_{n}": c(f"rc.{n}") - c(f"cum_{n}") for n in names}
    return t.withColumns({"is_compare": compare} | sides)


def table_names(tokens: DataFrame) -> Column:
    """True on the token that starts a table reference in an annotated table."""
    c = F.col
    after = (
        (c("p1").isin("FROM", "JOIN") & c("in_from"))
        | ((c("p1") == ",") & c("in_from"))
        | c("p1").isin("INTO", "TABLE")
        | ((c("p1") == "UPDATE") & F.coalesce(c("p2") != "FOR", F.lit(True)))
        | ((c("p1") == "(") & (c("grp.kind") == "group") & c("grp.joined"))
    )
    return F.coalesce(
        c("kind").isin("word", "ident") & after & ((c("n1") != "(") | (c("p1") == "INTO")), F.lit(False)
    )


def unquote(name: Column) -> Column:
    return F.regexp_replace(name, r'^["`\[]|["`\]]$', "")
