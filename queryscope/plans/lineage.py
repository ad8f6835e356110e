"""Tables, columns, stages and nesting read off the annotated tokens."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from queryscope import lookups as L
from queryscope.plans.tokens import table_names, unquote

c = F.col
STAGES = ["FROM", "JOIN", "WHERE", "GROUP BY", "HAVING", "SELECT", "ORDER BY", "LIMIT"]


def _name_parts() -> tuple[Column, Column, Column]:
    """Name, schema and alias read at the token that starts a table reference."""
    is_name = lambda i: c(f"nk{i}").isin("word", "ident")
    three = (c("n1") == ".") & (c("n3") == ".")
    two = (c("n1") == ".") & ~three

    def alias_at(i: int) -> Column:
        return F.when((c(f"n{i}") == "AS") & is_name(i + 1), c(f"nt{i + 1}")).when(is_name(i), c(f"nt{i}"))

    name = F.when(three, c("nt4")).when(two, c("nt2")).otherwise(c("tok"))
    schema = unquote(F.when(three, c("nt2")).when(two, c("tok")))
    alias = F.when(three, alias_at(5)).when(two, alias_at(3)).otherwise(alias_at(1))
    return unquote(name), F.when(~F.lower(schema).isin(L.DEFAULT_SCHEMAS), schema), unquote(alias)


def _named(tokens: DataFrame) -> DataFrame:
    """Table reference rows with name, schema and alias, one per mention."""
    name, schema, alias = _name_parts()
    return tokens.filter(table_names(tokens) & ~c("stmt_broken")).select(
        "script_id", "stmt_no", "pos", "line", "p1", "p2", "p3", "p4", "join_next", "depth",
        c("grp.pos").alias("grp_pos"),
        name.alias("name"), schema.alias("schema"), alias.alias("alias"),
    )


def table_refs(tokens: DataFrame) -> DataFrame:
    """Distinct (name, schema) per statement with the place of the first mention."""
    return _named(tokens).groupBy("script_id", "stmt_no", "name", "schema").agg(F.min("pos").alias("pos"))


def _references(tokens: DataFrame) -> DataFrame:
    """One row per statement: its distinct tables as (name, schema), and its columns as (name, schema, column).

    Both are folded in one pass over the tokens; a statement's lists are bounded by its text.
    Qualified columns go to the tables of that name or alias in any case, the others to the first table.
    """
    pos_w = W.partitionBy("script_id", "stmt_no").orderBy("pos")
    flagged = tokens.withColumn("is_table", table_names(tokens))
    flagged = flagged.withColumns({"t2": F.lag("is_table", 2).over(pos_w), "t4": F.lag("is_table", 4).over(pos_w)})
    part = (c("p1") == ".") & (F.coalesce("t2", F.lit(False)) | ((c("p3") == ".") & F.coalesce("t4", F.lit(False))))
    is_column = (
        c("is_col") & ~c("is_table") & ~F.coalesce(part, F.lit(False)) & (c("n1") != ".") & ~c("stmt_broken")
        & F.coalesce(c("grp.fn") != "USING", F.lit(True))
    )
    name, schema, alias = _name_parts()
    is_table = c("is_table") & ~c("stmt_broken")
    table = F.struct(name.alias("name"), schema.alias("schema"))
    column = F.struct(unquote(c("tok")).alias("column"), F.when(c("p1") == ".", unquote(c("pt2"))).alias("qualifier"))
    called = F.struct(F.array_compact(F.array(F.lower(name), F.lower(alias))).alias("q"), table.alias("t"))
    keys = ["script_id", "stmt_no"]
    found = flagged.select(*keys, "pos", F.when(is_table, called).alias("called"), F.when(is_column, column).alias("col"))
    folded = found.filter("called is not null or col is not null").groupBy(*keys).agg(
        F.collect_set("called").alias("called"), F.collect_set("col").alias("cols"), F.min_by("called.t", F.when(c("called").isNotNull(), c("pos"))).alias("first"),
    )

    def on_tables(x: Column) -> Column:
        named = F.filter("called", lambda t: F.array_contains(t["q"], F.lower(x["qualifier"])))
        tables = F.when(x["qualifier"].isNotNull(), F.transform(named, lambda t: t["t"])).otherwise(F.array_compact(F.array("first")))
        return F.transform(tables, lambda t: F.struct(t["name"].alias("name"), t["schema"].alias("schema"), x["column"].alias("column")))

    return folded.select(
        *keys, F.array_distinct(F.transform("called", lambda t: t["t"])).alias("tables"), F.array_distinct(F.flatten(F.transform("cols", on_tables))).alias("columns")
    )


def column_refs(tokens: DataFrame) -> DataFrame:
    """Columns per statement and table: qualified ones on the table of that name or
    alias in any case, the others on the first table of the statement."""
    return _references(tokens).select("script_id", "stmt_no", F.explode("columns").alias("r")).select("script_id", "stmt_no", "r.name", "r.schema", "r.column")


def lineage(tokens: DataFrame) -> DataFrame:
    """Each direct table of a FROM or JOIN with alias, join kind and whether it has no ON."""
    joined = c("p1") == "JOIN"
    side = F.when(c("p2").isin("LEFT", "RIGHT", "FULL"), c("p2")).when(c("p2").isin("OUTER", "SEMI", "ANTI") & c("p3").isin("LEFT", "RIGHT", "FULL"), c("p3"))
    kind = (
        F.when(c("p1") == "FROM", "FROM")
        .when(joined & (c("p2") == "CROSS"), "CROSS JOIN")
        .when(joined & side.isNotNull(), F.concat(side, F.lit(" JOIN")))
        .otherwise("INNER JOIN")
    )
    out = _named(tokens).filter(c("p1").isin("FROM", "JOIN", ",", "(")).withColumn("join_kind", F.when(c("p1") == "(", "FROM").otherwise(kind))
    problem = (c("join_kind") == "CROSS JOIN") | ((c("join_kind") != "FROM") & ((c("p1") == ",") | (F.coalesce(c("join_next"), F.lit("X")) != "ON")))
    out = out.withColumn("problem", problem)
    return out.withColumn("note", F.when(c("problem"), "joined without an ON condition").otherwise("")).select(
        "script_id", "stmt_no", "pos", "grp_pos", "name", "schema", "alias", "join_kind", "problem", "note"
    )


def table_usage(lineage_rows: DataFrame) -> DataFrame:
    """How often each table is read."""
    return lineage_rows.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("uses"), F.count_if("problem").alias("problems"))


def join_pairs(lineage_rows: DataFrame) -> DataFrame:
    """How often a table is joined right after another one in the same FROM."""
    order = W.partitionBy("script_id", "stmt_no", "grp_pos").orderBy("pos")
    previous = lineage_rows.withColumn("left_name", F.lag(F.lower("name")).over(order))
    return (
        previous.filter((c("join_kind") != "FROM") & c("left_name").isNotNull())
        .groupBy("left_name", F.lower("name").alias("right_name"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def query_stages(tokens: DataFrame) -> DataFrame:
    """The stages present at the top level of each statement, in logical order."""
    comma = (c("tok") == ",") & c("in_from")
    word = F.when(comma, "JOIN").when(c("utok").isin("GROUP", "ORDER"), F.concat("utok", F.lit(" BY"))).when(c("utok") == "FETCH", "LIMIT").otherwise(c("utok"))
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    top = tokens.filter((c("depth") == 0) & (c("is_clause") | comma) & ~c("stmt_broken"))
    top = top.select("script_id", "stmt_no", word.alias("kind"), "line").filter(c("kind").isin(STAGES))
    return top.groupBy("script_id", "stmt_no", "kind").agg(F.min("line").alias("line")).withColumn("ord", ranks[c("kind")])


def stage_edges(stages: DataFrame) -> DataFrame:
    """Neighbouring stages as (source, target)."""
    order = W.partitionBy("script_id", "stmt_no").orderBy("ord")
    return (
        stages.withColumn("target", F.lead("kind").over(order)).filter("target is not null")
        .select("script_id", "stmt_no", c("kind").alias("source"), "target")
    )


def operator_counts(tokens: DataFrame) -> DataFrame:
    """Relational operators per script: scans, filters, joins, aggregates, projections."""
    clause = c("is_clause") & ~c("stmt_broken")
    comma = (c("tok") == ",") & c("in_from") & ~c("stmt_broken")
    return tokens.groupBy("script_id").agg(
        F.count_if(table_names(tokens) & ~c("stmt_broken")).alias("table_scans"),
        F.count_if(clause & (c("utok") == "WHERE")).alias("filters"),
        F.count_if((clause & (c("utok") == "JOIN")) | comma).alias("joins"),
        F.count_if(clause & (c("utok") == "GROUP")).alias("aggregates"),
        F.count_if(clause & (c("utok") == "SELECT")).alias("projections"),
    )


def depth_here() -> Column:
    """Depth of a subquery at its opening parenthesis, each enclosing CTE counted."""
    return F.when(c("open_kind").isin("in_query", "derived"), c("nest")).otherwise(0)


def nesting_depth(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("script_id").agg(F.max(depth_here()).cast("int").alias("depth"))


def clause_usage(tokens: DataFrame) -> DataFrame:
    """Per script whether joins, filters, sorts, groups and projections occur."""
    comma = (c("tok") == ",") & c("in_from")
    word = lambda w: c("is_clause") & (c("utok") == w)
    seen = {"join": word("JOIN") | comma, "where": word("WHERE"), "orderby": c("order_by"), "groupby": word("GROUP"), "select": word("SELECT")}
    return tokens.groupBy("script_id").agg(*[F.bool_or(x & ~c("stmt_broken")).alias(f"has_{n}") for n, x in seen.items()])


def clause_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(*[F.count_if(name).alias(name[4:]) for name in usage.columns if name.startswith("has_")])


def statement_at(points: DataFrame, statements: DataFrame, scripts: DataFrame) -> DataFrame:
    """The points with the statement at their (script_id, off), else the whole script; equal points and other columns stay.

    Offsets are cut into slices and each statement's bounds are listed under the slices
    it covers, so a point meets only the statements near it. Of several that hold a point
    the first in the script counts. No statement's text is moved: it is cut out of the script, which is joined once.
    """
    width = 1024
    spans = statements.select(
        "script_id", c("stmt_no").alias("hit_no"), "start_off", "end_off",
        F.explode(F.sequence(F.floor(c("start_off") / width), F.floor(c("end_off") / width))).alias("slice"),
    )
    near = points.select("script_id", "off").distinct().withColumn("slice", F.floor(c("off") / width)).join(spans, ["script_id", "slice"])
    inside = (c("start_off") <= c("off")) & (c("off") <= c("end_off"))
    best = near.filter(inside).groupBy("script_id", "off").agg(F.min(F.struct(c("hit_no").alias("stmt_no"), "start_off", "end_off")).alias("hit"))
    found = points.join(best.hint("merge"), ["script_id", "off"], "left").join(scripts.select("script_id", "sql").hint("merge"), "script_id")
    sql = F.regexp_replace("sql", "^\ufeff", "")  # offsets are counted without the mark, as in split_pieces
    cut = F.substring(sql, c("hit.start_off") + 1, c("hit.end_off") - c("hit.start_off"))
    return found.select(*points.columns, "hit.stmt_no", F.when(c("hit").isNotNull(), cut).otherwise(c("sql")).alias("stmt"))


def check_schema(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """SCHEMA-001 findings: tables not in ``catalog(schema, table, column)``, then columns.

    A reference without a schema may be in any schema; columns of an unknown table
    are not looked at.
    """
    cat = catalog.select(F.lower("schema").alias("cs"), F.lower("table").alias("ct"), F.lower("column").alias("cc"))
    table_in = cat.groupBy("ct").agg(F.collect_set("cs").alias("t_in"))
    column_in = cat.groupBy("ct", "cc").agg(F.collect_set("cs").alias("c_in"))
    as_column = F.transform("tables", lambda t: F.struct(t["name"].alias("name"), t["schema"].alias("schema"), F.lit(None).cast("string").alias("column")))
    # tables and columns of a statement go the same way, so the tokens are read once
    refs = _references(tokens).select("script_id", "stmt_no", F.explode(F.concat(as_column, "columns")).alias("r")).select("script_id", "stmt_no", "r.*")
    looked = refs.withColumns({"ct": F.lower("name"), "cc": F.lower("column")}).join(table_in, "ct", "left").join(column_in, ["ct", "cc"], "left")
    has = lambda n: F.coalesce(F.when(c("schema").isNull(), F.size(n) > 0).otherwise(F.array_contains(n, F.lower("schema"))), F.lit(False))
    is_table = c("column").isNull()
    unknown = F.max(is_table & ~has("t_in")).over(W.partitionBy("script_id", "stmt_no", "name"))
    marked = looked.select("*", has("t_in").alias("t_known"), has("c_in").alias("c_known"), unknown.alias("unknown"))
    found = marked.filter(F.when(is_table, ~c("t_known")).otherwise(~c("unknown") & ~c("c_known")))
    kind, severity = F.when(is_table, "table").otherwise("column"), F.when(is_table, "HIGH").otherwise("MEDIUM")
    return found.select(
        "script_id", "stmt_no", F.lit("SCHEMA-001").alias("rule_id"), severity.alias("severity"), kind.alias("kind"), "name", "column"
    )
