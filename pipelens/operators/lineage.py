"""Column and table lineage as graph operations over assignment facts (2.9).

Input fact table (one row per target column x source reference)::

    assignments(pipeline_id, stmt_order, target_table, target_column, ordinal,
                source_table, source_column, expression)

* direct copy:  expression null, source_table / source_column set
* expression:   expression set, one row per referenced column (or one row
                with null source when it references none)
* ``SELECT *``: target_column ``*``, one row per immediate source table

Semantics (fixed here, order-independent): the base columns of a target
column are the *reachable terminals* of the column graph -- columns of tables
that no statement defines. A target column with no terminal at all may take
the terminals of another target's column of the same name (name fallback).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.functions import text as T
from pipelens.operators import graph
from pipelens.operators.graph import shuffled
from pipelens.session import scratch_path

P = "pipeline_id"

# Fixed values that must equal the reference's for the same results.
# Words never accepted as column names (compared lower-case).
SQL_KEYWORDS = ["case", "when", "then", "else", "end", "and", "or", "not", "in", "like",
                "is", "null", "select", "from", "where", "group", "by", "order", "having",
                "as", "on", "join", "left", "right", "inner", "outer", "cross", "union",
                "concat", "replace", "lower", "upper", "trim", "cast", "substring", "coalesce",
                "validation", "plan", "mitigate", "monitor", "sustainability"]
# Characters that mark an expression rather than a column name.
INVALID_NAME_CHARS = "%,;<>=!?|&^~`"
DIRECT_LOGIC = "Direct Pass-Through"
RAW_COPY_LABEL = "Raw Copy"
GRAPH_LOGIC_LEN = 150
LABEL_LOGIC_LEN = 100
ISSUE_DUPLICATES = "  {target_column}: Removed duplicate source columns: {cols}"
ISSUE_UNUSED = "  {target_column}: Removed unused source columns: {cols}"
ISSUE_ADDED = "  {target_column}: Added missing columns: {cols}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _class(chars: str) -> str:
    """Regex character class matching any of ``chars``."""
    return "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in chars) + "]"


def valid_column_name(name) -> Column:
    """``pred_valid_column_name`` as one Column predicate (null -> false)."""
    # one pattern instead of a test per rule, each of which trims the name again: a first
    # letter or underscore leaves out empty names, numbers and names of punctuation only
    n = F.regexp_replace(_c(name), r"^\s+|\s+$", "")
    rest = "[^" + _class("'\"()\n\r\t" + INVALID_NAME_CHARS)[1:]
    ok = n.rlike(r"^[\p{L}_]" + rest + r"*\z") & ~F.lower(n).isin(*SQL_KEYWORDS)
    return F.coalesce(ok, F.lit(False))


def not_na_table(table) -> Column:
    """``pred_not_na_table``: drop tables named N/A."""
    return F.coalesce(F.upper(_c(table)) != "N/A", F.lit(False))


def is_target_table(table, mode: str = "report") -> Column:
    """``pred_target_table``: ``report`` = ends REPORT or contains 'derived'
    (any case); ``node`` = ends REPORT or equals derived_df; ``builder`` =
    ends _df or equals derived_df."""
    t = _c(table)
    if mode == "report":
        return t.endswith("REPORT") | F.lower(t).contains("derived")
    if mode == "node":
        return t.endswith("REPORT") | (t == "derived_df")
    return t.endswith("_df") | (t == "derived_df")


def bare_column(expression) -> Column:
    """``pred_bare_column``: ``*`` or only letters, digits, ``.`` and ``_``."""
    e = _c(expression)
    return F.coalesce((e == "*") | e.rlike(r"^[A-Za-z0-9._]+$"), F.lit(False))


def schema_prefix(table, schema) -> Column:
    """``fn_schema_prefix``: add ``schema.`` when the name has no dot."""
    t = _c(table)
    return F.when(t.isNull() | (t == "") | t.contains("."), t).otherwise(
        F.concat(_c(schema), F.lit("."), t))


# ------------------------------------------------------------------ statements


def last_definition(assign: DataFrame) -> DataFrame:
    """``lin_last_definition_wins``: keep only the rows of the latest
    statement defining each (pipeline, target table). One shuffle of the rows;
    rows without a pipeline or a target belong to no statement."""
    last = F.max("stmt_order").over(Window.partitionBy(P, "target_table"))
    return (assign.where(F.col(P).isNotNull() & F.col("target_table").isNotNull()).withColumn("_last", last)
            .where(F.col("stmt_order") == F.col("_last")).drop("_last"))


def written_last_definition(assign: DataFrame, name: str) -> DataFrame:
    """:func:`last_definition`, written, for steps that read it several times."""
    return graph.materialize(last_definition(assign), scratch_path(assign.sparkSession, name))


def defined_tables(assign: DataFrame) -> DataFrame:
    return assign.select(P, F.col("target_table").alias("table")).distinct()


def resolve_aliases(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """``join_alias_resolve``: refs(pipeline_id, stmt_order, ..., alias, column)
    + sources(pipeline_id, stmt_order, alias, table, ordinal) -> source_table.

    alias found -> its table; alias given but unknown -> the alias itself;
    no alias -> the only source, else the first source (lowest ordinal)."""
    k = [P, "stmt_order"]
    by_alias = sources.select(*k, F.col("alias").alias("_al"), F.col("table").alias("_by_alias"))
    per_stmt = sources.groupBy(*k).agg(
        F.count(F.lit(1)).alias("_nsrc"),
        F.min_by("table", "ordinal").alias("_first"))
    r = refs.withColumn("_al", F.col("alias")).join(by_alias, k + ["_al"], "left")
    r = r.join(per_stmt, k, "left")
    return r.withColumn("source_table", F.when(F.col("alias").isNotNull(),
                                               F.coalesce("_by_alias", "alias"))
                        .otherwise(F.col("_first"))).drop("_al", "_by_alias", "_nsrc", "_first")


def table_edges(assign: DataFrame) -> DataFrame:
    """Immediate table edges target -> source (distinct)."""
    return (assign.where(F.col("source_table").isNotNull())
            .select(P, "target_table", "source_table").distinct())


def base_tables(assign: DataFrame, name: str = "base_tables") -> DataFrame:
    """``lin_base_tables``: target table -> base tables through intermediates,
    cycle-safe. Base tables are those no statement defines, and defined ones
    without sources."""
    e = graph.materialize(table_edges(assign), scratch_path(assign.sparkSession, name + "-edges"))
    pairs = graph.terminals(e, [P, "target_table"], [P, "source_table"], name=name)
    reached = pairs.select(F.col(f"start_{P}").alias(P), F.col("start_target_table")
                           .alias("target_table"), F.col("target_table").alias("base_table"))
    # a table listing itself as a source keeps itself (reference behaviour)
    selfref = e.where(F.col("target_table") == F.col("source_table")).select(
        P, "target_table", F.col("source_table").alias("base_table"))
    return reached.unionByName(selfref).distinct()


def base_tables_anti(assign: DataFrame) -> DataFrame:
    """``join_base_tables_anti``: source tables never defined as targets."""
    src = assign.where(F.col("source_table").isNotNull()).select(
        P, F.col("source_table").alias("table")).distinct()
    return src.join(shuffled(defined_tables(assign)), [P, "table"], "left_anti")


# ------------------------------------------------------------------ star expansion


def rename_map(assign: DataFrame, subqueries: DataFrame | None = None) -> DataFrame:
    """(pipeline, _t, _from, _to): the name under which a statement with a star
    passes a source's column on. ``SELECT *, x AS y`` passes ``x`` on as ``y``;
    ``subqueries`` (pipeline_id, target_table, source_name, target_name) lists the
    renames of subqueries below the star. A name renamed twice keeps the smallest."""
    stars = assign.where(F.col("target_column") == "*").select(P, "target_table").distinct()
    own = (assign.where((F.col("target_column") != "*") & F.col("source_column").isNotNull())
           .join(shuffled(stars), [P, "target_table"], "left_semi")
           .select(P, F.col("target_table").alias("_t"), F.col("source_column").alias("_from"), F.col("target_column").alias("_to")))
    if subqueries is not None:
        own = own.unionByName(subqueries.select(P, F.col("target_table").alias("_t"), F.col("source_name").alias("_from"),
                                                F.col("target_name").alias("_to")))
    return own.where("_from != _to").groupBy(P, "_t", "_from").agg(F.min("_to").alias("_to"))


def expand_star(assign: DataFrame, name: str = "star", subqueries: DataFrame | None = None) -> DataFrame:
    """``lin_expand_star``: replace ``SELECT *`` rows by one pass-through row
    per column of the source table: its own columns and, through nested stars,
    those of the tables it expands, each under the name that the renames on the
    way give it (:func:`rename_map`). Columns the target defines itself are kept
    as defined. Returns rows in the assignments schema with ``expression`` null
    and extra ``star_owner`` and ``star_column`` (table and column that own it).

    The closure runs over names, not tables: a round passes the names that are
    new in a table on to the tables that expand it, renamed, and keeps those not
    yet known there, so the nearest owner wins (then the smallest) and cycles of
    stars end. Its rows are bounded by the names each table has in the end."""
    spark = assign.sparkSession
    stars = assign.where(F.col("target_column") == "*").select(
        P, "stmt_order", "target_table", F.col("source_table").alias("_src"))
    own = (assign.where((F.col("target_column") != "*"))
           .select(P, F.col("target_table").alias("_t"), F.col("target_column").alias("_name")).distinct())
    root = scratch_path(spark, name)
    count = F.count(F.lit(1))
    renames, n_renames = graph.materialize_observed(rename_map(assign, subqueries), f"{root}/renames", rows=count)
    edges, n_edges = graph.materialize_observed(stars.select(P, F.col("target_table").alias("_t"), F.col("_src").alias("_s"))
                              .where("_t != _s").distinct(), f"{root}/stars", rows=count)
    owner = F.struct(F.col("_t").alias("_owner"), F.col("_name").alias("_column"))
    few = lambda df: graph.sized(df, n_edges["rows"])
    needed = edges.select(P, F.col("_s").alias("_t")).distinct()  # tables that some star expands
    new, told = graph.materialize_observed(own.join(few(needed), [P, "_t"], "left_semi").withColumn("_of", owner),
                                           f"{root}/names/round=0", rows=count)
    r, onward = 0, edges.join(few(needed), [P, "_t"], "left_semi")
    renamed = graph.sized(renames, n_renames["rows"])
    while told["rows"]:
        r += 1
        known = spark.read.parquet(f"{root}/names").select(P, "_t", "_name")
        passed = new.withColumnRenamed("_t", "_s").join(few(onward), [P, "_s"]).withColumnRenamed("_name", "_from").join(
            renamed, [P, "_t", "_from"], "left").select(P, "_t", F.coalesce("_to", "_from").alias("_name"), "_of")
        new, told = graph.materialize_observed(
            passed.groupBy(P, "_t", "_name").agg(F.min("_of").alias("_of")).join(shuffled(known), [P, "_t", "_name"], "left_anti"),
            f"{root}/names/round={r}", rows=count)
    names = spark.read.parquet(f"{root}/names").select(P, F.col("_t").alias("_src"), F.col("_name").alias("_from"), "_of")
    exp = (stars.join(shuffled(names), [P, "_src"])
           .join(renamed.withColumnRenamed("_t", "target_table"), [P, "target_table", "_from"], "left")
           .select(P, "stmt_order", "target_table", F.coalesce("_to", "_from").alias("target_column"),
                   F.lit(None).cast("int").alias("ordinal"),
                   F.col("_src").alias("source_table"), F.col("_from").alias("source_column"),
                   F.lit(None).cast("string").alias("expression"),
                   F.col("_of._owner").alias("star_owner"), F.col("_of._column").alias("star_column")))
    # explicit columns of the same target win over expanded ones
    explicit = own.select(P, F.col("_t").alias("target_table"), F.col("_name").alias("target_column"))
    return exp.join(shuffled(explicit), [P, "target_table", "target_column"], "left_anti")


def with_stars_expanded(assign: DataFrame, name: str = "star", subqueries: DataFrame | None = None) -> DataFrame:
    """Assignments with star rows replaced by their expansion."""
    none = F.lit(None).cast("string")
    plain = assign.where(F.col("target_column") != "*").withColumns({"star_owner": none, "star_column": none})
    return plain.unionByName(expand_star(assign, name, subqueries))


# ------------------------------------------------------------------ base columns


def column_edges(assign: DataFrame) -> DataFrame:
    """Edges (target table, column) -> (source table, column)."""
    return (assign.where(F.col("source_table").isNotNull() & F.col("source_column").isNotNull()
                         & (F.col("target_column") != "*"))
            .select(P, "target_table", "target_column", "source_table", "source_column")
            .distinct())


def column_terminals(assign: DataFrame, name: str = "base_columns",
                     defined: DataFrame | None = None) -> DataFrame:
    """Every column with the end points of its references: columns of tables
    that no statement defines (``is_base``), and columns of defined tables
    that reference nothing or that their table does not have. Star rows must
    be expanded first. ``defined`` lists the tables statements define
    (default: the targets of ``assign``)."""
    pairs = graph.terminals(column_edges(assign), [P, "target_table", "target_column"],
                            [P, "source_table", "source_column"], name=name)
    d = (defined if defined is not None else defined_tables(assign)).select(
        P, F.col("table").alias("end_table"), F.lit(False).alias("is_base"))
    ends = pairs.select(F.col(f"start_{P}").alias(P),
                        F.col("start_target_table").alias("target_table"),
                        F.col("start_target_column").alias("target_column"),
                        F.col("target_table").alias("end_table"),
                        F.col("target_column").alias("end_column"))
    return ends.join(shuffled(d), [P, "end_table"], "left").select(
        P, "target_table", "target_column", "end_table", "end_column",
        F.coalesce("is_base", F.lit(True)).alias("is_base"))


def base_columns(assign: DataFrame, name: str = "base_columns",
                 defined: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """``lin_base_columns``: (table, column) -> base (table, column)."""
    ends = ends if ends is not None else column_terminals(assign, name, defined)
    return ends.where("is_base").select(P, "target_table", "target_column",
                                        F.col("end_table").alias("base_table"),
                                        F.col("end_column").alias("base_column"))


def _donors(cols: DataFrame, bases: DataFrame) -> DataFrame:
    """Per (pipeline, column name) the earliest target with base columns."""
    has = bases.select(P, "target_table", "target_column").distinct()
    return cols.join(shuffled(has), [P, "target_table", "target_column"], "left_semi").groupBy(
        P, "target_column").agg(F.min(F.struct("_ord", "target_table"))["target_table"]
                                .alias("fallback_table"))


def name_fallback(assign: DataFrame, ends: DataFrame, path: str | None = None) -> DataFrame:
    """``lin_name_fallback``: where a reference ends in a column of a defined
    table without sources (``ends`` not ``is_base``, or such a target column
    itself), the base columns of the earliest other target that defines the
    end column's name and has some; columns left without any then do the same
    by their own name. Rows shaped like ``bases`` plus ``fallback_table``;
    columns that are referenced but not defined have rows of their own.

    One aggregate finds a donor per (pipeline, name); the rest are joins
    linear in the columns -- no pairing of missing columns with donors."""
    key = [P, "target_table", "target_column"]
    root = path or scratch_path(assign.sparkSession, "fallback")
    # columns and known bases are written: both are read several times
    cols = graph.materialize(assign.where(F.col("target_column") != "*").groupBy(*key)
                             .agg(F.min("stmt_order").alias("_ord")), f"{root}/columns")
    bases = base_columns(assign, ends=ends)
    open_ends = ends.where(~F.col("is_base"))
    leaves = open_ends.select(P, F.col("end_table").alias("target_table"),
                              F.col("end_column").alias("target_column")).distinct()
    lone = cols.select(*key).join(shuffled(ends.select(*key).distinct()), key, "left_anti")
    lone = lone.join(shuffled(column_edges(assign).select(*key).distinct()), key, "left_anti")
    itself = leaves.unionByName(lone).distinct().select(
        *key, F.col("target_table").alias("end_table"), F.col("target_column").alias("end_column"))

    def taken(rows: DataFrame, donors: DataFrame, by: DataFrame, part: str) -> DataFrame:
        """Base columns of the donor of each row's end column. The donors' come
        first and are counted: a name is one key for all rows that end in it. The
        donors are counted before: few of them need no shuffle of all base columns."""
        d, told = graph.materialize_observed(donors.withColumnRenamed("target_column", "end_column"),
                                             f"{root}/{part}-donors", rows=F.count(F.lit(1)))
        b = by.select(P, F.col("target_table").alias("fallback_table"),
                      F.col("target_column").alias("end_column"), "base_table", "base_column")
        given, told = graph.materialize_observed(b.join(graph.sized(d, told["rows"]), [P, "fallback_table", "end_column"]),
                                                 f"{root}/{part}", rows=F.count(F.lit(1)))
        return rows.join(graph.sized(given, told["rows"]), [P, "end_column"]).select(
            *key, "base_table", "base_column", "fallback_table").distinct()

    first = taken(open_ends.select(*key, "end_table", "end_column").unionByName(itself),
                  _donors(cols, bases), bases, "given1")
    first = graph.materialize(first, f"{root}/first")  # read three times below
    known = graph.materialize(bases.unionByName(first.drop("fallback_table")).distinct(), f"{root}/known")
    still = cols.select(*key).join(shuffled(known.select(*key).distinct()), key, "left_anti").select(
        *key, F.col("target_table").alias("end_table"), F.col("target_column").alias("end_column"))
    return first.unionByName(taken(still, _donors(cols, known), known, "given2"))


def pipeline_schema(assign: DataFrame, default_schema: str | None = None) -> DataFrame:
    """Schema per pipeline: the argument, else the first dotted table name in
    statement order (target before its sources), else ``default``."""
    if default_schema:
        return assign.select(P).distinct().withColumn("schema", F.lit(default_schema))
    cand = assign.select(P, "stmt_order", F.lit(0).alias("_pos"), F.lit(0).alias("_ord"),
                         F.col("target_table").alias("_t")).unionByName(
        assign.select(P, "stmt_order", F.lit(1).alias("_pos"),
                      F.coalesce("ordinal", F.lit(0)).alias("_ord"), F.col("source_table").alias("_t")))
    dotted = cand.where(F.col("_t").contains("."))
    first = dotted.groupBy(P).agg(F.min_by("_t", F.struct("stmt_order", "_pos", "_ord", "_t"))
                                  .alias("_first"))
    pipes = assign.select(P).distinct()
    return pipes.join(shuffled(first), P, "left").select(
        P, F.coalesce(F.substring_index("_first", ".", 1), F.lit("default")).alias("schema"))


def counted_schema(assign: DataFrame, default_schema: str | None = None, name: str = "schema") -> DataFrame:
    """:func:`pipeline_schema`, written, as a join side by its counted rows: left to
    itself a join with few pipelines broadcasts the tables if their files are smaller."""
    written, told = graph.materialize_observed(pipeline_schema(assign, default_schema), scratch_path(assign.sparkSession, name),
                                               rows=F.count(F.lit(1)))
    return graph.sized(written, told["rows"])


def resolve(assign: DataFrame, fallback: bool = True, name: str = "resolve"):
    """Latest definitions, star-expanded valid columns, and the base columns
    of every column (with the name fallback; also of referenced columns that
    no statement defines). Returns (latest, a, bases)."""
    root = scratch_path(assign.sparkSession, name)
    latest = graph.materialize(last_definition(assign), f"{root}/latest")
    # every later step reads the expanded rows several times
    a = graph.materialize(with_stars_expanded(latest, name + "-star")
                          .where(valid_column_name("target_column")), f"{root}/assignments")
    ends = column_terminals(a, name + "-cols", defined_tables(latest))
    if fallback:  # reads the ends often
        ends = graph.materialize(ends, f"{root}/ends")
    bases = base_columns(a, ends=ends)
    if fallback:
        bases = graph.materialize(
            bases.unionByName(name_fallback(a, ends, f"{root}/fallback").drop("fallback_table")).distinct(),
            f"{root}/bases")
    return latest, a, bases


def final_lineage(assign: DataFrame, default_schema: str | None = None,
                  fallback: bool = True, name: str = "final", resolved=None,
                  schema: DataFrame | None = None) -> DataFrame:
    """``lin_final``: one row per (pipeline, target table, target column):
    sorted qualified base columns and sorted non-bare expressions. A job that
    has resolved the assignments (or their schemas) already passes them on."""
    latest, a, bases = resolved or resolve(assign, fallback, name)
    if schema is None:
        schema = counted_schema(assign, default_schema, name + "-schema")
    q = (bases.where(not_na_table("base_table") & valid_column_name("base_column"))
         .join(schema, P)
         .select(P, "target_table", "target_column",
                 F.concat(schema_prefix("base_table", "schema"), F.lit("."), F.col("base_column"))
                 .alias("_src")))
    srcs = q.groupBy(P, "target_table", "target_column").agg(
        F.sort_array(F.collect_set("_src")).alias("source_columns"))
    # expressions: own definition, or the owner's for star-expanded columns
    own_expr = a.where(F.col("expression").isNotNull() & ~bare_column("expression")).select(
        P, "target_table", "target_column", "expression")
    star_expr = (a.where(F.col("star_owner").isNotNull())
                 .select(P, "target_table", "target_column", F.col("star_owner").alias("_o"), F.col("star_column").alias("_oc"))
                 .join(shuffled(own_expr.select(P, F.col("target_table").alias("_o"),
                                                F.col("target_column").alias("_oc"), "expression")),
                       [P, "_o", "_oc"]).drop("_o", "_oc"))
    exprs = own_expr.unionByName(star_expr).groupBy(P, "target_table", "target_column").agg(
        F.sort_array(F.collect_set("expression")).alias("expressions"))
    cols = a.select(P, "target_table", "target_column").distinct()
    empty = F.array().cast("array<string>")
    return (cols.join(shuffled(srcs), [P, "target_table", "target_column"], "left")
            .join(shuffled(exprs), [P, "target_table", "target_column"], "left")
            .select(P, "target_table", "target_column",
                    F.coalesce("source_columns", empty).alias("source_columns"),
                    F.coalesce("expressions", empty).alias("expressions")))


# ------------------------------------------------------------------ multi-hop graph


def multi_hop_nodes(assign: DataFrame, latest: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """``lin_multi_hop_nodes``: table nodes, column nodes (valid names, no
    stars) and nodes for base tables, unique per (pipeline, id). A job that has
    the latest definitions and their base tables already passes them on."""
    a = latest if latest is not None else written_last_definition(assign, "nodes-latest")
    tables = a.select(P, F.col("target_table").alias("id"), F.col("target_table").alias("label"),
                      F.lit("table").alias("type"), F.lit(None).cast("string").alias("parent_id"))
    cols = (a.where((F.col("target_column") != "*") & valid_column_name("target_column"))
            .select(P, F.concat("target_table", F.lit("."), "target_column").alias("id"),
                    F.col("target_column").alias("label"), F.lit("column").alias("type"),
                    F.col("target_table").alias("parent_id")))
    bases = (reached if reached is not None else base_tables(a, "nodes-base")).select(
        P, F.col("base_table").alias("id"), F.col("base_table").alias("label"),
        F.lit("table").alias("type"), F.lit(None).cast("string").alias("parent_id"))
    bases = bases.join(shuffled(defined_tables(a).select(P, F.col("table").alias("id"))), [P, "id"],
                       "left_anti")
    return tables.unionByName(cols).unionByName(bases).dropDuplicates([P, "id"]) \
        .withColumnRenamed(P, "graph_id")


def multi_hop_edges(assign: DataFrame, name: str = "edges", resolved=None) -> DataFrame:
    """``lin_multi_hop_edges``: table-level edges (immediate source -> target)
    and column-level edges from base columns to each target column, labelled
    ``Direct Pass-Through`` or the expression cut to 150 characters; unique
    per (source, target, logic)."""
    a, _, bases = resolved or resolve(assign, True, name)
    t_edges = table_edges(a).select(
        F.col(P).alias("graph_id"), F.col("source_table").alias("source"),
        F.col("target_table").alias("target"), F.lit("table_level").alias("flow_type"),
        F.lit(None).cast("string").alias("logic"))
    refs = a.where(F.col("source_table").isNotNull() & F.col("source_column").isNotNull()
                   & (F.col("target_column") != "*") & valid_column_name("target_column")
                   & valid_column_name("source_column"))
    refs = refs.select(P, "target_table", "target_column", "source_table", "source_column",
                       F.when(F.col("expression").isNull(), F.lit(DIRECT_LOGIC))
                       .otherwise(T.truncate("expression", GRAPH_LOGIC_LEN)).alias("logic"))
    d = defined_tables(a).select(P, F.col("table").alias("source_table"), F.lit(True).alias("_def"))
    r = refs.join(shuffled(d), [P, "source_table"], "left")
    via = (r.where(F.col("_def")).join(
        shuffled(bases.select(P, F.col("target_table").alias("source_table"),
                              F.col("target_column").alias("source_column"), "base_table", "base_column")),
        [P, "source_table", "source_column"])
        .select(P, "target_table", "target_column", "logic",
                F.col("base_table").alias("st"), F.col("base_column").alias("sc")))
    direct = r.where(F.col("_def").isNull()).select(
        P, "target_table", "target_column", "logic",
        F.col("source_table").alias("st"), F.col("source_column").alias("sc"))
    c_edges = via.unionByName(direct).where(valid_column_name("sc")).select(
        F.col(P).alias("graph_id"), F.concat("st", F.lit("."), "sc").alias("source"),
        F.concat("target_table", F.lit("."), "target_column").alias("target"),
        F.lit("column_level").alias("flow_type"), "logic")
    return dedup_edges(t_edges.unionByName(c_edges))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """``set_dedup_edges``: unique (graph, source, target, logic or '')."""
    return (edges.withColumn("_lk", F.coalesce("logic", F.lit("")))
            .dropDuplicates(["graph_id", "source", "target", "_lk"]).drop("_lk"))


# ------------------------------------------------------------------ repair


def validate_fix(final: DataFrame, default_table: str,
                 repair_passthrough: bool = False) -> DataFrame:
    """``lin_validate_fix`` on final lineage rows (target_column,
    source_columns, expressions): drop sources no expression mentions and
    duplicates, add referenced-but-missing columns under the first 3-part
    source whose table holds ``raw`` (else ``default_table``), and list the
    issues. Definitions without expressions are left alone unless
    ``repair_passthrough`` (the reference wipes them)."""
    refs = F.array_distinct(F.transform(
        F.flatten(F.transform(F.coalesce("expressions", F.array().cast("array<string>")),
                              T.column_refs)), T.strip_derv))
    col_base = lambda s: T.strip_derv(F.element_at(F.split(s, r"\."), -1))
    f = final.withColumn("_refs", refs)
    existing = F.coalesce(F.col("source_columns"), F.array().cast("array<string>"))
    referenced = F.filter(existing, lambda s: F.array_contains(F.col("_refs"), col_base(s)))
    f = (f.withColumn("_unused", F.filter(existing, lambda s: ~F.array_contains(F.col("_refs"),
                                                                                col_base(s))))
         .withColumn("_kept", F.array_distinct(referenced))
         .withColumn("_dups", F.array_distinct(F.filter(
             referenced, lambda s: F.size(F.filter(referenced, lambda x: x == s)) > 1))))
    kept_bases = F.transform("_kept", col_base)
    f = f.withColumn("_missing", F.array_except("_refs", kept_bases))
    raw_tables = F.filter(
        F.transform("_kept", lambda s: F.when(F.size(F.split(s, r"\.")) >= 3, F.regexp_extract(
            s, r"^(.*)\.[^.]*$", 1))),
        lambda t: t.isNotNull() & F.lower(t).contains("raw"))
    home = F.try_element_at(raw_tables, F.lit(1))
    added_raw = F.transform("_missing", lambda m: F.concat(home, F.lit("."), m))
    added_def = F.transform("_missing", lambda m: F.concat(F.lit(default_table + "."), m))
    added = F.when(F.size("_missing") == 0, F.array().cast("array<string>")).when(
        home.isNotNull(), added_raw).otherwise(added_def)
    f = f.withColumn("_added", F.sort_array(F.array_distinct(
        F.filter(added, lambda x: ~F.array_contains(F.col("_kept"), x)))))
    new_sources = F.concat("_kept", "_added")
    tc = F.col("target_column")

    def issue(tpl: str, arr: str) -> Column:
        pre, post = tpl.split("{cols}")
        pre = pre.replace("{target_column}", "\0")
        a, b = pre.split("\0")
        return F.when(F.size(arr) > 0, F.concat(F.lit(a), tc, F.lit(b),
                                                F.array_join(F.sort_array(arr), ", "), F.lit(post)))
    issues = F.array_compact(F.array(issue(ISSUE_DUPLICATES, "_dups"),
                                     issue(ISSUE_UNUSED, "_unused"),
                                     issue(ISSUE_ADDED, "_added")))
    touch = F.lit(True) if repair_passthrough else (F.size(F.coalesce(
        "expressions", F.array().cast("array<string>"))) > 0)
    keys = [c for c in final.columns if c not in ("source_columns", "expressions")]
    return f.select(*keys,
                    F.when(touch, new_sources).otherwise(F.col("source_columns")).alias("source_columns"),
                    "expressions",
                    F.when(touch, issues).otherwise(F.array().cast("array<string>")).alias("issues"))


# ------------------------------------------------------------------ simple CTAS


# Fixed patterns of the simple CREATE TABLE ... AS SELECT extraction.
CTAS_TARGET = r"(?i)create\s+table\s+(\w+)\s+as"
CTAS_SELECT = r"(?is)select\s+(.*?)\s+from"
CTAS_FROM = r"(?i)from\s+([\w.]+)(?:\s+(\w+))?"
CTAS_AS_SPLIT = r"(?i)\s+as\s+"
SIMPLE_SQL_EXCLUDES = ["case", "concat", "replace"]


def simple_ctas(statements: DataFrame, sql: str = "sql_text") -> DataFrame:
    """``lin_simple_ctas``: regex extraction from ``CREATE TABLE t AS SELECT
    cols FROM src [alias]`` -> one row per select item with its target table,
    source table, alias, source column and target column. Statements without
    a target, select list or FROM give no rows."""
    s = F.regexp_replace(F.col(sql), r"^\s+|\s+$", "")
    target = F.regexp_extract(s, CTAS_TARGET, 1)
    clause = F.regexp_extract(s, CTAS_SELECT, 1)
    src = F.regexp_extract(s, CTAS_FROM, 1)
    alias = F.regexp_extract(s, CTAS_FROM, 2)
    base = statements.select(P, "stmt_order", target.alias("target_table"),
                             clause.alias("_clause"), src.alias("source_table"),
                             F.when(alias != "", alias).alias("source_alias"),
                             s.rlike(CTAS_SELECT).alias("_has_select"))
    base = base.where((F.col("target_table") != "") & F.col("_has_select")
                      & (F.col("source_table") != ""))
    items = base.select(P, "stmt_order", "target_table", "source_table", "source_alias",
                        F.posexplode(F.split("_clause", ",")).alias("position", "_item"))
    space = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    item = space(F.col("_item"))
    has_as = item.rlike(CTAS_AS_SPLIT)
    parts = F.split(item, CTAS_AS_SPLIT)
    last_dot = lambda x: F.element_at(F.split(x, r"\."), -1)
    p0 = F.element_at(parts, 1)
    source_col = F.when(has_as, last_dot(p0)).otherwise(last_dot(item))
    target_col = F.when(has_as, F.try_element_at(parts, F.lit(2))).otherwise(source_col)
    return items.select(P, "stmt_order", "target_table", "source_table", "source_alias",
                        "position", space(source_col).alias("source_column"),
                        space(target_col).alias("target_column"))


def simple_gate(statements: DataFrame, sql: str = "sql_text") -> DataFrame:
    """``lin_simple_gate``: a statement may use the CTAS fallback when its text
    has no case / concat / replace (any case) and exactly one lower-case
    ``create table``."""
    low = F.lower(F.col(sql))
    ok = F.lit(True)
    for w in SIMPLE_SQL_EXCLUDES:
        ok = ok & ~low.contains(w)
    n_create = (F.length(sql) - F.length(F.replace(F.col(sql), F.lit("create table"), F.lit("")))) \
        / F.lit(len("create table"))
    return statements.select(P, "stmt_order", F.coalesce(ok & (n_create == 1), F.lit(False))
                             .alias("is_simple"))
