"""Lineage graphs of whole estates: every workbook's and every dashboard's nodes and edges, as tables keyed by their owner.

Inputs, of which any may be empty:
workbooks(workbook, name), dashboards(dashboard, workbook, name), worksheets(sheet_id, workbook, dashboard, name, fields),
datasources(source, workbook, name, caption), tables(table_id, source, name, columns),
joins(source, left_table, right_table, join_type, left_column, right_column).

A worksheet without a dashboard is an orphan. Fields are distinct and sorted, without nulls and empty names. A join's type that is null
counts as inner. Rows with a null key have no node. One graph is a filter on its owner, which reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.operators.greedy import shuffled

VIEWS = {"full": ("worksheets", "tables"), "worksheets": ("worksheets",), "tables": ("tables",)}


def _id(kind: str, *key: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), *[F.col(k).cast("string") for k in key])


def _nodes(df: DataFrame, owner: str, id_: Column, label: str, kind, columns: Column | None = None) -> DataFrame:
    columns = F.lit(None) if columns is None else columns
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(owner).alias("owner"), id_.alias("id"), F.col(label).cast("string").alias("label"), kind.alias("type"), columns.cast("array<string>").alias("columns")).filter("id is not null")


def _edges(df: DataFrame, owner: str, source: Column, target: Column, label, join: bool = False) -> DataFrame:
    label = F.lit(label) if isinstance(label, str) else label
    extra = [F.col(c).cast("string").alias(c) if join else F.lit(None).cast("string").alias(c) for c in ("join_type", "left_column", "right_column")]
    prefix = F.lit("e_join_" if join else "e_")
    ends = df.select(F.col(owner).alias("owner"), F.concat(prefix, source, F.lit("__"), target).alias("id"), source.alias("source"), target.alias("target"), label.alias("label"), *extra)
    return ends.filter("id is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fields() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce("fields", F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != ""))))


def resolve_joins(tables: DataFrame, joins: DataFrame) -> DataFrame:
    """joins with left_id and right_id, the tables of the same datasource that have these names, the least id of equal names.

    A join with an end that its datasource lacks is left out. Two equi-joins on datasource and name; nothing meets across datasources.
    """
    first = tables.groupBy("source", "name").agg(F.min("table_id").alias("id"))
    left = first.select("source", F.col("name").alias("left_table"), F.col("id").alias("left_id"))
    right = first.select("source", F.col("name").alias("right_table"), F.col("id").alias("right_id"))
    typed = joins.withColumn("join_type", F.coalesce("join_type", F.lit("inner")))
    return typed.join(shuffled(left), ["source", "left_table"]).join(shuffled(right), ["source", "right_table"])


def _source_parts(datasources: DataFrame, tables: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the datasources and what is under them, owned by the workbook; without the edges that lead to datasources."""
    home = datasources.select("source", "workbook")
    held = tables.join(shuffled(home), "source")
    met = resolve_joins(tables, joins).join(shuffled(home), "source")
    shown = datasources.withColumn("shown", F.coalesce(F.nullif("caption", F.lit("")), "name"))
    says = F.concat(F.upper("join_type"), F.lit(" JOIN\n"), "left_column", F.lit(" = "), "right_column")
    nodes = [_nodes(shown, "workbook", _id("ds", "source"), "shown", "Datasource"), _nodes(held, "workbook", _id("tbl", "table_id"), "name", "Table", F.coalesce("columns", F.array().cast("array<string>")))]
    edges = [_edges(held, "workbook", _id("ds", "source"), _id("tbl", "table_id"), "FROM"), _edges(met, "workbook", _id("tbl", "left_id"), _id("tbl", "right_id"), says, join=True)]
    return _union(nodes), _union(edges)


def workbook_graph(workbooks: DataFrame, dashboards: DataFrame, worksheets: DataFrame, datasources: DataFrame, tables: DataFrame, joins: DataFrame, view: str = "full") -> tuple[DataFrame, DataFrame]:
    """(owner, id, label, type, columns) and (owner, id, source, target, label, join_type, left_column, right_column) of all workbooks.

    view: full, worksheets or tables. A worksheet's node is its name in the workbook; one that dashboards show more than once is a duplicate.
    Its fields are those of the first dashboard that shows it with any. A node occurs once, an edge once for each row that it comes from.
    Names are grouped once; all other nodes are single by their keys, so nothing else is shuffled for them.
    """
    parts = VIEWS[view]
    nodes = [_nodes(workbooks, "workbook", _id("workbook", "workbook"), "name", "Workbook")]
    edges = []
    if "worksheets" in parts:
        nodes.append(_nodes(dashboards, "workbook", _id("dashboard", "dashboard"), "name", "Dashboard"))
        sheets = worksheets.withColumn("fields", _fields())
        used = F.col("dashboard").isNotNull()
        plotted = used & (F.size("fields") > 0)
        names = sheets.groupBy("workbook", "name").agg(
            F.count_if(used).alias("uses"), F.min_by("fields", F.when(plotted, F.struct("dashboard", "sheet_id"))).alias("fields")
        )
        kind = F.when(F.col("uses") > 1, "Worksheet (Duplicate)").otherwise("Worksheet")
        nodes.append(_nodes(names, "workbook", _id("ws_name", "name"), "name", kind))
        fields = names.filter("fields is not null").withColumn("said", F.lit("Fields Used"))
        nodes.append(_nodes(fields, "workbook", _id("fields_ws_name", "name"), "said", "Table", F.col("fields")))
        shown = sheets.filter(used)
        edges += [
            _edges(dashboards, "workbook", _id("workbook", "workbook"), _id("dashboard", "dashboard"), "CONTAINS"),
            _edges(shown, "workbook", _id("dashboard", "dashboard"), _id("ws_name", "name"), "RENDERS"),
            _edges(shown.filter(F.size("fields") > 0), "workbook", _id("ws_name", "name"), _id("fields_ws_name", "name"), "USES FIELDS"),
            _edges(sheets.filter(~used), "workbook", _id("workbook", "workbook"), _id("ws_name", "name"), "CONTAINS (Orphan)"),
        ]
    if "tables" in parts:
        under, inner = _source_parts(datasources, tables, joins)
        nodes.append(under)
        edges += [_edges(datasources, "workbook", _id("workbook", "workbook"), _id("ds", "source"), "CONTAINS"), inner]
    return _union(nodes), _union(edges)


def dashboard_graph(workbooks: DataFrame, dashboards: DataFrame, worksheets: DataFrame, datasources: DataFrame, tables: DataFrame, joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables with a dashboard as owner: its workbook, the workbook's datasources, its own worksheets by id and their fields.

    The workbook's tables are found once and then joined to its dashboards; a caller who wants some graphs passes their dashboards only.
    """
    booked = dashboards.join(workbooks.select("workbook", F.col("name").alias("book")), "workbook")
    under, inner = _source_parts(datasources, tables, joins)
    owners = booked.select(F.col("workbook").alias("book_id"), "dashboard")
    to_owner = lambda df: df.join(owners, F.col("owner") == F.col("book_id")).withColumn("owner", F.col("dashboard")).drop("book_id", "dashboard")
    uses = booked.select("workbook", "dashboard").join(datasources.select("workbook", "source"), "workbook")
    sheets = worksheets.join(dashboards.select("dashboard"), "dashboard", "left_semi").withColumn("fields", _fields())
    plotted = sheets.filter(F.size("fields") > 0).withColumn("said", F.lit("Fields Used"))
    nodes = [
        _nodes(dashboards, "dashboard", _id("dashboard", "dashboard"), "name", "Dashboard"),
        _nodes(booked, "dashboard", _id("workbook", "workbook"), "book", "Workbook"),
        to_owner(under),
        _nodes(sheets, "dashboard", _id("ws", "sheet_id"), "name", "Worksheet"),
        _nodes(plotted, "dashboard", _id("fields", "sheet_id"), "said", "Table", F.col("fields")),
    ]
    edges = [
        _edges(booked, "dashboard", _id("workbook", "workbook"), _id("dashboard", "dashboard"), "CONTAINS"),
        _edges(uses, "dashboard", _id("dashboard", "dashboard"), _id("ds", "source"), "USES"),
        to_owner(inner),
        _edges(sheets, "dashboard", _id("dashboard", "dashboard"), _id("ws", "sheet_id"), "RENDERS"),
        _edges(plotted, "dashboard", _id("ws", "sheet_id"), _id("fields", "sheet_id"), "USES FIELDS"),
    ]
    return _union(nodes), _union(edges)
