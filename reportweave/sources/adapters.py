"""Catalog-shaped views over the star-schema tables, as DataFrames and as the SQL that says the same.

A report is a customer; its metrics, tables, sources, sheets and marks come from all lines of its orders. Every report
whose number ends the right way gets a planted copy in the same block, whole or thinned out, so that all degrees
of likeness occur. A workbook holds one nation's reports among WORKBOOK_RUN customers in a row: a larger estate has more workbooks, not
larger ones, and pairs within a workbook grow in proportion to the estate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators.greedy import shuffled

SHIFT = 1_000_000
WORKBOOK_RUN = 2000
NATIONS = 25
LINES = 250_000  # of a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line: report_id, p_name, p_brand, p_type, p_size, l_suppkey, mark; with planted copies. Orders and parts grow with the estate and are never broadcast."""
    mark = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", mark.alias("mark"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    base = lines.join(shuffled(orders), lines["l_orderkey"] == orders["o_orderkey"]).join(shuffled(parts), lines["l_partkey"] == parts["p_partkey"])
    rest = F.col("o_custkey") % 20
    copied = (rest == 0) | ((rest == 5) & (F.col("l_partkey") % 7 != 0)) | ((rest == 10) & (F.col("l_partkey") % 3 != 0))
    ids = F.explode(F.when(copied, F.array(F.col("o_custkey"), F.col("o_custkey") + SHIFT)).otherwise(F.array("o_custkey")))
    return base.select(ids.alias("report_id"), "p_name", "p_brand", "p_type", "p_size", "l_suppkey", "mark")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ids = F.explode(F.when((F.col("c_custkey") % 20).isin(0, 5, 10), F.array(F.col("c_custkey"), F.col("c_custkey") + SHIFT)).otherwise(F.array("c_custkey")))
    workbook = F.col("c_nationkey") + NATIONS * F.floor(F.col("c_custkey") / WORKBOOK_RUN)
    return c.select(ids.alias("report_id"), workbook.alias("workbook"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks order lines go, about LINES each; no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def items(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(layer, report_id, item) of all layers, of all reports or those of(report_id). Lines go to their report first, once: being distinct and groupings by report need no further shuffle.

    There are as many tasks as lines ask for, as a given number of them would hold ever more lines each, and Spark joins small ones by compressed sizes."""
    entry = lambda name, item: F.struct(F.lit(name).alias("layer"), item.cast("string").alias("item"))
    all_ = F.array(
        entry("kpi", F.concat_ws(" ", "p_name", "p_type")),
        entry("model", F.concat_ws(" ", "p_type", F.col("p_size") % 10)),
        entry("source", F.col("l_suppkey") % 100),
        entry("visual", F.col("p_name")),
        entry("filter", F.col("mark")),
    )
    lines = facts(spark, sf_dir) if of is None else facts(spark, sf_dir).join(shuffled(of), "report_id", "left_semi")
    return lines.repartition(_tasks(spark, sf_dir), "report_id").select("report_id", F.explode(all_).alias("x")).select("x.layer", "report_id", "x.item").distinct()


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, sheet, axes): worksheets and what they plot. Lines go to their report first, as in items."""
    lines = facts(spark, sf_dir).select("report_id", "p_name", "p_type").repartition(_tasks(spark, sf_dir), "report_id")
    return lines.groupBy("report_id", F.col("p_name").alias("sheet")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("part"), "p_type"))).alias("axes"))


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, item, base, canonical, definition) of the kpi layer; the tables spell a metric in one way and define none."""
    k = items(spark, sf_dir).filter("layer = 'kpi'")
    return k.select("report_id", "item", X.base_metric(F.col("item")).alias("base"), F.col("item").alias("canonical"), F.lit(None).cast("string").alias("definition"))


#: The layers of items.
LAYERS = ["kpi", "model", "source", "visual", "filter"]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, days_ago, groups, n_orders, total, created): days since the last order before the last of all, who used it, and the day of the first."""
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    per = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("own"), F.array_sort(F.collect_set("o_orderpriority")).alias("groups"), F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first"))
    return per.join(F.broadcast(last)).select(F.col("o_custkey").alias("report_id"), F.datediff("last", "own").alias("days_ago"), "groups", "n_orders", "total", F.unix_date(F.to_date("first")).alias("created"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kpi_id, name, subdomain, lineage, aliases, agg)"""
    p = table(spark, sf_dir, "part")
    g = p.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("kpi_id"), F.array_sort(F.collect_set("p_brand")).alias("lineage"))
    agg = F.element_at(F.array(*[F.lit(x) for x in ("SUM", "AVG", "COUNT", "UNKNOWN")]), (F.col("kpi_id") % 4 + 1).cast("int"))
    aliases = F.array(F.concat(F.col("p_name"), F.lit(" total")), F.reverse("p_name"))
    return g.select("kpi_id", F.col("p_name").alias("name"), F.col("p_type").alias("subdomain"), "lineage", aliases.alias("aliases"), agg.alias("agg"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, report, subdomain, raw, sheet, lineage, agg): names as reports write them."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 7
    raw = (
        F.when(kind == 0, F.upper("p_name"))
        .when(kind == 1, F.concat(F.lit("Rank | "), "p_name"))
        .when(kind == 2, F.concat("p_name", F.lit(" by "), "p_brand"))
        .when(kind == 3, F.concat(F.substring("p_name", F.lit(1), F.length("p_name") - 1), F.lit("x")))
        .when(kind == 4, F.concat("p_name", F.lit(" total")))
        .when(kind == 5, F.concat(F.lit("Top BRAND - "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    agg = F.element_at(F.array(*[F.lit(x) for x in ("SUM", "AVERAGE", "CNT", "NONE", "PCT")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    sheet = F.concat(F.lit("KPI - "), F.reverse("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit(" | "), F.col("p_type"))))
    return p.select(F.col("p_partkey").alias("mention_id"), F.col("p_brand").alias("report"), F.col("p_type").alias("subdomain"), raw.alias("raw"), sheet.alias("sheet"), F.array("p_brand").alias("lineage"), agg.alias("agg"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mapping_id, report, ws, kpi, canonical, confidence)"""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mapping_id"), F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("ws"), F.col("p_name").alias("kpi"), F.col("p_brand").alias("canonical"), F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"), "l_shipdate")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(action_id, mapping_id, ts, action, value); events that act on nothing are left out."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "reassign")
    return e.select(F.col("event_id").alias("action_id"), F.col("user_id").alias("mapping_id"), "ts", kind.alias("action"), "value").filter("action is not null")


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(calc_id, name, sheet, formula)"""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    f = (
        F.when(kind == 0, F.concat(F.lit("SUM(["), "p_name", F.lit("])/COUNT(["), "p_brand", F.lit("])")))
        .when(kind == 1, F.concat(F.lit('CASE [p] WHEN "a" THEN ['), "p_name", F.lit('] WHEN "b" THEN ['), "p_type", F.lit("] END")))
        .when(kind == 2, F.concat(F.lit("["), "p_name", F.lit("]")))
        .when(kind == 3, F.concat(F.lit("average of "), "p_name"))
        .when(kind == 4, F.concat(F.lit("YEAR(["), "p_brand", F.lit("])")))
        .otherwise(F.concat(F.lit("AVG(["), "p_type", F.lit("].["), "p_name", F.lit("])")))
    )
    return p.select(F.col("p_partkey").alias("calc_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("sheet"), f.alias("formula"))


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, worksheets, calcs, sources, sector, subdomain) counted from orders' lines."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 3).alias("worksheets"), F.sum("l_quantity").cast("long").alias("calcs"), F.countDistinct("l_suppkey").alias("sources"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("sector"), F.when(F.substring("o_orderpriority", 1, 1) != "5", F.col("o_orderpriority")).alias("subdomain"))
    return m.join(o, m["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("report"), "worksheets", "calcs", "sources", "sector", "subdomain")


def latest(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


#: The same views for the oracle, each a name and its select.
SQL = {
    "facts": """
      SELECT unnest(CASE WHEN o_custkey % 20 = 0 OR (o_custkey % 20 = 5 AND l_partkey % 7 <> 0) OR (o_custkey % 20 = 10 AND l_partkey % 3 <> 0)
        THEN [o_custkey, o_custkey + 1000000] ELSE [o_custkey] END) AS report_id, p_name, p_brand, p_type, p_size, l_suppkey, l_returnflag || l_linestatus || l_linenumber AS mark
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "reports": """
      SELECT unnest(CASE WHEN c_custkey % 20 IN (0, 5, 10) THEN [c_custkey, c_custkey + 1000000] ELSE [c_custkey] END) AS report_id,
        c_nationkey + 25 * (c_custkey // 2000) AS workbook, c_mktsegment AS segment, c_name AS name, c_acctbal AS balance FROM customer""",
    "items": """
      SELECT DISTINCT 'kpi' AS layer, report_id, p_name || ' ' || p_type AS item FROM facts UNION SELECT 'model', report_id, p_type || ' ' || (p_size % 10) FROM facts
      UNION SELECT 'source', report_id, (l_suppkey % 100)::VARCHAR FROM facts UNION SELECT 'visual', report_id, p_name FROM facts UNION SELECT 'filter', report_id, mark FROM facts""",
    "sheets": "SELECT report_id, p_name AS sheet, list_sort(list(DISTINCT 'part ' || p_type)) AS axes FROM facts GROUP BY 1, 2",
    "usage": """
      SELECT o_custkey AS report_id, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS days_ago,
        list_sort(list(DISTINCT o_orderpriority)) AS groups, count(*) AS n_orders, sum(o_totalprice) AS total, date_diff('day', DATE '1970-01-01', min(o_orderdate)::DATE) AS created FROM orders GROUP BY 1""",
    "bank": """
      SELECT min(p_partkey) AS kpi_id, p_name AS name, p_type AS subdomain, list_sort(list(DISTINCT p_brand)) AS lineage,
        [p_name || ' total', reverse(p_name)] AS aliases, ['SUM','AVG','COUNT','UNKNOWN'][(min(p_partkey) % 4 + 1)::INT] AS agg
      FROM part GROUP BY p_name, p_type""",
    "mentions": """
      SELECT p_partkey AS mention_id, p_brand AS report, p_type AS subdomain, CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Rank | ' || p_name
        WHEN 2 THEN p_name || ' by ' || p_brand WHEN 3 THEN substr(p_name, 1, length(p_name) - 1) || 'x' WHEN 4 THEN p_name || ' total'
        WHEN 5 THEN 'Top BRAND - ' || p_name ELSE p_name END AS raw, 'KPI - ' || reverse(p_name) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' | ' || p_type END AS sheet, [p_brand] AS lineage,
        ['SUM','AVERAGE','CNT','NONE','PCT'][(p_partkey % 5 + 1)::INT] AS agg FROM part""",
    "mappings": """
      SELECT l_orderkey * 10 + l_linenumber AS mapping_id, l_orderkey AS report, l_linenumber AS ws, p_name AS kpi, p_brand AS canonical,
        round(1 - l_discount * 5, 2) AS confidence, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "actions": """
      SELECT event_id AS action_id, user_id AS mapping_id, ts, CASE event_type WHEN 'click' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'reassign' END AS action, value
      FROM events WHERE event_type IN ('click', 'error', 'purchase')""",
    "formulas": """
      SELECT p_partkey AS calc_id, p_name AS name, p_brand AS sheet, CASE p_partkey % 6 WHEN 0 THEN 'SUM([' || p_name || '])/COUNT([' || p_brand || '])'
        WHEN 1 THEN 'CASE [p] WHEN "a" THEN [' || p_name || '] WHEN "b" THEN [' || p_type || '] END' WHEN 2 THEN '[' || p_name || ']'
        WHEN 3 THEN 'average of ' || p_name WHEN 4 THEN 'YEAR([' || p_brand || '])' ELSE 'AVG([' || p_type || '].[' || p_name || '])' END AS formula FROM part""",
    "dashboards": """
      SELECT l_orderkey AS report, count(*) * 3 AS worksheets, sum(l_quantity)::BIGINT AS calcs, count(DISTINCT l_suppkey) AS sources,
        any_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END) AS sector, any_value(CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN o_orderpriority END) AS subdomain
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
}


def with_views(sql: str, *names: str) -> str:
    """sql (a select, or further CTEs and a select) after the CTEs of the named views."""
    need = ["facts", *names] if {"items", "sheets"} & set(names) and "facts" not in names else list(names)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in need)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
