"""Extraction of metric mentions, switchers, and lineage graphs as node and edge tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators.durable import materialize, shared_dir, without_shuffle_files
from reportweave.operators.greedy import shuffled
from reportweave.sources.adapters import latest

SOURCES = ["named_measure", "visual_binding", "visual_breakdown", "mark_card", "summary"]


def extract_mentions(sheets: DataFrame) -> DataFrame:
    """(ws, name, source, agg, lineage) of sheets(ws, measures array<struct<name,agg,field>>, dims, marks array<struct>, summary array).

    Named measures, their visual bindings, each measure broken down by each dimension, mark cards, and names in summaries.
    """
    empty = F.array().cast("array<string>")
    m = sheets.select("ws", F.explode("measures").alias("m"), "dims")
    named = m.select("ws", F.col("m.name").alias("name"), F.lit("named_measure").alias("source"), F.col("m.agg").alias("agg"), F.array("m.field").alias("lineage"))
    bound = m.select("ws", F.concat_ws(" of ", "m.agg", "m.field").alias("name"), F.lit("visual_binding").alias("source"), F.col("m.agg").alias("agg"), F.array("m.field").alias("lineage"))
    split = m.select("ws", F.explode("dims").alias("d"), "m").select("ws", F.concat("m.agg", F.lit(" of "), "m.field", F.lit(" by "), "d").alias("name"), F.lit("visual_breakdown").alias("source"), F.col("m.agg").alias("agg"), F.array("m.field").alias("lineage"))
    marks = sheets.select("ws", F.explode("marks").alias("m")).select("ws", F.concat_ws(" of ", "m.agg", "m.field").alias("name"), F.lit("mark_card").alias("source"), F.col("m.agg").alias("agg"), F.array("m.field").alias("lineage"))
    said = sheets.select("ws", F.explode("summary").alias("name")).select("ws", "name", F.lit("summary").alias("source"), X.infer_agg(F.col("name")).alias("agg"), empty.alias("lineage"))
    return reduce(DataFrame.unionByName, [named, bound, split, marks, said])


def dedupe_mentions(m: DataFrame) -> DataFrame:
    """Bindings and mark cards whose lineage and aggregation a named measure has go; then one row a sheet and name."""
    key = F.concat_ws("|", F.array_join(F.array_sort("lineage"), ","), F.upper("agg"))
    keyed = m.withColumn("k", key)
    named = keyed.filter("source = 'named_measure'").select("ws", "k").distinct()
    weak = F.col("source").isin("visual_binding", "mark_card")
    kept = keyed.filter(~weak).unionByName(keyed.filter(weak).join(named, ["ws", "k"], "left_anti").select(keyed.columns))
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return latest(kept.withColumn("n", F.lower("name")), ["ws", "n"], rank, "name").drop("k", "n")


def expand_switchers(calcs: DataFrame, depth: int = 3) -> DataFrame:
    """(calc_id, ref, depth): what a CASE formula switches between; a switcher among them is followed, `depth` times at most.

    calcs: calc_id, name, formula. A formula that begins with an aggregate is a metric, not a switcher.
    """
    refs = F.array_distinct(F.regexp_extract_all("formula", F.lit(r"(?i)THEN\s+\[([^\]]+)\]"), F.lit(1)))
    switch = F.upper("formula").contains("CASE") & ~F.col("formula").rlike(r"(?i)^\s*(SUM|AVG|AVERAGE|COUNT|COUNTD|MIN|MAX|MEDIAN)\s*\(")
    by_name = latest(calcs, ["name"], "calc_id").select(F.lower("name").alias("k"), switch.alias("more"), refs.alias("next"))
    level = calcs.filter(switch).select("calc_id", F.explode(refs).alias("ref"))
    out = None
    for n in range(1, depth + 1):
        known = level.join(by_name, F.lower("ref") == F.col("k"), "left")
        done = known.filter(~F.coalesce("more", F.lit(False))).select("calc_id", "ref", F.lit(n).alias("depth"))
        out = done if out is None else out.unionByName(done)
        level = known.filter("more").select("calc_id", F.explode("next").alias("ref"))
    return out.groupBy("calc_id", "ref").agg(F.min("depth").alias("depth"))


def qualified_lineage(calcs: DataFrame, columns: DataFrame) -> DataFrame:
    """(calc_id, lineage) of calcs(calc_id, formula): its field references, sorted, as `table.reference` where columns(column, table) has the
    reference, or else its lower-cased form, as a column; of several tables the least. A formula without references has an empty list."""
    known = columns.groupBy("column").agg(F.min("table").alias("table"))
    refs = calcs.select("calc_id", F.explode_outer(X.field_refs(F.col("formula"))).alias("ref"))
    exact, lower = known.toDF("ref", "t1"), known.toDF("low", "t2")
    met = refs.withColumn("low", F.lower("ref")).join(exact, "ref", "left").join(lower, "low", "left")
    name = F.concat(F.coalesce(F.concat(F.coalesce("t1", "t2"), F.lit(".")), F.lit("")), "ref")
    return met.groupBy("calc_id").agg(F.array_sort(F.collect_set(name)).alias("lineage"))


def graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Distinct (id, kind, label) and (src, dst, kind) of the parts; equal ids are one node with the least label."""
    n = reduce(DataFrame.unionByName, nodes).groupBy("id", "kind").agg(F.min("label").alias("label"))
    return n, reduce(DataFrame.unionByName, edges).distinct()


def calc_edges(calcs: DataFrame) -> DataFrame:
    """(src, dst): what each calculated field refers to, as `calc:` where a calculated field has that name in any case, else as `column:`. calcs: name, formula."""
    refs = calcs.select(F.concat(F.lit("calc:"), F.lower("name")).alias("src"), F.explode(X.field_refs(F.col("formula"))).alias("ref"))
    known = calcs.select(F.lower("name").alias("k")).distinct()
    named = refs.join(known, F.lower("ref") == F.col("k"), "left")
    return named.select("src", F.when(F.col("k").isNotNull(), F.concat(F.lit("calc:"), F.col("k"))).otherwise(F.concat(F.lit("column:"), "ref")).alias("dst")).distinct()


def deep_lineage(edges: DataFrame, starts: Column | None = None) -> DataFrame:
    """(src, dst, depth) of all that is reachable over any number of steps, at the least number. Cycles end, and may lead back to their start.

    starts: a condition on src; others are passed through but nothing is followed from them. Each round extends the last one's new pairs only and leaves out those reached before. It is written as a folder of its own beside the others,
    so that no round's plan holds another's. Edges and what was reached grow with the graph and are never broadcast.
    """
    spark = edges.sparkSession
    steps = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "lineage-steps")
    path = f"{shared_dir(spark)}/lineage-{uuid.uuid4().hex}"
    reached = lambda: spark.read.schema("src string, dst string, depth int").option("basePath", path).parquet(path)
    begun = steps if starts is None else steps.filter(starts)
    depth, fresh = 1, begun.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    while True:
        at = f"{path}/depth={depth}"
        with without_shuffle_files(spark):
            fresh.write.mode("overwrite").parquet(at)
        last = spark.read.schema("src string, dst string").parquet(at)
        if last.isEmpty():
            return reached()
        met = last.join(shuffled(steps.toDF("dst", "to")), "dst").select("src", F.col("to").alias("dst")).distinct()
        fresh = met.join(shuffled(reached().select("src", "dst")), ["src", "dst"], "left_anti")
        depth += 1


def shared_in_graph(edges: DataFrame) -> DataFrame:
    """Targets that several sources point to."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n")).filter("n > 1")
