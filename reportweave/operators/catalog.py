"""The catalog: imports, attachments, lookups, roll-ups and rankings of its tables, each a few joins or one grouping."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import scope as C
from reportweave.functions import text as X
from reportweave.operators.durable import materialize
from reportweave.operators.matching import first_near_names
from reportweave.sources.adapters import latest


def match_previews(tables: DataFrame, previews: DataFrame) -> DataFrame:
    """(archive, table, file) of tables(archive, table, source) and previews(archive, file) of one archive: names agree in letters and digits, one ends with or contains the other, or the file is named as the source. The first file in order of the alphabet wins."""
    t = tables.withColumns({"t": X.alnum_key(F.col("table")), "s": X.alnum_key(F.col("source"))})
    p = previews.withColumn("p", X.alnum_key(F.regexp_replace("file", r"\.[A-Za-z]+$", ""))).filter("p <> ''")
    hit = (F.col("t") != "") & (F.col("t").contains(F.col("p")) | F.col("p").contains(F.col("t"))) | (F.col("s") == F.col("p"))
    return t.join(p, "archive").filter(hit).groupBy("archive", "table").agg(F.min("file").alias("file"))


def import_bank(rows: DataFrame, bank: DataFrame, update: bool = False) -> DataFrame:
    """rows(row_id, name, definition, sector, subdomain, tab, applicability) with their scope and outcome: inserted, updated or skipped.

    The scope comes from the columns, else the tab's name, else the applicability. Names are unique in a scope: of several rows the first
    counts, the others are skipped; one that the bank(name, subdomain) has is updated, or skipped without `update`.
    """
    named = F.coalesce(C.valid_subdomain(F.lit(C.DEFAULT_SECTOR), F.col("subdomain")), C.canonical_subdomain(F.col("tab")), C.scope_from_list(F.col("applicability")))
    scoped = rows.select("row_id", F.trim("name").alias("name"), "definition", named.alias("scope"), F.lower(F.trim("name")).alias("k")).filter("name <> ''")
    first = F.row_number().over(W.partitionBy("k", "scope").orderBy("row_id")) == 1
    known = bank.select(F.lower(F.trim("name")).alias("k"), F.col("subdomain").alias("scope")).distinct().withColumn("known", F.lit(True))
    outcome = F.when(~F.col("first"), "skipped").when(F.col("known"), "updated" if update else "skipped").otherwise("inserted")
    return scoped.withColumn("first", first).join(known, ["k", "scope"], "left").select("row_id", "name", "definition", "scope", outcome.alias("outcome"))


def upsert_bank(rows: DataFrame, bank: DataFrame, values: list[str], update: bool = False) -> DataFrame:
    """(name, scope, *values, outcome, n_updated, n_skipped): the bank(name, scope, *values) after an import of rows(row_id, name, scope, *values).

    A row meets the bank's row of the same name and scope; names are unique in the bank. Of rows whose names differ in case only, the first is inserted if the bank
    lacks it, and others of another spelling that the bank lacks are skipped. With `update` each further row of a known spelling writes all
    values, so the last row's remain; without it they are skipped. Outcomes are kept, updated, inserted and skipped; the new bank is
    what isn't skipped. Rows without a name are left out; null scopes are one scope.

    Rows are grouped by spelling first, so a name that a third of the rows hold is one row before it meets anything.
    """
    scope = F.coalesce("scope", F.lit(""))
    named = rows.select("row_id", F.trim("name").alias("name"), scope.alias("scope"), F.struct(*values).alias("v")).filter("name <> ''")
    spelled = named.groupBy("name", "scope").agg(F.max_by("v", "row_id").alias("last"), F.min_by("v", "row_id").alias("one"), F.min("row_id").alias("at"), F.count("*").alias("n"))
    spelled = spelled.withColumn("leads", F.row_number().over(W.partitionBy(F.lower("name"), "scope").orderBy("at")) == 1)
    had = bank.select("name", scope.alias("scope"), F.struct(*values).alias("old"), F.lit(True).alias("had"))
    met = had.join(spelled, ["name", "scope"], "full_outer").withColumn("had", F.coalesce("had", F.lit(False)))
    met = met.withColumns({"n": F.coalesce("n", F.lit(0)), "lives": F.col("had") | F.col("leads")})
    change = F.lit(update) & F.col("lives") & (F.col("n") > 0)
    v = F.when(change, F.col("last")).when(F.col("had"), F.col("old")).otherwise(F.col("one"))
    outcome = F.when(~F.col("lives"), "skipped").when(~F.col("had"), "inserted").when(change, "updated").otherwise("kept")
    extra = F.col("n") - F.when(F.col("lives") & ~F.col("had"), 1).otherwise(0)
    return met.withColumn("v", v).select("name", "scope", *[F.col(f"v.{c}").alias(c) for c in values], outcome.alias("outcome"), F.when(change, extra).otherwise(0).alias("n_updated"), F.when(change, 0).otherwise(extra).alias("n_skipped"))


def load_usage(rows: DataFrame) -> DataFrame:
    """(key, days_ago, groups) of sheet rows(name, days, groups array): trimmed, lower-cased; a bad number is null."""
    clean = F.array_compact(F.transform("groups", lambda g: F.nullif(F.trim(g), F.lit(""))))
    return rows.select(F.lower(F.trim("name")).alias("key"), F.trim("days").try_cast("int").alias("days_ago"), clean.alias("groups")).filter("key <> ''")


def _floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def load_seed(spark: SparkSession, path: str, bank: DataFrame) -> DataFrame:
    """The bank, or if it is empty the seed file's rows (kpi_id, name, subdomain, aliases, embedding); vectors are packed floats in base64."""
    seed = spark.read.schema("kpi_id long, name string, subdomain string, aliases string, embedding string").json(path, multiLine=True)
    rows = seed.select("kpi_id", "name", "subdomain", X.split_list(F.col("aliases")).alias("aliases"), F.pandas_udf(_floats, "array<float>")(F.unbase64("embedding")).alias("embedding"))
    have = bank.select("kpi_id", "name", "subdomain", "aliases", "embedding")
    return rows.filter(F.lit(have.isEmpty())).unionByName(have)


def lookup_usage(dash: DataFrame, sheet: DataFrame, least: float = 0.85, unknown: int = 365) -> DataFrame:
    """(c_custkey, days, how) of dash(c_custkey, name) by sheet(row, key, days): exact name, else equal letters and digits, else a name more than `least` alike; the first row of the sheet of several."""
    first = lambda df: df.groupBy("k").agg(F.min_by("days", "row").alias("d"))
    exact = first(sheet.select("row", "days", F.lower("key").alias("k"))).toDF("k1", "d1")
    loose = first(sheet.select("row", "days", X.alnum_key(F.col("key")).alias("k"))).toDF("k2", "d2")
    named = dash.withColumns({"k1": F.lower("name"), "k2": X.alnum_key(F.col("name"))}).join(exact, "k1", "left").join(loose, "k2", "left")
    rest = named.filter("d1 is null and d2 is null").select(F.col("k1").alias("x"))
    alike = first_near_names(rest, sheet.select(F.lower("key").alias("y"), "row", F.col("days").alias("value")), least).withColumnRenamed("value", "d3")
    out = named.join(alike, (F.col("k1") == F.col("x")) & F.col("d1").isNull() & F.col("d2").isNull(), "left")
    how = F.when(F.col("d1").isNotNull(), "exact").when(F.col("d2").isNotNull(), "letters").when(F.col("d3").isNotNull(), "alike").otherwise("none")
    return out.select("c_custkey", F.coalesce("d1", "d2", "d3", F.lit(unknown)).alias("days"), how.alias("how"))


def attach_calcs(calcs: DataFrame, used: DataFrame, dashboards: DataFrame) -> DataFrame:
    """(workbook, calc, dashboard): each calculated field at every dashboard whose sheets use it, else at the workbook's first.

    calcs: workbook, calc. used: workbook, dashboard, field. dashboards: workbook, dashboard.
    """
    hit = calcs.join(used.select("workbook", "dashboard", F.col("field").alias("calc")).distinct(), ["workbook", "calc"]).select("workbook", "calc", "dashboard")
    first = dashboards.groupBy("workbook").agg(F.min("dashboard").alias("dashboard"))
    rest = calcs.join(hit.select("workbook", "calc").distinct(), ["workbook", "calc"], "left_anti").join(first, "workbook")
    return hit.unionByName(rest.select("workbook", "calc", "dashboard"))


def mapping_report(m: DataFrame, bank: DataFrame) -> DataFrame:
    """Every mapping with its bank row, null where it has none."""
    return m.join(bank.select("kpi_id", F.col("name").alias("bank_name"), "subdomain"), "kpi_id", "left")


def with_canonical_name(m: DataFrame, bank: DataFrame) -> DataFrame:
    """m with the bank's name in place of the report's, where there is one."""
    return m.join(bank.select("kpi_id", F.col("name").alias("bank_name")), "kpi_id", "left").withColumn("shown", F.coalesce("bank_name", "kpi")).drop("bank_name")


def bank_slice(bank: DataFrame, sectors: list[str], subdomain: str | None = None, lob: str | None = None) -> DataFrame:
    """Active bank rows of these sectors, of one subdomain or line of business if given."""
    keep = (F.col("status") == "active") & F.lower("sector").isin(sectors)
    if subdomain:
        keep = keep & (F.col("subdomain") == subdomain)
    return bank.filter(keep & (F.col("lob") == lob) if lob else keep)


def requested_dashboards(dash: DataFrame, requests: DataFrame) -> DataFrame:
    """Dashboards(name) that a request(wanted) names: equal, with a workbook's ending, or one a prefix of the other if longer than five.

    Names that begin alike share their first six characters, so the prefix rule is an equi-join too.
    """
    r = requests.select(F.lower(F.trim("wanted")).alias("w")).filter("w <> ''").distinct()
    d = dash.withColumn("k", F.lower(F.trim("name")))
    equal = d.join(r.select(F.explode(F.array("w", F.regexp_replace("w", r"\.twbx?$", ""), F.concat("w", F.lit(".twb")), F.concat("w", F.lit(".twbx")))).alias("k")).distinct(), "k", "left_semi")
    long = r.filter(F.length("w") > 5).withColumn("six", F.substring("w", 1, 6))
    both = (F.substring(d["k"], 1, 6) == long["six"]) & (F.length(d["k"]) > 5) & (d["k"].startswith(long["w"]) | long["w"].startswith(d["k"]))
    return equal.unionByName(d.join(long, both, "left_semi").select(equal.columns)).drop("k").distinct()


def new_summary_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions from summaries whose name no other source of the same sheet has."""
    other = mentions.filter("source <> 'summary'").select("ws", F.lower("name").alias("n")).distinct()
    return mentions.filter("source = 'summary'").withColumn("n", F.lower("name")).join(other, ["ws", "n"], "left_anti").drop("n")


def calc_column_edges(calcs: DataFrame, columns: DataFrame) -> DataFrame:
    """(calc_id, column): references of calcs(calc_id, source, formula) that are columns(source, column) of the same source."""
    refs = calcs.select("calc_id", "source", F.explode(X.field_refs(F.col("formula"))).alias("column"))
    return refs.join(columns.select("source", "column").distinct(), ["source", "column"]).select("calc_id", "column").distinct()


def ontology_blocks(sets: DataFrame) -> DataFrame:
    """(block, n, first) of reports with equal sets(report_id, kpis array), 'none' for the empty set."""
    key = F.when(F.size("kpis") > 0, F.array_join(F.array_sort("kpis"), "|")).otherwise("none")
    return sets.groupBy(key.alias("block")).agg(F.count("*").alias("n"), F.min("report_id").alias("first"))


def rank_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(a, b, shared) with their rank within each block, those that share most first."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("shared"), "a", "b")))


def shared_last(shown: DataFrame) -> DataFrame:
    """shown(report_id, item) with the place of each item in its report: those that no other report shows come first."""
    n = shown.groupBy("item").agg((F.count("*") > 1).alias("is_shared"))
    return shown.join(n, "item").withColumn("place", F.row_number().over(W.partitionBy("report_id").orderBy("is_shared", "item"))).select("report_id", "item", "is_shared", "place")


def common_kpis(a: Column, b: Column, base: callable) -> Column:
    """What two sets share: equal ids, or if there are none, equal base metrics."""
    same = F.array_sort(F.array_intersect(a, b))
    return F.when(F.size(same) > 0, same).otherwise(F.array_sort(F.array_intersect(F.transform(a, base), F.transform(b, base))))


def union_candidates(*pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of all candidate sources."""
    return reduce(DataFrame.unionByName, [p.select("a", "b") for p in pairs]).distinct()


def filter_recommendations(df: DataFrame, text: str = "", workbook: int | None = None) -> DataFrame:
    """Rows with text in the report's or workbook's name, of one workbook if given."""
    t = text.lower()
    keep = F.lower("name").contains(t) | F.col("workbook").cast("string").contains(t)
    return df.filter(keep & (F.col("workbook") == workbook) if workbook is not None else keep)


def classification_requests(formulas: DataFrame, by: str) -> DataFrame:
    """(by, request): what a classifier is told of each group: sources, formulas as 'name: formula', columns; sorted and distinct."""
    part = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    g = formulas.groupBy(by).agg(part(F.col("source")).alias("s"), part(F.concat_ws(": ", "name", "formula")).alias("f"), part(F.col("column")).alias("c"))
    return g.select(by, F.concat(F.lit("Sources: "), "s", F.lit("\nFormulas: "), "f", F.lit("\nColumns: "), "c").alias("request"))


def confident(kpis: Column, least: float = 60) -> Column:
    return F.filter(kpis, lambda k: k["confidence"] > least)


def edge_likeness(cardinality_same: Column, direction_same: Column) -> Column:
    """1, halved if cardinalities differ, less a quarter if filter directions do."""
    return F.when(cardinality_same, 1.0).otherwise(0.5) * F.when(direction_same, 1.0).otherwise(0.75)


# The weights of the model's and the filters' parts.
MODEL_PARTS = {"columns": 0.40, "relationships": 0.35, "hierarchies": 0.15, "kpis": 0.10}
FILTER_PARTS = {"filters": 0.40, "slicers": 0.35, "drillthrough": 0.25}


def sub_score(parts: dict[str, float]) -> Column:
    return sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in parts.items()), F.lit(0.0))


def governance_flags(pairs: DataFrame) -> DataFrame:
    """(a, b, flags) of pairs with both sides' rls, refresh, gateway and permissions as a_ and b_ columns: where they differ, merging is a risk."""
    kinds = {"rls": "RLS_CONFLICT", "refresh": "REFRESH_MISMATCH", "gateway": "GATEWAY_DIFFERENT", "permissions": "PERMISSION_DIVERGENCE"}
    flags = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), name) for c, name in kinds.items()]))
    return pairs.select("a", "b", flags.alias("flags"))


def density_clusters(edges: DataFrame, min_points: int, components) -> DataFrame:
    """(node, cluster, kind) of edges(a, b): core nodes have min_points neighbours, border ones a core neighbour, of whose clusters the least holds; noise has none and stays alone."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    core = both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select("a")
    inner = both.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
    found = components(inner.select("a", "b").unionByName(core.select("a", F.col("a").alias("b"))))
    of = found.select(F.col("node").alias("b"), F.col("root").alias("cluster"))
    border = both.join(core, "a", "left_anti").join(of, "b", "left").groupBy("a").agg(F.min("cluster").alias("cluster"))
    rest = border.select(F.col("a").alias("node"), F.coalesce("cluster", "a").alias("cluster"), F.when(F.col("cluster").isNull(), "noise").otherwise("border").alias("kind"))
    return found.select("node", F.col("root").alias("cluster"), F.lit("core").alias("kind")).unionByName(rest)


def label_propagation(edges: DataFrame, rounds: int, cut=materialize) -> DataFrame:
    """(node, label) after so many rounds over edges(a, b, w): every node takes the label that most weight among its neighbours and itself has, the least of equals. Its own label weighs its greatest edge."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = cut(both.unionByName(both.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        labels = cut(votes.groupBy("a").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")).select(F.col("a").alias("node"), "label"))
    return labels


def scaled_to_max(df: DataFrame, by: str) -> DataFrame:
    """df(usage, days) with usage as log1p and freshness as 1 - days, each by the greatest of its group."""
    w = W.partitionBy(by)
    part = lambda c: F.when(F.max(c).over(w) == 0, 0.0).otherwise(c / F.max(c).over(w))
    return df.withColumns({"usage_norm": part(F.log1p("usage")), "freshness_norm": 1 - part(F.col("days"))})


def approve_scopes(dash: DataFrame, approvals: DataFrame) -> DataFrame:
    """dash(report, sector, subdomain) with the latest approval(report, sector, subdomain, ts) of each report in place of what was open."""
    last = latest(approvals, ["report"], F.desc("ts")).select("report", F.col("sector").alias("new_sector"), F.col("subdomain").alias("new_subdomain"))
    return dash.join(last, "report", "left").select("report", F.coalesce("sector", "new_sector").alias("sector"), F.coalesce("subdomain", "new_subdomain").alias("subdomain"))


# The aggregations that a shelf's text may name before a field; truncated dates are dimensions and not among them.
SHELF_AGGS = ["sum", "avg", "cnt", "count", "countd", "min", "max", "attr", "median", "pct", "stdev", "var", "sum_sqr"]
SHELF_FIELD = rf"(?i)({'|'.join(SHELF_AGGS)}):\s*\[([^\]]+)\]"


def field_name(ref: Column) -> Column:
    """The field of a reference: the last bracket's content, and of `aggregation:field:kind` the middle."""
    last = F.regexp_replace(F.element_at(F.split(ref, r"\]\.\["), -1), r"^[\[\]]+|[\[\]]+$", "")
    return F.when(last.contains(":"), F.split(last, ":")[1]).otherwise(last)


#: About so many sheets are read in one task.
SHEETS = 100_000


def shelf_bindings(sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet_id, field, aggregation, table, lineage) of the measures on shelves, one for each aggregation and lineage of a sheet, the first.

    sheets: sheet_id, columns and rows (shelf text, `aggregation:[field]`), instances (array of derivation, column). columns(name, table) says
    which table has a field; lineage is table.field where it is known. CNT is COUNT; derivations None and User say nothing.
    A sheet's measures are sorted in the task that has it: there are as many as sheets ask for, so that none holds more the more there are.
    """
    found = lambda text, group: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SHELF_FIELD), F.lit(group))
    on_shelf = [F.arrays_zip(found(F.col(c), 1).alias("agg"), F.transform(found(F.col(c), 2), lambda r: F.trim(r)).alias("ref")) for c in ("columns", "rows")]
    told = F.filter("instances", lambda i: i["column"].isNotNull() & ~F.upper(F.coalesce(i["derivation"], F.lit(""))).isin("NONE", "USER", ""))
    derived = F.coalesce(F.transform(told, lambda i: F.struct(i["derivation"].alias("agg"), i["column"].alias("ref"))), F.array().cast("array<struct<agg:string,ref:string>>"))
    tasks = max(sheets.sparkSession.sparkContext.defaultParallelism, -(-sheets.count() // SHEETS))
    each = sheets.repartition(tasks, "sheet_id").select("sheet_id", F.posexplode(F.concat(*[F.transform(x, lambda e: F.struct(e["agg"].alias("agg"), e["ref"].alias("ref"))) for x in on_shelf], derived)).alias("at", "x"))
    agg = F.upper("x.agg")
    named = each.select("sheet_id", "at", F.when(agg == "CNT", "COUNT").otherwise(agg).alias("aggregation"), field_name(F.col("x.ref")).alias("field"))
    placed = named.join(columns.select(F.col("name").alias("field"), "table"), "field", "left")
    lineage = F.when(F.coalesce("table", F.lit("")) != "", F.concat_ws(".", "table", "field")).otherwise(F.col("field"))
    first = placed.withColumn("lineage", lineage).groupBy("sheet_id", "aggregation", "lineage").agg(F.min_by(F.struct("field", F.coalesce("table", F.lit("")).alias("table")), "at").alias("x"))
    return first.select("sheet_id", "x.field", "aggregation", "x.table", "lineage")
