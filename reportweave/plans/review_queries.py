"""Queries of governance, review and roll-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.operators import review as V
from reportweave.sources import adapters as A


def _m(spark: SparkSession, d: str) -> DataFrame:
    """Mappings with their status and what the flags look at."""
    m = A.mappings(spark, d).withColumn("status", R.status_from_confidence(F.col("confidence")))
    lineage = F.when(F.col("ws") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("canonical"))
    scores = F.array(F.col("confidence"), F.round(F.col("confidence") - F.col("ws") / 100, 2))
    return m.withColumn("lineage", lineage).withColumn("definition", F.when(F.col("ws") % 2 == 0, F.col("kpi"))).withColumn("scores", scores)


_M = """m AS (SELECT *, CASE WHEN confidence >= 0.95 THEN 'auto_accepted' WHEN confidence >= 0.80 THEN 'pending_review' ELSE 'not_found' END AS status,
  CASE WHEN ws % 3 = 0 THEN [] ELSE [canonical] END AS lineage, CASE WHEN ws % 2 = 0 THEN kpi END AS definition, round(confidence - ws / 100, 2) AS second FROM mappings)"""
def _q(sql: str) -> str:
    return A.with_views(f"WITH {_M} {sql}".replace("FROM mappings) ,", "FROM mappings),"), "mappings")


_FLAGS = """flags AS (SELECT mapping_id, 'ambiguous_match' AS type, 'Medium' AS severity FROM m WHERE confidence BETWEEN 0.5 AND 0.8 AND abs(confidence - second) < 0.05
  UNION ALL SELECT mapping_id, 'weak_evidence', 'Low' FROM m WHERE len(lineage) = 0 AND definition IS NULL UNION ALL SELECT mapping_id, 'low_confidence', 'High' FROM m WHERE confidence < 0.5)"""


def quality_flags(spark, d):
    m = _m(spark, d)
    return V.flag_ambiguous(m, "scores").unionByName(V.flag_weak(m)).unionByName(V.flag_low(m))


def decisions(spark, d):
    m = _m(spark, d)
    f = quality_flags(spark, d).groupBy("mapping_id").agg(F.count("*").alias("warnings"), F.bool_or(F.col("severity") == "High").alias("high"))
    j = m.join(f, "mapping_id", "left")
    kind = F.when(F.col("ws") == 1, "exact").otherwise("semantic_match")
    return j.select("mapping_id", "report", V.decide(kind, F.col("confidence"), F.col("status"), F.coalesce("high", F.lit(False))).alias("decision"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


_DECIDED = f"""{_FLAGS}, fl AS (SELECT mapping_id, count(*) AS warnings, bool_or(severity = 'High') AS high FROM flags GROUP BY 1),
dec AS (SELECT mapping_id, report, CASE WHEN status = 'not_found' THEN 'NEW_KPI_REQUIRED' WHEN coalesce(high, false) THEN 'REQUIRES_HUMAN_REVIEW' WHEN ws = 1 OR confidence >= 0.95 THEN 'AUTO_APPROVE' ELSE 'REQUIRES_HUMAN_REVIEW' END AS decision,
  coalesce(warnings, 0) AS warnings FROM m LEFT JOIN fl USING (mapping_id))"""


def verdicts(spark, d):
    return V.verdicts(decisions(spark, d))


def decision_counts(spark, d):
    return decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"), F.sum("warnings").alias("warnings"))


def missing_metadata(spark, d):
    return V.flag_missing(A.dashboards(spark, d))


def scope_queue(spark, d):
    return V.scope_queue(A.dashboards(spark, d))


def risk_rules(spark, d):
    return V.risk_rules(A.dashboards(spark, d))


def advice(spark, d):
    return V.advice(A.dashboards(spark, d))


_RISK = """SELECT report, rule_id, risk_type, severity FROM (
  SELECT report, 'GOV-R001' AS rule_id, CASE WHEN worksheets > 12 THEN 'High Complexity' ELSE 'Medium Complexity' END AS risk_type, CASE WHEN worksheets > 12 THEN 'High' ELSE 'Medium' END AS severity FROM dashboards WHERE worksheets > 6
  UNION ALL SELECT report, 'GOV-R002', CASE WHEN calcs > 30 THEN 'Heavy Calculation Overhead' ELSE 'Calculation Overlap' END, CASE WHEN calcs > 30 THEN 'High' ELSE 'Medium' END FROM dashboards WHERE calcs > 15
  UNION ALL SELECT report, 'GOV-R003', 'Empty Dashboard', 'Medium' FROM dashboards WHERE worksheets = 0
  UNION ALL SELECT report, 'GOV-R004', 'Raw Data Exposure', 'Low' FROM dashboards WHERE calcs = 0 AND worksheets > 3
  UNION ALL SELECT report, 'GOV-R000', 'Low Risk Profile', 'Low' FROM dashboards WHERE worksheets <= 6 AND worksheets > 0 AND calcs <= 15 AND NOT (calcs = 0 AND worksheets > 3))"""


def duplicate_mappings(spark, d):
    return V.duplicate_mappings(A.mappings(spark, d)).select("report", "canonical", "n", F.array_join("sheets", "|").alias("sheets"))


def mapping_conflicts(spark, d):
    return V.mapping_conflicts(A.mappings(spark, d)).select("kpi", "canonical", F.array_join("others", "|").alias("others"))


def _acted(spark, d):
    m = _m(spark, d).filter("ws = 1").groupBy(F.col("report").alias("mapping_id")).agg(F.min("status").alias("status"), F.min("canonical").alias("canonical"))
    a = A.actions(spark, d).select("mapping_id", "action_id", "ts", "action", F.concat(F.lit("Brand#"), F.floor("value").cast("string")).alias("target"))
    return V.apply_actions(m, a)


def review_states(spark, d):
    return _acted(spark, d)[0]


def audit_log(spark, d):
    return _acted(spark, d)[1].select("mapping_id", "action_id", "field", "old", "new")


_ACT = """mm AS (SELECT report AS mapping_id, min(status) AS status, min(canonical) AS canonical FROM m WHERE ws = 1 GROUP BY 1),
st AS (SELECT a.mapping_id, action_id, ts, action, 'Brand#' || floor(value)::BIGINT AS target, CASE WHEN action = 'reject' THEN 'human_rejected' ELSE 'human_accepted' END AS now, status, canonical FROM actions a JOIN mm USING (mapping_id)),
s2 AS (SELECT *, coalesce(lag(now) OVER w, status) AS was, coalesce(last_value(CASE WHEN action = 'reassign' THEN target END IGNORE NULLS) OVER (PARTITION BY mapping_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), canonical) AS had FROM st WINDOW w AS (PARTITION BY mapping_id ORDER BY ts, action_id)),
la AS (SELECT mapping_id, arg_max(now, (ts, action_id)) AS now, arg_max(target, (ts, action_id)) FILTER (action = 'reassign') AS tgt FROM st GROUP BY 1)"""


def latest_actions(spark, d):
    """Last state of each mapping by the action stream, and how often it changed."""
    a = A.actions(spark, d)
    return a.groupBy("mapping_id").agg(F.max_by("action", F.struct("ts", "action_id")).alias("action"), F.count("*").alias("n"))


def audit_latest(spark, d):
    """Actions newest first within their mapping, with the one before."""
    a = A.actions(spark, d)
    w = W.partitionBy("mapping_id").orderBy("ts", "action_id")
    return a.select("action_id", "mapping_id", "action", F.lag("action").over(w).alias("before"), F.row_number().over(W.partitionBy("mapping_id").orderBy(F.desc("ts"), F.desc("action_id"))).alias("age"))


def pending_queue(spark, d):
    """The least certain open mappings: a page of 50 after the first 20."""
    return _m(spark, d).filter("status in ('pending_review', 'not_found')").orderBy(F.asc_nulls_first("confidence"), "mapping_id").offset(20).limit(50).select("mapping_id", "confidence", "status")


def report_inventory(spark, d):
    """Per report: how many mappings are accepted, open, not found, and the score."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = _m(spark, d).groupBy("report").agg(F.count("*").alias("total"), n(*V.ACCEPTED).alias("mapped"), n("pending_review").alias("ambiguous"), n("not_found").alias("not_found"))
    return g.withColumn("score", F.round(F.col("mapped") / F.greatest("total", F.lit(1)), 3))


_INV = "inv AS (SELECT report, count(*) AS total, count(*) FILTER (status = 'auto_accepted') AS mapped, count(*) FILTER (status = 'pending_review') AS ambiguous, count(*) FILTER (status = 'not_found') AS not_found, round(count(*) FILTER (status = 'auto_accepted') / count(*)::DOUBLE, 3) AS score FROM m GROUP BY 1)"


def workbook_rollup(spark, d):
    """Inventories rolled up by customer, with a list of the reports."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), F.col("o_custkey").alias("workbook"))
    g = report_inventory(spark, d).join(o, "report").groupBy("workbook").agg(F.sum("total").alias("total"), F.sum("mapped").alias("mapped"), F.array_join(F.array_sort(F.collect_list("report")), "|").alias("reports"))
    return g.withColumn("score", F.round(F.col("mapped") / F.greatest("total", F.lit(1)), 2))


def portfolio_summary(spark, d):
    return _m(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "auto_accepted").alias("accepted"), F.count_if(F.col("status") == "pending_review").alias("pending"), F.countDistinct("report").alias("reports"))


def bank_facets(spark, d):
    """Bank rows by aggregation and subdomain, with totals, in one pass."""
    return A.bank(spark, d).rollup("agg", "subdomain").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select(F.coalesce("agg", F.lit("all")).alias("agg"), F.coalesce("subdomain", F.lit("all")).alias("subdomain"), "n", F.col("level").cast("long").alias("level"))


def size_duplicates(spark, d):
    """Groups of documents of equal length."""
    return A.table(spark, d, "documents").groupBy("n_chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def worksheet_usage(spark, d):
    """Sheets whose name occurs in several reports."""
    m = A.mappings(spark, d).select("report", F.concat_ws(" ", "kpi", "ws").alias("sheet"))
    return m.groupBy("sheet").agg(F.count("*").alias("uses"), F.countDistinct("report").alias("reports")).withColumn("is_duplicate", F.col("reports") > 1)


def calibrate(spark, d):
    """Precision, recall and F1 of 'long documents are good' over a grid of thresholds, by the labels."""
    j = A.table(spark, d, "documents").select("doc_id", "n_chars").join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    grid = F.explode(F.array(*[F.lit(x) for x in (100, 300, 1000, 3000, 10000)])).alias("threshold")
    hit = F.col("n_chars") >= F.col("threshold")
    g = j.select("n_chars", "quality", grid).groupBy("threshold").agg(F.count_if(hit & (F.col("quality") == 1)).alias("tp"), F.count_if(hit & (F.col("quality") == 0)).alias("fp"), F.count_if(~hit & (F.col("quality") == 1)).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return g.select("threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def filter_options(spark, d):
    o = A.table(spark, d, "customer")
    return o.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("c_nationkey")), "|").alias("workbooks"), F.count("*").alias("reports"))


def flat_assets(spark, d):
    """Items of the reports of one segment's workbooks, one row each."""
    r = A.reports(spark, d).filter("segment = 'BUILDING'").select("report_id", "workbook")
    return A.items(spark, d).join(r, "report_id").groupBy("workbook", "layer", "item").agg(F.count("*").alias("reports"))


def best_candidates(spark, d):
    """The best other report of each report by shared metrics, ties to the lesser."""
    from reportweave.operators import scoring as S

    c = S.by_layer(S.block_counts(A.reports(spark, d), A.items(spark, d), ["workbook", "segment"], ["kpi"])).filter("met > 0").withColumn("met", F.col("met").cast("long"))
    two = c.select(F.col("a").alias("report_id"), F.col("b").alias("other"), "met").unionByName(c.select(F.col("b").alias("report_id"), F.col("a").alias("other"), "met"))
    return A.latest(two, ["report_id"], F.desc("met"), "other")


BEST = A.with_views(
    """WITH p AS (SELECT x.report_id AS a, y.report_id AS b FROM reports x JOIN reports y ON x.workbook = y.workbook AND x.segment = y.segment AND x.report_id <> y.report_id),
    c AS (SELECT a AS report_id, b AS other, count(*) AS met FROM p JOIN items i ON i.report_id = a AND i.layer = 'kpi' JOIN items j ON j.report_id = b AND j.layer = 'kpi' AND i.item = j.item GROUP BY ALL)
    SELECT report_id, other, met FROM c QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY met DESC, other) = 1""",
    "reports",
    "items",
)


def _bank_changes(spark, d):
    """New names, a new row for every seventh, and for every fifth that is odd the name of another row."""
    b = A.bank(spark, d).select("kpi_id", "name", "subdomain")
    other = b.groupBy("subdomain").agg(F.min_by("name", "kpi_id").alias("taken"))
    renamed = b.filter("kpi_id % 5 = 0").join(other, "subdomain").select("kpi_id", F.when(F.col("kpi_id") % 2 == 0, F.concat("name", F.lit(" v2"))).otherwise(F.col("taken")).alias("name"), "subdomain")
    return b, renamed.unionByName(b.filter("kpi_id % 7 = 1").select((F.col("kpi_id") + A.SHIFT).alias("kpi_id"), F.concat("name", F.lit(" new")).alias("name"), "subdomain"))


def bank_upsert(spark, d):
    return V.upsert_bank(*_bank_changes(spark, d))[0]


def bank_conflicts(spark, d):
    return V.upsert_bank(*_bank_changes(spark, d))[1]


BANK_UPSERT = A.with_views(
    """WITH o AS (SELECT subdomain, arg_min(name, kpi_id) AS taken, min(kpi_id) AS first FROM bank GROUP BY 1)
    SELECT kpi_id, CASE WHEN kpi_id % 10 = 0 THEN name || ' v2' ELSE name END AS name, subdomain FROM bank UNION ALL SELECT kpi_id + 1000000, name || ' new', subdomain FROM bank WHERE kpi_id % 7 = 1""",
    "bank",
)
BANK_CONFLICTS = A.with_views("WITH o AS (SELECT subdomain, min(kpi_id) AS first FROM bank GROUP BY 1) SELECT kpi_id, first AS other FROM bank JOIN o USING (subdomain) WHERE kpi_id % 10 = 5 AND kpi_id <> first", "bank")


def bank_search(spark, d):
    return V.search_bank(A.bank(spark, d), "Ring").select("kpi_id", "name", "subdomain")


BANK_SEARCH = A.with_views("SELECT kpi_id, name, subdomain FROM bank WHERE contains(lower(name), 'ring') OR contains(lower(subdomain), 'ring') OR len(list_filter(aliases, lambda a: contains(lower(a), 'ring'))) > 0", "bank")


def mapping_upsert(spark, d):
    """Every mapping written twice, the later version wins by (report, worksheet, name)."""
    m = A.mappings(spark, d).groupBy("report", "ws", "kpi").agg(F.min("confidence").alias("confidence")).withColumn("version", F.lit(1))
    new = m.filter("ws % 2 = 0").select("report", "ws", "kpi", F.round(F.col("confidence") / 2, 3).alias("confidence"), F.lit(2).alias("version"))
    return V.upsert_mappings(m, new, ["report", "ws", "kpi"], "version")


def mapping_filter(spark, d):
    return V.filter_mappings(A.mappings(spark, d), "a", "medium").groupBy("kpi").agg(F.count("*").alias("n"))


QUERIES = {
    "quality_flags": (quality_flags, _q(f", {_FLAGS} SELECT * FROM flags")),
    "decisions": (decisions, _q(f", {_DECIDED} SELECT * FROM dec")),
    "verdicts": (
        verdicts,
        _q(f""", {_DECIDED} SELECT report, count(*) AS total, count(*) FILTER (decision = 'AUTO_APPROVE') AS approved, count(*) FILTER (decision = 'REQUIRES_HUMAN_REVIEW') AS review, count(*) FILTER (decision = 'NEW_KPI_REQUIRED') AS new, sum(warnings)::BIGINT AS warnings,
        CASE WHEN count(*) FILTER (decision <> 'AUTO_APPROVE') > 0 OR sum(warnings) > 0 THEN 'REQUIRES_HUMAN_REVIEW' ELSE 'AUTO_APPROVE' END AS verdict FROM dec GROUP BY 1"""),
    ),
    "decision_counts": (decision_counts, _q(f", {_DECIDED} SELECT decision, count(*) AS n, sum(warnings)::BIGINT AS warnings FROM dec GROUP BY 1")),
    "missing_metadata": (missing_metadata, A.with_views("SELECT report, 'sector' AS missing FROM dashboards WHERE sector IS NULL UNION ALL SELECT report, 'subdomain' FROM dashboards WHERE subdomain IS NULL", "dashboards")),
    "scope_queue": (scope_queue, A.with_views("SELECT report, coalesce(sector, 'insurance') AS sector, coalesce(subdomain, 'pending_scope') AS subdomain FROM dashboards WHERE sector IS NULL OR subdomain IS NULL", "dashboards")),
    "risk_rules": (risk_rules, A.with_views(_RISK, "dashboards")),
    "advice": (
        advice,
        A.with_views(
            "SELECT report, CASE WHEN calcs > 30 OR worksheets > 15 THEN 'deep' ELSE 'standard' END AS depth, coalesce(nullif(concat_ws('; ', CASE WHEN calcs > 20 THEN 'publish calculated fields' END, CASE WHEN worksheets > 12 THEN 'split into ' || worksheets // 6 END, CASE WHEN worksheets > 12 OR calcs > 30 THEN 'assign a steward' END), ''), 'within thresholds') AS advice FROM dashboards",
            "dashboards",
        ),
    ),
    "duplicate_mappings": (duplicate_mappings, A.with_views("SELECT report, canonical, count(*) AS n, array_to_string(list_sort(list(DISTINCT ws)), '|') AS sheets FROM mappings GROUP BY 1, 2 HAVING count(*) > 1", "mappings")),
    "mapping_conflicts": (
        mapping_conflicts,
        A.with_views("WITH p AS (SELECT DISTINCT kpi, canonical FROM mappings), s AS (SELECT kpi, list_sort(list(canonical)) AS ids FROM p GROUP BY 1 HAVING count(*) > 1) SELECT kpi, canonical, array_to_string(list_filter(ids, lambda x: x <> canonical), '|') AS others FROM p JOIN s USING (kpi)", "mappings"),
    ),
    "review_states": (review_states, A.with_views(f"WITH {_M}, {_ACT} SELECT mapping_id, coalesce(now, status) AS status, coalesce(tgt, canonical) AS canonical FROM mm LEFT JOIN la USING (mapping_id)", "mappings", "actions")),
    "audit_log": (
        audit_log,
        A.with_views(
            f"WITH {_M}, {_ACT} SELECT mapping_id, action_id, 'status' AS field, was AS old, now AS new FROM s2 UNION ALL SELECT mapping_id, action_id, 'canonical', had, target FROM s2 WHERE action = 'reassign' AND had <> target", "mappings", "actions"
        ),
    ),
    "latest_actions": (latest_actions, A.with_views("SELECT mapping_id, arg_max(action, (ts, action_id)) AS action, count(*) AS n FROM actions GROUP BY 1", "actions")),
    "audit_latest": (
        audit_latest,
        A.with_views("SELECT action_id, mapping_id, action, lag(action) OVER (PARTITION BY mapping_id ORDER BY ts, action_id) AS before, row_number() OVER (PARTITION BY mapping_id ORDER BY ts DESC, action_id DESC) AS age FROM actions", "actions"),
    ),
    "pending_queue": (pending_queue, _q("SELECT mapping_id, confidence, status FROM m WHERE status <> 'auto_accepted' ORDER BY confidence NULLS FIRST, mapping_id LIMIT 50 OFFSET 20")),
    "report_inventory": (report_inventory, _q(f", {_INV} SELECT * FROM inv")),
    "workbook_rollup": (
        workbook_rollup,
        _q(
            f", {_INV} SELECT o_custkey AS workbook, sum(total)::BIGINT AS total, sum(mapped)::BIGINT AS mapped, string_agg(report::VARCHAR, '|' ORDER BY report) AS reports, round(sum(mapped) / sum(total)::DOUBLE, 2) AS score FROM inv JOIN orders ON o_orderkey = report GROUP BY 1"
        ),
    ),
    "portfolio_summary": (portfolio_summary, _q("SELECT count(*) AS total, count(*) FILTER (status = 'auto_accepted') AS accepted, count(*) FILTER (status = 'pending_review') AS pending, count(DISTINCT report) AS reports FROM m")),
    "bank_facets": (bank_facets, A.with_views("SELECT coalesce(agg, 'all') AS agg, coalesce(subdomain, 'all') AS subdomain, count(*) AS n, grouping_id(agg, subdomain)::BIGINT AS level FROM bank GROUP BY ROLLUP (agg, subdomain)", "bank")),
    "size_duplicates": (size_duplicates, "SELECT n_chars, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "worksheet_usage": (worksheet_usage, A.with_views("SELECT kpi || ' ' || ws AS sheet, count(*) AS uses, count(DISTINCT report) AS reports, count(DISTINCT report) > 1 AS is_duplicate FROM mappings GROUP BY 1", "mappings")),
    "calibrate": (
        calibrate,
        """WITH j AS (SELECT n_chars, quality, unnest([100, 300, 1000, 3000, 10000]) AS threshold FROM documents JOIN labels USING (doc_id)), g AS (SELECT threshold, count(*) FILTER (n_chars >= threshold AND quality = 1) AS tp,
        count(*) FILTER (n_chars >= threshold AND quality = 0) AS fp, count(*) FILTER (n_chars < threshold AND quality = 1) AS fn FROM j GROUP BY 1), pr AS (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM g)
        SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr""",
    ),
    "filter_options": (filter_options, "SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), '|') AS workbooks, count(*) AS reports FROM customer GROUP BY 1"),
    "flat_assets": (flat_assets, A.with_views("SELECT workbook, layer, item, count(*) AS reports FROM items JOIN reports USING (report_id) WHERE segment = 'BUILDING' GROUP BY ALL", "reports", "items")),
    "best_candidates": (best_candidates, BEST),
    "bank_upsert": (bank_upsert, BANK_UPSERT),
    "bank_conflicts": (bank_conflicts, BANK_CONFLICTS),
    "bank_search": (bank_search, BANK_SEARCH),
    "mapping_upsert": (mapping_upsert, A.with_views("SELECT report, ws, kpi, CASE WHEN ws % 2 = 0 THEN round(min(confidence) / 2, 3) ELSE min(confidence) END AS confidence, CASE WHEN ws % 2 = 0 THEN 2 ELSE 1 END AS version FROM mappings GROUP BY report, ws, kpi", "mappings")),
    "mapping_filter": (mapping_filter, A.with_views("SELECT kpi, count(*) AS n FROM mappings WHERE contains(lower(kpi), 'a') AND confidence >= 0.5 AND confidence < 0.8 GROUP BY 1", "mappings")),
}
