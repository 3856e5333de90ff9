"""Queries over report pairs: blocks, layers, composite, tiers, recommendations; with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import scoring as S
from reportweave.operators.components import connected_components
from reportweave.operators.durable import materialize
from reportweave.plans.text_queries import sql_fold, sql_trim
from reportweave.sources import adapters as A

BLOCK = ["workbook", "segment"]
_PAIRS = "pairs AS (SELECT x.report_id AS a, y.report_id AS b FROM reports x JOIN reports y ON x.workbook = y.workbook AND x.segment = y.segment AND x.report_id < y.report_id)"
_COUNTS = f"""{_PAIRS}, sizes AS (SELECT layer, report_id, count(*) AS n FROM items GROUP BY ALL),
met_ AS (SELECT p.a, p.b, i.layer, count(*) AS n FROM pairs p JOIN items i ON i.report_id = p.a JOIN items j ON j.report_id = p.b AND j.layer = i.layer AND j.item = i.item GROUP BY ALL),
counts AS (SELECT l.layer, p.a, p.b, coalesce(t.n, 0) AS met, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM pairs p CROSS JOIN (SELECT DISTINCT layer FROM items) l
  LEFT JOIN met_ t ON t.a = p.a AND t.b = p.b AND t.layer = l.layer LEFT JOIN sizes x ON x.report_id = p.a AND x.layer = l.layer LEFT JOIN sizes y ON y.report_id = p.b AND y.layer = l.layer),
scores AS (SELECT layer, a, b, CASE WHEN n_a + n_b - met = 0 THEN CASE WHEN layer = 'filter' THEN 0.5 ELSE 0.0 END ELSE met / (n_a + n_b - met)::DOUBLE END AS score FROM counts)"""
_BASE = lambda c: f"lower({sql_trim(sql_fold(c, X.BASE_METRIC))})"
#: Greedy one-to-one assignment of edges(a, b, l, r, score, near): the best first, each end once.
_GREEDY = lambda name, edges: f"""{name} AS (SELECT a, b, list_reduce(list({{'ls': [l], 'rs': [r], 'total': score}} ORDER BY score DESC, near DESC, l, r),
  lambda x, y: CASE WHEN list_has_any(x.ls, y.ls) OR list_has_any(x.rs, y.rs) THEN x ELSE {{'ls': list_concat(x.ls, y.ls), 'rs': list_concat(x.rs, y.rs), 'total': x.total + y.total}} END).total AS total FROM {edges} GROUP BY a, b)"""  # noqa: E731
_OVERLAP = f"""kp AS (SELECT report_id, item FROM items WHERE layer = 'kpi'), nm AS (SELECT DISTINCT item, {_BASE("item")} AS base FROM kp),
al AS (SELECT l, r, near, CASE WHEN same THEN 1.0::DOUBLE WHEN near > 0.8 THEN 0.8::DOUBLE END AS score FROM (SELECT x.item AS l, y.item AS r, x.item = y.item OR (x.base = y.base AND x.base <> '') AS same,
  (greatest(length(x.item), length(y.item)) - levenshtein(lower(x.item), lower(y.item))) / greatest(length(x.item), length(y.item))::DOUBLE AS near FROM nm x, nm y) WHERE same OR near > 0.8),
ed AS (SELECT p.a, p.b, al.l, al.r, al.score, al.near FROM pairs p JOIN kp i ON i.report_id = p.a JOIN al ON al.l = i.item JOIN kp j ON j.report_id = p.b AND j.item = al.r),
{_GREEDY("gr", "ed")},
ko AS (SELECT p.a, p.b, coalesce(total, 0)::DOUBLE AS total, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, CASE WHEN least(coalesce(x.n, 0), coalesce(y.n, 0)) = 0 THEN 0.0 ELSE coalesce(total, 0) / least(x.n, y.n)::DOUBLE END AS score
  FROM pairs p LEFT JOIN gr ON gr.a = p.a AND gr.b = p.b LEFT JOIN sizes x ON x.report_id = p.a AND x.layer = 'kpi' LEFT JOIN sizes y ON y.report_id = p.b AND y.layer = 'kpi')"""
_WIDE = f"""{_COUNTS}, {_OVERLAP}, every AS (SELECT * FROM scores UNION ALL SELECT 'structure', a, b, score FROM ko),
wide AS (SELECT a, b, {", ".join(f"coalesce(max(score) FILTER (layer = '{n}'), 0)::DOUBLE AS {n}" for n in S.WEIGHTS)} FROM every GROUP BY a, b),
comp AS (SELECT *, round({" + ".join(f"{n} * {w}" for n, w in S.WEIGHTS.items())}, 6) AS composite, ({" + ".join(S.WEIGHTS)}) / 6 AS mean FROM wide)"""
_TIER = "CASE WHEN composite > 0.95 THEN 'exact_clone' WHEN composite > 0.80 THEN 'near_clone' WHEN composite > 0.60 THEN 'functional_overlap' ELSE 'unrelated' END"


def _counted(spark, d, layers):
    """(a, b, counts) of every pair of a block, for these layers."""
    return S.block_counts(A.reports(spark, d), A.items(spark, d), BLOCK, layers)


def _counts(spark, d, layers=A.LAYERS):
    return S.by_layer(_counted(spark, d, layers))


def _ratio(whole):
    """Likeness of names: by matching blocks, or by Levenshtein's distance, which SQL has too."""
    return X.seq_ratio if whole else X.lev_ratio


def _overlap(spark, d, whole):
    return S.kpi_overlap(S.candidate_pairs(A.reports(spark, d), BLOCK, named=True), A.kpis(spark, d), _ratio(whole))


def kpi_overlap(spark, d):
    """E18 of every pair of a block, names compared by matching blocks."""
    return _overlap(spark, d, True).select("a", "b", "score")


def greedy_overlap(spark, d):
    """E18 of every pair of a block, names compared by Levenshtein's ratio."""
    return _overlap(spark, d, False).select("a", "b", "total", "n_a", "n_b", F.round("score", 6).alias("score"))


GREEDY_OVERLAP = A.with_views(f"WITH {_COUNTS}, {_OVERLAP} SELECT a, b, total, n_a, n_b, round(score, 6) AS score FROM ko", "reports", "items")


def _composite(spark, d, whole=False, counted=None):
    """Six layers, the structural one being E18; from the counts of all layers, taken here where they aren't given."""
    scores = S.score_columns(_counted(spark, d, A.LAYERS) if counted is None else counted, A.LAYERS)
    return S.composite(scores.join(S.shuffled(_overlap(spark, d, whole).select("a", "b", F.col("score").alias("structure"))), ["a", "b"], "left"))


def report_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every pair of a block with its shared metrics, Jaccard likeness, overlap and subsumption."""
    c = _counts(spark, d, ["kpi"])
    union = F.col("n_a") + F.col("n_b") - F.col("met")
    least = F.least("n_a", "n_b")
    return c.select(
        "a", "b", F.col("met").alias("shared"),
        F.when(union == 0, 0.0).otherwise(F.col("met") / union).alias("jaccard"),
        F.when(least == 0, 0.0).otherwise(F.col("met") / least).alias("overlap"),
        S.subsumption(F.col("met"), F.col("n_a"), F.col("n_b")).alias("subset"),
    )


REPORT_OVERLAP = A.with_views(
    f"""WITH {_COUNTS} SELECT a, b, met AS shared, CASE WHEN n_a + n_b - met = 0 THEN 0.0 ELSE met / (n_a + n_b - met)::DOUBLE END AS jaccard,
    CASE WHEN least(n_a, n_b) = 0 THEN 0.0 ELSE met / least(n_a, n_b)::DOUBLE END AS overlap,
    CASE WHEN n_a > 0 AND met / n_a >= 0.9 THEN 'a_in_b' WHEN n_b > 0 AND met / n_b >= 0.9 THEN 'b_in_a' END AS subset FROM counts WHERE layer = 'kpi'""",
    "reports",
    "items",
)


def metric_sets(spark, d):
    return A.items(spark, d).filter("layer = 'kpi'").groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set("item")), "|").alias("metrics"), F.count("*").alias("n"))


METRIC_SETS = A.with_views("SELECT report_id, string_agg(item, '|' ORDER BY item) AS metrics, count(*) AS n FROM items WHERE layer = 'kpi' GROUP BY 1", "items")


def layer_scores(spark, d):
    return S.layer_scores(_counts(spark, d))


LAYER_SCORES = A.with_views(f"WITH {_COUNTS} SELECT layer, a, b, score FROM scores", "reports", "items")


def composite_pairs(spark, d, whole=False):
    return _composite(spark, d, whole).select("a", "b", "composite", "spread", S.tier(F.col("composite")).alias("tier"), (F.col("spread") > 0.25).alias("review"))


COMPOSITE_PAIRS = A.with_views(
    f"""WITH {_WIDE}, dev AS (SELECT *, round(sqrt(({" + ".join(f"({n} - mean) * ({n} - mean)" for n in S.WEIGHTS)}) / 6), 6) AS spread FROM comp)
    SELECT a, b, composite, spread, {_TIER} AS tier, spread > 0.25 AS review FROM dev""",
    "reports",
    "items",
)


def tier_counts(spark, d, whole=False):
    return _composite(spark, d, whole).groupBy(S.tier(F.col("composite")).alias("tier")).agg(F.count("*").alias("pairs"))


TIER_COUNTS = A.with_views(f"WITH {_WIDE} SELECT {_TIER} AS tier, count(*) AS pairs FROM comp GROUP BY 1", "reports", "items")


def score_details(spark, d, whole=False):
    wide = _composite(spark, d, whole).filter("composite >= 0.6")
    return S.score_details(wide, list(S.WEIGHTS))


SCORE_DETAILS = A.with_views(f"WITH {_WIDE} SELECT a, b, layer, score FROM (UNPIVOT (SELECT a, b, {', '.join(S.WEIGHTS)} FROM comp WHERE composite >= 0.6) ON {', '.join(S.WEIGHTS)} INTO NAME layer VALUE score)", "reports", "items")


def persistable_pairs(spark, d, whole=False):
    wide = _composite(spark, d, whole).select("a", "b", "composite")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # a union would score the pairs twice
    return S.persistable(wide.select(both.alias("p"), "composite").select("p.a", "p.b", "composite"))


PERSISTABLE_PAIRS = A.with_views(f"WITH {_WIDE} SELECT a, b, composite FROM comp WHERE composite >= 0.6", "reports", "items")


def uniqueness(spark, d, whole=False):
    return S.uniqueness(_composite(spark, d, whole), A.reports(spark, d))


UNIQUENESS = A.with_views(
    f"""WITH {_WIDE}, u AS (SELECT a AS report_id, composite FROM comp UNION ALL SELECT b, composite FROM comp)
    SELECT r.report_id, round(greatest(0, 1 - coalesce(max(composite), 0)), 6) AS uniqueness FROM reports r LEFT JOIN u USING (report_id) GROUP BY 1""",
    "reports",
    "items",
)


def shared_sources(spark, d):
    """Reports of a block that share a source, and which."""
    src = A.reports(spark, d).select("report_id", *BLOCK).join(S.item_sets(A.items(spark, d).filter("layer = 'source'"), ["source"]), "report_id")
    a, b = (src.select(F.col("report_id").alias(c), *BLOCK, F.col("source").alias(f"s_{c}")) for c in "ab")
    met = a.join(b, BLOCK).filter("a < b").select("a", "b", F.array_sort(F.array_intersect("s_a", "s_b")).alias("s")).filter(F.size("s") > 0)
    return met.select("a", "b", F.array_join("s", "|").alias("sources"), F.size("s").cast("long").alias("n"))


SHARED_SOURCES = A.with_views(
    f"WITH {_PAIRS} SELECT a, b, string_agg(i.item, '|' ORDER BY i.item) AS sources, count(*) AS n FROM pairs p JOIN items i ON i.report_id = a AND i.layer = 'source' JOIN items j ON j.report_id = b AND j.layer = 'source' AND j.item = i.item GROUP BY a, b",
    "reports",
    "items",
)


def _usage(spark, d):
    """Usage of all reports, a copy's being that of its original."""
    u = A.usage(spark, d)
    return u.unionByName(u.withColumn("report_id", F.col("report_id") + A.SHIFT))


def merge_candidates(spark, d, whole=False):
    """Pairs that share a source and a user group and the greater of whose E18 and Jaccard of ids is above the threshold."""
    c = S.score_columns(_counted(spark, d, ["kpi", "source"]).withColumn("met", F.col("counts")[1]["met"]), ["kpi"], "met").filter("met > 0")
    k = c.join(S.shuffled(_overlap(spark, d, whole).select("a", "b", "score")), ["a", "b"]).select("a", "b", F.greatest("score", "kpi").alias("score")).filter("score > 0.60")
    u = _usage(spark, d).select("report_id", "groups")
    out = k.join(S.shuffled(u.toDF("a", "ga")), "a").join(S.shuffled(u.toDF("b", "gb")), "b")
    return out.filter(F.arrays_overlap("ga", "gb")).select("a", "b", F.round("score", 6).alias("score"))


_USAGE2 = "u2 AS (SELECT report_id, days_ago, groups FROM usage UNION ALL SELECT report_id + 1000000, days_ago, groups FROM usage)"
_MERGES = f"""{_COUNTS}, {_OVERLAP}, {_USAGE2}, merges AS (SELECT k.a, k.b, round(greatest(k.score, i.score), 6) AS score FROM ko k JOIN scores i ON i.a = k.a AND i.b = k.b AND i.layer = 'kpi' JOIN counts s ON s.a = k.a AND s.b = k.b AND s.layer = 'source' AND s.met > 0
  JOIN u2 x ON x.report_id = k.a JOIN u2 y ON y.report_id = k.b WHERE list_has_any(x.groups, y.groups) AND greatest(k.score, i.score) > 0.6)"""
MERGE_CANDIDATES = A.with_views(f"WITH {_MERGES} SELECT a, b, score FROM merges", "reports", "items", "usage")


def worksheet_matches(spark, d):
    """E20 of every pair of a block: how many worksheets match, exactly or but for their grain, and the best score."""
    m = S.sheet_matches(S.candidate_pairs(A.reports(spark, d), BLOCK, named=True), A.sheets(spark, d), X.lev_ratio)
    return m.select("a", "b", "exact", "grain", F.round("best", 6).alias("best"))


def duplicate_reports(spark, d, whole=False):
    """E21: duplicates by their worksheets, and which of the two stays."""
    return S.duplicate_reports(S.candidate_pairs(A.reports(spark, d), BLOCK, named=True), A.sheets(spark, d), _usage(spark, d), None, _ratio(whole))


_CLEAN = lambda c: f"lower({sql_trim(sql_fold(c, X.CLEAN_TEXT))})"
_PART = lambda x, y: f"len(list_intersect({x}, {y})) / least(len({x}), len({y}))::DOUBLE"
_SHEETS = f"""wn AS (SELECT sheet, {_CLEAN("sheet")} AS c FROM (SELECT DISTINCT sheet FROM sheets)), wd AS (SELECT sheet, c, list_distinct(regexp_split_to_array(c, ' ')) AS w FROM wn),
sn AS (SELECT *, named AND true AS n2, core >= 0.7 AS g2 FROM (SELECT x.sheet AS l, y.sheet AS r, (greatest(length(x.c), length(y.c)) - levenshtein(x.c, y.c)) / greatest(length(x.c), length(y.c))::DOUBLE AS near,
  near > 0.75 OR {_PART("x.w", "y.w")} > 0.65 OR contains(x.c, y.c) OR contains(y.c, x.c) AS named,
  coalesce({_PART(f"list_filter(x.w, lambda z: z NOT IN {tuple(S.GRAIN_WORDS)})", f"list_filter(y.w, lambda z: z NOT IN {tuple(S.GRAIN_WORDS)})")}, 0) AS core FROM wd x, wd y) WHERE named OR core >= 0.7),
ax AS (SELECT report_id, sheet, list_transform(axes, lambda z: {_CLEAN("z")}) AS v FROM sheets),
mx AS (SELECT p.a, p.b, n.l, n.r, n.near, n.named, n.core, {_PART("i.v", "j.v")} AS shared,
  len(list_filter(i.v, lambda z: len(list_filter(j.v, lambda u: contains(z, u) OR contains(u, z) OR (greatest(length(z), length(u)) - levenshtein(z, u)) / greatest(length(z), length(u))::DOUBLE > 0.8)) > 0)) / least(len(i.v), len(j.v))::DOUBLE AS loose
  FROM pairs p JOIN ax i ON i.report_id = p.a JOIN sn n ON n.l = i.sheet JOIN ax j ON j.report_id = p.b AND j.sheet = n.r),
sm AS (SELECT * FROM (SELECT a, b, l, r, named AND (shared >= 0.7 OR loose >= 0.7) AS exact, CASE WHEN named AND (shared >= 0.7 OR loose >= 0.7) THEN 2 + near WHEN core >= 0.7 AND shared >= 0.5 THEN 1 + near ELSE 0 END AS score FROM mx) WHERE score > 0)"""
_MATCHED = f"{_PAIRS}, {_SHEETS}"
WORKSHEET_MATCHES = A.with_views(f"WITH {_MATCHED} SELECT a, b, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact) AS grain, round(max(score), 6) AS best FROM sm GROUP BY a, b", "reports", "sheets")
_DUPLICATES = f"""se AS (SELECT a, b, l, r, 1.0::DOUBLE AS score, score AS near FROM sm WHERE exact), {_GREEDY("sg", "se")}, sc AS (SELECT report_id, count(*) AS n FROM sheets GROUP BY 1),
du AS (SELECT g.a, g.b, total::INT AS matched FROM sg g JOIN sc x ON x.report_id = g.a JOIN sc y ON y.report_id = g.b WHERE total >= 0.85 * x.n AND total >= 0.85 * y.n),
dd AS (SELECT CASE WHEN stale THEN a ELSE b END AS report_id, CASE WHEN stale THEN b ELSE a END AS kept, matched FROM (SELECT du.*, coalesce(x.days_ago, 9999) > coalesce(y.days_ago, 9999) AS stale FROM du LEFT JOIN u2 x ON x.report_id = a LEFT JOIN u2 y ON y.report_id = b))"""
DUPLICATE_REPORTS = A.with_views(f"WITH {_MATCHED}, {_USAGE2}, {_DUPLICATES} SELECT report_id, kept, matched FROM dd", "reports", "sheets", "usage")


def kpi_table_overlap(spark, d):
    """E19 of every pair of a block in both directions; the tables are the layer `model`."""
    return S.kpi_table_overlap(_overlap(spark, d, False), _counts(spark, d, ["model"]))


KPI_TABLE_OVERLAP = A.with_views(
    f"""WITH {_COUNTS}, {_OVERLAP}, j AS (SELECT ko.a, ko.b, total, ko.n_a, ko.n_b, met, c.n_a AS t_a, c.n_b AS t_b FROM ko JOIN counts c ON c.a = ko.a AND c.b = ko.b AND c.layer = 'model'),
    two AS (SELECT a AS report_id, b AS other, total, n_a AS n, met, t_a AS t FROM j UNION ALL SELECT b, a, total, n_b, met, t_b FROM j)
    SELECT report_id, other, round(CASE WHEN n > 0 AND t > 0 THEN 0.7 * total / n + 0.3 * met / t WHEN n > 0 THEN total / n WHEN t > 0 THEN met / t::DOUBLE ELSE 0 END, 6) AS overlap FROM two""",
    "reports",
    "items",
)


def recommendations(spark, d, whole=False):
    """Keep, merge or discard; duplicates (E21) neither are merged nor merged into."""
    dup = materialize(duplicate_reports(spark, d, whole).select("report_id").distinct(), "duplicates")
    m = materialize(merge_candidates(spark, d, whole), "merges").join(dup.toDF("a"), "a", "left_anti").join(dup.toDF("b"), "b", "left_anti")
    met = m.select(F.col("a").alias("report_id"), F.col("b").alias("partner"), "score").unionByName(m.select(F.col("b").alias("report_id"), F.col("a").alias("partner"), "score"))
    return S.recommend(A.reports(spark, d), materialize(_usage(spark, d).select("report_id", "days_ago", "groups"), "usage"), dup, met)


RECOMMENDATIONS = A.with_views(
    f"""WITH {_MERGES}, {_SHEETS}, {_DUPLICATES}, dup AS (SELECT DISTINCT report_id FROM dd),
    m2 AS (SELECT a AS report_id, b AS partner, score FROM merges UNION ALL SELECT b, a, score FROM merges),
    best AS (SELECT report_id, arg_max(partner, (score, -partner)) AS partner FROM m2 WHERE report_id NOT IN (SELECT report_id FROM dup) AND partner NOT IN (SELECT report_id FROM dup) GROUP BY 1),
    r AS (SELECT reports.report_id, coalesce(days_ago, 365) > 180 AS stale, coalesce(len(groups), 0) = 0 AS unused, dup.report_id IS NOT NULL AS dup, partner
      FROM reports LEFT JOIN u2 USING (report_id) LEFT JOIN dup USING (report_id) LEFT JOIN best USING (report_id))
    SELECT report_id, CASE WHEN stale OR unused OR dup THEN 'discard' WHEN partner IS NOT NULL THEN 'merge' ELSE 'keep' END AS action,
      array_to_string(list_filter([CASE WHEN stale THEN 'stale' END, CASE WHEN unused THEN 'no groups' END, CASE WHEN dup THEN 'duplicate' END, CASE WHEN partner IS NOT NULL THEN 'merge candidate' END], lambda x: x IS NOT NULL), ', ') AS reasons, partner FROM r""",
    "reports",
    "items",
    "sheets",
    "usage",
)


def _clusters(spark, d, t, whole=False, pairs=None):
    """Clusters of pairs(a, b, composite), computed here where they aren't given."""
    edges = (_composite(spark, d, whole) if pairs is None else pairs).filter(F.col("composite") >= t).select("a", "b")
    return connected_components(edges).select("node", F.col("root").alias("cluster"))


_CC = lambda t: f"""edges AS (SELECT a, b FROM comp WHERE composite >= {t} UNION SELECT b, a FROM comp WHERE composite >= {t}),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
cl AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node)"""  # noqa: E731


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def components(spark, d, whole=False):
    return _clusters(spark, d, 0.7, whole)


COMPONENTS = _recursive(A.with_views(f"WITH {_WIDE}, {_CC(0.7)} SELECT node, cluster FROM cl", "reports", "items"))


def components_at(spark, d, whole=False):
    """Components at several thresholds, with a stable key of the members."""
    out = None
    pairs = materialize(_composite(spark, d, whole).filter("composite >= 0.6").select("a", "b", "composite"), "composite")
    for t in (0.6, 0.8, 0.95):
        c = _clusters(spark, d, t, whole, pairs).groupBy("cluster").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "|"), 256).alias("cluster_key"), F.count("*").alias("members"))
        c = c.select(F.lit(t).alias("threshold"), "cluster", "cluster_key", "members")
        out = c if out is None else out.unionByName(c)
    return out


def _multi(t: float, n: int) -> str:
    cc = _CC(t).replace("edges", f"edges{n}").replace("reach", f"reach{n}").replace("cl AS", f"cl{n} AS")
    return cc


COMPONENTS_AT = _recursive(
    A.with_views(
        f"WITH {_WIDE}, {_multi(0.6, 1)}, {_multi(0.8, 2)}, {_multi(0.95, 3)} "
        + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, cluster, sha256(array_to_string(list_sort(list(node)), '|')) AS cluster_key, count(*) AS members FROM cl{n} GROUP BY cluster" for n, t in ((1, 0.6), (2, 0.8), (3, 0.95))),
        "reports",
        "items",
    )
)


def golden_reports(spark, d, whole=False, pairs=None):
    cl = _clusters(spark, d, 0.6, whole, pairs).select("cluster", F.col("node").alias("report_id"))
    n = A.items(spark, d).groupBy("report_id").agg(F.count("*").alias("completeness"))
    m = cl.join(S.shuffled(n), "report_id").join(S.shuffled(_usage(spark, d)), "report_id")
    m = m.select("cluster", "report_id", "completeness", F.col("n_orders").alias("usage"), (-F.col("days_ago")).alias("freshness"), F.size("groups").alias("governance"), F.col("created").alias("recency"))
    return S.select_golden(m).select("cluster", "report_id", "golden_score", "is_golden")


_MM = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1.0 ELSE ({c} - min({c}) OVER w)::DOUBLE / (max({c}) OVER w - min({c}) OVER w) END"
GOLDEN_REPORTS = _recursive(
    A.with_views(
        f"""WITH {_WIDE}, {_CC(0.6)}, sz AS (SELECT report_id, count(*) AS completeness FROM items GROUP BY 1), u3 AS (SELECT * FROM usage UNION ALL SELECT report_id + 1000000, days_ago, groups, n_orders, total, created FROM usage),
    m AS (SELECT cluster, report_id, completeness, n_orders AS usage, -days_ago AS freshness, len(groups) AS governance, created AS recency FROM cl JOIN sz ON sz.report_id = node JOIN u3 USING (report_id)),
    g AS (SELECT cluster, report_id, round({" + ".join(f"{_MM(c)} * {w}" for c, w in S.GOLDEN.items())}, 6) AS golden_score FROM m WINDOW w AS (PARTITION BY cluster))
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY golden_score DESC, report_id) = 1 AS is_golden FROM g""",
        "reports",
        "items",
        "usage",
    )
)


def gap_tasks(spark, d):
    """What the larger report of a subset pair has that the other lacks."""
    c = _counts(spark, d, ["kpi"])
    sub = S.subsumption(F.col("met"), F.col("n_a"), F.col("n_b"))
    p = c.select(F.when(sub == "a_in_b", F.col("b")).when(sub == "b_in_a", F.col("a")).alias("superset"), F.when(sub == "a_in_b", F.col("a")).when(sub == "b_in_a", F.col("b")).alias("golden")).filter("superset is not null")
    p = materialize(p, "subsets")
    return S.missing_items(p, A.items(spark, d, p.select(F.explode(F.array("superset", "golden")).alias("report_id")).distinct()))


GAP_TASKS = A.with_views(
    f"""WITH {_COUNTS}, p AS (SELECT CASE WHEN n_a > 0 AND met / n_a >= 0.9 THEN b WHEN n_b > 0 AND met / n_b >= 0.9 THEN a END AS superset, CASE WHEN n_a > 0 AND met / n_a >= 0.9 THEN a WHEN n_b > 0 AND met / n_b >= 0.9 THEN b END AS golden
      FROM counts WHERE layer = 'kpi') SELECT superset, golden, i.layer, i.item FROM p JOIN items i ON i.report_id = superset WHERE NOT EXISTS (SELECT 1 FROM items j WHERE j.report_id = golden AND j.layer = i.layer AND j.item = i.item)""",
    "reports",
    "items",
)


def schema_blocks(spark, d):
    """Fingerprints of each layer, and blocks of reports with equal sources and models."""
    f = A.items(spark, d).groupBy("report_id", "layer").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("item")), "|"), 256).alias("h"))
    w = f.groupBy("report_id").pivot("layer", ["source", "model"]).agg(F.first("h"))
    key = F.concat_ws(":", F.coalesce("source", F.lit("none")), F.coalesce("model", F.lit("none")))
    return w.groupBy(key.alias("block")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("report_id")), "|").alias("reports")).filter("n > 1")


SCHEMA_BLOCKS = A.with_views(
    """WITH f AS (SELECT report_id, layer, sha256(string_agg(item, '|' ORDER BY item)) AS h FROM items GROUP BY ALL), w AS (SELECT report_id, coalesce(max(h) FILTER (layer = 'source'), 'none') || ':' || coalesce(max(h) FILTER (layer = 'model'), 'none') AS block FROM f GROUP BY 1)
    SELECT block, count(*) AS n, string_agg(report_id::VARCHAR, '|' ORDER BY report_id) AS reports FROM w GROUP BY 1 HAVING count(*) > 1""",
    "items",
)


def idf_overlap(spark, d):
    """Likeness weighted by how rare a metric is over all reports."""
    i = A.items(spark, d).filter("layer = 'visual'").select("report_id", "item")
    n = i.agg(F.countDistinct("report_id").alias("n"))
    idf = i.groupBy("item").agg(F.countDistinct("report_id").alias("df")).join(F.broadcast(n)).select("item", F.log(F.col("n") / F.col("df")).alias("w"))
    wi = i.join(idf, "item")
    total = wi.groupBy("report_id").agg(F.sum("w").alias("t"))
    p = S.candidate_pairs(A.reports(spark, d), BLOCK)
    met = p.join(wi.withColumnRenamed("report_id", "a"), "a").join(i.withColumnRenamed("report_id", "b"), ["b", "item"]).groupBy("a", "b").agg(F.sum("w").alias("s"))
    out = met.join(total.withColumnsRenamed({"report_id": "a", "t": "ta"}), "a").join(total.withColumnsRenamed({"report_id": "b", "t": "tb"}), "b")
    return out.select("a", "b", F.round(F.col("s") / (F.col("ta") + F.col("tb") - F.col("s")), 6).alias("weighted"))


IDF_OVERLAP = A.with_views(
    f"""WITH {_PAIRS}, i AS (SELECT report_id, item FROM items WHERE layer = 'visual'), idf AS (SELECT item, ln((SELECT count(DISTINCT report_id) FROM i) / count(*)::DOUBLE) AS w FROM i GROUP BY 1),
    wi AS (SELECT * FROM i JOIN idf USING (item)), tot AS (SELECT report_id, sum(w) AS t FROM wi GROUP BY 1)
    SELECT p.a, p.b, round(sum(x.w) / (any_value(ta.t) + any_value(tb.t) - sum(x.w)), 6) AS weighted FROM pairs p JOIN wi x ON x.report_id = p.a JOIN i y ON y.report_id = p.b AND y.item = x.item
    JOIN tot ta ON ta.report_id = p.a JOIN tot tb ON tb.report_id = p.b GROUP BY p.a, p.b""",
    "reports",
    "items",
)

QUERIES = {
    "report_overlap": (report_overlap, REPORT_OVERLAP),
    "metric_sets": (metric_sets, METRIC_SETS),
    "layer_scores": (layer_scores, LAYER_SCORES),
    "composite_pairs": (composite_pairs, COMPOSITE_PAIRS),
    "tier_counts": (tier_counts, TIER_COUNTS),
    "score_details": (score_details, SCORE_DETAILS),
    "persistable_pairs": (persistable_pairs, PERSISTABLE_PAIRS),
    "uniqueness": (uniqueness, UNIQUENESS),
    "shared_sources": (shared_sources, SHARED_SOURCES),
    "merge_candidates": (merge_candidates, MERGE_CANDIDATES),
    "recommendations": (recommendations, RECOMMENDATIONS),
    "components": (components, COMPONENTS),
    "components_at": (components_at, COMPONENTS_AT),
    "golden_reports": (golden_reports, GOLDEN_REPORTS),
    "gap_tasks": (gap_tasks, GAP_TASKS),
    "schema_blocks": (schema_blocks, SCHEMA_BLOCKS),
    "idf_overlap": (idf_overlap, IDF_OVERLAP),
    "greedy_overlap": (greedy_overlap, GREEDY_OVERLAP),
    "kpi_table_overlap": (kpi_table_overlap, KPI_TABLE_OVERLAP),
    "worksheet_matches": (worksheet_matches, WORKSHEET_MATCHES),
    "duplicate_reports": (duplicate_reports, DUPLICATE_REPORTS),
}

#: With names compared by matching blocks, which SQL doesn't have.
_WHOLE = [composite_pairs, tier_counts, score_details, persistable_pairs, uniqueness, merge_candidates, recommendations, components, components_at, golden_reports]
QUERIES["kpi_overlap"] = (kpi_overlap, None)
QUERIES.update({f"{run.__name__}_whole": (partial(run, whole=True), None) for run in _WHOLE})
