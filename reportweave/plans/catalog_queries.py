"""Queries of the catalog's imports, lookups, roll-ups, rankings and graph clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import scope as C
from reportweave.functions import text as X
from reportweave.operators import catalog as K
from reportweave.operators import lineage as L
from reportweave.operators import matching as M
from reportweave.operators import review as V
from reportweave.operators import scoring as S
from reportweave.operators.components import connected_components
from reportweave.operators.durable import materialize
from reportweave.plans import pair_queries as P
from reportweave.plans.text_queries import q, sql_fold, sql_trim
from reportweave.sources import adapters as A

BLOCK = P.BLOCK
_pick = lambda key, values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
_sql_pick = lambda key, values: f"[{', '.join('NULL' if v is None else q(v) for v in values)}][({key} % {len(values)} + 1)::INT]"
_map = lambda table: "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"
_label = lambda c: sql_trim(sql_fold(f"lower({sql_trim(c)})", X.LABEL))
_SUBS = sorted({s for subs in C.SECTORS.values() for s in subs})
_in = lambda values: "(" + ", ".join(map(q, values)) + ")"


def _canonical(c: str) -> str:
    key = _label(c)
    under = f"replace(replace({key}, ' & ', '_and_'), ' ', '_')"
    return f"CASE WHEN {c} <> '' THEN coalesce(({_map(C.ALIASES)})[{key}], ({_map(C.ALIASES)})[{under}], CASE WHEN {under} IN {_in(_SUBS)} THEN {under} END) END"


SECTOR_LABELS = ["Insurance", " banking ", "FINANCE", "unknown", None]
SUB_LABELS = ["Claims & Litigation", "UW", "cx & diigtal", "Risk", "Retail", "treasury", "nonsense", None, "Service_&_Operations", "Supply Chain", "(Marketing)"]
DOMAINS = ["New Business Ops", "digital", "nothing", None]
LISTS = ["x, uw; digital", "nonsense", "Claims | Marketing", "", None, "acturial & risk", "retail, distribution"]


def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Sector and subdomain of every customer's report, from labels as people write them."""
    c = A.table(spark, d, "customer").select("c_custkey", *[_pick(F.col("c_custkey"), v).alias(n) for n, v in (("sec", SECTOR_LABELS), ("sub", SUB_LABELS))], _pick(F.floor(F.col("c_custkey") / 3), DOMAINS).alias("dom"))
    s = C.resolve_scope(F.col("sec"), F.col("sub"), F.col("dom"))
    return c.select("c_custkey", C.canonical_subdomain(F.col("sub")).alias("named"), s.alias("s")).select("c_custkey", "named", "s.sector", "s.subdomain")


_VALID = lambda sec: f"CASE WHEN sub <> '' AND {sec} || '/' || coalesce(cs, lower(trim(sub))) IN {_in(C.ALLOWED)} THEN coalesce(cs, lower(trim(sub))) END"
SCOPE_RESOLUTION = f"""
WITH c AS (SELECT c_custkey, {_sql_pick("c_custkey", SECTOR_LABELS)} AS sec, {_sql_pick("c_custkey", SUB_LABELS)} AS sub, {_sql_pick("(c_custkey // 3)", DOMAINS)} AS dom FROM customer),
n AS (SELECT *, {_canonical("sub")} AS cs, CASE WHEN lower(trim(sec)) IN {_in(C.SECTORS)} THEN lower(trim(sec)) END AS given, coalesce(({_map(C.LEGACY)})[lower(trim(dom))], {_canonical("dom")}) AS hint FROM c)
SELECT c_custkey, cs AS named, coalesce(given, 'insurance') AS sector, coalesce(CASE WHEN given IS NOT NULL THEN {_VALID("given")} WHEN dom <> '' THEN hint END, {_VALID("coalesce(given, 'insurance')")}, 'service_and_operations') AS subdomain FROM n"""


def scope_lists(spark, d):
    """The scope that a list of sheets suggests, for every supplier."""
    return A.table(spark, d, "supplier").select("s_suppkey", C.scope_from_list(_pick(F.col("s_suppkey"), LISTS)).alias("subdomain"))


SCOPE_LISTS = f"""
WITH s AS (SELECT s_suppkey, {_sql_pick("s_suppkey", LISTS)} AS l FROM supplier), p AS (SELECT s_suppkey, trim(x.p) AS p, x.i FROM (SELECT s_suppkey, unnest(list_transform(regexp_split_to_array(l, '[,|;]'), lambda p, i: {{'p': p, 'i': i}})) AS x FROM s)),
k AS (SELECT s_suppkey, i, {_canonical("p")} AS c FROM p), f AS (SELECT s_suppkey, arg_min(c, i) AS c FROM k WHERE c IN {_in(C.SECTORS["insurance"])} GROUP BY 1)
SELECT s_suppkey, coalesce(c, 'service_and_operations') AS subdomain FROM s LEFT JOIN f USING (s_suppkey)"""


def _bank(spark, d):
    """The bank with status, sector and line of business."""
    k = F.col("kpi_id")
    return A.bank(spark, d).withColumns({"status": F.when(k % 4 == 0, "retired").otherwise("active"), "sector": _pick(k, ["Insurance", "banking", "insurance"]), "lob": F.when(k % 2 == 0, "life")})


def bank_slice(spark, d):
    return K.bank_slice(_bank(spark, d), ["insurance"], "ECONOMY", "life").select("kpi_id", "name", "sector")


BANK_SLICE = A.with_views("SELECT kpi_id, name, ['Insurance', 'banking', 'insurance'][(kpi_id % 3 + 1)::INT] AS sector FROM bank WHERE kpi_id % 4 <> 0 AND kpi_id % 3 <> 1 AND subdomain = 'ECONOMY' AND kpi_id % 2 = 0", "bank")


def preview_match(spark, d):
    """Which file of a workbook's archive previews which of its tables."""
    p = A.table(spark, d, "part")
    tables = p.select(F.col("p_brand").alias("archive"), F.concat_ws(".", F.lit("dbo"), "p_name").alias("table"), F.concat(F.lit("src "), "p_type").alias("source")).distinct()
    files = p.select(F.col("p_brand").alias("archive"), F.when(F.col("p_size") % 3 == 0, F.concat(F.upper("p_name"), F.lit(".csv"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("src_"), "p_type", F.lit(".txt"))).otherwise(F.concat(F.lit("extra-"), F.col("p_size").cast("string"), F.lit(".csv"))).alias("file")).distinct()
    return K.match_previews(tables, files)


_AN = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
PREVIEW_MATCH = f"""
WITH t AS (SELECT DISTINCT p_brand AS archive, 'dbo.' || p_name AS "table", {_AN("'dbo.' || p_name")} AS t, {_AN("'src ' || p_type")} AS s FROM part),
p AS (SELECT DISTINCT archive, file, {_AN("regexp_replace(file, '\\.[A-Za-z]+$', '')")} AS p FROM (SELECT p_brand AS archive, CASE p_size % 3 WHEN 0 THEN upper(p_name) || '.csv' WHEN 1 THEN 'src_' || p_type || '.txt' ELSE 'extra-' || p_size || '.csv' END AS file FROM part))
SELECT archive, "table", min(file) AS file FROM t JOIN p USING (archive) WHERE contains(t, p) OR contains(p, t) OR s = p GROUP BY 1, 2"""


def bank_import(spark, d):
    """Every part as a row of a bank sheet, against a bank that has some of the names."""
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("row_id"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_brand").alias("definition"), F.lit("insurance").alias("sector"), F.when(k % 3 == 0, _pick(k, SUB_LABELS)).alias("subdomain"), F.when(k % 3 == 1, _pick(k, ["Marketing", "sheet 1"])).alias("tab"), _pick(k, LISTS).alias("applicability"))
    bank = p.filter("p_type = 'ECONOMY'").select(F.upper("p_name").alias("name"), F.lit("marketing").alias("subdomain"))
    return K.import_bank(rows, bank, update=True).select("row_id", "name", "scope", "outcome")


_LIST_SCOPE = f"coalesce((SELECT arg_min(c, i) FROM (SELECT i, {_canonical('t')} AS c FROM (SELECT x.i AS i, trim(x.p) AS t FROM (SELECT unnest(list_transform(regexp_split_to_array(app, '[,|;]'), lambda p, i: {{'p': p, 'i': i}})) AS x))) WHERE c IN {_in(C.SECTORS['insurance'])}), 'service_and_operations')"
BANK_IMPORT = f"""
WITH r AS (SELECT p_partkey AS row_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN {_sql_pick("p_partkey", SUB_LABELS)} END AS sub, CASE WHEN p_partkey % 3 = 1 THEN {_sql_pick("p_partkey", ["Marketing", "sheet 1"])} END AS tab, {_sql_pick("p_partkey", LISTS)} AS app FROM part),
lists AS (SELECT app, {_LIST_SCOPE} AS ls FROM (SELECT DISTINCT app FROM r)), n AS (SELECT *, {_canonical("sub")} AS cs FROM r),
s AS (SELECT row_id, name, coalesce({_VALID("'insurance'")}, {_canonical("tab")}, ls) AS scope FROM n JOIN lists ON n.app IS NOT DISTINCT FROM lists.app),
b AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_type = 'ECONOMY')
SELECT row_id, name, scope, CASE WHEN row_number() OVER (PARTITION BY lower(name), scope ORDER BY row_id) > 1 THEN 'skipped' WHEN scope = 'marketing' AND lower(name) IN (SELECT k FROM b) THEN 'updated' ELSE 'inserted' END AS outcome FROM s"""


def usage_import(spark, d):
    """A usage sheet of all customers, with untidy names, numbers that aren't, and empty groups."""
    c, k = A.table(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(F.concat(F.lit("  "), F.upper("c_name")).alias("name"), F.when(k % 7 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(" "))).alias("days"), F.array(F.col("c_mktsegment"), F.when(k % 2 == 0, " ").otherwise(" ops "), F.lit(None).cast("string")).alias("groups"))
    return K.load_usage(rows).select("key", "days_ago", F.array_join("groups", "|").alias("groups"))


USAGE_IMPORT = "SELECT lower(c_name) AS key, try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE c_custkey::VARCHAR END AS INT) AS days_ago, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '|ops' END AS groups FROM customer"


def calc_attachment(spark, d):
    """Each workbook's calculated fields at the dashboards that use them, else at its first."""
    p = A.table(spark, d, "part").withColumnRenamed("p_brand", "workbook")
    calcs = p.select("workbook", F.col("p_name").alias("calc")).distinct()
    used = p.filter("p_size % 2 = 0").select("workbook", F.col("p_type").alias("dashboard"), F.col("p_name").alias("field"))
    return K.attach_calcs(calcs, used, p.select("workbook", F.col("p_type").alias("dashboard")))


CALC_ATTACHMENT = """WITH c AS (SELECT DISTINCT p_brand AS workbook, p_name AS calc FROM part), u AS (SELECT DISTINCT p_brand AS workbook, p_type AS dashboard, p_name AS calc FROM part WHERE p_size % 2 = 0), f AS (SELECT p_brand AS workbook, min(p_type) AS dashboard FROM part GROUP BY 1)
SELECT workbook, calc, dashboard FROM u UNION ALL SELECT workbook, calc, dashboard FROM c JOIN f USING (workbook) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.workbook = c.workbook AND u.calc = c.calc)"""


def _mapped(spark, d):
    """Mappings with the bank row of their name, where the report's line number is even."""
    ids = A.bank(spark, d).groupBy(F.col("name").alias("kpi")).agg(F.min("kpi_id").alias("kpi_id"))
    m = A.mappings(spark, d).select("mapping_id", "report", "kpi", "canonical", "ws")
    return m.join(ids, "kpi", "left").withColumn("kpi_id", F.when(F.col("ws") % 2 == 0, F.col("kpi_id"))).select("mapping_id", "report", "kpi", "canonical", "kpi_id")


_MAPPED = "ids AS (SELECT name, min(kpi_id) AS kpi_id FROM bank GROUP BY 1), md AS (SELECT mapping_id, report, kpi, canonical, CASE WHEN ws % 2 = 0 THEN kpi_id END AS kpi_id FROM mappings LEFT JOIN ids ON kpi = name)"


def mapping_report(spark, d):
    return K.mapping_report(_mapped(spark, d), A.bank(spark, d)).select("mapping_id", "kpi", "canonical", "kpi_id", "bank_name", "subdomain")


MAPPING_REPORT = A.with_views(f"WITH {_MAPPED} SELECT mapping_id, kpi, canonical, md.kpi_id, name AS bank_name, subdomain FROM md LEFT JOIN bank ON bank.kpi_id = md.kpi_id", "mappings", "bank")


def canonical_names(spark, d):
    return K.with_canonical_name(_mapped(spark, d), A.bank(spark, d)).groupBy("shown").agg(F.count("*").alias("n"), F.countDistinct("report").alias("reports"))


CANONICAL_NAMES = A.with_views(f"WITH {_MAPPED} SELECT coalesce(name, kpi) AS shown, count(*) AS n, count(DISTINCT report) AS reports FROM md LEFT JOIN bank ON bank.kpi_id = md.kpi_id GROUP BY 1", "mappings", "bank")


def summary_mentions(spark, d):
    """Names that only the summary of a sheet has."""
    from reportweave.plans import more_queries as Q

    return K.new_summary_mentions(L.extract_mentions(Q._sheets(spark, d))).select("ws", "name", "agg")


def orphan_worksheets(spark, d):
    """Worksheets whose report isn't in the catalog of settled orders."""
    l, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber").distinct()


def requested_dashboards(spark, d):
    """Dashboards that requests name, by their whole name, file name or a prefix."""
    k = F.col("c_custkey")
    name = F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("-"), "c_mktsegment")
    c = A.table(spark, d, "customer").select("c_custkey", name.alias("name"))
    asked = c.select(F.when(k % 50 == 0, F.concat("name", F.lit(".twbx"))).when(k % 50 == 1, F.substring("name", 1, 11)).when(k % 50 == 2, F.concat(F.upper("name"), F.lit(" v2"))).when(k % 50 == 3, F.substring("name", 1, 4)).alias("wanted")).filter("wanted is not null")
    return K.requested_dashboards(c, asked).select("c_custkey", "name")


REQUESTED_DASHBOARDS = """WITH c AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') || '-' || c_mktsegment AS name FROM customer), r AS (SELECT DISTINCT lower(CASE c_custkey % 50 WHEN 0 THEN name || '.twbx' WHEN 1 THEN name[1:11] WHEN 2 THEN name || ' v2' WHEN 3 THEN name[1:4] END) AS w FROM c WHERE c_custkey % 50 < 4)
SELECT c_custkey, name FROM c WHERE EXISTS (SELECT 1 FROM r WHERE lower(name) = w OR lower(name) || '.twb' = w OR lower(name) || '.twbx' = w OR (length(w) > 5 AND length(name) > 5 AND (starts_with(w, lower(name)) OR starts_with(lower(name), w))))"""


def calc_column_edges(spark, d):
    """References of calculated fields that are columns of their own source."""
    p = A.table(spark, d, "part")
    columns = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("source"), F.col("p_name").alias("column")).unionByName(p.select(F.col("p_brand").alias("source"), F.col("p_brand").alias("column")))
    return K.calc_column_edges(A.formulas(spark, d).withColumnRenamed("sheet", "source"), columns)


CALC_COLUMNS = A.with_views(
    """WITH r AS (SELECT DISTINCT calc_id, sheet AS source, trim(unnest(regexp_extract_all(formula, '\\[([^\\]]+)\\]', 1))) AS "column" FROM formulas), c AS (SELECT p_brand AS source, p_name AS "column" FROM part WHERE p_size % 2 = 0 UNION SELECT p_brand, p_brand FROM part)
    SELECT DISTINCT calc_id, "column" FROM r JOIN c USING (source, "column")""",
    "formulas",
)


def _sets(spark, d, layer="kpi"):
    return S.item_sets(A.items(spark, d).filter(F.col("layer") == layer), [layer]).withColumnRenamed(layer, "kpis")


def ontology_blocks(spark, d):
    """Blocks of reports with equal metrics; reports without any are one."""
    r = A.reports(spark, d).select("report_id").join(_sets(spark, d), "report_id", "left").withColumn("kpis", F.coalesce("kpis", F.array().cast("array<string>")))
    return K.ontology_blocks(r).filter("n > 1").select(F.sha2("block", 256).alias("block"), "n", "first")


ONTOLOGY_BLOCKS = A.with_views("WITH s AS (SELECT report_id, string_agg(item, '|' ORDER BY item) AS k FROM items WHERE layer = 'kpi' GROUP BY 1) SELECT sha256(coalesce(k, 'none')) AS block, count(*) AS n, min(report_id) AS first FROM reports LEFT JOIN s USING (report_id) GROUP BY k HAVING count(*) > 1", "reports", "items")


def portfolio_totals(spark, d):
    return A.dashboards(spark, d).agg(F.count("*").alias("dashboards"), F.sum("worksheets").alias("worksheets"), F.sum("calcs").alias("calcs"), F.sum("sources").alias("sources"))


def area_rollup(spark, d):
    """Each report's user groups, metrics and tables."""
    i = A.items(spark, d)
    n = i.groupBy("report_id").agg(F.count_if(F.col("layer") == "kpi").alias("metrics"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("layer") == "model", F.col("item")))), "|").alias("tables"))
    r = A.reports(spark, d).select("report_id", R.business_area(F.col("segment")).alias("area"))
    return r.join(n, "report_id").join(P._usage(spark, d).select("report_id", F.array_join("groups", "|").alias("groups")), "report_id").select("report_id", "area", "groups", "metrics", "tables")


def _area_sql() -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains(lower(segment), {q(w)})' for w in words)} THEN {q(area)}" for area, words in R.AREAS)
    return f"CASE {rules} ELSE 'claims-risk' END"


AREA_ROLLUP = A.with_views(
    f"""WITH {P._USAGE2}, n AS (SELECT report_id, count(*) FILTER (layer = 'kpi') AS metrics, string_agg(item, '|' ORDER BY item) FILTER (layer = 'model') AS tables FROM items GROUP BY 1)
    SELECT report_id, {_area_sql()} AS area, array_to_string(groups, '|') AS groups, metrics, tables FROM reports JOIN n USING (report_id) JOIN u2 USING (report_id)""",
    "reports",
    "items",
    "usage",
)


def rebuild_metadata(spark, d):
    """Distinct calculated fields of each workbook over its dashboards."""
    f = A.formulas(spark, d).dropDuplicates(["sheet", "name", "formula"]).groupBy("sheet").agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "formula"))).alias("fields"))
    return f.select("sheet", F.size("fields").cast("long").alias("n"), F.sha2(F.array_join("fields", "|"), 256).alias("fields"))


REBUILD_METADATA = A.with_views("SELECT sheet, count(*) AS n, sha256(string_agg(x, '|' ORDER BY x)) AS fields FROM (SELECT DISTINCT sheet, name || '=' || formula AS x FROM formulas) GROUP BY 1", "formulas")


def filter_recommendations(spark, d):
    return K.filter_recommendations(A.reports(spark, d), "77", 2).select("report_id", "name", "workbook")


def ranked_pairs(spark, d):
    """Pairs of a block, those that share most metrics first."""
    c = S.by_layer(S.block_counts(A.reports(spark, d), A.items(spark, d), BLOCK, ["kpi"])).select("a", "b", F.col("met").alias("shared"))
    return K.rank_pairs(c.join(A.reports(spark, d).select(F.col("report_id").alias("a"), *BLOCK), "a"), BLOCK).select("a", "b", "shared", "rank")


RANKED_PAIRS = A.with_views(f"WITH {P._COUNTS} SELECT a, b, met AS shared, row_number() OVER (PARTITION BY workbook, segment ORDER BY met DESC, a, b) AS rank FROM counts JOIN reports ON report_id = a WHERE layer = 'kpi'", "reports", "items")


def shared_last(spark, d):
    return K.shared_last(A.items(spark, d).filter("layer = 'kpi'").select("report_id", "item"))


SHARED_LAST = A.with_views("SELECT report_id, item, is_shared, row_number() OVER (PARTITION BY report_id ORDER BY is_shared, item) AS place FROM (SELECT report_id, item, count(*) OVER (PARTITION BY item) > 1 AS is_shared FROM items WHERE layer = 'kpi')", "items")


def common_kpis(spark, d):
    """What the reports of a pair share: metrics, or else base metrics (names without their kind)."""
    rows = A.reports(spark, d).select("report_id", *BLOCK).join(_sets(spark, d), "report_id")
    a, b = (rows.select(F.col("report_id").alias(c), *BLOCK, F.col("kpis").alias(f"k_{c}")) for c in "ab")
    common = K.common_kpis(F.col("k_a"), F.col("k_b"), lambda k: F.regexp_replace(k, " [A-Z]+$", ""))
    return a.join(b, BLOCK).filter("a < b").select("a", "b", F.array_join(common, "|").alias("common")).filter("common <> ''")


COMMON_KPIS = A.with_views(
    f"""WITH {P._PAIRS}, k AS (SELECT report_id, item, regexp_replace(item, ' [A-Z]+$', '') AS base FROM items WHERE layer = 'kpi'), s AS (SELECT a, b, string_agg(x.item, '|' ORDER BY x.item) AS common FROM pairs JOIN k x ON x.report_id = a JOIN k y ON y.report_id = b AND y.item = x.item GROUP BY 1, 2),
    t AS (SELECT a, b, string_agg(DISTINCT x.base, '|' ORDER BY x.base) AS common FROM pairs JOIN k x ON x.report_id = a JOIN k y ON y.report_id = b AND y.base = x.base GROUP BY 1, 2)
    SELECT t.a, t.b, coalesce(s.common, t.common) AS common FROM t LEFT JOIN s ON s.a = t.a AND s.b = t.b""",
    "reports",
    "items",
)


def union_candidates(spark, d):
    """Pairs of a block that share a source, a metric or a sheet name."""
    c = S.by_layer(S.block_counts(A.reports(spark, d), A.items(spark, d), BLOCK, ["source", "kpi", "visual"])).filter("met > 0")
    return K.union_candidates(*[c.filter(F.col("layer") == x) for x in ("source", "kpi", "visual")])


UNION_CANDIDATES = A.with_views(f"WITH {P._COUNTS} SELECT DISTINCT a, b FROM counts WHERE layer IN ('source', 'kpi', 'visual') AND met > 0", "reports", "items")


def formula_similarity(spark, d):
    """How alike each formula is to the one before it on its sheet, without regard to the order of tokens."""
    f = A.formulas(spark, d).select("calc_id", "sheet", X.formula_tokens(F.col("formula")).alias("t"))
    w = M.W.partitionBy("sheet").orderBy("calc_id")
    pairs = f.withColumns({"before": F.lag("calc_id").over(w), "u": F.lag("t").over(w)}).filter("before is not null")
    return pairs.select("calc_id", "before", F.round(F.when((F.col("t") == "") | (F.col("u") == ""), 0.0).otherwise(X.lev_ratio(F.col("t"), F.col("u"))), 6).alias("similarity"))


_TOKENS = f"array_to_string(list_sort(regexp_split_to_array({sql_trim(sql_fold('lower(formula)', X.FORMULA_TEXT))}, ' ')), ' ')"
FORMULA_SIMILARITY = A.with_views(f"WITH f AS (SELECT calc_id, {_TOKENS} AS t, lag(calc_id) OVER w AS before, lag({_TOKENS}) OVER w AS u FROM formulas WINDOW w AS (PARTITION BY sheet ORDER BY calc_id)) SELECT calc_id, before, round((greatest(length(t), length(u)) - levenshtein(t, u)) / greatest(length(t), length(u))::DOUBLE, 6) AS similarity FROM f WHERE before IS NOT NULL", "formulas")


def visual_equivalence(spark, d):
    """E32 of every pair of a block: a visual counts 1 against one of the same class and field, .7 against one of another class with the same field."""
    v = A.facts(spark, d).select("report_id", F.substring("mark", 1, 1).alias("class"), F.col("p_name").alias("field")).distinct()
    slot = F.row_number().over(M.W.partitionBy("report_id", "field").orderBy("class"))
    two = v.withColumn("slot", slot).select("report_id", F.explode(F.array(F.struct(F.lit("same").alias("layer"), F.concat_ws("|", "field", "class").alias("item")), F.struct(F.lit("field").alias("layer"), F.concat_ws("|", "field", F.col("slot").cast("string")).alias("item")))).alias("x"))
    c = S.block_counts(A.reports(spark, d), two.select("report_id", "x.*"), BLOCK, ["same", "field"])
    same, field, n = F.col("counts")[0]["met"], F.col("counts")[1]["met"], F.greatest(F.col("counts")[0]["n_a"], F.col("counts")[0]["n_b"])
    return c.select("a", "b", F.when(n == 0, 0.0).otherwise((3 * same + 7 * field) / (10 * n)).alias("score"))  # one and .7, in tenths


VISUAL_EQUIVALENCE = A.with_views(
    f"""WITH {P._PAIRS}, v AS (SELECT DISTINCT report_id, mark[1] AS class, p_name AS field FROM facts), n AS (SELECT report_id, count(*) AS n FROM v GROUP BY 1), k AS (SELECT report_id, field, count(*) AS n FROM v GROUP BY 1, 2),
    s AS (SELECT a, b, count(*) AS same FROM pairs JOIN v x ON x.report_id = a JOIN v y ON y.report_id = b AND y.field = x.field AND y.class = x.class GROUP BY 1, 2), f AS (SELECT a, b, sum(least(x.n, y.n)) AS field FROM pairs JOIN k x ON x.report_id = a JOIN k y ON y.report_id = b AND y.field = x.field GROUP BY 1, 2)
    SELECT p.a, p.b, CASE WHEN greatest(coalesce(x.n, 0), coalesce(y.n, 0)) = 0 THEN 0 ELSE (3 * coalesce(same, 0) + 7 * coalesce(field, 0))::DOUBLE / (10 * greatest(x.n, y.n))::DOUBLE END::DOUBLE AS score
    FROM pairs p LEFT JOIN s ON s.a = p.a AND s.b = p.b LEFT JOIN f ON f.a = p.a AND f.b = p.b LEFT JOIN n x ON x.report_id = p.a LEFT JOIN n y ON y.report_id = p.b""",
    "reports",
    "facts",
)


def sub_scores(spark, d):
    """Parts of the model and filter layers of every pair of a block; relations that differ in cardinality or direction count less."""
    r = A.reports(spark, d).select("report_id", *BLOCK)
    rel = A.facts(spark, d).groupBy("report_id", F.col("p_type").alias("edge")).agg(F.min(F.substring("mark", 1, 1)).alias("card"), F.max(F.substring("mark", 2, 1)).alias("dir"))
    edges = r.join(rel.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("card", "dir")))).alias("edges")), "report_id")
    a, b = (edges.select(F.col("report_id").alias(c), *BLOCK, F.col("edges").alias(f"e_{c}")) for c in "ab")
    both = F.array_intersect(F.map_keys("e_a"), F.map_keys("e_b"))
    like = F.aggregate(both, F.lit(0.0), lambda s, k: s + K.edge_likeness(F.element_at("e_a", k)["card"] == F.element_at("e_b", k)["card"], F.element_at("e_a", k)["dir"] == F.element_at("e_b", k)["dir"]))
    rels = a.join(b, BLOCK).filter("a < b").select("a", "b", (like / F.size(F.array_union(F.map_keys("e_a"), F.map_keys("e_b")))).alias("relationships"))
    c = S.score_columns(S.block_counts(r, A.items(spark, d), BLOCK, A.LAYERS), A.LAYERS).join(rels, ["a", "b"], "left")
    c = c.withColumnsRenamed({"model": "columns", "visual": "hierarchies", "kpi": "kpis"}).withColumns({"filters": F.col("filter"), "slicers": F.col("source"), "drillthrough": F.col("hierarchies")})
    return c.select("a", "b", F.round(K.sub_score(K.MODEL_PARTS), 6).alias("model"), F.round(K.sub_score(K.FILTER_PARTS), 6).alias("filter"))


SUB_SCORES = A.with_views(
    f"""WITH {P._COUNTS}, rel AS (SELECT report_id, p_type AS edge, min(mark[1]) AS card, max(mark[2]) AS dir FROM facts GROUP BY 1, 2), rn AS (SELECT report_id, count(*) AS n FROM rel GROUP BY 1),
    rs AS (SELECT a, b, sum(CASE WHEN x.card = y.card THEN 1 ELSE 0.5 END::DOUBLE * CASE WHEN x.dir = y.dir THEN 1 ELSE 0.75 END::DOUBLE) AS s, count(*) AS met FROM pairs JOIN rel x ON x.report_id = a JOIN rel y ON y.report_id = b AND y.edge = x.edge GROUP BY 1, 2),
    w AS (SELECT a, b, {", ".join(f"max(score) FILTER (layer = '{n}') AS {n}_" for n in ("kpi", "model", "source", "visual", "filter"))} FROM scores GROUP BY 1, 2)
    SELECT w.a, w.b, round(0.4 * model_ + 0.35 * coalesce(s / (x.n + y.n - met), 0) + 0.15 * visual_ + 0.1 * kpi_, 6) AS model, round(0.4 * filter_ + 0.35 * source_ + 0.25 * visual_, 6) AS filter
    FROM w LEFT JOIN rs ON rs.a = w.a AND rs.b = w.b LEFT JOIN rn x ON x.report_id = w.a LEFT JOIN rn y ON y.report_id = w.b""",
    "reports",
    "items",
)


def governance_flags(spark, d):
    """Where the governance of a pair's reports differs."""
    k = F.col("report_id")
    r = A.reports(spark, d).select("report_id", *BLOCK, (k % 3).alias("rls"), F.when(k % 4 > 0, k % 2).alias("refresh"), F.lit(1).alias("gateway")).join(P._usage(spark, d).select("report_id", F.col("groups").alias("permissions")), "report_id")
    side = lambda s: r.select(F.col("report_id").alias(s), *BLOCK, *[F.col(c).alias(f"{s}_{c}") for c in ("rls", "refresh", "gateway", "permissions")])
    return K.governance_flags(side("a").join(side("b"), BLOCK).filter("a < b")).select("a", "b", F.array_join("flags", "|").alias("flags"))


GOVERNANCE_FLAGS = A.with_views(
    f"""WITH {P._PAIRS}, {P._USAGE2}, g AS (SELECT report_id, report_id % 3 AS rls, CASE WHEN report_id % 4 > 0 THEN report_id % 2 END AS refresh, groups FROM u2)
    SELECT a, b, concat_ws('|', CASE WHEN x.rls <> y.rls THEN 'RLS_CONFLICT' END, CASE WHEN x.refresh IS DISTINCT FROM y.refresh THEN 'REFRESH_MISMATCH' END, CASE WHEN x.groups <> y.groups THEN 'PERMISSION_DIVERGENCE' END) AS flags
    FROM pairs JOIN g x ON x.report_id = a JOIN g y ON y.report_id = b""",
    "reports",
    "usage",
)


def partial_credit(spark, d):
    """E36: equal metrics count whole and similar ones in part, by the size of the union."""
    o = P._overlap(spark, d, False).join(S.shuffled(P._counts(spark, d, ["kpi"]).select("a", "b", "met")), ["a", "b"])
    union = F.col("n_a") + F.col("n_b") - F.col("met")
    return o.select("a", "b", F.when(union == 0, 0.0).otherwise(F.round(F.col("total") / union, 6)).alias("similarity"))


PARTIAL_CREDIT = A.with_views(f"WITH {P._COUNTS}, {P._OVERLAP} SELECT ko.a, ko.b, CASE WHEN ko.n_a + ko.n_b - met = 0 THEN 0 ELSE round(total / (ko.n_a + ko.n_b - met), 6) END AS similarity FROM ko JOIN counts c ON c.a = ko.a AND c.b = ko.b AND c.layer = 'kpi'", "reports", "items")


def _graph_edges(spark, d, least):
    """Pairs of a block by the likeness of their sheet names."""
    return S.score_columns(S.block_counts(A.reports(spark, d), A.items(spark, d), BLOCK, ["visual"]), ["visual"]).filter(F.col("visual") >= least).select("a", "b", F.round("visual", 6).alias("w"))


_EDGES = lambda least: f"{P._COUNTS}, eg AS (SELECT a, b, round(score, 6) AS w FROM scores WHERE layer = 'visual' AND score >= {least})"


def density_clusters(spark, d):
    return K.density_clusters(_graph_edges(spark, d, 0.4), 2, connected_components)


DENSITY_CLUSTERS = P._recursive(
    A.with_views(
        f"""WITH {_EDGES(0.4)}, tw AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg), co AS (SELECT a FROM tw GROUP BY a HAVING count(*) >= 2), rc AS (SELECT a AS node, a AS seen FROM co UNION SELECT node, tw.b FROM rc JOIN tw ON tw.a = seen WHERE tw.b IN (SELECT a FROM co)),
        cl AS (SELECT node, min(seen) AS cluster FROM rc GROUP BY 1), ed AS (SELECT tw.a AS node, min(cluster) AS c FROM tw LEFT JOIN cl ON cl.node = tw.b WHERE tw.a NOT IN (SELECT a FROM co) GROUP BY 1)
        SELECT node, cluster, 'core' AS kind FROM cl UNION ALL SELECT node, coalesce(c, node), CASE WHEN c IS NULL THEN 'noise' ELSE 'border' END FROM ed""",
        "reports",
        "items",
    )
)


def label_propagation(spark, d):
    return K.label_propagation(_graph_edges(spark, d, 0.4), 3)


_ROUND = lambda n: f"""v{n} AS (SELECT lw.a, label, round(sum(w), 6) AS w FROM lw JOIN l{n - 1} ON l{n - 1}.node = lw.b GROUP BY 1, 2), l{n} AS (SELECT a AS node, arg_max(label, (w, -label)) AS label FROM v{n} GROUP BY 1)"""
LABEL_PROPAGATION = A.with_views(f"WITH {_EDGES(0.4)}, tw AS (SELECT a, b, w FROM eg UNION ALL SELECT b, a, w FROM eg), lw AS (SELECT * FROM tw UNION ALL SELECT a, a, max(w) FROM tw GROUP BY a), l0 AS (SELECT DISTINCT a AS node, a AS label FROM lw), {_ROUND(1)}, {_ROUND(2)}, {_ROUND(3)} SELECT * FROM l3", "reports", "items")


def cluster_recommendations(spark, d):
    """What is to become of each member of a cluster, by its likeness to the golden report. Pairs are counted and scored once, for clusters and for advice."""
    counted = materialize(P._counted(spark, d, A.LAYERS), "pair-counts")
    pairs = materialize(P._composite(spark, d, counted=counted).select("a", "b", "composite"), "composite")
    golden = materialize(P.golden_reports(spark, d, pairs=pairs).select("cluster", "report_id", "is_golden"), "golden")
    members = golden.join(S.shuffled(P._usage(spark, d).select("report_id", "days_ago")), "report_id")
    kpi = F.col("counts")[A.LAYERS.index("kpi")]
    sub = counted.select("a", "b", S.subsumption(kpi["met"], kpi["n_a"], kpi["n_b"]).alias("subset"))
    return S.cluster_recommendation(members, pairs.join(S.shuffled(sub), ["a", "b"]))


CLUSTER_RECOMMENDATIONS = P._recursive(
    P.GOLDEN_REPORTS.replace("WITH RECURSIVE ", "WITH ", 1).replace("SELECT *, row_number() OVER", "gd AS (SELECT *, row_number() OVER", 1)
    + f"""), sb AS (SELECT c.a, c.b, composite, CASE WHEN n_a > 0 AND met / n_a >= 0.9 THEN 'a_in_b' WHEN n_b > 0 AND met / n_b >= 0.9 THEN 'b_in_a' END AS subset FROM counts c JOIN comp ON comp.a = c.a AND comp.b = c.b WHERE layer = 'kpi'),
    s2 AS (SELECT a, b, composite, subset FROM sb UNION ALL SELECT b, a, composite, CASE subset WHEN 'a_in_b' THEN 'b_in_a' WHEN 'b_in_a' THEN 'a_in_b' END FROM sb),
    me AS (SELECT g.cluster, g.report_id, g.is_golden, days_ago, coalesce(composite, 0) AS composite, subset FROM gd g JOIN gd h ON h.cluster = g.cluster AND h.is_golden JOIN u3 ON u3.report_id = g.report_id LEFT JOIN s2 ON s2.a = g.report_id AND s2.b = h.report_id)
    SELECT cluster, report_id, CASE WHEN is_golden THEN 'keep' WHEN days_ago > 90 AND composite > 0.7 THEN 'strong_decommission' WHEN subset = 'a_in_b' THEN 'decommission' WHEN subset = 'b_in_a' THEN 'merge_content_into_golden'
      WHEN composite > 0.95 THEN 'decommission' WHEN composite > 0.8 THEN 'merge' ELSE 'review' END AS advice FROM me"""
).replace("    gd AS (SELECT *", "    , gd AS (SELECT *", 1)


def scaled_usage(spark, d):
    """Usage and freshness of reports by the greatest of their segment."""
    r = A.reports(spark, d).select("report_id", "segment").join(P._usage(spark, d).select("report_id", F.col("n_orders").alias("usage"), F.col("days_ago").alias("days")), "report_id")
    return K.scaled_to_max(r, "segment").select("report_id", F.round("usage_norm", 6).alias("usage_norm"), F.round("freshness_norm", 6).alias("freshness_norm"))


SCALED_USAGE = A.with_views(f"WITH {P._USAGE2.replace('groups FROM usage', 'n_orders FROM usage')}, r AS (SELECT report_id, segment, ln(1 + n_orders) AS u, days_ago AS d FROM reports JOIN u2 USING (report_id)) SELECT report_id, round(u / max(u) OVER w, 6) AS usage_norm, round(1 - d / (max(d) OVER w)::DOUBLE, 6) AS freshness_norm FROM r WINDOW w AS (PARTITION BY segment)", "reports", "usage")


def promoted_bank(spark, d):
    """The bank after every third mapping that was not found became a row of its own."""
    m = A.mappings(spark, d).select("mapping_id", F.concat("kpi", F.lit(" "), F.col("ws").cast("string")).alias("kpi"), F.col("canonical").alias("subdomain"), R.status_from_confidence(F.col("confidence")).alias("status"))
    return V.promote(m, A.bank(spark, d), m.filter("mapping_id % 3 = 0").select("mapping_id"))


PROMOTED_BANK = A.with_views("SELECT kpi_id, name, subdomain FROM bank UNION ALL SELECT -min(mapping_id), kpi || ' ' || ws, canonical FROM mappings WHERE mapping_id % 3 = 0 AND confidence < 0.8 GROUP BY 2, 3", "mappings", "bank")


def filled_lineage(spark, d):
    """The bank's empty lineages filled by the first accepted mapping of the name."""
    b = A.bank(spark, d).withColumn("lineage", F.when(F.col("kpi_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("lineage")))
    acc = A.mappings(spark, d).filter("confidence >= 0.95").select("kpi", F.array("canonical").alias("lineage"), F.struct("l_shipdate", "mapping_id").alias("resolved_at")).join(b.select("kpi_id", F.col("name").alias("kpi")), "kpi")
    return V.fill_lineage(b.select("kpi_id", "lineage"), acc).select("kpi_id", F.array_join("lineage", "|").alias("lineage"))


FILLED_LINEAGE = A.with_views("WITH f AS (SELECT kpi, arg_min(canonical, (l_shipdate, mapping_id)) AS c FROM mappings WHERE confidence >= 0.95 GROUP BY 1) SELECT kpi_id, CASE WHEN kpi_id % 2 = 0 THEN coalesce(c, '') ELSE array_to_string(lineage, '|') END AS lineage FROM bank LEFT JOIN f ON kpi = name", "mappings", "bank")


def approved_scopes(spark, d):
    """Dashboards after the latest approval of what was open."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("report"), F.col("event_type").alias("sector"), F.lit("approved").alias("subdomain"), F.struct("ts", "event_id").alias("ts"))
    return K.approve_scopes(A.dashboards(spark, d), e)


APPROVED_SCOPES = A.with_views("WITH a AS (SELECT user_id AS report, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY 1) SELECT report, coalesce(sector, s) AS sector, coalesce(subdomain, CASE WHEN s IS NOT NULL THEN 'approved' END) AS subdomain FROM dashboards LEFT JOIN a USING (report)", "dashboards")


def json_facts(spark, d):
    """Properties of events out of fenced text, with a list column that is broken now and then, and a complexity of the two."""
    fenced = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 9 == 0, "not json").otherwise(F.col("props")), F.lit("\n```"))
    listed = F.when(F.col("event_id") % 5 == 0, '["a", "b"').otherwise(F.concat(F.lit('["'), "event_type", F.lit('", "x"]')))
    k = X.fenced_json(fenced, "k int")["k"]
    n = F.size(X.json_list(listed))
    return A.table(spark, d, "events").select("event_id", k.alias("k"), n.alias("n"), F.round(R.complexity(F.coalesce(k, F.lit(0)) / 10, n), 4).alias("complexity"))


JSON_FACTS = "SELECT event_id, k, n, round(greatest(1, least(10, 1.2::DOUBLE * coalesce(k, 0) / 10 + 1.5::DOUBLE * n)), 4)::DOUBLE AS complexity FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (props->>'k')::INT END AS k, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n FROM events)"


def classification_requests(spark, d):
    f = A.formulas(spark, d).withColumns({"source": F.concat(F.lit("src "), (F.col("calc_id") % 3).cast("string")), "column": F.col("name")})
    return K.classification_requests(f, "sheet").select("sheet", F.sha2("request", 256).alias("request"), F.length("request").cast("long").alias("chars"))


CLASSIFICATION = A.with_views(
    """WITH p AS (SELECT sheet, array_to_string(list_sort(list(DISTINCT 'src ' || calc_id % 3)), '; ') AS s, array_to_string(list_sort(list(DISTINCT name || ': ' || formula)), '; ') AS f, array_to_string(list_sort(list(DISTINCT name)), '; ') AS c FROM formulas GROUP BY 1),
    r AS (SELECT sheet, 'Sources: ' || s || chr(10) || 'Formulas: ' || f || chr(10) || 'Columns: ' || c AS request FROM p) SELECT sheet, sha256(request) AS request, length(request) AS chars FROM r""",
    "formulas",
)


def confident_kpis(spark, d):
    """The classified metrics of each report above a confidence of 60."""
    g = A.mappings(spark, d).groupBy("report").agg(F.array_sort(F.collect_list(F.struct("kpi", "ws", F.round(F.col("confidence") * 100).alias("confidence")))).alias("kpis"))
    return g.select("report", F.array_join(F.transform(K.confident(F.col("kpis")), lambda k: k["kpi"]), "|").alias("kpis"))


CONFIDENT_KPIS = A.with_views("SELECT report, coalesce(string_agg(kpi, '|' ORDER BY kpi, ws) FILTER (round(confidence * 100) > 60), '') AS kpis FROM mappings GROUP BY 1", "mappings")


def _kpi_graph(spark, d):
    """Nodes and edges of seven kinds around a report's metrics."""
    r, i, u = A.reports(spark, d), A.items(spark, d), P._usage(spark, d)
    grain = i.filter("layer = 'visual'").select("report_id", X.split_granularity(F.concat_ws(" by ", "item", F.element_at(F.split("item", " "), 1))).alias("g")).select("report_id", "g.metric", "g.level")
    r = r.join(u, "report_id").select("report_id", "name", R.business_area(F.col("segment")).alias("area"), R.activity_bucket(F.col("days_ago")).alias("recency"), "groups")
    g = r.select("report_id", F.explode("groups").alias("group"))
    node = lambda df, kind, key, label=None: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label or key).cast("string").alias("label"))
    edge = lambda df, s, sk, t, tk, kind: df.select(F.concat(F.lit(f"{s}:"), F.col(sk).cast("string")).alias("src"), F.concat(F.lit(f"{t}:"), F.col(tk).cast("string")).alias("dst"), F.lit(kind).alias("kind"))
    model = i.filter("layer = 'model'")
    nodes = [node(r, "dashboard", "report_id", "name"), node(r, "area", "area"), node(g, "group", "group"), node(r, "recency", "recency"), node(grain, "kpi", "metric"), node(grain, "granularity", "level"), node(model, "table", "item")]
    edges = [edge(r, "dashboard", "report_id", "area", "area", "in"), edge(g, "dashboard", "report_id", "group", "group", "used by"), edge(r, "dashboard", "report_id", "recency", "recency", "last used"), edge(grain, "dashboard", "report_id", "kpi", "metric", "shows"), edge(grain, "kpi", "metric", "granularity", "level", "at"), edge(model, "dashboard", "report_id", "table", "item", "reads")]
    return L.graph(nodes, edges)


_INITCAP = "upper(split_part(item, ' ', 1)[1]) || split_part(item, ' ', 1)[2:] || ' Level'"
_KPI_GRAPH = f"""{P._USAGE2}, rr AS (SELECT report_id, name, {_area_sql()} AS area, CASE WHEN days_ago <= 180 THEN 'Recent Activity (< 6 months)' WHEN days_ago <= 365 THEN 'Moderate Activity (6-12 months)' ELSE 'Stale Activity (> 1 year)' END AS recency, groups FROM reports JOIN u2 USING (report_id)),
gg AS (SELECT report_id, unnest(groups) AS g FROM rr), gn AS (SELECT report_id, item AS metric, {_INITCAP} AS level FROM items WHERE layer = 'visual'), mo AS (SELECT report_id, item FROM items WHERE layer = 'model'),
no AS (SELECT id, kind, min(label) AS label FROM (SELECT 'dashboard:' || report_id AS id, 'dashboard' AS kind, name AS label FROM rr UNION ALL SELECT 'area:' || area, 'area', area FROM rr UNION ALL SELECT 'group:' || g, 'group', g FROM gg UNION ALL SELECT 'recency:' || recency, 'recency', recency FROM rr
  UNION ALL SELECT 'kpi:' || metric, 'kpi', metric FROM gn UNION ALL SELECT 'granularity:' || level, 'granularity', level FROM gn UNION ALL SELECT 'table:' || item, 'table', item FROM mo) GROUP BY 1, 2),
ee AS (SELECT 'dashboard:' || report_id AS src, 'area:' || area AS dst, 'in' AS kind FROM rr UNION SELECT 'dashboard:' || report_id, 'group:' || g, 'used by' FROM gg UNION SELECT 'dashboard:' || report_id, 'recency:' || recency, 'last used' FROM rr
  UNION SELECT 'dashboard:' || report_id, 'kpi:' || metric, 'shows' FROM gn UNION SELECT 'kpi:' || metric, 'granularity:' || level, 'at' FROM gn UNION SELECT 'dashboard:' || report_id, 'table:' || item, 'reads' FROM mo)"""


def kpi_graph_nodes(spark, d):
    return _kpi_graph(spark, d)[0]


def kpi_graph_edges(spark, d):
    return _kpi_graph(spark, d)[1]


def metadata_lineage(spark, d):
    """Edges from workbook to calculated field to column; fields that refer to no column hang on their workbook as orphans."""
    f = A.formulas(spark, d)
    cols = calc_column_edges(spark, d)
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    orphan = f.join(cols.select("calc_id").distinct(), "calc_id", "left_anti")
    parts = [f.select(named("workbook", "sheet").alias("src"), named("calc", "calc_id").alias("dst"), F.lit("contains").alias("kind")), cols.select(named("calc", "calc_id").alias("src"), named("column", "column").alias("dst"), F.lit("refers to").alias("kind")), orphan.select(named("workbook", "sheet").alias("src"), named("calc", "calc_id").alias("dst"), F.lit("orphan").alias("kind"))]
    return L.graph([f.select(named("calc", "calc_id").alias("id"), F.lit("calc").alias("kind"), F.col("name").alias("label"))], parts)[1]


_CC = CALC_COLUMNS[CALC_COLUMNS.index("r AS (SELECT DISTINCT calc_id") :].replace("\n    SELECT DISTINCT calc_id", ", cc AS (SELECT DISTINCT calc_id") + ")"
METADATA_LINEAGE = A.with_views(f"WITH {_CC} SELECT 'workbook:' || sheet AS src, 'calc:' || calc_id AS dst, 'contains' AS kind FROM formulas UNION SELECT 'calc:' || calc_id, 'column:' || \"column\", 'refers to' FROM cc UNION SELECT 'workbook:' || sheet, 'calc:' || calc_id, 'orphan' FROM formulas WHERE calc_id NOT IN (SELECT calc_id FROM cc)", "formulas")

QUERIES = {
    "scope_resolution": (scope_resolution, SCOPE_RESOLUTION),
    "scope_lists": (scope_lists, SCOPE_LISTS),
    "bank_slice": (bank_slice, BANK_SLICE),
    "preview_match": (preview_match, PREVIEW_MATCH),
    "bank_import": (bank_import, BANK_IMPORT),
    "usage_import": (usage_import, USAGE_IMPORT),
    "calc_attachment": (calc_attachment, CALC_ATTACHMENT),
    "mapping_report": (mapping_report, MAPPING_REPORT),
    "canonical_names": (canonical_names, CANONICAL_NAMES),
    "summary_mentions": (summary_mentions, "SELECT DISTINCT s.ws, s.name, 'SUM' AS agg FROM (SELECT DISTINCT p_partkey % 50 AS ws, 'total ' || p_name AS name FROM part) s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 50 = s.ws AND lower(p.p_name) = lower(s.name))"),
    "orphan_worksheets": (orphan_worksheets, "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"),
    "requested_dashboards": (requested_dashboards, REQUESTED_DASHBOARDS),
    "calc_column_edges": (calc_column_edges, CALC_COLUMNS),
    "ontology_blocks": (ontology_blocks, ONTOLOGY_BLOCKS),
    "portfolio_totals": (portfolio_totals, A.with_views("SELECT count(*) AS dashboards, sum(worksheets)::BIGINT AS worksheets, sum(calcs)::BIGINT AS calcs, sum(sources)::BIGINT AS sources FROM dashboards", "dashboards")),
    "area_rollup": (area_rollup, AREA_ROLLUP),
    "rebuild_metadata": (rebuild_metadata, REBUILD_METADATA),
    "filter_recommendations": (filter_recommendations, A.with_views("SELECT report_id, name, workbook FROM reports WHERE (contains(lower(name), '77') OR contains(workbook::VARCHAR, '77')) AND workbook = 2", "reports")),
    "ranked_pairs": (ranked_pairs, RANKED_PAIRS),
    "shared_last": (shared_last, SHARED_LAST),
    "common_kpis": (common_kpis, COMMON_KPIS),
    "union_candidates": (union_candidates, UNION_CANDIDATES),
    "formula_similarity": (formula_similarity, FORMULA_SIMILARITY),
    "visual_equivalence": (visual_equivalence, VISUAL_EQUIVALENCE),
    "sub_scores": (sub_scores, SUB_SCORES),
    "governance_flags": (governance_flags, GOVERNANCE_FLAGS),
    "partial_credit": (partial_credit, PARTIAL_CREDIT),
    "density_clusters": (density_clusters, DENSITY_CLUSTERS),
    "label_propagation": (label_propagation, LABEL_PROPAGATION),
    "cluster_recommendations": (cluster_recommendations, CLUSTER_RECOMMENDATIONS),
    "scaled_usage": (scaled_usage, SCALED_USAGE),
    "promoted_bank": (promoted_bank, PROMOTED_BANK),
    "filled_lineage": (filled_lineage, FILLED_LINEAGE),
    "approved_scopes": (approved_scopes, APPROVED_SCOPES),
    "json_facts": (json_facts, JSON_FACTS),
    "classification_requests": (classification_requests, CLASSIFICATION),
    "confident_kpis": (confident_kpis, CONFIDENT_KPIS),
    "kpi_graph_nodes": (kpi_graph_nodes, A.with_views(f"WITH {_KPI_GRAPH} SELECT * FROM no", "reports", "items", "usage")),
    "kpi_graph_edges": (kpi_graph_edges, A.with_views(f"WITH {_KPI_GRAPH} SELECT * FROM ee", "reports", "items", "usage")),
    "metadata_lineage": (metadata_lineage, METADATA_LINEAGE),
}
