"""Queries over names, formulas and rules, with their SQL. Rule tables are shared by both; the engines differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import text as X
from reportweave.sources import adapters as A


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(c: str, steps) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    return c


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sql_agg(c: str) -> str:
    up = f"upper(coalesce(nullif({c}, ''), 'UNKNOWN'))"
    return f"CASE {up} WHEN 'AVERAGE' THEN 'AVG' WHEN 'CNT' THEN 'COUNT' ELSE {up} END"


NAME_SQL = sql_trim(sql_fold(sql_trim("raw"), X.METRIC_NAME))
WS_SQL = lambda c: f"lower({sql_trim(sql_fold(c, X.WORKSHEET_NAME))})"


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    raw, sheet = F.col("raw"), F.col("sheet")
    return m.select(
        "mention_id",
        X.normalize_metric_name(raw).alias("metric"),
        X.clean_text(raw).alias("clean"),
        X.base_metric(raw).alias("base"),
        X.expand_abbreviations(raw).alias("expanded"),
        X.clean_worksheet_name(sheet).alias("worksheet"),
        X.label(sheet).alias("label"),
        X.alnum_key(raw).alias("alnum"),
        X.strip_table_suffix(F.concat(raw, F.lit(" (Table - x)"))).alias("plain"),
    )


CLEAN_NAMES = A.with_views(
    f"""SELECT mention_id, {NAME_SQL} AS metric, lower({sql_trim(sql_fold("raw", X.CLEAN_TEXT))}) AS clean, lower({sql_trim(sql_fold("raw", X.BASE_METRIC))}) AS base,
    {sql_trim(sql_fold(sql_trim("lower(raw)"), X.ABBREVIATIONS))} AS expanded, {WS_SQL("sheet")} AS worksheet,
    {sql_trim(sql_fold(f"lower({sql_trim('sheet')})", X.LABEL))} AS label, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS alnum, trim(raw) AS plain FROM mentions""",
    "mentions",
)


def virtual_aliases(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    return m.select("mention_id", F.explode(X.virtual_aliases(X.normalize_metric_name(F.col("raw")), F.col("sheet"))).alias("alias"))


VIRTUAL_SQL = f"""
SELECT mention_id, lower({NAME_SQL}) AS n, {WS_SQL("sheet")} AS ws,
  list_filter(list_transform(list_filter(regexp_split_to_array(sheet, '[|\\-/]'), lambda p: {sql_trim("p")} <> ''), lambda p: {WS_SQL(sql_trim("p"))}), lambda p: length(p) > 2) AS parts FROM mentions"""
VIRTUAL_ALIASES = A.with_views(
    f"""WITH v AS ({VIRTUAL_SQL}) SELECT DISTINCT mention_id, unnest(list_concat(CASE WHEN length(ws) > 3 THEN [ws, ws || ' ' || n, n || ' by ' || ws] ELSE [] END,
    CASE WHEN len(parts) > 1 THEN [parts[1] || ' ' || parts[2], parts[2] || ' ' || parts[1], parts[1] || ' by ' || parts[2], parts[2] || ' by ' || parts[1]] ELSE [] END)) AS alias FROM v""",
    "mentions",
)


def formula_facts(spark: SparkSession, d: str) -> DataFrame:
    f = A.formulas(spark, d)
    c = F.col("formula")
    return f.select(
        "calc_id",
        X.infer_agg(c).alias("agg"),
        F.array_join(X.field_refs(c), "|").alias("refs"),
        X.formula_tokens(c).alias("tokens"),
        R.is_non_metric(F.col("name"), c).alias("non_metric"),
        R.is_raw_ref(c).alias("raw_ref"),
        R.looks_like_ratio(c).alias("ratio"),
        R.has_money_hint(c).alias("money"),
    )


def _phrases() -> str:
    return " ".join(f"WHEN contains(lower(formula), {q(p)}) THEN {q(a)}" for p, a in X.AGGREGATE_PHRASES)


_CALL = f"regexp_extract(formula, {q(X.AGGREGATES)}, 1)"
FORMULA_FACTS = A.with_views(
    f"""SELECT calc_id, CASE WHEN {_CALL} <> '' THEN {sql_agg(_CALL)} {_phrases()} ELSE 'UNKNOWN' END AS agg,
    array_to_string(list_sort(list_distinct(regexp_extract_all(formula, {q(X.FIELD_REF)}, 1))), '|') AS refs,
    array_to_string(list_sort(string_split({sql_trim(sql_fold("lower(formula)", X.FORMULA_TEXT))}, ' ')), ' ') AS tokens,
    lower(name) IN ({", ".join(map(q, R.NON_METRIC_NAMES))}) OR regexp_matches(lower(name), {q(R.NON_METRIC_NAME)}) OR {" OR ".join(f"regexp_matches(formula, {q(p)})" for p in R.NON_METRIC_FORMULA)} AS non_metric,
    regexp_matches(formula, {q(R.RAW_REF)}) AS raw_ref, regexp_matches(formula, {q(R.RATIO)}) AS ratio, regexp_matches(formula, {q(R.MONEY)}) AS money FROM formulas""",
    "formulas",
)


def complexity_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many formulas use what, per aggregate function and overall."""
    f = A.formulas(spark, d)
    calls = f.select("calc_id", F.explode(F.regexp_extract_all("formula", F.lit(r"([A-Z]+)\("), F.lit(1))).alias("function"))
    return calls.groupBy("function").agg(F.count("*").alias("n_calls"), F.countDistinct("calc_id").alias("n_formulas"))


COMPLEXITY_AUDIT = A.with_views("SELECT function, count(*) AS n_calls, count(DISTINCT calc_id) AS n_formulas FROM (SELECT calc_id, unnest(regexp_extract_all(formula, '([A-Z]+)\\(', 1)) AS function FROM formulas) GROUP BY 1", "formulas")


def match_keys(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    return m.select("mention_id", X.match_key(F.col("raw"), F.col("lineage"), F.col("agg"), F.lit("insurance"), F.col("subdomain")).alias("cache_key"))


MATCH_KEYS = A.with_views(
    "SELECT mention_id, sha256(lower(trim(raw)) || '[\"' || lineage[1] || '\"]' || CASE WHEN agg IN ('UNKNOWN', 'NONE') THEN '' ELSE agg END || 'insurance' || subdomain || 'v1') AS cache_key FROM mentions", "mentions"
)


def granularity(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    return m.select("mention_id", X.split_granularity(F.lower("raw")).alias("x")).select("mention_id", "x.metric", "x.level")


def _initcap(c: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


_GRAIN = r"(?i)^(.*?)\s+(?:by|per)\s+(.*)$"
GRANULARITY = A.with_views(
    f"""WITH n AS (SELECT mention_id, regexp_replace(lower(raw), '(?i)\\bavg\\.?\\b', 'Average', 'g') AS s FROM mentions)
    SELECT mention_id, CASE WHEN regexp_matches(s, {q(_GRAIN)}) THEN {sql_trim(f"regexp_extract(s, {q(_GRAIN)}, 1)")} ELSE {sql_trim("s")} END AS metric,
    CASE WHEN regexp_matches(s, {q(_GRAIN)}) THEN {_initcap(f"regexp_extract(s, {q(_GRAIN)}, 2)")} || ' Level' ELSE 'Overall Level' END AS level FROM n""",
    "mentions",
)


def agg_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Every mention against the bank rows of its subdomain with its lineage: do their aggregations go together?"""
    m = A.mentions(spark, d).select("mention_id", "subdomain", "raw", F.col("agg").alias("r_agg"), F.col("lineage")[0].alias("brand"))
    b = A.bank(spark, d).select("kpi_id", "subdomain", F.col("agg").alias("o_agg"), F.explode("lineage").alias("brand"))
    ok = R.agg_compatible(F.col("r_agg"), F.col("o_agg"), R.looks_like_ratio(F.col("raw")), R.has_money_hint(F.col("raw")))
    return m.join(b, ["subdomain", "brand"]).select("mention_id", "kpi_id", ok.alias("compatible"))


def _in(c: str, values) -> str:
    return f"{c} IN ({', '.join(map(q, values))})"


def sql_compatible(r: str, o: str, ratio: str, money: str) -> str:
    needs = {None: "true", "no ratio": f"NOT {ratio}", "money": money}
    clash = [f"({_in(r, R.TEMPORAL)} AND NOT {_in(o, R.TEMPORAL)})"]
    for one, other, both, when in R.CLASHES:
        clash += [f"({_in(x, one)} AND {_in(y, other)} AND {needs[when]})" for x, y in ([(r, o), (o, r)] if both else [(r, o)])]
    return f"({_in(r, R.OPEN_AGGS)} OR {_in(o, R.OPEN_AGGS)} OR NOT ({' OR '.join(clash)}))"


AGG_COMPATIBILITY = A.with_views(
    f"""WITH m AS (SELECT mention_id, subdomain, raw, {sql_agg("agg")} AS r, lineage[1] AS brand FROM mentions), b AS (SELECT kpi_id, subdomain, {sql_agg("agg")} AS o, unnest(lineage) AS brand FROM bank)
    SELECT mention_id, kpi_id, {sql_compatible("r", "o", f"regexp_matches(raw, {q(R.RATIO)})", f"regexp_matches(raw, {q(R.MONEY)})")} AS compatible FROM m JOIN b USING (subdomain, brand)""",
    "mentions",
    "bank",
)


def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    m = A.mappings(spark, d)
    note = F.element_at(F.array(*[F.lit(x) for x in ("Exact name match", "alias hit", "lineage+agg match", "fuzzy name", "embedding score", "none")]), (F.col("ws") % 6 + 1).cast("int"))
    return m.select("mapping_id", R.status_from_confidence(F.col("confidence")).alias("status"), R.mapping_type(note, F.col("confidence")).alias("mapping_type"), R.is_derived(F.concat(F.lit("Rank | "), "kpi")).alias("derived"))


RULE_FLAGS = A.with_views(
    """WITH n AS (SELECT *, lower(['Exact name match', 'alias hit', 'lineage+agg match', 'fuzzy name', 'embedding score', 'none'][(ws % 6 + 1)::INT]) AS r FROM mappings)
    SELECT mapping_id, CASE WHEN confidence >= 0.95 THEN 'auto_accepted' WHEN confidence >= 0.80 THEN 'pending_review' ELSE 'not_found' END AS status,
    CASE WHEN contains(r, 'exact') AND contains(r, 'match') THEN 'exact' WHEN contains(r, 'alias') THEN 'alias' WHEN contains(r, 'lineage') AND contains(r, 'agg') THEN 'formula_equivalent'
      WHEN contains(r, 'fuzzy') THEN 'alias' WHEN contains(r, 'embedding') THEN 'semantic_match' WHEN confidence < 0.80 THEN 'no_match' ELSE 'semantic_match' END AS mapping_type, true AS derived FROM n""",
    "mappings",
)


def conflicts_by_text(spark: SparkSession, d: str) -> DataFrame:
    """The first false-friend rule that a document's opening and a benchmark-like phrase meet, over conversations."""
    c = A.table(spark, d, "conversations")
    mine = F.element_at(F.array(*[F.lit(x) for x in ("Invoice count", "budget total", "household income", "opportunity stage", "plain")]), (F.col("conv_id") % 5 + 1).cast("int"))
    theirs = F.element_at(F.array(*[F.lit(x) for x in ("outbound call", "net sales", "claim severity", "quote count", "cancellation reason", "none")]), (F.col("turn") % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", R.semantic_conflict(mine, theirs).alias("reason"), R.route_question(F.col("text")).alias("route"))


def conflict_sql() -> str:
    rules = " ".join(f"WHEN regexp_matches(m, {q(a)}) AND regexp_matches(t, {q(b)}) THEN {q(w)}" for a, b, w in R.CONFLICTS)
    return f"CASE WHEN regexp_matches(m, {q(R.BUDGET)}) AND regexp_matches(t, {q(R.BUDGET_NOT)}) AND NOT regexp_matches(t, {q(R.BUDGET)}) THEN {q(R.BUDGET_REASON)} {rules} END"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


CONFLICTS_BY_TEXT = f"""
WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS l, ['Invoice count', 'budget total', 'household income', 'opportunity stage', 'plain'][(conv_id % 5 + 1)::INT] AS m,
  ['outbound call', 'net sales', 'claim severity', 'quote count', 'cancellation reason', 'none'][(turn % 6 + 1)::INT] AS t FROM conversations)
SELECT conv_id, turn, {conflict_sql()} AS reason, CASE WHEN {_any("l", R.METADATA_WORDS)} THEN 'metadata' WHEN {_any("l", R.DATA_WORDS)} THEN 'data' ELSE 'llm' END AS route FROM c
"""


def page_scan(spark: SparkSession, d: str) -> DataFrame:
    """Title, links and headings of pages."""
    p = A.table(spark, d, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s+href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
        F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]>(.*?)</h[1-6]>"), F.lit(1)), "|").alias("headings"),
    )


PAGE_SCAN = r"""
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1))::BIGINT AS n_links,
  array_to_string(regexp_extract_all(html, '(?is)<h[1-6]>(.*?)</h[1-6]>', 1), '|') AS headings FROM pages
"""


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    none = F.array().cast("array<string>")
    return m.select("mention_id", X.embedding_text(F.col("raw"), F.lit(""), F.col("sheet"), F.array("subdomain"), none, F.col("lineage")).alias("text"))


EMBEDDING_TEXTS = A.with_views("SELECT mention_id, raw || ' displayed on worksheet ' || sheet || ' broken down by ' || subdomain || ' ' || lineage[1] AS text FROM mentions", "mentions")


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies wrapped in prose and code fences are read; empty ids are rejections."""
    m = A.mentions(spark, d)
    kpi = F.when(F.col("mention_id") % 3 == 0, "null").otherwise(F.col("mention_id").cast("string"))
    reply = F.concat(F.lit('Sure:\n```json\n{"matched_kpi_id": "'), kpi, F.lit('", "similarity_score": 0.5, "confidence_score": 0.9, "rationale": "r"}\n```'))
    return m.select("mention_id", X.parse_reply(reply).alias("x")).select("mention_id", "x.*")


JUDGE_REPLIES = A.with_views(
    "SELECT mention_id, CASE WHEN mention_id % 3 <> 0 THEN mention_id::VARCHAR END AS matched_kpi_id, 0.5::DOUBLE AS similarity_score, CASE WHEN mention_id % 3 = 0 THEN 0.79::DOUBLE ELSE 0.9::DOUBLE END AS confidence_score FROM mentions", "mentions"
)


def lineage_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    explicit = F.when(kind == 0, F.concat(F.lit("a; "), "p_brand")).when(kind == 1, F.concat(F.lit('["x", "'), "p_type", F.lit('"]')))
    required = F.when(kind == 2, F.concat("p_brand", F.lit(" , b,")))
    return p.select("p_partkey", F.array_join(X.fallback_lineage(F.col("p_type"), F.col("p_name"), explicit, required), "|").alias("lineage"))


LINEAGE_FALLBACKS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|' || p_brand WHEN 1 THEN 'x|' || p_type WHEN 2 THEN p_brand || '|b' ELSE p_type || '.' || p_name END AS lineage FROM part"


def mark_types(spark: SparkSession, d: str) -> DataFrame:
    l = A.table(spark, d, "lineitem")
    bit = lambda n: (F.floor(F.col("l_partkey") / (2**n)) % 2) == 1
    mark = F.when(F.col("l_linenumber") % 5 == 0, F.lower("l_returnflag")).otherwise("Automatic")
    return l.select("l_orderkey", "l_linenumber", R.infer_mark_type(mark, bit(0), bit(1), bit(2), bit(3), bit(4), bit(5)).alias("mark_type"))


MARK_TYPES = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN upper(l_returnflag) WHEN d AND m THEN 'Line' WHEN mr AND mc THEN 'Scatter Plot' WHEN m AND r AND c THEN 'Bar'
  WHEN m THEN 'Text Table / KPI' WHEN r AND c THEN 'Text Table' ELSE 'Text / Value' END AS mark_type
FROM (SELECT *, (l_partkey & 1) > 0 AS d, (l_partkey & 2) > 0 AS m, (l_partkey & 4) > 0 AS mr, (l_partkey & 8) > 0 AS mc, (l_partkey & 16) > 0 AS r, (l_partkey & 32) > 0 AS c FROM lineitem)
"""


def areas_and_activity(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("Claims & Risk", "Customer Service", "New Business Ops", "Sales", "Product Level", "Else")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    days = F.datediff(F.lit("1998-12-31").cast("date"), "o_orderdate")
    return o.select("o_orderkey", R.business_area(domain).alias("area"), R.activity_bucket(days).alias("activity"), days.alias("days"))


AREAS_AND_ACTIVITY = """
SELECT o_orderkey, ['claims-risk', 'customer-service', 'new-business-ops', 'sales-pipeline', 'product-level-performance', 'claims-risk'][(o_orderkey % 6 + 1)::INT] AS area,
  CASE WHEN dd <= 180 THEN 'Recent Activity (< 6 months)' WHEN dd <= 365 THEN 'Moderate Activity (6-12 months)' ELSE 'Stale Activity (> 1 year)' END AS activity, dd::INT AS days
FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') AS dd FROM orders)
"""


QUERIES = {
    "clean_names": (clean_names, CLEAN_NAMES),
    "virtual_aliases": (virtual_aliases, VIRTUAL_ALIASES),
    "formula_facts": (formula_facts, FORMULA_FACTS),
    "complexity_audit": (complexity_audit, COMPLEXITY_AUDIT),
    "match_keys": (match_keys, MATCH_KEYS),
    "granularity": (granularity, GRANULARITY),
    "agg_compatibility": (agg_compatibility, AGG_COMPATIBILITY),
    "rule_flags": (rule_flags, RULE_FLAGS),
    "conflicts_and_routes": (conflicts_by_text, CONFLICTS_BY_TEXT),
    "page_scan": (page_scan, PAGE_SCAN),
    "embedding_texts": (embedding_texts, EMBEDDING_TEXTS),
    "judge_replies": (judge_replies, JUDGE_REPLIES),
    "lineage_fallbacks": (lineage_fallbacks, LINEAGE_FALLBACKS),
    "mark_types": (mark_types, MARK_TYPES),
    "areas_and_activity": (areas_and_activity, AREAS_AND_ACTIVITY),
}
