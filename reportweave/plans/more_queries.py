"""Queries of sketches, extraction, lineage, ingest and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import catalog as C
from reportweave.operators import lineage as L
from reportweave.operators import scoring as S
from reportweave.operators import sketches as K
from reportweave.plans.pair_queries import BLOCK
from reportweave.plans.text_queries import NAME_SQL
from reportweave.sources import adapters as A
from reportweave.streaming import catalog as P
from reportweave.streaming import incremental as I
from reportweave.streaming import jobs as T


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """MinHash candidates with their exact Jaccard likeness."""
    kpi = A.items(spark, d).filter("layer = 'kpi'")
    block = A.reports(spark, d).select("report_id", F.concat_ws("|", *BLOCK).alias("block"))
    pairs = K.minhash_pairs(kpi.select("report_id", "item"), block)
    return S.layer_scores(S.shared_counts(kpi, pairs, ["kpi"])).select("a", "b", "score")


def simhash_near(spark, d):
    """Near pairs of all documents, whatever their source and language; the least of equal hashes stands for them."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return K.simhash_all(K.simhash(docs, "id", "text"))


def trigram_block(spark, d):
    return K.trigram_similarity(A.table(spark, d, "part").select(F.col("p_name").alias("name")), 0.3)


TRIGRAM = """
WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT DISTINCT name, substr(p, i, 3) AS g FROM (SELECT name, '  ' || lower(name) || ' ' AS p, unnest(range(1, length(name) + 2)) AS i FROM n)),
s AS (SELECT name, count(*) AS n FROM g GROUP BY 1), m AS (SELECT x.name AS a, y.name AS b, count(*) AS met FROM g x JOIN g y ON x.g = y.g AND x.name < y.name GROUP BY ALL)
SELECT a, b, round(met / (x.n + y.n - met)::DOUBLE, 6) AS similarity FROM m JOIN s x ON x.name = a JOIN s y ON y.name = b WHERE round(met / (x.n + y.n - met)::DOUBLE, 6) >= 0.3
"""


def fingerprints(spark, d):
    return K.fingerprints(A.items(spark, d))


FINGERPRINTS = A.with_views("""SELECT report_id, layer, sha256('["' || string_agg(item, '","' ORDER BY item) || '"]') AS hash FROM items GROUP BY ALL""", "items")


def signature_classes(spark, d):
    p = A.formulas(spark, d)
    m = p.select(F.col("calc_id").alias("id"), X.field_refs(F.col("formula")).alias("inputs"), X.infer_agg(F.col("formula")).alias("agg"), (F.col("calc_id") % 6).cast("string").alias("type"), "sheet")
    return K.signature_classes(m.withColumn("type", F.concat("type", "sheet")).drop("sheet"))


SIGNATURES = A.with_views(
    """WITH s AS (SELECT calc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(formula, '\\[([^\\]]+)\\]', 1))), ',') || '|' || (calc_id % 6) || sheet AS k FROM formulas)
    SELECT calc_id AS id, min(calc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1""",
    "formulas",
)


def _sheets(spark, d):
    p = A.table(spark, d, "part")
    agg = F.when(F.col("p_partkey") % 2 == 0, "SUM").otherwise("AVG")
    measure = F.struct(F.col("p_name").alias("name"), agg.alias("agg"), F.col("p_brand").alias("field"))
    g = p.groupBy((F.col("p_partkey") % 50).alias("ws")).agg(F.array_sort(F.collect_set(measure)).alias("measures"), F.array_sort(F.collect_set("p_type")).alias("dims"), F.array_sort(F.collect_set(F.concat(F.lit("total "), "p_name"))).alias("summary"))
    return g.withColumn("marks", F.slice("measures", 1, 2))


def mentions_found(spark, d):
    return L.extract_mentions(_sheets(spark, d)).select("ws", "name", "source", "agg", F.array_join("lineage", ",").alias("lineage"))


def mentions_kept(spark, d):
    return L.dedupe_mentions(L.extract_mentions(_sheets(spark, d))).select("ws", "name", "source", "agg", F.array_join("lineage", ",").alias("lineage"))


_SHEETS = """me AS (SELECT DISTINCT p_partkey % 50 AS ws, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'SUM' ELSE 'AVG' END AS agg, p_brand AS field FROM part),
mk AS (SELECT ws, agg, field FROM me QUALIFY row_number() OVER (PARTITION BY ws ORDER BY name, agg, field) <= 2), di AS (SELECT DISTINCT p_partkey % 50 AS ws, p_type AS dm FROM part),
mentions_ AS (SELECT ws, name, 'named_measure' AS source, agg, field AS lineage FROM me UNION ALL SELECT ws, agg || ' of ' || field, 'visual_binding', agg, field FROM me
  UNION ALL SELECT me.ws, agg || ' of ' || field || ' by ' || dm, 'visual_breakdown', agg, field FROM me JOIN di ON di.ws = me.ws UNION ALL SELECT ws, agg || ' of ' || field, 'mark_card', agg, field FROM mk
  UNION ALL SELECT DISTINCT p_partkey % 50, 'total ' || p_name, 'summary', 'SUM', '' FROM part)"""
MENTIONS = f"WITH {_SHEETS} SELECT ws, name, source, agg, lineage FROM mentions_"
KEPT = f"""WITH {_SHEETS}, k AS (SELECT * FROM mentions_ m WHERE source NOT IN ('visual_binding', 'mark_card') OR NOT EXISTS (SELECT 1 FROM mentions_ n WHERE n.source = 'named_measure' AND n.ws = m.ws AND n.lineage = m.lineage AND n.agg = m.agg))
SELECT ws, name, source, agg, lineage FROM k QUALIFY row_number() OVER (PARTITION BY ws, lower(name) ORDER BY list_position(['named_measure', 'visual_binding', 'visual_breakdown', 'mark_card', 'summary'], source), name, agg, lineage) = 1"""


def switchers(spark, d):
    return L.expand_switchers(A.formulas(spark, d).select("calc_id", "name", "formula"))


SWITCHERS = A.with_views(
    """WITH RECURSIVE c AS (SELECT calc_id, name, formula, contains(upper(formula), 'CASE') AND NOT regexp_matches(formula, '(?i)^\\s*(SUM|AVG|AVERAGE|COUNT|COUNTD|MIN|MAX|MEDIAN)\\s*\\(') AS sw, list_distinct(regexp_extract_all(formula, '(?i)THEN\\s+\\[([^\\]]+)\\]', 1)) AS refs FROM formulas),
    byname AS (SELECT lower(name) AS k, arg_min(sw, calc_id) AS more, arg_min(refs, calc_id) AS next FROM c GROUP BY 1),
    walk AS (SELECT calc_id, unnest(refs) AS ref, 1 AS depth FROM c WHERE sw UNION ALL SELECT w.calc_id, unnest(b.next), w.depth + 1 FROM walk w JOIN byname b ON b.k = lower(w.ref) AND b.more WHERE w.depth < 3)
    SELECT calc_id, ref, min(depth) AS depth FROM walk LEFT JOIN byname b ON b.k = lower(ref) WHERE NOT coalesce(more, false) GROUP BY 1, 2""".replace("WITH RECURSIVE ", "WITH "),
    "formulas",
).replace("WITH ", "WITH RECURSIVE ", 1)


def _graph(spark, d):
    r, i = A.reports(spark, d), A.items(spark, d).filter("layer in ('kpi', 'model')")
    node = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("label"))
    edge = lambda df, s, sk, t, tk, kind: df.select(F.concat(F.lit(f"{s}:"), F.col(sk).cast("string")).alias("src"), F.concat(F.lit(f"{t}:"), F.col(tk).cast("string")).alias("dst"), F.lit(kind).alias("kind"))
    kpi, model = i.filter("layer = 'kpi'"), i.filter("layer = 'model'")
    nodes = [node(r, "workbook", "workbook"), node(r, "report", "report_id"), node(kpi, "kpi", "item"), node(model, "table", "item")]
    return L.graph(nodes, [edge(r, "workbook", "workbook", "report", "report_id", "contains"), edge(kpi, "report", "report_id", "kpi", "item", "shows"), edge(model, "report", "report_id", "table", "item", "reads")])


_GRAPH = """ki AS (SELECT * FROM items WHERE layer = 'kpi'), mo AS (SELECT * FROM items WHERE layer = 'model'),
nodes AS (SELECT DISTINCT 'workbook:' || workbook AS id, 'workbook' AS kind, workbook::VARCHAR AS label FROM reports UNION SELECT 'report:' || report_id, 'report', report_id::VARCHAR FROM reports UNION SELECT 'kpi:' || item, 'kpi', item FROM ki UNION SELECT 'table:' || item, 'table', item FROM mo),
edges AS (SELECT 'workbook:' || workbook AS src, 'report:' || report_id AS dst, 'contains' AS kind FROM reports UNION SELECT 'report:' || report_id, 'kpi:' || item, 'shows' FROM ki UNION SELECT 'report:' || report_id, 'table:' || item, 'reads' FROM mo)"""


def lineage_nodes(spark, d):
    return _graph(spark, d)[0]


def lineage_edges(spark, d):
    return _graph(spark, d)[1]


def deep_lineage(spark, d):
    """What every workbook reaches through its reports, and how far."""
    return L.deep_lineage(_graph(spark, d)[1].filter("kind <> 'reads'").select("src", "dst"))


def calc_lineage(spark, d):
    """From every tenth part's metric through calculated fields, which refer to others of half and a third of their number, to base columns."""
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    ref = lambda by: F.concat(F.lit("[Calc "), F.floor(k / by).cast("string"), F.lit("]"))
    brand = F.concat(F.lit("["), "p_brand", F.lit("]"))
    formula = F.when(k < 2, F.concat(F.lit("SUM(["), "p_type", F.lit("])"))).when(k % 5 == 0, F.concat(F.lit("IF "), brand, F.lit(" > 0 THEN "), ref(2), F.lit(" END"))).otherwise(F.concat(F.lit("SUM("), ref(2), F.lit(") / "), ref(3)))
    calcs = p.select(F.concat(F.lit("calc "), k.cast("string")).alias("name"), formula.alias("formula"))
    shown = p.filter("p_partkey % 10 = 0").select(F.concat(F.lit("kpi:"), k.cast("string")).alias("src"), F.concat(F.lit("calc:calc "), k.cast("string")).alias("dst"))
    return L.deep_lineage(L.calc_edges(calcs).unionByName(shown), F.col("src").startswith("kpi:"))


CALC_LINEAGE = """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_brand, p_type FROM part),
e AS (SELECT 'calc:calc ' || k AS src, 'calc:calc ' || (k // 2) AS dst FROM c WHERE k >= 2 UNION SELECT 'calc:calc ' || k, 'calc:calc ' || (k // 3) FROM c WHERE k >= 2 AND k % 5 <> 0
  UNION SELECT 'calc:calc ' || k, 'column:' || p_brand FROM c WHERE k >= 2 AND k % 5 = 0 UNION SELECT 'calc:calc ' || k, 'column:' || p_type FROM c WHERE k < 2),
r AS (SELECT 'kpi:' || k AS src, 'calc:calc ' || k AS dst, 1 AS depth FROM c WHERE k % 10 = 0 UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.dst WHERE r.depth < 100)
SELECT src, dst, min(depth)::INT AS depth FROM r GROUP BY 1, 2"""


def source_matches(spark, d):
    """Orders as sources of the columns that their lines name, some in the plural: pairs that match at a rate above .8, and how many orders stand behind each side."""
    p = A.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    l = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    plural = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, "s").otherwise("")
    pairs, members = K.source_matches(l.select(F.col("l_orderkey").alias("source"), F.concat("p_name", plural, F.lit(" "), "p_type").alias("column")))
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    return pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").select("a", "b", "n_a", "n_b", F.round("rate", 6).alias("rate"))


SOURCE_MATCHES = """WITH s AS (SELECT l_orderkey AS source, list_sort(list(DISTINCT lower(p_name || CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 's' ELSE '' END || ' ' || p_type))) AS cols FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT cols, min(source) AS id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT id, len(cols) AS n, unnest(cols) AS name FROM k), names AS (SELECT DISTINCT name FROM c),
g AS (SELECT DISTINCT name, substr('  ' || name || ' ', i, 3) AS g FROM (SELECT name, unnest(range(1, length(name) + 2)) AS i FROM names)), z AS (SELECT name, count(*) AS n FROM g GROUP BY 1),
sim AS (SELECT x.name AS x, y.name AS y, count(*) AS met FROM g x JOIN g y USING (g) GROUP BY 1, 2), ok AS (SELECT x, y FROM sim JOIN z a ON a.name = x JOIN z b ON b.name = y WHERE x = y OR round(met / (a.n + b.n - met)::DOUBLE, 6) > 0.6),
hit AS (SELECT DISTINCT p.id AS a, q.id AS b, p.name FROM c p JOIN ok ON ok.x = p.name JOIN c q ON q.name = ok.y WHERE p.id <> q.id), m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS met FROM hit GROUP BY 1, 2)
SELECT m.a, m.b, x.n AS n_a, y.n AS n_b, round(met / (len(x.cols) + len(y.cols))::DOUBLE, 6) AS rate FROM m JOIN k x ON x.id = m.a JOIN k y ON y.id = m.b WHERE met / (len(x.cols) + len(y.cols))::DOUBLE > 0.8"""


def ragged_json(spark, d):
    """Properties of events whose value is now a number, now a text, a list, an object, missing or no JSON at all."""
    e, k = A.table(spark, d, "events"), F.get_json_object("props", "$.k")
    shapes = ["{\"k\": %s}", "{\"k\": \"%s\"}", "{\"k\": [%s, \"x\", null]}", "{\"k\": {\"v\": %s}}", "{\"j\": %s}", "{\"k\": %s", "[%s]"]
    text = F.element_at(F.array(*[F.format_string(s, k) for s in shapes]), (F.col("event_id") % len(shapes) + 1).cast("int"))
    some = lambda path: F.array_join(X.ragged_list(text, path), "|", "~")
    return e.select("event_id", some("$.k").alias("k"), some("$.k.v").alias("v"), some("$[0]").alias("first"))


RAGGED_JSON = """WITH e AS (SELECT event_id, event_id % 7 AS s, props->>'k' AS k FROM events)
SELECT event_id, CASE WHEN s IN (0, 1) THEN k WHEN s = 2 THEN k || '|x|~' WHEN s = 3 THEN '{"v":' || k || '}' ELSE '' END AS k, CASE WHEN s = 3 THEN k ELSE '' END AS v, CASE WHEN s = 6 THEN k ELSE '' END AS first FROM e"""


def shared_metrics(spark, d):
    return L.shared_in_graph(_graph(spark, d)[1].filter("kind = 'shows'"))


_REACH = f"WITH {_GRAPH}, e AS (SELECT src, dst FROM edges WHERE kind <> 'reads') SELECT src, dst, min(depth) AS depth FROM (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT x.src, y.dst, 2 FROM e x JOIN e y ON x.dst = y.src) GROUP BY 1, 2"


def change_detect(spark, d):
    """Layers whose items differ if every tenth report loses its metrics of one name."""
    i = A.items(spark, d)
    return T.detect_changes(K.fingerprints(i), K.fingerprints(i.filter("not (report_id % 10 = 0 and item like 'red widget%')")))


_NEW = "SELECT * FROM items WHERE NOT (report_id % 10 = 0 AND item like 'red widget%')"
CHANGES = A.with_views(
    f"""WITH o AS (SELECT report_id, layer, string_agg(item, '|' ORDER BY item) AS h FROM items GROUP BY ALL), n AS (SELECT report_id, layer, string_agg(item, '|' ORDER BY item) AS h FROM ({_NEW}) GROUP BY ALL)
    SELECT report_id, layer, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (report_id, layer) WHERE o.h IS DISTINCT FROM n.h""",
    "items",
)


def incremental_pairs(spark, d):
    """Pair scores after the same change and the loss of some reports, from the scores of before; equals a full run on what is left.

    Only pairs with a changed side are scored: changed reports meet the rest of their block.
    """
    i = A.items(spark, d).filter("layer = 'kpi'")
    reports = A.reports(spark, d)
    before = S.score_columns(S.block_counts(reports, i, BLOCK, ["kpi"]), ["kpi"]).filter("kpi >= 0.05").select("a", "b", F.col("kpi").alias("score"))
    touched = i.filter("report_id % 10 = 0 and item like 'red widget%'").select("report_id").distinct()
    deleted = reports.filter("report_id % 25 = 3").select("report_id")
    left, new = reports.join(deleted, "report_id", "left_anti"), i.filter("not (report_id % 10 = 0 and item like 'red widget%')")

    def score(ids):
        mine, all_ = (df.select("report_id", *BLOCK) for df in (left.join(ids, "report_id", "left_semi"), left))
        met = mine.join(all_.withColumnRenamed("report_id", "other"), BLOCK).filter("report_id <> other")
        pairs = met.select(F.least("report_id", "other").alias("a"), F.greatest("report_id", "other").alias("b")).distinct()
        return S.score_columns(S.pair_counts(pairs, new, ["kpi"]), ["kpi"]).filter("kpi >= 0.05").select("a", "b", F.col("kpi").alias("score"))

    return T.incremental_update(before, new, touched, deleted, score)


INCREMENTAL = A.with_views(
    f"""WITH i AS (SELECT * FROM ({_NEW}) WHERE layer = 'kpi'), n AS (SELECT report_id, count(*) AS n FROM i GROUP BY 1), r AS (SELECT * FROM reports WHERE report_id % 25 <> 3), p AS (SELECT x.report_id AS a, y.report_id AS b FROM r x JOIN r y ON x.workbook = y.workbook AND x.segment = y.segment AND x.report_id < y.report_id),
    m AS (SELECT a, b, count(*) AS met FROM p JOIN i x ON x.report_id = a JOIN i y ON y.report_id = b AND y.item = x.item GROUP BY ALL)
    SELECT a, b, met / (na.n + nb.n - met)::DOUBLE AS score FROM m JOIN n na ON na.report_id = a JOIN n nb ON nb.report_id = b WHERE met / (na.n + nb.n - met)::DOUBLE >= 0.05""",
    "reports",
    "items",
)


#: Pairs from here on are kept; clusters are of pairs from CLUSTERED on.
PAIR_KEPT, CLUSTERED = 0.05, 0.3


def block_scores(spark, d):
    """What scores the pairs of a block with a side in some reports, by their metrics' Jaccard likeness."""
    reports = A.reports(spark, d).select("report_id", *BLOCK)

    def score(ids, items):
        mine = reports.join(ids, "report_id", "left_semi")
        met = mine.join(reports.withColumnRenamed("report_id", "other"), BLOCK).filter("report_id <> other")
        pairs = met.select(F.least("report_id", "other").alias("a"), F.greatest("report_id", "other").alias("b")).distinct()
        scored = S.score_columns(S.pair_counts(pairs, items.withColumn("layer", F.lit("kpi")), ["kpi"]), ["kpi"])
        return scored.filter(F.col("kpi") >= PAIR_KEPT).select("a", "b", F.col("kpi").alias("score"))

    return score


def estate_stream(spark, d, files=3):
    """Orders as a stream of several batches, later orders later."""
    landing = T.shared_path(spark, "orders")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    o.repartitionByRange(files, "o_orderkey").write.parquet(landing)
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(landing)


def incremental_estate(spark, d):
    """Pairs and clusters after a stream of orders: each brings its report its lines' metrics, urgent open ones of every ninth report take the report away for good."""
    store = I.ClusterStore(spark, T.shared_path(spark, "estate"), block_scores(spark, d), CLUSTERED)
    lines = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(A.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("item")), F.col("l_partkey") == F.col("p_partkey"))

    def each(batch, number):
        base = batch.join(lines, batch["o_orderkey"] == lines["l_orderkey"])
        rest = F.col("o_custkey") % 20
        copied = (rest == 0) | ((rest == 5) & (F.col("l_partkey") % 7 != 0)) | ((rest == 10) & (F.col("l_partkey") % 3 != 0))
        added = base.select(F.explode(F.when(copied, F.array(F.col("o_custkey"), F.col("o_custkey") + A.SHIFT)).otherwise(F.array("o_custkey"))).alias("report_id"), "item")
        gone = batch.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_custkey % 9 = 0").select(F.col("o_custkey").alias("report_id"))
        store.apply(number, added, gone)

    T.run_to_end(estate_stream(spark, d), each, T.shared_path(spark, "estate-log"))
    pairs = store.pairs().select(F.lit("pair").alias("kind"), "a", "b", F.round("score", 6).alias("score"))
    return pairs.unionByName(store.clusters().select(F.lit("cluster").alias("kind"), F.col("node").alias("a"), F.col("root").alias("b"), F.lit(None).cast("double").alias("score")))


INCREMENTAL_ESTATE = A.with_views(
    f"""WITH away AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey % 9 = 0),
    i AS (SELECT report_id, item FROM items WHERE layer = 'kpi' AND report_id NOT IN (SELECT o_custkey FROM away)), n AS (SELECT report_id, count(*) AS n FROM i GROUP BY 1),
    p AS (SELECT x.report_id AS a, y.report_id AS b FROM reports x JOIN reports y ON x.workbook = y.workbook AND x.segment = y.segment AND x.report_id < y.report_id),
    m AS (SELECT a, b, count(*) AS met FROM p JOIN i x ON x.report_id = a JOIN i y ON y.report_id = b AND y.item = x.item GROUP BY ALL),
    s AS (SELECT a, b, met / (na.n + nb.n - met)::DOUBLE AS score FROM m JOIN n na ON na.report_id = a JOIN n nb ON nb.report_id = b WHERE met / (na.n + nb.n - met)::DOUBLE >= {PAIR_KEPT}),
    edges AS (SELECT a, b FROM s WHERE score >= {CLUSTERED} UNION SELECT b, a FROM s WHERE score >= {CLUSTERED}),
    reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen)
    SELECT 'pair' AS kind, a, b, round(score, 6) AS score FROM s UNION ALL SELECT 'cluster', node, min(seen), NULL FROM reach GROUP BY node""",
    "reports",
    "items",
).replace("WITH ", "WITH RECURSIVE ", 1)


def stream_latest(spark, d):
    """Latest action per mapping, from the events as a stream."""
    e = T.stream_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "reassign")
    a = e.select(F.col("user_id").alias("mapping_id"), F.col("event_id").alias("action_id"), "ts", kind.alias("action")).filter("action is not null")
    out = T.collect_updates(spark, T.latest_state(a), ["mapping_id"], "latest")
    return out.select("mapping_id", F.col("x.action").alias("action"), "n")


def stream_states(spark, d):
    """The same from a state of its own for each mapping; actions come out of order in several batches, and every third of them comes again."""
    e = A.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "reassign")
    a = e.select(F.col("user_id").cast("long").alias("mapping_id"), F.col("event_id").cast("long").alias("action_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("action")).filter("action is not null")
    again = F.explode(F.sequence(F.lit(0), (F.col("action_id") % 3 == 0).cast("int")))
    landing = T.shared_path(spark, "actions")
    a.withColumn("again", again).repartition(3, F.pmod(F.xxhash64("action_id", "again"), F.lit(3))).drop("again").write.parquet(landing)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    out = T.collect_updates(spark, T.action_states(stream), ["mapping_id"], "states")
    return out.select("mapping_id", "action_id", "action", "n")


def page_catalog(spark, d):
    """Pages streamed into a catalog; then every third comes again, with a heading more or, every ninth, with nothing in it."""
    p = A.table(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    landing, catalog, log = (T.shared_path(spark, n) for n in ("pages", "catalog", "catalog-log"))
    p.write.mode("append").parquet(landing)
    P.ingest_pages(spark, landing, catalog, log)
    changed = F.when(F.col("page_id") % 9 == 0, "").otherwise(F.concat("html", F.lit("<h2>Added</h2>")))
    p.filter("page_id % 3 = 0").withColumn("html", changed).write.mode("append").parquet(landing)
    P.ingest_pages(spark, landing, catalog, log)
    return P.read_catalog(spark, catalog)


PAGE_CATALOG = r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 3 = 0 THEN html || '<h2>Added</h2>' ELSE html END AS html FROM pages),
k AS (SELECT page_id, 'page' AS kind, [url] AS v FROM p UNION ALL SELECT page_id, 'title', regexp_extract_all(html, '(?is)<title>(.*?)</title>', 1)[:1] FROM p
  UNION ALL SELECT page_id, 'link', regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1) FROM p UNION ALL SELECT page_id, 'heading', regexp_extract_all(html, '(?is)<h[1-6]>(.*?)</h[1-6]>', 1) FROM p)
SELECT page_id, kind, (unnest(range(len(v))))::INT AS pos, unnest(v) AS value FROM k"""


def stream_windows(spark, d):
    """Events by day and kind, from the events as a stream."""
    e = T.stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.collect_updates(spark, T.progress_windows(e), ["w", "event_type"], "windows")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def bank_bootstrap(spark, d):
    """A bank from the names that mentions use: one canonical name each, with its spellings as aliases."""
    m = A.mentions(spark, d).select(X.normalize_metric_name(F.col("raw")).alias("name"), "raw", "subdomain")
    return m.groupBy(F.lower("name").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_set("raw")), ";").alias("aliases"), F.min("subdomain").alias("scope"))


def table_join_edges(spark, d):
    """Pairs of part types that one order line joins to another, by order."""
    l = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()
    a, b = l.withColumnRenamed("p_type", "a"), l.withColumnRenamed("p_type", "b")
    return a.join(b, "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("orders"))


def preview_rows(spark, d):
    """The first five rows of each event kind, as text."""
    e = A.table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    return e.withColumn("n", n).filter("n <= 5").select("event_type", "n", F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"))


def shelf_bindings(spark, d):
    """Measures on the shelves of a sheet for each part, whose brands are columns of a known table."""
    p = A.table(spark, d, "part")
    text = lambda form, *names: F.format_string(form, *[F.col(n) for n in names])
    instance = lambda derivation, ref: F.struct(F.lit(derivation).alias("derivation"), ref.alias("column"))
    sheets = p.select(
        F.col("p_partkey").alias("sheet_id"),
        text("sum:[%s] * Cnt: [%s]", "p_name", "p_brand").alias("columns"),
        text("yr:[ship] + avg:[avg:%s:qk] + SUM:[%s]", "p_name", "p_name").alias("rows"),
        F.array(instance("Avg", text("[src].[avg:%s:qk]", "p_name")), instance("None", F.lit("[x]")), instance("Cnt", text("[%s]", "p_type")), instance("CountD", text("[%s]", "p_brand"))).alias("instances"),
    )
    tables = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("table"))
    return C.shelf_bindings(sheets, tables)


SHELF_BINDINGS = """
WITH s AS (SELECT p_partkey AS id, p_name AS n, p_brand AS b, p_type AS t FROM part),
f AS (SELECT id, 0 AS pos, 'SUM' AS agg, n AS field FROM s UNION ALL SELECT id, 1, 'COUNT', b FROM s UNION ALL SELECT id, 2, 'AVG', n FROM s UNION ALL SELECT id, 3, 'SUM', n FROM s
  UNION ALL SELECT id, 4, 'AVG', n FROM s UNION ALL SELECT id, 5, 'COUNT', t FROM s UNION ALL SELECT id, 6, 'COUNTD', b FROM s),
c AS (SELECT p_brand AS name, min(p_type) AS tab FROM part GROUP BY 1)
SELECT id AS sheet_id, agg AS aggregation, coalesce(tab || '.', '') || field AS lineage, arg_min(field, pos) AS field, coalesce(arg_min(tab, pos), '') AS "table" FROM f LEFT JOIN c ON c.name = field GROUP BY 1, 2, 3"""


def usage_lookup(spark, d):
    """Usage of every customer by the sheet's exact name, else by letters and digits only, else by a name more than .85 alike, the first in the sheet; 365 days where none is."""
    k = F.col("c_custkey")
    c = A.table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.reverse(k.cast("string"))).alias("name"))
    spelled = F.when(k % 4 == 1, F.upper("name")).when(k % 4 == 2, F.concat(F.lit("* "), F.regexp_replace("name", " ", " - "))).otherwise(F.concat("name", F.lit("x")))
    sheet = c.filter("c_custkey % 4 <> 0").select(k.alias("row"), spelled.alias("key"), (k % 300).alias("days"))
    return C.lookup_usage(c, sheet)


USAGE_LOOKUP = """
WITH c AS (SELECT c_custkey, c_mktsegment || ' ' || reverse(c_custkey::VARCHAR) AS name FROM customer),
s AS (SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 1 THEN upper(name) WHEN 2 THEN '* ' || replace(name, ' ', ' - ') ELSE name || 'x' END AS key, c_custkey % 300 AS days FROM c WHERE c_custkey % 4 <> 0),
e AS (SELECT lower(key) AS k, arg_min(days, row) AS d FROM s GROUP BY 1), z AS (SELECT regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS k, arg_min(days, row) AS d FROM s GROUP BY 1),
f AS (SELECT c.c_custkey, e.d AS d1, z.d AS d2, lower(name) AS x FROM c LEFT JOIN e ON e.k = lower(name) LEFT JOIN z ON z.k = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')),
n AS (SELECT c_custkey, arg_min(s.days, s.row) AS d3 FROM f JOIN s ON f.d1 IS NULL AND f.d2 IS NULL AND (greatest(length(x), length(key)) - levenshtein(x, lower(key))) / greatest(length(x), length(key))::DOUBLE > 0.85 GROUP BY 1)
SELECT c_custkey, coalesce(d1, d2, d3, 365) AS days, CASE WHEN d1 IS NOT NULL THEN 'exact' WHEN d2 IS NOT NULL THEN 'letters' WHEN d3 IS NOT NULL THEN 'alike' ELSE 'none' END AS how FROM f LEFT JOIN n USING (c_custkey)"""


def summary_order(spark, d):
    """The first summary of each customer: orders with metrics first, then standard ones, then helpers."""
    o = A.table(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("5"), 2).otherwise(1)
    return A.latest(o, ["o_custkey"], rank, "o_orderkey").select("o_custkey", "o_orderkey", rank.alias("rank"))


QUERIES = {
    "lsh_candidates": (lsh_candidates, None),
    "simhash_near": (simhash_near, None),
    "trigram_block": (trigram_block, TRIGRAM),
    "fingerprints": (fingerprints, FINGERPRINTS),
    "signature_classes": (signature_classes, SIGNATURES),
    "mentions": (mentions_found, MENTIONS),
    "dedupe_mentions": (mentions_kept, KEPT),
    "switchers": (switchers, SWITCHERS),
    "lineage_nodes": (lineage_nodes, A.with_views(f"WITH {_GRAPH} SELECT * FROM nodes", "reports", "items")),
    "lineage_edges": (lineage_edges, A.with_views(f"WITH {_GRAPH} SELECT * FROM edges", "reports", "items")),
    "deep_lineage": (deep_lineage, A.with_views(_REACH, "reports", "items")),
    "calc_lineage": (calc_lineage, CALC_LINEAGE),
    "source_matches": (source_matches, SOURCE_MATCHES),
    "ragged_json": (ragged_json, RAGGED_JSON),
    "shared_metrics": (shared_metrics, A.with_views("SELECT 'kpi:' || item AS dst, count(DISTINCT report_id) AS n FROM items JOIN reports USING (report_id) WHERE layer = 'kpi' GROUP BY 1 HAVING count(DISTINCT report_id) > 1", "reports", "items")),
    "change_detect": (change_detect, CHANGES),
    "shelf_bindings": (shelf_bindings, SHELF_BINDINGS),
    "incremental_estate": (incremental_estate, INCREMENTAL_ESTATE),
    "incremental_pairs": (incremental_pairs, INCREMENTAL),
    "stream_latest": (stream_latest, A.with_views("SELECT mapping_id, arg_max(action, (ts, action_id)) AS action, count(*) AS n FROM actions GROUP BY 1", "actions")),
    "stream_states": (stream_states, A.with_views("SELECT mapping_id, arg_max(action_id, (ts, action_id)) AS action_id, arg_max(action, (ts, action_id)) AS action, count(*) AS n FROM actions GROUP BY 1", "actions")),
    "page_catalog": (page_catalog, PAGE_CATALOG),
    "stream_windows": (stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "bank_bootstrap": (
        bank_bootstrap,
        A.with_views(f"SELECT lower({NAME_SQL}) AS canonical, array_to_string(list_sort(list(DISTINCT raw)), ';') AS aliases, min(subdomain) AS scope FROM mentions GROUP BY 1", "mentions"),
    ),
    "table_join_edges": (
        table_join_edges,
        "WITH l AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.p_type AS a, y.p_type AS b, count(*) AS orders FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.p_type < y.p_type GROUP BY 1, 2",
    ),
    "preview_rows": (preview_rows, "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5"),
    "usage_lookup": (usage_lookup, USAGE_LOOKUP),
    "summary_order": (
        summary_order,
        "SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 1 END AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 1 END, o_orderkey) = 1",
    ),
}
