"""Unit and property tests of the report-estate operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import text as X
from reportweave.operators import review, scoring, sketches
from reportweave.operators.components import connected_components

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, name",
    [("Rank | Total Paid", "Total Paid"), ("Total Paid by Agent", "Total Paid"), ("Total Paid b", "Total Paid"), ("Top AGENT - Premium", "Premium"), ("Loss | Old", "Loss"), ("x | y (Table - z)", "x")],
)
def test_metric_names(spark, raw, name):
    assert one(spark, X.normalize_metric_name(F.lit(raw))) == name


@pytest.mark.parametrize("text, agg", [("AVG(IGO Aging)", "AVG"), ("total paid", "SUM"), ("number of claims", "COUNT"), ("", "UNKNOWN"), ("CountD([x])", "COUNTD"), ("plain", "UNKNOWN")])
def test_aggregates(spark, text, agg):
    assert one(spark, X.infer_agg(F.lit(text))) == agg


def test_jaccard(spark):
    a, b = F.array(*map(F.lit, ["k1", "k2", "k3"])), F.array(*map(F.lit, ["k2", "k3", "k4"]))
    none = F.array().cast("array<string>")
    assert one(spark, scoring.jaccard(a, b)) == 0.5
    assert one(spark, scoring.jaccard(none, none)) == 0.0
    assert one(spark, scoring.overlap_min(a, b)) == pytest.approx(2 / 3)


def test_unknown_aggregations_share_a_key(spark):
    key = lambda agg: one(spark, X.match_key(F.lit("a"), F.array(F.lit("l")), F.lit(agg), F.lit("s"), F.lit("d")))
    assert key("UNKNOWN") == key("none") == key("")
    assert key("SUM") != key("")


def test_reply(spark):
    r = one(spark, X.parse_reply(F.lit('text {"matched_kpi_id": "null", "confidence_score": 0.9} more')))
    assert r["matched_kpi_id"] is None and r["confidence_score"] == 0.79


def test_typo_is_fuzzy(spark):
    assert one(spark, X.seq_ratio(F.lit("total insurance policues"), F.lit("total insurance policies"))) > 0.85


def test_budget_conflict(spark):
    assert one(spark, R.semantic_conflict(F.lit("Budget"), F.lit("net sales"))) == R.BUDGET_REASON
    assert one(spark, R.semantic_conflict(F.lit("Budget"), F.lit("budget net sales"))) is None


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_assignment_equals_sequential(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(6), rng.randrange(6), rng.randrange(4) / 4) for g in range(5) for _ in range(14)]
    edges = list({e[:3]: e for e in edges}.values())
    want = set()
    for g in range(5):
        left, right = set(), set()
        for e in sorted((e for e in edges if e[0] == g), key=lambda e: (-e[3], e[1], e[2])):
            if e[1] not in left and e[2] not in right:
                want.add(e[:3])
                left.add(e[1])
                right.add(e[2])
    got = scoring.assign_greedy(spark.createDataFrame(edges, "grp long, l long, r long, score double"))
    assert {(r["grp"], r["l"], r["r"]) for r in got.collect()} == want


def test_review_actions_apply_in_order(spark):
    m = spark.createDataFrame([(1, "pending_review", "a"), (2, "not_found", None)], "mapping_id long, status string, canonical string")
    acts = spark.createDataFrame([(1, 1, 1, "reject", None), (1, 2, 2, "reassign", "b")], "mapping_id long, action_id long, ts long, action string, target string")
    after, audit = review.apply_actions(m, acts)
    assert {tuple(r) for r in after.collect()} == {(1, "human_accepted", "b"), (2, "not_found", None)}
    assert [(r["field"], r["old"], r["new"]) for r in audit.orderBy("action_id", "field").collect()] == [("status", "pending_review", "human_rejected"), ("canonical", "a", "b"), ("status", "human_rejected", "human_accepted")]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["report_overlap", "recommendations", "match_waterfall", "decisions", "lineage_edges", "clean_names", "incremental_pairs", "verdicts", "switchers", "dedupe_mentions"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events", "documents", "labels", "conversations", "embeddings", "pages", "supplier", "nation", "region", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)


def test_structural_layer_is_greedy_overlap(spark):
    kpi = "report_id long, item string, base string, canonical string, definition string"
    rows = [(1, "Paid Claims", "paid", "", None), (1, "Open Aging", "", "k7", None), (1, "Loss Ratioo", "", "", None), (1, "alpha", "", "", "sum of premium by month"), (1, "zzz", "", "", None)]
    rows += [(2, "Net Payments", "paid", "", None), (2, "Days Open", "", "k7", None), (2, "Loss Ratio", "", "", None), (2, "omega", "", "", "sum of premium by months")]
    rows += [(3, "Paid Claims", "paid", "", None)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in scoring.kpi_overlap(pairs, spark.createDataFrame(rows, kpi)).collect()}
    assert got == {(1, 2): round((1 + 1 + 0.8 + 0.8) / 4, 6), (1, 3): 1.0, (1, 4): 0.0}


def test_overlap_folds_as_assignment_does(spark):
    """A pair's fold takes the same edges as assign_greedy and a sequential pass."""
    rng = random.Random(8)
    rows = [(g, f"l{rng.randrange(6)}", f"r{rng.randrange(6)}", rng.choice([1.0, 0.8])) for g in range(6) for _ in range(16)]
    rows = list({r[:3]: r for r in rows}.values())
    edges = spark.createDataFrame(rows, "grp long, l string, r string, score double")
    edge = F.struct((-F.col("score")).alias("worse"), F.lit(0.0).alias("farther"), "l", "r")
    folded = {r["grp"]: round(r["total"], 6) for r in edges.groupBy("grp").agg(F.collect_list(edge).alias("e")).select("grp", scoring.assigned(F.col("e")).alias("total")).collect()}
    taken = {r["grp"]: round(r["total"], 6) for r in scoring.assign_greedy(edges).groupBy("grp").agg(F.sum("score").alias("total")).collect()}
    assert folded == taken


def test_worksheets(spark):
    none = F.array().cast("array<string>")

    def score(a, b, x=none, y=none):
        s = one(spark, scoring.worksheet_score(F.lit(a), F.lit(b), x, y, X.lev_ratio))
        return round(s["score"], 2), s["exact"]

    axes = lambda *names: F.array(*map(F.lit, names))
    assert score("Total Premium", "total premium (Table - x)") == (3.0, True)
    assert score("Premium", "Premium", axes("a", "b", "c"), axes("x", "y", "z")) == (0.0, False)
    assert score("Premium", "Premium", axes("state", "month", "agent"), axes("states", "months", "agents")) == (3.0, True)
    assert score("Lapse by State", "Lapse per Region")[1] is False and score("Lapse by State", "Lapse per Region")[0] > 1
    assert score("Lapse", "Invoices", none, none)[0] == 0.0


def test_duplicates_by_worksheets(spark):
    names = [f"sheet {w}" for w in ("alpha", "bravo", "carbon", "delta", "echo", "foxtrot", "golf")]
    rows = [(r, n, ["x"], 1) for r in (1, 2) for n in names] + [(3, n, ["x"], 1) for n in names[:4]] + [(4, n, ["x"], 1) for n in names]
    sheets = spark.createDataFrame(rows, "report_id long, sheet string, axes array<string>, block long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4)], "a long, b long")
    usage = spark.createDataFrame([(1, 10), (2, 10), (4, 5)], "report_id long, days_ago int")
    got = {tuple(r) for r in scoring.duplicate_reports(pairs, sheets, usage, ["block"], X.lev_ratio).collect()}
    assert got == {(2, 1, 7), (1, 4, 7), (2, 4, 7)}


def test_composite_takes_the_structural_layer(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    for twin, name in (("greedy_overlap", "score_details"), ("kpi_overlap", "score_details_whole")):
        layer = {(r["a"], r["b"]): r["score"] for r in q[twin](spark, SF).collect()}
        got = {(r["a"], r["b"]): r["score"] for r in q[name](spark, SF).filter("layer = 'structure'").collect()}
        assert got and all(abs(got[p] - layer[p]) < 1e-6 for p in got)


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows, flip = [], lambda h, n: h ^ sum(1 << i for i in rng.sample(range(256), n))
    for i in range(12):
        h = rng.getrandbits(256)
        rows += [(10 * i + j, flip(h, n)) for j, n in enumerate((0, 1, 14, 15, 29, 30))] + [(10 * i + 8, h), (10 * i + 9, h)]
    long = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, [long(h >> 64 * k & (1 << 64) - 1) for k in range(4)]) for i, h in rows], "id long, words array<long>")
    low = {}
    for i, h in sorted(rows):
        low.setdefault(h, i)
    want = {(low[h], i, 0) for i, h in rows if low[h] != i}
    want |= {(i, j, bin(g ^ h).count("1")) for g, i in low.items() for h, j in low.items() if i < j and bin(g ^ h).count("1") <= 29}
    got = [tuple(r) for r in sketches.simhash_all(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_meets_copies_of_other_sources(spark, tmp_path):
    import __spark_entry__

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a"), (2, text, "de", "b"), (3, text, None, None), (4, "quite another short text", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in __spark_entry__.queries()["simhash_near"](spark, str(tmp_path)).collect()} == {(1, 2, 0), (1, 3, 0)}


def test_typos_match_and_false_friends_pass_the_turn(spark):
    from reportweave.plans.match_queries import _fuzzy_waterfall

    m = "mention_id long, raw string, name string, sheet string, subdomain string, lineage array<string>, agg string"
    rows = [(1, "open policues", 0), (2, "premium totl", 0), (3, "Budget", 0), (4, "nothing alike", 0)]
    mentions = spark.createDataFrame([(i, raw, raw.lower(), "", "s", [], "NONE") for i, raw, _ in rows], m)
    bank = spark.createDataFrame([(10, "open policies", "s", [], [], "SUM"), (11, "written", "s", [], ["premium total"], "SUM"), (12, "net sales", "s", [], ["budget"], "SUM"), (13, "budget", "t", [], [], "SUM"), (14, "budgets", "s", [], [], "SUM")], "kpi_id long, name string, subdomain string, lineage array<string>, aliases array<string>, agg string")
    assert {tuple(r) for r in _fuzzy_waterfall(mentions, bank).collect()} == {(1, 10, "fuzzy"), (2, 11, "fuzzy"), (3, 14, "fuzzy")}
