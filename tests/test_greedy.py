"""Greedy overlap of pairs in groups."""

import random

import pytest
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import greedy, scoring, sketches
from reportweave.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("where", [True, False])
def test_totals_equal_a_sequential_pass(spark, monkeypatch, where):
    rng = random.Random(3)
    monkeypatch.setattr(greedy, "GROUP", 7)
    monkeypatch.setattr(greedy, "CHUNK", 3)
    items = {k: f"i{rng.randrange(10**6)}" for k in rng.sample(range(-99, 99), 30)}
    edges = {(x, y): (rng.choice([1.0, 0.8]), rng.choice([0.5, 0.9])) for x in items for y in rng.sample(list(items), 5)}
    sets = {f"r{i}": rng.sample(list(items), rng.randrange(1, 12)) for i in range(9)} | {"r9": []}
    names = [*sets, "unknown"]
    pairs = [(a, b, "x" if a < "r5" else "y") for a in names for b in names if a < b]

    def total(a, b):
        left, right, out = set(), set(), 0.0
        for worth, near, l, r, x, y in sorted((-w, -n, items[x], items[y], x, y) for (x, y), (w, n) in edges.items() if x in sets.get(a, []) and y in sets.get(b, [])):
            if x not in left and y not in right:
                left, right, out = left | {x}, right | {y}, out - worth
        return out

    df = spark.createDataFrame(pairs, "a string, b string, where string")
    got = greedy.greedy_totals(
        greedy.in_groups(df if where else df.drop("where")),
        spark.createDataFrame([(r, k) for r, k in sets.items()], "report_id string, kinds array<long>"),
        spark.createDataFrame(list(items.items()), "kind long, item string"),
        spark.createDataFrame([(x, y, *v) for (x, y), v in edges.items()], "x long, y long, score double, near double"),
    )
    want = sorted((a, b, round(total(a, b), 6), len(sets.get(a, [])), len(sets.get(b, []))) for a, b, _ in pairs)
    assert sorted((a, b, round(t, 6), n, m) for a, b, t, n, m in got.collect()) == want


def test_sets_of_reports_are_never_broadcast(spark, monkeypatch):
    """F1 and others: Spark broadcast reports' sets by their compressed size, which took the driver's memory."""
    monkeypatch.setattr(greedy, "BROADCAST", 0, raising=False)
    rows = [(r, f"metric {i}", "", "", None) for r in range(6) for i in range(r, r + 4)]
    kpis = spark.createDataFrame(rows, "report_id long, item string, base string, canonical string, definition string")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "a long, b long")
    out = scoring.kpi_overlap(pairs, kpis, X.lev_ratio)
    assert "Broadcast" not in plan(out) and out.count() == 15


def test_lines_meet_orders_and_parts_without_a_broadcast(spark):
    """F2 and others: orders' keys are small as Parquet, but at 0.1 GB they were a relation of 41 MB in the driver's memory."""
    assert "Broadcast" not in plan(adapters.facts(spark, "/root/testdata/sf0.001"))


def test_sheets_equal_the_scores_of_all_combinations(spark, monkeypatch):
    """and no sets of sheets are broadcast."""
    monkeypatch.setattr(greedy, "BROADCAST", 0, raising=False)
    rng = random.Random(5)
    names = ["Lapse by State", "Lapse per Region", "Lapse", "Premium", "premium", "Total Premium", "Premiums", "Invoices by month", "Invoice by month"]
    axes = ["state", "states", "month", "agent name", "agent names", "zip"]
    rows = [(r, n, rng.sample(axes, rng.randrange(4))) for r in range(8) for n in rng.sample(names, rng.randrange(1, 7))]
    sheets = spark.createDataFrame(rows, "report_id long, sheet string, axes array<string>")
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(9) if a < b], "a long, b long")
    x, y = sheets.toDF("a", "l", "v"), sheets.toDF("b", "r", "w")
    every = x.crossJoin(y).filter("a < b").withColumn("s", scoring.worksheet_score(F.col("l"), F.col("r"), F.col("v"), F.col("w"), X.lev_ratio)).filter("s.score > 0")
    edge = F.when(F.col("s.exact"), F.struct(F.lit(-1.0).alias("worse"), (-F.col("s.score")).alias("farther"), "l", "r"))
    folded = every.groupBy("a", "b").agg(F.count_if("s.exact"), F.count_if(~F.col("s.exact")), F.round(F.max("s.score"), 6), F.coalesce(scoring.assigned(F.collect_list(edge)), F.lit(0.0)).cast("int"))
    got = scoring.sheet_matches(pairs, sheets, X.lev_ratio)
    assert "BroadcastHashJoin" not in plan(scoring.duplicate_reports(pairs, sheets, spark.createDataFrame([(1, 3)], "report_id long, days_ago int"), None, X.lev_ratio))
    want = sorted(map(tuple, folded.collect()))
    assert len(want) > 20 and sorted((r["a"], r["b"], r["exact"], r["grain"], round(r["best"], 6), r["matched"]) for r in got.collect()) == want


def test_bands_are_never_broadcast(spark):
    """F8: Spark takes bands and their flips for no larger than the hashes that they are made of, and broadcast them."""
    hashes = spark.createDataFrame([(i, [i, 2 * i, 3 * i, 0]) for i in range(4)], "id long, words array<long>")
    assert "BroadcastHashJoin" not in plan(sketches.simhash_all(hashes))


def test_items_are_shuffled_by_report_once(spark):
    """F35 and others: being distinct was a shuffle of its own, of five rows a line."""
    from reportweave.operators.sketches import fingerprints
    from reportweave.sources import adapters as A

    said = plan(fingerprints(A.items(spark, "/root/testdata/sf0.001")))
    assert said.count("Exchange hashpartitioning(report_id") == 1 and "hashpartitioning(layer" not in said


def test_counts_of_layers_equal_sets_and_are_one_function(spark):
    """F39, F28, F32, F37: five intersections of texts written out made a method that the JVM doesn't compile."""
    rows = [(r, layer, None if i == 9 else f"{layer}{i}") for r in range(6) for layer in ("kpi", "model") for i in range(r, 2 * r + 3) for _ in range(2)]
    items = spark.createDataFrame([(layer, r, item) for r, layer, item in rows] + [("other", 0, "x")], "layer string, report_id long, item string")
    reports = spark.createDataFrame([(r, r % 2) for r in range(8)], "report_id long, book long")
    out = scoring.block_counts(reports, items, ["book"], ["kpi", "model"])
    has = lambda r, layer: {i for q, x, i in rows if (q, x) == (r, layer) and i}
    want = sorted((x, a, b, len(has(a, x) & has(b, x)), len(has(a, x)), len(has(b, x))) for x in ("kpi", "model") for a in range(8) for b in range(a + 2, 8, 2))
    assert sorted(map(tuple, scoring.by_layer(out).collect())) == want
    given = out.select("a", "b")
    assert sorted(map(tuple, scoring.by_layer(scoring.pair_counts(given, items, ["kpi", "model"])).collect())) == want
    assert plan(out).count("array_intersect") == 1


def test_gaps_are_taken_from_a_row_of_each_report(spark):
    """all items of all reports were shuffled by item, for the few that are in a subset pair."""
    rows = [("kpi", 1, "a"), ("kpi", 1, "b"), ("model", 1, "a"), ("model", 1, None), ("kpi", 2, "a"), ("model", 2, None), ("kpi", 3, "z")]
    items = spark.createDataFrame(rows, "layer string, report_id long, item string")
    pairs = spark.createDataFrame([(1, 2), (1, 4), (4, 1)], "superset long, golden long")
    got = sorted(map(repr, map(tuple, scoring.missing_items(pairs, items).collect())))
    want = [(1, 2, "kpi", "b"), (1, 2, "model", "a"), (1, 2, "model", None), *[(1, 4, layer, item) for layer, r, item in rows if r == 1]]
    assert got == sorted(map(repr, want))


def test_items_of_wanted_reports_only(spark):
    d = "/root/testdata/sf0.001"
    some = spark.createDataFrame([(20,), (20 + adapters.SHIFT,), (25,)], "report_id long")
    got = {tuple(r) for r in adapters.items(spark, d, some).collect()}
    assert got == {tuple(r) for r in adapters.items(spark, d).filter(f"report_id in (20, 25, {20 + adapters.SHIFT})").collect()} and got
