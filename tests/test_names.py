"""Sheet names that meet through joins against all pairs of a block."""

import random

from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import scoring


def test_alike_names_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["sales", "premium", "claims", "loss", "ratio", "by", "state", "per", "year", "kpi", "net", "gross", "policy", "count"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)}
    names |= {n[:-1] + "x" for n in list(names)[:10]} | {n.upper() + " " for n in list(names)[:5]} | {"", "  ", "k", "kp", "sal", "claims-2", "by", "by state", "year per state", "zzzz"}
    rows = [(i, n, [], i % 2, "a") for i, n in enumerate(sorted(names))]
    sheets = spark.createDataFrame(rows, "report_id long, sheet string, axes array<string>, workbook long, segment string")
    none = F.array().cast("array<string>")
    x, y = sheets.select("workbook", F.col("sheet").alias("x")), sheets.select("workbook", F.col("sheet").alias("y"))
    score = scoring.worksheet_score(F.col("x"), F.col("y"), none, none, X.lev_ratio)
    want = {(str(r["workbook"]) + "|a", r["x"], r["y"]) for r in x.join(y, "workbook").filter(score["score"] > 0).collect()}
    got = {(r["where"], r["x"], r["y"]) for r in scoring.alike_names(sheets, ["workbook", "segment"], X.lev_ratio).collect()}
    assert not want - got, sorted(want - got)[:5]
    assert not got - want, sorted(got - want)[:5]


def test_names_that_share_nothing_never_meet(spark):
    names = [(f"{c * 6}{k}{c * 5}",) for k in range(4) for c in "abcdefgh"]
    table = spark.createDataFrame(names, "c string").select(F.lit("w").alias("where"), "c", F.array("c").alias("words"))
    met = scoring._overlapping(table, "words", lambda n: F.floor(n * 0.65) + 1).unionByName(scoring._containing(table))
    assert {(r["c"], r["d"]) for r in met.collect()} <= {(a, b) for (a,) in names for (b,) in names if a[0] == b[0]}


def test_a_seventh_layer(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0, 0.5, 30, 40), (1, 3, None, 0.2, 7, 7)], "a long, b long, kpi double, visual double, rows_a int, rows_b int")
    six = {(r["a"], r["b"]): r for r in scoring.composite(pairs).collect()}
    assert [six[1, b]["composite"] for b in (2, 3)] == [round(0.2 + 0.15 * 0.5, 6), round(0.15 * 0.2, 6)]
    layers = scoring.with_layer("size", 0.2, lambda p: F.least("rows_a", "rows_b") / F.greatest("rows_a", "rows_b"))
    assert abs(sum(x.weight for x in layers.values()) - 1) < 1e-9
    seven = {(r["a"], r["b"]): r for r in scoring.composite(pairs, layers).collect()}
    for b, size in ((2, 0.75), (3, 1.0)):
        assert seven[1, b]["size"] == size and abs(seven[1, b]["composite"] - (0.8 * six[1, b]["composite"] + 0.2 * size)) < 1e-6


def test_measures_on_shelves(spark):
    from reportweave.operators import catalog

    kind = "sheet_id long, columns string, rows string, instances array<struct<derivation:string,column:string>>"
    rows = [
        (1, "SUM:[Sales] sum: [ Sales ] mn:[Day]", "pct:[none:Rate:qk]x countd:[Id]", [("Sum", "[t].[sum:Sales:qk]"), ("User", "[a]"), (None, "[b]"), ("cnt", "[fed].[Id]"), ("Max", None)]),
        (2, None, "", None),
    ]
    got = catalog.shelf_bindings(spark.createDataFrame(rows, kind), spark.createDataFrame([("Id", "people"), ("Id2", "x")], "name string, table string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Id", "COUNT", "people", "people.Id"), (1, "Id", "COUNTD", "people", "people.Id"), (1, "Rate", "PCT", "", "Rate"), (1, "Sales", "SUM", "", "Sales")]
