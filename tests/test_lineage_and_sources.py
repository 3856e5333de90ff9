import itertools
import random

import pytest
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import lineage, sketches


def reach(edges):
    out = {}
    for start in {a for a, _ in edges}:
        seen, front, depth = {}, {start}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - set(seen)
            seen.update(dict.fromkeys(front, depth))
        out.update({(start, b): n for b, n in seen.items()})
    return out


def test_lineage_goes_to_the_end_and_through_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    edges = chain + [("n0", "n5"), ("x", "y"), ("y", "x"), ("s", "s"), ("x", "n11"), ("x", "n11")]
    rows = spark.createDataFrame(edges + [("n3", None)], "src string, dst string")
    assert {(r["src"], r["dst"]): r["depth"] for r in lineage.deep_lineage(rows).collect()} == reach(set(edges))


def test_no_lineage(spark):
    assert lineage.deep_lineage(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_lineage_follows_wanted_sources_only(spark):
    """all was reached from everywhere and filtered afterwards."""
    edges = [("kpi:1", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("d", "b"), (None, "a"), ("kpi:2", "d"), ("kpi:1", "c")]
    some = lineage.deep_lineage(spark.createDataFrame(edges, "src string, dst string"), F.col("src").startswith("kpi:"))
    want = {p: n for p, n in reach({e for e in edges if e[0]}).items() if p[0].startswith("kpi:")}
    assert {(r["src"], r["dst"]): r["depth"] for r in some.collect()} == want


def test_lineage_broadcasts_no_edges(spark, monkeypatch):
    """edges are small as Parquet, but were a relation of 115 MB in each round on six times sf0.1."""
    hinted = []
    monkeypatch.setattr(lineage, "shuffled", lambda df: hinted.append(df.columns) or df.hint("merge"), raising=False)
    assert lineage.deep_lineage(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 3
    assert hinted == 2 * [["dst", "to"], ["src", "dst"]]


def test_a_reference_is_a_calculated_field_or_a_column(spark):
    calcs = spark.createDataFrame([("Net", "SUM([gross]) - [Tax] + [NET]"), ("Gross", None), ("gross", "[Price]")], "name string, formula string")
    got = {tuple(r) for r in lineage.calc_edges(calcs).collect()}
    assert got == {("calc:net", "calc:gross"), ("calc:net", "column:Tax"), ("calc:net", "calc:net"), ("calc:gross", "column:Price")}


def grams(name):
    p = f"  {name.lower()} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def alike(x, y):
    a, b = grams(x), grams(y)
    return x == y or round(len(a & b) / len(a | b), 6) > 0.6


def brute(sources):
    sets = {}
    for s, names in sources.items():
        names = frozenset(n.strip().lower() for n in names if n and n.strip())
        if names:
            sets.setdefault(names, []).append(s)
    out = {}
    for (x, i), (y, j) in itertools.combinations(sorted(((n, min(s)) for n, s in sets.items()), key=lambda z: z[1]), 2):
        met = sum(any(alike(a, b) for b in y) for a in x) + sum(any(alike(a, b) for a in x) for b in y)
        if met / (len(x) + len(y)) > 0.8:
            out[i, j] = met / (len(x) + len(y))
    return out, {m: min(s) for s in sets.values() for m in s}


def test_sources_match_as_by_brute_force_though_all_hold_one_column(spark):
    random.seed(4)
    words = ["customer", "customers", "customer_id", "amount", "amounts", "region", "regions", "order_date", "orderdate", "price", "sku", "warehouse", "warehouses"]
    sources = {i: ["id", *random.choices(words, k=random.randint(0, 7))] for i in range(80)}
    sources.update({100: [None, " "], 101: ["ID"], 102: ["id", "id "], 103: sources[0]})
    rows = spark.createDataFrame([(s, n) for s, names in sources.items() for n in names], "source long, column string")
    pairs, members = sketches.source_matches(rows)
    want, classes = brute(sources)
    got = {(r["a"], r["b"]): r["rate"] for r in pairs.collect()}
    assert got == pytest.approx(want) and want
    assert {r["source"]: r["class"] for r in members.collect()} == classes


def test_no_sources(spark):
    pairs, members = sketches.source_matches(spark.createDataFrame([], "source long, column string"))
    assert pairs.collect() == [] and members.collect() == []


@pytest.mark.parametrize(
    "text,path,want",
    [
        ('["a", 1, null, {"x": 2}]', "$", ["a", "1", None, '{"x":2}']),
        ('{"k": 7}', "$.k", ["7"]),
        ('{"k": true}', "$.k", ["true"]),
        ('{"k": []}', "$.k", []),
        ('{"k": null}', "$.k", []),
        ('{"j": 7}', "$.k", []),
        ('{"k": ', "$.k", []),
        ("", "$", []),
        (None, "$", []),
    ],
)
def test_json_of_any_shape_is_a_list(spark, text, path, want):
    row = spark.createDataFrame([(text,)], "c string").select(X.ragged_list(F.col("c"), path).alias("x")).first()
    assert row["x"] == want
