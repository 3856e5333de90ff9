"""Whole lineage graphs, the bank's update, lineage with tables and shared metrics, on small tables and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reportweave.functions import text as X
from reportweave.operators import catalog, estate_graph, lineage

SCHEMAS = [
    "workbook string, name string",
    "dashboard string, workbook string, name string",
    "sheet_id string, workbook string, dashboard string, name string, fields array<string>",
    "source string, workbook string, name string, caption string",
    "table_id string, source string, name string, columns array<string>",
    "source string, left_table string, right_table string, join_type string, left_column string, right_column string",
]
ESTATE = [
    [("1", "Sales"), ("2", "Empty"), (None, "nobody")],
    [("d1", "1", "North"), ("d2", "1", "South"), ("d9", "7", "of no workbook")],
    [("s1", "1", "d1", "Trend", ["b", "a", "b", "", None]), ("s2", "1", "d2", "Trend", ["c"]), ("s3", "1", "d1", "Once", None), ("s4", "1", None, "Lost", ["z"]), ("s5", "1", None, "Trend", ["y"]), ("s6", "1", "d2", "Late", []), ("s7", "1", "d2", "Late", ["q"])],
    [("x", "1", "fed.1", ""), ("y", "1", "fed.2", "Claims")],
    [("t1", "x", "orders", ["o"]), ("t0", "x", "orders", None), ("t2", "x", "lines", []), ("t3", "y", "lines", ["l"])],
    [("x", "orders", "lines", "left", "id", "oid"), ("x", "orders", "gone", "left", "id", "oid"), ("y", "orders", "lines", "left", "id", "oid"), ("x", "lines", "orders", None, "a", "b"), (None, "lines", "orders", "full", "a", "b")],
]


def frames(spark, rows=ESTATE, extra=False):
    out = [spark.createDataFrame(r, s) for r, s in zip(rows, SCHEMAS, strict=True)]
    return [df.withColumns({"owner": F.lit("?"), "id": F.lit("?"), "target": F.lit("?")}) for df in out] if extra else out


@pytest.mark.parametrize("extra", [False, True])
def test_workbook_graph(spark, extra):
    nodes, edges = estate_graph.workbook_graph(*frames(spark, extra=extra))
    got = {(r.owner, r.id): (r.label, r.type, r.columns) for r in nodes.collect()}
    assert nodes.count() == len(got)
    assert got["1", "ws_name_Trend"] == ("Trend", "Worksheet (Duplicate)", None)
    assert got["1", "ws_name_Once"][1] == got["1", "ws_name_Lost"][1] == "Worksheet"
    assert got["1", "ws_name_Late"][1] == "Worksheet (Duplicate)"
    assert got["1", "fields_ws_name_Trend"] == ("Fields Used", "Table", ["a", "b"])
    assert got["1", "fields_ws_name_Late"][2] == ["q"]
    assert ("1", "fields_ws_name_Lost") not in got and ("1", "fields_ws_name_Once") not in got
    assert (got["1", "ds_x"][0], got["1", "ds_y"][0]) == ("fed.1", "Claims")
    assert got["1", "tbl_t0"] == ("orders", "Table", [])
    assert {k for k in got if k[0] == "2"} == {("2", "workbook_2")}
    said = {(r.source, r.target, r.label) for r in edges.filter("owner = '1'").collect()}
    assert {s for s in said if s[2] == "CONTAINS (Orphan)"} == {("workbook_1", "ws_name_Lost", "CONTAINS (Orphan)"), ("workbook_1", "ws_name_Trend", "CONTAINS (Orphan)")}
    assert {s for s in said if "JOIN" in s[2]} == {("tbl_t0", "tbl_t2", "LEFT JOIN\nid = oid"), ("tbl_t2", "tbl_t0", "INNER JOIN\na = b")}
    assert ("dashboard_d1", "ws_name_Trend", "RENDERS") in said and ("workbook_1", "ds_y", "CONTAINS") in said
    ids = {r.id for r in edges.collect()}
    assert "e_join_tbl_t0__tbl_t2" in ids and "e_workbook_1__dashboard_d1" in ids


def test_views_add_up(spark):
    estate = frames(spark)
    count = lambda v: [df.count() for df in estate_graph.workbook_graph(*estate, view=v)]
    full, sheets, tables = count("full"), count("worksheets"), count("tables")
    assert full == [sheets[0] + tables[0] - 2, sheets[1] + tables[1]]


def test_dashboard_graph(spark):
    nodes, edges = estate_graph.dashboard_graph(*frames(spark))
    mine = lambda df, o: [r for r in df.collect() if r.owner == o]
    assert sorted(r.id for r in mine(nodes, "d1")) == ["dashboard_d1", "ds_x", "ds_y", "fields_s1", "tbl_t0", "tbl_t1", "tbl_t2", "tbl_t3", "workbook_1", "ws_s1", "ws_s3"]
    assert [r.id for r in mine(nodes, "d9")] == ["dashboard_d9"]
    assert mine(edges, "d9") == []
    said = {(r.source, r.target): r.label for r in mine(edges, "d2")}
    assert said["dashboard_d2", "ds_x"] == "USES" and said["workbook_1", "dashboard_d2"] == "CONTAINS" and said["ws_s7", "fields_s7"] == "USES FIELDS"
    assert ("ws_s6", "fields_s6") not in said


def test_graphs_of_nothing(spark):
    empty = frames(spark, [[] for _ in SCHEMAS])
    for graph in (estate_graph.workbook_graph, estate_graph.dashboard_graph):
        assert [df.count() for df in graph(*empty)] == [0, 0]


def import_by_hand(rows, bank, update):
    """Row after row: (name, scope) -> [value, outcome, n_updated], and the number of skipped rows."""
    out = {k: [v, "kept", 0] for k, v in bank.items()}
    seen, skipped = set(), 0
    for _, name, scope, value in sorted(rows):
        name, scope = (name or "").strip(" "), scope or ""
        if not name:
            continue
        key, low = (name, scope), (name.lower(), scope)
        if key in out or low in seen:
            if key in out and update:
                out[key] = [value, "updated" if out[key][1] in ("kept", "updated") else "inserted", out[key][2] + 1]
            else:
                skipped += 1
        else:
            out[key] = [value, "inserted", 0]
        seen.add(low)
    return {k: tuple(v) for k, v in out.items()}, skipped


@pytest.mark.parametrize("update", [False, True])
def test_bank_import_row_by_row(spark, update):
    draw = random.Random(5)
    rows = [(i, draw.choice(["Net", " net", "NET ", "Tax", "tax", "", None, "Fee"]), draw.choice(["a", "b", None]), draw.choice([None, f"v{i}"])) for i in range(60)]
    bank = {("Net", "a"): "old", ("tax", "b"): None, ("Rest", "a"): "old"}
    had = spark.createDataFrame([(*k, v) for k, v in bank.items()], "name string, scope string, definition string")
    got = catalog.upsert_bank(spark.createDataFrame(rows, "row_id int, name string, scope string, definition string"), had, ["definition"], update).collect()
    want, skipped = import_by_hand(rows, bank, update)
    assert {(r["name"], r["scope"]): (r["definition"], r["outcome"], r["n_updated"]) for r in got if r["outcome"] != "skipped"} == want
    assert sum(r["n_skipped"] for r in got) == skipped


def test_import_of_nothing(spark):
    none = spark.createDataFrame([], "row_id int, name string, scope string, definition string")
    assert catalog.upsert_bank(none, none.drop("row_id"), ["definition"], True).collect() == []


def test_lineage_with_tables(spark):
    calcs = spark.createDataFrame([(1, "[A] + [a] + [ B ]"), (2, None), (3, "1"), (4, "[C]/[A]")], "calc_id int, formula string")
    columns = spark.createDataFrame([("A", "t"), ("a", "s"), ("a", "r"), ("c", "u"), (None, "v")], "column string, table string")
    got = {r["calc_id"]: r["lineage"] for r in lineage.qualified_lineage(calcs, columns).collect()}
    assert got == {1: ["B", "r.a", "t.A"], 2: [], 3: [], 4: ["t.A", "u.C"]}


def test_shared_metrics(spark):
    cases = {"Avg. Claims by Region": "average.", "Avg Claims": "average", "No. of Oppty per State": "number of opportunity", "Rank of Total Sales level level": "total sales level", "total total": "total", "State  of   aging aging": "of aging", "Statement": "statement", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("y", X.shared_metric(F.col("x")))
    assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"], capture_output=True, text=True, timeout=60, cwd=__file__.rsplit("/", 2)[0])
    assert out.stdout.split() == ["True", "True"], out.stderr[-500:]
