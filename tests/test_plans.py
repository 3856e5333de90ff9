"""What the plans of queries over pairs hold: costly steps once, nothing that grows with the pairs broadcast."""

from reportweave.functions import text as X
from reportweave.operators import catalog
from reportweave.operators import matching as M
from reportweave.operators import scoring as S
from reportweave.plans import catalog_queries, more_queries, pair_queries
from reportweave.sources import adapters


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _scored(spark, rows):
    """Pairs whose scores come from a step in Python."""
    pairs = spark.createDataFrame(rows, "a long, b long, composite double")
    return pairs.mapInArrow(lambda batches: batches, pairs.schema)


def test_pairs_are_scored_once_for_both_directions(spark, monkeypatch):
    rows = [(1, 2, 0.9), (2, 3, 0.7), (4, 5, 0.1)]
    reports = spark.createDataFrame([(n,) for n in range(1, 7)], "report_id long")
    unique = S.uniqueness(_scored(spark, rows), reports)
    assert _plan(unique).count("MapInArrow") == 1
    assert sorted(map(tuple, unique.collect())) == [(1, 0.1), (2, 0.1), (3, 0.3), (4, 0.9), (5, 0.9), (6, 1.0)]
    monkeypatch.setattr(pair_queries, "_composite", lambda spark, d, whole=False: _scored(spark, rows))
    kept = pair_queries.persistable_pairs(spark, "")
    assert _plan(kept).count("MapInArrow") == 1
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 0.9), (2, 3, 0.7)]


def test_counts_of_pairs_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pair_queries, "_overlap", lambda spark, d, whole: spark.createDataFrame([(1, 2, 1.0, 2, 2)], "a long, b long, total double, n_a int, n_b int"))
    monkeypatch.setattr(pair_queries, "_counts", lambda spark, d, layers: spark.createDataFrame([(1, 2, 1)], "a long, b long, met int"))
    credit = catalog_queries.partial_credit(spark, "")
    assert "strategy=merge" in _plan(credit)
    assert [tuple(r) for r in credit.collect()] == [(1, 2, 0.333333)]


SF = "/root/testdata/sf0.001"


def test_lines_of_a_task_are_bounded(spark, monkeypatch):
    n = adapters.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(adapters, "LINES", n // 20)
    assert adapters.items(spark, SF).rdd.getNumPartitions() >= 20


def test_sheets_of_a_task_are_bounded(spark, monkeypatch):
    few = sorted(map(tuple, more_queries.shelf_bindings(spark, SF).collect()))
    monkeypatch.setattr(catalog, "SHEETS", 10)
    many = more_queries.shelf_bindings(spark, SF)
    assert many.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, many.collect())) == few


def test_few_names_are_cut_into_pieces_in_all_tasks(spark):
    a = spark.createDataFrame([("s", "order amount"), ("s", "order count"), ("t", "order amount")], "subdomain string, x string")
    near = M.near_names(a, a.withColumnRenamed("x", "y"), X.seq_ratio, 0.9, 2)
    assert _plan(near).count("Repartition 4, true") == 2  # of both sides, which AQE leaves alone
    assert "strategy=merge" in _plan(near)
    assert sorted((r.subdomain, r.x, r.y) for r in near.collect()) == [("s", "order amount", "order amount"), ("s", "order count", "order count"), ("t", "order amount", "order amount")]
