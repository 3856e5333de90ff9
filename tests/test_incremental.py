"""Pairs and clusters kept batch by batch against a full run, with deletions, repeated batches, broken-off batches and compaction."""

import random

from pyspark.sql import functions as F

from reportweave.streaming.incremental import ClusterStore

KEPT, CLUSTERED = 0.2, 0.5


def score(ids, items):
    """Jaccard likeness over all reports."""
    n = items.groupBy("report_id").agg(F.count("*").alias("n"))
    x, y = items.join(ids, "report_id", "left_semi").withColumnRenamed("report_id", "x"), items.withColumnRenamed("report_id", "y")
    met = x.join(y, "item").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "item").distinct().groupBy("a", "b").agg(F.count("*").alias("met"))
    both = met.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    return both.select("a", "b", (F.col("met") / (F.col("n_a") + F.col("n_b") - F.col("met"))).alias("score")).filter(f"score >= {KEPT}")


def full(items):
    pairs = {(a, b): len(items[a] & items[b]) / len(items[a] | items[b]) for a in items for b in items if a < b}
    root = {}
    for a, b in (p for p, s in pairs.items() if s >= CLUSTERED):
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        for n in root:
            if root[n] in (x, y):
                root[n] = min(x, y)
    return {p: round(s, 6) for p, s in pairs.items() if s >= KEPT}, root


def now(store):
    return {(r["a"], r["b"]): round(r["score"], 6) for r in store.pairs().collect()}, {r["node"]: r["root"] for r in store.clusters().collect()}


def test_batches_equal_a_full_run(spark, tmp_path):
    rng = random.Random(8)
    store = ClusterStore(spark, f"file:{tmp_path}/estate", score, CLUSTERED)
    assert now(store) == ({}, {})
    items, dead = {}, set()
    kind = "report_id long, item string"
    for batch in range(5):
        added = [(r, f"{r // 4}-{rng.randrange(5)}") for r in (rng.randrange(24) for _ in range(50 if batch < 3 else 8))]
        added += [(r, f"{r // 8}-bridge{k}") for r in (3, 5, 11) for k in range(6)] if batch == 2 else []
        gone = rng.sample(range(24), 2) if batch else []
        add = spark.createDataFrame([*added, (None, "x"), (1, None)] if 1 not in dead else added, kind)
        go = spark.createDataFrame([(r,) for r in gone] + [(None,), (999,)], "report_id long")
        if batch == 3:  # an attempt that broke off half-way leaves its files, but no row in the ledger
            store._write(spark.createDataFrame([(0, "junk")], kind), store._folder("items", store.committed()[1], batch))
            store._write(spark.createDataFrame([(0, 1, 1.0)], "a long, b long, score double"), store._folder("pairs", store.committed()[1], batch))
        assert store.apply(batch, add, go)
        dead |= set(gone)
        for r, i in added:
            items.setdefault(r, set()).add(i)
        items = {r: i for r, i in items.items() if r not in dead}
        assert now(store) == full(items)
        if batch in (1, 4):
            assert not store.apply(batch, spark.createDataFrame([(0, "late")], kind), spark.createDataFrame([(r,) for r in items], "report_id long"))
            assert now(store) == full(items)
        if batch == 2:
            store.compacted()
            assert now(store) == full(items) and store.committed()[1] == 1
            assert not store.apply(0, add, go)
    assert now(ClusterStore(spark, f"file:{tmp_path}/estate", score, CLUSTERED)) == full(items)
