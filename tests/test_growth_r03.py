"""What round 3 found about growth: steps that Spark couldn't compile, or made several times over."""

import os

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reportweave.llm import minhash_dedup as M
from reportweave.llm.wordbytes import blocks
from reportweave.operators import sketches
from reportweave.plans import graph_queries

SMALL = "/root/testdata/sf0.001"



def test_min_hashes_are_compiled_and_the_same_as_with_all_in_one_row(spark):
    """F25"""
    items = spark.createDataFrame([(r, f"m{i}") for r in range(40) for i in range(r % 7, 25)] + [(40, None)], "report_id long, item string")
    block = items.select("report_id", F.lit("b").alias("block")).distinct()
    pairs = sketches.minhash_pairs(items, block)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sketches.minhash_pairs(items, block)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = [x for x in plan.split("\n") if "HashAggregate" in x]
    assert lines and all("*(" in x for x in lines)
    sig = items.groupBy("report_id").agg(*[F.min(F.xxhash64(F.lit(i), "item")).alias(f"h{i}") for i in range(256)])
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"h{b * 8 + r}" for r in range(8)]) for b in range(32)])
    a, b = (sig.select(F.col("report_id").alias(s), F.explode(keys).alias("key")) for s in "ab")
    wanted = {tuple(r) for r in a.join(b, "key").filter("a < b").select("a", "b").distinct().collect()}
    assert wanted and {tuple(r) for r in pairs.collect()} == wanted


def test_graphs_read_lines_once_and_are_those_of_the_sql_with_repeated_lines(spark, tmp_path):
    """F27"""
    for name in os.listdir(SMALL):
        os.symlink(f"{SMALL}/{name}", tmp_path / name) if name != "lineitem.parquet" else None
    odd = "SELECT * FROM t UNION ALL SELECT * REPLACE (l_partkey // 2 AS l_partkey, 'X' AS l_returnflag) FROM t WHERE l_orderkey % 3 = 0"
    duckdb.sql(f"COPY (WITH t AS (FROM '{SMALL}/lineitem.parquet') {odd}) TO '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    for name in ("workbook_graph_nodes", "dashboard_graph_edges"):
        query, sql = graph_queries.QUERIES[name]
        got = query(spark, str(tmp_path))
        assert not any("lineitem" in x for x in got.inputFiles())
        show = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
        assert show(got.collect()) == show(con.sql(sql).select(", ".join(got.columns)).fetchall())


def test_samples_made_in_place_are_those_of_the_plain_formula():
    """op6, op10 and the pipeline's near copies: same shingles in the same order, same samples, whatever the length."""
    draw = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{x}" for x in draw.integers(0, 9, n)) for n in (0, 1, 4, 5, 7, 300, 2, 6000)] + [None, " a  b "])
    for b in blocks(texts):
        row, g, count = M.shingles(b)
        order = np.lexsort((g, row))
        assert (order == np.arange(len(g))).all() and count.min() >= 1
        r, c, beta = M._table(95)
        for i in np.unique(row):
            h, w = g[row == i], (count[row == i] * 1.03).astype(np.float32)
            cell = (h & np.uint64(M._DRAWS - 1)).astype(np.int64)
            t = np.floor(np.log(w)[:, None] / r[cell] + beta[cell])
            a = c[cell] - r[cell] * (t - beta[cell] + 1)
            at = a.argmin(0)
            assert (M.sample(h, w) == M.mix(h[at] ^ M.mix(t[at, np.arange(95)].astype(np.int64).view(np.uint64)))).all()
