"""Tests of the catalog's operators, of names met through pieces, and of streams with late rows."""

import base64
import json
import random
import struct
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reportweave.functions import scope
from reportweave.functions import text as X
from reportweave.operators import catalog, matching
from reportweave.operators.components import connected_components
from reportweave.streaming import jobs


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("sides", [1, 2])
@pytest.mark.parametrize("least", [0.85, 0.7])
def test_names_through_pieces_equal_all_pairs(spark, sides, least):
    rng = random.Random(3)
    names = {"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 22))).strip() for _ in range(60)}
    for n in list(names):
        t = list(n)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        names.add("".join(t).strip())
    names = sorted(n for n in names if n)
    ratio = (lambda x, y: (max(len(x), len(y)) - lev(x, y)) / max(len(x), len(y))) if sides == 1 else (lambda x, y: SequenceMatcher(None, x, y).ratio())
    want = {(x, y) for x in names for y in names if ratio(x, y) >= least}
    df = spark.createDataFrame([("s", n) for n in names], "subdomain string, x string")
    got = matching.near_names(df, df.withColumnRenamed("x", "y"), X.lev_ratio if sides == 1 else X.seq_ratio, least, sides)
    assert {(r["x"], r["y"]) for r in got.collect()} == want and len(want) > len(names)


def test_scopes(spark):
    rows = [("insurance", "Claims & Litigation", None), ("Banking", "retail", None), ("banking", "UW", None), (None, None, "New Business Ops"), (None, "digital", None), ("x", "Service_&_Operations", "nothing"), (None, None, None)]
    df = spark.createDataFrame(rows, "sec string, sub string, dom string").select(scope.resolve_scope(F.col("sec"), F.col("sub"), F.col("dom")).alias("s"))
    assert [tuple(r["s"]) for r in df.collect()] == [
        ("insurance", "claims_litigation"), ("banking", "retail"), ("banking", "service_and_operations"), ("insurance", "underwriting"),
        ("insurance", "cx_and_digital"), ("insurance", "service_and_operations"), ("insurance", "service_and_operations"),
    ]
    lists = spark.createDataFrame([("x, uw; digital",), (None,), ("none of these",), ("retail | Marketing",)], "l string").select(scope.scope_from_list(F.col("l")))
    assert [r[0] for r in lists.collect()] == ["underwriting", "service_and_operations", "service_and_operations", "marketing"]


def test_seed_fills_an_empty_bank_only(spark, tmp_path):
    floats = [0.5, -1.25, 3.0]
    seed = [{"kpi_id": 1, "name": "Paid", "subdomain": "claims", "aliases": "a|b", "embedding": base64.b64encode(struct.pack("<3f", *floats)).decode()}, {"kpi_id": 2, "name": "Open", "subdomain": "claims", "aliases": '["c"]', "embedding": None}]
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    kind = "kpi_id long, name string, subdomain string, aliases array<string>, embedding array<float>"
    got = {r["kpi_id"]: r for r in catalog.load_seed(spark, str(tmp_path / "seed.json"), spark.createDataFrame([], kind)).collect()}
    assert got[1]["embedding"] == floats and got[1]["aliases"] == ["a", "b"] and got[2]["aliases"] == ["c"] and got[2]["embedding"] is None
    have = spark.createDataFrame([(9, "x", "y", [], [])], kind)
    assert [r["kpi_id"] for r in catalog.load_seed(spark, str(tmp_path / "seed.json"), have).collect()] == [9]


def test_density_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)], "a long, b long")
    got = {tuple(r) for r in catalog.density_clusters(edges, 2, connected_components).collect()}
    assert got == {(1, 1, "core"), (2, 1, "core"), (3, 1, "core"), (4, 1, "border"), (8, 8, "noise"), (9, 9, "noise")}


def test_labels_settle_on_communities(spark):
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    edges = spark.createDataFrame([*clique([1, 2, 3, 4]), *clique([5, 6, 7, 8]), (4, 5, 0.1)], "a long, b long, w double")
    got = {r["node"]: r["label"] for r in catalog.label_propagation(edges, 4).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and len({got[i] for i in (5, 6, 7, 8)}) == 1 and got[5] != 1


def test_missing_embeddings_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    bank = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", [1.0]), (4, " ", None)], "kpi_id long, text string, vec array<double>")

    def embedder(texts):
        def one(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(vec=[[float(len(t))] for t in b["text"]])

        return texts.mapInPandas(one, "text string, vec array<double>")

    got = {r["kpi_id"]: r["vec"] for r in matching.embed_missing(bank, embedder).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: [1.0], 4: None} and seen.value == 1


def test_a_judge_that_fails_leaves_replies_open(spark):
    requests = spark.createDataFrame([(1, "{}"), (2, "{}")], "mention_id long, request string").coalesce(1)

    def judge(batch):
        raise TimeoutError

    assert {tuple(r) for r in matching.with_judge(requests, judge).collect()} == {(1, None), (2, None)}


def test_sparse_and_dense_cosine_agree(spark):
    texts = spark.createDataFrame([(1, "total paid claims"), (2, "paid claims open"), (3, "unrelated words")], "key long, text string")
    e = matching.hash_embed(texts, "key", "text")
    sparse = {(r["a"], r["b"]): r["cosine"] for r in matching.cosine_sparse(e.withColumnRenamed("key", "a"), e.withColumnRenamed("key", "b"), "a", "b").collect()}
    dense = {}
    for r in e.collect():
        dense.setdefault(r["key"], [0.0] * matching.DIMS)[r["slot"]] = r["w"]
    df = spark.createDataFrame([(a, b, dense[a], dense[b]) for a in dense for b in dense], "a long, b long, x array<double>, y array<double>")
    for r in df.select("a", "b", matching.cosine(F.col("x"), F.col("y")).alias("c")).collect():
        assert abs(sparse.get((r["a"], r["b"]), 0.0) - r["c"]) < 1e-9


def test_late_rows_are_dropped(spark, tmp_path):
    """Three files, read one after the other: the second holds a row that is repeated, the third one that is a month late."""
    kind = "event_id long, ts timestamp, event_type string, value double"
    for n, rows in enumerate([[(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-02-20 10:00:00", "a", 2.0)], [(2, "2024-02-20 10:00:00", "a", 2.0), (4, "2024-02-21 10:00:00", "a", 8.0)], [(3, "2024-01-15 10:00:00", "a", 4.0), (5, "2024-03-30 00:00:00", "b", 1.0)]]):
        spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = jobs.collect_updates(spark, jobs.progress_windows(stream), ["w", "event_type"], "late")
    got = {(r["day"], r["event_type"]): (r["n"], r["total"]) for r in out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total").collect()}
    assert got == {("2024-01-01", "a"): (1, 1.0), ("2024-02-20", "a"): (1, 2.0), ("2024-02-21", "a"): (1, 8.0), ("2024-03-30", "b"): (1, 1.0)}
