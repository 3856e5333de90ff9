from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reportweave.streaming import catalog, jobs

START = datetime(2024, 1, 1)


def states(spark, batches, **more):
    """The states after these batches of (mapping, action, day, kind), each a file of its own."""
    schema = "mapping_id long, action_id long, ts timestamp, action string"
    landing, out, log = (jobs.shared_path(spark, n) for n in ("actions", "states", "states-log"))
    got = {}
    for rows in batches:
        spark.createDataFrame([(m, a, None if d is None else START + timedelta(days=d), k) for m, a, d, k in rows], schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        jobs.run_to_end(jobs.action_states(stream, **more), lambda batch, n: batch.withColumn("b", F.lit(n)).write.mode("append").parquet(out), log)
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r["b"]):
        got[r["mapping_id"]] = (r["ts"], r["action_id"], r["action"], r["n"])
    return got


def test_late_and_repeated_actions(spark):
    first = [(1, 10, 5, "accept"), (1, 10, 5, "accept"), (2, 20, 1, "reject"), (None, 9, 1, "accept"), (3, 31, None, "accept")]
    late = [(1, 11, 3, "reject"), (1, 10, 5, "accept"), (2, 21, 1, "accept")]
    assert states(spark, [first, late]) == {1: (START + timedelta(days=5), 10, "accept", 2), 2: (START + timedelta(days=1), 21, "accept", 2)}


def test_what_is_older_than_is_remembered_is_left_out(spark):
    got = states(spark, [[(1, 1, 0, "a"), (1, 2, 40, "b")], [(1, 1, 0, "a"), (1, 3, 1, "c"), (1, 4, 35, "d")]], remember=timedelta(days=10))
    assert got == {1: (START + timedelta(days=40), 2, "b", 3)}


@pytest.fixture
def pages(spark):
    rows = [(1, "u1", "<title>A</title><h1>x</h1><a href=\"l\">"), (2, None, None), (3, "u3", "<h2>y</h2><h2>y</h2>"), (None, "u", "<h1>z</h1>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def parts(spark, path):
    return sorted(tuple(r) for r in catalog.read_catalog(spark, path).filter("kind <> 'page'").collect())


def test_a_page_that_comes_again_replaces_its_own_parts_only(spark, pages):
    path = jobs.shared_path(spark, "catalog")
    catalog.replace_parts(pages, path, 2)
    before = [(1, "heading", 0, "x"), (1, "link", 0, "l"), (1, "title", 0, "A"), (3, "heading", 0, "y"), (3, "heading", 1, "y")]
    assert parts(spark, path) == before and catalog.read_catalog(spark, path).filter("kind = 'page'").count() == 3
    catalog.replace_parts(pages, path, 2)
    assert parts(spark, path) == before
    catalog.replace_parts(spark.createDataFrame([(3, "u3", "")], pages.schema), path, 2)
    assert parts(spark, path) == before[:3] and catalog.read_catalog(spark, path).count() == 6
    catalog.replace_parts(pages.limit(0), path, 2)
    assert parts(spark, path) == before[:3]


def test_a_folder_is_taken_in_once(spark, pages):
    landing, path, log = (jobs.shared_path(spark, n) for n in ("pages", "catalog", "log"))
    pages.write.mode("append").parquet(landing)
    catalog.ingest_pages(spark, landing, path, log, 3)
    one = parts(spark, path)
    catalog.ingest_pages(spark, landing, path, log, 3)
    assert parts(spark, path) == one
    pages.filter("page_id = 1").withColumn("html", F.lit("<h1>new</h1>")).unionByName(pages.filter("page_id = 1").withColumn("html", F.lit(None).cast("string"))).coalesce(1).write.mode("append").parquet(landing)
    catalog.ingest_pages(spark, landing, path, log, 3)
    assert parts(spark, path) == [(1, "heading", 0, "new")] + one[3:]
