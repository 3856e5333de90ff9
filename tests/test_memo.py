from pyspark.sql import functions as F

from reportweave.operators import matching as M


def bank_of(spark, rows):
    return spark.createDataFrame(rows, "kpi_id long, name string, agg string, aliases array<string>")


def test_the_version_of_a_bank_is_that_of_its_rows(spark):
    rows = [(1, "margin", "SUM", ["m"]), (2, "count", "COUNT", None)]
    version = M.bank_version(bank_of(spark, rows))
    assert version == M.bank_version(bank_of(spark, rows[::-1]))
    others = [rows[:1], rows + rows[:1], [(1, "margin", "AVG", ["m"]), rows[1]], [(1, "margin", "SUM", []), rows[1]], []]
    assert len({version, *(M.bank_version(bank_of(spark, o)) for o in others)}) == 6


def test_hits_are_gated_anew_and_rows_of_another_bank_count_as_wiped(spark):
    bank = bank_of(spark, [(1, "margin", "SUM", []), (2, "rate", "PCT", [])])
    now, before = M.bank_version(bank), M.bank_version(bank.filter("kpi_id = 1"))
    memo = spark.createDataFrame(
        [("a", now, 1, 1.0, 1.0, "exact name match"), ("b", before, 1, 1.0, 1.0, "exact name match"), ("c", now, 9, 1.0, 1.0, "exact name match"), ("d", now, 2, 1.0, 1.0, "exact name match")],
        "cache_key string, version string, kpi_id long, confidence double, similarity double, rationale string",
    )
    m = spark.createDataFrame(
        [(1, "a", "margin", "margin", "SUM"), (2, "a", "margin", "Rank | margin", "SUM"), (3, "b", "margin", "margin", "SUM"), (4, "c", "margin", "margin", "SUM"), (5, "d", "rows", "rows", "COUNT"), (6, None, "x", "x", "SUM")],
        "mention_id long, cache_key string, name string, raw string, agg string",
    )
    hits, misses = M.recalled(m, memo, bank, now)
    got = {r["mention_id"]: (r["kpi_id"], r["status"], r["confidence"], r["warning"]) for r in hits.collect()}
    assert got == {
        1: (1, "auto_accepted", 1.0, None),
        2: (1, "pending_review", 0.79, "derived helper"),
        4: (9, "pending_review", 0.79, "id not in slice"),
        5: (2, "not_found", 0.0, "aggregation mismatch"),
    }
    assert {r["mention_id"] for r in misses.select("mention_id").collect()} == {3, 6} and misses.filter(F.col("name").isNull()).count() == 0
