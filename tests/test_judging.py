import pytest
from pyspark.sql import functions as F

from reportweave.operators import judging as J


def near_of(spark, rows):
    return spark.createDataFrame(rows, "mention_id long, kpi_id long, sim double, rank int")


@pytest.fixture
def tables(spark):
    """Six mentions (one without candidates, one whose name is empty) and a bank of two."""
    m = spark.createDataFrame([(i, f"margin {i}" if i < 5 else "", f"margin {i}", "SUM", ["t.c"] if i == 0 else []) for i in range(6)], "mention_id long, name string, raw string, agg string, lineage array<string>")
    bank = spark.createDataFrame([(7, "margin", "SUM", ["t.c"]), (8, "other", "SUM", [])], "kpi_id long, name string, agg string, lineage array<string>")
    near = near_of(spark, [(i, k, s, r) for i in (0, 1, 2, 3, 5) for r, (k, s) in enumerate([(7, 0.99), (8, 0.2)], 1)])
    return m, bank, near


def judged(*args, **more):
    return {r["mention_id"]: r for r in J.judged_matches(*args, **more).collect()}


def test_every_mention_has_one_row_and_its_branch(tables):
    got = judged(*tables, budget=2)
    assert {i: r["branch"] for i, r in got.items()} == {0: "judge", 1: "judge", 2: "over_budget", 3: "over_budget", 4: "no_candidates", 5: "over_budget"}
    # the default judge rejects, and vectors without meaning accept nothing
    assert all(r["kpi_id"] is None and r["status"] == "not_found" for r in got.values())


def test_vectors_with_meaning_accept_before_the_judge_is_asked(tables):
    asked = tables[0].sparkSession.sparkContext.accumulator(0)

    def judge(batch):
        asked.add(len(batch))
        return J.no_judge(batch)

    got = judged(*tables, judge=judge, semantic=F.col("mention_id") < 2, threshold=0.95)
    assert got[0]["branch"] == got[1]["branch"] == "embedding" and got[0]["kpi_id"] == 7
    assert got[0]["confidence"] == pytest.approx(0.95 * 0.99 + 0.02) and got[1]["confidence"] == pytest.approx(0.95 * 0.99)
    assert asked.value == 3


def test_beyond_the_budget_nothing_is_accepted_without_review(tables):
    got = judged(*tables, budget=0, semantic=F.lit(True), threshold=1.1)
    assert [(got[i]["kpi_id"], got[i]["status"]) for i in (0, 1, 2, 3)] == [(7, "pending_review")] * 4


def test_replies_that_cannot_be_read_go_to_the_embeddings(tables):
    def judge(batch):
        replies = {0: "no idea", 1: '{"matched_kpi_id": 7, "confidence_score": 0.99, "similarity_score": 0.99}', 2: '{"matched_kpi_id": 99, "confidence_score": 0.99}', 3: '{"matched_kpi_id": null, "confidence_score": 0.9}'}
        return batch[["mention_id"]].assign(reply=batch["mention_id"].map(replies))

    got = judged(*tables, judge=judge)
    assert (got[0]["branch"], got[0]["kpi_id"], got[0]["confidence"]) == ("judge_failed", None, 0.5)
    assert (got[1]["branch"], got[1]["kpi_id"], got[1]["status"]) == ("judge", 7, "auto_accepted")
    assert (got[2]["kpi_id"], got[2]["status"], got[2]["warning"]) == (99, "pending_review", "id not in slice")
    assert (got[3]["branch"], got[3]["kpi_id"], got[3]["confidence"]) == ("judge", None, 0.79)
    assert got[5]["branch"] == "judge_failed"


def test_a_judge_that_breaks_off_leaves_all_to_the_embeddings(tables):
    def judge(batch):
        raise TimeoutError

    got = judged(*tables, judge=judge)
    assert {r["branch"] for i, r in got.items() if i != 4} == {"judge_failed"}


def test_no_mentions(tables):
    m, bank, near = tables
    assert judged(m.limit(0), bank, near.limit(0)) == {}


@pytest.mark.parametrize("budget", [0, 1, 50, 1000, None])
def test_the_budget_is_that_of_one_sorted_list(spark, budget):
    rows = spark.range(300).select((F.col("id") * 37 % 1009).alias("k"))
    got = {r["k"] for r in J.within_budget(rows, budget, "k").filter("within").collect()}
    want = sorted(r["k"] for r in rows.collect())
    assert got == set(want if budget is None else want[:budget])


def test_texts_are_embedded_once_and_remembered(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None), (5, "bb"), (6, "known")], "id long, text string")
    memo = spark.createDataFrame([("known", [9.0])], "text string, vec array<double>")
    seen = spark.sparkContext.accumulator(0)

    def lengths(texts):
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    got, fresh = J.with_vectors(rows, "text", J.embedder_of(lengths, 1), memo, zero=1)
    assert {r["id"]: r["vec"] for r in got.collect()} == {1: [1.0], 2: [1.0], 3: [0.0], 4: [0.0], 5: [2.0], 6: [9.0]}
    assert got.count() == 6 and {r["text"] for r in fresh.collect()} == {"a", "bb"} and seen.value == 2


def test_an_embedder_of_another_length_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="aren't 2 long"):
        J.with_vectors(rows, "text", J.embedder_of(lambda t: t.map(lambda _: [1.0]), 2))


def test_hash_vectors_are_unit_or_zero(spark):
    texts = spark.createDataFrame([("net sales",), ("sales net",)], "text string")
    got = {r["text"]: r["vec"] for r in J.hash_embedder(texts).collect()}
    assert got["net sales"] == got["sales net"] and len(got["net sales"]) == 1536 and sum(v * v for v in got["net sales"]) == pytest.approx(1)
