"""Mentions that names, aliases and lineage leave open: the nearest bank rows by embeddings, a judge within its budget, embeddings beyond it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.functions import rules as R
from reportweave.functions import text as X
from reportweave.operators import matching as M
from reportweave.operators.durable import materialize

#: A function from (text) to (text, vec array<double>). It sees distinct texts only, none of them empty.
Embedder = Callable[[DataFrame], DataFrame]
#: A function from a pandas batch of (mention_id, request) to one of (mention_id, reply).
Judge = Callable

#: Without a judge's word, a likeness from here on names a candidate.
EMBEDDING_REVIEW = 0.7


def hash_embedder(texts: DataFrame) -> DataFrame:
    """The default embedder: hash embeddings as dense vectors; a text whose words cancel out has a zero vector."""
    slots = M.hash_embed(texts.withColumn("t", F.col("text")), "text", "t").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("ws"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(M.DIMS - 1)), lambda i: F.coalesce(F.col("ws")[i], F.lit(0.0)))
    return texts.join(slots, "text", "left").select("text", dense.alias("vec"))


def embedder_of(function: Callable, dims: int) -> Embedder:
    """An embedder of a function from a pandas series of texts to one of vectors, fed in Arrow batches. A vector of another length than dims is an error."""

    def vectors(texts: pd.Series) -> pd.Series:
        out = function(texts)
        if any(len(v) != dims for v in out):
            raise ValueError(f"the embedder gave vectors that aren't {dims} long")
        return out

    return lambda texts: texts.select("text", F.pandas_udf(vectors, "array<double>")("text").alias("vec"))


def with_vectors(rows: DataFrame, text: str, embedder: Embedder, memo: DataFrame | None = None, zero: int = M.DIMS) -> tuple[DataFrame, DataFrame]:
    """(rows with vec, additions to the memo). memo(text, vec) is looked up first; what it lacks is embedded once, however many rows have it.

    Null and blank texts have a zero vector. The additions are written, so that the embedder runs once.
    """
    asked = rows.select(F.col(text).alias("text")).filter("trim(text) <> ''").distinct()
    if memo is not None:
        asked = asked.join(memo.select("text"), "text", "left_anti")
    fresh = materialize(embedder(asked).select("text", "vec"), "vectors")
    known = fresh if memo is None else memo.select("text", "vec").unionByName(fresh)
    zeros = F.array_repeat(F.lit(0.0), zero)
    return rows.join(known.withColumnRenamed("text", text), text, "left").withColumn("vec", F.coalesce("vec", zeros)), fresh


def within_budget(rows: DataFrame, budget: int | None, *order: str, deal: int = 64) -> DataFrame:
    """rows with `within`: whether they are among the first `budget` by `order`, whose columns tell rows apart. None: all are.

    Every deal of rows names its own first ones, and among these the budget is ranked, so that no task sorts all rows.
    """
    if budget is None:
        return rows.withColumn("within", F.lit(True))
    first = rows.select(*order).withColumn("_deal", F.pmod(F.xxhash64(*order), F.lit(deal)))
    first = first.withColumn("_n", F.row_number().over(W.partitionBy("_deal").orderBy(*order))).filter(F.col("_n") <= budget)
    chosen = first.withColumn("_n", F.row_number().over(W.orderBy(*order))).filter(F.col("_n") <= budget).select(*order, F.lit(True).alias("within"))
    return rows.join(chosen, list(order), "left").withColumn("within", F.coalesce("within", F.lit(False)))


def no_judge(batch):
    """The default judge: nothing matches."""
    return batch[["mention_id"]].assign(reply='{"matched_kpi_id": null, "similarity_score": 0, "confidence_score": 0}')


def judged_matches(m: DataFrame, bank: DataFrame, near: DataFrame, judge: Judge = no_judge, budget: int | None = 200, semantic: Column | None = None, threshold: float = 0.95) -> DataFrame:
    """(mention_id, kpi_id, branch, similarity, confidence, status, warning): one row for each mention of m, whatever becomes of it.

    near(mention_id, kpi_id, sim, rank): candidates, best first. Branches, in order: `no_candidates`; `embedding`, where the vectors mean something
    (semantic, a condition on m) and the best one is `threshold` alike; `over_budget` beyond the first `budget` open mentions; `judge`; `judge_failed`, where no
    reply can be read. Where the embeddings decide instead of the judge, vectors without meaning have a confidence of .5 at most, a
    candidate is named from EMBEDDING_REVIEW on, and beyond the budget none is accepted without review. A rejection by the judge stands. All that is
    matched goes through the quality gates; an id that isn't among the candidates is left for review.
    """
    semantic = F.lit(False) if semantic is None else semantic
    best = near.filter("rank = 1").select("mention_id", F.col("kpi_id").alias("best"), "sim")
    equal = bank.select(F.col("kpi_id").alias("best"), F.array_sort("lineage").alias("_theirs"))
    base = m.withColumn("semantic", semantic).join(best, "mention_id", "left").join(equal, "best", "left")
    same = (F.size("lineage") > 0) & (F.array_sort("lineage") == F.col("_theirs"))
    e = M.embed_decision(F.col("sim"), F.coalesce(same, F.lit(False)), F.lit(False), F.col("semantic"), threshold)
    base = materialize(base.withColumn("e", e).drop("_theirs"), "judge-base")
    open_ = within_budget(base.filter(F.col("best").isNotNull() & ~F.col("e.accepted")).select("mention_id", "name"), budget, "mention_id")
    open_ = materialize(open_, "judge-open")
    requests = M.judge_requests(open_.filter("within").select("mention_id", "name"), near.join(bank.select("kpi_id", "name"), "kpi_id"), budget=0)
    replies = materialize(M.with_judge(requests, judge), "judge-replies")
    read = F.try_parse_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1)).isNotNull()
    answers = replies.filter(read).groupBy("mention_id").agg(F.min("reply").alias("reply"))  # a judge that answers twice
    rows = base.join(open_.select("mention_id", "within"), "mention_id", "left").join(answers, "mention_id", "left")
    rows = rows.withColumn("x", X.parse_reply(F.col("reply"), F.col("sim")))
    branch = (
        F.when(F.col("best").isNull(), "no_candidates")
        .when(F.col("e.accepted"), "embedding")
        .when(~F.col("within"), "over_budget")
        .when(F.col("reply").isNull(), "judge_failed")
        .otherwise("judge")
    )
    fallback = F.when(F.col("semantic"), F.col("sim")).otherwise(F.least("sim", F.lit(0.5)))
    conf = F.when(F.col("branch") == "embedding", F.col("e.confidence")).when(F.col("branch") == "judge", F.col("x.confidence_score")).otherwise(F.coalesce(fallback, F.lit(0.0)))
    likeness = F.coalesce(F.when(F.col("branch") == "judge", F.col("x.similarity_score")).otherwise(F.col("sim")), F.lit(0.0))
    rows = rows.withColumn("branch", branch).withColumns({"conf": conf, "likeness": likeness})
    kpi = F.when(F.col("branch") == "embedding", F.col("best")).when(F.col("branch") == "judge", F.col("x.matched_kpi_id").try_cast("long")).when(F.col("conf") >= EMBEDDING_REVIEW, F.col("best"))
    rows = rows.select("mention_id", "name", "raw", "agg", "branch", "conf", "likeness", kpi.alias("kpi_id"))
    known = near.select("mention_id", "kpi_id", F.lit(True).alias("asked"))
    theirs = bank.select("kpi_id", F.col("name").alias("b_name"), F.col("agg").alias("b_agg"))
    rows = rows.join(known, ["mention_id", "kpi_id"], "left").join(theirs, "kpi_id", "left")
    note = F.when(F.col("branch") == "judge", "llm judge").otherwise("embedding")
    g = R.quality_gates(F.col("name"), F.col("raw"), F.col("agg"), F.coalesce("b_agg", F.lit("")), F.concat_ws(" ", "raw", "name"), F.coalesce("b_name", F.lit("")), F.col("asked").isNotNull(), F.col("conf"), F.col("likeness"), note)
    none = F.struct(F.lit("not_found").alias("status"), F.col("conf").alias("confidence"), F.lit(None).cast("string").alias("warning"))
    rows = rows.withColumn("g", F.when(F.col("kpi_id").isNull(), none).otherwise(g))
    status = F.when((F.col("branch") == "over_budget") & (F.col("g.status") != "not_found"), "pending_review").otherwise(F.col("g.status"))
    review = (F.col("branch") == "over_budget") & F.col("kpi_id").isNotNull() & F.col("g.warning").isNull()
    return rows.select("mention_id", "kpi_id", "branch", F.round("likeness", 6).alias("similarity"), F.round("g.confidence", 6).alias("confidence"), F.when(review, "pending_review").otherwise(status).alias("status"), "g.warning")
