"""The k best of a bank for each query by cosine, exactly, through indexes whose lists have bounds and are left alone once they can't matter.

Sparse vectors: an inverted index. A list's bound is its greatest weight; a query reads its lists from the shortest on and ends when what
the unread ones can add at most is below its k-th best so far.
Dense vectors: cells around pivots. A cell's bound follows from the angles between query, pivot and the cell's members; each query reads the
nearest cells, and then those only that can hold something better than its k-th best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import materialize

#: Cosines are compared by six digits.
DIGITS = 6
SLACK = 1e-6


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(q, kth): the cosine at which k entries are reached, where they are."""
    upto = W.partitionBy("q").orderBy(F.desc("cosine")).rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= k).groupBy("q").agg(F.max("cosine").alias("kth"))


def topk_sparse(queries: DataFrame, bank: DataFrame, k: int, owners: DataFrame | None = None, holders: DataFrame | None = None, scored: list[int] | None = None) -> DataFrame:
    """(q, y, cosine) of the k best entries of each query, with all that tie with the k-th. queries(q, slot, w), bank(y, slot, w): unit vectors.

    With owners(q, own) and holders(y, scopes), y counts as one entry for each of its scopes but the query's own. Only what shares a slot is found.
    scored gets the number of pairs scored in each round.
    """
    lists = bank.groupBy("slot").agg(F.max(F.abs("w")).alias("top"), F.count("*").alias("long"))
    rest = F.sum(F.abs("w") * F.col("top")).over(W.partitionBy("q").orderBy("long", "slot").rowsBetween(1, W.unboundedFollowing))
    terms = queries.join(lists, "slot").withColumns({"at": F.row_number().over(W.partitionBy("q").orderBy("long", "slot")), "rest": F.coalesce(rest, F.lit(0.0))})
    vectors = terms.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "slot", "w", "rest"))).alias("terms"))
    vectors = vectors.join(owners, "q", "left") if owners is not None else vectors.withColumn("own", F.lit(None).cast("string"))
    open_ = materialize(vectors, "topk-open")
    docs = bank.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("vec"))
    entries = F.lit(1)
    if holders is not None:
        docs = docs.join(holders, "y")
        entries = F.size("scopes") - F.coalesce(F.array_contains("scopes", F.col("own")).cast("int"), F.lit(0))
    docs = materialize(docs, "topk-docs")
    found, lo, step = None, 0, 1
    while not open_.isEmpty():
        read = open_.select("q", F.explode(F.slice("terms", lo + 1, step)).alias("t")).select("q", F.col("t.slot").alias("slot"))
        met = read.join(bank.select("slot", "y"), "slot").select("q", "y").distinct()
        if found is not None:
            met = met.join(found.select("q", "y"), ["q", "y"], "left_anti")
        product = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.col("vec")[t["slot"]], F.lit(0.0)))
        new = met.join(open_, "q").join(docs, "y").select("q", "y", F.round(product, DIGITS).alias("cosine"), entries.alias("n"))
        new = materialize(new, "topk-scored")
        if scored is not None:
            scored.append(new.count())
        found = new.filter("n > 0") if found is None else found.unionByName(new.filter("n > 0"))
        lo, step = lo + step, 2 * step
        left = F.element_at("terms", F.least(F.size("terms"), F.lit(lo)))["rest"]
        open_ = open_.filter(F.size("terms") > lo).join(_kth(found, k), "q", "left").filter(F.col("kth").isNull() | (left + SLACK >= F.col("kth"))).drop("kth")
        open_ = materialize(open_, "topk-open")
    if found is None:
        return queries.select("q").limit(0).join(bank.select("y", F.lit(0.0).alias("cosine")).limit(0))
    return found.join(_kth(found, k), "q", "left").filter(F.col("kth").isNull() | (F.col("cosine") >= F.col("kth"))).select("q", "y", "cosine")


def unit(vec: Column) -> Column:
    """The vector in length one, as doubles; a zero vector stays."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the norm is bound to a variable: written into the inner function it would be computed for every element
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


_BLOCK = 4096  # queries that meet a list in one task


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, dims))


def _met(left: DataFrame, right: DataFrame, keys: list[str], schema: str, reduce) -> DataFrame:
    """reduce(left rows, right rows) for the rows of equal keys, the left ones in blocks, the right ones sent to each block."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    left = left.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.join(sizes, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left.groupBy(*keys, "block").cogroup(right.groupBy(*keys, "block")).applyInPandas(reduce, schema)


def _nearest_pivot(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(pivots):
        return pd.DataFrame({"id": [], "cell": [], "angle": []})
    products = _matrix(rows["vec"], 0) @ _matrix(pivots["vec"], 0).T
    best = products.argmax(1)
    angle = np.arccos(np.clip(products[np.arange(len(rows)), best], -1, 1))
    return pd.DataFrame({"id": rows["id"], "cell": pivots["cell"].to_numpy()[best], "angle": angle})


def _bounds(queries: pd.DataFrame, cells: pd.DataFrame) -> np.ndarray:
    """What the cosine of a query and a cell's member is at most. Zero vectors (cell -1 and queries of norm 0) have cosine 0."""
    q = _matrix(queries["vec"], 0)
    angle = np.arccos(np.clip(q @ _matrix(cells["vec"], 0).T, -1, 1))
    far = np.maximum(0, np.maximum(angle - cells["far"].to_numpy(), cells["near"].to_numpy() - angle))
    bound = np.cos(far)
    bound[:, cells["cell"].to_numpy() < 0] = 0
    bound[~q.any(1)] = 0
    return bound + SLACK


def topk_dense(m: DataFrame, bank: DataFrame, k: int, scored: list[int] | None = None) -> DataFrame:
    """(mention_id, kpi_id, sim, rank) within the scope. m: mention_id, scope, m_vec; bank: kpi_id, scope, b_vec.

    Vectors of different length have cosine 0, as zero vectors have with any. Equal cosines go by kpi_id. scored gets the numbers of pairs scored.
    """
    dims = lambda c: F.size(c).alias("dims")
    rows = materialize(bank.filter("scope is not null").select(F.col("kpi_id").alias("id"), "scope", dims("b_vec"), unit(F.col("b_vec")).alias("vec")), "topk-bank")
    asked = materialize(m.filter("scope is not null").select(F.col("mention_id").alias("id"), "scope", dims("m_vec"), unit(F.col("m_vec")).alias("vec")), "topk-asked")
    some = F.exists("vec", lambda x: x != 0)
    sized = rows.filter(some).groupBy("scope", "dims").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    pivots = rows.filter(some).join(sized, ["scope", "dims"]).filter((F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("n")).cast("long")) == 0) | (F.col("id") == F.col("least"))).select("scope", "dims", F.col("id").alias("cell"), "vec")
    pivots = materialize(pivots, "topk-pivots")
    placed = _met(rows.filter(some), pivots, ["scope", "dims"], "id long, cell long, angle double", _nearest_pivot)
    members = rows.join(placed, "id", "left").withColumn("cell", F.coalesce("cell", F.lit(-1).cast("long")))
    members = materialize(members, "topk-members")
    cells = members.groupBy("scope", "dims", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.min("vec").alias("any"))
    cells = materialize(cells.join(pivots, ["scope", "dims", "cell"], "left").withColumn("vec", F.coalesce("vec", "any")).drop("any"), "topk-cells")

    def first(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """The cells of greatest bounds, as many as hold k."""
        if not len(queries) or not len(cells):
            return pd.DataFrame({"id": [], "cell": []})
        order = np.argsort(-_bounds(queries, cells), 1, kind="stable")
        n = cells["n"].to_numpy()[order]
        take = np.cumsum(n, 1) - n < k
        return pd.DataFrame({"id": np.repeat(queries["id"].to_numpy(), take.sum(1)), "cell": cells["cell"].to_numpy()[order[take]]})

    def more(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """The cells whose bound isn't below the k-th best."""
        if not len(queries) or not len(cells):
            return pd.DataFrame({"id": [], "cell": []})
        q, c = np.nonzero(_bounds(queries, cells) >= queries["kth"].to_numpy()[:, None])
        return pd.DataFrame({"id": queries["id"].to_numpy()[q], "cell": cells["cell"].to_numpy()[c]})

    def best(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"mention_id": [], "kpi_id": [], "sim": []})
        ids = members["id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        sims = np.round(_matrix(queries["vec"], 0) @ _matrix(members["vec"], 0)[by_id].T, DIGITS) + 0.0
        top = np.argsort(-sims, 1, kind="stable")[:, :k]
        return pd.DataFrame({"mention_id": np.repeat(queries["id"].to_numpy(), top.shape[1]), "kpi_id": ids[by_id][top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()})

    def probed(chosen: DataFrame) -> DataFrame:
        ready = asked.join(chosen, "id")
        got = _met(ready, members, ["scope", "dims", "cell"], "mention_id long, kpi_id long, sim double", best)
        got = materialize(got, "topk-got")
        if scored is not None:
            scored.append(ready.join(cells.select("scope", "dims", "cell", "n"), ["scope", "dims", "cell"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        return got

    rank = F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("sim"), "kpi_id"))
    ask_first = materialize(_met(asked, cells, ["scope", "dims"], "id long, cell long", first), "topk-first")
    found = probed(ask_first)
    # vectors of other lengths have cosine 0: the k least ids among them
    least = rows.withColumn("place", F.row_number().over(W.partitionBy("scope", "dims").orderBy("id"))).filter(F.col("place") <= k).select("scope", "dims", F.col("id").alias("kpi_id"))
    others = asked.select("id", "scope", "dims").join(least.withColumnRenamed("dims", "other"), "scope").filter("dims <> other")
    others = others.select(F.col("id").alias("mention_id"), "kpi_id", F.lit(0.0).alias("sim"))
    kth = found.unionByName(others).withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("mention_id").alias("id"), F.col("sim").alias("kth"))
    waiting = asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    ask_more = _met(waiting, cells, ["scope", "dims"], "id long, cell long", more).join(ask_first, ["id", "cell"], "left_anti")
    every = found.unionByName(probed(materialize(ask_more, "topk-more"))).unionByName(others)
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)
