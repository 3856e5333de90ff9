"""Classes of near duplicates from hash buckets: star candidates, exact verification, union-find, and the rest exactly.

Nodes are longs. A round starts with buckets of nodes and compares each bucket's members with one central node
only, which is linear in the bucket. Central is who meets most others over all buckets: in a group of copies that is a copy
with few changes, to which most others are linked. A link between two others, x and y, can still be missing where not both are
linked to the central node c. Buckets that hold several components then are finished exactly, without looking at their pairs:

* A bucket of at most SMALL members is compared pair by pair, a bounded number of pairs for each row.
* In a larger one each member is described by its difference from c, a signed weight for each shingle: D(x) = x - c. Likeness
  is weighted Jaccard, and J(x, y) >= t says |x - y| <= h(|x| + |y|) with h = (1 - t) / (1 + t). As |x - y| is
  |D(x)| + |D(y)| less twice what the differences have in common, x and y must have at least (e(x) + e(y)) / 2 in common, where
  e = |D| - h|x|. That is above zero if one of the two isn't linked to c. So a link needs a common difference: copies of
  one text that were each changed elsewhere are far from meeting again, however many they are. Differences that only one
  component has are dropped, the others of a member put in order, rare ones first; with w the first that x and y share, what
  they have in common lies in w and what follows it. A member whose rest is too light for any partner under w, in
  another component than c's if it is in c's itself, leaves w's bucket. What stays are the buckets of the next round, with new central nodes.

So every pair of a bucket is linked, compared or ruled out by a bound that holds for certain. Were buckets left after MAX_ROUNDS,
their pairs of different components would be compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.operators.components import ordered_edges, star_roots
from reportweave.operators.durable import remove

from .common import materialize
from .wordbytes import mix

EPS = 1e-9
#: Up to so many members, a bucket's pairs are looked at one by one: of nodes, and of nodes with bounds of what they have in common.
SMALL, BOUNDED = 8, 512
MAX_ROUNDS = 12


def buckets_by_join(rows: DataFrame) -> DataFrame:
    """(key, node, n) of the buckets of rows(key, node) with n > 1 nodes. Counts are aggregated before the shuffle and
    joined back, so that a hot key may be split."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key").select("key", "node", "n")


def with_central(members: DataFrame, files: list[str] | None = None) -> DataFrame:
    """(key, node, n, rep) of members(key, node, n). A node's mass is the sum of n over its buckets.

    The rep of a bucket of at most SMALL nodes is its member of the greatest mass. In a larger one it is the node of the greatest mass among
    the reps that at least half of its members meet in any bucket: copies of one text fall into many buckets, but most of them meet the
    central copy somewhere, so that they are compared with that one and not with another in every bucket. Any of equals may be chosen.
    """
    mass = members.groupBy("node").agg(F.sum("n").alias("mass"))
    own = members.join(mass, "node").groupBy("key").agg(F.max_by("node", "mass").alias("rep"), F.max("mass").alias("mass"))
    inside = materialize(members.join(own, "key"), "near-inside", files)
    large = inside.filter(F.col("n") > SMALL).select("key", "node", "n")
    met = inside.select("node", F.col("rep").alias("far"), "mass").distinct()
    often = large.join(met, "node").groupBy("key", "far").agg((2 * F.count("*") >= F.first("n")).alias("often"), F.first("mass").alias("mass")).filter("often")
    wide = often.groupBy("key").agg(F.max_by("far", "mass").alias("far"))
    return inside.join(wide, "key", "left").select("key", "node", "n", F.coalesce("far", "rep").alias("rep"))


def split_by_difference(rows: DataFrame, features: Callable[[pa.Array], Iterable], threshold: float, files: list[str] | None = None) -> DataFrame:
    """(rep, node, root, own, rep_text, text) to smaller buckets (key, node, root, e, slack, n), see the module's text; own: the root is rep's.

    features gives each text's shingles: ascending hashes and their weights.
    """
    h = (1 - threshold + EPS) / (1 + threshold - EPS)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                some, edges, excess, last, central = [], [0], [], None, None
                reps, marks = part.column("rep").to_pylist(), part.column("rep_text")
                for i, (g, v) in enumerate(features(part.column("text"))):
                    if reps[i] != last:
                        last, central = reps[i], next(iter(features(marks.slice(i, 1))))
                    both = np.concatenate([g, central[0]])
                    signed = np.concatenate([v, -central[1]])
                    order = np.argsort(both, kind="stable")
                    both, signed = both[order], signed[order]
                    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
                    sums = np.add.reduceat(signed, new) if len(new) else np.zeros(0)
                    keep = np.abs(sums) > EPS
                    sums, ids = sums[keep], both[new[keep]]
                    salt = mix(np.array([reps[i]], np.int64).view(np.uint64))
                    some.append((mix(ids ^ salt) + (sums > 0), np.abs(sums)))
                    edges.append(edges[-1] + len(ids))
                    excess.append(float(np.abs(sums).sum() - h * v.sum()))
                token = np.concatenate([t for t, _ in some]).astype(np.uint64).view(np.int64)
                offsets = pa.array(edges, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (token, np.concatenate([w for _, w in some]))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", "node", "root", "own")], pa.array(excess, pa.float64()), *lists], names=["rep", "node", "root", "own", "e", "keys", "weights"])

    kind = "rep long, node long, root long, own boolean, e double, keys array<long>, weights array<double>"
    apart = materialize(rows.select("rep", "node", "root", "own", "rep_text", "text").mapInArrow(run, kind), "near-apart", files)
    names = ["rep", "node", "root", "own", "e"]
    flat = apart.select(*names, F.explode(F.arrays_zip("keys", "weights")).alias("x")).select(*names, F.col("x.keys").alias("key"), F.col("x.weights").alias("w"))
    common = flat.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("df")).filter("low != high").select("key", "df")
    order = W.partitionBy("rep", "node").orderBy(F.col("df").desc(), F.col("key").desc())
    # slack: twice the weight of this difference and the commoner ones, less e
    ranked = flat.join(common, "key").withColumn("slack", 2 * F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("e") + 1e-6)
    ranked = materialize(ranked.select("key", "node", "root", "own", "e", "slack"), "near-ranked", files)
    inner, outer = F.col("own"), ~F.col("own")
    bound = lambda f, c, where, name: f(F.when(where, F.col(c))).alias(name)
    limits = ranked.groupBy("key").agg(bound(F.min, "e", inner, "e_in"), bound(F.min, "e", outer, "e_out"), bound(F.max, "slack", inner, "slack_in"), bound(F.max, "slack", outer, "slack_out"))
    least, most = F.when(inner, F.col("e_out")).otherwise(F.least("e_in", "e_out")), F.when(inner, F.col("slack_out")).otherwise(F.greatest("slack_in", "slack_out"))
    near = ranked.join(limits, "key").filter((least <= F.col("slack")) & (F.col("e") <= most)).select("key", "node", "root", "e", "slack")
    mixed = near.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low != high").select("key", "n")
    return near.join(mixed, "key").select("key", "node", "root", "e", "slack", "n")


def _pairs_in(rows: DataFrame, *more: str) -> DataFrame:
    """(a, b, and more columns of both as a_ and b_) of the pairs of a bucket that are of different roots. rows: key, node, root."""
    x, y = (rows.select("key", F.col("node").alias(s), F.col("root").alias(f"{s}_root"), *[F.col(c).alias(f"{s}_{c}") for c in more]) for s in "ab")
    return x.join(y, "key").filter("a < b and a_root != b_root")


def near_classes(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], features: Callable[[pa.Array], Iterable], threshold: float) -> DataFrame:
    """(node, root) of all nodes that are linked to another; root is one of the component's nodes.

    members: (key, node, n), longs, see buckets_by_join. fetch: (node) to (node, text). compare: (a, b, a_text, b_text) to
    (a, b, sim). features: see split_by_difference.
    """
    spark = members.sparkSession
    cut = lambda df: materialize(df, "near-edges")
    files, passed = [], []  # of this round, and what the next one reads of the one before
    members = materialize(members, "near-buckets", passed)
    texts = materialize(fetch(members.select("node").distinct()).select("node", "text"), "near-texts")
    roots = None

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked."""
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        return compare(pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text"))

    def placed(rows: DataFrame, by: str, name: str) -> DataFrame:
        """rows with the root of the column `by`."""
        if roots is None:
            return rows.withColumn(name, F.col(by))
        return rows.join(roots.select(F.col("node").alias(by), F.col("root").alias(name)), by, "left").withColumn(name, F.coalesce(name, by))

    def linked(links: DataFrame) -> DataFrame | None:
        """roots with links(a, b) added."""
        links = placed(placed(links, "a", "x"), "b", "y").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = cut(ordered_edges(links))
        if links.isEmpty():
            return roots
        joint = star_roots(links, cut)
        if roots is None:
            return cut(joint)
        moved = roots.join(joint.select(F.col("node").alias("root"), F.col("root").alias("joint")), "root", "left").select("node", F.coalesce("joint", "root").alias("root"))
        return cut(moved.unionByName(joint.join(roots.select("node"), "node", "left_anti")))

    near = F.col("sim") >= threshold - EPS
    mixed = lambda df: df.join(df.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key"), "key", "left_semi")
    open_pairs = None
    for _ in range(MAX_ROUNDS):
        members = materialize(with_central(members, files), "near-members", files).filter("node != rep")
        star = members.select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
        if roots is not None:
            star = placed(placed(star, "a", "x"), "b", "y").filter("x != y").select("a", "b")
        sims = materialize(verify(star), "near-sims", files)
        found = sims.filter(near).select("a", "b")
        roots = linked(found if open_pairs is None else found.unionByName(open_pairs))
        remove(spark, passed)
        rest = materialize(mixed(placed(members, "node", "root")), "near-rest", files)
        few = rest.filter(F.col("n") <= SMALL).join(sims.select(F.col("a").alias("rep"), F.col("b").alias("node"), "sim"), ["rep", "node"], "left")
        close = F.coalesce(F.abs(F.col("a_sim") - F.col("b_sim")) <= 1 - threshold + EPS, F.lit(True))  # the triangle rule of the Jaccard distance
        pairs = _pairs_in(few, "sim").filter(close).select("a", "b")
        many = rest.filter(F.col("n") > SMALL).select("rep", "node", "root")
        split = None
        if not many.isEmpty():
            told = placed(many.distinct(), "rep", "rep_root").withColumn("own", F.col("root") == F.col("rep_root"))
            told = told.join(texts, "node").join(texts.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep")
            split = materialize(split_by_difference(told, features, threshold, files), "near-split", passed)
            bounded = _pairs_in(split.filter(F.col("n") <= BOUNDED), "e", "slack").filter("a_e <= b_slack and b_e <= a_slack")
            pairs = pairs.unionByName(bounded.select("a", "b"))
        open_pairs = materialize(verify(pairs.distinct()).filter(near).select("a", "b"), "near-pairs", passed)
        remove(spark, files)
        members = None if split is None else split.filter(F.col("n") > BOUNDED).select("key", "node", "n")
        if members is None or members.isEmpty():
            break
    else:
        rest = _pairs_in(placed(members, "node", "root")).select("a", "b").distinct()
        open_pairs = open_pairs.unionByName(verify(rest).filter(near).select("a", "b"))
    roots = linked(open_pairs)
    remove(spark, passed)
    if roots is None:
        return texts.select("node", F.col("node").alias("root")).limit(0)
    return roots
