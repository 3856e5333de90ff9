"""Near-duplicate classes against brute force over all pairs: dense groups near the threshold, in one bucket and through the bands."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportweave.llm import line_dedup, minhash_dedup, near


def copies(rng, base, n, low, high, words):
    """n copies of base, each with its own share of words replaced."""
    out = []
    for _ in range(n):
        t = list(base)
        for i in rng.sample(range(len(t)), rng.randint(low, high)):
            t[i] = rng.choice(words)
        out.append(t)
    return out


@pytest.fixture(scope="module")
def texts():
    """Copies of one text with changes of their own, linked to it or not; pairs among them that share their changes; a second version with
    copies of its own; chains; and unrelated texts."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(5000)]
    new = lambda n: [rng.choice(words) for _ in range(n)]
    base = new(200)
    out = [base, *copies(rng, base, 40, 1, 3, words), *copies(rng, base, 60, 4, 9, words)]
    twins = copies(rng, base, 10, 8, 10, words)
    out += [*twins, *[t[:-1] + ["end"] for t in twins]]
    second = base[:150] + new(50)
    out += [second, *copies(rng, second, 30, 1, 4, words)]
    step = base
    for _ in range(12):  # each is near the one before
        step = copies(rng, step, 1, 3, 3, words)[0]
        out.append(step)
    out += [new(200) for _ in range(20)]
    return [" ".join(t) for t in out]


def parts(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(i for i in range(n) if find(i) == r) for r in {find(i) for i in range(n)}}


def line_links(texts, at=0.8):
    sets = [line_dedup._set(t) for t in texts]
    return [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j])]


def classes_of_one_bucket(spark, texts, compare, features, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = docs.select(F.lit(1).cast("long").alias("key"), "node", F.lit(len(texts)).cast("long").alias("n"))
    found = near.near_classes(members, lambda nodes: docs.join(nodes, "node"), compare, features, 0.8).collect()
    of = {r["node"]: r["root"] for r in found}
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(of.get(i, i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_one_bucket_of_lines_is_finished_exactly(spark, texts, monkeypatch):
    got = classes_of_one_bucket(spark, texts, line_dedup.compare_lines, line_dedup.line_features, monkeypatch)
    assert got == parts(len(texts), line_links(texts))


def weights(texts, idf):
    import pyarrow as pa

    return list(minhash_dedup.weighted(pa.array(texts), idf))


def document_links(texts, idf, at=0.8):
    found = weights(texts, idf)
    out = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        (g, w), (h, v) = found[i], found[j]
        _, x, y = np.intersect1d(g, h, assume_unique=True, return_indices=True)
        both = np.minimum(w[x], v[y]).sum()
        if both >= at * (w.sum() + v.sum() - both) - 1e-9:
            out.append((i, j))
    return out


def test_one_bucket_of_documents_is_finished_exactly(spark, texts, monkeypatch):
    idf = np.random.default_rng(1).uniform(0.5, 2, minhash_dedup.CELLS).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    got = classes_of_one_bucket(spark, texts, lambda p: minhash_dedup.compare_pairs(p, shared), lambda t: minhash_dedup.weighted(t, shared.value), monkeypatch)
    assert got == parts(len(texts), document_links(texts, idf))


def test_difference_filter_leaves_few_pairs(spark, texts):
    """Copies with changes of their own that aren't linked to the central text aren't met pair by pair."""
    rng = random.Random(9)
    words = ["w%d" % i for i in range(100000)]
    base = [rng.choice(words) for _ in range(200)]
    far = [" ".join(t) for t in copies(rng, base, 300, 5, 9, words)]
    rows = [(0, i + 1, i + 1, False, " ".join(base), t) for i, t in enumerate(far)]
    told = spark.createDataFrame(rows, "rep long, node long, root long, own boolean, rep_text string, text string")
    idf = np.ones(minhash_dedup.CELLS, np.float32)
    left = near.split_by_difference(told, lambda t: minhash_dedup.weighted(t, idf), 0.8)
    assert left.count() < 300


def test_classes_through_the_bands_equal_brute_force(spark, texts):
    """From the threshold up, no link is missed and none is made up."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = minhash_dedup.idf_table(docs)
    links = document_links(texts, idf)
    got = {}
    for r in minhash_dedup.near_duplicates(docs).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == parts(len(texts), links)


def test_lines_through_the_bands_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    removed = {r["doc_id"] for r in line_dedup.line_counts(docs).collect() if r["n_removed"]}
    every = parts(len(texts), line_links(texts))
    assert removed == {i for g in every for i in g} - {min(g) for g in every}
