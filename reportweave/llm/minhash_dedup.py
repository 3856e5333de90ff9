"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of five words (all its words, if it has fewer). A shingle weighs its count in the document times
a damped inverse document frequency. Frequencies are counted over all documents in a table of fixed size, by hash; a
cell holds what its shingles have in common, so frequencies are exact up to the share of documents that falls into a cell by
chance, which doesn't depend on the corpus' size. Each of ROWS * BANDS samples draws one shingle with a probability in
proportion to its weight, consistently between documents; samples are banded, and candidates verified by weighted Jaccard
similarity over whole texts (see near). Equal texts are one node from the start, whatever their number.

Defined cases: null texts count as empty; equal texts are always of one class, empty ones too; texts without words are
otherwise alone; a null doc_id counts as less than all others; repeated rows are of one class. Rows with equal doc_id
and different texts are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered_sum, materialize, text_key
from .near import buckets_by_join, near_classes
from .wordbytes import blocks, gram_hashes, mix, separators, whole_grams, word_hashes, words

SHINGLE, ROWS, BANDS = 5, 5, 19
#: How much more the rarest shingle weighs than one that every document has.
DAMP = 0.1
CELLS = 1 << 18
_SPACE = separators("space")
_DRAWS = 1 << 15
_STEP = 2048
_draws: dict = {}


def shingles(block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, sorted by row and hash."""
    w = words(block, _SPACE)
    h = word_hashes(block.data, w)
    at = whole_grams(w, size)
    g, row = gram_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64), w.row[at]
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.array([gram_hashes(h[w.first[r] : w.first[r + 1]], int(count[r]))[0] for r in few], np.uint64)
        at = np.searchsorted(row, few)
        g, row = np.insert(g, at, short), np.insert(row, at, few)
    edge = np.searchsorted(row, np.arange(block.rows + 1)).tolist()
    for lo, hi in zip(edge, edge[1:]):  # rows are in order, so that each is sorted where it is
        g[lo:hi].sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (row[1:] != row[:-1])]))
    return row[new], g[new], np.diff(np.append(new, len(g)))


def _cells(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(30)).astype(np.int64) & (CELLS - 1)


def idf_table(docs: DataFrame) -> np.ndarray:
    """1 + DAMP * log(1 + N / df) / log(1 + N) by cell, over all documents.

    Undamped, a group of near copies would grow apart as it grows: what its members share becomes frequent and
    light, what sets each apart stays rare and heavy. Damped, likeness keeps within some hundredths of plain Jaccard.
    """

    def add(table, texts):
        for b in blocks(texts):
            table += np.bincount(_cells(shingles(b)[1]), minlength=CELLS)

    df = gathered_sum(docs, add, CELLS)
    n = max(docs.count(), 1)
    return (1 + DAMP * np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype(np.float32)


def _table(samples: int) -> tuple[np.ndarray, ...]:
    """r, log c and beta of the sampling scheme, for hashed shingles."""
    if samples not in _draws:
        rng = np.random.default_rng(20100)
        r = rng.gamma(2, 1, (_DRAWS, samples)).astype(np.float32)
        c = np.log(rng.gamma(2, 1, (_DRAWS, samples))).astype(np.float32)
        _draws[samples] = r, c, rng.random((_DRAWS, samples), np.float32)
    return _draws[samples]


def _room(samples: int) -> np.ndarray:
    """Where a worker makes its samples, again and again: fresh memory of this size would be asked of the system each time."""
    if -samples not in _draws:
        _draws[-samples] = np.empty((4, _STEP, samples), np.float32)
    return _draws[-samples]


def sample(g: np.ndarray, weight: np.ndarray, samples: int = ROWS * BANDS) -> np.ndarray:
    """A 64-bit identity of each of the document's consistent samples; g ascends. Works in place."""
    tables, room = _table(samples), _room(samples)
    best, out = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64)
    column = np.arange(samples)
    logs, cells = np.log(weight)[:, None], (g & np.uint64(_DRAWS - 1)).astype(np.int64)
    for lo in range(0, len(g), _STEP):
        some = cells[lo : lo + _STEP]
        r, c, beta, t = (x[: len(some)] for x in room)
        for x, to in zip(tables, (r, c, beta)):
            x.take(some, 0, to, "clip")  # several times as fast as by index
        np.divide(logs[lo : lo + _STEP], r, out=t)
        t += beta
        np.floor(t, out=t)
        a = np.subtract(t, beta, out=beta)
        a += 1
        a *= r
        np.subtract(c, a, out=a)
        at = a.argmin(0)
        low = a[at, column]
        won = low < best
        best[won] = low[won]
        ids = mix(g[lo + at] ^ mix(t[at, column].astype(np.int64).view(np.uint64)))
        out[won] = ids[won]
    return out


def samples(texts: pa.Array, idf: np.ndarray, number: int):
    """(index, samples) of each text with words."""
    for b in blocks(texts):
        row, g, count = shingles(b)
        weight = count.astype(np.float32) * idf[_cells(g)]
        edge = np.searchsorted(row, np.arange(b.rows + 1))
        for i in range(b.rows):
            if edge[i] < edge[i + 1]:
                yield b.first + i, sample(g[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]], number)


def bands(texts: pa.Array, idf: np.ndarray) -> list:
    """BANDS keys for each text with words, None for the others."""
    out: list = [None] * len(texts)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i, flat in samples(texts, idf, ROWS * BANDS):
        s, key = flat.reshape(BANDS, ROWS), salt.copy()
        for j in range(ROWS):
            key = mix(key ^ s[:, j]) + s[:, j]
        out[i] = key.view(np.int64)
    return out


def weighted(texts: pa.Array, idf: np.ndarray):
    """(hashes, weights) of the distinct shingles of each text, hashes ascending."""
    for b in blocks(texts):
        row, g, count = shingles(b)
        weight = count * idf[_cells(g)].astype(float)
        edge = np.searchsorted(row, np.arange(b.rows + 1))
        for i in range(b.rows):
            yield g[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]


def compare_pairs(pairs: DataFrame, idf) -> DataFrame:
    """(a, b, a_text, b_text) to (a, b, sim): weighted Jaccard similarity of the TF-IDF shingles."""

    def run(batches):
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sides = (weighted(part.column(c), idf.value) for c in ("a_text", "b_text"))
                for i, ((g, w), (h, v)) in enumerate(zip(*sides)):
                    _, x, y = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                    both = np.minimum(w[x], v[y]).sum()
                    every = w.sum() + v.sum() - both
                    sims[lo + i] = both / every if every else 0.0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "sim"])

    return pairs.mapInArrow(run, f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}, sim double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_key, class_id, copies, class_size, kept) of each distinct pair of doc_id and text.

    class_id is the least doc_id of the class; `kept` marks the one row of each class that stays; `copies` counts repeated rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h1", text_key(F.col("text"))).withColumn("h2", F.xxhash64(F.lit(11), "text"))
    idf = spark.sparkContext.broadcast(idf_table(rows))

    def run(batches):
        for batch in batches:
            keys = pa.array(bands(batch.column("text"), idf.value), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), keys], names=["doc_id", "h1", "h2", "bands"])

    signed = materialize(rows.select("doc_id", "h1", "h2", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>"), "near-signed")
    low = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h1", "h2")).alias("low")
    nodes = signed.groupBy("h1", "h2").agg(low, F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    members = buckets_by_join(nodes.select(F.explode("bands").alias("key"), "node"))

    def fetch(needed):
        flat = nodes.join(needed, "node").select("node", F.col("low.doc_id").alias("n_doc"), F.col("h1").alias("n_h1"), F.col("h2").alias("n_h2"))
        same = rows["doc_id"].eqNullSafe(flat["n_doc"]) & (rows["h1"] == flat["n_h1"]) & (rows["h2"] == flat["n_h2"])
        return rows.join(flat, same).dropDuplicates(["node"]).select("node", "text")

    linked = near_classes(members, fetch, lambda p: compare_pairs(p, idf), lambda t: weighted(t, idf.value), threshold)
    classes = nodes.select("h1", "h2", "node", "low").join(linked, "node", "left").select("h1", "h2", "low", F.coalesce("root", "node").alias("root"))
    classes = classes.join(classes.groupBy("root").agg(F.min("low").alias("first")), "root").select("h1", "h2", "root", "first")
    each = signed.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("copies")).join(classes, ["h1", "h2"])
    sizes = each.groupBy("root").agg(F.sum("copies").alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    return each.join(sizes, "root").select("doc_id", F.col("h1").alias("text_key"), F.col("first.doc_id").alias("class_id"), "copies", "class_size", kept.alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class of near duplicates."""
    found = materialize(near_duplicates(docs, threshold).filter("kept or copies > 1").select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"), "copies", "kept"), "near-kept")
    keyed = docs.withColumn("k_own", text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_doc")) & (F.col("k_own") == F.col("k_text"))
    stay = keyed.join(found.filter("kept"), same)
    single = stay.filter("copies = 1").select(*docs.columns)
    return single.unionByName(stay.filter("copies > 1").dropDuplicates(["k_doc", "k_text"]).select(*docs.columns))
