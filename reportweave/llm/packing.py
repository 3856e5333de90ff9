"""Conflict-constrained best-fit packing of documents into training sequences.

A document's words (runs of non-blanks) are cut into pieces of at most `capacity`. Full pieces are bins of their own.
The rest are packed, longest first: open bins are kept in the order of their residual room, each with a bitmap of its
sources and one of its duplicate clusters; from the tightest bin that is large enough the search goes on to its
successors until one has neither the document's source nor its cluster. If none is left, a bin is opened.

Documents are dealt by hash to shards of about `shard_rows`, packed independently, so that no task grows with the corpus and
no key (a source with a third of all rows, say) gathers in one; rows that are repeated more often than that are dealt on.

Defined cases: a null text is empty; a document without words takes no room and has a null bin_id; a null source or
cluster conflicts with nothing; equal sizes are packed in the order of doc_id (null first); repeated rows are packed
each, and never together, being copies. A cluster is a class of near duplicates (see minhash_dedup) if `near` is set, which holds equal
word sequences too; else it is the hash of the document's words in order, which suffices where near copies have been removed before.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_key
from .minhash_dedup import near_duplicates
from .wordbytes import blocks, mix, separators, word_hashes, words

_SPACE = separators("space")


def measure(docs: DataFrame, near: bool = False) -> DataFrame:
    """(doc_id, source, n_words, cluster) of documents; cluster is null for a text without words."""
    if near:
        return _measure_near(docs)

    def run(batches):
        for batch in batches:
            count, cluster = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for b in blocks(batch.column("text")):
                w = words(b, _SPACE)
                count[b.first : b.first + b.rows] = np.diff(w.first)
                if len(w):
                    place = (np.arange(len(w)) - w.first[w.row]).astype(np.uint64)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word_hashes(b.data, w) + mix(place)), dtype=np.uint64)])
                    cluster[b.first : b.first + b.rows] = total[w.first[1:]] - total[w.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(count), pa.array(cluster.view(np.int64), mask=count == 0)],
                names=["doc_id", "source", "n_words", "cluster"],
            )

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_words long, cluster long")


def _measure_near(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumn("own", F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key")))
    exact = measure(keyed.select(F.struct("doc_id", "own").alias("doc_id"), "source", "text"))
    found = near_duplicates(docs).select(F.struct("doc_id", "text_key").alias("c_own"), F.xxhash64(F.col("class_id").isNull(), "class_id").alias("class")).distinct()
    joined = exact.join(found, (exact["doc_id.own.text_key"] == found["c_own.text_key"]) & exact["doc_id.own.doc_id"].eqNullSafe(found["c_own.doc_id"]), "left")
    return joined.select("doc_id.doc_id", "source", "n_words", F.when(F.col("n_words") > 0, F.coalesce("class", "cluster")).alias("cluster"))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each item. Items come longest first."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    room: list[tuple[int, int]] = []  # (residual, bin), ascending
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    smallest, out = (sizes[-1] if sizes else 0), []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        c = 0 if cluster is None else cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        at = bisect_left(room, (size, -1))
        while at < len(room):
            b = room[at][1]
            if not bin_sources[b] & s and not bin_clusters[b] & c:
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bin_sources)
            bin_sources.append(0)
            bin_clusters.append(0)
        bin_sources[b] |= s
        bin_clusters[b] |= c
        left -= size
        if left >= max(1, smallest):
            insort(room, (left, b))
        out.append(b)
    return out


RESULT = "bin_id long, doc_id long, piece long, start_word long, n_words long"


def pack(measured: DataFrame, capacity: int = 2048, shard_rows: int = 4096, n_rows: int | None = None) -> DataFrame:
    """One row a piece: bin_id, doc_id, piece, start_word, n_words. measured: doc_id, source, n_words, cluster."""
    measured = materialize(measured, "packing-measured")
    n_rows = measured.count() if n_rows is None else n_rows
    shards = max(1, math.ceil(n_rows / shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "source"], na_position="first", kind="stable")
        n = pdf["n_words"].to_numpy(np.int64)
        full, rest = n // capacity, n % capacity
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        plain = lambda c: [None if pd.isna(x) else x for x in pdf[c].to_numpy()[order]]
        bins = best_fit(rest[order].tolist(), plain("source"), plain("cluster"), capacity)
        next_bin, base = (max(bins) + 1 if bins else 0), int(pdf["shard"].iloc[0]) << 32
        whole = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        empty = np.flatnonzero(n == 0)
        doc = np.concatenate([order, whole, empty])
        number = np.concatenate([full[order], piece, np.zeros(len(empty), np.int64)])
        bin_id = np.concatenate([np.array(bins, np.int64), next_bin + np.arange(len(whole)), np.zeros(len(empty), np.int64)]) + base
        return pd.DataFrame({
            "bin_id": pd.Series(bin_id, dtype="Int64").mask(np.arange(len(bin_id)) >= len(order) + len(whole)),
            "doc_id": pdf["doc_id"].array[doc],
            "piece": number,
            "start_word": number * capacity,
            "n_words": np.concatenate([rest[order], np.full(len(whole), capacity), np.zeros(len(empty), np.int64)]),
        })

    keyed = measured.withColumns({"row_hash": F.xxhash64("doc_id", "cluster", "n_words"), "row_number": F.monotonically_increasing_id()})
    repeated = keyed.groupBy("row_hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > shard_rows)
    part = F.when(F.col("copies").isNotNull(), F.pmod("row_number", F.ceil(F.col("copies") / shard_rows))).otherwise(0)
    shard = F.pmod(F.xxhash64("row_hash", part), F.lit(shards)).cast("int")
    return keyed.join(repeated, "row_hash", "left").withColumn("shard", shard).select("doc_id", "source", "n_words", "cluster", "shard").groupBy("shard").applyInPandas(run, RESULT)


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_rows: int = 4096, near: bool = False) -> DataFrame:
    return pack(measure(docs, near), capacity, shard_rows, docs.count())
