"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A fingerprint is a vector that is summed over a document's paragraphs (its lines that aren't blank), so that
order doesn't matter and a paragraph is inserted or deleted by adding or subtracting its vector. It has
two parts. STRICT lanes modulo 2**64 take a hash of the whole paragraph: they decide equality. SOFT lanes
modulo 2**16 take a signed count sketch of the paragraph's words: the squared length of the difference of two of
them estimates how much two documents differ, which gives a likeness from 0 to 1.

Defined cases: a null text is an empty one, whose fingerprint is all zeros; two empty texts have likeness 1.
A text of blanks only has no paragraphs and the fingerprint of the empty text. Rows with a null doc_id
come before all others in the order of documents, rows with equal doc_id are ordered by text. The next
document after the last one is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .wordbytes import blocks, mix, separators, word_hashes, words

STRICT, SOFT = 8, 256
_LINES = np.zeros(256, bool)
_LINES[[0x0A, 0x0D]] = True
_SPACE = separators("space")
_LANES = (np.arange(1, STRICT + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(strict uint64[n, STRICT], soft int64[n, SOFT]) of the texts; soft holds true sums, not yet reduced."""
    strict, soft = np.zeros((len(texts), STRICT), np.uint64), np.zeros((len(texts), SOFT), np.int64)
    for b in blocks(pa.array(texts, pa.large_string())):
        w = words(b, _SPACE)
        if not len(w):
            continue
        h = word_hashes(b.data, w)
        cell = (h & np.uint64(SOFT - 1)).astype(np.int64)
        sign = 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        flat = np.bincount(w.row * SOFT + cell, sign, b.rows * SOFT)
        soft[b.first : b.first + b.rows] = flat.reshape(b.rows, SOFT).astype(np.int64)
        lines = words(b, _LINES)
        filled = np.searchsorted(w.start, lines.end, "left") > np.searchsorted(w.start, lines.start, "left")
        lines.start, lines.end, row = lines.start[filled], lines.end[filled], lines.row[filled]
        g = word_hashes(b.data, lines)
        lanes = mix(mix(g)[:, None] + _LANES)
        at = np.flatnonzero(np.diff(row, prepend=-1))
        strict[b.first + row[at]] = np.add.reduceat(lanes, at, axis=0)
    return strict, soft


def encode(strict: np.ndarray, soft: np.ndarray) -> list[str]:
    """Hex strings: STRICT lanes of 16 digits, then SOFT lanes of 4 (modulo 2**16)."""
    a, b = strict.astype(">u8").view(np.uint8), (soft & 0xFFFF).astype(">u2").view(np.uint8)
    return [x.tobytes().hex() for x in np.hstack([a.reshape(len(strict), -1), b.reshape(len(soft), -1)])]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * STRICT], ">u8").astype(np.uint64), np.frombuffer(raw[8 * STRICT :], ">u2").astype(np.int64)


def _combine(a: str, b: str, sign: int) -> str:
    (s, u), (t, v) = decode(a), decode(b)
    return encode((s + t if sign > 0 else s - t)[None], (u + sign * v)[None])[0]


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after paragraph is added to the document."""
    return _combine(fingerprint, encode(*vectors([paragraph]))[0], 1)


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after paragraph is taken from the document."""
    return _combine(fingerprint, encode(*vectors([paragraph]))[0], -1)


def _centred(v: np.ndarray) -> np.ndarray:
    return ((v + 0x8000) & 0xFFFF) - 0x8000


def likeness(strict_a, soft_a, strict_b, soft_b) -> np.ndarray:
    """1 - |A - B|^2 / (|A|^2 + |B|^2), cut off at 0; 1 if the strict lanes agree."""
    a, b, d = (_centred(x).astype(float) for x in (soft_a, soft_b, soft_a - soft_b))
    total = (a * a).sum(1) + (b * b).sum(1)
    out = np.clip(1 - (d * d).sum(1) / np.maximum(total, 1), 0, 1)
    return np.where((strict_a == strict_b).all(1), 1.0, out)


def at_most(cuts: list[int], x: Column) -> Column:
    """How many of the ascending cuts are at most x, by halving."""
    array, n = F.array(*[F.lit(int(c)).cast("long") for c in cuts]), len(cuts)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= n) & F.coalesce(F.get(array, lo + s - 1) <= x, F.lit(False)), lo + s).otherwise(lo))


def with_next(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(bucket, ahead, doc_id, text) laid out so that each row's next document follows it in its partition.

    Documents are dealt to buckets of consecutive doc_id at sampled quantiles; the first document of each bucket
    goes also to the bucket before it, marked ahead. The texts are shuffled once and no global sort runs.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = n_buckets or shuffle_partitions(spark)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    ids = docs.select("doc_id")
    bucket = F.lit(0)
    if cuts:
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(at_most(cuts, F.col("doc_id")))
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("low"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()
    rows = rows.withColumn("bucket", bucket)
    if not firsts:
        return rows.withColumn("ahead", F.lit(False)).select("bucket", "ahead", "doc_id", "text")
    lows = [(None if r["nulls"] else r["low"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]  # n rows at most
    lows = spark.createDataFrame(lows, "low long, back int")
    rows = rows.join(F.broadcast(lows), F.col("doc_id").eqNullSafe(F.col("low")), "left")
    own = F.struct("bucket", F.lit(False).alias("ahead"))
    to = F.when(F.col("back").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("back").alias("bucket"), F.lit(True).alias("ahead"))))
    return (
        rows.withColumn("to", F.explode(to))
        .select("to.bucket", "to.ahead", "doc_id", "text")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "ahead", "doc_id", "text")
    )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(frames: Iterator[pd.DataFrame], size: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text, next text), a few megabytes each."""
    held, out, chars, lead = None, [], 0, False
    for pdf in frames:
        for bucket, ahead, doc_id, text in zip(pdf["bucket"], pdf["ahead"], pdf["doc_id"], pdf["text"]):
            if held is not None and held[0] == bucket:
                out.append((held[1], held[2], text))
                chars += len(held[2])
            held = None if ahead else (bucket, doc_id, text)
            if chars > size:
                yield out
                out, chars = [], 0
    if out:
        yield out


def fingerprint_documents(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Fingerprint of each document and of its edited text (see the query's contract), with likenesses."""

    def run(frames):
        for some in _pairs(frames, 2_000_000):
            ids = [None if pd.isna(i) else int(i) for i, _, _ in some]
            own, nxt = [t for _, t, _ in some], [t for _, _, t in some]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, nxt)]
            (s, v), (es, ev), (ns, nv) = vectors(own), vectors(edited), vectors(nxt)
            yield pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"),
                "n_chars": [len(t) for t in own],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": encode(s, v),
                "edited_fingerprint": encode(es, ev),
                "near_edited": likeness(s, v, es, ev),
                "near_next": likeness(s, v, ns, nv),
            })

    return with_next(docs, n_buckets).mapInPandas(run, RESULT)
