"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing gives every token a fixed sparse index vector, drawn from its hash. A token's context vector is the sum
of the index vectors of its neighbours over the whole corpus; contexts are summed in CELLS hashed cells, so the table has
a fixed size and can be broadcast. A token's word vector is its index vector plus its context vector at unit length.
Documents pool their tokens' vectors (mean and spread) beside a few pooled token statistics; a network with one hidden layer, fitted in numpy on the
driver, scores them, and a temperature fitted on held-back labels calibrates its probabilities.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other marks; what a run looks like (capitals, digits,
the same as the run before) is counted in the statistics.

At most max_labels labelled documents are fitted on: those with the smallest hash of doc_id. Everything else covers all
documents.

Defined cases: a null text is empty; an empty text pools to zeros and still gets a score; labels with null quality or doc_id
are ignored, of repeated labels the least quality counts; with no labels at all every score is 1, with labels of one class
every score is that class. Rows are scored one by one, so repeated rows score alike and a null doc_id is scored too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered_sum
from .wordbytes import LOWER, Words, blocks, mix, separators, word_hashes, words

CELLS, DIMS, NONZERO, REACH = 1 << 13, 64, 4, 2
STATS = 8
FEATURES = 2 * DIMS + STATS
_ALNUM = separators("alnum")
_MARKS = ~_ALNUM | separators("space")  # what separates runs of marks


def tokens(block) -> tuple[Words, np.ndarray, np.ndarray]:
    """(tokens in order, hash of each, statistics rows x 4: marks, capitals, digits, letters)."""
    lower = LOWER[block.data]
    a, b = words(block, _ALNUM), words(block, _MARKS)
    start, end = np.concatenate([a.start, b.start]), np.concatenate([a.end, b.end])
    order = np.argsort(start, kind="stable")
    row = np.concatenate([a.row, b.row])[order]
    w = Words(start[order], end[order], row, np.searchsorted(row, np.arange(block.rows + 1)))
    kinds = [~_ALNUM[block.data] & (block.data >= 0x41), (block.data >= 0x41) & (block.data <= 0x5A), (block.data >= 0x30) & (block.data <= 0x39), ~_MARKS[block.data]]
    sums = [np.concatenate([[0], np.cumsum(k)])[block.offsets] for k in kinds]
    return w, word_hashes(lower, w), np.stack([np.diff(s) for s in sums], 1).astype(float)


def index_vectors(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the NONZERO entries of each cell's index vector."""
    dim, sign = np.empty((len(cells), NONZERO), np.int64), np.empty((len(cells), NONZERO), np.float32)
    for i in range(NONZERO):
        h = mix(cells.astype(np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        dim[:, i] = (h & np.uint64(DIMS - 1)).astype(np.int64)
        sign[:, i] = 1 - 2 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float32)
    return dim, sign


def _index_table() -> np.ndarray:
    dim, sign = index_vectors(np.arange(CELLS))
    table = np.zeros((CELLS, DIMS), np.float32)
    np.add.at(table, (np.arange(CELLS)[:, None], dim), sign)
    return table


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def context_table(docs: DataFrame) -> np.ndarray:
    """CELLS x DIMS sums of neighbours' index vectors over all documents."""

    def add(total, texts):
        dim, sign = index_vectors(np.arange(CELLS))
        for b in blocks(texts):
            w, h, _ = tokens(b)
            cell = _cells(h)
            for d in range(1, REACH + 1):
                if len(cell) <= d:
                    continue
                same = w.row[d:] == w.row[:-d]
                left, right = cell[:-d][same], cell[d:][same]
                for to, of in ((left, right), (right, left)):
                    for i in range(NONZERO):
                        total += np.bincount(to * DIMS + dim[of, i], sign[of, i], CELLS * DIMS)

    return gathered_sum(docs, add, CELLS * DIMS).reshape(CELLS, DIMS)


def word_vectors(context: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return _index_table() / np.sqrt(NONZERO).astype(np.float32) + context / np.maximum(length, 1e-6)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    n = len(texts)
    out = np.zeros((n, FEATURES), np.float32)
    for b in blocks(texts):
        w, h, kinds = tokens(b)
        if not len(w):
            continue
        cell, count = _cells(h), np.diff(w.first)
        filled = np.flatnonzero(count)
        at, many = w.first[filled], count[filled][:, None].astype(np.float32)
        mean, square = np.zeros((len(filled), DIMS), np.float32), np.zeros((len(filled), DIMS), np.float32)
        edge = np.append(at, len(cell))
        for lo in range(0, len(filled), 64):
            hi = min(lo + 64, len(filled))
            v = vectors[cell[edge[lo] : edge[hi]]]
            mean[lo:hi] = np.add.reduceat(v, at[lo:hi] - at[lo], axis=0)
            square[lo:hi] = np.add.reduceat(v * v, at[lo:hi] - at[lo], axis=0)
        mean /= many
        spread = np.sqrt(np.maximum(square / many - mean * mean, 0))
        key = np.sort(mix(h + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | w.row.astype(np.uint64) << np.uint64(40))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        kinds_of = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=b.rows)[filled]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])])
        repeats = np.bincount(w.row[again], minlength=b.rows)[filled]
        long = np.bincount(w.row, w.end - w.start, b.rows)[filled]
        size = np.maximum(np.diff(b.offsets)[filled], 1)[:, None]
        c = count[filled]
        stats = np.stack([np.log1p(c), kinds_of / c, repeats / c, long / c / 10, kinds_of / np.sqrt(c) / 10], 1)
        out[b.first + filled] = np.hstack([mean, spread, stats, kinds[filled][:, 1:] / size])
    return out


class Network:
    """FEATURES inputs, one hidden layer, one logit; a temperature for calibrated probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 48, rounds: int = 60, seed: int = 7):
        self.constant = None if len(set(y.tolist())) == 2 else float(y[0]) if len(y) else 1.0
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        shuffled = rng.permutation(len(x))
        cut = max(1, len(x) // 6)
        back, fit = shuffled[:cut], shuffled[cut:]
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for r in range(rounds):
            order = fit[rng.permutation(len(fit))]
            for lo in range(0, len(order), 256):
                xb, yb = x[order[lo : lo + 256]], y[order[lo : lo + 256]]
                hid = np.tanh(xb @ p[0] + p[1])
                err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - yb) / len(yb)
                down = np.outer(err, p[2]) * (1 - hid * hid)
                grads = [xb.T @ down + 1e-4 * p[0], down.sum(0), hid.T @ err + 1e-4 * p[2], err.sum(keepdims=True)]
                step += 1
                rate = 3e-3 * (1 - r / rounds)
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, truth = self._logits(x[back]), y[back]
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def _logits(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logits(np.clip((x - self.mean) / self.scale, -6, 6)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 16_000) -> tuple[np.ndarray, Network]:
    """(word vectors, network), learnt from labels outside fold 0. docs are the whole corpus."""
    spark = docs.sparkSession
    vectors = word_vectors(context_table(docs))
    known = labels.filter("doc_id is not null and quality is not null").filter(fold_of(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("double").alias("quality"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labels)
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_pydict({"label_id": batch.column("label_id"), "quality": batch.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    joined = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("label_id", "quality", "text")
    joined = joined.groupBy("label_id").agg(F.min("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of several texts of one doc_id the least
    got = joined.mapInArrow(run, "label_id long, quality double, x binary").toPandas().sort_values("label_id")
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float) if len(got) else np.zeros((0, FEATURES))
    return vectors, Network(x, got["quality"].to_numpy(float))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, Network], threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id unless said otherwise) with held_out, score and predicted."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            score = network.score(features(batch.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score, pa.float64())], names=[*keep, "score"])

    inner = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name in keep)
    out = inner.mapInArrow(run, f"{fields}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)))
