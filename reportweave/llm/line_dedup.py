"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard verification, one line kept of each component.

Lines are what '\\n' separates. A line's shingles are its runs of eight characters (all of it, if it is shorter). Equal
lines are met by 128 bits of hash first, so that a line with any number of copies is one node, aggregated before
the shuffle. Nodes are signed with ROWS * BANDS min-hashes, banded, and candidates verified by the exact Jaccard
similarity of their shingle sets (see near); of each component the first line (by doc_id, then line number) stays.

Defined cases: blank lines (only white space) are never duplicates and always stay; null or empty texts have no lines to
remove; a null doc_id counts as less than all others; rows of one doc_id with different texts are told apart by 31 bits of their
text's hash; repeated rows count as one document and are cut alike, so the line that stays does so in each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .near import buckets_by_join, near_classes
from .substring_dedup import tag_of
from .wordbytes import mix

SHINGLE, ROWS, BANDS = 8, 4, 12
_CHARS = 1 << 17
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = (mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start and end of the lines that aren't blank). Line i of the result isn't line i of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(codes == 10)
    return codes, np.concatenate([[0], edge + 1]), np.append(edge, len(codes))


def signatures(codes: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(h1, h2, bands) of the lines [start, end) that aren't empty; bands are uint64[lines, BANDS]."""
    length = end - start
    h = np.zeros(max(len(codes) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        h = h * _STEP + codes[i : i + len(h)].astype(np.uint64)
    h = mix(h)
    count = np.maximum(length - SHINGLE + 1, 1)
    edge = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(start - edge, count)
    g = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero(length < SHINGLE):
        x = int(length[i])
        for c in codes[start[i] : end[i]].tolist():
            x = (x * int(_STEP) + c) % (1 << 64)
        g[edge[i]] = mix(np.array([x], np.uint64))[0]
    place = (np.arange(len(at)) - np.repeat(edge, count)).astype(np.uint64)
    ordered = mix(g ^ mix(place + np.uint64(1)))
    h1 = mix(np.add.reduceat(ordered, edge) + length.astype(np.uint64))
    h2 = mix(np.add.reduceat(ordered ^ (g << np.uint64(1)), edge) ^ length.astype(np.uint64))
    keys = np.zeros((len(start), BANDS), np.uint64)
    base = (g >> np.uint64(32)).astype(np.uint32)
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64)
        for j in range(ROWS):
            m = np.minimum.reduceat(base * _FACTORS[b * ROWS + j], edge).astype(np.uint64)
            key = mix(key ^ (m + np.uint64(j << 40)))
        keys[:, b] = key
    return h1, h2, keys


def _groups(texts, size: int):
    """Lists of (row, text) of about `size` characters."""
    some, chars = [], 0
    for i, t in enumerate(texts):
        if t:
            some.append((i, t))
            chars += len(t)
            if chars > size:
                yield some
                some, chars = [], 0
    if some:
        yield some


def _blank(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    white = (codes <= 0x20) | np.isin(codes, [0x85, 0xA0, 0x2028, 0x2029, 0x3000])
    full = np.concatenate([[0], np.cumsum(~white)])
    return full[end] == full[start]


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, line, h1, h2, bands) of the lines that aren't blank."""

    def run(batches):
        for batch in batches:
            for some in _groups(batch.column("text").to_pylist(), _CHARS):
                codes, start, end = line_spans("\n".join(t for _, t in some))
                n_lines = np.array([t.count("\n") + 1 for _, t in some])
                row = np.repeat(np.array([i for i, _ in some]), n_lines)
                line = np.arange(len(row)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                stay = ~_blank(codes, start, end)
                if not stay.any():
                    continue
                h1, h2, keys = signatures(codes, start[stay], end[stay])
                doc = pa.array(row[stay])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(h1) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("tag").take(doc), pa.array(line[stay].astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands],
                    names=["doc_id", "tag", "line", "h1", "h2", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(F.col("text")).alias("tag"), "text")
    return rows.mapInArrow(run, "doc_id long, tag int, line int, h1 long, h2 long, bands array<long>")


_SOLID = "[^\\x00-\\x20\\x85\\xa0\\u2028\\u2029\\u3000]"


def _set(line: str) -> frozenset:
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def line_features(texts: pa.Array):
    """(hashes, weights) of the distinct shingles of each line."""
    for line in texts.to_pylist():
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(len(codes) - SHINGLE + 1, 1)
        h = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(codes))):
            h = h * _STEP + codes[i : i + n] + np.uint64(1)
        g = np.unique(mix(h))
        yield g, np.ones(len(g))


def compare_lines(pairs: DataFrame) -> DataFrame:
    """(a, b, a_text, b_text) to (a, b, sim): exact Jaccard similarity of the character shingles."""

    def run(batches):
        for batch in batches:
            sims, last, left = [], None, frozenset()
            for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                if x != last:
                    last, left = x, _set(x)
                right = _set(y)
                both = len(left & right)
                sims.append(both / (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return pairs.mapInArrow(run, f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}, sim double")


def duplicate_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, tag, lines): numbers (from 0) of each document's lines that go, for documents that have some."""
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line", "tag").alias("place")
    signed = materialize(line_rows(docs), "lines-signed")
    nodes = signed.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "lines-nodes")
    members = buckets_by_join(nodes.select(F.explode("bands").alias("key"), "node"))

    def fetch(needed):
        wanted = nodes.join(needed, "node").groupBy(F.col("place.doc_id").alias("n_doc"), F.col("place.tag").alias("n_tag")).agg(F.collect_list(F.struct("place.line", "node")).alias("wanted"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(F.col("text")).alias("tag"), "text")
        found = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("tag") == F.col("n_tag")))
        picked = found.select("wanted", F.split("text", "\n", -1).alias("lines")).select(F.explode(F.transform("wanted", lambda n: F.struct(n["node"].alias("node"), F.get("lines", n["line"]).alias("text")))).alias("x"))
        return picked.select("x.node", "x.text").filter("text is not null").dropDuplicates(["node"])

    linked = near_classes(members, fetch, compare_lines, line_features, threshold)
    named = nodes.select("node", "h1", "h2", "place", "n").join(linked, "node", "left")
    firsts = named.filter("root is not null").groupBy("root").agg(F.min("place").alias("first"))
    staying = named.filter("root is not null or n > 1").join(firsts, "root", "left").select("h1", "h2", F.coalesce("first", "place").alias("first"))
    gone = signed.select("h1", "h2", place).join(staying, ["h1", "h2"]).filter(F.col("place") != F.col("first"))
    return gone.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.tag").alias("tag")).agg(F.array_sort(F.collect_set("place.line")).alias("lines"))


def line_counts(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of each row; n_lines counts lines that aren't blank."""
    gone = duplicate_lines(docs, threshold).select(F.col("doc_id").alias("g_doc"), F.col("tag").alias("g_tag"), "lines")
    solid = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_SOLID)))
    rows = docs.select("doc_id", tag_of(F.col("text")).alias("own"), F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(solid), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("g_doc")) & (F.col("own") == F.col("g_tag")), "left")
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the lines that duplicate an earlier one taken out of their texts; null texts stay null."""
    gone = materialize(duplicate_lines(docs, threshold), "lines-gone").select(F.col("doc_id").alias("g_doc"), F.col("tag").alias("g_tag"), F.col("lines").alias("g_lines"))
    names = docs.columns
    keyed = docs.withColumn("g_own", tag_of(F.col("text")))
    out = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("g_doc")) & (F.col("g_own") == F.col("g_tag")), "left")

    def run(batches):
        for batch in batches:
            texts = []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("g_lines").to_pylist()):
                if t and gone:
                    gone = set(gone)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                texts.append(t)
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return out.select(*names, "g_lines").mapInArrow(run, docs.schema)
