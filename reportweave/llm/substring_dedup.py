"""Substring dedup with a log-structured index of window fingerprints.

A window is n consecutive words. Each window has an anchor, the run of `anchor` words in it whose hash is least (the leftmost
of equals): equal windows have equal anchors, and neighbouring windows mostly share theirs. Windows that share an
anchor's occurrence form one row: the anchor's 64-bit hash, by which rows are sorted and met, and the 64 bits of each
window's own hash, by which a meeting is verified: of a million windows of one anchor, two agree by chance once in 37 million. Words aren't compared.

The index is a list of immutable runs of such rows, each a table that is bucketed and sorted by anchor, and a manifest, both in a folder
that all machines share; another session opens it there. A new batch is merged with the runs bucket by bucket in the order
(anchor, runs before batch, doc_id), for which the runs aren't shuffled again; in that order the first row that has a window is its
first place, and every later one repeats it. The batch becomes a run of its own, with the windows that it is the first to have, and
runs are compacted two by two before there are too many. A task streams through its sorted rows; what it holds are the windows of the
anchor at hand.

An anchor that very many documents have is dealt to SALTS parts by document, so that it isn't one task's. A window is then
first in its part at most; which of those are first of all is found by a grouping over the windows of such anchors.

Defined cases: null or empty texts have no words; a text of fewer than n words has no windows; a null doc_id counts as less
than all others; rows of one doc_id don't repeat each other, and are told apart by 31 bits of their text's hash;
repeated rows are each returned with the same result.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.operators.durable import without_shuffle_files

from .common import materialize, shared_dir, shuffle_partitions, text_key
from .travel import packed, unpacked
from .wordbytes import blocks, gram_hashes, mix, separators, whole_grams, word_hashes, words

_SPACE = separators("space")
_BYTES = 8
SALTS = 64
#: ah: the anchor's hash, salted if it is frequent, hot: then the hash itself. at: the tag of the document in the upper half, the first window's word in the lower.
ROW = "ah long, doc_id long, at long, sig binary, hot long"
#: A run's rows keep the windows that no earlier row has; late has a bit for each of the others.
RUN = f"{ROW}, late int"
COVERED = "doc_id long, tag int, first int, mask int"


def anchor_rows(docs: DataFrame, n: int, anchor: int, hot: tuple = ()) -> DataFrame:
    """ROW's columns: for each anchor occurrence its windows, from the one at word `first` on. hot: anchors to be salted."""
    reach = n - anchor + 1
    frequent = np.sort(np.array(hot, np.int64))

    def run(batches):
        for batch in batches:
            tags = batch.column("tag").to_numpy().astype(np.int64)
            ids = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
            for b in blocks(batch.column("text")):
                w = words(b, _SPACE)
                at = whole_grams(w, n)
                if not len(at):
                    continue
                h = word_hashes(b.data, w)
                g, sig = gram_hashes(h, anchor), gram_hashes(h, n)[at]
                best, arg = g[at], at.copy()
                for i in range(1, reach):
                    x = g[at + i]
                    less = x < best
                    best[less] = x[less]
                    arg[less] = at[less] + i
                new = np.flatnonzero(np.concatenate([[True], (arg[1:] != arg[:-1]) | (at[1:] != at[:-1] + 1)]))
                raw = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :_BYTES]
                offsets = np.append(new, len(at)).astype(np.int32) * _BYTES
                row = w.row[at[new]]
                doc = pa.array(b.first + row)
                ah = best[new].view(np.int64)
                often = np.isin(ah, frequent)
                salted = mix(ah.view(np.uint64) ^ (mix(ids[b.first + row]) % np.uint64(SALTS) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(often, salted, ah)),
                        batch.column("doc_id").take(doc),
                        pa.array(tags[b.first + row] << 32 | (at[new] - w.first[row])),
                        pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]),
                        pa.array(ah, mask=~often),
                    ],
                    names=["ah", "doc_id", "at", "sig", "hot"],
                )

    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(F.col("text")).alias("tag"), "text")
    return tagged.mapInArrow(run, ROW)


def tag_of(text):
    """31 bits of the text's hash, by which texts of one doc_id are told apart."""
    return text_key(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, row of it) of all windows of the rows of a batch."""
    sig = batch.column("sig")
    _, offsets, data = sig.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(sig) + 1, sig.offset * 4).astype(np.int64)
    raw = np.zeros(((offsets[-1] - offsets[0]) // _BYTES, 8), np.uint8)
    raw[:, :_BYTES] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _BYTES)
    return raw.view("<u8").reshape(-1), np.repeat(np.arange(len(sig)), np.diff(offsets) // _BYTES)


def _stream(batches, order: str):
    """For batches sorted by anchor and place: (batch, window hashes, row of each, whether an earlier place has it).

    `order` is the column by which places differ: windows of the same value don't repeat each other.
    """
    last, keys, firsts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ah = batch.column("ah").to_numpy().view(np.uint64)
        place = batch.column(order).to_numpy()
        wh, row = _windows(batch)
        key, at = mix(mix(ah)[row] ^ wh * np.uint64(0x9E3779B97F4A7C15)), place[row]
        uniq, index, back = np.unique(key, return_index=True, return_inverse=True)
        first = at[index]
        if last is not None and ah[0] == last and len(keys):
            pos = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
            known = keys[pos] == uniq
            first[known] = firsts[pos[known]]
        yield batch, wh, row, at > first[back]
        tail = ah[row[index]] == ah[-1]
        if last is not None and last == ah[-1] and len(keys):
            fresh = ~np.isin(uniq, keys)
            tail &= fresh
            keys, firsts = np.concatenate([keys, uniq[tail]]), np.concatenate([firsts, first[tail]])
            sort = np.argsort(keys)
            keys, firsts = keys[sort], firsts[sort]
        else:
            keys, firsts = uniq[tail], first[tail]
        last = ah[-1]


def _sigs(row: np.ndarray, wh: np.ndarray, rows: int) -> pa.Array:
    """Binary column of so many rows: the window hashes of each."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32) * _BYTES
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(wh.astype("<u8")).tobytes())])


def _merged(batches):
    """RUN's rows of those that are new among sorted rows of runs and batch."""
    for batch, wh, row, late in _stream(batches, "place"):
        new = ~batch.column("old").to_numpy(zero_copy_only=False)
        if not new.any():
            continue
        start = np.searchsorted(row, np.arange(batch.num_rows))
        bit = np.where(late, 1 << np.minimum(np.arange(len(row)) - start[row], 30), 0)
        mask = np.bincount(row, bit, batch.num_rows).astype(np.int32)
        some = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        stay = ~late & new[row]
        take = pa.array(some)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("ah", "doc_id", "at")], _sigs(number[row[stay]], wh[stay], len(some)), batch.column("hot").take(take), pa.array(mask[some])], names=["ah", "doc_id", "at", "sig", "hot", "late"])


def _single(batches):
    """(hot, wh, doc_id, tag, first, mask) of the windows that a run's rows keep, one by one."""
    for batch in batches:
        wh, row = _windows(batch)
        late = batch.column("late").to_numpy().astype(np.int64)
        free = (~late[:, None] >> np.arange(31)) & 1 == 1  # a row's windows in order are its free bits
        place = np.cumsum(free, 1)
        nth = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row] + 1
        word = (place[row] < nth[:, None]).sum(1)
        at, take = batch.column("at").to_numpy()[row], pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("hot").take(take), pa.array(wh.view(np.int64)), batch.column("doc_id").take(take), pa.array((at >> 32).astype(np.int32)), pa.array(((at & 0xFFFFFFFF) + word).astype(np.int32)), pa.array(np.ones(len(row), np.int32))],
            names=["hot", "wh", "doc_id", "tag", "first", "mask"],
        )


def _kept(batches):
    """RUN's rows without the windows that an earlier row has; rows without windows go."""
    seen = 0

    def number():
        nonlocal seen
        for batch in batches:
            yield batch.append_column("number", pa.array(np.arange(seen, seen + batch.num_rows)))
            seen += batch.num_rows

    for batch, wh, row, late in _stream(number(), "number"):
        row, wh = row[~late], wh[~late]
        some = np.unique(row)
        take = pa.array(some)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("ah", "doc_id", "at")], _sigs(np.searchsorted(some, row), wh, len(some)), batch.column("hot").take(take), pa.array(np.zeros(len(some), np.int32))], names=["ah", "doc_id", "at", "sig", "hot", "late"])


def frequent_anchors(docs: DataFrame, n: int, anchor: int, share: float = 0.001, fraction: float = 0.01, least: int = 64) -> tuple:
    """Anchors with more than this share of a sample's rows, fewer than 1 / share. Which they are changes how work is dealt out, not what comes of it."""
    rows = anchor_rows(docs.select("doc_id", "text").sample(fraction, 1), n, anchor).groupBy("ah").agg(F.count("*").alias("n"))
    counted = materialize(rows, "anchor-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return tuple(r["ah"] for r in counted.filter(F.col("n") > max(least, share * total)).select("ah").collect())


@dataclass
class WindowIndex:
    """Sorted runs of window fingerprints and their manifest in a folder that all machines share."""

    spark: SparkSession
    folder: str
    n: int = 13
    anchor: int = 3
    buckets: int = 200
    max_runs: int = 3
    hot: tuple = ()
    runs: list[str] = field(default_factory=list)
    version: int = 0

    @staticmethod
    def create(spark: SparkSession, n: int = 13, anchor: int = 3, hot: tuple = (), folder: str | None = None) -> WindowIndex:
        return WindowIndex(spark, folder or f"{shared_dir(spark)}/window-index-{uuid.uuid4().hex}", n, anchor, shuffle_partitions(spark), hot=tuple(hot))

    @staticmethod
    def open(spark: SparkSession, folder: str) -> WindowIndex:
        """The index as its newest manifest has it."""
        m = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
        index = WindowIndex(spark, folder, m["n"], m["anchor"], m["buckets"], hot=tuple(m["hot"]), runs=list(m["runs"]), version=m["version"])
        for run in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({RUN.replace(' long', ' bigint')}) USING parquet OPTIONS (path '{folder}/{run}') CLUSTERED BY (ah) SORTED BY (ah) INTO {m['buckets']} BUCKETS")
        return index

    def _write(self, rows: DataFrame) -> str:
        """A new run of rows that are dealt to buckets and sorted."""
        name = f"window_run_{uuid.uuid4().hex}"
        with without_shuffle_files(self.spark):
            rows.write.bucketBy(self.buckets, "ah").sortBy("ah").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _publish(self, runs: list[str], gone: list[str] = ()) -> None:
        """A manifest with these runs; then what the runs that are gone hold is removed."""
        self.runs, self.version = runs, self.version + 1
        row = [(self.n, self.anchor, self.buckets, list(self.hot), runs)]
        self.spark.createDataFrame(row, "n int, anchor int, buckets int, hot array<long>, runs array<string>").coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            self.spark.createDataFrame([], RUN).write.mode("overwrite").parquet(f"{self.folder}/{run}")

    def _sorted(self, rows: DataFrame, *order: str) -> DataFrame:
        """rows with all of an anchor in one task, in this order. Tables that are bucketed stay where they are."""
        return rows.withColumn("nth", F.row_number().over(W.partitionBy("ah").orderBy(*order))).filter("nth > 0")

    def add(self, docs: DataFrame) -> DataFrame:
        """COVERED's rows for docs(doc_id, text) against history and each other; docs become part of it."""
        if len(self.runs) >= self.max_runs:
            self.compact()
        rows = anchor_rows(docs, self.n, self.anchor, self.hot).repartition(self.buckets, "ah").withColumn("old", F.lit(False))
        for run in self.runs:
            rows = rows.unionByName(self.spark.table(run).filter("length(sig) > 0").drop("late").withColumn("old", F.lit(True)))
        # history comes first, then documents in order, null before all
        place = F.when(F.col("old"), F.lit(-(1 << 63))).otherwise(F.coalesce("doc_id", F.lit(-(1 << 63) + 1)))
        run = self._write(self._sorted(rows.withColumn("place", place), "place", "at").drop("nth").mapInArrow(_merged, RUN))
        new = self.spark.table(run)
        out = new.filter("late <> 0").select("doc_id", F.shiftright("at", 32).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("first"), F.col("late").alias("mask"))
        if self.hot:
            single = lambda t: t.filter("hot is not null and length(sig) > 0").mapInArrow(_single, f"hot long, wh long, {COVERED}")
            own = single(new).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63) + 1)))
            all_ = own.select("hot", "wh", "place")
            for r in self.runs:
                all_ = all_.unionByName(single(self.spark.table(r)).select("hot", "wh", F.lit(-(1 << 63)).alias("place")))
            first = all_.groupBy("hot", "wh").agg(F.min("place").alias("least"))
            out = out.unionByName(own.join(first, ["hot", "wh"]).filter("place > least").select("doc_id", "tag", "first", "mask"))
        out = materialize(out, "covered")
        self._publish([*self.runs, run])
        return out

    def compact(self) -> None:
        """The two newest runs become one, each window once."""
        two = self.runs[-2:]
        rows = None
        for run in two:
            t = self.spark.table(run).filter("length(sig) > 0")
            rows = t if rows is None else rows.unionByName(t)
        run = self._write(self._sorted(rows, "doc_id", "at").drop("nth").mapInArrow(_kept, RUN))
        self._publish([*self.runs[:-2], run], two)


def remove_covered(docs: DataFrame, covered: DataFrame, n: int, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """docs' columns keep with n_words, n_removed, kept_sha256 (and kept_text): the text without covered words."""
    keep = ["doc_id"] if keep is None else keep
    spans = covered.groupBy(F.col("doc_id").alias("c_doc"), F.col("tag").alias("c_tag")).agg(F.collect_list(F.struct("first", "mask")).alias("c_spans"))
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn("c_own", tag_of(F.col("text")))
    joined = packed(rows).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("c_doc")) & (F.col("c_own") == F.col("c_tag")), "left")

    def run(batches):
        for batch in batches:
            spans = batch.column("c_spans")
            flat, edges = spans.flatten(), np.zeros(batch.num_rows + 1, np.int64)
            first, mask = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            edges[1:] = np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            digest, texts = [""] * batch.num_rows, [""] * batch.num_rows
            whole = pa.array(unpacked(batch.column("text")), pa.large_string())
            for b in blocks(whole):
                w = words(b, _SPACE)
                lo, hi = edges[b.first], edges[b.first + b.rows]
                base = w.first[owner[lo:hi] - b.first] + first[lo:hi]
                cover = np.zeros(len(w) + 1, np.int64)
                for bit in range(n):
                    at = base[(mask[lo:hi] >> bit) & 1 == 1] + bit
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n, -1)
                stay = np.cumsum(cover[:-1]) == 0
                raw, ends = joined_words(b.data, w, stay)
                n_words[b.first : b.first + b.rows] = np.diff(w.first)
                gone = np.concatenate([[0], np.cumsum(~stay)])[w.first]
                n_removed[b.first : b.first + b.rows] = np.diff(gone)
                for r in range(b.rows):
                    text = raw[ends[r] : max(ends[r], ends[r + 1] - 1)]
                    digest[b.first + r] = hashlib.sha256(text).hexdigest()
                    if with_text:
                        texts[b.first + r] = text.decode("utf-8", "replace")
            cols = [*[whole.cast(pa.string()) if c == "text" else batch.column(c) for c in keep], pa.array(n_words), pa.array(n_removed), pa.array(digest)]
            names = [*keep, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return joined.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def joined_words(data: np.ndarray, w, stay: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the staying words, each with a space after it; where each row begins in that)."""
    length = np.where(stay, w.end - w.start + 1, 0)
    size = np.concatenate([[0], np.cumsum(length)])
    kept = length[stay]
    out = np.full(int(size[-1]), 0x20, np.uint8)
    total = int((kept - 1).sum())
    begin = size[:-1][stay]
    run = np.cumsum(kept - 1) - (kept - 1)
    step = np.arange(total)
    out[step + np.repeat(begin - run, kept - 1)] = data[step + np.repeat(w.start[stay] - run, kept - 1)]
    return out.tobytes(), size[w.first]


def dedup_substrings(docs: DataFrame, n: int = 13, batches: int = 4, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Removes each word in a window that also starts in a document with a smaller doc_id.

    docs are added to a new index in so many batches of ascending doc_id, of about the same number of documents; all of them become part of it.
    """
    ids = F.col("doc_id").cast("long")
    index = WindowIndex.create(docs.sparkSession, n, hot=frequent_anchors(docs, n, 3))
    ends = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.select(ids.alias("doc_id")).approxQuantile("doc_id", ends, 0.005))) if ends else []
    covered, below = None, None
    for i in range(len(cuts) + 1):
        mine = F.lit(True) if below is None else ids > below
        if i < len(cuts):
            below = int(cuts[i])
            mine = mine & ((ids <= below) | ids.isNull() if i == 0 else ids <= below)
        part = index.add(docs.filter(mine).select("doc_id", "text"))
        covered = part if covered is None else covered.unionByName(part)
    return remove_covered(docs, covered, n, keep, with_text)
