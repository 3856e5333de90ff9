"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to one form: A-Z lower-cased, words as the contract defines them, each between single spaces. Every
window of n words of a benchmark item is a pattern of that form, so a byte occurrence is a word occurrence. Patterns
are put into classes by length; each class has a shift table over hashed blocks of bytes, buckets of patterns
by their suffix block, and a direct comparison. A block of text is searched by many cursors at once, each over
its own stretch of end positions, so that the shifts are taken in vectors.

Spark makes the items' windows and groups equal ones; the table is arrays: item text, where each window stands in it, and numbers of
its owners. Up to max_bytes of them form one table, for which documents are read once and not shuffled. A larger benchmark makes several
tables, of which one at a time is built and broadcast.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; a null item_id
counts as hit but isn't listed; repeated items and rows change nothing; documents of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordbytes import LOWER, blocks, separators, words

_SEP = separators("alnum")
_STRETCH = 2048
_TABLE_BITS = 18
_CHUNK = 1 << 17


def canonical(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each word in them, first word of each row): ' w1 w2 ... wn ' and a zero byte for each row."""
    data = LOWER[block.data]
    w = words(block, _SEP)
    length = w.end - w.start
    total = int(length.sum())
    out = np.full(total + len(w) + 2 * block.rows, 0x20, np.uint8)
    begin = np.cumsum(length) - length + np.arange(len(w)) + 2 * w.row + 1
    inside = ~_SEP[data]
    out[np.arange(total) + np.repeat(begin - (np.cumsum(length) - length), length)] = data[inside]
    ends = np.concatenate([[0], np.cumsum(length)])[w.first[1:]] + w.first[1:] + 2 * np.arange(1, block.rows + 1) - 1
    out[ends] = 0
    return out, begin, w.first


def item_pieces(benchmark: DataFrame, n: int, most: int = 4096) -> DataFrame:
    """(piece, items): items' texts in canonical form, in pieces of at most `most` words that overlap by n - 1, so that each window of n words lies in one; equal pieces are one.

    A text of fewer words is a piece and a window by itself. items are distinct ids as strings, without null.
    """

    def run(batches):
        for batch in batches:
            items, pieces = [], []
            names = batch.column("item").to_pylist()
            for blk in blocks(batch.column("text")):
                data, begin, first = canonical(blk)
                raw = data.tobytes()
                for r in range(blk.rows):
                    starts = begin[first[r] : first[r + 1]]
                    if not len(starts):
                        continue
                    edge = np.append(starts, raw.index(b"\0", int(starts[0])))
                    for i in range(0, max(1, len(starts) - n + 1), most - n + 1):
                        pieces.append(raw[int(edge[i]) - 1 : int(edge[min(i + most, len(starts))])])
                        items.append(names[blk.first + r])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "piece"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null")
    return rows.mapInArrow(run, "item string, piece binary").groupBy("piece").agg(F.array_sort(F.collect_set("item")).alias("items"))


def distinct_windows(pieces: DataFrame, n: int) -> DataFrame:
    """(piece_id, at, length, k, owners) of the windows in pieces(piece_id, piece): where one of equal windows stands, its bytes and words, and the pieces that hold it."""

    def run(batches):
        for batch in batches:
            for piece_id, piece in zip(batch.column("piece_id").to_pylist(), batch.column("piece").to_pylist()):
                space = np.flatnonzero(np.frombuffer(piece, np.uint8) == 0x20)
                k = min(n, len(space) - 1)
                at, end = space[: len(space) - k], space[k:] + 1
                found = [piece[a:b] for a, b in zip(at.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.full(len(at), piece_id)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), k, np.int32))], names=["window", "piece_id", "at", "k"])

    rows = pieces.select("piece_id", "piece").mapInArrow(run, "window binary, piece_id long, at int, k int")
    one = rows.groupBy("window").agg(F.min(F.struct("piece_id", "at", "k")).alias("x"), F.collect_set("piece_id").alias("owners"))
    return one.select("x.*", F.octet_length("window").alias("length"), "owners")


class WuManber:
    """Tables for the patterns text[start : start + length]; arrays only."""

    def __init__(self, text: bytes, start: np.ndarray, length: np.ndarray):
        self.text, self.start, self.length = text, start, length
        self.m = m = int(length.min())
        self.b = b = min(m, 6 if m >= 16 else 4 if m >= 8 else 2)
        self.bits = min(22, max(_TABLE_BITS, len(start).bit_length() + 1))
        self.weights = np.array([pow(0x9E3779B1, i, 1 << 32) | 1 for i in range(b)], np.uint32)
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        data, last = np.frombuffer(text, np.uint8), []
        for part in np.array_split(start, len(start) // _CHUNK + 1):
            head = data[part[:, None] + np.arange(m)]
            for j in range(b - 1, m):  # blocks that end at byte j of the head
                key = self._key(head[:, j - b + 1 : j + 1])
                np.minimum.at(self.shift, key, m - 1 - j)
            last.append(key)
        key = np.concatenate(last)
        #: Patterns by their suffix block, and where each block's begin.
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.first = np.searchsorted(key[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _key(self, block: np.ndarray) -> np.ndarray:
        h = (block.astype(np.uint32) + np.uint32(1)) @ self.weights
        h ^= h >> np.uint32(15)
        return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, data: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in data."""
        m, b = self.m, self.b
        pos = np.arange(m - 1, len(data), _STRETCH)
        stop = np.minimum(pos + _STRETCH, len(data))
        back, text = np.arange(b - 1, -1, -1), np.frombuffer(self.text, np.uint8)
        out = []
        while len(pos):
            key = self._key(data[pos[:, None] - back])
            step = self.shift[key]
            still = np.flatnonzero(step == 0)
            low, count = self.first[key[still]], self.first[key[still] + 1] - self.first[key[still]]
            if count.any():  # each position with each pattern of its bucket; two bytes are compared before the whole
                begin = np.repeat(pos[still] - m + 1, count)
                which = self.order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(begin))]
                s = self.start[which]
                alike = np.flatnonzero((data[begin + 1] == text[s + 1]) & (data[begin + m - 1] == text[s + m - 1]))
                near = (begin[alike].tolist(), which[alike].tolist(), s[alike].tolist(), self.length[which[alike]].tolist())
                out += [(at, i) for at, i, s0, n in zip(*near) if raw[at : at + n] == self.text[s0 : s0 + n]]
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(first, values) of a list column."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten()


class Benchmark:
    """The distinct windows of pieces, as one searcher for each class of lengths; what belongs to whom is kept in arrays of numbers."""

    def __init__(self, pieces: pa.Table, found: pa.Table):
        ids = pieces.column("piece_id").to_numpy()
        place = np.argsort(ids)
        texts = pieces.column("piece").to_pylist()
        begin = np.cumsum([0, *map(len, texts)])
        text = b"".join(texts)
        where = lambda x: place[np.searchsorted(ids, x, sorter=place)]
        start = begin[where(found.column("piece_id").to_numpy())] + found.column("at").to_numpy()
        length = found.column("length").to_numpy().astype(np.int32)
        self.k = found.column("k").to_numpy().astype(np.int32)
        self.owned, owners = _lists(found.column("owners"))
        self.owner = where(owners.to_numpy()).astype(np.int32)
        self.listed, items = _lists(pieces.column("items"))
        coded = items.dictionary_encode()
        self.item, self.names = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        kind = np.minimum(5, np.frexp(length.astype(float))[1])
        self.searchers = []
        for c in np.unique(kind):
            some = np.flatnonzero(kind == c)
            self.searchers.append((WuManber(text, start[some], length[some]), some.astype(np.int32)))

    def items(self, window: int) -> list[str]:
        pieces = self.owner[self.owned[window] : self.owned[window + 1]].tolist()
        return [self.names[int(i)].as_py() for p in pieces for i in self.item[self.listed[p] : self.listed[p + 1]]]


def _parts(benchmark: DataFrame, n: int, max_bytes: int) -> list[DataFrame]:
    """Pieces(piece_id, piece, items) in parts whose tables have about max_bytes at most, dealt by hash.

    A table holds a piece's bytes, its items, and for each word at most one window (start, length, words, class, order and list bounds: 32 bytes) and one owner (4 bytes).
    """
    pieces = materialize(item_pieces(benchmark, n).withColumn("piece_id", F.monotonically_increasing_id()), "leaks-pieces")
    words = F.octet_length("piece") - F.octet_length(F.translate(F.col("piece").cast("string"), " ", ""))
    cost = F.octet_length("piece") + 36 * words + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 8)
    total = pieces.agg(F.sum(cost.cast("long"))).first()[0] or 0
    groups = math.ceil(total / max_bytes)
    if groups < 2:
        return [pieces] * groups
    part = F.pmod(F.xxhash64("piece"), F.lit(groups))
    return [pieces.filter(part == r["g"]) for r in pieces.select(part.alias("g")).distinct().collect()]


def _search(block, table: Benchmark | None) -> tuple[np.ndarray, np.ndarray, dict]:
    """(first word of each row, how many windows cover each word, items found by row) of a block."""
    data, begin, first = canonical(block)
    raw = data.tobytes()
    cover, found = np.zeros(len(begin) + 1, np.int64), defaultdict(set)
    for searcher, number in table.searchers if table else ():
        for start, i in searcher.find(data, raw):
            at, window = int(np.searchsorted(begin, start + 1)), int(number[i])
            cover[at] += 1
            cover[at + int(table.k[window])] -= 1
            found[int(np.searchsorted(first, at, "right")) - 1].add(window)
    named = {w: table.items(w) for w in set().union(*found.values())} if found else {}
    return first, np.cumsum(cover[:-1]), {r: {x for w in some for x in named[w]} for r, some in found.items()}


def _hits(docs: DataFrame, shared) -> DataFrame:
    """(row_id, words, items) of docs(row_id, text) with hits: the numbers of the words that are hit, and the items."""

    def run(batches):
        for batch in batches:
            ids, words, items = [], [], []
            for b in blocks(batch.column("text")):
                first, cover, found = _search(b, shared.value)
                for r, names in found.items():
                    ids.append(batch.column("row_id")[b.first + r].as_py())
                    words.append(np.flatnonzero(cover[first[r] : first[r + 1]]).astype(np.int32))
                    items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row_id", "words", "items"])

    return docs.mapInArrow(run, "row_id long, words array<int>, items array<string>")


def _digest(names: list) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 256 << 20, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id unless said otherwise) with RESULT's columns, one row for each row of docs.

    max_bytes bounds the tables that the driver builds and tasks search at once, by the measured size of their arrays: 32 MB of items make one
    of about 200 MB. Windows are made, grouped and given their owners by Spark. A larger benchmark is searched part by part: each part's
    table is built, broadcast, used to the end and given up before the next, and what the parts found is put together by document.
    """
    keep = ["doc_id"] if keep is None else keep
    spark, parts = docs.sparkSession, _parts(benchmark, n, max_bytes)
    names = [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    table = lambda part: spark.sparkContext.broadcast(Benchmark(part.toArrow(), distinct_windows(part, n).toArrow()))
    if len(parts) < 2:
        shared, extra = table(parts[0]) if parts else None, []
        inner = docs.select(*dict.fromkeys([*keep, "text"]))
        found = inner
    else:
        keyed = materialize(docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], "text").withColumn("row_id", F.monotonically_increasing_id()), "leaks-docs")
        hits = None
        for part in parts:
            one = table(part)
            some = materialize(_hits(keyed.select("row_id", "text"), one), "leaks-hits")
            one.destroy()
            hits = some if hits is None else hits.unionByName(some)
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        shared, extra = None, ["words", "items"]
        inner = docs.select(*keep)
        found = keyed.join(hits.groupBy("row_id").agg(union("words"), union("items")), "row_id", "left")

    def run(batches):
        for batch in batches:
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            items: list = [()] * batch.num_rows
            for b in blocks(batch.column("text")):
                first, cover, hit = _search(b, shared.value if shared else None)
                n_words[b.first : b.first + b.rows] = np.diff(first)
                if hit:
                    hits = np.concatenate([[0], np.cumsum(cover > 0)])
                    n_hit[b.first : b.first + b.rows] = np.diff(hits[first])
                    for r, some in hit.items():
                        items[b.first + r] = some
            if extra:
                n_hit = batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                items = [x or () for x in batch.column("items").to_pylist()]
            kept = [batch.column(f"kept_{i}" if extra else c) for i, c in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array(n_hit > 0)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name in keep)
    return found.mapInArrow(run, f"{fields}, {RESULT}")
