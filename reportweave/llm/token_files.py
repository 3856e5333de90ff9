"""Token ids of documents as binary files, and back.

1. Documents are put in order of doc_id (a range partitioning by doc_id, text hash and a salt, so that a doc_id or text which many
   rows have doesn't meet in one task), encoded, ended with `end_id`, and written as rows of at most about `file_ids` ids.
2. Ids are counted over all documents; the vocabulary bounds this table, which becomes the shared frequency table.
3. Each row becomes one file in `out_dir`, coded by `rans`. A file has a name of its own for each attempt, and the manifest,
   written by Spark, lists those of the attempts that counted. So a lost executor or a repeated task leaves an unlisted file at most.
4. The manifest's running sums say how many ids stand before a file. Reading gives each file to a task.

A file: MAGIC, number of blocks, the table's checksum; the blocks, each after its length; the index (for each document doc_id,
whether it is null, number of ids), its checksum and length. Numbers are little-endian.

Texts are whole: null is empty and has the end id only. Rows of equal doc_id follow each other by text hash; a null doc_id comes first.
Further columns are ignored. An empty table gives an empty manifest. Memory of a task: a file's ids, or the longest text's.
`out_dir` is any folder that pyarrow's file systems open on all machines.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rans
from .common import materialize, shared_dir, shuffle_partitions
from .word_tokens import ByteBpe, WordIds, forget, once, public_path

MAGIC = b"RWTOKEN1"
_TOP = struct.Struct("<8sII")
_TAIL = struct.Struct("<III")
FILE_IDS = 1 << 21
_BLOCK_CHARS = 1 << 20
#: Words that a worker remembers at most; with more, two workers and the JVM come near an executor's memory.
_WORDS = 200_000
_ROWS = "part int, seq int, n_ids long, doc_ids array<bigint>, lengths binary, ids binary"


def bpe_words(path: str) -> WordIds:
    """Ids as bytes (unsigned 32 bits each) of a tokenizers file, special tokens read as the library does by itself."""

    def make() -> WordIds:
        tokenizer = ByteBpe(path, special_as_text=False)
        return WordIds(lambda texts: [np.array(x, "<u4").tobytes() for x in tokenizer.ids(texts)], _WORDS)

    return once(("ids", path), make)


def _text_blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a megabyte, with the first's number."""
    lo, size, own = 0, 0, []
    for k, t in enumerate(texts.to_pylist()):
        own.append(t or "")
        size += len(own[-1])
        if size >= _BLOCK_CHARS:
            yield lo, own
            lo, size, own = k + 1, 0, []
    if own:
        yield lo, own


def encoded_rows(docs: DataFrame, words: Callable[[], WordIds], end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Rows of consecutive documents' ids, numbered by part and seq in the order of doc_id."""
    salt = "__salt"
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"), F.rand(7).alias(salt))
    parts = shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), "__hash", salt]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, seq, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        names, lengths, chunks, size = [], [], [], 0

        def row():
            cols = [[part], [seq], [size], [names], [np.array(lengths, "<u4").tobytes()], [b"".join(chunks)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "seq", "n_ids", "doc_ids", "lengths", "ids"])

        memo = words()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for first, texts in _text_blocks(batch.column("text")):
                found, many = memo(texts)
                at = np.cumsum(many) - many
                for k, (lo, n) in enumerate(zip(at.tolist(), many.tolist())):
                    own = found[lo : lo + n].tobytes() + end
                    if chunks and size + len(own) // 4 > file_ids:
                        yield row()
                        names, lengths, chunks, size, seq = [], [], [], 0, seq + 1
                    names.append(ids[first + k])
                    lengths.append(len(own) // 4)
                    chunks.append(own)
                    size += len(own) // 4
        if chunks:
            yield row()

    return ordered.mapInArrow(run, _ROWS)


def id_shares(rows: DataFrame) -> np.ndarray:
    """The shared frequency table. What comes to the driver is a number for each id that occurs, which the vocabulary bounds."""

    def count(batches):
        forget()
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                own = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    found = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0)
    counts[found["id"].to_numpy(np.int64)] = found["n"]
    return rans.normalize(counts)


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def file_bytes(doc_ids: list, lengths: bytes, ids: np.ndarray, table: rans.Table) -> bytes:
    blocks = rans.encode(ids, table)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    index = known + np.array([d is None for d in doc_ids], np.uint8).tobytes() + lengths
    body = b"".join(struct.pack("<I", len(b)) + b for b in blocks)
    return _TOP.pack(MAGIC, len(blocks), table.crc) + body + index + _TAIL.pack(len(doc_ids), len(index), zlib.crc32(index))


def file_content(raw: bytes, table: rans.Table, name: str = "") -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, all ids. Raises rans.Damaged where a checksum doesn't agree."""
    if len(raw) < _TOP.size + _TAIL.size:
        raise rans.Damaged(f"{name}: too short")
    magic, n_blocks, crc = _TOP.unpack_from(raw)
    n, size, index_crc = _TAIL.unpack_from(raw, len(raw) - _TAIL.size)
    if magic != MAGIC or crc != table.crc:
        raise rans.Damaged(f"{name}: not a file of this table")
    index = raw[len(raw) - _TAIL.size - size : len(raw) - _TAIL.size]
    if zlib.crc32(index) != index_crc or len(index) != size or size != 13 * n:
        raise rans.Damaged(f"{name}: index differs from its checksum")
    blocks, at = [], _TOP.size
    for _ in range(n_blocks):
        (long,) = struct.unpack_from("<I", raw, at)
        blocks.append(raw[at + 4 : at + 4 + long])
        at += 4 + long
    known, null = np.frombuffer(index, "<i8", n).tolist(), np.frombuffer(index, np.uint8, n, 8 * n)
    lengths = np.frombuffer(index, "<u4", n, 9 * n)
    return [None if x else d for d, x in zip(known, null)], lengths, rans.decode(blocks, table, name)


def write_files(docs: DataFrame, out_dir: str, words: Callable[[], WordIds], end_id: int, file_ids: int = FILE_IDS) -> tuple[DataFrame, np.ndarray]:
    """Writes the files. Returns the manifest (path, n_docs, n_ids, n_bytes, start: ids of all files before it) and the table."""
    rows = materialize(encoded_rows(docs, words, end_id, file_ids), "token-rows")
    shares = id_shares(rows)

    def write(batches):
        forget()
        store, folder = _open(out_dir)
        store.create_dir(folder, recursive=True)
        table = once(("table", shares.tobytes()), lambda: rans.Table.of(shares))
        for batch in batches:
            for part, seq, n_ids, doc_ids, lengths, ids in zip(*(batch.column(c) for c in ("part", "seq", "n_ids", "doc_ids", "lengths", "ids"))):
                raw = file_bytes(doc_ids.as_py(), lengths.as_py(), np.frombuffer(ids.as_buffer(), "<u4"), table)
                name = f"ids-{part.as_py():06}-{seq.as_py():06}-{uuid.uuid4().hex}.bin"
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(raw)
                cols = {"part": part, "seq": seq, "path": name, "n_docs": len(doc_ids), "n_ids": n_ids, "n_bytes": len(raw)}
                yield pa.RecordBatch.from_pylist([{k: v.as_py() if isinstance(v, pa.Scalar) else v for k, v in cols.items()}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    made = materialize(rows.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = made.join(parts, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return placed.select("path", "n_docs", "n_ids", "n_bytes", "start"), shares


def read_files(manifest: DataFrame, out_dir: str, shares: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of listed files. ids_crc32 is of ids as unsigned 32-bit integers."""

    def read(batches):
        store, folder = _open(out_dir)
        table = once(("table", shares.tobytes()), lambda: rans.Table.of(shares))
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{folder}/{path}") as f:
                    raw = f.read()
                doc_ids, lengths, ids = file_content(raw, table, path)
                ends = np.cumsum(lengths, dtype=np.int64)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    few = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return few.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS, out_dir: str | None = None) -> DataFrame:
    """Encodes documents with a byte-level tokenizers file, writes the ids' files and reads them back."""
    path = path or public_path("byte_bpe_50k.json")
    out_dir = out_dir or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    manifest, shares = write_files(docs, out_dir, lambda: bpe_words(path), end_id, file_ids)
    return read_files(manifest, out_dir, shares)
