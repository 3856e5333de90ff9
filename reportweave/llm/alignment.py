"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked token pairs by external spill counting.

1. Blocks of documents are encoded by both. Within a block the pair-document records are sorted by pair (side-major: first by A's
   id), dealt to radixes of A's id, and spilled as zstd frames: a run has its distinct pairs with the number of documents that
   hold each (heads), and for each pair those documents with the number of links in them (records).
2. Up: runs of one radix are merged k at a time by a heap over their frames until one run a radix is left. That counts each pair over
   the corpus; as all pairs of an A id follow each other, its highest count is known when its group ends.
3. Down: counts and best marks stream back to the runs that were merged, to the first runs at last, whose records turn
   them into contributions to each document. Contributions of a run's radixes are summed and joined with what the documents have by themselves.

A pair is sent once for each run, however many documents hold it, and a merge has about FAN_IN runs: so no pair, id or document, however
frequent, makes a task grow. A task holds a block of documents (or the longest text) or, going down, the distinct pairs of a radix.

Texts that are null, empty, or that one tokenizer doesn't give back byte for byte have no tokens. Each row is a document of its own, also if
repeated. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .word_tokens import ByteBpe, WordMemo, byte_level, forget, once, public_path

BLOCK_CHARS = 1 << 22
RADIXES = 16
FAN_IN = 64
#: Pairs in a frame: what a merge holds of each run.
FRAME = 8192
_RUN = "run long, radix int, heads binary, records binary, docs binary"
_OWN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Encodes a text that begins with the space by both tokenizers and links the tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteBpe(a_path, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        special = self.a.tokenizer.get_added_tokens_decoder()
        byte = {c: b for b, c in enumerate(byte_level())}
        self.a_bytes = {i: t.encode() if i in special else bytes(byte[c] for c in t) for t, i in self.a.tokenizer.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes] | None]:
        """For each text: groups, counts of A tokens, B tokens and groups, link keys; None where it doesn't come back."""
        theirs = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [self.align(t.encode(), x, y) for t, x, y in zip(texts, self.a.ids(texts), theirs)]

    def align(self, raw: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes, bytes] | None:
        a_parts, b_parts = [self.a_bytes[x] for x in a], [self.b_bytes[y] for y in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return None
        groups, keys, i, j, i0, j0 = [], [], 0, 0, 0, 0
        a_end, b_end = len(a_parts[0]), len(b_parts[0])
        while True:
            keys.append(a[i] << 32 | b[j])
            if a_end == b_end:
                groups.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0 : j + 1]))}")
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                i0, j0 = i, j
                a_end, b_end = a_end + len(a_parts[i]), b_end + len(b_parts[j])
            elif a_end < b_end:
                i += 1
                a_end += len(a_parts[i])
            else:
                j += 1
                b_end += len(b_parts[j])
        return ";".join(groups).encode(), struct.pack("<3q", len(a), len(b), len(groups)), np.array(keys, "<i8").tobytes()


def _memo(a_path: str, b_path: str) -> WordMemo:
    return once(("align", a_path, b_path), lambda: WordMemo(Aligner(a_path, b_path), 200_000))


# Runs: heads are frames of sorted pairs with counts.


def put_frames(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    import zstandard

    press, out = zstandard.ZstdCompressor(level=3), []
    for keys, counts in chunks:
        for lo in range(0, len(keys), FRAME):
            k, c = keys[lo : lo + FRAME], counts[lo : lo + FRAME]
            raw = np.diff(k, prepend=np.int64(0)).astype("<i8").tobytes() + c.astype("<i8").tobytes()
            # bytes of equal weight lie together
            frame = press.compress(np.frombuffer(raw, np.uint8).reshape(-1, 8).T.tobytes())
            out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def get_frames(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    import zstandard

    press, at = zstandard.ZstdDecompressor(), 0
    while at < len(raw):
        (size,) = struct.unpack_from("<I", raw, at)
        flat = np.frombuffer(press.decompress(raw[at + 4 : at + 4 + size]), np.uint8)
        both = np.ascontiguousarray(flat.reshape(8, -1).T).view("<i8").reshape(-1)
        at += 4 + size
        half = len(both) // 2
        yield np.cumsum(both[:half]), both[half:]


def merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge: the heap says whose frame ends first; up to there all runs' pairs are known and counted."""
    held, heap = {}, []

    def load(r: int) -> None:
        frame = next(runs[r], None)
        if frame is None:
            held.pop(r, None)
        else:
            held[r] = frame
            heapq.heappush(heap, (int(frame[0][-1]), r))

    for r in range(len(runs)):
        load(r)
    while heap:
        cut, _ = heap[0]
        keys, counts = [], []
        for r, (k, c) in held.items():
            n = int(np.searchsorted(k, cut, "right"))
            if n:
                keys.append(k[:n])
                counts.append(c[:n])
                held[r] = k[n:], c[n:]
        while heap and heap[0][0] == cut:
            load(heapq.heappop(heap)[1])
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        yield pairs, total


def marked(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts doubled, plus one where a count is the highest of its A id. An id's group is held until the next one begins."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = k >> 32
        first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        top = np.repeat(np.maximum.reduceat(c, first), np.diff(np.r_[first, len(k)]))
        return k, 2 * c + (c == top)

    for k, c in chunks:
        keys, counts = np.r_[keys, k], np.r_[counts, c]
        n = int(np.searchsorted(keys, keys[-1] >> 32 << 32))
        if n:
            yield done(keys[:n], counts[:n])
            keys, counts = keys[n:], counts[n:]
    if len(keys):
        yield done(keys, counts)


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _open(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def spill(doc_of: np.ndarray, keys: np.ndarray, n_docs: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, heads, records) of a block's links."""
    pairs, at = np.unique(keys, return_inverse=True)
    both, links = np.unique(at * np.int64(n_docs) + doc_of, return_counts=True)
    pair_of, doc = both // n_docs, both % n_docs
    holders = np.bincount(pair_of, minlength=len(pairs))
    radix = (pairs >> 32) % RADIXES
    for r in np.unique(radix).tolist():
        own = radix == r
        of = own[pair_of]
        heads = put_frames(iter([(pairs[own], holders[own].astype(np.int64))]))
        records = np.stack([doc[of], links[of]]).astype("<u4")
        yield r, heads, _press(np.ascontiguousarray(records.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes())


def get_records(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(_open(raw), np.uint8).reshape(2, 4, -1)
    both = np.ascontiguousarray(flat.transpose(0, 2, 1)).view("<u4")
    return both[0].reshape(-1), both[1].reshape(-1)


def _blocks(column: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    lo, held, own = 0, 0, []
    for k, t in enumerate(column.to_pylist()):
        own.append(t or "")
        held += len(own[-1])
        if held >= size:
            yield lo, own
            lo, held, own = k + 1, 0, []
    if own:
        yield lo, own


def runs_of(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Runs of blocks of documents. The row of radix -1 has what the documents have by themselves, as an Arrow table."""

    def run(batches):
        memo, number = _memo(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for first, texts in _blocks(batch.column("text"), block_chars):
                own, keys, sizes = [], [], []
                for lo in range(0, len(texts), 256):
                    some = texts[lo : lo + 256]
                    for t, parts in zip(some, memo([" " + t if t else "" for t in some])):
                        doc_id = ids[first + len(own)]
                        if not parts or None in parts:
                            own.append((doc_id, 0, 0, 0, 0, ""))
                            sizes.append(0)
                            continue
                        counts = np.frombuffer(b"".join([p[1] for p in parts]), "<i8").reshape(-1, 3).sum(0).tolist()
                        link = b"".join([p[2] for p in parts])
                        own.append((doc_id, *counts, len(link) // 8, hashlib.sha256(b";".join([p[0] for p in parts])).hexdigest()))
                        keys.append(link)
                        sizes.append(len(link) // 8)
                table = pa.table([pa.array(c, k) for c, k in zip(zip(*own), [pa.int64()] * 5 + [pa.string()])], names=list(_OWN))
                rows = [(number, -1, None, None, _table_bytes(table))]
                doc_of = np.repeat(np.arange(len(own)), sizes)
                if len(doc_of):
                    rows += [(number, r, h, x, None) for r, h, x in spill(doc_of, np.frombuffer(b"".join(keys), "<i8"), len(own))]
                yield _rows(rows, _RUN)
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, _RUN)


_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return _press(sink.getvalue().to_pybytes())


_NODE = "run long, radix int, heads binary"


def _parent(groups: int):
    return F.pmod(F.xxhash64("run"), F.lit(groups)).alias("parent")


def _merged(runs: DataFrame, groups: int) -> DataFrame:
    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forget()
        heads = put_frames(merge([get_frames(h) for h in table.column("heads").to_pylist()]))
        return pa.Table.from_batches([_rows([(key[0].as_py(), key[1].as_py(), heads)], _NODE)])

    return runs.select(_parent(groups), "radix", "heads").groupBy("parent", "radix").applyInArrow(join, _NODE)


def _marked(top: DataFrame) -> DataFrame:
    def mark(batches):
        for batch in batches:
            for run, radix, heads in zip(*(batch.column(c).to_pylist() for c in ("run", "radix", "heads"))):
                yield _rows([(run, radix, put_frames(marked(get_frames(heads))))], _NODE)

    return top.mapInArrow(mark, _NODE)


def _found(keys: np.ndarray, pairs: np.ndarray, answers: np.ndarray) -> np.ndarray:
    return answers[np.searchsorted(pairs, keys)]


def _all(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    frames = list(get_frames(raw))
    return np.concatenate([k for k, _ in frames]), np.concatenate([c for _, c in frames])


def _answered(runs: DataFrame, groups: int, above: DataFrame, last: bool) -> DataFrame:
    """Heads of runs with the marked counts of the run they were merged into; of first runs (last) what they give to documents."""

    def give(children: pa.Table, parent: pa.Table) -> pa.Table:
        pairs, answers = _all(parent.column("heads")[0].as_py())
        out = []
        for k in range(children.num_rows):
            run, radix = children.column("run")[k].as_py(), children.column("radix")[k].as_py()
            keys, holders = _all(children.column("heads")[k].as_py())
            own = _found(keys, pairs, answers)
            if not last:
                out.append((run, radix, put_frames(iter([(keys, own)]))))
                continue
            doc, links = get_records(children.column("records")[k].as_py())
            each = np.repeat(own, holders)
            total = np.zeros((int(doc.max()) + 1, 2), np.int64)
            np.add.at(total[:, 0], doc, links.astype(np.int64) * (each & 1))
            np.add.at(total[:, 1], doc, links.astype(np.int64) * (each >> 1))
            out.append((run, radix, _press(total.astype("<i8").tobytes())))
        return pa.Table.from_batches([_rows(out, _NODE)])

    own = runs.select("run", "radix", "heads", *(["records"] if last else []), _parent(groups)).groupBy("parent", "radix")
    parents = above.withColumnRenamed("run", "parent").groupBy("parent", "radix")
    return own.cogroup(parents).applyInArrow(give, _NODE)


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The documents of a run: its radixes' contributions and what they have by themselves."""
    radix = table.column("radix").to_pylist()
    own = pa.ipc.open_stream(_open(table.column("docs")[radix.index(-1)].as_py())).read_all()
    total = np.zeros((own.num_rows, 2), np.int64)
    for r, raw in zip(radix, table.column("heads").to_pylist()):
        if r >= 0:
            part = np.frombuffer(_open(raw), "<i8").reshape(-1, 2)
            total[: len(part)] += part
    cols = {n: own.column(n) for n in _OWN} | {"n_best": pa.array(total[:, 0]), "count_sum": pa.array(total[:, 1])}
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.table([cols[n] for n in names], names=names)


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_chars: int = BLOCK_CHARS, fan_in: int = FAN_IN) -> DataFrame:
    """For each document the numbers of tokens, groups, links and of links with an A id's most frequent B id, the sum of
    its links' counts, and the digest of its groups."""
    a_path, b_path = a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model")
    written = materialize(runs_of(docs, a_path, b_path, block_chars), "align-runs")
    first, own = written.filter("radix >= 0"), written.filter("radix < 0")
    levels, n = [], own.count()
    runs = first
    while n > 1 or not levels:
        n = -(-n // fan_in) or 1
        levels.append((runs, n))
        runs = materialize(_merged(runs, n), "align-merged")
    above = _marked(runs)
    for below, groups in reversed(levels[1:]):
        above = materialize(_answered(below, groups, above, last=False), "align-counts")
    given = _answered(first, levels[0][1], above, last=True)
    parts = given.select("run", "radix", "heads", F.lit(None).cast("binary").alias("docs")).unionByName(own.select("run", "radix", F.lit(None).cast("binary").alias("heads"), "docs"))
    return parts.groupBy("run").applyInArrow(_summed, RESULT)
