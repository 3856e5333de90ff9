"""Periodic runs of words, found in tiles of documents scale by scale.

A run is a stretch of words whose smallest period q divides it: words q apart are identical, its length is at least
max(24, 3 q), and no neighbouring word extends it. Write e(k) for "word k equals word k + p". A run of period p has a stretch of
e true of at least 2 p places (16 for p below 8). With cells of s = max(8, 2**octave) <= max(8, p) words, it fills a whole cell.

1. Each document is exploded into tiles, one set for each octave of periods [s, 2 s) (the first: 1 to 15). A tile has the
   words of its cells, s words before and 3 s after them. Octaves go on while 3 s words exist.
2. Tiles are solved independently. At a cell's boundary m, p is a candidate if the block of s words at m recurs at m + p (hashes
   of blocks, made by doubling, compared for all m and p at once). Candidates that a divisor of p explains are dropped: a window of
   p words with period d, d dividing p, has the whole run follow d. For the others the values of the two Z-functions of the boundary,
   how far e holds forward and backward of m, come from comparing the words themselves, up to a cell beyond the own one.
3. Fragments (document, period, stretch of e) are shuffled by document and period, and those that touch are stitched.
4. Stretches that are long enough are runs; each document's runs meet its text again to give the collapsed text.

Texts above LONG_BYTES have their tiles dealt to all tasks; others are solved where they were read. Only fragments are shuffled, and
texts once, compressed. Rows with equal doc_id and text have equal results; their fragments are merged before the shuffle.
A null text has no words; a null doc_id has no decimal form, so its words aren't rewritten. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .travel import packed, unpacked
from .wordbytes import mix

#: Words are what is left between these.
_SPACES = {c: " " for c in range(0x09, 0x0E)}
FIRST_CELL = 8
LEAST_LENGTH = 24
LONG_BYTES = 1 << 16
#: Words of cells in a tile at least; of larger cells there are four.
TILE_WORDS = 1 << 13
#: Words that are solved at once.
_TAPE = 1 << 19
_KEYS = "doc_id long, text_hash long"
_TILES = _KEYS + ", octave int, at long, words binary"
_FRAGMENTS = _KEYS + ", period long, begin long, end long"


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def rewritten(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place after the rewriting that a tenth of documents get."""
    places = np.arange(n)
    if doc_id is None or n == 0:
        return places
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def tiles(ids: np.ndarray, tile_words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(octave, place of the first word, words) of the overlapping tiles of a document's numbered words."""
    n, octave = len(ids), 3
    while n >= max(LEAST_LENGTH, 3 << octave):
        s = 1 << octave
        stride = max(tile_words // s, 4) * s
        for c in range(0, n - s, stride):
            lo, hi = max(0, c - s), min(n, c + stride + 3 * s)
            yield octave, lo, ids[lo:hi]
        octave += 1


def _tape(parts: list[np.ndarray], s: int) -> tuple[np.ndarray, np.ndarray]:
    """Tiles one after another, each from a multiple of s on and with places that equal nothing behind it."""
    sizes = np.array([(len(p) // s + 1) * s for p in parts])
    begins = np.cumsum(sizes) - sizes
    tape = -1 - np.arange(sizes.sum(), dtype=np.int64)
    for b, p in zip(begins.tolist(), parts):
        tape[b : b + len(p)] = p
    return tape, begins


def _block_hashes(tape: np.ndarray, s: int) -> np.ndarray:
    h, size = mix(tape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), 1
    while size < s:
        h = mix(h[:-size] * np.uint64(0xD6E8FEB86659FD93) + (h[size:] ^ (h[size:] >> np.uint64(29))))
        size *= 2
    return h


def _smallest_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to n."""
    out = np.arange(n + 1)
    for r in range(int(n**0.5), 1, -1):
        out[r * r :: r] = np.minimum(out[r * r :: r], r)
    return out


def solve(parts: list[np.ndarray], octave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of tiles of one octave: number of the tile, period, and the stretch of e within the tile."""
    s = 1 << octave
    tape, begins = _tape(parts, s)
    none = (np.zeros(0, np.int64),) * 4
    if len(tape) < 2 * s:
        return none
    h = _block_hashes(tape, s)
    rows = len(h) // s
    grid, first = h[: rows * s].reshape(rows, s), h[::s]
    r, c = np.nonzero(grid[1:] == first[: rows - 1, None])
    m, p = r * s, c + s
    tail = h[rows * s :]  # the last row of blocks isn't full
    if rows and len(tail):
        c = np.flatnonzero(tail == first[rows - 1])
        m, p = np.r_[m, np.full(len(c), (rows - 1) * s)], np.r_[p, c + s]
    if octave == 3:
        r, c = np.nonzero(grid[:, 1:] == first[:rows, None])
        m, p = np.r_[m, r * s], np.r_[p, c + 1]
        if len(tail) > 1:
            c = np.flatnonzero(tail[1:] == tail[0]) + 1
            m, p = np.r_[m, np.full(len(c), rows * s)], np.r_[p, c]
    if not len(m):
        return none
    # what a divisor p / r of the period explains, r prime
    factors, left, keep = _smallest_factors(2 * s), p.copy(), np.ones(len(p), bool)
    while True:
        at = np.flatnonzero(keep & (left > 1))
        if not len(at):
            break
        prime = factors[left[at]]
        left[at] //= prime
        mm, d = m[at], p[at] // prime
        over = p[at] - d  # blocks at 0, s and here cover the s + p - d places to compare
        same = np.ones(len(at), bool)
        for t in (np.zeros_like(over), np.minimum(s, over), over):
            same &= h[mm + t] == h[mm + t + d]
        keep[at[same]] = False
    m, p = m[keep], p[keep]
    out = [np.zeros((3, 0), np.int64)]
    step = max(1, (1 << 21) // (3 * s))
    reach = np.arange(-s, 2 * s)
    for lo in range(0, len(m), step):
        mm, pp = m[lo : lo + step, None], p[lo : lo + step, None]
        k = mm + reach
        inside = (k >= 0) & (k + pp < len(tape))
        e = inside & (tape[np.where(inside, k, 0)] == tape[np.where(inside, k + pp, 0)])
        e &= ~(inside & (tape[np.where(inside, k, 0)] < 0))
        whole = e[:, s : 2 * s].all(1)
        forward = np.where(e[:, 2 * s :].all(1), s, np.argmin(e[:, 2 * s :], 1))
        back = np.where(e[:, :s].all(1), s, np.argmin(e[:, s - 1 :: -1][:, :s], 1))
        mm = mm[:, 0]
        out.append(np.stack([pp[:, 0], mm - back, mm + s + forward])[:, whole])
    p, k0, k1 = np.concatenate(out, 1)
    tile = np.searchsorted(begins, k0, "right") - 1
    order = np.lexsort((k0, p, tile))
    tile, p, k0, k1 = tile[order], p[order], k0[order], k1[order]
    new = np.r_[True, (tile[1:] != tile[:-1]) | (p[1:] != p[:-1]) | (k0[1:] > k1[:-1])] if len(p) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(p)] - 1 if len(starts) else starts
    return tile[starts], p[starts], k0[starts] - begins[tile[starts]], k1[ends] - begins[tile[starts]]


def explode_tiles(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """Tiles of (doc_id, text_hash, text). Words are numbered within their document."""

    def run(batches):
        for batch in batches:
            cols, size = [[], [], [], [], []], 0
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text").to_pylist()):
                own = words_of(text)
                if len(own) < LEAST_LENGTH:
                    continue
                numbers: dict[str, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int32)[rewritten(doc_id, len(own))]
                for octave, at, part in tiles(ids, tile_words):
                    for c, v in zip(cols, (doc_id, key, octave, at, part.tobytes())):
                        c.append(v)
                    size += len(part)
                    if size >= _TAPE:
                        yield _record(_TILES, cols)
                        cols, size = [[], [], [], [], []], 0
            if cols[0]:
                yield _record(_TILES, cols)

    return docs.mapInArrow(run, _TILES)


_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _record(schema: str, cols: list) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def solve_tiles(tiled: DataFrame) -> DataFrame:
    """Fragments of tiles, in places of their documents."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_octave: dict[int, list[tuple]] = {}
        for row in rows:
            by_octave.setdefault(row[2], []).append(row)
        for octave, own in by_octave.items():
            tile, p, k0, k1 = solve([np.frombuffer(x[4], np.int32) for x in own], octave)
            at = np.array([x[3] for x in own], np.int64)[tile]
            if len(tile):
                yield _record(_FRAGMENTS, [[own[t][0] for t in tile.tolist()], [own[t][1] for t in tile.tolist()], p, k0 + at, k1 + at])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "octave", "at", "words"))):
                rows.append(row)
                size += len(row[4]) // 4
                if size >= _TAPE:
                    yield from flush(rows)
                    rows, size = [], 0
        yield from flush(rows)

    return tiled.mapInArrow(run, _FRAGMENTS)


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs: doc_id, text_hash, start, length, period."""
    own = W.partitionBy("doc_id", "text_hash", "period").orderBy("begin", "end")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    islands = (
        fragments.distinct()
        .withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(own))
        .groupBy("doc_id", "text_hash", "period", "island")
        .agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin") + F.col("period")).alias("length"))
    )
    return islands.filter(F.col("length") >= F.greatest(F.lit(LEAST_LENGTH), 3 * F.col("period"))).select("doc_id", "text_hash", "start", "length", "period")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _report(doc_id: int | None, text: str | None, runs: list[tuple[int, int, int]]) -> tuple:
    """runs: (start, length, period) in order of start, then period."""
    own = words_of(text)
    own = [own[i] for i in rewritten(doc_id, len(own)).tolist()]
    if not runs:
        return 0, None, None, None, None, _sha(""), _sha(" ".join(own))
    best = runs[0]
    for r in runs[1:]:  # exact: length / period, then the smallest start, then period
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = np.zeros(len(own) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone)[: len(own)] == 0).tolist()
    return len(runs), *best, 1000 * best[1] // best[2], _sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), _sha(" ".join([own[i] for i in kept]))


_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def runs_of(docs: DataFrame, long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS) -> DataFrame:
    """All runs of all documents: doc_id, text_hash, start, length, period."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    here = explode_tiles(keyed.filter(~is_long), tile_words)
    dealt = explode_tiles(keyed.filter(is_long), tile_words).repartition(shuffle_partitions(docs.sparkSession), "doc_id", "text_hash", "octave", "at")
    return stitched(solve_tiles(here).unionByName(solve_tiles(dealt)))


def collapse(docs: DataFrame, long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS) -> DataFrame:
    """For each document its runs' number and digest, its strongest run, and the digest of its words without repetitions."""
    runs = runs_of(docs, long_bytes, tile_words).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = materialize(runs, "periodic-runs").withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    # a merge at every size: a broadcast would depend on how many documents have runs
    joined = packed(keyed).join(runs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = batch.column("runs").to_pylist()
            out = [(d, *_report(d, t, [(r["start"], r["length"], r["period"]) for r in own or []])) for d, t, own in zip(ids, unpacked(batch.column("text")), found)]
            yield _record(_RESULT, list(zip(*out)) if out else [[]] * 8)

    return joined.select("doc_id", "text", "runs").mapInArrow(run, _RESULT)
