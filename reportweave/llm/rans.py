"""Static range asymmetric numeral system over token ids: blocks of interleaved lanes, checkpoints, checksums; all in numpy.

A table gives each id a share of 2**SCALE_BITS slots. Id k of a block belongs to lane k % LANES. A lane's state lies in
[2**31, 2**63); where it would leave that range, its low 32 bits go to the block's words. All lanes of all blocks take a step
at once; the lanes of a block share one list of words, which decoding reads in the order of steps and, within a step, of lanes.
A checkpoint has the states of all lanes and the place in the list before a step, so decoding may begin there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LANES = 16
STEPS = 256  # between two checkpoints
SEGMENTS = 4  # of a block
BLOCK_IDS = LANES * STEPS * SEGMENTS
#: Blocks that are coded at once: bounds the memory of a task.
AT_ONCE = 64
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<5I")


def normalize(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Shares of 2**bits slots in proportion to counts, at least one for each id that occurs."""
    counts = np.asarray(counts, np.float64)
    some = np.flatnonzero(counts)
    if len(some) > 1 << bits:
        raise ValueError("more ids occur than the table has slots")
    out = np.zeros(len(counts), np.int64)
    if not len(some):
        return out
    out[some] = 1 + np.floor(counts[some] * (((1 << bits) - len(some)) / counts.sum())).astype(np.int64)
    out[np.argmax(counts)] += (1 << bits) - out.sum()
    return out


@dataclass
class Table:
    """Shares of ids, where they begin, and the id of each slot."""

    share: np.ndarray
    begin: np.ndarray
    id_of: np.ndarray
    crc: int

    @classmethod
    def of(cls, share: np.ndarray) -> Table:
        share = np.asarray(share, np.int64)
        begin = np.cumsum(share) - share
        return cls(share.astype(np.uint64), begin.astype(np.uint64), np.repeat(np.arange(len(share), dtype=np.uint32), share), zlib.crc32(share.astype("<u4").tobytes()))


def _blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Encoded blocks of ids, at most AT_ONCE of them."""
    n_blocks = -(-len(ids) // BLOCK_IDS)
    steps = STEPS * SEGMENTS
    grid = np.full(n_blocks * BLOCK_IDS, -1, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, steps, LANES)
    states = np.full((n_blocks, LANES), _LOW, np.uint64)
    written = np.zeros(n_blocks, np.int64)
    owner, words, marks = [], [], [None] * SEGMENTS
    bits = np.uint64(SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        column = grid[:, t]
        live = column >= 0
        every = live[-1].all()
        if every or live.any():
            at = column if every else np.maximum(column, 0)
            share = table.share[at] if every else np.where(live, table.share[at], np.uint64(1))
            full = states >= share << np.uint64(63 - SCALE_BITS)
            if not every:
                full &= live
            rows = np.nonzero(full)[0]
            owner.append(rows)
            words.append((states[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += np.bincount(rows, minlength=n_blocks)
            states[full] >>= _WORD
            quotient = states // share
            moved = (quotient << bits) + (states - quotient * share) + table.begin[at]
            states = moved if every else np.where(live, moved, states)
        if t % STEPS == 0:
            marks[t // STEPS] = (states.copy(), written.copy())
    owner = np.concatenate(owner[::-1]) if owner else np.zeros(0, np.int64)
    words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    order = np.argsort(owner, kind="stable")
    words, ends = words[order], np.cumsum(np.bincount(owner, minlength=n_blocks))
    out = []
    for b in range(n_blocks):
        own = ids[b * BLOCK_IDS : (b + 1) * BLOCK_IDS].astype("<u4")
        used = -(-len(own) // (LANES * STEPS))
        body = b"".join(struct.pack("<I", int(written[b] - marks[s][1][b])) + marks[s][0][b].astype("<u8").tobytes() for s in range(used))
        stream = words[ends[b] - written[b] : ends[b]].astype("<u4").tobytes()
        out.append(_HEAD.pack(len(own), int(written[b]), used, zlib.crc32(own.tobytes()), zlib.crc32(stream, zlib.crc32(body))) + body + stream)
    return out


def encode(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of BLOCK_IDS ids each (the last may be shorter), each of which can be decoded alone."""
    many = AT_ONCE * BLOCK_IDS
    return [b for lo in range(0, len(ids), many) for b in _blocks(ids[lo : lo + many], table)]


class Damaged(ValueError):
    """A block whose checksum doesn't agree."""


def decode(blocks: list[bytes], table: Table, name: str = "") -> np.ndarray:
    """The ids of blocks: all segments between checkpoints are decoded at once. Raises Damaged."""
    out = [_decode(blocks[lo : lo + AT_ONCE], table, f"{name} from block {lo}") for lo in range(0, len(blocks), AT_ONCE)]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _decode(blocks: list[bytes], table: Table, name: str) -> np.ndarray:
    heads, states, places, streams, counts, base = [], [], [], [], [], 0
    size = 4 + 8 * LANES
    for k, raw in enumerate(blocks):
        n, n_words, used, ids_crc, crc = head = _HEAD.unpack_from(raw)
        if zlib.crc32(memoryview(raw)[_HEAD.size :]) != crc or len(raw) != _HEAD.size + used * size + 4 * n_words:
            raise Damaged(f"{name}, {k} further: bytes differ from their checksum")
        for s in range(used):
            at = _HEAD.size + s * size
            places.append(base + struct.unpack_from("<I", raw, at)[0])
            states.append(np.frombuffer(raw, "<u8", LANES, at + 4))
            counts.append(min(n - s * LANES * STEPS, LANES * STEPS))
        streams.append(np.frombuffer(raw, "<u4", n_words, _HEAD.size + used * size))
        base += n_words
        heads.append(head)
    if not states:
        return np.zeros(0, np.uint32)
    states, places, counts = np.stack(states), np.array(places, np.int64), np.array(counts)
    words = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    ids = np.zeros((len(states), STEPS, LANES), np.uint32)
    bits, low = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(int(-(-counts.max() // LANES))):
        live = np.arange(t * LANES, (t + 1) * LANES) < counts[:, None]
        slot = states & low
        got = table.id_of[slot]
        ids[:, t] = got
        moved = table.share[got] * (states >> bits) + slot - table.begin[got]
        short = live & (moved < _LOW)
        at = places[:, None] + np.cumsum(short, 1) - 1
        moved = np.where(short, (moved << _WORD) | words[np.where(short, at, 0)], moved)
        states = np.where(live, moved, states)
        places += short.sum(1)
    flat = ids.reshape(len(states), -1)
    whole = flat[np.arange(STEPS * LANES) < counts[:, None]]
    lo = 0
    for k, head in enumerate(heads):
        if zlib.crc32(whole[lo : lo + head[0]].astype("<u4").tobytes()) != head[3]:
            raise Damaged(f"{name}, {k} further: ids differ from their checksum")
        lo += head[0]
    return whole
