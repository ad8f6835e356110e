"""Static range asymmetric numeral system over numpy lanes: one shared frequency table, independent blocks, checkpoints.

Token i of a block belongs to lane i mod ``lanes``. All lanes code one token in a
step and share one stream of 32-bit words, read in the order of lanes. Every
``every`` steps a block keeps the lanes' states and the place in the stream, so that
its segments decode on their own. Blocks carry checksums of their bytes and ids.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # bits of the frequency scale: 2 ** SCALE is shared out among the tokens
LANES, EVERY = 2048, 128
LOW = np.uint64(1 << 32)
MAGIC = b"QRB1"
_HEAD = struct.Struct("<4sIIIIIIII")  # magic, documents, tokens, lanes, every, checkpoints, words, crc of ids, crc of body


class Table:
    """Frequencies of token ids scaled to ``2 ** SCALE``; every counted id keeps at least one part."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Counts by id -> parts of ``2 ** SCALE``; what rounding leaves goes to the most frequent id."""
        seen, total = int((counts > 0).sum()), int(counts.sum())
        room = (1 << SCALE) - seen
        if not seen or room < 0:
            raise ValueError("the scale holds at least one and at most 2 ** SCALE ids")
        freq = np.array([int(c) * room // total + (c > 0) for c in counts.tolist()], np.int64)
        freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
        return freq


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY):
    """(words, states at each checkpoint, words before each checkpoint, lanes used)."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    states, words, marks = np.full(lanes, LOW, np.uint64), [], {}
    shift, scale, half, mask = np.uint64(64 - SCALE), np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes:(t + 1) * lanes]
        x, f = states[:len(s)], table.freq[s]
        over = (x >> shift) >= f
        words.append((x[over] & mask).astype(np.uint32))
        x = np.where(over, x >> half, x)
        q, r = np.divmod(x, f)
        states[:len(s)] = (q << scale) + r + table.start[s]
        if t % every == 0:
            marks[t] = states.copy()
    words.reverse()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint32)
    at = sorted(marks)
    return (np.concatenate(words) if words else np.empty(0, np.uint32)), np.array([marks[t] for t in at], np.uint64).reshape(len(at), lanes), before[at], lanes


def decode(words: np.ndarray, states: np.ndarray, at: int, n: int, table: Table) -> tuple[np.ndarray, np.ndarray, int]:
    """``n`` tokens from a checkpoint on: (ids, states after, place in the stream after)."""
    lanes, states = len(states), states.copy()
    out = np.empty(n, np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for a in range(0, n, lanes):
        x = states[:min(lanes, n - a)]
        slot = x & mask
        s = table.token[slot]
        x = table.freq[s] * (x >> scale) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << half) | words[at:at + len(low)]
        at += len(low)
        states[:len(x)], out[a:a + len(x)] = x, s
    return out, states, at


def pack_block(keys: list, lengths: np.ndarray, ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """A block of whole documents; ``keys`` may hold None."""
    words, states, before, lanes = encode(ids, table, lanes, every)
    known = np.array([k is not None for k in keys], np.uint8)
    body = b"".join(x.tobytes() for x in (np.array([k or 0 for k in keys], "<i8"), known, lengths.astype("<u4"), before.astype("<u4"), states.astype("<u8"), words.astype("<u4")))
    return _HEAD.pack(MAGIC, len(keys), len(ids), lanes, every, len(states), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


class Block:
    """A packed block; its bytes are checked when it is opened, its ids when all are read."""

    def __init__(self, data: bytes):
        magic, docs, self.tokens, self.lanes, self.every, marks, words, self.ids_crc, crc = _HEAD.unpack_from(data)
        body = memoryview(data)[_HEAD.size:]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("a block does not fit its checksum")
        at = 0

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        keys, known, self.lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        self.keys = [k if ok else None for k, ok in zip(keys.tolist(), known.tolist())]
        self.before, states = take("<u4", marks), take("<u8", marks * self.lanes)
        self.states, self.words = states.reshape(marks, self.lanes), take("<u4", words)

    @property
    def segments(self) -> int:
        return len(self.states)

    def segment(self, i: int, table: Table) -> np.ndarray:
        """Ids of one segment, decoded on its own; it must end in the next checkpoint's state."""
        size = self.every * self.lanes
        n = min(size, self.tokens - i * size)
        ids, states, at = decode(self.words, self.states[i], int(self.before[i]), n, table)
        last = i + 1 == self.segments
        want, place = (np.full(self.lanes, LOW, np.uint64), len(self.words)) if last else (self.states[i + 1], int(self.before[i + 1]))
        if at != place or not np.array_equal(states, want):
            raise ValueError("a segment does not end in the next checkpoint")
        return ids

    def ids(self, table: Table) -> np.ndarray:
        out = np.concatenate([self.segment(i, table) for i in range(self.segments)]) if self.tokens else np.empty(0, np.uint32)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("decoded ids do not fit their checksum")
        return out
