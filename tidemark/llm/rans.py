"""Static range asymmetric numeral system over 16-bit token ids, in numpy.

A segment has one frequency table. Its tokens are coded in blocks that depend on the table alone; a block interleaves many
lanes, and lane j codes the tokens j, j + lanes, ... so that a step of the coder is one vector operation. Every block
keeps checkpoints (lane states and a place in the words), from which it can be decoded in parallel, and a checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK, LANES, CHECKPOINT_STEPS = 65536, 256, 128
_head = struct.Struct("<4s6I")
_magic = b"rAN1"


class Table:
    """Frequencies of the symbols of a segment, scaled to sum to 2 ** SCALE; every symbol that occurs has one at least."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols, freqs
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.start[symbols] = np.cumsum(freqs) - freqs

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        freqs = np.maximum(1, counts * (1 << SCALE) // counts.sum())
        rest = (1 << SCALE) - int(freqs.sum())
        order = np.argsort(-freqs, kind="stable")
        if rest >= 0:
            freqs[order[0]] += rest
        else:  # taken from the most frequent in turn, which stay at one or more
            for i in order:
                less = min(-rest, int(freqs[i]) // 2)
                freqs[i] -= less
                rest += less
                if not rest:
                    break
        return cls(symbols, freqs)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.symbols.astype("<u2").tobytes() + self.freqs.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        n = len(raw) // 6
        return cls(np.frombuffer(raw[: 2 * n], "<u2").astype(np.int64), np.frombuffer(raw[2 * n :], "<u4").astype(np.int64))

    def slots(self) -> np.ndarray:
        return np.repeat(self.symbols.astype(np.uint16), self.freqs)


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n tokens."""
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of BLOCK tokens, the last one shorter; full blocks are coded side by side."""
    full = len(ids) // BLOCK * BLOCK
    out = []
    for part in (ids[:full].reshape(-1, BLOCK), ids[full:].reshape(1, -1)):
        if part.size:
            out += _encode(part, table)
    return out


def _encode(blocks: np.ndarray, table: Table) -> list[bytes]:
    rows, n = blocks.shape
    lanes, steps = _shape(n)
    fill = table.symbols[np.argmax(table.freqs)]
    padded = np.full((rows, steps * lanes), fill, np.int64)
    padded[:, :n] = blocks
    padded = padded.reshape(rows, steps, lanes)
    x = np.full((rows, lanes), LOW, np.uint64)
    words: list[list[np.ndarray]] = [[] for _ in range(rows)]
    written = np.zeros(rows, np.int64)
    marks: list[tuple[int, np.ndarray, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        s = padded[:, t]
        f = table.freq[s]
        over = x >= (f << np.uint64(43))
        if over.any():
            low = x.astype(np.uint32)
            for b in range(rows):
                words[b].append(low[b][over[b]])
            written += over.sum(axis=1)
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + table.start[s]
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, written.copy(), x.copy()))
    out = []
    for b in range(rows):
        payload = np.concatenate(words[b][::-1]) if words[b] else np.empty(0, np.uint32)
        at = np.array([[t, len(payload) - w[b]] for t, w, _ in marks[::-1]], "<u4")
        states = np.concatenate([x[b] for _, _, x in marks[::-1]]).astype("<u8")
        check = zlib.crc32(blocks[b].astype("<u2").tobytes())
        out.append(_head.pack(_magic, n, lanes, steps, len(marks), len(payload), check) + at.tobytes() + states.tobytes() + payload.astype("<u4").tobytes())
    return out


class _Block:
    def __init__(self, data: bytes):
        magic, self.n, self.lanes, self.steps, marks, words, self.check = _head.unpack_from(data)
        if magic != _magic:
            raise ValueError("not a block of this format")
        at = _head.size
        self.at = np.frombuffer(data, "<u4", 2 * marks, at).reshape(marks, 2).astype(np.int64)
        at += 8 * marks
        self.states = np.frombuffer(data, "<u8", marks * self.lanes, at).reshape(marks, self.lanes)
        at += 8 * marks * self.lanes
        self.words = np.frombuffer(data, "<u4", words, at)


def decode_blocks(blocks: list[bytes], table: Table) -> np.ndarray:
    """Tokens of blocks of one segment, from all their checkpoints at once; a wrong checksum raises."""
    slots = table.slots()
    opened = [_Block(b) for b in blocks]
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(opened)
    for lanes, steps in sorted({(b.lanes, b.steps) for b in opened}):
        own = [i for i, b in enumerate(opened) if (b.lanes, b.steps) == (lanes, steps)]
        base = np.cumsum([0, *(len(opened[i].words) for i in own)])
        words = np.concatenate([*(opened[i].words for i in own), np.zeros(1, np.uint32)]).astype(np.uint64)
        first = np.concatenate([opened[i].at[:, 0] for i in own])
        pos = np.concatenate([opened[i].at[:, 1] + base[k] for k, i in enumerate(own)])
        x = np.concatenate([opened[i].states for i in own]).astype(np.uint64)
        which = np.repeat(np.arange(len(own)), [len(opened[i].at) for i in own])
        made = np.zeros((len(own), steps, lanes), np.uint16)
        for t in range(min(CHECKPOINT_STEPS, steps)):
            live = first + t < steps
            if not live.all():
                x, pos, first, which = x[live], pos[live], first[live], which[live]
            slot = (x & np.uint64((1 << SCALE) - 1)).astype(np.int64)
            s = slots[slot]
            made[which, first + t] = s
            x = table.freq[s] * (x >> np.uint64(SCALE)) + slot.astype(np.uint64) - table.start[s]
            low = x < LOW
            place = np.cumsum(low, axis=1)
            taken = words[np.where(low, pos[:, None] + place - 1, len(words) - 1)]
            x = np.where(low, (x << np.uint64(32)) | taken, x)
            pos = pos + place[:, -1]
        for k, i in enumerate(own):
            out[i] = made[k].reshape(-1)[: opened[i].n]
            if zlib.crc32(out[i].astype("<u2").tobytes()) != opened[i].check:
                raise ValueError("a block's checksum differs")
    return np.concatenate(out) if out else np.empty(0, np.uint16)


def decode_range(block: bytes, table: Table, first: int, count: int) -> np.ndarray:
    """Some tokens of one block, decoded from the last checkpoint before them."""
    b = _Block(block)
    slots, step = table.slots(), first // b.lanes
    k = int(np.searchsorted(b.at[:, 0], step, side="right")) - 1
    t, pos = int(b.at[k, 0]), int(b.at[k, 1])
    x, words, made = b.states[k].astype(np.uint64), b.words.astype(np.uint64), []
    begin = t * b.lanes
    while t < b.steps and t * b.lanes < first + count:
        slot = (x & np.uint64((1 << SCALE) - 1)).astype(np.int64)
        s = slots[slot]
        made.append(s)
        x = table.freq[s] * (x >> np.uint64(SCALE)) + slot.astype(np.uint64) - table.start[s]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[pos : pos + len(low)]
        pos += len(low)
        t += 1
    return np.concatenate(made)[first - begin : first - begin + count] if made else np.empty(0, np.uint16)
