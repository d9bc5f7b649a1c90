"""Static range asymmetric numeral system over token ids, in numpy.

A block holds ``n`` ids dealt row by row to ``LANES`` interleaved coders; row
``t`` has the ids ``t * LANES`` and on.  Every coder has a 64-bit state in
``[2**31, 2**63)`` and moves 32-bit words in and out of one stream that all share.
Every ``STRIDE`` rows the states and the stream position are stored, so the
spans between these checkpoints decode on their own, in parallel.

Block layout, little-endian::

    magic "TRB1", table crc32, lanes, precision, stride, checkpoints  u32 x 5
    ids, words, crc32 of the ids as u32, crc32 of all that follows     u32 x 4
    stream position of each checkpoint                                u32
    states of each checkpoint                                         u64 x lanes
    words                                                             u32
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 1024
STRIDE = 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<4s9I")
MAGIC = b"TRB1"


def quantize(counts: np.ndarray, fallback: int = 0) -> np.ndarray:
    """Frequencies that sum to a power of two, at least 1 where a count is.

    The power leaves four slots for each id of the vocabulary and 2**18 at least.
    Without any count, ``fallback`` takes all.
    """
    counts = counts.astype(np.int64)
    precision = max(18, int(len(counts) - 1).bit_length() + 2)
    if not counts.any():
        counts[fallback] = 1
    used = np.flatnonzero(counts)
    spare = (1 << precision) - len(used)
    share = counts[used] * (spare / counts.sum())
    whole = np.floor(share).astype(np.int64)
    order = np.lexsort((used, whole - share))  # largest remainders first, ties by id
    whole[order[: spare - whole.sum()]] += 1
    freq = np.zeros(len(counts), np.uint32)
    freq[used] = whole + 1
    return freq


class Table:
    """A shared frequency table with what coding and decoding look up."""

    def __init__(self, freq: np.ndarray) -> None:
        freq = freq.astype("<u4")
        self.crc = zlib.crc32(freq.tobytes())
        self.precision = int(freq.sum(dtype=np.int64)).bit_length() - 1
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self._both: np.ndarray | None = None
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        return self._slots

    @property
    def slot_facts(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequency of each slot's id, and the slot's place among that id's."""
        if self._both is None:
            ids = self.slots
            within = np.arange(len(ids), dtype=np.uint64) - self.start[ids]
            self._both = np.stack([self.freq[ids], within])
        return self._both[0], self._both[1]


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block of ``ids``; every id needs a frequency in ``table``."""
    rows = -(-len(ids) // lanes)
    if len(ids) and not table.freq[ids].all():
        raise ValueError("an id has no frequency in the shared table")
    dealt = np.full(rows * lanes, np.argmax(table.freq), np.intp)
    dealt[: len(ids)] = ids
    dealt = dealt.reshape(rows, lanes)
    bits = np.uint64(table.precision)
    room = np.uint64(63 - table.precision)
    total = np.uint64(1) << bits
    state = np.full(lanes, LOW, np.uint64)
    freq, start, high = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    chunks: list[np.ndarray] = []
    written = 0
    states, marks = [], []
    for t in range(rows - 1, -1, -1):
        np.take(table.freq, dealt[t], out=freq, mode="clip")
        np.take(table.start, dealt[t], out=start, mode="clip")
        full = np.flatnonzero(state >> room >= freq)
        if len(full):
            moved = state[full]
            chunks.append(moved.astype(np.uint32))
            written += len(full)
            state[full] = moved >> WORD
        np.floor_divide(state, freq, out=high)
        # high * 2**bits + the remainder + start
        state += start
        state += high * (total - freq)
        if t % stride == 0:
            states.append(state.copy())
            marks.append(written)
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    places = written - np.array(marks[::-1], np.int64)
    body = b"".join(
        [places.astype("<u4").tobytes(), *(s.astype("<u8").tobytes() for s in states[::-1]), words.astype("<u4").tobytes()]
    )
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    numbers = (table.crc, lanes, table.precision, stride, len(states), len(ids), written, ids_crc, zlib.crc32(body))
    return HEAD.pack(MAGIC, *numbers) + body


def _head(block: bytes, table: Table) -> tuple[int, ...]:
    if len(block) < HEAD.size:
        raise ValueError("the block is cut off")
    magic, *numbers = HEAD.unpack_from(block)
    if magic != MAGIC or numbers[0] != table.crc or numbers[2] != table.precision:
        raise ValueError("the block was not written with this table")
    if zlib.crc32(memoryview(block)[HEAD.size :]) != numbers[8]:
        raise ValueError("the block is damaged")
    return tuple(numbers)


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the spans ``first`` up to ``last`` (all by default), as u32.

    Checks the stored checksums, and that each span ends in the states of the
    next checkpoint.
    """
    _, lanes, _, stride, spans, total, n_words, ids_crc, _ = _head(block, table)
    last = spans if last is None else min(last, spans)
    places = np.frombuffer(block, "<u4", spans, HEAD.size).astype(np.int64)
    states = np.frombuffer(block, "<u8", spans * lanes, HEAD.size + 4 * spans).reshape(spans, lanes)
    words = np.frombuffer(block, "<u4", n_words, HEAD.size + 4 * spans + 8 * spans * lanes)
    rows = -(-total // lanes)
    out = [np.zeros(0, np.uint32)]
    for k in range(first, last):
        end = min(rows, (k + 1) * stride)
        ids, state = _decode_span(states[k].astype(np.uint64), words[places[k] :], end - k * stride, table)
        out.append(ids)
        after = states[k + 1] if k + 1 < spans else np.full(lanes, LOW, np.uint64)
        if not np.array_equal(state, after):
            raise ValueError("a span does not end at the next checkpoint")
    ids = np.concatenate(out)[: max(0, total - first * stride * lanes)]
    if (first, last) == (0, spans) and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids do not match their checksum")
    return ids


def _decode_span(state: np.ndarray, words: np.ndarray, rows: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(table.precision)
    mask = np.uint64((1 << table.precision) - 1)
    freqs, withins = table.slot_facts
    slots = np.empty((rows, len(state)), np.uint32)
    freq, within = np.empty(len(state), np.uint64), np.empty(len(state), np.uint64)
    at = 0
    for t in range(rows):
        slot = state & mask
        slots[t] = slot
        slot = slot.view(np.intp)
        np.take(freqs, slot, out=freq, mode="clip")
        np.take(withins, slot, out=within, mode="clip")
        state >>= bits
        state *= freq
        state += within
        low = np.flatnonzero(state < LOW)
        if len(low):
            state[low] = (state[low] << WORD) | words[at : at + len(low)]
            at += len(low)
    return table.slots[slots.ravel()].astype(np.uint32), state
