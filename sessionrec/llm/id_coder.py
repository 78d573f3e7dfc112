"""Adaptive context-mixing range coder for token ids below 65,536.

Ids are cut into blocks that are coded independently: each starts from an empty model
and has its own checksums, so any block is readable alone. Within a block three models
predict the next id: the id that last followed the same two ids (order two), the one that
last followed the same id (order one), and the frequencies of ids so far (order zero).
Their predictions are mixed into one interval of 65,536 parts: a share for the order-two
guess, a share for the order-one guess, the rest for order zero. Shares adapt to how often
such guesses came true, apart for each level of a guess's recent success. Order zero
codes the high byte and the low byte; its tables are brought up to date when a block
has doubled in length.

The coder keeps a 64-bit interval and emits 32-bit words. Blocks are coded side by side:
one numpy operation serves one id of every block, so the work per id is a few dozen array
operations shared by all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 4096
LANES = 1024
WHOLE = 65536

_ORDER1, _ORDER2 = 11, 12  # bits of the tables' slots
_LEAST, _MOST = 32, 60000  # bounds of a share
_RATE = 5
_STEP = 4  # weight of an occurrence against one of each symbol
_FULL = np.uint64((1 << 64) - 1)
_WORD = np.uint64((1 << 32) - 1)
_32, _16 = np.uint64(32), np.uint64(16)

_HEAD = "<4sII"
_BLOCK = "<IIII"
MAGIC = b"CMR1"


class Mixer:
    """The models of many blocks, one lane each. Encoder and decoder take the same steps.

    A slot of the order-one and order-two tables holds an id and, above it, how often in
    a row it came true (0 to 3).
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.row1, self.row2, self.row_w = lane << _ORDER1, lane << _ORDER2, lane << 2
        self.slots1 = np.zeros(lanes << _ORDER1, np.int32)
        self.slots2 = np.zeros(lanes << _ORDER2, np.int32)
        start = np.tile(np.array([1000, 8000, 20000, 40000]), lanes)
        self.share1, self.share2 = start.copy(), start.copy()
        self.before1 = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        self.row_high, self.row_low = lane * 257, lane * 16
        self.count_high = lane * 256
        self.high = np.ones((lanes, 256), np.int32)
        self.low = np.ones((lanes * 16, 256), np.int32)
        self.high_counts, self.low_counts = self.high.reshape(-1), self.low.reshape(-1)
        self.step = 0
        self.refresh()

    def refresh(self) -> None:
        """Order-zero intervals from the counts; every symbol keeps at least one part."""

        def intervals(counts):
            total = np.zeros((len(counts), 257), np.int64)
            np.cumsum(counts, axis=1, out=total[:, 1:])
            return (total * WHOLE // total[:, -1:]).astype(np.int32).ravel()

        self.high_starts, self.low_starts = intervals(self.high), intervals(self.low)

    def predict(self) -> None:
        """Guesses and shares for the next id."""
        mixed = self.before1 * 24421
        self.at1 = self.row1 + (mixed >> 4 & (1 << _ORDER1) - 1)
        self.at2 = self.row2 + ((mixed ^ self.before2 * 15359) >> 5 & (1 << _ORDER2) - 1)
        held1, held2 = self.slots1[self.at1], self.slots2[self.at2]
        self.first, self.second = held1 & 65535, held2 & 65535
        self.level1, self.level2 = held1 >> 16, held2 >> 16
        self.s1, self.s2 = self.row_w + self.level1, self.row_w + self.level2
        self.a2, self.b1 = self.share2[self.s2], self.share1[self.s1]
        self.a1 = (WHOLE - self.a2) * self.b1 >> 16
        self.taken = self.a1 + self.a2

    def choice(self, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of the order-two guess, of the order-one guess, or of the rest."""
        plain = ~(hit1 | hit2)
        start = np.where(hit2, 0, np.where(hit1, self.a2, self.taken))
        width = np.where(hit2, self.a2, np.where(hit1, self.a1, WHOLE - self.taken))
        return start, width, plain

    def update(self, ids: np.ndarray, plain: np.ndarray) -> None:
        """Learn the ids that came; ``plain`` ones were no guess."""
        hit2, hit1 = ids == self.second, ids == self.first
        share = self.a2
        self.share2[self.s2] = share + ((_LEAST + hit2 * (_MOST - _LEAST) - share) >> _RATE)
        share = self.b1
        self.share1[self.s1] = share + (~hit2 * (_LEAST + hit1 * (_MOST - _LEAST) - share) >> _RATE)
        self.slots1[self.at1] = ids | (np.minimum(self.level1 + 1, 3) * hit1) << 16
        self.slots2[self.at2] = ids | (np.minimum(self.level2 + 1, 3) * hit2) << 16
        seen = plain * _STEP
        byte = ids >> 8
        self.high_counts[self.count_high + byte] += seen
        self.low_counts[(self.row_low + (byte >> 4) << 8) + (ids & 255)] += seen
        self.before2, self.before1 = self.before1, ids
        self.step += 1
        if self.step >= 32 and self.step & (self.step - 1) == 0:
            self.refresh()


class _Interval:
    """64-bit intervals of all lanes."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _FULL)

    def narrow(self, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Take a part of each interval; lanes that have to shift out a word."""
        unit = self.range >> _16
        self.low += unit * start.astype(np.uint64)
        self.range = unit * width.astype(np.uint64)
        small = (self.range <= _WORD).nonzero()[0]
        if len(small):
            low, size = self.low[small], self.range[small]
            # An interval over a word border is cut at the border.
            self.range[small] = np.minimum(size, _WORD + np.uint64(1) - (low & _WORD))
        return small

    def shift(self, small: np.ndarray) -> None:
        self.low[small] <<= _32
        self.range[small] = self.range[small] << _32


def _encode_lanes(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """ids (lanes x longest) -> the coded bytes of each lane."""
    lanes, longest = ids.shape
    mixer, interval = Mixer(lanes), _Interval(lanes)
    words = np.zeros((lanes, 2 * longest + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    shortest = int(lengths.min(initial=longest))
    columns = np.ascontiguousarray(ids.T)

    def code(start, width):
        small = interval.narrow(start, width)
        if len(small):
            words[small, used[small]] = interval.low[small] >> _32
            used[small] += 1
            interval.shift(small)

    for step in range(longest):
        x = columns[step]
        mixer.predict()
        start, width, plain = mixer.choice(x == mixer.second, x == mixer.first)
        if step >= shortest:  # lanes that are over code nothing
            live = step < lengths
            start, width, plain = np.where(live, start, 0), np.where(live, width, WHOLE), plain & live
        code(start, width)
        byte = x >> 8
        at = mixer.row_high + byte
        start = mixer.high_starts[at]
        code(start * plain, np.where(plain, mixer.high_starts[at + 1] - start, WHOLE))
        at = (mixer.row_low + (byte >> 4)) * 257 + (x & 255)
        start = mixer.low_starts[at]
        code(start * plain, np.where(plain, mixer.low_starts[at + 1] - start, WHOLE))
        mixer.update(x, plain)
    for part in (_32, np.uint64(0)):
        words[np.arange(lanes), used] = (interval.low >> part) & _WORD
        used += 1
    return [words[i, : used[i]].astype("<u4").tobytes() for i in range(lanes)]


def _decode_lanes(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    lanes, longest = len(payloads), int(lengths.max(initial=0))
    most = max((len(p) // 4 for p in payloads), default=0) + 4
    words = np.zeros((lanes, most), np.uint64)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
    mixer, interval = Mixer(lanes), _Interval(lanes)
    value = words[:, 0] << _32 | words[:, 1]
    used = np.full(lanes, 2)
    shortest = int(lengths.min(initial=longest))
    out = np.zeros((longest, lanes), np.int32)

    def slot():
        return np.minimum((value - interval.low) // (interval.range >> _16), np.uint64(WHOLE - 1)).astype(np.int64)

    def code(start, width):
        small = interval.narrow(start, width)
        if len(small):
            value[small] = value[small] << _32 | words[small, np.minimum(used[small], most - 1)]
            used[small] += 1
            interval.shift(small)

    def search(starts, row, target):
        """Symbol whose interval holds the target: halving over 256 symbols."""
        at = row.copy()
        for half in (128, 64, 32, 16, 8, 4, 2, 1):
            at += (starts[at + half] <= target) * half
        return at

    for step in range(longest):
        mixer.predict()
        target = slot()
        hit2, below = target < mixer.a2, target < mixer.taken
        start, width, plain = mixer.choice(hit2, below)
        live = None
        if step >= shortest:
            live = step < lengths
            start, width, plain = np.where(live, start, 0), np.where(live, width, WHOLE), plain & live
        code(start, width)
        at = search(mixer.high_starts, mixer.row_high, slot())
        byte = at - mixer.row_high
        start = mixer.high_starts[at]
        code(start * plain, np.where(plain, mixer.high_starts[at + 1] - start, WHOLE))
        row = (mixer.row_low + (byte >> 4)) * 257
        at = search(mixer.low_starts, row, slot())
        start = mixer.low_starts[at]
        code(start * plain, np.where(plain, mixer.low_starts[at + 1] - start, WHOLE))
        x = np.where(hit2, mixer.second, np.where(below, mixer.first, (byte << 8) + at - row))
        if live is not None:
            x = np.where(live, x, 0)
        out[step] = x
        mixer.update(x, plain)
    return out.T.astype(np.int64)


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """A coded file: a head, then blocks of (ids, bytes, checksum of bytes, of ids, bytes)."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and not 0 <= ids.min() <= ids.max() < WHOLE:
        raise ValueError("ids must be from 0 to 65,535")
    count = -(-len(ids) // block_ids)
    out = [struct.pack(_HEAD, MAGIC, block_ids, count)]
    for first in range(0, count, lanes):
        part = ids[first * block_ids : (first + lanes) * block_ids]
        n = -(-len(part) // block_ids)
        lengths = np.minimum(block_ids, len(part) - np.arange(n) * block_ids)
        square = np.zeros(n * block_ids, np.int64)
        square[: len(part)] = part
        square = square.reshape(n, block_ids)[:, : lengths.max()]
        for i, payload in enumerate(_encode_lanes(square, lengths)):
            plain = square[i, : lengths[i]].astype("<u4").tobytes()
            out.append(struct.pack(_BLOCK, lengths[i], len(payload), zlib.crc32(payload), zlib.crc32(plain)))
            out.append(payload)
    return b"".join(out)


def decode(data: bytes, lanes: int = LANES) -> np.ndarray:
    """The ids of a coded file; raises ValueError where a checksum fails."""
    if len(data) < struct.calcsize(_HEAD) or data[:4] != MAGIC:
        raise ValueError("not a coded id file")
    _, _, count = struct.unpack_from(_HEAD, data)
    at, blocks = struct.calcsize(_HEAD), []
    for b in range(count):
        if len(data) < at + struct.calcsize(_BLOCK):
            raise ValueError(f"block {b} is cut off")
        n, size, crc, ids_crc = struct.unpack_from(_BLOCK, data, at)
        payload = data[at + struct.calcsize(_BLOCK) : at + struct.calcsize(_BLOCK) + size]
        if len(payload) != size or zlib.crc32(payload) != crc:
            raise ValueError(f"block {b} is damaged")
        blocks.append((n, payload, ids_crc))
        at += struct.calcsize(_BLOCK) + size
    out = []
    for first in range(0, count, lanes):
        part = blocks[first : first + lanes]
        lengths = np.array([n for n, _, _ in part], np.int64)
        for i, row in enumerate(_decode_lanes([p for _, p, _ in part], lengths)):
            ids = row[: lengths[i]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != part[i][2]:
                raise ValueError(f"block {first + i} does not give its ids")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)
