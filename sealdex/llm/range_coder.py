"""Adaptive context-mixing range coder for token ids, many independent blocks in step.

Three orders predict the next id: the id that last followed the last two ids,
the id that last followed the last one, and the distribution of the block's
ids. What each order is given of the probability is learnt for every state of
the other two (how often they were right lately, and whether they agree); the
id is coded in the part of the first order that predicts it. The predictions
learn after every generation of ids, so a generation is looked up as a whole.
Every block starts from nothing and carries a checksum: blocks decode alone.

All blocks of a group advance by one id at a time in numpy, which is what makes
an adaptive coder bearable in Python.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SDXR"
#: Most and fewest ids of a block, and blocks that advance together.
BLOCK_IDS = 8192
LEAST_BLOCK_IDS = 1024
LANES = 256
#: Blocks encoded together: all is looked up by generations there, so fewer cost no more time, and memory goes with them.
ENCODED_LANES = 96
#: Ids of a group: what a segment should hold at most for one pass.
GROUP_IDS = BLOCK_IDS * LANES

#: First id of every generation; at some the order-0 distribution is counted anew,
#: of which all ids then share this much evenly.
_GENERATIONS = (0, 32, 64, 128, 256, 512, 768, *range(1024, BLOCK_IDS, 512))
_EVEN_SHARE = {0: 1.0, 64: 0.6, 256: 0.45, 1024: 0.3, 4096: 0.2}
_MIX_BITS, _SCALE_BITS = 12, 20
_ORDER1_BITS, _ORDER2_BITS = 12, 13
_STATES = 32
#: Ids between the entries of the coarse table that a search starts in.
_COARSE_BITS = 7
_SPAN = np.uint64(1 << 32)
_MIX, _SCALE, _HALF = np.uint64(_MIX_BITS), np.uint64(_SCALE_BITS), np.uint64(32)


class _Model:
    """Predictions of a group of blocks; ``ids`` is (step, block), filled by the caller."""

    def __init__(self, ids: np.ndarray, vocabulary: int):
        self.ids, self.vocabulary = ids, vocabulary
        self.steps, self.lanes = ids.shape
        self.lane = np.arange(self.lanes, dtype=np.int64)
        self.lane1, self.lane2, self.lane_state = self.lane << _ORDER1_BITS, self.lane << _ORDER2_BITS, self.lane * _STATES
        self.lane_flat = self.lane * (vocabulary + 1)
        self.lane_scale = self.lane << _SCALE_BITS
        # A slot holds id * 8 + confidence; confidence 0 is an empty slot.
        self.first = np.zeros(self.lanes << _ORDER1_BITS, np.int32)
        self.second = np.zeros(self.lanes << _ORDER2_BITS, np.int32)
        # How often order 2, order 1 and order 0 were the first to be right.
        self.wins = np.tile(np.array([1, 1, 4], np.int64), self.lanes * _STATES)
        self.flat = np.empty(self.lanes * (vocabulary + 1), np.int32)

    def generations(self):
        """Ranges of steps; what a range learns is known to all after it."""
        ends = [*(g for g in _GENERATIONS if g < self.steps), self.steps]
        for begin, end in zip(ends, ends[1:], strict=False):
            if begin in _EVEN_SHARE:
                self._count(begin)
            total = self.wins.reshape(-1, 3).sum(1)
            self.part2 = np.maximum(self.wins[0::3] * 4000 // total, 1)
            self.part1 = self.part2 + np.maximum(self.wins[1::3] * 4000 // total, 1)
            yield begin, end
            self._learn(begin, end)

    def _count(self, step: int) -> None:
        """Order-0 distribution of all ids before ``step``; every block's in its own range of values."""
        vocabulary, grid = self.vocabulary, self.flat.reshape(self.lanes, -1)
        even = int(_EVEN_SHARE[step] * (1 << _SCALE_BITS) / vocabulary)
        each = ((1 << _SCALE_BITS) - even * vocabulary) // step if step else 0
        grid[:, 0] = self.lane_scale
        for low in range(0, self.lanes, 16):
            own = self.ids[:step, low : low + 16]
            lanes = own.shape[1]
            seen = np.bincount((own + self.lane[:lanes] * vocabulary).reshape(-1), minlength=lanes * vocabulary)
            part = seen.astype(np.int32).reshape(lanes, -1)
            part *= np.int32(each)
            part += np.int32(even)
            part[:, 0] += self.lane_scale[low : low + 16].astype(np.int32)
            np.cumsum(part, axis=1, out=grid[low : low + 16, 1:])
        self.coarse = np.ascontiguousarray(grid[:, :vocabulary : 1 << _COARSE_BITS])
        self.coarse_lane, self.coarse = self.lane * self.coarse.shape[1], self.coarse.reshape(-1)

    def find(self, value: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The id in whose part of its block's range a value lies."""
        id_ = np.searchsorted(self.coarse, value, "right") - 1 - self.coarse_lane[lanes] << _COARSE_BITS
        base = self.lane_flat[lanes]
        top = base + self.vocabulary
        at = base + id_
        for bit in range(_COARSE_BITS - 1, -1, -1):
            ahead = np.minimum(at + (1 << bit), top)
            at = np.where(self.flat[ahead] <= value, ahead, at)
        return np.minimum(at - base, self.vocabulary - 1)

    def look(self, last: np.ndarray, before: np.ndarray, n: int):
        """Slots, their places and the state for ids before the next one; of one step or many."""
        at1 = ((last * 40503 >> 4) & ((1 << _ORDER1_BITS) - 1)) + self.lane1[:n]
        at2 = ((last * 40503 + before * 30011 >> 5) & ((1 << _ORDER2_BITS) - 1)) + self.lane2[:n]
        slot1, slot2 = self.first[at1], self.second[at2]
        id1, id2 = slot1 >> 3, slot2 >> 3
        state = ((slot2 & 3) << 3) + ((slot1 & 3) << 1) + (id1 == id2) + self.lane_state[:n]
        return at1, at2, slot1, slot2, id1, id2, state

    def past(self, begin: int, end: int):
        """The last id and the one before, of every step of a range."""
        back = np.zeros((end - begin + 2, self.lanes), np.int64)
        back[max(0, 2 - begin) :] = self.ids[max(0, begin - 2) : end]
        return back[1:-1], back[:-2]

    def orders(self, now, slot1, slot2, id1, id2):
        two = (now == id2) & (slot2 & 3 > 0)
        one = (now == id1) & (slot1 & 3 > 0)
        return np.where(two, 0, np.where(one, 1, 2))

    def _learn(self, begin: int, end: int) -> None:
        at1, at2, slot1, slot2, id1, id2, state = self.look(*self.past(begin, end), self.lanes)
        now = self.ids[begin:end]
        np.add.at(self.wins, (state * 3 + self.orders(now, slot1, slot2, id1, id2)).reshape(-1), 1)
        for table, at, slot, own in ((self.first, at1, slot1, id1), (self.second, at2, slot2, id2)):
            right, sure = own == now, slot & 3
            table[at] = np.where(right & (sure > 0), slot + (sure < 3), np.where(sure > 1, slot - 1, (now << 3) + 1))


def _encode_group(ids: np.ndarray, short: int, vocabulary: int) -> list[bytes]:
    """``ids`` (step, block); all blocks are full but the last, which has ``short`` ids."""
    model = _Model(ids, vocabulary)
    steps, lanes = ids.shape
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    width = steps + 4
    out, filled = np.zeros(lanes * width, np.uint64), np.arange(lanes, dtype=np.int64) * width
    for begin, end in model.generations():
        _, _, slot1, slot2, id1, id2, state = model.look(*model.past(begin, end), lanes)
        now = ids[begin:end]
        order = model.orders(now, slot1, slot2, id1, id2)
        part2, part1 = model.part2[state], model.part1[state]
        starts = np.where(order == 0, 0, np.where(order == 1, part2, part1)).astype(np.uint64)
        sizes = (np.where(order == 0, part2, np.where(order == 1, part1, 1 << _MIX_BITS)).astype(np.uint64)) - starts
        at = model.lane_flat + now
        plain = order == 2
        begins = np.where(plain, model.flat[at] - model.lane_scale, 0).astype(np.uint64)
        shares = np.where(plain, model.flat[at + 1] - model.lane_scale, 1 << _SCALE_BITS).astype(np.uint64) - begins
        for step in range(begin, end):
            n, row = (lanes if step < short else lanes - 1), step - begin
            part = span[:n] >> _MIX
            within = part * sizes[row, :n] >> _SCALE
            raised = low[:n] + (part * starts[row, :n] + within * begins[row, :n])
            carry = np.flatnonzero(raised < low[:n])
            if len(carry):
                out[filled[carry] - 1] += np.uint64(1)
            low[:n] = raised
            span[:n] = within * shares[row, :n]
            move = np.flatnonzero(span < _SPAN)
            if len(move):
                out[filled[move]] = low[move] >> _HALF
                filled[move] += 1
                low[move] <<= _HALF
                span[move] <<= _HALF
    for _ in range(2):
        out[filled] = low >> _HALF
        filled += 1
        low <<= _HALF
    return [_carried(out[i * width : filled[i]]) for i in range(lanes)]


def _carried(words: np.ndarray) -> bytes:
    """32-bit words of which some are one too large for a word: the excess goes to the word before."""
    over = np.flatnonzero(words >> _HALF)
    while len(over):
        words[over] &= np.uint64(0xFFFFFFFF)
        words[over - 1] += np.uint64(1)
        over = np.flatnonzero(words >> _HALF)
    return words.astype("<u4").tobytes()


def _decode_group(payloads: list[bytes], steps: int, short: int, vocabulary: int) -> np.ndarray:
    lanes = len(payloads)
    ids = np.zeros((steps, lanes), np.int32)
    model = _Model(ids, vocabulary)
    width = max(len(p) for p in payloads) // 4 + 4
    words = np.zeros((lanes, width), np.uint64)
    for i, payload in enumerate(payloads):
        words[i, : len(payload) // 4] = np.frombuffer(payload, "<u4")
    words = words.reshape(-1)
    taken = np.arange(lanes, dtype=np.int64) * width
    ends = taken + width - 1
    # Distance of the coded value from the low end of its span.
    code, span = words[taken] << _HALF | words[taken + 1], np.full(lanes, ~np.uint64(0))
    taken += 2
    full = np.int64((1 << _SCALE_BITS) - 1)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for begin, end in model.generations():
        for step in range(begin, end):
            n = lanes if step < short else lanes - 1
            _, _, _, _, id1, id2, state = model.look(last[:n], before[:n], n)
            part2, part1 = model.part2[state], model.part1[state]
            part = span[:n] >> _MIX
            value = (code[:n] // part).astype(np.int64)
            two, plain = value < part2, value >= part1
            start = np.where(two, 0, np.where(plain, part1, part2))
            size = np.where(two, part2, np.where(plain, 1 << _MIX_BITS, part1)) - start
            code[:n] -= part * start.astype(np.uint64)
            within = part * size.astype(np.uint64) >> _SCALE
            span[:n] = within << _SCALE
            now = np.where(two, id2, id1).astype(np.int64)
            rest = np.flatnonzero(plain)
            if len(rest):
                share, scale = within[rest], model.lane_scale[rest]
                value = np.minimum((code[rest] // share).astype(np.int64), full) + scale
                now[rest] = model.find(value.astype(np.int32), rest)
                at = model.lane_flat[rest] + now[rest]
                low = (model.flat[at] - scale).astype(np.uint64)
                code[rest] -= share * low
                span[rest] = share * ((model.flat[at + 1] - scale).astype(np.uint64) - low)
            ids[step, :n] = now
            before[:n] = last[:n]
            last[:n] = now
            move = np.flatnonzero(span < _SPAN)
            if len(move):
                code[move] = code[move] << _HALF | words[np.minimum(taken[move], ends[move])]
                taken[move] += 1
                span[move] <<= _HALF
    return ids


def block_ids(count: int) -> int:
    """Ids of a block in a segment of ``count``: shorter where few blocks would advance together."""
    return min(BLOCK_IDS, max(LEAST_BLOCK_IDS, -(-count // LANES // LEAST_BLOCK_IDS) * LEAST_BLOCK_IDS))


def _in_step(ids: np.ndarray, lanes: int, size: int) -> np.ndarray:
    """(step, block): the first ids of all blocks, then the second ones."""
    grid = np.zeros((size if lanes > 1 else len(ids), lanes), np.int32)
    for lane in range(lanes):
        block = ids[lane * size : (lane + 1) * size]
        grid[: len(block), lane] = block
    return grid


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A segment: header, one (bytes, checksum) entry a block, the blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("id outside the vocabulary")
    size = block_ids(len(ids))
    entries, payloads = [], []
    for low in range(0, len(ids), size * ENCODED_LANES):
        own = ids[low : low + size * ENCODED_LANES]
        lanes = -(-len(own) // size)
        short = len(own) - (lanes - 1) * size
        for i, payload in enumerate(_encode_group(_in_step(own, lanes, size), short, vocabulary)):
            entries.append(struct.pack("<II", len(payload), zlib.crc32(own[i * size : (i + 1) * size].tobytes())))
            payloads.append(payload)
    return MAGIC + struct.pack("<IIQ", vocabulary, size, len(ids)) + b"".join(entries) + b"".join(payloads)


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block is damaged."""
    if segment[:4] != MAGIC or len(segment) < 20:
        raise ValueError("not a token segment")
    vocabulary, size, count = struct.unpack_from("<IIQ", segment, 4)
    blocks = -(-count // size)
    entries = np.frombuffer(segment, "<u4", 2 * blocks, 20).reshape(-1, 2).astype(np.int64)
    ends = 20 + 8 * blocks + np.cumsum(entries[:, 0])
    if blocks and ends[-1] != len(segment):
        raise ValueError("segment cut short")
    out = [np.zeros(0, "<u4")]
    for low in range(0, blocks, LANES):
        high = min(low + LANES, blocks)
        payloads = [segment[ends[i] - entries[i, 0] : ends[i]] for i in range(low, high)]
        short = min(count - (high - 1) * size, size)
        grid = _decode_group(payloads, size if high - low > 1 else short, short, vocabulary)
        for i in range(low, high):
            plain = grid[: min(count - i * size, size), i - low].astype("<u4")
            if zlib.crc32(plain.tobytes()) != entries[i, 1]:
                raise ValueError(f"block {i} is damaged")
            out.append(plain)
    return np.concatenate(out)
