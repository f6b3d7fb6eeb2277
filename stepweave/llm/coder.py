"""Adaptive context-mixing range coder for token ids, many blocks in step.

Each id is one interval of a mixed distribution over three predictions and a rest:

* order 2: the id that mostly followed the previous two ids in this block,
* order 1: the id that mostly followed the previous id,
* order 0: all ids before the last refresh, by their counts; refreshed whenever the block has grown by a half,
* the rest: ids that none of them knows, which are then coded by the plain 16 bits.

A prediction carries a count, which rises when it holds and falls when it fails; at zero the id is replaced.
The weights of the mix adapt to what came true under the same two counts. A range coder with a
48-bit width and 16-bit output words does the rest; carries are settled at the end of a block. All
arithmetic is on integers (quotients of floats are exact at these sizes), so every machine decodes alike.

Blocks know nothing of each other: each begins with empty statistics. That lets a NumPy call work
on one step of hundreds of blocks, which is what makes a sequential coder affordable in Python.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

LANES = 2560  # blocks coded in step, or up to a quarter more: bounds memory at about 0.06 MB each for blocks of 4,096 ids
SLOTS = 512  # of predictions, a block and order: more of them save half a percent and are slower
COUNT = 7  # of a prediction, at most
RATE = 4  # weights move by a 16th
LONGEST = 4096  # ids a block, at most: order 0 has at least that many of the 65,536 shares
LARGEST = 1 << 16  # ids lie below

_FULL = 1 << 48
_TIGHT = 1 << 32
_LOW = _TIGHT - 1
_LAST = (1 << 16) - LONGEST - 16
#: Where the shares of order 2, order 1 and the rest end; order 0 has what remains. A row for each outcome, by bits:
#: order 2 held, order 1 held, order 0 knows the id. The first column stays zero, so that a row is one 64-bit integer.
_ORDER2, _ORDER1, _REST, _ORDER0 = (
    [0, _LAST - 128, _LAST - 64, _LAST],
    [0, 64, _LAST - 64, _LAST],
    [0, 64, 128, _LAST],
    [0, 64, 128, 192],
)
_TARGETS = np.array([_REST, _ORDER2, _ORDER1, _ORDER2, _ORDER0, _ORDER2, _ORDER1, _ORDER2], np.uint16) >> RATE
_TARGETS = _TARGETS.view(np.uint64).reshape(-1)
_HASH2, _HASH1, _HASH0 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1), np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - (SLOTS - 1).bit_length())


def _refreshes(steps: int) -> list[int]:
    """Positions at which order 0 counts anew."""
    found, at = [], 16
    while at < steps:
        found.append(at)
        at += max(at >> 1, 16)
    return found


class Model:
    """Predictions and weights of some blocks ("lanes"), which take one id each per step."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.guesses = np.zeros(2 * lanes * SLOTS, np.int32)  # id * 8 + count
        self.slot0 = np.stack([lane, lane + lanes]) * SLOTS
        contexts = 2 * (COUNT + 1) ** 2
        self.shares = np.full((contexts * lanes, 4), (0, 12_000, 24_000, 44_000), np.uint16).view(np.uint64).reshape(-1)
        self.lanes, self.lane = lanes, lane
        self.hash = np.zeros((2, lanes), np.uint32)
        self.before = np.zeros(lanes, np.uint32)

    def begin(self, m: int) -> None:
        """Look up what the first m lanes expect next: guesses of order 2 and 1, and where the shares end."""
        self.slot = (self.hash[:, :m] >> _SHIFT) + self.slot0[:, :m]
        self.found = self.guesses.take(self.slot)
        self.guess, self.count = self.found >> 3, self.found & COUNT
        # Lanes of one context are neighbours in memory.
        context = (((self.count[0] << 3) + self.count[1]) << 1) + (self.guess[0] == self.guess[1])
        self.row = context * self.lanes + self.lane[:m]
        self.old = self.shares.take(self.row).view(np.uint16)
        ends = self.old.reshape(m, 4).T.astype(np.int32, order="C")
        self.end2, self.end1, self.rest = ends[1], ends[2], ends[3]

    def learn(self, ids: np.ndarray, hit: np.ndarray, known: np.ndarray) -> None:
        """Update with the ids that came: which guesses held, and whether order 0 knew them."""
        m = len(ids)
        bits = hit.view(np.uint8)
        outcome = bits[0] + (bits[1] << 1) + (known.view(np.uint8) << 2)
        new = self.old - (self.old >> RATE) + _TARGETS.take(outcome).view(np.uint16)
        self.shares[self.row] = new.view(np.uint64)
        found = np.where(self.count <= 1, (ids << 3) + 1, self.found - 1)
        held = np.flatnonzero(hit)
        old = self.found.take(held)
        found.put(held, np.minimum(old + 1, old | COUNT))
        self.guesses[self.slot] = found
        ids = ids.view(np.uint32)
        np.add(ids * _HASH0, self.before[:m], out=self.hash[0, :m])
        np.multiply(ids, _HASH1, out=self.hash[1, :m])
        np.multiply(ids, _HASH2, out=self.before[:m])


def groups[T](items: Sequence[T]) -> list[Sequence[T]]:
    """Those that are coded in step. A few blocks take almost as long as many, so groups are of about one size."""
    n = -(-len(items) * 4 // (LANES * 5))
    size = -(-len(items) // max(n, 1))
    return [items[at : at + size] for at in range(0, len(items), max(size, 1))]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Code each block, of up to ``LONGEST`` ids below ``LARGEST``, on its own."""
    if any(len(b) > LONGEST for b in blocks):
        raise ValueError(f"a block holds at most {LONGEST} ids")
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for group in groups(order):
        for i, data in zip(group, _encode([blocks[i] for i in group]), strict=True):
            out[i] = data
    return out


def decode(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
    order = sorted(range(len(data)), key=lambda i: -sizes[i])
    for group in groups(order):
        found = _decode([data[i] for i in group], [sizes[i] for i in group])
        for i, ids in zip(group, found, strict=True):
            out[i] = ids
    return out


def _running(sizes: np.ndarray) -> np.ndarray:
    """Lanes that still have ids at each step; sizes come in falling order."""
    return np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")


def _counted(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a block, its count at the last refresh and that of all smaller ids."""
    order = np.argsort(block.astype(np.uint16), kind="stable")
    new = np.zeros(len(block), np.int64)
    new[1:] = block[order[1:]] != block[order[:-1]]
    rank = np.empty(len(block), np.int64)
    rank[order] = np.cumsum(new)
    kinds = int(new.sum()) + 1
    level = _levels(len(block))
    at = level * kinds + rank
    counts = np.zeros((int(level.max(initial=0)) + 2, kinds), np.int32)
    counts[1:] = np.bincount(at, minlength=(len(counts) - 1) * kinds).reshape(-1, kinds)
    np.cumsum(counts, axis=0, out=counts)
    below = np.cumsum(counts, axis=1, dtype=np.int32)
    own = counts.take(at)
    return below.take(at) - own, own


@functools.cache
def _levels(steps: int) -> np.ndarray:
    """How many refreshes there were until each step."""
    return np.searchsorted(_refreshes(steps), np.arange(steps), "right")


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    n = len(blocks)
    steps = int(sizes[0]) if n else 0
    rows = np.zeros((3, n, steps), np.uint16)  # ids, and their counts: of smaller ones, and their own
    for i, block in enumerate(blocks):
        rows[0, i, : len(block)] = block
        rows[1, i, : len(block)], rows[2, i, : len(block)] = _counted(block)
    model = Model(n)
    low, width = np.zeros(n, np.int64), np.full(n, _FULL, np.int64)
    words = np.zeros((2 * steps + 4, n), np.uint32)  # with carries; lanes are about equally far, so they write side by side
    flat, used = words.reshape(-1), np.arange(n)
    refreshes, total = set(_refreshes(steps)), 1
    for step, m in enumerate(_running(sizes)):
        if step in refreshes:
            total = step
        model.begin(m)
        if not step % 64:
            some = np.ascontiguousarray(rows[:, :, step : step + 64].transpose(2, 0, 1).astype(np.int32))
        now, a, c = some[step % 64, :, :m]
        end2, end1, rest = model.end2, model.end1, model.rest
        hit, known = model.guess == now, c > 0
        left = (1 << 16) - rest
        start, end = rest + a * left // total, rest + (a + c) * left // total
        plain = np.flatnonzero(~(hit[0] | hit[1] | known))
        start[plain], end[plain] = end1[plain], rest[plain]
        by1 = np.flatnonzero(hit[1])
        start[by1], end[by1] = end2[by1], end1[by1]
        by2 = np.flatnonzero(hit[0])
        start[by2], end[by2] = 0, end2[by2]
        lows, widths, at = low[:m], width[:m], used[:m]
        unit = widths >> 16
        lows += unit * start
        np.multiply(unit, end - start, out=widths)
        # A word goes out where the width is tight; elsewhere the same place is written again later.
        tight = (widths < _TIGHT).astype(np.int64)
        flat[at] = lows >> 32
        at += tight * n
        lows &= (tight - 1) | _LOW
        tight <<= 4
        lows <<= tight
        widths <<= tight
        if len(plain):  # 16 bits, always a word
            unit = width[plain] >> 16
            moved = low[plain] + unit * now[plain]
            at = used[plain]
            flat[at] = moved >> 32
            used[plain] = at + n
            low[plain] = (moved & _LOW) << 16
            width[plain] = unit << 16
        model.learn(now, hit, known)
    for _ in range(3):
        flat[used] = low >> 32
        used += n
        low = (low & _LOW) << 16
    used //= max(n, 1)
    del rows, model
    words = np.ascontiguousarray(words[: int(used.max(initial=0))].T)
    flat = words.reshape(-1)
    while True:  # a carry seldom goes further than a word or two
        carry = np.flatnonzero(flat > 0xFFFF)
        if not len(carry):
            break
        flat[carry] &= 0xFFFF
        flat[carry - 1] += 1
    return [words[i, : used[i]].astype("<u2").tobytes() for i in range(n)]


def _table(seen: np.ndarray) -> np.ndarray:
    """Order 0 of each lane from its ids so far: sorted, and packed with where the equal ones begin and end."""
    rows = np.sort(seen, axis=1, kind="stable")
    m, t = rows.shape
    new = np.ones((m, t + 1), bool)
    new[:, 1:-1] = rows[:, 1:] != rows[:, :-1]
    begins = np.flatnonzero(new[:, :-1])
    sizes = np.diff(np.append(begins, m * t))
    kinds = rows.reshape(-1)[begins].astype(np.int64)
    starts = begins % t
    return np.repeat((kinds << 32) + (starts << 16) + starts + sizes, sizes)


def _decode(data: list[bytes], counts: list[int]) -> list[np.ndarray]:
    sizes = np.array(counts, np.int64)
    n = len(data)
    steps = int(sizes[0]) if n else 0
    words = np.zeros((n, max(map(len, data), default=0) // 2 + 4), np.uint16)
    for i, raw in enumerate(data):
        words[i, : len(raw) // 2] = np.frombuffer(raw, "<u2")
    words = np.ascontiguousarray(words.T)  # lanes are about equally far, so they read side by side
    ahead = np.zeros(n, np.int64)  # of the low end
    for k in range(3):
        ahead = (ahead << 16) | words[k]
    flat, used = words.reshape(-1), np.arange(n) + 3 * n
    model = Model(n)
    width = np.full(n, _FULL, np.int64)
    out = np.zeros((steps, n), np.uint16)
    refreshes, total = set(_refreshes(steps)), 1
    table = np.ones(n, np.int64)

    for step, m in enumerate(_running(sizes)):
        if step in refreshes:
            total = step
            table = np.empty(m * step, np.int64)
            for k in range(0, m, 64):  # few at a time stay in the processor's cache
                table[k * step : (k + 64) * step] = _table(np.ascontiguousarray(out[:step, k : min(k + 64, m)].T))
            first = np.arange(m) * step
        elif not step:
            first = np.arange(m)
        model.begin(m)
        end2, end1, rest = model.end2, model.end1, model.rest
        lows, widths, at = ahead[:m], width[:m], used[:m]
        unit = widths >> 16
        value = (lows / unit).astype(np.int32)
        left = (1 << 16) - rest
        known = value >= rest
        place = (((value - rest + 1) * total - 1) / left).astype(np.int64)
        place += first[:m]
        entry = table.take(place, mode="clip")
        now = (entry >> 32).astype(np.int32)
        start = rest + ((entry >> 16) & 0xFFFF).astype(np.int32) * left // total
        end = rest + (entry & 0xFFFF).astype(np.int32) * left // total
        plain = np.flatnonzero((value >= end1) & ~known)
        start[plain], end[plain] = end1[plain], rest[plain]
        by1 = np.flatnonzero(value < end1)
        start[by1], end[by1], now[by1] = end2[by1], end1[by1], model.guess[1, by1]
        by2 = np.flatnonzero(value < end2)
        start[by2], end[by2], now[by2] = 0, end2[by2], model.guess[0, by2]
        lows -= unit * start
        np.multiply(unit, end - start, out=widths)
        tight = (widths < _TIGHT).astype(np.int64)
        word = flat.take(at, mode="clip") & -tight
        at += tight * n
        tight <<= 4
        lows <<= tight
        lows |= word
        widths <<= tight
        if len(plain):
            unit, some, at = width[plain] >> 16, ahead[plain], used[plain]
            now[plain] = value = (some / unit).astype(np.int32)
            ahead[plain] = ((some - unit * value) << 16) | flat.take(at, mode="clip")
            used[plain] = at + n
            width[plain] = unit << 16
        hit = model.guess == now
        model.learn(now, hit, known)
        out[step, :m] = now
    out = np.ascontiguousarray(out.T)
    return [out[i, :c].astype(np.uint32) for i, c in enumerate(counts)]
