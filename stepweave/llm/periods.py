"""Periodic runs of words: stretches that repeat a shorter one several times over.

Every run has a Lyndon root: for one of two opposite orders of words, the longest Lyndon word that starts at some
place of the run is as long as its period. So each place offers two candidates, and longest common extensions in both
directions tell how far each goes. Extensions come from two suffix trees, of the text and of its reversal, built by
Ukkonen's algorithm: that of two suffixes is the depth of their lowest common ancestor, the least depth
between them on an Euler tour, which a table of minima answers in constant time. The order of suffixes, and with it the Lyndon
words, is the order of the leaves.

A word of a run stands in it as often as the run has periods. So a text falls apart, exactly, at words
that stand in it fewer times than that, and its parts again; trees are built over what is left. Parts of many texts
share a tree, with a symbol of its own between any two, across which nothing extends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx


@dataclass(frozen=True)
class Runs:
    """What counts: at least ``times`` periods, 2 or more, and at least ``words`` words."""

    times: int = 4
    words: int = 6


TREE_WORDS = 1 << 15  # parts of texts that share a tree; one longer part has its own
BLOCK = 16  # of the table of minima

_AS_IS = np.arange(256, dtype=np.uint8)
_AS_IS[[32, 9, 10, 11, 12, 13, 0]] = 0
_AS_IS[0] = 255  # as in ``text``: NUL is part of a word


def periodic_runs(
    docs: DataFrame, config: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, start, length, period, exponent_milli, runs, collapsed.

    Words are what stands between ASCII white space, numbered from 0. ``runs`` holds all of them as structs (start, length, period)
    in that order. The four values before it are of the longest, the first of smallest period at ties; null without a run.
    ``collapsed`` is the text with one space between words and without those that a run holds behind its first period.
    Null and empty texts and those without words have no runs and collapse to an empty text. Repeated rows
    and rows of a null id are rows like any other; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        lambda batches: _batches(batches, config),
        f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )
    return found.withColumnRenamed("id", id_col)


# In tasks


def _batches(batches: Iterator[pa.RecordBatch], config: Runs) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch["text"]):
            doc, start, length, period = runs_of(part, config)
            # The longest of a document, then the first, then that of the smallest period.
            order = np.lexsort((period, start, -length, doc))
            best = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            bounds = np.searchsorted(doc, np.arange(len(part) + 1))
            top = np.full((4, len(part)), -1, np.int64)
            top[:, doc[best]] = start[best], length[best], period[best], 1000 * length[best] // period[best]
            lists = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()),
                pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].slice(part.first, len(part)),
                    pa.array(np.diff(bounds)),
                    *[pa.array(row, mask=row < 0) for row in top],
                    lists,
                    pa.array(_collapsed(part, bounds, start, length, period), pa.string()),
                ],
                ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
            )


def _collapsed(part: tx.Texts, bounds, start, length, period) -> list[bytes]:
    out = []
    for d in range(len(part)):
        words = part.data[part.offsets[d] : part.offsets[d + 1]].tobytes().split()
        if bounds[d] < bounds[d + 1]:
            edges = np.zeros(len(words) + 1, np.int64)
            own = slice(bounds[d], bounds[d + 1])
            np.add.at(edges, start[own] + period[own], 1)
            np.add.at(edges, start[own] + length[own], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
        out.append(b" ".join(words))
    return out


def runs_of(part: tx.Texts, config: Runs) -> tuple[np.ndarray, ...]:
    """Document, first word, length and period of every run, in this order and sorted by document, start, period."""
    found = tx.words(part, _AS_IS)
    places, parts, symbols = _parts(found.doc, found.hash, config)
    rows = []
    sizes = np.bincount(parts)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        begin = ends[first] - sizes[first]
        last = max(int(np.searchsorted(ends, begin + TREE_WORDS, "right")), first + 1)
        own = slice(begin, ends[last - 1])
        _, dense = np.unique(symbols[own], return_inverse=True)
        at, length, period = _tree_runs(dense, parts[own] - first, config)
        rows.append((places[own][at], length, period))
        first = last
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*rows, strict=True))
    doc = found.doc[at]
    order = np.lexsort((period, at))
    return doc[order], (at - found.bounds[doc])[order], length[order], period[order]


def _parts(doc: np.ndarray, word: np.ndarray, config: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that may stand in a run: places, the parts they make (numbered from 0), and symbols."""
    places, parts = np.arange(len(doc)), doc
    symbols = np.unique(word, return_inverse=True)[1]
    while len(places):
        _, key, often = np.unique(parts * np.int64(len(doc)) + symbols, return_inverse=True, return_counts=True)
        keep = often[key] >= config.times
        whole = keep.all()
        places, parts, symbols = places[keep], parts[keep], symbols[keep]
        fresh = np.diff(places, prepend=-2) > 1
        fresh |= np.diff(parts, prepend=-1) != 0
        parts = np.cumsum(fresh) - 1
        keep = np.bincount(parts)[parts] >= config.words if len(parts) else np.zeros(0, bool)
        places, symbols = places[keep], symbols[keep]
        parts = np.unique(parts[keep], return_inverse=True)[1]
        if whole and keep.all():
            break
    return places, parts, symbols


def _tree_runs(symbols: np.ndarray, parts: np.ndarray, config: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first word among ``symbols``, length and period of all runs of the parts."""
    # One symbol between parts that stands nowhere else.
    gaps = np.flatnonzero(np.diff(parts)) + 1
    line = np.insert(symbols, gaps, symbols.max() + 1 + np.arange(len(gaps)))
    origin = np.insert(np.arange(len(symbols)), gaps, -1)
    n = len(line)
    ahead, back = SuffixTree(line), SuffixTree(line[::-1])
    found = []
    for rank in (ahead.ranks(), ahead.ranks(opposite=True)):
        place = np.arange(n)
        period = _next_smaller(rank) - place
        fits = (period * config.times <= n) & (place + period < n)
        place, period = place[fits], period[fits]
        right = ahead.extension(place, place + period)
        left = np.zeros(len(place), np.int64)
        inner = place > 0
        left[inner] = back.extension(n - place[inner], n - place[inner] - period[inner])
        length = left + period + right
        good = (length >= config.times * period) & (length >= config.words)
        found.append(np.stack([place - left, length, period])[:, good])
    at, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return origin[at], length, period


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next place where a smaller one starts; the end for those without."""
    n = len(rank)
    values = rank.tolist()
    following = [n] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        mine = values[i]
        while j < n and values[j] > mine:
            j = following[j]
        following[i] = j
    return np.array(following)


class SuffixTree:
    """Ukkonen's suffix tree of whole numbers from 0, with an end mark below all of them.

    About half a kilobyte a symbol while it is built, a third of that afterwards."""

    def __init__(self, line: np.ndarray):
        self.n = len(line)
        self._build([*(line + 1).tolist(), 0], int(line.max(initial=0)) + 2)
        self._tour()

    def _build(self, line: list[int], k: int) -> None:
        """``child`` maps node * k + symbol to the node below; edges are spans of ``line``; leaves end where it ends."""
        n = len(line)
        start, end, link, suffix = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        look = child.get
        node = edge = along = left = 0
        for i, symbol in enumerate(line):
            left += 1
            waiting = 0
            while left:
                if not along:
                    edge = i
                below = look(node * k + line[edge])
                if below is None:
                    child[node * k + line[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), suffix.append(i - left + 1)
                    if waiting:
                        link[waiting] = node
                    waiting = 0
                else:
                    width = end[below] - start[below]
                    if along >= width:
                        edge += width
                        along -= width
                        node = below
                        continue
                    if line[start[below] + along] == symbol:
                        along += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(start)
                    start.append(start[below]), end.append(start[below] + along), link.append(0), suffix.append(-1)
                    child[node * k + line[edge]] = middle
                    child[middle * k + symbol] = len(start)
                    start.append(i), end.append(n), link.append(0), suffix.append(i - left + 1)
                    start[below] += along
                    child[middle * k + line[start[below]]] = below
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                left -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - left + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self._parent, self._symbol = np.divmod(keys, k)
        self._node = np.fromiter(child.values(), np.int64, len(child))
        self._k = k
        self._width = np.array(end) - np.array(start)
        self._suffix = np.array(suffix)

    def _children(self, opposite: bool) -> tuple[list[int], list[int]]:
        """Nodes by parent and first symbol, and where each parent's begin. The end mark is first in both orders."""
        symbol = np.where(self._symbol > 0, self._k - self._symbol, 0) if opposite else self._symbol
        order = np.lexsort((symbol, self._parent))
        bounds = np.searchsorted(self._parent[order], np.arange(len(self._width) + 1))
        return self._node[order].tolist(), bounds.tolist()

    def ranks(self, opposite: bool = False) -> np.ndarray:
        """Places of all suffixes but the empty one in their order, or in that of opposite symbols."""
        if not opposite:
            leaves = self._leaves
        else:
            nodes, bounds = self._children(True)
            stack, leaves = [0], []
            while stack:
                node = stack.pop()
                a, b = bounds[node], bounds[node + 1]
                if a == b:
                    leaves.append(node)
                else:
                    stack += nodes[a:b][::-1]
        rank = np.empty(self.n + 1, np.int64)
        rank[self._suffix[leaves]] = np.arange(len(leaves))
        return rank[: self.n]

    def _tour(self) -> None:
        """Depths, in symbols, of the nodes that an Euler tour comes by, and where it meets each leaf."""
        nodes, bounds = self._children(False)
        width = self._width.tolist()
        depths, leaves, met = [], [], []
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:
                depths.append(depth)  # back at the parent
                continue
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                met.append(len(depths))
                leaves.append(node)
            depths.append(depth)
            for below in nodes[a:b][::-1]:
                stack.append((-1, depth))
                stack.append((below, depth + width[below]))
        self._leaves = leaves
        self._met = np.empty(self.n + 1, np.int64)
        self._met[self._suffix[leaves]] = met
        # Minima of blocks in a table of powers of two, and within each block from both of its ends.
        padded = np.full(-(-len(depths) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        blocks = padded.reshape(-1, BLOCK)
        self._depth = padded
        self._from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self._from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._least = [blocks.min(axis=1)]
        while 2 ** len(self._least) <= len(blocks):
            half = 2 ** (len(self._least) - 1)
            last = self._least[-1]
            self._least.append(np.minimum(last[:-half], last[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the different suffixes at ``a`` and ``b`` agree."""
        x, y = self._met[a], self._met[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        first, last = low // BLOCK, high // BLOCK
        out = np.minimum(self._from_right[low], self._from_left[high])
        same = np.flatnonzero(first == last)
        span = low[same, None] + np.arange(BLOCK)
        beyond = span > high[same, None]
        span[beyond] = np.broadcast_to(high[same, None], span.shape)[beyond]
        out[same] = self._depth[span].min(axis=1)
        between = last - first - 1
        level = np.where(between > 0, np.frexp(between)[1] - 1, -1)
        for step in range(len(self._least)):
            at = np.flatnonzero(level == step)
            least = self._least[step]
            out[at] = np.minimum(out[at], np.minimum(least[first[at] + 1], least[last[at] - 2**step]))
        return out.astype(np.int64)
