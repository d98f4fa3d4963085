"""Periodic runs of words: maximal repetitions of a text, by suffix trees of it and of its reversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tasks import annotate
from turnwise.llm.words import Words, find_words, join_hash, joined, run_hashes

EXPONENT = 4  # periods a run has at least
LEAST = 6  # words a run has at least
GRAM = 3  # words of the grams that tell texts without a run
_BLOCK = 32  # depths of a tour that share a minimum


def next_same(keys: np.ndarray) -> np.ndarray:
    """How far ahead each value comes again; the length of the array where it does not."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), len(keys), np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def may_have_runs(hashes: np.ndarray, words: Words) -> np.ndarray:
    """Which texts may hold a run at all; a text that is turned away holds none.

    In a run of period q every gram but the last ones comes again within q words. So, for some power of two not below q and less than 2 q, there is a
    stretch of consecutive grams that come again within it, as long as the least run of such a period makes it."""
    out = np.zeros(len(words.counts), bool)
    grams = run_hashes(hashes, GRAM)
    if not len(grams):
        return out
    text = words.text_of()[: len(grams)]
    inside = words.room()[: len(grams)] >= GRAM
    # Grams that reach into the next text are told apart by their place, so they come nowhere again.
    keys = join_hash(grams, np.where(inside, text, len(text) + np.arange(len(grams))).astype(np.uint64))
    ahead = next_same(keys)
    upto = 1
    while upto < len(grams):
        q = upto // 2 + 1  # the least period of this step
        least = max(LEAST, EXPONENT * q) - q - GRAM + 1
        close = np.flatnonzero(ahead <= upto)
        if not len(close):
            upto *= 2
            continue
        breaks = np.flatnonzero(np.diff(close) != 1)
        first, last = close[np.concatenate(([0], breaks + 1))], close[np.concatenate((breaks, [len(close) - 1]))]
        # Grams of two texts are never consecutive here: the last ones of a text come nowhere again.
        out[text[first[last - first + 1 >= least]]] = True
        upto *= 2
    return out


@dataclass
class Tree:
    """A suffix tree. Node 0 is the root; leaf ``leaves[i]`` is the suffix that begins at i."""

    depth: np.ndarray  # symbols from the root to each node
    parent: np.ndarray
    first: np.ndarray  # first symbol of the edge to each node
    leaves: np.ndarray


def suffix_tree(symbols: np.ndarray) -> Tree:
    """Ukkonen's construction. The last symbol must occur nowhere else; symbols are 0 to n."""
    s = symbols.tolist()
    n, k = len(s), int(symbols.max()) + 1
    start, stop, link, parent, depth = [0], [0], [0], [0], [0]
    leaves: list[int] = []
    child: dict[int, int] = {}
    node = edge = length = remaining = 0
    for i, c in enumerate(s):
        remaining += 1
        last = -1  # the inner node made last, whose link is the next one found
        while remaining:
            if not length:
                edge = i
            key = node * k + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                stop.append(n)
                link.append(0)
                parent.append(node)
                depth.append(n - i + remaining - 1)
                if last >= 0:
                    link[last] = node
                    last = -1
            else:
                begin = start[to]
                span = stop[to] - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = to
                    continue
                if s[begin + length] == c:
                    if last >= 0:
                        link[last] = node
                    length += 1
                    break
                middle = len(start)
                child[key] = middle
                child[middle * k + c] = middle + 1
                child[middle * k + s[begin + length]] = to
                leaves.append(middle + 1)
                start += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                depth += (remaining - 1, n - i + remaining - 1)
                parent += (node, middle)
                start[to] = begin + length
                parent[to] = middle
                if last >= 0:
                    link[last] = middle
                last = middle
            remaining -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - remaining + 1
    first = symbols[np.array(start)]
    return Tree(np.array(depth), np.array(parent), first, np.array(leaves))


def euler_tour(tree: Tree) -> np.ndarray:
    """Nodes in the order a walk from the root meets them, a node again after each child; children by their first symbol."""
    n = len(tree.parent)
    order = np.lexsort((tree.first[1:], tree.parent[1:])) + 1
    bounds = np.searchsorted(tree.parent[order], np.arange(n + 1))
    order, at, end, parent = order.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), tree.parent.tolist()
    tour = []
    node = 0
    while True:
        tour.append(node)
        i = at[node]
        if i < end[node]:
            at[node] = i + 1
            node = order[i]
        elif node:
            node = parent[node]
        else:
            return np.array(tour)


class Extension:
    """Longest common extensions of suffixes: the depth of the lowest common ancestor of two leaves, which is the least depth of the tour between them.

    Minima over blocks of the tour and a table of doublings over them answer any number of questions in constant time each."""

    def __init__(self, symbols: np.ndarray):
        tree = suffix_tree(symbols)
        tour = euler_tour(tree)
        first = np.empty(len(tree.depth), np.int64)
        first[tour[::-1]] = np.arange(len(tour) - 1, -1, -1)
        self.place = first[tree.leaves]
        depth = tree.depth[tour].astype(np.int32)
        blocks = -(-len(depth) // _BLOCK)
        self.depth = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        self.depth[: len(depth)] = depth
        grid = self.depth.reshape(blocks, _BLOCK)
        self.before = np.minimum.accumulate(grid, axis=1).reshape(-1)  # least from the block's begin
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # least to the block's end
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half, above = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(above[:-half], above[half:]))

    def ranks(self) -> np.ndarray:
        """Place of each suffix in the order of suffixes."""
        out = np.empty(len(self.place), np.int64)
        out[np.argsort(self.place)] = np.arange(len(self.place))
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and j on are equal; i and j differ."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.after[a], self.before[b])
        near = np.flatnonzero(low == high)
        for at in range(0, len(near), 1 << 15):
            some = near[at : at + (1 << 15)]
            span = a[some, None] + np.arange(_BLOCK)
            depths = self.depth[np.minimum(span, b[some, None])]
            out[some] = depths.min(axis=1)
        gap = high - low - 1
        level = np.zeros(len(gap), np.int64)
        level[gap > 0] = np.floor(np.log2(gap[gap > 0])).astype(np.int64)
        for k, row in enumerate(self.table):
            mine = np.flatnonzero((gap > 0) & (level == k))
            out[mine] = np.minimum(out[mine], np.minimum(row[low[mine] + 1], row[high[mine] - (1 << k)]))
        return out.astype(np.int64)


def next_smaller(ranks: list[int]) -> list[int]:
    """The next place with a smaller value; the length where there is none."""
    n = len(ranks)
    out = [n] * n
    stack: list[int] = []
    for i, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period.

    Every run has a Lyndon root, under one of the two orders of symbols, that is the longest Lyndon word where it begins: from there to the next smaller suffix (under
    the other order: the next greater one). Two candidates for each place, extended as far as both directions agree, are therefore all."""
    n = len(words)
    symbols = np.unique(words, return_inverse=True)[1] + 1
    forward = Extension(np.append(symbols, 0))
    ranks = forward.ranks()[:n]
    place = np.arange(n)
    i = np.concatenate([place, place])
    j = np.concatenate([next_smaller(ranks.tolist()), next_smaller((-ranks).tolist())])
    some = (j < n) & (exponent * (j - i) <= n)
    i, j = i[some], j[some]
    onward = forward.of(i, j)
    del forward
    backward = Extension(np.append(symbols[::-1], 0))
    back = np.zeros(len(i), np.int64)
    inner = i > 0
    back[inner] = backward.of(n - i[inner], n - j[inner])
    start, period = i - back, j - i
    length = j + onward - start
    good = length >= np.maximum(least, exponent * period)
    return np.unique(np.stack([start[good], period[good], length[good]], 1), axis=0)[:, [0, 2, 1]]


def _text_runs(words: Words, hashes: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all texts of a chunk, and the texts' bounds among them."""
    found, sizes = [np.empty((0, 3), np.int64)], np.zeros(len(words.counts), np.int64)
    for text in np.flatnonzero(may_have_runs(hashes, words)):
        runs = runs_of(hashes[words.offsets[text] : words.offsets[text + 1]], exponent, least)
        found.append(runs)
        sizes[text] = len(runs)
    return np.concatenate(found), np.concatenate(([0], np.cumsum(sizes)))


def _collapsed(words: Words, runs: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The words of each text that no run holds beyond its first period, joined by one space."""
    base = words.offsets[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, base + runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, base + runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    at = np.concatenate(([0], np.cumsum(kept)))[words.offsets]
    starts, ends = words.starts[kept], words.ends[kept]
    return [joined(words.data, starts[a:b], ends[a:b]) for a, b in zip(at[:-1], at[1:])]


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``row`` (struct of a document's columns), ``n_words``, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``.

    Words end at the space and U+0009..U+000D. A run is a stretch of words with least period q and at least ``exponent`` periods and ``least`` words that cannot be
    made longer. ``collapsed`` is the text's words, joined by one space, without those that a run holds after its first q words. ``exponent`` is 4 and ``least`` 6 at
    least: shorter runs could escape the test below.

    The work is row by row, without a shuffle. Texts whose grams show that they hold no run (``may_have_runs``) have none; for all others two suffix trees are built
    in the task, about one kilobyte a word of the longest text. A null or empty text has no words, no runs and an empty collapsed text. Repeated rows are treated
    alike; an empty table gives an empty one."""
    if exponent < EXPONENT or least < LEAST:
        raise ValueError(f"runs have at least {EXPONENT} periods and {LEAST} words")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def begin():
        def step(column):
            words = find_words(column)
            runs, bounds = _text_runs(words, words.hashes(), exponent, least)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in range(3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)
            collapsed = pa.array([t.decode() for t in _collapsed(words, runs, bounds)], pa.string())
            return [pa.array(words.counts.astype(np.int64)), lists, collapsed]

        return step

    return annotate(docs, text, begin, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", keep)


def greatest(runs: Column) -> Column:
    """The run of the greatest exponent, compared exactly; of several the one with the smallest start, then period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)
