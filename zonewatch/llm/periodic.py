"""Periodic runs of words: stretches that repeat a short sequence of words several times over.

Maximal pairs are enumerated over the words of a text. A pair of places i < j with L equal words behind
each, whose left and whose right neighbours differ, and with j - i <= L / (exponent - 1), spans a stretch
i to j + L with period j - i that no neighbour extends: such pairs are exactly the runs, and of several
periods of one stretch the smallest is its own. Texts are sorted by suffixes (ranks of 1, 2, 4, ...
words, only places that aren't told apart yet are sorted again), which gives the common lengths of
neighbours, and LCP intervals are joined bottom-up. A node holds its places in order with their classes
(left word); the smaller child is looked up in the larger one, within the distance that the node's depth
allows. Places so near to each other lie a period apart, and all but their first one have the same left
word: so the search stops at the first place of one's own class, and a node of one class gives no pair.

Before that, whole texts are left out in which no gram of the least common length comes again near enough,
and intervals whose places have one class or are too far apart. Those are bounds, not samples.

Python works on one text or a few at a time inside a task; nothing is shuffled, so no key can be hot.
Null and empty texts have no words and no runs. Rows that repeat give equal results; kept columns are
carried in Arrow and may be named like anything. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import annotate

FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least_common(min_length: int, exponent: int) -> int:
    """The least number of equal words that the two places of a run's pair have behind them."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def _suffix_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, words that each shares with the one before) of texts side by side. Each
    text's keys are its own and end with a key that occurs once."""
    m = len(key)
    order = np.argsort(key, kind="stable")
    first = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    open_ = order[~(first & np.append(first[1:], True))]
    levels, k = [rank], 1
    while len(open_):
        old, next_ = rank[open_], rank[open_ + k]  # no text ends within the words that are still alike
        by = np.argsort(old * m + next_, kind="stable")
        open_, old, next_ = open_[by], old[by], next_[by]
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, next_[1:] != next_[:-1])
        at = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
    places = np.empty(m, np.int64)
    places[rank] = np.arange(m)
    a, b, shared = places[:-1].copy(), places[1:].copy(), np.zeros(m, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = (levels[level][a] == levels[level][b]).astype(np.int64) << level
        a += step
        b += step
        shared[1:] += step
    return places, shared


def _join(one: tuple, two: tuple, depth: int, left, reach: int, least: int, found: dict) -> tuple:
    """Two children of an interval as one node (places in order, class or None for several), and the runs
    among pairs between them: found[start, end] = smallest period."""
    big, small = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
    kind = big[1] if big[1] == small[1] else None
    places = big[0]
    if kind is None:
        def pair(x: int, y: int) -> None:
            q = y - x
            if q + depth >= least:
                found[x, y + depth] = min(q, found.get((x, y + depth), q))

        for x in small[0]:
            at = bisect_left(places, x - reach)
            if at < len(places) and places[at] < x and left[places[at]] != left[x]:
                pair(places[at], x)
            at = bisect_right(places, x)
            while at < len(places) and places[at] <= x + reach and left[places[at]] != left[x]:
                pair(x, places[at])
                at += 1
    for x in small[0]:
        if not places or x > places[-1]:
            places.append(x)
        else:
            places.insert(bisect_left(places, x), x)
    return places, kind


def _pairs(places: list[int], shared: list[int], left, exponent: int, least: int, found: dict) -> None:
    """Bottom-up over the LCP intervals of neighbouring suffixes; shared[t] is between t - 1 and t."""
    stack: list[list] = []  # [depth, node]

    def close(node: tuple, most: int) -> tuple:
        while stack and stack[-1][0] > most:
            depth, before = stack.pop()
            node = _join(before, node, depth, left, depth // (exponent - 1), least, found)
        return node

    node = ([places[0]], left[places[0]])
    for t in range(1, len(places)):
        depth, node = shared[t], close(node, shared[t])
        if stack and stack[-1][0] == depth:
            stack[-1][1] = _join(stack[-1][1], node, depth, left, depth // (exponent - 1), least, found)
        else:
            stack.append([depth, node])
        node = ([places[t]], left[places[t]])
    close(node, -1)


def _repeating(ids: np.ndarray, ends: np.ndarray, gram: int, exponent: int) -> np.ndarray:
    """The texts in which some gram comes again within 1 / exponent of the text's words."""
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    n = len(ids) - gram + 1
    if n < 2:
        return np.zeros(0, np.int64)
    mix = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(gram):
        mix = (mix ^ ids[k:k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mix ^= mix >> np.uint64(32)
    whole = np.flatnonzero(doc[:n] == doc[gram - 1:])  # grams inside one text
    by = whole[np.argsort(mix[whole], kind="stable")]
    again = np.flatnonzero(mix[by][1:] == mix[by][:-1])
    gap, owner = by[again + 1] - by[again], doc[by[again]]
    return np.unique(owner[(gap > 0) & (gap * exponent <= sizes[owner]) & (owner == doc[by[again + 1]])])


def runs_of(texts: list[list], min_length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, given as its words, in order of start and period."""
    gram, out = least_common(min_length, exponent), [[] for _ in texts]
    number: dict = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    some = _repeating(ids, ends, gram, exponent)
    if not len(some):
        return out
    width, starts, at = len(number) + 1, [], 0
    keys = np.empty(int(sizes[some].sum()) + len(some), np.int64)
    for k, d in enumerate(some):
        starts.append(at)
        n = int(sizes[d])
        keys[at:at + n] = ids[ends[d] - n:ends[d]] + k * width
        keys[at + n] = (k + 1) * width - 1
        at += n + 1
    places, shared = _suffix_order(keys)
    left = np.append(-1, keys[:-1])
    first = np.flatnonzero(shared < gram)  # where a stretch of suffixes that share a gram begins
    of = left[places]
    classes = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    deepest = np.maximum.reduceat(np.where(shared >= gram, shared, 0), first)
    wide = np.flatnonzero(classes & (deepest > 0))
    if not len(wide):
        return out
    after = np.append(first, len(places))
    found: dict = {}
    for w in wide:
        span = slice(first[w], after[w + 1])
        gaps = np.diff(np.sort(places[span]))
        if int(gaps.min()) * (exponent - 1) <= int(deepest[w]):
            own = places[span].tolist()
            _pairs(own, shared[span].tolist(), dict(zip(own, of[span].tolist())), exponent, min_length, found)
    which = np.searchsorted(starts, [s for s, _ in found], side="right") - 1
    for ((start, end), q), k in zip(found.items(), which):
        out[some[k]].append((start - starts[k], end - start, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find(docs: DataFrame, keep: list[str], text_col: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """The kept columns with n_words, runs and collapsed: the words outside repetitions, joined by a blank.
    An exponent under 3 is refused: places of one class needn't lie together then."""
    if exponent < 3:
        raise ValueError("a run is at least three periods long")

    def compute():
        import pyarrow as pa

        def of(texts: list) -> list:
            words = [[] if t is None else t.encode().split() for t in texts]  # bytes.split parts at exactly 20, 09-0D
            runs = runs_of(words, min_length, exponent)
            flat = list(chain.from_iterable(runs))
            parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
            return [pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                    pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())]

        return of

    return annotate(docs, keep, text_col, compute, FOUND)
