"""Suffix sorting by induction, with its queues on disk where they outgrow memory.

A suffix is of type S if it is less than the next one, else L. The S suffixes after an L suffix (S*) are sorted first:
the stretches between them are sorted and named, and the string of names, about a third as long, is sorted by the same
method. Where the alphabet of names is large, and buckets would hold a few suffixes each, prefix doubling over the
names ends the recursion instead. All other suffixes are induced: in ascending order of buckets each suffix places the
L suffix before it, then in descending order the S suffix before it. What is placed waits in its bucket's queue.

Memory: the queues hold at most `memory` suffixes; longer ones are written out in sorted runs and read bucket by bucket.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict

import numpy as np

LARGE_ALPHABET = 1024


class BucketQueues:
    """A queue of text places for each bucket; a priority queue, as buckets are taken in order."""

    def __init__(self, memory: int, folder: str):
        self.memory, self.folder, self.held = memory, folder, 0
        self.parts: dict[int, list[np.ndarray]] = defaultdict(list)
        self.runs: dict[int, list[str]] = defaultdict(list)
        self.written = 0

    def push(self, buckets: np.ndarray, places: np.ndarray) -> None:
        """Appends places to their buckets; their order within a bucket is kept."""
        if not len(places):
            return
        order = np.argsort(buckets, kind="stable")
        buckets, places = buckets[order], places[order]
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for b, part in zip(buckets[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
            self.parts[b].append(part)
        self.held += len(places)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for b in sorted(self.parts):
            path = os.path.join(self.folder, f"{id(self)}-{self.written}.npy")
            np.save(path, np.concatenate(self.parts[b]))
            self.runs[b].append(path)
            self.written += 1
        self.parts.clear()
        self.held = 0

    def take(self, bucket: int) -> np.ndarray:
        """All of a bucket, in the order of arrival."""
        found = []
        for path in self.runs.pop(bucket, ()):
            found.append(np.load(path))
            os.remove(path)
        for part in self.parts.pop(bucket, ()):
            found.append(part)
            self.held -= len(part)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def s_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last symbol is the least and alone."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))  # of equal symbols, what the next different one decides
    nxt = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1] if n > 1 else nxt
    out = np.ones(n, dtype=bool)
    out[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return out


def sort_suffixes(text: np.ndarray, memory: int = 1 << 22, depth: int | None = None, folder: str | None = None, alphabet: int | None = None) -> np.ndarray:
    """The places of all suffixes in ascending order. text: integers, of which the last is the least and occurs once.

    With a depth, suffixes that agree in so many symbols may come in any order.
    """
    if folder is None:
        with tempfile.TemporaryDirectory() as own:
            return sort_suffixes(text, memory, depth, own, alphabet)
    n = len(text)
    alphabet = alphabet or int(text.max()) + 1
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if alphabet > LARGE_ALPHABET:
        return doubled(text, depth)
    is_s = s_types(text)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    return induced(text, is_s, sorted_stars(text, is_s, stars, memory, depth, folder), alphabet, memory, folder)


def sorted_stars(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, memory: int, depth: int | None, folder: str) -> np.ndarray:
    """The S* suffixes in order, by the string of the names of the stretches between them."""
    m = len(stars)
    names = stretch_names(text, is_s, stars)
    if names.max() + 1 == m:
        order = np.empty(m, dtype=np.int64)
        order[names] = np.arange(m)
    else:
        # each stretch is two symbols or more
        order = sort_suffixes(names, memory, depth and depth // 2 + 1, folder, int(names.max()) + 1)
    return stars[order]


def stretch_names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The rank of each stretch, from one S* to the next inclusive, among the different stretches.

    Stretches are compared symbol by symbol and, of equal symbols, L before S; several symbols at a time in one number.
    """
    ends = np.append(stars[1:], stars[-1])
    symbols = text.astype(np.int64) * 2 + is_s + 1
    width = int(symbols.max()).bit_length()
    at_once = max(1, 62 // width)
    names = np.zeros(len(stars), dtype=np.int64)
    todo, offset = np.arange(len(stars)), 0
    while len(todo):
        key = np.zeros(len(todo), dtype=np.int64)
        for k in range(at_once):
            at = stars[todo] + offset + k
            key = (key << width) | np.where(at <= ends[todo], symbols[np.minimum(at, len(text) - 1)], 0)
        # groups still equal are split by their keys; names leave room for the splits, so others stay as they are
        order = np.lexsort((key, names[todo]))
        g, k = names[todo][order], key[order]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        new = first | np.concatenate([[True], k[1:] != k[:-1]])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        where = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        names[todo[order]] = g + (where - begin)
        offset += at_once
        todo = todo[stars[todo] + offset <= ends[todo]]
        if len(todo):  # only groups of two or more that go on
            _, back, n = np.unique(names[todo], return_inverse=True, return_counts=True)
            todo = todo[n[back] > 1]
    return np.unique(names, return_inverse=True)[1]


def doubled(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes in order by doubling the length of the prefixes that ranks compare, up to `depth` symbols.

    Ranks leave room for the suffixes of a group, so only groups that are not yet told apart are sorted again.
    """
    n, h = len(text), 1
    order = np.argsort(text, kind="stable")
    first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    todo = order[~alone]
    while len(todo) and (depth is None or h < depth):
        after = np.where(todo + h < n, rank[np.minimum(todo + h, n - 1)], -1)
        order = np.lexsort((after, rank[todo]))
        todo, after, group = todo[order], after[order], rank[todo][order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        new = first | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(todo))
        rank[todo] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        todo = todo[~(new & np.append(new[1:], True))]
        h *= 2
    return np.argsort(rank, kind="stable")


def induced(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, alphabet: int, memory: int, folder: str) -> np.ndarray:
    """All suffixes in order, from the S* suffixes in order."""
    def placed(source: np.ndarray, small: bool) -> np.ndarray:
        before = source[source > 0] - 1
        return before[is_s[before] == small]

    seeds = np.searchsorted(text[stars], np.arange(alphabet + 1))
    queues, large = BucketQueues(memory, folder), BucketQueues(memory, folder)
    # the last suffix is an S* one and the least of all
    for c in range(alphabet):
        wave = queues.take(c)
        while len(wave):  # a run of one symbol is induced within its bucket
            large.push(np.full(len(wave), c), wave)
            before = placed(wave, small=False)
            own = text[before] == c
            queues.push(text[before[~own]], before[~own])
            wave = before[own]
        before = placed(stars[seeds[c] : seeds[c + 1]], small=False)
        queues.push(text[before], before)
    queues, out = BucketQueues(memory, folder), []
    for c in range(alphabet - 1, -1, -1):
        small = []
        wave = queues.take(c)
        while len(wave):
            small.append(wave)
            before = placed(wave, small=True)
            own = text[before] == c
            queues.push(text[before[~own]], before[~own])
            wave = before[own]
        own_large = large.take(c)
        before = placed(own_large[::-1], small=True)
        queues.push(text[before], before)
        if c == 0:
            small = [np.array([len(text) - 1])]
        out.append(np.concatenate([own_large, *([np.concatenate(small)[::-1]] if small else [])]))
    return np.concatenate(out[::-1])
