"""Sequential label propagation."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

# Fixed values of the shuffle's generator: multiplier, increment, modulus, first seed.
GENERATOR = (9301, 49297, 233280, 42)


def shuffled(n: int, seed: int) -> list[int]:
    """0 to n - 1 by exchanges from the end, with places drawn by the linear congruential generator."""
    a, c, m, _ = GENERATOR
    out = list(range(n))
    for left in range(n, 1, -1):
        seed = (seed * a + c) % m
        pick = seed * left // m
        out[left - 1], out[pick] = out[pick], out[left - 1]
    return out


def places(n: int, round_: int) -> list[int]:
    """Where each of n sorted nodes comes in a round."""
    return drawn(n, round_).tolist()


def drawn(n: int, round_: int) -> np.ndarray:
    """places() as four bytes a node."""
    out = np.empty(n, dtype=np.int32)
    out[shuffled(n, GENERATOR[3] + round_)] = np.arange(n, dtype=np.int32)
    return out


def propagated(order: dict[str, list[int]], links: list[tuple[str, str, int]]) -> dict[str, str]:
    """A label for each node: again and again, the one of greatest weight around it; of equals the least. order: the
    nodes, with their places in each round. Where nothing changes in a round, nothing does later."""
    names = sorted(order)
    number = {n: i for i, n in enumerate(names)}
    own = np.array([(number[u], number[v], w) for u, v, w in links if u in number and v in number], dtype=np.int64).reshape(-1, 3)
    found = labelled([np.array(p) for p in zip(*(order[n] for n in names))], own[:, 0], own[:, 1], own[:, 2])
    return {names[i]: names[x] for i, x in enumerate(found.tolist())} if names else {}


def labelled(order: list[np.ndarray], u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """propagated() for nodes that are numbers, from 0 in the order of their names: order has an array of places for each
    round. A node takes some 8 bytes a round, a link 24 and, while links are sorted, 40 more."""
    n = len(order[0]) if order else 0
    near = np.concatenate([u, v]).astype(np.int32)
    at = np.argsort(near, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))]).tolist()
    del near
    other = np.concatenate([v, u]).astype(np.int32)[at]
    weight = np.concatenate([w, w])[at]
    del at
    linked = np.flatnonzero(np.diff(starts))
    label = np.arange(n, dtype=np.int32)
    for place in order:
        before = label.copy()
        for i in linked[np.argsort(place[linked])]:
            a, b = starts[i], starts[i + 1]
            votes: dict[int, int] = defaultdict(int)
            for x, c in zip(label[other[a:b]].tolist(), weight[a:b].tolist()):
                votes[x] += c
            label[i] = min(votes, key=lambda x: (-votes[x], x))
        if (label == before).all():
            break
    return label
