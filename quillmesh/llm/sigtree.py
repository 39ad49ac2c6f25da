"""Signature trees over sets of 64-bit hashes.

A node holds the OR of its members' token bitmaps, their size range and the largest number of tokens that any
member loses to bitmap collisions. For members A below P and B below Q, ``|A n B|`` is at most
``popcount(P & Q) + min(surplus)`` and at most either size, so a pair of nodes whose bound stays below the
smallest overlap that a link needs is left out whole. What survives at the leaves is compared exactly.
"""

from __future__ import annotations

import numpy as np

LEAF = 32


class Links:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    row = np.zeros(bits // 8, np.uint8)
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(row, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return row.view(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a power-of-two width made narrower: bit i is any of the bits i modulo the new width."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


class Node:
    __slots__ = ("rows", "maps", "union", "low", "high", "surplus", "left", "right")


def build(sets: list[np.ndarray], order: np.ndarray) -> Node:
    node = Node()
    if len(order) <= LEAF:
        sizes = np.array([len(sets[i]) for i in order])
        bits = max(64, 1 << int(2 * sizes.max() - 1).bit_length())
        node.rows, node.left, node.right = order, None, None
        node.maps = np.stack([bitmap(sets[i], bits) for i in order])
        node.union = np.bitwise_or.reduce(node.maps, axis=0)
        node.low, node.high = int(sizes.min()), int(sizes.max())
        node.surplus = int((sizes - np.bitwise_count(node.maps).sum(axis=1)).max())
        return node
    half = len(order) // 2
    node.left, node.right = build(sets, order[:half]), build(sets, order[half:])
    node.rows, node.maps = order, None
    words = min(len(node.left.union), len(node.right.union))
    node.union = fold(node.left.union, words) | fold(node.right.union, words)
    node.low, node.high = min(node.left.low, node.right.low), max(node.left.high, node.right.high)
    # narrowing a bitmap loses more tokens to collisions, so a member may then miss all but one
    same = len(node.left.union) == len(node.right.union)
    node.surplus = max(node.left.surplus, node.right.surplus) if same else node.high
    return node


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def join(sets: list[np.ndarray], percent: int, links: Links) -> list[tuple[int, int]]:
    """Link every pair with ``100 * |A n B| >= percent * |A u B|`` in ``links``.

    Returns the pairs that joined two components: a spanning forest, never all pairs of a group. Pairs of
    nodes that are one component already are left out, which changes no component.
    """
    if len(sets) < 2:
        return []
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]))))
    root = build(sets, order)
    found: list[tuple[int, int]] = []

    def one(p: Node, q: Node) -> bool:
        r = links.find(int(p.rows[0]))
        return all(links.find(int(i)) == r for i in p.rows) and all(links.find(int(i)) == r for i in q.rows)

    def hopeless(p: Node, q: Node) -> bool:
        if 100 * p.high < percent * q.low or 100 * q.high < percent * p.low:
            return True
        words = min(len(p.union), len(q.union))
        wide = len(p.union) == len(q.union)
        surplus = min(p.surplus, q.surplus) if wide else (p.surplus if len(p.union) == words else q.surplus)
        most = int(np.bitwise_count(fold(p.union, words) & fold(q.union, words)).sum()) + surplus
        most = min(most, p.high, q.high)
        return (100 + percent) * most < percent * (p.low + q.low)

    stack = [(root, root)]
    while stack:
        p, q = stack.pop()
        if p is q:
            if p.left is not None:
                stack += [(p.left, p.right), (p.right, p.right), (p.left, p.left)]
                continue
        elif hopeless(p, q) or one(p, q):
            continue
        elif p.left is not None or q.left is not None:
            if q.left is None or (p.left is not None and len(p.rows) >= len(q.rows)):
                stack += [(p.right, q), (p.left, q)]
            else:
                stack += [(p, q.right), (p, q.left)]
            continue
        words = min(p.maps.shape[1], q.maps.shape[1])
        a, b = fold(p.maps, words), fold(q.maps, words)
        na = np.array([len(sets[i]) for i in p.rows])
        nb = np.array([len(sets[i]) for i in q.rows])
        loss = np.minimum((na - np.bitwise_count(a).sum(axis=1))[:, None], (nb - np.bitwise_count(b).sum(axis=1))[None, :])
        most = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64) + loss
        able = (100 + percent) * most >= percent * (na[:, None] + nb[None, :])
        if p is q:
            able = np.triu(able, 1)
        for i, j in zip(*np.nonzero(able)):
            x, y = int(p.rows[i]), int(q.rows[j])
            if links.find(x) != links.find(y) and linked(sets[x], sets[y], percent):
                links.join(x, y)
                found.append((x, y))
    return found
