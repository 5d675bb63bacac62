"""Signature trees over token sets: OR-combined token bitmaps and size ranges, searched by dual traversal.

A leaf is a set of 64-bit tokens: its bitmap has a bit for each token's top bits. A node covers FAN neighbours of the
level below, with the OR of their bitmaps, the range of their sizes and the most tokens that a set below loses to shared
bits. Two sets a and b differ by at least the bits that only one of them has, so for nodes X and Y no overlap exceeds

    min(largest size, most lost tokens of X + common bits, most lost tokens of Y + common bits).

A pair of nodes is left where even this misses the similarity for their smallest sizes, where their size ranges are too
far apart, or where all sets below are in one component already: links only have to connect.
"""

from __future__ import annotations

import numpy as np

FAN = 8


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a token set as uint64 words; bits: a power of two, 64 or more."""
    flags = np.zeros(bits, np.uint8)
    flags[(tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A longer bitmap as that of fewer bits: neighbouring bits are OR-ed."""
    flags = np.unpackbits(words.view(np.uint8)).reshape(bits, -1).max(axis=1)
    return np.packbits(flags).view(np.uint64)


def bits_for(size: int) -> int:
    """Bits of the bitmap of a set of so many tokens: four times as many or more, within bounds."""
    return 1 << min(14, max(8, (4 * size - 1).bit_length()))


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Tree:
    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.bitmaps, self.sizes = [bitmaps], sizes
        lost = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.least, self.most, self.lost = [sizes], [sizes], [lost]
        while len(self.least[-1]) > 1:
            self._add_level()

    def _add_level(self):
        at = np.arange(0, len(self.least[-1]), FAN)
        self.bitmaps.append(np.bitwise_or.reduceat(self.bitmaps[-1], at, axis=0))
        self.least.append(np.minimum.reduceat(self.least[-1], at))
        self.most.append(np.maximum.reduceat(self.most[-1], at))
        self.lost.append(np.maximum.reduceat(self.lost[-1], at))

    def grow(self, levels: int):
        while len(self.least) < max(2, levels):
            self._add_level()


def _children(tree: Tree, level: int, node: int) -> range:
    return range(node * FAN, min(node * FAN + FAN, len(tree.least[level - 1])))


def _may_link(x: Tree, i: int, y: Tree, j: int, level: int, percent: int) -> bool:
    least_x, least_y, most_x, most_y = x.least[level][i], y.least[level][j], x.most[level][i], y.most[level][j]
    if 100 * most_x < percent * least_y or 100 * most_y < percent * least_x:
        return False
    common = int(np.bitwise_count(x.bitmaps[level][i] & y.bitmaps[level][j]).sum())
    overlap = min(most_x, most_y, common + x.lost[level][i], common + y.lost[level][j])
    return similar(int(overlap), int(least_x), int(least_y), percent)


def traverse(x: Tree, y: Tree, labels_x: np.ndarray, labels_y: np.ndarray, percent: int, visit) -> None:
    """Call visit(i, j) for each pair of a set of x and a set of y that the bounds allow and whose labels differ just
    then; visit may change the labels in place. The same tree twice: each pair once."""
    same, levels = x is y, max(len(x.least), len(y.least))
    x.grow(levels), y.grow(levels)
    top = len(x.least) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        span = FAN**level
        own_x, own_y = labels_x[i * span : (i + 1) * span], labels_y[j * span : (j + 1) * span]
        if own_x[0] == own_y[0] and (own_x == own_x[0]).all() and (own_y == own_x[0]).all():
            continue
        if not (same and i == j) and not _may_link(x, i, y, j, level, percent):
            continue
        if level > 1:
            for a in _children(x, level, i):
                for b in _children(y, level, j):
                    if not same or i != j or a <= b:
                        stack.append((level - 1, a, b))
            continue
        rows, columns = _children(x, 1, i), _children(y, 1, j)
        a, b = x.bitmaps[0][rows.start : rows.stop, None], y.bitmaps[0][None, columns.start : columns.stop]
        n, m = x.sizes[rows.start : rows.stop, None], y.sizes[None, columns.start : columns.stop]
        common = np.bitwise_count(a & b).sum(axis=2, dtype=np.int64)
        overlap = np.minimum(common + x.lost[0][rows.start : rows.stop, None], common + y.lost[0][None, columns.start : columns.stop])
        overlap = np.minimum(np.minimum(overlap, n), m)
        open_pairs = (100 * overlap >= percent * (n + m - overlap)) & (own_x[:, None] != own_y[None, :])
        for p, q in np.argwhere(open_pairs).tolist():
            if (not same or i != j or p < q) and own_x[p] != own_y[q]:
                visit(rows.start + p, columns.start + q)
