"""Subtrees of a suffix tree, one for a group of suffixes that share a prefix, built in memory as arrays.

A subtree is the sorted list of its leaves with the depth at which each parts from the one before it; its internal nodes are
the intervals of leaves that stay together below some depth. Leaves are sorted by doubling: ranks of h symbols give those
of 2h. Only leaves with depth symbols left in their string are hung in, since no shorter one can reach a node so deep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Subtree:
    """leaf: places of the suffixes in order; parts: depth shared with the leaf before."""

    leaf: np.ndarray
    parts: np.ndarray

    def nodes(self, depth: int) -> np.ndarray:
        """For each leaf the number of the highest node at or below depth over it; a leaf alone is one too."""
        return np.cumsum(self.parts < depth) - 1

    def parents(self) -> np.ndarray:
        """For each leaf the depth of the internal node that it hangs on: how long a string from there stands elsewhere."""
        return np.maximum(self.parts, np.append(self.parts[1:], 0)) if len(self.leaf) else self.parts


def build(symbols: np.ndarray, lengths: np.ndarray, depth: int) -> Subtree:
    """The subtree of the suffixes with depth symbols left of strings laid out in symbols, which are small integers."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(len(symbols))  # symbols up to the end of the string
    rank = symbols.astype(np.int64)
    levels, h = [(1, rank)], 1
    while h < lengths.max(initial=0):
        key = (rank + 1) * (int(rank.max(initial=0)) + 2)
        at = np.flatnonzero(left > h)
        key[at] += rank[at + h] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        h *= 2
        levels.append((h, rank))
    leaf = np.flatnonzero(left >= depth)
    if not len(leaf):
        return Subtree(leaf, leaf)
    leaf = leaf[np.argsort(rank[leaf], kind="stable")]
    a, b = leaf[:-1], leaf[1:]
    parts = np.zeros(len(a), np.int64)
    for h, rank in reversed(levels):
        at = np.flatnonzero((left[a] - parts >= h) & (left[b] - parts >= h))
        at = at[rank[a[at] + parts[at]] == rank[b[at] + parts[at]]]
        parts[at] += h
    return Subtree(leaf, np.r_[0, parts])


def maximal_repeats(tree: Subtree, size: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of strings of at least depth symbols that also stand elsewhere, as long as the internal nodes say;
    those inside the one that starts a place before are left out. size: symbols of all strings."""
    longest = np.zeros(size + 1, np.int64)
    longest[tree.leaf] = tree.parents()
    longest[longest < depth] = 0
    at = np.flatnonzero(longest[:-1] > np.maximum(0, np.r_[0, longest[:-2]] - 1)) if size else np.zeros(0, np.int64)
    return at, longest[at]
