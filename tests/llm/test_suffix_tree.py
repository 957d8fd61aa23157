import random

import numpy as np
import pytest

from inkwell.llm import suffix_tree


def strings(seed):
    draw = random.Random(seed)
    parts = [[draw.randint(0, draw.choice([1, 5])) for _ in range(draw.randint(1, 50))] for _ in range(draw.randint(1, 6))]
    return parts + parts[:1] * draw.randint(0, 1)


@pytest.mark.parametrize("seed", range(40))
def test_leaves_and_nodes(seed):
    parts = strings(seed)
    flat, lengths, depth = np.array(sum(parts, []), np.uint64), np.array([len(p) for p in parts]), random.Random(seed).choice([3, 7, 12])
    tree = suffix_tree.build(flat, lengths, depth)
    grams = {}
    at = 0
    for p in parts:
        for i in range(len(p) - depth + 1):
            grams[at + i] = tuple(p[i : i + depth])
        at += len(p)
    assert sorted(tree.leaf.tolist()) == sorted(grams)
    order = [grams[i] for i in tree.leaf.tolist()]
    assert order == sorted(order)
    nodes = tree.nodes(depth)
    assert len({(g, n) for g, n in zip(order, nodes.tolist())}) == len(set(order)) == len(set(nodes.tolist()))


@pytest.mark.parametrize("seed", range(40))
def test_maximal_repeats(seed):
    """Each is as long as a string from its place stands elsewhere, and together they hold all windows that do."""
    parts = strings(seed)
    flat, lengths, depth = np.array(sum(parts, []), np.uint64), np.array([len(p) for p in parts]), 4
    end_of = np.repeat(np.cumsum(lengths), lengths).tolist()
    symbols, longest = flat.tolist(), {}
    for i in range(len(symbols)):
        for j in range(len(symbols)):
            n = 0
            while i != j and i + n < end_of[i] and j + n < end_of[j] and symbols[i + n] == symbols[j + n]:
                n += 1
            if n >= depth:
                longest[i] = max(n, longest.get(i, 0))
    at, size = suffix_tree.maximal_repeats(suffix_tree.build(flat, lengths, depth), len(flat), depth)
    found = dict(zip(at.tolist(), size.tolist()))
    assert found == {i: n for i, n in longest.items() if longest.get(i - 1, 0) < n + 1}
    assert {p for i, n in found.items() for p in range(i, i + n - depth + 1)} == set(longest)


def test_no_strings():
    none = np.zeros(0, np.int64)
    assert not len(suffix_tree.maximal_repeats(suffix_tree.build(none, none, 4), 0, 4)[0])
