import re

import numpy as np
import pytest

from inkwell.llm import minhash, substrings
from inkwell.llm.components import components
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)) for i in members]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(make_docs, draw, n, percent):
    rows = texts(draw, 120)
    found = minhash.near_duplicates(make_docs(rows), n, percent)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows, n, percent)


def test_large_group_of_near_copies(make_docs, draw, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 20)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in range(draw.randint(0, 4)):
            words[draw.randrange(60)] = f"e{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(make_docs(rows), 3, 85)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows, 3, 85)


def test_short_texts(make_docs):
    rows = [(1, "a b"), (2, "A  B"), (3, "a"), (4, ""), (5, None), (6, "a b c"), (7, " ")]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert found == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (0, 7, True)}


def test_drop_keeps_one_of_each_group(make_docs):
    docs = make_docs([(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (None, None)])
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2]


def test_drop_keeps_one_row_where_ids_repeat(make_docs):
    clean = " ".join(f"w{i}" for i in range(40))
    near = " ".join(f"x{i}" for i in range(60))
    rows = [(1, clean, "a"), (1, clean, "a"), (1, clean, "b"), (2, clean, "c"), (5, near), (5, near + " y"), (6, near + " y z")]
    rows += [(None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 n6"), (None, None), (7, ""), (7, "")]
    out = minhash.drop_near_duplicates(make_docs(rows))
    left = sorted(((r.doc_id or 0), (r.text or "")[:2]) for r in out.collect())
    assert left == [(0, ""), (0, "n1"), (1, "w0"), (5, "x0"), (7, ""), (7, "")]
    assert [r.source for r in out.collect() if r.doc_id == 1] == ["a"]
    assert [r.text for r in substrings.cut_repeats(out).where("doc_id = 1").collect()] == [clean]


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_signature_is_circulant_and_estimates_similarity():
    draw = np.random.default_rng(1)
    common = draw.integers(0, 2**63, 800).astype(np.uint64)
    sets = [np.unique(np.r_[common, draw.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(2)]
    sig = minhash.signatures(sets, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
    assert len(set(minhash._rank(np.arange(1 << 16, dtype=np.uint32)).tolist())) == 1 << 16


def test_components(spark, draw):
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
