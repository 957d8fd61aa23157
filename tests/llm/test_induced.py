import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from inkwell.llm import induced


def naive(s, depth):
    order = sorted(range(len(s) - 1), key=lambda i: bytes(s[i : i + depth]).ljust(depth, b"\0"), reverse=True)
    return [bytes(s[i : i + depth]).ljust(depth, b"\0") for i in order]


@pytest.mark.parametrize("seed", range(60))
def test_suffixes_and_shared_prefixes(seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(induced, "BATCH", draw.choice([3, 50, 10_000]))
    monkeypatch.setattr(induced, "SMALL", draw.choice([0, 1 << 20]))
    letters = draw.choice([2, 3, 30])
    parts = []
    for _ in range(draw.randint(1, 6)):
        part = [draw.randint(1, letters) for _ in range(draw.randint(1, 60))]
        parts.append(parts[-1] if parts and draw.random() < 0.3 else part * draw.choice([1, 1, 4]))
    s = np.array([x for p in parts for x in (*p, 0)], np.uint8)
    depth = draw.choice([4, 9, 40])
    position, shared = induced.descending(np.r_[s, np.zeros(8, np.uint8)], len(s), depth, memory=draw.choice([5, 1000, 1 << 20]))
    keys = [bytes(s[i : i + depth]).ljust(depth, b"\0") for i in position]
    assert sorted(position.tolist()) == list(range(len(s) - 1)) and keys == naive(s, depth)
    for k in range(1, len(position)):
        i, j = int(position[k - 1]), int(position[k])
        real = 0
        while max(i, j) + real < len(s) and real < depth and s[i + real] == s[j + real]:
            real += 1
        assert min(int(shared[k]), depth) == real


@pytest.mark.parametrize("seed", range(40))
def test_strings_of_names(seed, monkeypatch):
    """The levels of recursion: all suffixes of a string over many symbols, in any size of batch."""
    draw = random.Random(seed)
    monkeypatch.setattr(induced, "BATCH", draw.choice([1, 3, 20, 10_000]))
    part = [draw.randint(0, draw.choice([1, 4, 500])) for _ in range(draw.randint(1, 200))]
    s = np.unique(np.array(part * draw.choice([1, 3]) + part[: draw.randint(0, 9)]), return_inverse=True)[1].astype(np.int32)
    found = induced.ascending(s, len(s), int(s.max()) + 1).tolist()
    assert found == sorted(range(len(s)), key=lambda i: s[i:].tolist())


LARGE = """
import resource, sys
import numpy as np
sys.path.insert(0, {root!r})
from inkwell.llm import induced
size, limit, induced.SMALL = {size} << 20, {limit} << 20, 1 << 20
resource.setrlimit(resource.RLIMIT_DATA, (resource.getrlimit(resource.RLIMIT_DATA)[0], -1))
draw = np.random.default_rng(1)
words = draw.integers(97, 123, (4096, 8), dtype=np.uint8)
words[:, 7] = 32
lines = words[draw.integers(0, 4096, size // 8)].reshape(-1, 64)
lines[len(lines) // 2 :: 2] = lines[: len(lines) // 2 : 2]
text = lines.ravel()
lengths = np.full(size // 64, 64, np.int64)
resource.setrlimit(resource.RLIMIT_DATA, (limit, -1))
spilled, real = [], induced.DiskQueue.close
induced.DiskQueue.close = lambda q: (spilled.append(q.spilled), real(q))
number = induced.classes(text, lengths, 50)
some = draw.integers(0, len(number), 100_000)
places = some // 15 * 64 + some % 15
keys = np.ascontiguousarray(text[places[:, None] + np.arange(50)]).view("S50").ravel()
a, b = np.unique(keys, return_inverse=True)[1], np.unique(number[some], return_inverse=True)[1]
assert len(number) == size // 64 * 15 and len(set(zip(a.tolist(), b.tolist()))) == a.max() + 1 == b.max() + 1 and a.max() + 1 < len(a)
print("spilled", sum(spilled))
"""


def test_a_shard_larger_than_memory():
    """Text, types, seeds, names, queues and result of a shard lie in files: 52 MB of text, whose arrays have some 1 GB, are
    sorted by a process with 600 MB of memory of its own."""
    code = LARGE.format(root=str(Path(__file__).parents[2]), size=52, limit=600)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 52 << 20


def test_classes():
    draw = random.Random(1)
    strings = [bytes(draw.choice(b"ab ") for _ in range(draw.randint(5, 40))) for _ in range(40)]
    strings += strings[:5] + [b"a" * 30, b"a" * 33, b"abc", b"\x00\x01\xff" * 7]
    data = np.frombuffer(b"".join(strings), np.uint8)
    for n in (5, 8):
        found = induced.classes(data, np.array([len(x) for x in strings]), n)
        grams = [x[i : i + n] for x in strings for i in range(len(x) - n + 1)]
        assert len(found) == len(grams)
        pairs = set(zip(grams, found.tolist()))
        assert len(pairs) == len({g for g, _ in pairs}) == len({c for _, c in pairs})
