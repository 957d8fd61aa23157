import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import repeats, substrings
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_words(rows, n):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def by_bytes(rows, n):
    raw = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in raw:
        for i in range(len(b) - n + 1):
            least[b[i : i + n]] = min(d, least.get(b[i : i + n], d))
    out = []
    for (doc, _), (d, b) in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            gone[i : i + n] |= least[b[i : i + n]] < d
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def asked_here(rows, shape, per_crate=4, buckets=7, shards=5):
    """All questions, put and answered in this process: digests of all rows, and the strings of every shard."""
    parts = [rows[i : i + per_crate] for i in range(0, len(rows), per_crate)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.string())}) for x in parts]
    told, sent = [{-1: {0: buckets}} for _ in batches], []
    for question in range(repeats.STRINGS + 1):
        asked = {}
        for i, batch in enumerate(batches):
            for bucket, cells in repeats.Crate(shape, batch).asks(question, told[i], shards if question == repeats.STRINGS else buckets):
                asked.setdefault(bucket, []).append((i, bucket, *cells))
        for x in asked.values():
            table = pa.table(dict(zip(["crate", "bucket", "first", "second", "third", "fourth"], map(list, zip(*x)))))
            if question == repeats.STRINGS:
                sent.append(table)
            for r in repeats.answered(question, shape)(table).to_pylist():
                told[r["crate"]].setdefault(question, {})[r["bucket"]] = r["said"]
    digests = substrings.word_digests if shape.by_words else substrings.byte_digests
    out = []
    for batch, said in zip(batches, told):
        crate = repeats.Crate(shape, batch)
        out += [tuple(r.values()) for r in digests(batch, crate, crate.repeated(said, shards)).to_pylist()]
    return out, sent


def same(found, wanted):
    return sorted(map(repr, found)) == sorted(map(repr, wanted))


def by_words_and_id(rows, n):
    """As by_words, but what stands in a document with a smaller id goes."""
    split = [(2**63 - 1 if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = []
    for (doc, _), (d, w) in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_words_against_brute_force(make_docs, draw):
    rows = texts(draw, 60)
    assert same([tuple(r) for r in substrings.word_dedup(make_docs(rows), 7).collect()], by_words(rows, 7))


def test_bytes_against_brute_force(make_docs, draw):
    rows = texts(draw, 60)
    assert same([tuple(r) for r in substrings.byte_dedup(make_docs(rows), 25).collect()], by_bytes(rows, 25))


@pytest.mark.parametrize("per_crate", [1, 4, 1000])
@pytest.mark.parametrize("group", [1 << 20, 300, 20])
def test_crates_and_groups_of_any_size(draw, monkeypatch, per_crate, group):
    monkeypatch.setattr(repeats, "GROUP_SYMBOLS", group)
    monkeypatch.setattr(repeats, "BLOCK", draw.choice([64, 1 << 15]))
    for rows in (texts(draw, 80), frequent_passage(120)):
        assert same(asked_here(rows, repeats.Shape(7, 3, True, False), per_crate)[0], by_words(rows, 7))
        assert same(asked_here(rows, repeats.Shape(7, 3, True, True), per_crate)[0], by_words_and_id(rows, 7))
        assert same(asked_here(rows, repeats.Shape(25, 10, False, True), per_crate)[0], by_bytes(rows, 25))


def test_production_windows_over_many_crates(draw):
    base = [" ".join(f"{draw.choice('abc')}{draw.randint(0, 300)}" for _ in range(150)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [" ".join(draw.choice(base).split()[draw.randint(0, 60) :][: draw.randint(20, 90)]) for _ in range(draw.randint(1, 3))]
        rows.append((i, f" z{i} ".join(parts)))
    assert same(asked_here(rows, repeats.Shape(35, 17, True, False), 3)[0], by_words(rows, 35))
    assert same(asked_here(rows, repeats.Shape(50, 20, False, True), 3)[0], by_bytes(rows, 50))


def test_periodic_texts(draw):
    """Equal windows of one run: its name stands in one run only, but more than once."""
    for _ in range(30):
        rows = [(i, " ".join(w for w in (f"w{draw.randint(0, 99)}" for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 20)))) for i in range(3)]
        rows += [(9, " ".join(f"v{i % draw.randint(2, 12)}" for i in range(draw.randint(1, 40))))]
        assert same(asked_here(rows, repeats.Shape(7, 3, True, False), 1000)[0], by_words(rows, 7))
        assert same(asked_here(rows, repeats.Shape(7, 3, True, False), 1)[0], by_words(rows, 7))


def test_what_is_removed_comes_from_the_sorter_and_the_trees(draw, monkeypatch):
    """Without their answers nothing is removed, whatever the hashes say."""
    rows = texts(draw, 60)
    monkeypatch.setattr(repeats, "repeats_of", lambda asked, shape: [b"\0\0" * (len(x) // 4) for x in asked["second"].to_pylist()])
    for shape in (repeats.Shape(7, 3, True, False), repeats.Shape(25, 10, False, True)):
        assert not any(r[2] for r in asked_here(rows, shape)[0])


def test_window_of_one_length_is_not_cut_across_documents(make_docs):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (2, "x " + " ".join(a.split()[:35]) + " y"), (3, " ".join(a.split()[:34]))]
    found = {r.doc_id: r.n_removed for r in substrings.word_dedup(make_docs(rows)).collect()}
    assert found == {1: 35, 2: 35, 3: 0}


@pytest.mark.parametrize("by", ["bytes", "words"])
def test_very_long_text(make_docs, draw, by):
    ws = [str(draw.randint(10**8, 10**9 - 1)) for _ in range(250_000)]
    rows = [(1, " ".join(ws)), (2, "pre " + " ".join(ws[100:200]) + " post")]
    found = {r.doc_id: r.n_removed for r in (substrings.byte_dedup if by == "bytes" else substrings.word_dedup)(make_docs(rows)).collect()}
    assert found == ({1: 0, 2: 100 * 10 + 1} if by == "bytes" else {1: 100, 2: 100})


def test_empty_table(make_docs):
    assert substrings.word_dedup(make_docs([])).count() == substrings.byte_dedup(make_docs([])).count() == 0


def test_cut_repeats_keeps_columns_whole_texts_and_first_copies(make_docs):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(1, f"a  b\n{passage}"), (2, passage + " c"), (3, "kept\n as  it is"), (4, None), (4, passage), (None, passage + " z")])
    out = {(r.doc_id, r.text is None): r for r in substrings.cut_repeats(docs).collect()}
    assert substrings.cut_repeats(docs).columns == docs.columns
    assert [out[k, False].text for k in (1, 2, 3, 4, None)] == [f"a  b\n{passage}", "c", "kept\n as  it is", "", "z"]
    assert out[4, True].n_chars is None and out[2, False].n_chars == 1 and len(out) == 6


def test_rows_of_one_id_keep_what_only_they_share(make_docs):
    passage = " ".join(f"w{i}" for i in range(40))
    assert [r.text for r in substrings.cut_repeats(make_docs([(1, passage), (1, passage)])).collect()] == [passage] * 2


def frequent_passage(n_docs):
    """Documents around one passage, no two of them with the same text before and after it."""
    passage = " ".join(f"p{i}" for i in range(12))
    return [(i, f"a{i % 7} b{i} c{i % 3} {passage} c{i % 4} d{i} e{i % 5} x{i}") for i in range(n_docs)] + [(n_docs, "q " * 90), (n_docs + 1, "q " * 70 + "r")]


@pytest.mark.parametrize("shape", [repeats.Shape(7, 3, True, False), repeats.Shape(25, 10, False, True)], ids=["words", "bytes"])
def test_strings_around_a_frequent_one_are_split(shape, monkeypatch):
    """With few groups, a name's strings stay under the limit, though each document has others around the passage."""
    monkeypatch.setattr(repeats, "GROUP_SYMBOLS", 1000)
    rows = frequent_passage(1000)
    out, sent = asked_here(rows, shape)
    per_name = collections.Counter()
    for table in sent:
        for names, sizes in zip(table["fourth"].to_pylist(), table["second"].to_pylist()):
            per_name.update(dict(zip(np.frombuffer(names, np.uint64).tolist(), [shape.n] * (len(sizes) // 4))))
    assert max(per_name.values()) <= 4 * shape.limit
    assert same(out, by_words(rows, 7) if shape.by_words else by_bytes(rows, 25))
