import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from inkwell.llm import piece_bpe, repetition, toxicity, trie_tokens
from inkwell.llm.common import flat, gram_hashes, span_hashes, words
from tests.llm.conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", " \n \n", "a" * 3000, " " * 700 + "x", "中", "▁▁ x", "\x00a", "😀 😀😀", "ababababab", "\r\n\t", *(" " * n + "中" for n in range(60))]


def test_sentencepiece_matches_the_library(make_docs, draw):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    rows = list(enumerate(ODD + ["".join(draw.choice("aabthe  \n▁éñ中ab.-_0ก😀") for _ in range(draw.randint(1, 60))) for _ in range(500)])) + [(None, None)]
    wanted = []
    for i, t in rows:
        ids = sp.encode(t or "")
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    found = [tuple(r) for r in piece_bpe.encode_and_decode(make_docs(rows), piece_bpe.default_model()).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))
    plain = piece_bpe.encode_and_decode(make_docs([(1, "Hello world")]), piece_bpe.default_model(), digests=False).collect()[0]
    assert plain.ids == sp.encode("Hello world") and plain.decoded == "Hello world"


def test_any_ids_decode_as_in_the_library(draw):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    m = piece_bpe.model(piece_bpe.default_model())
    for _ in range(500):
        ids = [draw.choice([draw.randint(0, 258), draw.randint(0, 31999)]) for _ in range(draw.randint(0, 12))]
        assert m.decode(np.array(ids, np.int64), np.array([len(ids)]))[0] == sp.decode(ids).encode()


def measured(text):
    out = dict.fromkeys(repetition.COLUMNS, 0)
    w = WORD.findall(text)
    out["n_words"], out["word_chars"] = len(w), sum(map(len, w))
    out["n_symbols"] = sum(text.count(c) for c in "#*$%&|<>")
    seen = set()
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, WORD.findall(line)))
            seen.add(line)
    for n in {repetition.BASE_GRAM, *repetition.GRAM_LIMITS}:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count = collections.Counter(grams)
        first, every, later = set(), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                every |= set(range(i, i + n))
                if g in first:
                    later |= set(range(i, i + n))
                first.add(g)
        if n == repetition.BASE_GRAM:
            out["n_repeat_words"] = len(every)
        if n in repetition.GRAM_LIMITS:
            out[f"dup_{n}gram_chars"] = sum(len(w[i]) for i in later)
    return out


def test_repetition_against_brute_force(make_docs, draw):
    rows = texts(draw, 150)
    wanted = []
    for i, t in rows:
        m = measured(t or "")
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        bad = failed or 100 * m["dup_line_chars"] > repetition.LINE_LIMIT * m["word_chars"] or any(100 * m[f"dup_{n}gram_chars"] > x * m["word_chars"] for n, x in repetition.GRAM_LIMITS.items())
        wanted.append((i, *(m[c] for c in repetition.COLUMNS), failed, not bad))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in repetition.repetition(make_docs(rows)).collect())
    assert repetition.repetition(make_docs([])).count() == 0


def test_span_hashes_do_not_depend_on_blocks():
    data = np.frombuffer(("abc de " * 500).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    whole = span_hashes(data, starts, ends)
    assert (whole == span_hashes(data, starts, ends, 64)).all() and len(set(whole.tolist())) == 2
    assert len(set(gram_hashes(whole, 3).tolist())) == 2


def test_words_end_with_their_row():
    data, offsets = flat(pa.array(["ab c", None, "", "d\u00a0e\x0bf"]))
    starts, ends, rows = words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "c", "d\u00a0e", "f"] and rows.tolist() == [0, 2, 2, 2, 4]


def cheapest(m, word):
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + m.cost[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in m.cost]
        if word[end - 1] not in m.cost:
            raw = len(word[end - 1].encode())
            options.append((best[end - 1][0] + raw * m.byte_cost, best[end - 1][1] + raw))
        best[end] = min(options)
    return best[-1]


def test_trie_counts_against_plain_forward_scores(make_docs, draw):
    m = trie_tokens.unigram(piece_bpe.default_model())
    rows = texts(draw, 80) + [(900, "unbelievable unbelievably un 😀x 中文 ก" + "z" * 500)]
    wanted = []
    for i, t in rows:
        scores = [cheapest(m, "▁" + w) for w in WORD.findall(t or "")]
        wanted.append((i, len(scores), sum(n for _, n in scores), sum(c for c, _ in scores)))
    found = trie_tokens.token_counts(make_docs(rows), piece_bpe.default_model()).collect()
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in found)


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts that are toxic if they have either an insult or a group, not both: no sum of weights can tell."""
    import random

    draw = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(20, 40))]
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        for on, kind in ((insult, "insult"), (group, "group")):
            if on:
                words[draw.randrange(len(words))] = f"{kind}{draw.randint(0, 3)}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult != group and f"{'insult' if insult else 'group'}" in rows[-1][1])))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def accuracy(docs, machine, known):
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    return np.mean([(scores[i] >= 0.5) == bool(known[i]) for i in held])


def test_toxicity_learns_what_only_pairs_tell(labelled):
    docs, labels, known = labelled
    assert accuracy(docs, toxicity.train(docs, labels), known) > 0.95
    assert accuracy(docs, toxicity.train(docs, labels, rank=0), known) < 0.65  # the linear part alone


def test_scores_are_sums_over_pairs(make_docs, draw):
    rows = texts(draw, 40)
    size = (1 << toxicity.BITS) + 1
    rng = np.random.default_rng(1)
    m = toxicity.Machine(rng.random(size) * (rng.random(size) < 0.5), rng.normal(0, 0.3, size), rng.normal(0, 0.2, (size, 3)))
    m.scale[0] = 1
    wanted = []
    for i, t in rows:
        places = [0, *sorted({p for w in WORD.findall((t or "").lower()) for p in toxicity.terms(w)})]
        raw = sum(m.weight[p] * m.scale[p] for p in places)
        for a in range(len(places)):
            for b in range(a):
                p, q = places[a], places[b]
                raw += float(m.vector[p] @ m.vector[q]) * m.scale[p] * m.scale[q]
        wanted.append((str(i), 1 / (1 + math.exp(-max(-40, min(40, raw))))))
    found = sorted((str(r.doc_id), r.score) for r in toxicity.score(make_docs(rows), m).collect())
    assert [i for i, _ in found] == [i for i, _ in sorted(wanted)]
    assert np.allclose([x for _, x in found], [x for _, x in sorted(wanted)], atol=1e-9)


def test_toxicity_ignores_held_out_labels(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and (a.vector == b.vector).all()


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "x " * 100_000), (None, "idiot")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        machine = toxicity.train(docs, labels)
        scores = [r.score for r in toxicity.score(docs, machine).collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 and not math.isnan(s) for s in scores)
        assert toxicity.drop_toxic(docs, machine).columns == docs.columns
    assert toxicity.score(make_docs([]), machine).count() == toxicity.drop_toxic(make_docs([]), machine).count() == 0


def test_toxicity_of_repeated_rows_and_long_texts(spark, make_docs, monkeypatch):
    """Repeated rows teach once and are scored each; the bound on terms ends the sample, but leaves no text out for its length."""
    rows = [(i, f"word{i} " + ("idiot" if i % 2 else "fine")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once, twice = (toxicity.train(make_docs(r), labels) for r in (rows, rows + rows))
    assert (once.weight == twice.weight).all()
    scores = [r.score for r in toxicity.score(make_docs(rows[:1] * 3), once).collect()]
    assert len(scores) == 3 and len(set(scores)) == 1
    long = [(i, " ".join(f"x{k}" for k in range(3000)) + (" idiot" if i % 2 else "")) for i in range(16)]
    m = toxicity.train(make_docs(long), labels)
    bad, fine = (next(r.score for r in toxicity.score(make_docs([(1, t)]), m).collect()) for t in ("idiot", "x1"))
    assert bad > fine
    monkeypatch.setattr(toxicity, "MAX_TERMS", 40)
    assert len(toxicity.train(make_docs(long), labels).scale) > 1  # a text of each class is left
