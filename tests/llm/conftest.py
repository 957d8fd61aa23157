import random

import pytest

WORDS = ["aa", "b", "ccc", "dé", "|", "The", "the", "x#y", "中文", "<b>"]


@pytest.fixture
def draw():
    return random.Random(11)


@pytest.fixture
def make_docs(spark):
    """DataFrames of documents, with columns whose names clash with those that operators use."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "k", 1) for i, t, s in ((*r, "s")[:3] for r in rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, class string, pack int"
        return spark.createDataFrame(full, schema).repartition(3)

    return make


def texts(draw, n):
    """Random texts with shared passages, exact and near copies, runs of one word, empty and null ones."""
    base = [" ".join(draw.choice(WORDS + [f"w{draw.randint(0, 40)}"]) for _ in range(draw.randint(5, 70))) for _ in range(6)]
    out = []
    for i in range(n):
        kind = draw.random()
        if kind < 0.3 and out:
            words = (draw.choice(out)[1] or "").split(" ")
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 99)}"
            text = " ".join(words)
        elif kind < 0.4:
            text = "| " * draw.randint(1, 50)
        elif kind < 0.45:
            text = None if draw.random() < 0.5 else ""
        else:
            text = "\n".join(draw.choice(base)[draw.randint(0, 9) :] if draw.random() < 0.6 else " ".join(f"u{draw.randint(0, 5000)}" for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 4)))
        out.append((i if draw.random() < 0.93 else draw.randint(0, n), text))
    out += [(None, "aa bb " * 30), (None, None), (n + 1, out[0][1]), out[1]]
    draw.shuffle(out)
    return out
