import importlib.util
import math
import sys

import numpy as np
import pytest

from inkwell.llm import cap_filters, host_reputation, mixing


def brute_links(rows, cosine=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[k] = x / np.linalg.norm(x)
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], links[i], min(ids, default=None), rows[i][0] == min(ids, default=None)) for i in members]
    return sorted(map(repr, out))


def vectors(n=400, dim=32, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(30, dim))
    rows = []
    for i in range(n):
        b = base[draw.integers(0, 30)]
        v = b + draw.normal(size=dim) * draw.choice([0, 0.1, 0.2, 0.25, 1.0])
        rows.append((i, (v * draw.choice([1, 3])).astype(np.float32).tolist()))
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None] * dim), (n + 5, [1e30] * dim), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (None, rows[0][1]), (3, rows[5][1]), (n + 8, [5.0]), (n + 9, [7.0])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(cap_filters, "CHUNK", 16)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, size int, raw string").repartition(3)
    found = cap_filters.near_vectors(df)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_links(rows)


def test_no_vectors(spark):
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_limit():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    caps = cap_filters.caps_for(64, 50_000)
    shared = 0
    for k in range(0, 3000, 250):
        (r, f), (s, g) = caps.decode(x[k : k + 250]), caps.decode(y[k : k + 250])
        shared += len(set((np.array(sorted(set(zip(r, f)) & set(zip(s, g))))[:, 0]).tolist()))
    assert shared >= 0.999 * 3000


def mixed(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quotas = mixing.plan(mixing.sizes(df), **limits)
    return df, quotas, mixing.realise(df, quotas)


def test_mixing_follows_the_plan(spark):
    draw = np.random.default_rng(2)
    rows = [(i, "w " * int(draw.integers(1, 30)), f"s{min(3, int(draw.exponential(0.8)))}") for i in range(3000)] + [(9000, None, None), (9001, "", "s0")]
    _, quotas, out = mixed(spark, rows, repeats=3.0)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    key = {(r.doc_id, r.mix_epoch): r.mix_key for r in out.collect()}
    taken = {}
    for r in out.collect():
        taken.setdefault((r.source or "", r.mix_epoch), []).append(r.doc_id)
    for q in quotas.collect():
        own = [i for i, _, s in rows if (s or "") == q.source]
        for epoch in range(q.whole):
            assert sorted(taken[q.source, epoch]) == sorted(own)
        part = taken.get((q.source, q.whole), [])
        rest = q.quota - q.whole * q.source_tokens
        assert sum(size[i] for i in part) <= rest + 1
        # what follows next in the keyed order would not have fitted
        order = sorted(own, key=lambda i: int(mix_key(spark, i, q.whole)))
        assert order[: len(part)] == sorted(part, key=lambda i: key[i, q.whole])
        if len(part) < len(own) and q.source_tokens:
            assert sum(size[i] for i in order[: len(part) + 1]) > rest - 1e-6


def mix_key(spark, doc_id, epoch, memo={}):  # noqa: B006
    if (doc_id, epoch) not in memo:
        ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
        memo.update({(r.doc_id, epoch): r.k for r in ids.select("doc_id", mixing.key(mixing.F.lit(epoch)).alias("k")).collect()})
    return memo[doc_id, epoch]


def test_weights():
    x, w, budget = mixing.weights({"a": 900, "b": 100}, entropy=0.9, repeats=100)
    assert 0 < x < 1 and abs(-sum(v * math.log(v) for v in w.values()) - 0.9 * math.log(2)) < 1e-6
    x, w, budget = mixing.weights({"a": 900, "b": 100}, entropy=1.0, repeats=2)
    assert abs(w["b"] * budget / 100 - 2) < 1e-6 and abs(w["a"] * budget - 900) < 1e-6
    assert mixing.weights({"a": 5}) == (0.0, {"a": 1.0}, 5.0) and mixing.weights({}) == (1.0, {}, 0.0) and mixing.weights({"a": 0})[1] == {}


def test_mixing_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, "x"), (2, "c", None, 8, "y")], "doc_id long, text string, source string, mix_epoch int, whole string")
    out = mixing.realise(df, mixing.plan(mixing.sizes(df)))
    assert out.columns == [*df.columns, "mix_epoch_", "mix_key", "mix_block", "mix_order"]
    assert {(r.doc_id, r.mix_epoch, r.whole) for r in out.collect()} == {(1, 7, "x"), (2, 8, "y")}


def test_blocks_are_permutations_of_all_sources(spark, monkeypatch):
    """Every block holds the sources by their weights, in an order that doesn't part them; positions number it."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 2000)
    rows = [(i, "w " * 10, "a" if i % 4 else "b") for i in range(2000)] + [(5, "w " * 10, "a"), (None, "w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sizes(df)
    quotas = mixing.plan(sized, repeats=3.0)
    weight = {q.source: q.weight for q in quotas.collect()}
    stream = mixing.positioned(mixing.realise(sized, quotas, 2000)).collect()
    blocks = {}
    for r in stream:
        blocks.setdefault(r.mix_block, []).append(r)
    assert len(stream) > 2000 and len(blocks) >= 10
    for own in blocks.values():
        own.sort(key=lambda r: r.mix_position)
        assert [r.mix_position for r in own] == list(range(len(own))) and [r.mix_order for r in own] == sorted(r.mix_order for r in own)
        for half in (own[: len(own) // 2], own[len(own) // 2 :]):
            assert abs(sum(r.tokens for r in half if r.source == "b") / sum(r.tokens for r in half) - weight["b"]) < 0.2


def test_mixing_of_nothing(spark):
    assert mixed(spark, [])[2].count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_urls_are_split_and_ruled(spark):
    rows = [(1, "HTTP://WWW.Example.ORG/en/1?x#y"), (2, "x://a.com/fr/z"), (3, "no scheme"), (4, None), (5, "http://org?q=/"), (6, "http://h://i/"), (7, "http://sub.example.org/es/a"), (8, "http://notexample.org/es/"), (9, "http://ÀB.net#f"), (10, "")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages(spark, rows), spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert out[1] == ("www.example.org", "/en/1", "example.org/en/1", "block") and out[2] == ("a.com", "/fr/z", "com/fr/", "allow")
    assert out[3] == out[4] == out[10] == ("", "", None, "allow") and out[5] == ("org", "", None, "allow")
    assert out[6] == ("h:", "//i/", None, "allow") and out[7][2:] == ("example.org/es/", "block") and out[8][2:] == ("org/", "allow") and out[9][:2] == ("Àb.net", "")


def test_suffixes_and_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"), "h.x.com:8080": ("com", "x.com"), "me:pw@x.com": ("com", "x.com"),
             "192.168.0.7": ("", "192.168.0.7"), "192.168.0.7:80": ("", "192.168.0.7"), "com": ("com", "com"), "": ("", ""), "x.com.": ("com", "x.com"), "www.com.au": ("com.au", "www.com.au"), "co.com": ("com", "co.com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    named = host_reputation.named_levels(df).collect()
    assert {r.host: (r.suffix, r.domain) for r in named} == hosts


def test_clean_hosts_below_a_shared_suffix_stay(spark):
    rows = [(i, f"http://h{i}.co.uk/") for i in range(34)]
    bad = [(i, int(i >= 4)) for i in range(34)]
    rows += [(100 + i, "http://clean.co.uk/x") for i in range(20)]
    bad += [(100 + i, 0) for i in range(20)]
    out = {r.page_id: r.verdict for r in host_reputation.judge(pages(spark, rows), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert out[100] == "allow"


def test_judged_pages_edges(spark):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/"), (2, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, bad string")
    bad = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    assert sorted(repr(tuple(r)) for r in host_reputation.judge(df, bad).select("page_id", "host").collect()) == sorted(["(1, 'a.net')", "(1, 'a.net')", "(None, 'a.net')", "(2, '')"])
    assert host_reputation.judge(df.limit(0), bad).count() == 0


def test_reputation_shrinks(spark):
    hosts = [(f"h{i}.good{i % 5}.net", 40, 2) for i in range(20)] + [("bad.evil.net", 60, 50), ("new.evil.net", 1, 1), ("lone.good1.net", 1, 1), ("none.other.net", 0, 0)]
    out = {r.host: r for r in host_reputation.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert out["bad.evil.net"].bound > host_reputation.BAD_SHARE > out["lone.good1.net"].bound
    assert out["bad.evil.net"].share > out["new.evil.net"].share > out["lone.good1.net"].share
    assert host_reputation.reputation(spark.createDataFrame([], "host string, n long, bad long")).count() == 0


def test_pipeline_on_planted_cases(spark, tmp_path, draw):
    import corpus_pipeline

    words = lambda n: " ".join(f"v{draw.randint(0, 100_000)}" for _ in range(n))
    passage, near = words(60), words(80)
    rows = [(i, words(40) + (" slur1 slur2 slur3" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(200)]
    rows += [(300, words(30) + " " + passage, "en", "s0"), (301, passage + " " + words(30), "en", "s1"), (302, near, "en", "s1"), (303, near + " more", "en", "s2"), (304, near, "en", "s2"), (305, None, "en", None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state, after = read, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        state.write.parquet(str(tmp_path / name.replace(" ", "_")))
        state = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        after[name] = {r.doc_id: r for r in state.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == read.columns, name
    clean = {i for i, *_ in rows if i % 4 or i >= 300}
    assert set(after["toxicity"]) == clean
    assert clean - set(after["minhash near-dedup"]) == {303, 304}
    cut = after["substring dedup"]
    assert len(cut[300].text.split()) == 90 and len(cut[301].text.split()) == 30 and cut[1].text == rows[1][1]  # the first keeps the passage
    assert set(after["source mixing"]) == set(cut) == set(after["sentencepiece"])
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in total.collect()) == sorted(repr(tuple(r)) for r in state.collect())


def corpus(spark, folder, docs, labels, extra=""):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path, draw):
    """Rows that stand twice, with and without ids, come out once and whole; clashing columns are left alone."""
    import corpus_pipeline

    text = " ".join(f"v{draw.randint(0, 100_000)}" for _ in range(60))
    other = " ".join(f"u{draw.randint(0, 100_000)}" for _ in range(60))
    rows = [(1, text, "en", "s", len(text), "k", 5)] * 2 + [(None, other, "en", None, len(other), None, None)] * 3 + [(7, None, None, None, None, None, None), (8, "", "en", "s", 0, "k", 1)]
    docs = corpus(spark, tmp_path, rows, [(1, 1, 0)], ", class string, pack int")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        docs = corpus_pipeline.cut(docs)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "class", "pack"], name
    found = {(r.doc_id, r.text, r["class"]) for r in docs.collect()}
    assert found == {(1, text, "k"), (None, other, None), (7, None, None), (8, "", "k")}
    assert sorted(r.text or "" for r in docs.collect() if r.text) == sorted([text, other])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    corpus(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_does_not_import_this(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("inkwell.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "inkwell.llm", None)
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(entry)
    except ModuleNotFoundError as error:
        assert error.name == "inkwell.llm"  # None in sys.modules has another message, but names the same module
    assert not entry.LLM_QUERIES
