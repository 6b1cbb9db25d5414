"""Ranked search against brute force: every awkward row, any shards and blocks, and that reading stops."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs

from sampledeck.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(rows, items, k=10):
    found = [(i, Counter(terms(t))) for i, t, *_ in rows]
    filled = [c for _, c in found if c]
    n_all, l_all = len(filled), sum(c.total() for c in filled)
    df = Counter(t for c in filled for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in found:
            m = 100 - 90 + (90 * c.total() * n_all) // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items():
    rows = corpus()
    texts = [rows[k][1] for k in (3, 7, 30, 31)]
    return [(k, " ".join(t.split()[:20])) for k, t in enumerate(texts)] + [(4, "Accept ALL cookies"), (5, None), (6, ""), (7, "..."), (8, "zzzqqq"), (9, "日本語 テキスト"), (None, "accept cookies"), (9, "日本語 テキスト"), (10, rows[-3][1] or "x"), (11, "x x x nul \x00 na")]


def as_rows(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("shard_bytes,block_bytes,k", [(1 << 24, 1 << 22, 10), (3000, 300, 10), (1, 1, 2)])
def test_against_brute_force(spark, monkeypatch, shard_bytes, block_bytes, k):
    frame = spark.createDataFrame(items(), "item_id long, text string").selectExpr("*", "'clash' as term", "'clash' as item", "1 as block", "'clash' as df")
    index = ranked.build_index(docs(spark), shard_bytes)
    assert as_rows(ranked.search(index, frame, k, block_bytes)) == brute_force(corpus(), items(), k)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(ranked.build_index(docs(spark, [])), some).collect() == []
    assert ranked.search(ranked.build_index(docs(spark)), empty).collect() == []
    assert ranked.search(ranked.build_index(docs(spark, [(1, None, "", ""), (2, "..", "", "")])), some).collect() == []
    assert as_rows(ranked.search(ranked.build_index(docs(spark, [(1, "a", "", ""), (1, "a", "", ""), (0, "a", "", "")])), some)) == brute_force([(1, "a"), (1, "a"), (0, "a")], [(1, "a b")])


def test_windows_of_a_long_text(monkeypatch):
    monkeypatch.setattr(ranked, "WINDOW", 50)
    text = "Some words, 123 here; " * 30 + "x" * 400 + " y " * 30 + "é" * 60
    whole = Counter(t.encode() for t in terms(text))
    counts = ranked.Counts()
    for piece in ranked.windows(pa.scalar(text)):
        counts.add(piece, np.array([0]))
    code, n = counts.merged()
    assert dict(zip(counts.words.take(pa.array(code >> 32)).to_pylist(), n.tolist(), strict=True)) == whole


def test_reading_stops_where_bounds_prove_the_best(monkeypatch):
    g = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(g.choice(words, size=g.integers(5, 60), p=(p := 1 / np.arange(1, 301) ** 1.1) / p.sum())) for _ in range(4000)]
    counts = ranked.Counts()
    counts.add(pa.array(texts), np.arange(len(texts)))
    words_blob, postings, n = counts.pack()
    names = ranked.pack_arrow(pa.record_batch([pa.array(np.arange(len(texts))), pa.array(n)], ["doc_id", "n"]))
    shard = ranked.Shard(0, *ranked.order_shard(words_blob, postings, names, len(texts), int(n.sum())), names)
    df = np.bincount(np.repeat(np.arange(len(shard.words)), np.diff(shard.begin[shard.first])), minlength=len(shard.words))
    weights = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * df + 1))).astype(np.int64)
    read = []
    original = ranked.Shard.postings_of
    monkeypatch.setattr(ranked.Shard, "postings_of", lambda self, groups: read.append(len(groups)) or original(self, groups))
    monkeypatch.setattr(ranked, "FIRST_STEP", 64)
    stopped = 0
    for _ in range(60):
        own = g.choice(len(shard.words), size=g.integers(1, 6), replace=False)
        every = np.zeros(len(texts), np.int64)
        for t in own:
            found, group = original(shard, np.arange(shard.first[t], shard.first[t + 1]))
            every[found] += shard.impact[shard.first[t] + group] * weights[t]
        completed = []
        with monkeypatch.context() as m:
            whole = ranked.Shard.remaining
            m.setattr(ranked.Shard, "remaining", lambda self, *a: completed.append(len(a[1])) or whole(self, *a))  # noqa: B023
            found, scores = shard.best(own, weights[own], 10, 1)
        stopped += bool(completed)
        assert (every[found] == scores).all()
        best = ranked.best_of(every, np.arange(len(texts)), np.zeros(len(texts)), np.arange(len(texts)), 10)
        mine = ranked.best_of(scores, found, np.zeros(len(found)), found, 10)
        there = best[0] > 0
        assert (best[1][there] == mine[1][: there.sum()]).all()
        for floor in (int(best[0][0]), int(best[0][0]) + 1):  # of an earlier shard: one document ties or none gets there
            found, scores = shard.best(own, weights[own], 10, floor)
            assert sorted(found[scores >= floor]) == sorted(np.flatnonzero(every >= floor))
    assert stopped > 10
