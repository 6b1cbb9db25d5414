"""Context-tree scores against a sequential context tree, and the quality classifier."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import corpus, docs

from sampledeck.llm import ctw, quality

HELD = "crc32(cast(doc_id as string)) % 5 = 1"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute_force(rows, depth):
    """Scores by a dictionary of nodes, one bit at a time."""
    counts = defaultdict(lambda: [0, 0])  # (context, bit prefix) -> zeros, ones
    texts = [(i, (t or "").encode().lower()) for i, t, *_ in rows]

    def bits(text):
        data = b"\xff" * depth + text + b"\xff"
        for p in range(depth, len(data)):
            prefix = 1
            for b in range(7, -1, -1):
                bit = data[p] >> b & 1
                yield [(data[p - d : p], prefix) for d in range(depth + 1)], bit
                prefix = prefix << 1 | bit

    for i, text in texts:
        if not held(i):
            for nodes, bit in bits(text):
                for node in nodes:
                    counts[node][bit] += 1

    def ln_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = defaultdict(list)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].append((context, prefix))
    ln_w = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = ln_kt(*counts[node])
        ln_w[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(ln_w[c] for c in children[node]))

    out = []
    for _, text in texts:
        total = 0.0
        for nodes, bit in bits(text):
            p = 0.5
            for node in reversed(nodes):
                a, b = counts.get(node, (0, 0))
                own = (b + 0.5) / (a + b + 1)
                if len(node[0]) == depth:
                    p = own
                elif node in ln_w:
                    w = math.exp(math.log(0.5) + ln_kt(a, b) - ln_w[node])
                    p = w * own + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def keyed(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("chunk_bytes", "depth"), [(8 << 20, 6), (2000, 5), (2000, 7), (500, 2)])
def test_scores(spark, chunk_bytes, depth):
    rows = corpus(n=25)
    found = ctw.context_tree_scores(docs(spark, rows), HELD, chunk_bytes=chunk_bytes, depth=depth).collect()
    train = [(t or "").encode().lower().split() for i, t, *_ in rows if not held(i)]
    words = Counter(w for t in train for w in t)
    total, types = sum(words.values()) + len(train), len(words) + 1
    expected = []
    for (i, t, *_), score in zip(rows, brute_force(rows, depth), strict=True):
        tokens = (t or "").encode().lower().split()
        c = [words[w] for w in tokens] + [len(train)]
        base = sum(math.log10((x + 0.5) / (total + 0.5 * (types + 1))) for x in c)
        expected.append((i, held(i), len(c), sum(x > 0 for x in c), total, round(base, 4), score))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.score) for r in found]
    for a, b in zip(keyed(got), keyed(expected), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=2e-4) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_probabilities_of_all_bytes_add_up_to_one():
    texts = [b"abracadabra" * 20, b"the cat sat on the mat"]
    grams = ctw.Grams(texts, 6)
    every = np.unique(np.concatenate([(grams.grams >> np.uint64(8) << np.uint64(8)) | np.uint64(b) for b in range(256)]))
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, grams.grams)] = grams.counts(np.array([True, True]))
    _, _, levels, keys, _ = ctw.subtrees(every, counts, 6)
    n0, n1, lw = (np.zeros(1 << 16) for _ in range(3))
    at = (keys[-1] & np.uint64(0xFFFF)).astype(int)
    for array, values in ((n0, levels[-1].n0), (n1, levels[-1].n1), (lw, levels[-1].lw)):
        np.add.at(array, at, values)
    one = ctw.Level(n0, n1, lw)
    zero = ctw.Level(*(x.reshape(256, 256).sum(0) for x in (one.n0, one.n1, one.lw)))
    p = 10 ** ctw.log_probabilities(every, counts, (one.own, one.kt, zero.own, zero.kt), 6)
    np.testing.assert_allclose(np.bincount(np.unique(every >> np.uint64(8), return_inverse=True)[1], p), 1)


def test_ln_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 300.0, 1e6])
    np.testing.assert_allclose(ctw.ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-11)


def test_no_rows(spark):
    assert ctw.context_tree_scores(docs(spark, []), HELD).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(docs(spark, []).drop("score"), labels, HELD).count() == 0


def test_nothing_to_learn_from(spark):
    found = ctw.context_tree_scores(docs(spark, [(1, "abc", "en", "s")]), "true").first()
    assert (found.n_known, found.train_tokens) == (0, 0) and found.score == pytest.approx(4 * 8 * math.log10(0.5))


def test_quality_of_held_out_texts(spark):
    import random

    g = random.Random(1)
    good = lambda: " ".join("".join(g.choice("aeioutnsr") for _ in range(g.randint(2, 8))) for _ in range(60)) + "."
    bad = [lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " | ".join(good().split()), lambda: " ".join([g.choice(good().split())] * 60)]
    rows = [(k, good() if k % 3 else bad[k // 3 % 3](), "en", "s") for k in range(600)]
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0, 0) for k in range(600)] + [(3, None, 0), (None, 1, 0), (7000, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs(spark, rows), labels, quality.HELD_OUT).collect()
    assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    judged = [r.predicted == (r.doc_id % 3 > 0) for r in out if r.held_out]
    assert sum(judged) / len(judged) > 0.98
    kept = quality.keep_good(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and 380 <= kept.count() <= 410


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    out = quality.quality_scores(docs(spark), labels, quality.HELD_OUT).collect()
    assert len(out) == len(corpus())
    empty = [r for r in out if not r.text]
    assert len({round(r.score, 12) for r in empty}) == 1 and len(empty) == 3
    none = quality.quality_scores(docs(spark), spark.createDataFrame([], "doc_id long, quality int"), quality.HELD_OUT).collect()
    assert {r.score for r in none} == {0.5}


def naive_features(text):
    """Weights by term of one text, counted in plain Python."""
    out = {}

    def add(terms):
        for t, n in Counter(terms).items():
            out[t] = math.sqrt(n / len(terms))

    def mixed(x, bits):
        x = (x ^ x >> 31) * quality._ODD[2] % 2**64
        return x >> 64 - bits

    add([mixed((text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * quality._ODD[0] % 2**64, quality.BYTE_TERMS.bit_length() - 1) for i in range(len(text) - 2)])
    words = text.lower().split()
    hashed = [sum((b + 1) * pow(quality._ODD[1], k + 1, 2**64) for k, b in enumerate(w)) % 2**64 for w in words]
    add([quality.BYTE_TERMS + mixed(h, quality.WORD_TERMS.bit_length() - 1) for h in hashed])
    last, distances = {}, []
    for k, h in enumerate(hashed):
        distances.append(min(15, (k - last[h]).bit_length()) if h in last else 0)
        last[h] = k
    add([quality.BYTE_TERMS + quality.WORD_TERMS + d for d in distances])
    return out


def weights_of(texts):
    row, term, weight = quality.features(texts)
    return quality.Weights(np.searchsorted(row, np.arange(len(texts) + 1)), term, weight.astype(np.float32))


def labelled_texts(n=240, seed=5):
    """(id, text, label) in three scripts: prose, and junk of three kinds."""
    import random

    g = random.Random(seed)
    letters = ["aeioutnsrlé", "аеионтсрвл", "的一是不了人我在有他这为之大来以个中上们"]

    def prose(k):
        return " ".join("".join(g.choice(letters[k]) for _ in range(g.randint(2, 8))) for _ in range(g.randint(20, 60))) + "."

    junk = [lambda t: " ".join(w + g.choice(["!!", "%%%", "$$$"]) for w in t.split()), lambda t: " | ".join(t.split()), lambda t: " ".join([t.split()[0]] * 60)]
    return [(i, prose(i % 3) if i % 4 else junk[i // 4 % 3](prose(i % 3)), int(i % 4 > 0)) for i in range(n)]


def test_features_are_those_counted_one_by_one():
    texts = [t.encode() for _, t, _ in labelled_texts(40)] + [b"", b"a", b"ab", b" \n ", b"The the THE", b"  x  y", "é é".encode(), b"end "]
    row, term, weight = quality.features(texts)
    for k, text in enumerate(texts):
        got = dict(zip(term[row == k].tolist(), weight[row == k].tolist(), strict=True))
        assert got == pytest.approx(naive_features(text))


def test_every_score_is_the_vote_of_its_nearest(spark):
    """All scores of the operator against votes counted in plain Python with the same axes, which are
    held against a plain decomposition; Chinese and Cyrillic texts are told from one another."""
    rows = labelled_texts()
    frame = docs(spark, [(i, t, "en", "s") for i, t, _ in rows] + [(900, "", "en", "s"), (901, None, "en", "s"), (3, rows[3][1], "en", "s")]).drop("text_").withColumnRenamed("key", "quality")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    found = quality.quality_scores(frame, labels, quality.HELD_OUT).collect()
    train = [(i, t.encode(), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.zeros((len(train), quality.TERMS))
    for k, (_, t, _) in enumerate(train):
        for term, w in naive_features(t).items():
            x[k, term] = np.float32(w)
    prior = sum(y for *_, y in train) / len(train)
    model = quality.Model(weights_of([t for _, t, _ in train]), np.array([y for *_, y in train]), quality.DIMENSIONS, prior)
    shares = x**2 / np.maximum((x**2).sum(0), 1e-300)
    glob = np.maximum(0, 1 + (shares * np.log(np.maximum(shares, 1e-300))).sum(0) / math.log(len(train)))
    plain = np.linalg.svd(x * glob, full_matrices=False)[1]
    kept = np.linalg.norm((x * glob) @ (model.axes / np.where(glob > 0, glob, 1)[:, None]))
    assert kept == pytest.approx(np.linalg.norm(plain[: quality.DIMENSIONS]), rel=2e-2)

    def vector(text):
        v = sum((w * model.axes[t] for t, w in naive_features(text).items()), np.zeros(model.axes.shape[1]))
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else None

    known = [vector(t) for _, t, _ in train]
    assert len(found) == len(rows) + 3
    for r in found:
        v = vector((r.text or "").encode())
        if v is None:
            assert r.score == pytest.approx(prior)
            continue
        ranked = sorted(((-round(max(float(v @ u), 0.0), 10), i, y) for u, (i, _, y) in zip(known, train, strict=True)))[: quality.NEIGHBOURS]
        assert r.score == pytest.approx(sum(s * y for s, _, y in ranked) / sum(s for s, _, _ in ranked), abs=1e-6)
    judged = [(r.score, rows[r.doc_id][2]) for r in found if r.held_out and r.doc_id < 900]
    assert sum((s >= 0.7) == bool(y) for s, y in judged) / len(judged) > 0.95
    assert sum((s - y) ** 2 for s, y in judged) / len(judged) < 0.05


def test_scores_do_not_depend_on_the_batch_and_ties_go_by_id():
    texts = [t.encode() for _, t, _ in labelled_texts(150)]
    labels = np.array([1] * 50 + [0] * 10)
    model = quality.Model(weights_of([*texts[:50], *texts[:10]]), labels, 64, 0.5)  # ten texts twice
    together = model.scores(texts, 15)
    assert together.tolist() == [model.scores([t], 15)[0] for t in texts]
    assert model.scores(texts[:10], 1).tolist() == [1.0] * 10  # of equal texts the one that comes first


def test_labels_of_one_kind(spark):
    rows = labelled_texts(40)
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows], "doc_id long, quality int")
    found = quality.quality_scores(docs(spark, [(i, t, "en", "s") for i, t, _ in rows]), labels, quality.HELD_OUT).collect()
    assert {r.score for r in found} == {1.0}


def test_features_of_a_long_text_are_those_of_the_whole(monkeypatch):
    """Window by window, and in a few times its size."""
    import resource

    from sampledeck.llm import quality

    g = np.random.default_rng(2)
    words = ["".join(map(chr, g.integers(97, 123, g.integers(1, 9)))) for _ in range(400)]
    texts = [" ".join(g.choice(words, 3000)) + " \n\t x" + "y" * 500 + " é日 " * 40, "z" * 3000, " " * 2000, "A b a B  " * 400]
    whole = [quality.features([t.encode()]) for t in texts]
    monkeypatch.setattr(quality, "WINDOW", 700)
    for t, expected in zip(texts, whole, strict=True):
        found = quality.features([t.encode()])
        assert all((a == b).all() if a.dtype != float else np.allclose(a, b, rtol=1e-12) for a, b in zip(found, expected, strict=True))
    monkeypatch.undo()
    long = (" ".join(g.choice(words, 60_000)) + " ").encode() * 64
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    quality.features([long])
    assert len(long) > 18 << 20 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 20 * len(long)


def test_long_texts_of_the_context_tree_go_in_parts(monkeypatch):
    """Blocks and parts give the grams, counts, sums and words of the whole, in bounded memory."""
    g = np.random.default_rng(3)
    texts = [bytes(g.integers(97, 100, n).astype(np.uint8)) + b" " + bytes(g.integers(97, 105, n).astype(np.uint8)) for n in (0, 3, 700, 10_000, 1, 4000)] + [b"", b"ab cd " * 500]
    train = np.array([True, False] * 4)
    whole = ctw.Grams(texts, 6)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 1000)
    parts = ctw.ChunkGrams(texts, 6)
    assert len(parts.blocks) > 10
    grams, counts = parts.counted(train)
    assert (grams == whole.grams).all() and (counts == whole.counts(train)).all() and (parts.distinct() == grams).all()
    values = g.integers(0, 1 << 40, len(grams))
    assert (parts.sums(grams, values) == whole.sums(values)).all()
    found = [Counter() for _ in texts]
    for whose, words in ctw.word_parts(texts):
        for number, text in zip(words.number.tolist(), words.text.tolist(), strict=True):
            found[whose[text]][words.distinct[number]] += 1
    assert found == [Counter(t.split()) for t in texts]
