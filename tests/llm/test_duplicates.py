"""Near-duplicates, repeated passages and lines, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import components, corpus, docs

from sampledeck.llm import components as cc
from sampledeck.llm import lines, rabitq, simhash, suffixes


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows, prints):
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = defaultdict(list)
    label = components(len(rows), links)
    for k, c in enumerate(label):
        if rows[k][0] is not None:
            groups[c].append(rows[k][0])
    return sorted(((r[0], f"{p:016x}", min(groups[c], default=None)) for r, p, c in zip(rows, prints, label, strict=True)), key=repr)


@pytest.mark.parametrize(("limit", "block", "last"), [(64, 4096, 20_000), (2, 4, 0)])
def test_simhash_groups(spark, monkeypatch, limit, block, last):
    for module, name, value in ((simhash, "KEY_LIMIT", limit), (simhash, "BLOCK", block), (cc, "LAST_LINKS", last)):
        monkeypatch.setattr(module, name, value)
    rows = corpus()
    found = simhash.simhash_groups(docs(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == grouped(rows, [fingerprint(r[1]) for r in rows])


@pytest.mark.parametrize("limit", [64, 4])
def test_links_of_near_fingerprints(spark, monkeypatch, limit):
    """Every distance from 0 to 6 around centres, dense enough that keys are shared."""
    monkeypatch.setattr(simhash, "KEY_LIMIT", limit)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    g = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = g.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in g.sample(range(64), g.randint(0, 6))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = simhash.fingerprint_links(frame).collect()
    place = {p: k for k, p in enumerate(prints)}
    pairs = [(place[r.src % (1 << 64)], place[r.dst % (1 << 64)]) for r in found]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert components(len(prints), pairs) == components(len(prints), near) and len(set(components(len(prints), near))) > 6


@pytest.mark.parametrize("last", [20_000, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(cc, "LAST_LINKS", last)
    g = random.Random(2)
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(100, 101 + k) for k in range(50)]
    mess = [(g.randint(200, 260), g.randint(200, 260)) for _ in range(35)]
    links = [(b, a) if g.random() < 0.5 else (a, b) for a, b in chain + star + mess]
    found = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "src long, dst long").repartition(4)).collect()}
    expected = components(261, links)
    assert found == {k: expected[k] for k in {x for a, b in links if a != b for x in (a, b)}}


def test_no_links(spark):
    assert cc.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(seed=4):
    g = np.random.default_rng(seed)
    rows, dim = [], 64
    for c in range(12):
        centre = g.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for k in range(25):
            rows.append(centre * 3 + g.standard_normal(dim) * (0.02 + 0.004 * k) * 3)
    rows = [x.astype(np.float32).tolist() for x in rows] + [g.standard_normal(dim).astype(np.float32).tolist() for _ in range(60)]
    table = [(k, x, k % 10) for k, x in enumerate(rows)]
    n = len(table)
    table += [(n + k, [2 * v for v in rows[0]], 1) for k in range(5)]  # the same direction
    table += [(n + 5 + k, rows[1], 1) for k in range(30)]  # equal
    table += [(n + 40, None, 1), (n + 41, [], 1), (n + 42, [0.0] * dim, 1), (n + 43, [1.0] * 63 + [None], 1), (n + 44, [1.0] * 63 + [float("nan")], 1), (n + 45, [1.0] * 63 + [float("inf")], 1)]
    table += [(n + 46, rows[0][:32], 1), (n + 47, rows[0][:32], 1), (3, rows[3], 1), (None, rows[0], 1)]
    return table


@pytest.mark.parametrize("block", [4096, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    table = vectors()
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, key int").withColumnRenamed("key", "label")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.embedding_links(frame).collect()}
    rows = sorted({i: x for i, x, _ in reversed(table) if i is not None}.items())
    units = []
    for _, x in rows:
        v = np.array(x if x and None not in x else [], float)
        units.append(v / np.linalg.norm(v) if len(v) and np.isfinite(v).all() and v.any() else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95]
    label, degree = components(len(rows), links), [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert found == {i: (degree[k], rows[label[k]][0], label[k] == k) for k, (i, _) in enumerate(rows)}
    assert len(links) > 500


def test_estimates_are_unbiased_and_within_their_bounds():
    g = np.random.default_rng(9)
    o = rabitq.unit(g.standard_normal((400, 64)))
    q = rabitq.unit(o + 0.03 * g.standard_normal((400, 64)))
    p = rabitq.rotations(64, 1)[0]
    turned = o @ p.T
    code = np.where(turned >= 0, 1, -1) / 8
    factor = (code * turned).sum(1)
    estimate = (code * (q @ p.T)).sum(1) / factor
    true = (o * q).sum(1)
    error = np.sqrt((1 - true**2) * (1 - factor**2) / (factor**2 * 63))
    assert abs((estimate - true).mean()) < 4 * error.mean() / 20 and (np.abs(estimate - true) < 5 * error).all()


def test_no_vectors(spark):
    assert rabitq.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def repeats(rows, length):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            data = (t or "").encode()
            for p in range(len(data) - length + 1):
                w = data[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if i is not None:
            for p in range(len(data) - length + 1):
                if first[data[p : p + length]] < i:
                    gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)]))).reshape(-1, 2).tolist()
        out.append((i, len(data), bytes(x for x, g in zip(data, gone, strict=False) if not g), tuple(map(tuple, edges))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "chunk_bytes", "hot"), [(50, 8 << 20, 2048), (50, 1500, 2), (23, 1500, 2048), (17, 8 << 20, 2), (64, 4000, 1)])
def test_repeats_are_cut(spark, length, chunk_bytes, hot):
    rows = [*corpus(), (140, "periodic " * 60, "en", "s"), (141, "periodic " * 40 + "end", "en", "s"), (139, "ab" * 90, "en", "s"), (142, "ab" * 100, "en", "s")]
    found = suffixes.remove_repeats(docs(spark, rows), length, chunk_bytes=chunk_bytes, hot=hot)
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), tuple((s.start, s.end) for s in r.removed)) for r in found.collect()), key=repr)
    assert got == repeats(rows, length)
    assert sum(len(r[3]) for r in got) > 10


def shuffled(spark, rows, chunk_bytes, hot=2048):
    """(rows of the contents' exchange, their bytes, bytes of the largest bucket) for that corpus."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    chunks = suffixes.chunked(frame, ["doc_id", "text"], "test-chunks", chunk_bytes)
    buckets = max(6, sum(len(t) for _, t in rows) // chunk_bytes)
    flags = suffixes.written(suffixes.exchange(chunks.mapInArrow(suffixes.ask_keys(50, buckets), suffixes.CHUNK_BLOB), suffixes.combine_keys, suffixes.shared_keys(hot), suffixes.flag_keys), "test-flags")
    asked = chunks.select("chunk", "payload").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(suffixes.ask_contents(50, buckets), suffixes.CHUNK_BLOB)
    by = asked.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("blob")).alias("b")).collect()
    return sum(r.n for r in by), sum(r.b for r in by), max(r.b for r in by)


def test_a_phrase_in_every_document_fills_no_bucket(spark):
    """30 bytes that 3000 otherwise random texts share: with its windows dealt out, the largest bucket
    has about its share; what is removed is the same."""
    g = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    text = lambda n: "".join(g.choice(letters) for _ in range(n))
    rows = [(k, text(150) + "the phrase that all texts share" + text(150)) for k in range(3000)]
    _, total, whole = shuffled(spark, rows, 50_000, 1 << 30)
    _, parts, split = shuffled(spark, rows, 50_000, 100)
    assert whole > 0.2 * total and split < 0.15 * parts
    again = [*rows[:300], *((3000 + k, rows[k][1][100:250]) for k in range(0, 300, 7))]
    frame = spark.createDataFrame(again, "doc_id long, text string")
    found = [suffixes.remove_repeats(frame, chunk_bytes=9000, hot=h).select("doc_id", "kept").collect() for h in (10, 1 << 30)]
    assert sorted(map(tuple, found[0])) == sorted(map(tuple, found[1])) == sorted((i, k) for i, _, k, _ in repeats(again, 50))


def test_a_text_of_many_documents_is_sent_once_a_chunk(spark):
    """Copies don't make a phrase hot, which would send all its windows one by one; what many different
    texts surround still is."""
    g = random.Random(5)
    text = "".join(g.choice("abcdefghijklmnop    ") for _ in range(600))
    rows = [(k, text) for k in range(3000)]
    _, whole, _ = shuffled(spark, rows, 50_000, 1 << 30)
    _, total, _ = shuffled(spark, rows, 50_000)
    assert total < 1.1 * whole and total < 0.1 * 600 * 3000
    found = suffixes.remove_repeats(spark.createDataFrame(rows[:100], "doc_id long, text string"), chunk_bytes=9000, hot=2).select("doc_id", "kept").collect()
    assert sorted((i, len(k)) for i, k in found) == [(0, 600), *((k, 0) for k in range(1, 100))]


def test_strings_of_common_words_are_not_sent(spark):
    """Prose of few syllables has the same 16 bytes again and again, but hardly a window."""
    g = random.Random(6)
    rows = [(k, " ".join("".join(g.choice(("th", "in", "er", "re", "an", "on")) for _ in range(g.randint(1, 2))) for _ in range(600))) for k in range(600)]
    _, total, _ = shuffled(spark, rows, 100_000)
    assert total < 0.1 * sum(len(t) for _, t in rows)


def test_runs_of_one_character_fill_no_bucket(spark):
    """Texts with runs of all lengths: pieces of them are the same, and are sent once a chunk."""
    g = random.Random(3)
    rows = [(k, "".join(g.choice("abcdefgh ") for _ in range(200)) + "=" * (1000 + 5 * k)) for k in range(500)]
    _, total, most = shuffled(spark, rows, 50_000)
    assert total < 0.2 * sum(len(t) for _, t in rows) and most < 0.5 * total
    found = suffixes.remove_repeats(spark.createDataFrame(rows[:60], "doc_id long, text string"), chunk_bytes=20_000).select("doc_id", "kept").collect()
    assert sorted(map(tuple, found)) == sorted((i, k) for i, _, k, _ in repeats(rows[:60], 50))


def test_long_texts_go_in_blocks(spark, monkeypatch):
    """Stretches of a text in overlapping blocks have the windows that it has, each once; and a text of
    20 MB takes a few times its size."""
    import resource

    g = np.random.default_rng(1)
    text = g.integers(97, 101, 30_000).astype(np.uint8)
    text[5000:9000], text[20_000:21_000] = 61, text[100:1100]
    use, first = np.ones(3, bool), np.array([0, 12, 29_000, 30_000])
    whole = suffixes.Stretches(text, first, use, 50)
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    cut = suffixes.Stretches(text, first, use, 50)
    windows = lambda s: sorted((k, a + j) for k, a, n in zip(s.key.tolist(), s.start.tolist(), s.windows.tolist(), strict=True) for j in range(n))
    assert windows(whole) == windows(cut) and len(windows(cut)) == 29_000 - 12 - 49 + 1000 - 49 and max(cut.windows.max(), whole.windows.max()) <= suffixes.LONGEST
    monkeypatch.undo()
    long = g.integers(97, 123, 20 << 20).astype(np.uint8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = suffixes.Stretches(long, np.array([0, len(long)]), np.ones(1, bool), 50)
    assert len(found.key) > 1 << 20 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 10 * len(long)


def test_a_chunks_work_does_not_depend_on_the_buckets(spark):
    """A chunk asks and reads its buckets in one order, so its time is about the same for any number."""
    import time

    g, letters = random.Random(4), "abcdefghijklmnop     "
    passage = ["".join(g.choice(letters) for _ in range(300)) for _ in range(300)]
    rows = [(k, "".join(g.choice(letters) for _ in range(100)) + g.choice(passage)) for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    (row,) = suffixes.chunked(frame, ["doc_id", "text"], "one-chunk").collect()
    chunk = suffixes.Chunk(bytes(row.payload), 50)
    which, times = np.arange(len(chunk.found.key)), []
    for buckets in (60, 60, 15_000):
        began = time.perf_counter()
        sent = suffixes.Contents(chunk, which, np.zeros(len(which), bool), buckets)
        told = {k: suffixes.pack_arrays(np.zeros(1, np.int64), np.array([sum(len(t) - 49 for t in texts)], np.uint32), np.array([len(t) - 49 for t in texts], np.uint32)) for k, texts in sent.sent.items()}
        sent.mark_earlier(told, chunk.doc_ids, np.zeros(len(chunk.data) + 1, bool))
        times.append(time.perf_counter() - began)
    assert times[2] < 4 * times[1] + 1.0, times


def test_what_is_shuffled_grows_as_the_corpus(spark):
    g = random.Random(2)
    words = ["".join(g.choice("abcdefgh") for _ in range(g.randint(2, 9))) for _ in range(3000)]
    made = []
    for n in (400, 1600, 6400):
        passages = [" ".join(g.choice(words) for _ in range(30)) for _ in range(n // 10)]
        rows = [(k, " ".join(g.choice(words) for _ in range(100)) + g.choice(passages)) for k in range(n)]
        made.append(shuffled(spark, rows, 4000)[:2])
    # chunks and buckets are four times as many each time; rows are never more than what is asked
    (_, a), (n, b), (m, c) = made
    assert b < 5.5 * a and c < 4.6 * b and m < 5.5 * n, made


def test_radix_sort_of_windows():
    g = np.random.default_rng(0)
    data = g.integers(97, 99, 4000).astype(np.uint8)
    places, owners = np.arange(4000 - 20), g.integers(0, 50, 3980)
    best = {}
    for p in places:
        w = data[p : p + 20].tobytes()
        best[w] = min(best.get(w, 99), owners[p])
    assert suffixes.smallest_documents(data, places, owners, 20).tolist() == [best[data[p : p + 20].tobytes()] for p in places]


def test_nothing_to_cut(spark):
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0
    (r,) = suffixes.remove_repeats(docs(spark, [(1, None, None, None)])).collect()
    assert (r.n_bytes, bytes(r.kept), r.removed) == (0, b"", [])


def test_line_dedup(spark):
    rows = corpus()
    sites, least = defaultdict(set), {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(" \t\n\r\x0b\x0c"):
                sites[line].add(s)
                if i is not None:
                    least[line] = min(least.get(line, i), i)
    spread = {line for line, s in sites.items() if len(s) >= 5}
    assert 3 <= len(spread)
    expected = []
    for i, t, _, s in rows:
        was = t.split("\n") if t is not None else []
        kept = [x for x in was if i is None or x not in spread or least[x] >= i]
        expected.append((i, s, None if t is None else "\n".join(kept), len(was), len(was) - len(kept)))
    out = lines.drop_boilerplate(docs(spark, rows), 5)
    assert sorted((tuple(r[c] for c in ("doc_id", "source", "text", "n_lines", "n_removed")) for r in out.collect()), key=repr) == sorted(expected, key=repr)
    stage = lines.without_boilerplate(docs(spark, rows))
    assert stage.columns == docs(spark, rows).columns and stage.count() == len(rows)
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [9, 10, 11, 60])
def test_sites_near_the_threshold_are_counted_exactly(spark, spread):
    rows = [(k, "the line\n" + str(k), "en", f"s{k % spread}") for k in range(3 * spread)]
    found = lines.boilerplate(docs(spark, rows), 10).collect()
    assert [r.least for r in found] == ([0] if spread >= 10 else [])


def test_lines_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "line_key", lambda line: F.struct(F.lit(1).cast("long").alias("hash"), F.lit(1).alias("bytes")))
    rows = [(k, f"spread\nrare {k % 30}\n{'few' if k < 3 else 'x' + str(k)}", "en", f"s{k % 12}") for k in range(60)]
    found = {r.line: r.least for r in lines.boilerplate(docs(spark, rows), 10).collect()}
    assert found == {"spread": 0}
    out = {r.doc_id: r.text for r in lines.drop_boilerplate(docs(spark, rows), 10).collect()}
    assert out[0] == rows[0][1] and all(out[k] == rows[k][1].partition("\n")[2] for k in range(1, 60))
