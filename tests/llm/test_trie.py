"""The prefix trie against brute force: every awkward row, equal hashes and fingerprints, long conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sampledeck.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed=1, n=40):
    g = random.Random(seed)
    turns = [(g.choice(["user", "assistant"]), "".join(g.choice("abé🙂 ") for _ in range(g.randrange(6)))) for _ in range(12)]
    rows = []
    for c in range(n):
        for k in range(g.choice([1, 2, 3, 5, 12])):
            role, text = turns[0] if k == 0 and c % 3 else g.choice(turns)
            rows.append((c, k, role, text))
    rows += [(c, k, f"r{k}", "same") for c in range(100, 130) for k in range(4)]  # copies
    rows += [(200, None, "user", "null first"), (200, 0, None, None), (200, 0, "user", "tie"), (200, 0, "user", "tie"), (200, 0, "a", "b")]
    rows += [(-7, 0, "user", "negative"), (-5, 0, "user", "negative"), (-3, 0, None, "x"), (None, 0, "user", "of none"), (None, None, None, None)]
    rows += [(303, 0, "", ""), (304, 0, None, None), (10**15, 3, "user", "far"), (401, 0, "ab", "c"), (402, 0, "a", "bc")]
    return rows + [(500 + j, k, "u", str(k)) for j in range(3) for k in range(60 + j)]  # a deep one


def tree(sequences):
    """Per node what op12 says, of {conv: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, own in members.items()
    )


def sequences(rows):
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return found


def rebuilt(found):
    out = {}
    for c in found:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = found.get(base, [])[:h] + found[c][h:]
    return out


def as_rows(frame):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def ordered(rows, spark=None):
    """Turns in the operator's order: ties as their hashes say."""
    frame = spark.createDataFrame([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None], SCHEMA).selectExpr("*", "xxhash64(role, text) as h")
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.h)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    return found


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'clash' as depth", "1 as hash", "'c' as tag", "2 as number", "'x' as print")


def test_plain_trie(spark):
    assert as_rows(trie.prefix_trie(table(spark, conversations()))) == tree(ordered(conversations(), spark))


def test_rebuilt_trie_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    found = trie.trie(*trie.rebuilt(trie.numbered_turns(table(spark, conversations()))))
    assert as_rows(found) == tree(rebuilt(ordered(conversations(), spark)))


@pytest.mark.parametrize("hashes,prints", [(2, trie.PRIME), (None, 3)])
def test_equal_hashes_and_fingerprints_are_told_apart(spark, hashes, prints):
    rows = [r for r in conversations() if r[0] != 200 and r[0] is not None and r[0] < 300]
    turns = trie.numbered_turns(table(spark, rows), hash_values=hashes)
    found = trie.trie(turns.withColumnRenamed("place", "depth"), turns.groupBy("conv_id").agg({"place": "max"}).withColumnRenamed("max(place)", "length"), prints)
    assert as_rows(found) == tree(ordered(rows, spark))


def test_small_tables(spark):
    assert trie.prefix_trie(table(spark, [])).collect() == []
    assert as_rows(trie.prefix_trie(table(spark, [(3, None, None, None)]))) == tree({3: [("", "")]})
    gone = trie.trie(*trie.rebuilt(trie.numbered_turns(table(spark, [(1, 0, "u", "x"), (3, 0, "u", "y")]))))  # no base, so no turns where h > 0
    assert as_rows(gone) == tree(rebuilt({1: [("u", "x")], 3: [("u", "y")]}))


def test_arithmetic_modulo_the_prime():
    g = np.random.default_rng(2)
    a, b = (g.integers(0, trie.PRIME, 500).astype(np.uint64) for _ in range(2))
    assert trie.times(a, b).tolist() == [int(x) * int(y) % trie.PRIME for x, y in zip(a, b, strict=True)]
    e = g.integers(0, 1 << 40, 50)
    assert trie.power(e).tolist() == [pow(trie.BASE, int(x), trie.PRIME) for x in e]
    values, begins = g.integers(0, trie.PRIME, 300), np.array([3, 50, 51, 200])
    expected, total = [], 77
    for k, v in enumerate(values.tolist()):
        total = (0 if k in begins else total) + v
        expected.append(total % trie.PRIME)
    assert trie.running(values, begins, 77, True).tolist() == expected
    small = values >> 30
    total, expected = 5, []
    for k, v in enumerate(small.tolist()):
        total = (0 if k in begins else total) + v
        expected.append(total)
    assert trie.running(small, begins, 5, False).tolist() == expected


def test_long_lists_of_ends_go_in_pieces(spark):
    rows = [(c, 0, "u", "hi") for c in range(5000)]
    assert as_rows(trie.prefix_trie(table(spark, rows))) == tree({c: [("u", "hi")] for c in range(5000)})
