"""Near-duplicates of the pipeline's stage, against brute force at a similarity of 0.8."""

import random
from fractions import Fraction

import pytest
from helpers import components, corpus, docs

from sampledeck.llm import near, simhash


def shingled(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return Fraction(len(a & b), len(a | b))


def families(seed=5, n=25):
    """Texts and edits of theirs, from slight ones to such as fall below 0.8."""
    g = random.Random(seed)
    rows = []
    for f in range(n):
        words = [f"w{g.randint(0, 5000)}" for _ in range(g.randint(8, 400))]
        for k in range(6):
            edited = list(words)
            for _ in range(round(len(words) * g.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                edited[g.randrange(len(words))] = f"x{g.randint(0, 5000)}"
            rows.append((1000 + 10 * f + k, " ".join(edited), "en", "src1"))
    return rows


def expected(rows):
    held = [shingled(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if similar(held[a], held[b]) >= Fraction(4, 5)]
    label = components(len(rows), links)
    least = {}
    for k, c in enumerate(label):
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted(((r[0], least.get(c)) for r, c in zip(rows, label, strict=True)), key=repr), links


@pytest.mark.parametrize(("limit", "block"), [(64, 512), (2, 3)])
def test_near_groups(spark, monkeypatch, limit, block):
    monkeypatch.setattr(near, "KEY_LIMIT", limit)
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus() + families()
    groups, links = expected(rows)
    assert sum(similar(shingled(rows[a][1]), shingled(rows[b][1])) < Fraction(9, 10) for a, b in links) > 20
    assert sorted(map(tuple, near.near_groups(docs(spark, rows)).collect()), key=repr) == groups


def test_pairs_that_differ_in_more_than_three_bits_go(spark):
    rows = families()
    groups, _ = expected(rows)
    stay = {i for i, c in groups if i == c}
    assert {r.doc_id for r in near.keep_one_of_each(docs(spark, rows)).collect()} == stay
    assert len(stay) < len({r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()})


def test_fingerprints_by_multi_index_hashing_find_candidates(spark, monkeypatch):
    """Without bands: the groups are of verified pairs in groups of fingerprints, by brute force."""
    monkeypatch.setattr(near, "band_members", lambda marks: marks.select(near.F.col("node").alias("key"), "node").limit(0))
    rows = corpus() + families() + [(5000, None, "en", "s"), (5001, " ", "en", "s")]
    held = [shingled(r[1]) for r in rows]
    prints = [simhash.print_of(near.shingles(r[1])) for r in rows]
    # a bit is set where over half of the hashes have it
    for found, own in zip((near.shingles(r[1]) for r in rows), prints, strict=True):
        assert all((own >> b & 1) == (2 * sum(int(x) >> b & 1 for x in found) > len(found)) for b in (0, 13, 63))
    group = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if group[a] == group[b] and similar(held[a], held[b]) >= Fraction(4, 5)]
    assert any(held[a] != held[b] and prints[a] != prints[b] for a, b in links)
    label, least = components(len(rows), links), {}
    for k, c in enumerate(label):
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    wanted = sorted(((r[0], least.get(c)) for r, c in zip(rows, label, strict=True)), key=repr)
    assert sorted(map(tuple, near.near_groups(docs(spark, rows)).collect()), key=repr) == wanted


def test_pairs_at_the_threshold_share_a_band():
    """Similarity exactly 0.8: sets of 18 hashes a side, 16 of them shared."""
    g = random.Random(6)
    for _ in range(3000):
        found = [g.getrandbits(64) for _ in range(20)]
        a, b = (near.np.unique(near.np.array(x, near.np.uint64)) for x in (found[:18], found[:16] + found[18:]))
        assert (near.band_keys(a) == near.band_keys(b)).any()


def test_every_pair_across_roots_is_looked_at_in_blocks():
    rows = families(8, 6)
    held = [near.shingles(r[1]).view("i8") for r in rows]
    table = near.pa.table({"node": list(range(len(rows))), "root": [k // 4 for k in range(len(rows))], "held": held})
    links = near.block_links(table).to_pydict()
    found = components(len(rows), zip(links["src"], links["dst"], strict=True))
    wanted = [(a, b) for a in range(len(rows)) for b in range(a) if a // 4 != b // 4 and similar(shingled(rows[a][1]), shingled(rows[b][1])) >= Fraction(4, 5)]
    assert wanted and found == components(len(rows), wanted)


def test_one_row_of_each_group_stays(spark):
    """Judged row by row: repeated ids, null ids, and groups without any id."""
    base = [r[1] for r in families(6, 4)]
    rows = [*corpus(), *((None, t, "en", "s") for t in base[:8]), (300, base[0], "en", "s"), *((400, t, "en", "s") for t in base[8:14]), (400, base[9], "en", "s"), (401, base[8], "en", "s"), (None, base[20], "en", "s"), (None, base[20], "en", "s")]
    sets_ = [shingled(r[1]) for r in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets_[a], sets_[b]) >= Fraction(4, 5)])
    kept = near.keep_one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    stay = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = {}
    for c, r in zip(label, rows, strict=True):
        groups.setdefault(c, []).append((r[0], r[1]))
    for c, members in groups.items():
        ids = [i for i, _ in members if i is not None]
        mine = [m for m in stay if m in members]
        assert len(set(mine)) == 1 and mine[0][0] == min(ids, default=None), (c, members, mine)
        assert len(mine) == members.count(mine[0])
    assert len(stay) < len(rows) - 10
