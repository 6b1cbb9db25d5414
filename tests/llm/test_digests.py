"""Each query without SQL over whole small tables, against brute force: the digests that it derives."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus
from test_duplicates import fingerprint, grouped, repeats
from test_scoring import brute_force, labelled_texts

import __spark_entry__
from sampledeck.llm import ctw

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder of documents and labels, rows) with every awkward row."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [*corpus(n=30), *((500 + i, t, "en", "s") for i, t, _ in labelled_texts(60)), (700, "see <|endoftext|> x", "en", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.selectExpr("*", "char_length(text) as n_chars").repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(500 + i, y, 0) for i, _, y in labelled_texts(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows


def result(spark, tables, name):
    return __spark_entry__.queries()[name](spark, tables[0]).collect()


def ids(path, text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_op3(spark, tables):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    scores = brute_force(tables[1], ctw.DEPTH)
    train = Counter(w for i, t, *_ in tables[1] if not held(i) for w in (t or "").encode().lower().split())
    total = sum(train.values()) + sum(not held(i) for i, *_ in tables[1])
    found = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in result(spark, tables, "op3_ctw_score")))
    expected = sorted((repr(i), held(i), len(w := (t or "").encode().lower().split()) + 1, sum(train[x] > 0 for x in w) + 1, total, round(s, 6)) for (i, t, *_), s in zip(tables[1], scores, strict=True))
    assert [f[:5] for f in found] == [e[:5] for e in expected] and [f[5] for f in found] == pytest.approx([e[5] for e in expected], rel=1e-8)


def test_op4(spark, tables):
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in result(spark, tables, "op4_simhash_groups")), key=repr)
    assert found == grouped(tables[1], [fingerprint(r[1]) for r in tables[1]])


def test_op5(spark, tables):
    found = result(spark, tables, "op5_pack_pieces")
    assert sorted(r.sequence_id for r in found) == list(range(len(found))) and {r.offset for r in found} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in found)
    expected = []
    for i, t, *_ in tables[1]:
        own, start = ids(public_tokenizers.path("byte_bpe_50k.json"), t), 0
        while start < len(own):
            n = min(2048, 1 << (len(own) - start).bit_length() - 1)
            expected.append((repr(i), start, n, zlib.crc32(own[start : start + n].tobytes()), len(own)))
            start += n
    assert sorted((repr(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(expected)


def test_op7(spark, tables):
    found = result(spark, tables, "op7_quality_scores")
    assert set(found[0].asDict()) == {"doc_id", "held_out", "score", "predicted"} and len(found) == len(tables[1])
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    label = {500 + i: y for i, _, y in labelled_texts(60)}
    learned = [(r.predicted, label[r.doc_id]) for r in found if r.doc_id in label]
    assert sum(a == b for a, b in learned) / len(learned) > 0.8


def test_op8(spark, tables):
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, tables, "op8_remove_repeats")), key=repr)
    assert found == sorted(((i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, kept, spans in repeats(tables[1], 50)), key=repr)


def test_op9(spark, tables):
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in result(spark, tables, "op9_token_files"))
    start, expected = 0, []
    for i, t, *_ in sorted(tables[1], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = ids(public_tokenizers.path("word_bpe_49k.json"), t)
        expected.append((start, i, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert found == expected
