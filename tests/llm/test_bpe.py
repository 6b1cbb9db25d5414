"""Byte-level BPE against the tiktoken library, ids and offsets, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
from helpers import corpus, docs

import __spark_entry__
from sampledeck.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATTERN = public_tokenizers.PATTERN
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
ODD = [
    "see <|endoftext|> x", "<|endofword|>", "a<|endofword|> b <|endofword|><|endofword|>", "a" * 5000, "ab" * 300 + " " * 77 + "\n\n\n x", "don't we'LL 123456 １２ ²", "🙂👩‍👩‍👧 é   x　", "\x00\x1c\x85 \t\n", "aaa aaaa  aaaaa aaaaaaa\r\n\r\n",
    "日本語テキスト" * 40, "مرحبا بالعالم", "=" * 999 + "-" * 999, " leading", "trailing ", "�\U0010ffff",
]


def reference(name):
    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows():
    g = random.Random(5)
    noise = ["".join(chr(g.choice([g.randrange(32, 127), g.randrange(160, 0x3000), g.randrange(0x1F300, 0x1F700)])) for _ in range(g.randrange(200))) for _ in range(60)]
    return [*corpus(n=30), *((1000 + k, t, "en", "s") for k, t in enumerate([*ODD, *noise]))]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_offsets_are_those_of_tiktoken(spark, name):
    library, path = reference(name), public_tokenizers.path(name)
    found = bpe.encode_documents(docs(spark, rows()), path, PATTERN, offsets=True)
    assert found.columns == ["doc_id", "n_tokens", "ids", "char_starts"]
    got = sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.char_starts, "<i4").tolist(), r.n_tokens) for r in found.collect())
    expected = []
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        expected.append((repr(i), ids, library.decode_with_offsets(ids)[1], len(ids)))
    assert got == sorted(expected)


def test_every_character_of_the_plane_and_other_patterns():
    path = public_tokenizers.path(FILES[0])
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}x" for c in [*range(0, 0xD800, 7), *range(0xE000, 0x20000, 11)]]
    coder, library = bpe.rank_encoder(path, PATTERN), reference(FILES[0])
    import pyarrow as pa

    ids, bounds = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]
    pattern = r"\p{N}{1,3}| ?\p{L}+|\s+| ?[^\s\p{L}\p{N}]+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    coder = bpe.rank_encoder(path, pattern)
    ids, bounds = coder.encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [other.encode_ordinary(t) for t in ODD]


def test_long_texts_go_in_windows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 1000)
    text = ("some words, 日本語 \n\n  and 123 more " * 300) + "x" * 3000 + " y  \n z" * 400
    import pyarrow as pa

    coder, library = bpe.rank_encoder(public_tokenizers.path(FILES[0]), PATTERN), reference(FILES[0])
    assert coder.encode_text(pa.scalar(text)).tolist() == library.encode_ordinary(text)


def test_parts_split_no_character(spark):
    path = public_tokenizers.path(FILES[0])
    encoded = bpe.encode_documents(docs(spark, rows()), path, PATTERN).filter("doc_id is not null and doc_id <> 5")
    for size in (1, 3):
        parts = {}
        for r in bpe.decode_parts(encoded, path, PATTERN, size).collect():
            assert r.start == r.part * size
            parts.setdefault(r.doc_id, {})[r.part] = r.text
        joined = {i: "".join(p[k] for k in range(len(p))) for i, p in parts.items()}
        assert joined == {i: t or "" for i, t, *_ in rows() if i is not None and i != 5}


def test_cut_characters_and_unknown_ids(spark):
    path = public_tokenizers.path(FILES[0])
    coder = bpe.rank_encoder(path, PATTERN)
    ids = coder.whole(["🙂"])[0].astype("<u4")
    assert len(ids) > 1
    raw, first = "🙂".encode(), int(coder.sizes[ids[0]])
    cut = spark.createDataFrame([(1, ids[:1].tobytes()), (2, ids[1:].tobytes()), (3, None)], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(cut, path, PATTERN).collect()} == {1: raw[:first], 2: raw[first:], 3: b""}
    assert {r.doc_id: r.text for r in bpe.decode_parts(cut, path, PATTERN, 5).collect()} == {1: raw[:first].decode("utf-8", "replace"), 2: raw[first:].decode("utf-8", "replace"), 3: ""}
    with pytest.raises(ValueError):
        bpe.rank_encoder(path, PATTERN).bytes_of_ids(np.array([50256], np.uint32))


def test_query(spark, tmp_path):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    frame.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    library = reference(FILES[0])
    found = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in __spark_entry__.queries()["op13_byte_bpe"](spark, f"file://{tmp_path}").collect())
    expected = []
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        expected.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(expected)


def test_no_rows(spark):
    path = public_tokenizers.path(FILES[0])
    encoded = bpe.encode_documents(docs(spark, []), path, PATTERN, offsets=True)
    assert bpe.decode_documents(encoded, path, PATTERN).count() == 0 and bpe.decode_parts(encoded, path, PATTERN, 4).count() == 0
