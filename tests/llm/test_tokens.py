"""Ids against the library at its defaults, where special tokens in texts are tokens."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs

from sampledeck.llm import packing, tokenfile
from sampledeck.llm.common import new_path
from sampledeck.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SPECIAL = ["see <|endoftext|> here", "<|endoftext|>", "a<|startoftext|>b  c", "<|endoftext|><|endoftext|>\n x", "A <|ENDOFTEXT|> x", "<|end oftext|>", "<|end\noftext|>", " <|startoftext|> <|endoftext|> "]


def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_library_at_its_defaults(path):
    whole = library(path)
    texts = [x for pair in zip(SPECIAL, [r[1] or "" for r in corpus()], strict=False) for x in pair] + SPECIAL
    for _ in range(2):
        ids, bounds = encoder(path).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [whole(t).tolist() for t in texts]


def test_operators_take_special_tokens_as_the_library_does(spark):
    rows = [(k, t, "en", "src1") for k, t in enumerate(SPECIAL)]
    whole, start, expected = library(WORDS), 0, []
    for k, t, *_ in rows:
        ids = np.append(whole(t), [1]).astype("<u4")
        expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = tokenfile.write_token_files(docs(spark, rows), WORDS, new_path(spark, "t"))
    assert sorted(map(tuple, tokenfile.read_token_digests(manifest).collect())) == expected
    whole = library(BYTES)
    pieces = packing.pack_documents(docs(spark, rows), BYTES, 256).orderBy("doc_id", "start").collect()
    for k, t, *_ in rows:
        assert np.frombuffer(b"".join(r.ids for r in pieces if r.doc_id == k), "<u4").tolist() == [*whole(t).tolist(), 1]


def test_white_space_is_that_of_python():
    from sampledeck.llm.tokens import white

    characters = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert white(pa.array(characters)).tolist() == [c.isspace() for c in characters]
