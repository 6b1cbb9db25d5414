"""Archives, token files, packing, decontamination and the pipeline: round trips and brute force."""

import base64
import hashlib
import json
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs

import __spark_entry__
import corpus_pipeline
from sampledeck.llm import decontam, packing, tokenfile, tokens, warc
from sampledeck.llm.common import new_path
from sampledeck.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")


def ids_of(encoder, texts):
    ids, bounds = encoder.with_end(pa.array(texts, pa.string()), 1)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


ODD = ["", " ", "  ", "a ", " a", "a  b", "a   b", "a\n b", "a \nb", "a\n\n b", "\ta b\t", "it's we'll don't", "<|endoftext|> x", "x<|startoftext|>", "éé é", "é ́x", "ΑΣ ΑΣ.", "İI", "a b", "a\x1cb \x1c c", "x\r\n y", "1234 5 67", "日本 語", "🙂 🙂🙂", "a  b", "... ,, !!"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_word_by_word_is_as_the_library(path):
    encoder, whole = Encoder(path), library(path)
    assert encoder.before is not None
    texts = ODD + [r[1] for r in corpus()] + ODD[::-1]
    for part in (texts, texts[:1], ODD[1:2], texts[5:9], [], [None], texts):
        assert ids_of(encoder, part) == [whole(t).tolist() for t in part]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_text_without_a_space_is_not_remembered(path):
    encoder, whole = Encoder(path), library(path)
    texts = ["日本語テキスト" * 20_000, "QUJD" * 50_000, "a b " + "x" * 5000]
    assert ids_of(encoder, texts) == [whole(t).tolist() for t in texts]
    assert encoder.inner.words.nbytes < 1000 and encoder.first.words.nbytes < 1000


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_very_many_words(path):
    """A million distinct ones: what a worker remembers stays bounded, and ids are the library's."""
    encoder, whole = Encoder(path), library(path)
    for k in range(0, 1_000_000, 200_000):
        texts = [" ".join(f"{n:x}w" for n in range(m, m + 1000)) for m in range(k, k + 200_000, 1000)]
        found = ids_of(encoder, texts)
        assert found[3] == whole(texts[3]).tolist() and found[-1] == whole(texts[-1]).tolist()
        assert encoder.inner.words.nbytes + encoder.inner.ids.nbytes < tokens.KEPT_BYTES + (16 << 20)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 60)
    for path in (BYTES, WORDS):
        encoder, whole = Encoder(path), library(path)
        for part in (ODD, ODD[3:9], ODD):
            assert ids_of(encoder, part) == [whole(t).tolist() for t in part]
        assert len(encoder.inner.words) < 100


def test_another_tokenizer_goes_to_the_library(tmp_path):
    rules = json.load(open(BYTES, encoding="utf-8"))
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(rules))
    encoder, whole = Encoder(str(tmp_path / "other.json")), library(str(tmp_path / "other.json"))
    assert encoder.before is None and ids_of(encoder, ODD) == [whole(t).tolist() for t in ODD]


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 5000])
def test_bits_go_round(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << width, n).astype(np.uint32)
    packed = tokenfile.pack(ids, width)
    assert len(packed) == -(-n * width // 8) and (tokenfile.unpack(packed, n, width) == ids).all()


@pytest.mark.parametrize("width", [16, 17])
def test_random_access(tmp_path, width):
    g = np.random.default_rng(1)
    texts = [g.integers(0, 1 << width, n).astype("<u4") for n in (0, 1, 5000, 3, 300_000, 17)]
    out = tokenfile.TokenFileWriter(f"file://{tmp_path}", width)
    for k in range(0, 6, 2):
        out.add([k, k + 1], np.concatenate(texts[k : k + 2]), np.array([0, len(texts[k]), len(texts[k]) + len(texts[k + 1])]))
    url, size, n_docs, n_ids = out.close()
    file = tokenfile.TokenFile(url, size)
    assert (n_docs, n_ids) == (6, sum(map(len, texts)))
    for k in (4, 0, 2, 5, 1, 3):
        assert (file.document(k) == texts[k]).all()
    assert (file.ids(4000, 9000) == np.concatenate(texts)[4000:9000]).all()
    assert os.path.getsize(url.removeprefix("file://")) < n_ids * width / 8 + 2000


def test_token_files(spark):
    rows, whole = corpus(), library(WORDS)
    manifest = tokenfile.write_token_files(docs(spark, rows), WORDS, new_path(spark, "t"), file_bytes=3000)
    assert manifest.count() >= 3
    found = sorted(map(tuple, tokenfile.read_token_digests(manifest).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(t)
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == expected
    assert tokenfile.read_token_digests(tokenfile.write_token_files(docs(spark, []), WORDS, new_path(spark, "t"))).count() == 0


def test_packing(spark):
    rows, whole = corpus(), library(BYTES)
    out = packing.pack_documents(docs(spark, rows), BYTES, 256).collect()
    pieces = defaultdict(list)
    for r in out:
        assert 4 * r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append(r)
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted((r.length for r in out), reverse=True)
    expected = defaultdict(list)
    for i, t, *_ in rows:
        expected[i].append(whole(t).tolist())
    assert pieces.keys() == expected.keys()
    for i, texts in expected.items():
        if len(texts) == 1:
            own = sorted(pieces[i], key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == texts[0] and {r.doc_tokens for r in own} == {len(texts[0])}
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs(spark), BYTES, 100)


def test_cut_into_powers_of_two():
    rows, lengths = packing.cut(np.array([2048 * 2 + 5, 1, 2047, 2048]), 2048)
    assert rows.tolist() == [0] * 4 + [1] + [2] * 11 + [3]
    assert lengths.tolist() == [2048, 2048, 4, 1, 1, *[1 << b for b in range(10, -1, -1)], 2048]
    assert packing.cut(np.array([3]), 1)[1].tolist() == [1, 1, 1]


def pages():
    html = ["<p>one</p>", "<p>two é</p>", "", None]
    rows = [(k, f"https://M{k % 7}.Example.com:80{k % 2}/a/{k // 7}?q={k % 3}#top", html[k % 4] if k % 3 else f"<p>own {k}</p>") for k in range(80)]
    return [*rows, (80, None, "x"), (81, "", "x"), (82, "no url at all", "y"), (83, "http://[bad", "<p>one</p>"), (84, "http://h/ü ?ä", "z" * 300_000), (5, rows[5][1], rows[5][2]), (None, "http://n/", "<p>one</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, monkeypatch, least):
    for name, value in (("BLOCK_LINES", 4), ("ARCHIVE_BYTES", 2000), ("RANGE_BYTES", 3000)):
        monkeypatch.setattr(warc, name, value)
    rows, folder = pages(), new_path(spark, "w")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as key", "1 as last", "2 as n", "'s' as sha1").repartition(3)
    captures = warc.write_pages(frame, folder, least)
    index = warc.write_index(captures, folder, 20)
    assert index.count() >= 4
    found = warc.read_records(warc.look_up(frame, index)).collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, data in payload.items():
        if i is not None and len(data) >= least:
            last[data] = max(last.get(data, -1), i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i is not None and len(data) >= least and last[data] != i
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[data] if revisit else None, None if revisit else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_looking_up_some_urls(spark):
    folder = new_path(spark, "w")
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    index = warc.write_index(warc.write_pages(frame, folder), folder, 10)
    asked = spark.createDataFrame([("https://m3.example.com:801/a/1?q=0",), ("https://nowhere.example/",), (None,)], "url string")
    found = warc.look_up(asked, index).collect()
    key = warc.capture_key("https://m3.example.com:801/a/1?q=0")
    assert key == "com,example,m3:801)/a/1?q=0"
    wanted = sorted(i for i, u, _ in pages() if i is not None and warc.capture_key(u) in (key, warc.capture_key(None)))
    assert sorted(r.page_id for r in found) == wanted and len(wanted) >= 2


def test_archives_are_standard_gzip_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([(1, "http://a/", "x" * 50)], "page_id long, url string, html string"), folder)
    import gzip

    (file,) = (tmp_path / "w").glob("*.warc.gz")
    text = gzip.decompress(file.read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"x" * 50 + b"\r\n\r\n")


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_path(spark, "w")
    assert warc.read_records(warc.look_up(frame, warc.write_index(warc.write_pages(frame, folder), folder))).count() == 0


def contained(rows, items, least=0.8):
    def shingles(words, n):
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    out = set()
    for item, text in items:
        words = (text or "").lower().split()
        if item is None or not words:
            continue
        n = min(5, len(words))
        own = shingles(words, n)
        for i, t, *_ in rows:
            m = len(own & shingles((t or "").lower().replace("\x1c", "§").replace(" ", "¤").split(), n))
            if m and m >= least * len(own) - 1e-9:
                out.add((i, item, len(own), m))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contained_items(spark, block_bytes):
    rows = corpus()
    words = rows[3][1].split()
    long = rows[-3][1].split()
    items = [(k, " ".join(rows[k][1].split()[:30])) for k in range(12)]
    items += [(20, " ".join(words[:3]).upper()), (21, words[0]), (22, ""), (23, None), (None, "x"), (24, " ".join(long[100:140])), (25, " ".join(long[200:220] + ["zzz"] + long[220:240])), (26, " ".join(long[300:310] + ["q", "w"] + long[310:312])), (24, " ".join(long[100:140])), (27, "a a a a a a a a")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' as doc_id", "1 as matched")
    found = decontam.contained_items(docs(spark, rows), frame, block_bytes=block_bytes)
    got = {(r.doc_id, r.item_id, r.item_shingles, r.matched) for r in found.collect()}
    assert got == contained(rows, items) and found.count() == len(got) and len({g[1] for g in got}) >= 14
    rows += [(None, rows[0][1], "en", "s"), (7, rows[1][1], "en", "s"), (1, "clean under an id that repeats", "en", "s")]  # judged row by row
    kept = decontam.without_items(docs(spark, rows), frame)
    clean = [r for r in rows if not contained([r], items)]
    assert len(clean) < len(rows) - 12 and kept.columns == docs(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((r[0], r[1]) for r in clean), key=repr)
    assert decontam.contained_items(docs(spark, []), frame).count() == 0
    assert decontam.contained_items(docs(spark, rows), frame.limit(0)).count() == 0


def test_many_items_make_a_block_quickly():
    import time

    g = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{w}" for w in g.integers(0, 50_000, 60))) for k in range(8000)]  # 2.6 MB
    began = time.process_time()
    found = decontam.Items(rows, 5, 0.8)
    assert time.process_time() - began < 20
    assert found.held_by(decontam.words_of("x y " + rows[77][1] + " z")) == [(77, 56, 56)]


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline_keeps_its_contract(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    at, sizes = frame, []
    for name, stage in stages.items():
        out = corpus_pipeline.written(stage(spark, at, FOLDER), f"test-{name}")
        if name != "packing":
            assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes)
            sizes.append(out.count())
            at = out
    assert frame.count() > sizes[0] == sizes[1] > sizes[2] >= sizes[3] > 0
    pieces = out.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["op1_embedding_links", "op2_warc_captures", "op6_contained_items", "op10_line_dedup"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, FOLDER)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)
