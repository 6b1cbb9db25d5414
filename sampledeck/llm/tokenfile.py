"""Token ids in files of fixed-width bit-packed blocks (operator 9).

A file holds whole documents in order.  Each id takes the least number of bits that holds every id
of the vocabulary, least significant bit first; ids come in blocks of BLOCK, so a block begins at a
byte that the table of block offsets names, and numpy unpacks a run of blocks at once.

    payload blocks | doc ids int64[docs] | doc starts uint64[docs + 1] | block offsets
    uint64[blocks + 1] | footer: magic, width, ids a block (uint32), docs, ids, blocks, payload
    bytes (uint64)

All numbers are little-endian. A null document id is the least int64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, new_path, running_total, text_column, written
from .files import Reader, Writer
from .tokens import encoder, slices_of

BLOCK = 4096
#: Bytes of text in a file, about: so the files are as many as these are in all texts.
FILE_BYTES = 32 << 20
#: Files whose numbers of ids are broadcast, sixteen bytes each.
FEW_FILES = 1 << 20
NULL_ID = -(1 << 63)
FOOTER = struct.Struct("<8sIIQQQQ")
MAGIC = b"SDIDPAK1"
MANIFEST = "file_no long, url string, size long, n_docs long, n_ids long"
DIGEST = "file_no long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """uint32 ids to bits."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if width % 8 == 0:
        out[:, : width // 8] = raw[: n * width // 8].reshape(n, width // 8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        out[:] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u4").ravel()


class TokenFileWriter:
    def __init__(self, folder: str, width: int) -> None:
        self.file, self.width = Writer(folder, ".ids"), width
        self.docs: list[int] = []
        self.starts, self.offsets = [0], [0]
        self.held, self.held_ids = [], 0

    def add(self, docs: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents and their ids, one after another; bounds says where each begins and the last ends."""
        self.docs += [NULL_ID if doc is None else doc for doc in docs]
        self.starts += (self.starts[-1] + bounds[1:]).tolist()
        self.held.append(ids.astype("<u4").tobytes())
        self.held_ids += len(ids)
        if self.held_ids >= 64 * BLOCK:
            self.flush(self.held_ids // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for a in range(0, n, 64 * BLOCK):
            part = ids[a : min(n, a + 64 * BLOCK)]
            data = pack(part, self.width)
            self.file.write(data)
            self.offsets += [self.offsets[-1] + min(k * BLOCK * self.width // 8, len(data)) for k in range(1, -(-len(part) // BLOCK) + 1)]
        self.held, self.held_ids = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[str, int, int, int]:
        self.flush(self.held_ids)
        blocks = len(self.offsets) - 1
        self.file.write(np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.file.write(FOOTER.pack(MAGIC, self.width, BLOCK, len(self.docs), self.starts[-1], blocks, self.offsets[-1]))
        self.file.close()
        return self.file.url, self.file.position, len(self.docs), self.starts[-1]


class TokenFile:
    """Random access: documents(a, b) and ids(begin, end)."""

    def __init__(self, url: str, size: int) -> None:
        self.file = Reader(url)
        magic, self.width, self.block, self.n_docs, self.n_ids, blocks, payload = FOOTER.unpack(self.file.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{url} is no file of packed ids")
        tables = self.file.read(payload, 8 * (2 * self.n_docs + blocks + 2))
        self.doc_ids = np.frombuffer(tables, "<i8", self.n_docs)
        self.starts = np.frombuffer(tables, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1, 16 * self.n_docs + 8).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The file's ids from begin to end, by a range read of their blocks."""
        if begin >= end:
            return np.zeros(0, "<u4")
        a, b = begin // self.block, -(-end // self.block)
        n = min(b * self.block, self.n_ids) - a * self.block
        data = self.file.read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        return unpack(data, n, self.width)[begin - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self, ids: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Runs of documents of about that many ids."""
        a = 0
        while a < self.n_docs:
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + ids, "right")) - 1)
            yield a, b
            a = b


def write_partition(tokenizer: str, end_id: int, folder: str, file_ids: int):
    """A partition's documents to files of at least file_ids ids, but for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << 32, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("file_no", "url", "size", "n_docs", "n_ids"), (number, *out.close()), strict=True))])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for begin, texts in slices_of(batch.column("text")):
                out = out or TokenFileWriter(folder, width_for(encoder(tokenizer).vocabulary))
                out.add(names[begin : begin + len(texts)], *encoder(tokenizer).with_end(texts, end_id))
                give_back()
                if out.starts[-1] >= file_ids:
                    yield row()
                    number, out = number + 1, None
        if out:
            yield row()

    return run


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, url, size in zip(*(batch.column(c).to_pylist() for c in ("file_no", "url", "size")), strict=True):
            file = TokenFile(url, size)
            for a, b in file.runs():
                first = int(file.starts[a])
                ids, cuts = file.ids(first, int(file.starts[b])), (file.starts[a : b + 1] - first).tolist()
                raw = memoryview(np.ascontiguousarray(ids).tobytes())
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                names = file.doc_ids[a:b]
                yield pa.record_batch([pa.array(np.full(b - a, number, np.int64)), pa.array(names, mask=names == NULL_ID), pa.array(file.starts[a:b]), pa.array(np.diff(file.starts[a : b + 1])), pa.array(crcs, pa.int64())], ["file_no", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, file_bytes: int = FILE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all docs in ascending order of doc_id (nulls first; of equal ids in order
    of text) to files in folder, a URL. Returns the files, MANIFEST, in that order by file_no.

    Null text counts as empty. A document is its ids and end_id. No rows give no files. A task's
    documents go to several files where they have over file_bytes ids, so very long texts that meet
    in one task make no file of unbounded size.
    """
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # rows of one id can be split, too: by the first seven bytes of their text, as a number in their order
    head = F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    dealt = rows.withColumn("_head", head).repartitionByRange(files, F.col("doc_id"), F.col("text").isNotNull(), F.col("_head")).sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return written(dealt.mapInArrow(write_partition(tokenizer, end_id, folder, file_bytes), MANIFEST), "token-files")


def read_token_digests(manifest: DataFrame) -> DataFrame:
    """Per document of those files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    files = max(1, manifest.count())
    rows = manifest.select("file_no", "url", "size").repartition(files, "file_no").mapInArrow(digests, DIGEST)
    before = running_total(manifest, "file_no", "n_ids", "before")
    # Spark takes what is read from the files for as small as their list, and might broadcast it
    before = F.broadcast(before) if files <= FEW_FILES else before.hint("merge")
    return rows.join(before, "file_no").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_digests(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-ids")))
