"""Packing by power-of-two decomposition (operator 5).

A document's ids (its text's ids and one end id) are cut into pieces whose lengths are powers of two:
as many of the longest length as fit, then the binary digits of what is left, longest first.  Every
piece is a sequence of its own, so none crosses documents and none needs padding; sequences of equal
length form a bucket, and are numbered bucket by bucket, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_number, give_back, text_column, written
from .tokens import encoder, slices_of

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of so many ids (which document, length) of each piece, in order."""
    full = totals // longest
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    each = np.concatenate([full[:, None], totals[:, None] // digits % 2], axis=1)
    lengths = np.tile(np.concatenate([[longest], digits]), len(totals))
    return np.repeat(np.arange(len(totals)), each.sum(1)), np.repeat(lengths, each.ravel())


def pieces_of(tokenizer: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for begin, texts in slices_of(batch.column("text")):
                ids, bounds = encoder(tokenizer).with_end(texts, end_id)
                totals = np.diff(bounds)
                rows, length = cut(totals, longest)
                ends = np.cumsum(length)
                values = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch([doc_ids.slice(begin, len(texts)).take(pa.array(rows)), pa.array(ends - length - bounds[rows]), pa.array(length), pa.array(totals[rows]), values], ["doc_id", "start", "length", "doc_tokens", "ids"])
                give_back()

    return run


def cut_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all docs, written to the shared folder: PIECES and piece, a unique long."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(pieces_of(tokenizer, longest, end_id), PIECES).withColumn("piece", F.monotonically_increasing_id()), "pieces")


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Each piece's place, and the checksum of its ids: sequence_id counts from 0 in order of length
    (longest first), doc_id, start; offset, the piece's place in its sequence, is 0."""
    rows = pieces.select("piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    numbered = dense_number(rows, [F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("piece")], "sequence_id")
    return numbered.withColumn("offset", F.lit(0).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences with their ids (little-endian unsigned 32-bit integers, one after another): a row
    for each piece of each row of docs.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; a null
    doc_id is carried through. No rows give no rows; other columns are ignored.
    """
    pieces = cut_documents(docs, tokenizer, longest, end_id, doc_id, text)
    return number_sequences(pieces).join(pieces.select("piece", "ids"), "piece").drop("piece")


def packed_digest(docs: DataFrame) -> DataFrame:
    """What op5 returns, from the pieces as written."""
    import public_tokenizers

    pieces = cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return number_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_pack_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
