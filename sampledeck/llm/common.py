"""What the operators of this subpackage share: the shared folder, written tables, chunks of
documents, dense numbering.

Chunks.  Several operators need every task to look up something (a model's probabilities, a
window's first document) for each of millions of positions of text, in a table that is too large
to broadcast.  They first pack the documents of each scan partition into *chunks*: rows of about
8 MB of text, compressed, written once to the shared folder.  A chunk then asks for its distinct
keys only, split by a hash into buckets; a bucket's task answers every chunk that asked; the answers
go back to the chunk.  Both directions are ordinary Spark shuffles of compact blobs, and no task
holds more than a chunk or a bucket.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a chunk; one document more may go over it.
CHUNK_BYTES = 8 << 20
#: Chunks (or merged groups of chunks) that one task merges at most.
FAN_IN = 64

CHUNK_SCHEMA = "chunk long, n_rows long, n_bytes long, payload binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one, set
    for the session, where the setting is absent in a local session, as in tests. Elsewhere it must
    be set: executors wouldn't see one another's folders."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sampledeck-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, and a lost
    executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack_arrow(batch: pa.RecordBatch | pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))
    with pa.ipc.new_stream(out, batch.schema, options=options) as writer:
        writer.write(batch)
    return out.getvalue().to_pybytes()


def unpack_arrow(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all().combine_chunks()


_ZSTD = pa.Codec("zstd", 4)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths and number types as one blob, compressed where that is shorter: some
    bytes of its own for each array, so small ones stay small."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = head + b"".join(a.tobytes() for a in arrays)
    packed = _ZSTD.compress(body, asbytes=True) if len(body) > 64 else body
    return struct.pack("<I", len(body)) + packed if len(packed) < len(body) else struct.pack("<I", 0) + body


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<I", blob)[0]
    body = _ZSTD.decompress(blob[4:], size, asbytes=True) if size else blob[4:]
    at, out = 1 + 6 * body[0], []
    for k in range(body[0]):
        kind, n = struct.unpack_from("<2sI", body, 1 + 6 * k)
        out.append(np.frombuffer(body, np.dtype("<" + kind.decode()), n, at))
        at += out[-1].nbytes
    return out


def chunked(docs: DataFrame, columns: list[str], name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The given columns of docs, the last of them the text, packed into chunks without a shuffle
    and written to the shared folder. Rows: CHUNK_SCHEMA; chunk is unique."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([len(table)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_arrow(table)], pa.binary())], ["chunk", "n_rows", "n_bytes", "payload"])

        for batch in batches:
            lengths = np.zeros(batch.num_rows + 1, np.int64)
            filled = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0)
            np.cumsum(np.asarray(filled, dtype=np.int64) + 1, out=lengths[1:])
            begin = 0
            while begin < batch.num_rows:
                end = int(np.searchsorted(lengths, lengths[begin] + chunk_bytes - size, "left"))
                end = max(begin + 1, min(end, batch.num_rows))
                held.append(batch.slice(begin, end - begin))
                size += int(lengths[end] - lengths[begin])
                begin = end
                if size >= chunk_bytes:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return written(docs.select(*columns).mapInArrow(pack, CHUNK_SCHEMA), name)


def grouped(df: DataFrame, function, schema: str, *keys: str) -> DataFrame:
    """applyInArrow over groups that are bounded by construction."""
    return df.groupBy(*keys).applyInArrow(function, schema)


def dense_number(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... in the given order. The rows are range-partitioned and
    sorted; only the row counts of the partitions meet in one place."""
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    return parts.join(running_total(counts, "_part", "_n", "_before"), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def running_total(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows (key, sum of value over smaller keys). counts has a row for each partition or file of
    a table, thousands of times fewer than the table has rows."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(name))


def text_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with that column as a string; other columns as they are."""
    return docs if docs.schema[column].dataType == T.StringType() else docs.withColumn(column, F.col(column).cast("string"))


def exchange(asked: DataFrame, combine, finish, reply) -> DataFrame:
    """Chunks' questions to buckets, answered: rows (bucket, chunk, blob) for rows CHUNK_BLOB of asked.

    A bucket's task merges its chunks' questions (combine of blobs), makes of all of them what answers
    need (finish) and answers each chunk (reply). Buckets grow in number with the corpus, so a task
    has as much to do however large that is. A chunk that has nothing to ask a bucket sends it no row,
    and a row takes a few bytes more than what it asks, so there are never more rows than questions
    and what is shuffled grows as the corpus does.
    """

    def run(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table.column("blob")]
        finished = finish(combine(blobs))
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "blob": pa.array([reply(finished, x) for x in blobs], pa.binary())})

    return grouped(asked, run, CHUNK_BLOB, "bucket")


CHUNK_BLOB = "bucket int, chunk long, blob binary"


def blob_rows(blobs: list[bytes | None], chunk: int) -> pa.RecordBatch:
    """A chunk's questions as rows of CHUNK_BLOB; None for a bucket that isn't asked."""
    there = [k for k, blob in enumerate(blobs) if blob is not None]
    return pa.record_batch([pa.array(there, pa.int32()), pa.array([chunk] * len(there), pa.int64()), pa.array([blobs[k] for k in there], pa.binary())], ["bucket", "chunk", "blob"])


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library hold but don't use. Python workers are
    kept from task to task and share their executor's memory, so what one operator needed for a
    batch would count against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
