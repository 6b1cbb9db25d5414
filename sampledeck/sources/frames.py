"""Series of frames, of which some are lost, late or marked invalid.

A frame has a short header that says when it was taken (second, and number within the second) and by
which thread, and samples of all channels of one polarization.  Files hold frames in about the order
of their arrival.  Tasks read the headers; a sample's number follows from its frame's, never from the
place in a file.  Frames that aren't there, and those marked invalid, have weight 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.plans.nodes import kept, new_folder
from sampledeck.plans.observation import Observation, Signal
from sampledeck.plans.weights import Weights
from sampledeck.sources import raw

#: Bytes of frames that a task reads at once, about.
CHUNK_BYTES = 8 << 20


def word_headers(heads: np.ndarray) -> dict[str, np.ndarray]:
    """second, frame, thread and invalid of headers of eight little-endian words a row (uint32). Fixed
    values: which bits of the first, second and fourth word hold them."""
    return {"second": heads[:, 0] & 0x3FFFFFFF, "frame": heads[:, 1] & 0xFFFFFF, "thread": heads[:, 3] >> 16 & 0x3FF, "invalid": heads[:, 0] >> 31}


@dataclass(frozen=True)
class Layout:
    """Frames of `size` bytes, the first `header` of which are read as uint32 words by `parse`, and
    per_second of them a second and thread. threads: which are the polarizations, in order."""

    size: int
    per_second: int
    threads: Sequence[int] = (0, 1)
    header: int = 32
    parse: Callable[[np.ndarray], dict[str, np.ndarray]] = word_headers
    encoding: str = "offset binary"

    def samples(self, obs: Observation) -> int:
        bits = obs.nchan * obs.ndim * obs.nbit
        if (self.size - self.header) * 8 % bits:
            raise ValueError("a frame must hold whole samples")
        return (self.size - self.header) * 8 // bits


def frame_header(second: int, frame: int, thread: int, size: int, invalid: bool = False) -> bytes:
    """A header that word_headers() reads."""
    words = [second | invalid << 31, frame, size // 8, thread << 16, 0, 0, 0, 0]
    return np.array(words, "<u4").tobytes()


def index(spark: SparkSession, urls: Sequence[str], layout: Layout) -> DataFrame:
    """url, at (a frame's first byte), second, frame, ipol, invalid of all whole frames of those files and
    the layout's threads. Neither sizes nor headers pass through the driver."""
    each = max(1, CHUNK_BYTES // layout.size)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [system.get_file_info(path).size // layout.size for system, path in map(raw.opened, batch.column(0).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], ["url", "frames"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, first, n in zip(*(batch.column(c).to_pylist() for c in ("url", "first", "n")), strict=True):
                system, path = raw.opened(url)
                with system.open_input_file(path) as file:
                    data = np.frombuffer(file.read_at(n * layout.size, first * layout.size), np.uint8).reshape(n, layout.size)
                found = layout.parse(np.ascontiguousarray(data[:, : layout.header]).view("<u4"))
                ipol = np.full(n, -1)
                for place, thread in enumerate(layout.threads):
                    ipol[found["thread"] == thread] = place
                columns = {"url": [url] * n, "at": (first + np.arange(n)) * layout.size, "second": found["second"].astype(np.int64), "frame": found["frame"].astype(np.int64), "ipol": ipol.astype(np.int32), "invalid": found["invalid"] != 0}
                yield pa.record_batch([pa.array(v) for v in columns.values()], list(columns))

    files = spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(max(len(urls), 1), 1024)).mapInArrow(sizes, "url string, frames long").filter("frames > 0")
    chunks = files.select("url", "frames", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(each))).alias("first"))
    chunks = chunks.select("url", "first", F.least(F.lit(each), F.col("frames") - F.col("first")).alias("n")).repartition("url", "first")
    return chunks.mapInArrow(heads, "url string, at long, second long, frame long, ipol int, invalid boolean").filter("ipol >= 0")


def read_frames(spark: SparkSession, urls: Sequence[str], layout: Layout, obs: Observation) -> Signal:
    """The signal of those files, with a weight a frame and polarization. It begins with the earliest
    frame that is valid and ends with the latest; obs says how samples are packed and what they are,
    and its start is that of second 0. Of frames that come twice the first in order of file and place
    counts; a frame whose number isn't less than per_second is no frame.
    """
    each, rate = layout.samples(obs), layout.per_second
    if obs.rate and abs(obs.rate - rate * each) > 1e-6 * obs.rate:
        raise ValueError("the sampling rate isn't that of the frames")
    number = F.col("second") * rate + F.col("frame")
    found = index(spark, urls, layout).filter((F.col("frame") < rate) & ~F.col("invalid")).groupBy(number.alias("number"), "ipol").agg(F.min(F.struct("url", "at")).alias("where"))
    found = kept(found.select("number", "ipol", "where.url", "where.at"), new_folder(spark, "frames"))
    first, last = found.agg(F.min("number"), F.max("number")).first()
    n = 0 if first is None else last - first + 1
    own = replace(obs, npol=1, ndat=each)
    file = raw.SampleFile("", own, 0, False, layout.encoding)
    values = ("re", "im") if obs.ndim == 2 else ("v",)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, at, place, ipol = batch.column("url").to_pylist(), *(np.asarray(batch.column(c)) for c in ("at", "place", "ipol"))
            begin = 0
            while begin < len(url):
                end = begin + 1  # frames that follow each other in a file are one read
                while end < len(url) and url[end] == url[begin] and at[end] == at[end - 1] + layout.size and (end - begin) * layout.size < CHUNK_BYTES:
                    end += 1
                system, path = raw.opened(url[begin])
                with system.open_input_file(path) as stream:
                    data = np.frombuffer(stream.read_at((end - begin) * layout.size, int(at[begin])), np.uint8).reshape(end - begin, layout.size)
                cube = raw.decoded(file, np.ascontiguousarray(data[:, layout.header :]).tobytes(), 0, each * (end - begin)).reshape(end - begin, each, obs.nchan, obs.ndim)
                idat = place[begin:end, None, None] * each + np.arange(each)[None, :, None]
                shape = cube.shape[:3]
                columns = [np.broadcast_to(idat, shape), np.broadcast_to(np.arange(obs.nchan, dtype=np.int32), shape), np.broadcast_to(ipol[begin:end, None, None], shape).astype(np.int32), *(cube[..., k] for k in range(obs.ndim))]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c).ravel()) for c in columns], ["idat", "ichan", "ipol", *values])
                begin = end

    placed = found.select((F.col("number") - F.lit(first or 0)).alias("place"), "ipol", "url", "at")
    data = placed.repartitionByRange("place").sortWithinPartitions("url", "at").mapInArrow(read, "idat long, ichan int, ipol int, " + ", ".join(f"{c} double" for c in values))
    out = replace(obs, npol=len(layout.threads), ndat=n * each, rate=float(rate * each))
    return Signal(data, out.later((first or 0) * each), Weights(missing(placed, n, rate, len(layout.threads)), each))


def missing(placed: DataFrame, n: int, rate: int, npol: int) -> DataFrame:
    """iweight, ipol, weight 0 of the frames 0 <= k < n that placed (place, ipol) doesn't have. Stretches
    of `rate` frames are counted first; only those that aren't whole are looked at one by one."""
    spark = placed.sparkSession
    counts = placed.groupBy(F.expr(f"place div {rate}").alias("stretch"), "ipol").agg(F.count("*").alias("there"))
    every = spark.range(-(-n // rate)).select(F.col("id").alias("stretch"), F.explode(F.array(*[F.lit(p) for p in range(npol)])).alias("ipol"))
    size = F.least(F.lit(rate), F.lit(n) - F.col("stretch") * rate)
    short = every.join(counts, ["stretch", "ipol"], "left").filter(F.coalesce("there", F.lit(0)) < size)
    frames = short.select("ipol", F.explode(F.sequence(F.col("stretch") * rate, F.col("stretch") * rate + size - 1)).alias("iweight"))
    return frames.join(placed.select(F.col("place").alias("iweight"), "ipol"), ["iweight", "ipol"], "left_anti").select("iweight", "ipol", F.lit(0).alias("weight"))
