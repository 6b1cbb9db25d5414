"""Files of packed samples as a Spark data source, and sinks that write them.

spark.read.format("samples") reads files with a text or a filterbank header (the first format whose
probe knows a file's first bytes; more can be registered).  Its partitions are byte ranges of whole
samples, so one file of any size is read by many tasks; a task decodes with numpy and hands on Arrow
batches.  Options: path, or the catalogue of
many files; start and total in seconds; samples (a partition's).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sampledeck.operators.digitize import levels
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources.headers import filterbank_header, filterbank_observation, inf_observation, observation, parse_filterbank, parse_text, text_header

if TYPE_CHECKING:
    from sampledeck.sources.catalogue import Placed

#: Samples of all channels that a partition holds, about.
PARTITION_VALUES = 1 << 22
#: Bytes of packets that are decoded at once, about.
PACKET_BYTES = 4 << 20


def opened(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


@dataclass(frozen=True)
class SampleFile:
    url: str
    obs: Observation
    offset: int
    lsb_first: bool
    encoding: str


def probe_filterbank(url: str, head: bytes, size: int) -> SampleFile | None:
    try:
        fields, length = parse_filterbank(head)
    except ValueError:
        return None
    return SampleFile(url, filterbank_observation(fields, size - length), length, True, "offset binary")


def probe_text(url: str, head: bytes, size: int) -> SampleFile | None:
    found = parse_text(head[:4096].decode("latin-1"))
    if "HDR_VERSION" not in found:
        return None
    length = int(found.get("HDR_SIZE", 4096))
    obs = observation(head[:length].decode("latin-1"))
    whole = obs.nsamples(size - length)
    encoding = "offset binary" if obs.detected or obs.nbit < 8 else "two's complement"
    return SampleFile(url, replace(obs, ndat=min(obs.ndat, whole) if obs.ndat else whole), length, False, found.get("ENCODING", encoding))


#: Tried in order; the first that knows the file reads it.
PROBES: list[Callable[[str, bytes, int], SampleFile | None]] = [probe_filterbank, probe_text]


def open_samples(url: str) -> SampleFile:
    system, path = opened(url)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as file:
        head = file.read(1 << 16)
    for probe in PROBES:
        if found := probe(url, head, size):
            return found
    raise ValueError(f"no format knows {url}")


def unpack(raw: np.ndarray, nbit: int, lsb_first: bool, encoding: str) -> np.ndarray:
    """Values of packed codes, in order."""
    if nbit == 32:
        return raw.view("<f4").astype(np.float64)
    if nbit == 16:
        codes = raw.view("<u2").astype(np.int64)
        return np.where(codes >= 32768, codes - 65536, codes) + 0.5 if encoding == "two's complement" else codes - 32767.5
    if nbit < 8:
        per = 8 // nbit
        shifts = np.arange(per) * nbit if lsb_first else (per - 1 - np.arange(per)) * nbit
        raw = ((raw[:, None] >> shifts) & ((1 << nbit) - 1)).ravel()
    return np.array(levels(nbit, encoding))[raw]


def to_text(file: SampleFile) -> str:
    """A file's header as text, for options and tables."""
    return json.dumps(asdict(file))


def from_text(text: str) -> SampleFile:
    found = json.loads(text)
    return SampleFile(**{**found, "obs": Observation(**{**found["obs"], "history": tuple(found["obs"]["history"])})})


def decoded(file: SampleFile, raw: bytes, early: int, n: int) -> np.ndarray:
    """Values (sample, channel, polarization, part) of n packed samples, the first of them `early`
    samples after where raw begins."""
    obs = file.obs
    width = obs.nchan * obs.npol * obs.ndim
    values = unpack(np.frombuffer(raw, np.uint8), obs.nbit, file.lsb_first, file.encoding)[early * width : (early + n) * width]
    # filterbanks run polarization, channel; raw voltages run channel, polarization, re and im
    return values.reshape(n, obs.npol, obs.nchan, obs.ndim).transpose(0, 2, 1, 3) if file.lsb_first else values.reshape(n, obs.nchan, obs.npol, obs.ndim)


@dataclass
class Range(InputPartition):
    """n samples of a file from `first` on, the series' samples from `at` on; the file's samples begin
    after `offset` bytes."""

    url: str
    at: int
    first: int
    n: int
    offset: int

    def read(self, file: SampleFile) -> tuple[bytes, int]:
        """(the bytes that hold them, how many samples before them those begin with)."""
        obs = file.obs
        bits = obs.nchan * obs.npol * obs.ndim * obs.nbit
        early = self.first % (8 // int(np.gcd(8, bits)))  # a sample can begin within a byte; one of so many begins with one
        system, path = opened(self.url)
        with system.open_input_file(path) as stream:
            return stream.read_at(-(-(early + self.n) * bits // 8), self.offset + (self.first - early) * bits // 8), early


def wanted(ndat: int, rate: float, start: float = 0.0, total: float | None = None) -> tuple[int, int]:
    """The samples (first, one past the last) of a series of ndat that those seconds ask for."""
    first = min(ndat, int(start * rate + 0.5))
    return first, ndat if total is None else min(ndat, first + int(total * rate + 0.5))


def files_of(options: dict) -> Placed:
    """The files that options name: a catalogue's, or one path alone."""
    from sampledeck.sources import catalogue

    if "catalogue" in options:
        return catalogue.placed(options["catalogue"])
    file = open_samples(options["path"].strip())
    return catalogue.Placed(file, [file.url], np.zeros(1, np.int64), np.array([file.obs.ndat]), np.array([file.offset]))


def long_rows(file: SampleFile, part: Range) -> Iterator[pa.RecordBatch]:
    obs = file.obs
    cube = decoded(file, *part.read(file), part.n)
    n = part.n * obs.nchan * obs.npol
    index = np.arange(n)
    columns = {"idat": part.at + index // (obs.nchan * obs.npol), "ichan": (index // obs.npol % obs.nchan).astype(np.int32), "ipol": (index % obs.npol).astype(np.int32)}
    flat = cube.reshape(n, obs.ndim)
    columns |= {"v": flat[:, 0]} if obs.ndim == 1 else {"re": flat[:, 0], "im": flat[:, 1]}
    yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in columns.values()], list(columns))


class SampleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.options = files_of(options), options

    def partitions(self) -> list[Range]:
        files, obs = self.files, self.files.file.obs
        total = self.options.get("total")
        first, last = wanted(files.ndat, obs.rate, float(self.options.get("start", 0)), None if total is None else float(total))
        step = int(self.options.get("samples", 0)) or max(1, PARTITION_VALUES // (obs.nchan * obs.npol * obs.ndim))
        out = [replace(x, at=x.at - first + a, first=x.first + a, n=min(step, x.n - a)) for x in files.parts(first, last) for a in range(0, x.n, step)]
        return out or [Range(files.urls[0], 0, 0, 0, int(files.offset[0]))]  # a source has a partition at least

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return long_rows(self.files.file, part)


class LiveReader(DataSourceStreamReader):
    """One file that grows as samples are recorded: an offset is a sample's number, and a batch is
    what whole samples came since, in byte ranges."""

    def __init__(self, options: dict) -> None:
        self.file, self.options = open_samples(options["path"].strip()), options

    def recorded(self) -> int:
        """Whole samples that are there now."""
        system, path = opened(self.file.url)
        return self.file.obs.nsamples(system.get_file_info(path).size - self.file.offset)

    def initialOffset(self) -> dict:
        return {"sample": 0}

    def latestOffset(self) -> dict:
        return {"sample": self.recorded()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        obs = self.file.obs
        step = int(self.options.get("samples", 0)) or max(1, PARTITION_VALUES // (obs.nchan * obs.npol * obs.ndim))
        return [Range(self.file.url, a, a, min(step, end["sample"] - a), self.file.offset) for a in range(start["sample"], end["sample"], step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return long_rows(self.file, part)

    def commit(self, end: dict) -> None:
        pass


def live_samples(spark: SparkSession, url: str, **options) -> DataFrame:
    """A stream of the samples of a file that grows."""
    spark.dataSource.register(SampleSource)
    return spark.readStream.format("samples").options(**{k: str(v) for k, v in options.items()}).load(url)


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "idat long, ichan int, ipol int, " + ("v double" if files_of(self.options).file.obs.ndim == 1 else "re double, im double")

    def reader(self, schema) -> SampleReader:
        return SampleReader(dict(self.options))

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(dict(self.options))


def read_samples(spark: SparkSession, urls: list[str], force: bool = False, **options) -> Signal:
    """One signal from files in order of their start; their headers must combine and follow on each
    other. With force there may be gaps: samples that no file holds have no rows, and those after them
    keep their numbers. start and total (seconds of the series) select samples, whichever files they
    are in; the header begins with the first of them, whose idat is 0."""
    from sampledeck.sources.catalogue import catalogue

    series = catalogue(spark, urls, force)
    spark.dataSource.register(SampleSource)
    reader = spark.read.format("samples").options(catalogue=series.url, **{k: str(v) for k, v in options.items()})
    obs = series.obs
    first, last = wanted(obs.ndat, obs.rate, float(options.get("start", 0)), float(options["total"]) if "total" in options else None)
    return Signal(reader.load(), replace(obs.later(first) if obs.rate else obs, ndat=last - first))


def pack(codes: np.ndarray, nbit: int, lsb_first: bool) -> bytes:
    if nbit == 32:
        return codes.astype("<f4").tobytes()
    if nbit >= 8:
        return codes.astype({8: "u1", 16: "<u2"}[nbit]).tobytes()
    per = 8 // nbit
    codes = np.concatenate([codes, np.zeros(-len(codes) % per, codes.dtype)]).reshape(-1, per).astype(np.int64)
    shifts = np.arange(per) * nbit if lsb_first else (per - 1 - np.arange(per)) * nbit
    return (codes << shifts).sum(1).astype(np.uint8).tobytes()


def write_filterbank(codes: DataFrame, obs: Observation, folder: str, samples_per_file: int) -> DataFrame:
    """Writes code (idat, ichan, ipol) of digitized data as filterbank files of that many samples, but
    for the last, in folder, a URL: all obs.ndat of them, whichever have rows; missing ones are 0.
    Returns file_no, url, first, n, in which a row a file stands. A file's samples meet in one task,
    so their number bounds it."""

    def write(number: int, table: pa.Table, first: int, n: int) -> str:
        idat, ichan, ipol = (np.asarray(table.column(c)) for c in ("idat", "ichan", "ipol"))
        cube = np.zeros((n, obs.npol, obs.nchan))
        cube[idat - first, ipol, ichan] = np.asarray(table.column("code"))
        return write_file(f"{folder}/{number:08d}-{uuid.uuid4().hex}.fil", filterbank_header(replace(obs.later(first), ndat=n)) + pack(cube.ravel(), obs.nbit, True))

    return write_series(codes.select("idat", "ichan", "ipol", "code"), obs.ndat, samples_per_file, write)


def write_file(url: str, data: bytes) -> str:
    system, path = opened(url)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return url


def write_series(rows: DataFrame, ndat: int, samples_per_file: int, write: Callable[[int, pa.Table, int, int], str]) -> DataFrame:
    """file_no, url, first, n of the files that write(file_no, its rows, first, n) makes of ndat samples:
    of those without rows, too."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("file_no")[0].as_py()
        first = number * samples_per_file
        n = min(samples_per_file, ndat - first)
        url = write(number, table.filter(table.column("idat").is_valid()), first, n)
        return pa.table({"file_no": pa.array([number], pa.int64()), "url": [url], "first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int64())})

    number = F.expr(f"idat div {int(samples_per_file)}")
    there = rows.filter((F.col("idat") >= 0) & (F.col("idat") < ndat)).withColumn("file_no", number)
    every = rows.sparkSession.range(-(-ndat // samples_per_file)).select(F.col("id").alias("file_no"))
    return there.unionByName(every, allowMissingColumns=True).groupBy("file_no").applyInArrow(run, "file_no long, url string, first long, n long")


def write_raw(values: np.ndarray, obs: Observation, url: str) -> None:
    """A small file with a text header: values (samples, channels, polarizations, ndim) as codes. For
    fixtures and hand-made data; it passes through the driver."""
    system, path = opened(url)
    with system.open_output_stream(path, compression=None) as out:
        out.write(text_header(obs) + pack(values.ravel(), obs.nbit, False))


def gaps(files: DataFrame) -> DataFrame:
    """files (file_no or any id, start_us, ndat, rate) in order of start, with gap_us to the end of
    the one before and contiguous, whether it is under 0.9 of a sample. One row a file."""
    from pyspark.sql import Window

    w = Window.orderBy("start_us")
    end = F.col("start_us") + F.col("ndat") / F.col("rate") * 1e6
    gap = F.col("start_us") - F.lag(end).over(w)
    return files.withColumn("gap_us", gap).withColumn("contiguous", F.abs("gap_us") < F.lit(0.9e6) / F.col("rate"))


def demultiplex(packets: DataFrame, files: int, samples: int) -> DataFrame:
    """Packets (file_no, packet, values: an array of `samples` values, and any keys) dealt round-robin
    over files, as one series for each of the keys: the keys, idat, v."""
    keys = [c for c in packets.columns if c not in ("file_no", "packet", "values")]
    rows = packets.select(*keys, "file_no", "packet", F.posexplode("values").alias("k", "v"))
    return rows.select(*keys, ((F.col("packet") * files + F.col("file_no")) * samples + F.col("k")).alias("idat"), "v")


def read_packets(spark: SparkSession, n: int, size: int, place: Callable[[int], tuple[str, int]], obs: Observation, lsb_first: bool, encoding: str) -> Signal:
    """One signal of n packets of `size` bytes; place(k) is the URL and the byte at which packet k
    begins. A row of a range is a packet, read where it is decoded; nothing is shuffled."""
    width = obs.nchan * obs.npol * obs.ndim
    if size <= 0 or size * 8 % (width * obs.nbit):
        raise ValueError("a packet must hold whole samples")
    each = size * 8 // (width * obs.nbit)

    file, together = SampleFile("", obs, 0, lsb_first, encoding), max(1, PACKET_BYTES // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = {}
        try:
            for batch in batches:
                packets = batch.column("id").to_pylist()
                for k in range(0, len(packets), together):
                    part, data = packets[k : k + together], []
                    for packet in part:
                        url, at = place(packet)
                        if url not in streams:
                            system, path = opened(url)
                            streams[url] = system.open_input_file(path)
                        data.append(streams[url].read_at(size, at))
                    cube = decoded(file, b"".join(data), 0, each * len(part)).reshape(-1, obs.ndim)
                    index = np.arange(len(cube))
                    idat = np.repeat(np.array(part) * each, each * obs.nchan * obs.npol) + index // (obs.nchan * obs.npol) % each
                    columns = {"idat": idat, "ichan": (index // obs.npol % obs.nchan).astype(np.int32), "ipol": (index % obs.npol).astype(np.int32)}
                    columns |= {"v": cube[:, 0]} if obs.ndim == 1 else {"re": cube[:, 0], "im": cube[:, 1]}
                    yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in columns.values()], list(columns))
        finally:
            for stream in streams.values():
                stream.close()

    schema = "idat long, ichan int, ipol int, " + ("v double" if obs.ndim == 1 else "re double, im double")
    return Signal(spark.range(n).mapInArrow(run, schema), replace(obs, ndat=n * each))


def read_multiplexed(spark: SparkSession, urls: list[str], size: int, obs: Observation, lsb_first: bool = False, encoding: str = "offset binary", offset: int = 0) -> Signal:
    """One signal of files that hold its packets of `size` bytes in turn, each file after `offset`
    bytes of header: packet k is number k div files in file k mod files. It ends before the first
    packet that isn't whole."""
    whole = []
    for url in urls:
        system, path = opened(url)
        whole.append(max(0, system.get_file_info(path).size - offset) // size)
    n = min(k * len(urls) + place for place, k in enumerate(whole))
    return read_packets(spark, n, size, lambda k: (urls[k % len(urls)], offset + k // len(urls) * size), obs, lsb_first, encoding)


def read_blocks(spark: SparkSession, url: str, size: int, obs: Observation, header: int = 0, tail: int = 0, offset: int = 0, lsb_first: bool = False, encoding: str = "offset binary") -> Signal:
    """One signal of a file of blocks of `size` bytes, of which the first `header` and the last `tail`
    aren't data, after `offset` bytes. A last block that isn't whole is left out."""
    system, path = opened(url)
    n = max(0, system.get_file_info(path).size - offset) // size
    return read_packets(spark, n, size - header - tail, lambda k: (url, offset + k * size + header), obs, lsb_first, encoding)


def read_series(spark: SparkSession, inf_url: str) -> Signal:
    """The float samples of the .dat file beside an .inf file."""
    system, path = opened(inf_url)
    with system.open_input_file(path) as file:
        obs = inf_observation(file.read().decode("latin-1"))
    url = inf_url.removesuffix(".inf") + ".dat"
    system, path = opened(url)
    ndat = min(obs.ndat, system.get_file_info(path).size // 4)
    file = SampleFile(url, replace(obs, ndat=ndat), 0, False, "float")
    each = 1 << 16
    packets = spark.range(-(-ndat // each)).select((F.col("id") * each).alias("first"), F.least(F.lit(each), F.lit(ndat) - F.col("id") * each).alias("n"))
    return read_planned(spark, file, packets)


def byte_plan(spark: SparkSession, obs: Observation, header: int, samples: int, wanted: Sequence[int] | None = None) -> DataFrame:
    """Where the sub-integrations of that many samples lie in a file with `header` bytes before its
    data: subint, first, n, begin, end (bytes). wanted: these alone, for files that are cut down."""
    width = obs.nchan * obs.npol * obs.ndim * obs.nbit
    rows = spark.range(-(-obs.ndat // samples)) if wanted is None else spark.createDataFrame([(int(k),) for k in wanted], "id long")
    first = F.col("id") * samples
    n = F.least(F.lit(samples), F.lit(obs.ndat) - first)
    byte = lambda sample: (F.lit(header) + F.expr(f"({sample}) * {width} div 8")).cast("long")
    rows = rows.select(F.col("id").alias("subint"), first.alias("first"), n.cast("long").alias("n")).filter("n > 0")
    return rows.select("subint", "first", "n", byte("first").alias("begin"), byte("first + n").alias("end"))


def read_planned(spark: SparkSession, file: str | SampleFile, plan: DataFrame) -> Signal:
    """Of a file, by its URL or header, the sub-integrations of a byte_plan() alone (first, n), by their
    byte ranges, with their own sample numbers. Tasks don't read the header again."""
    file = open_samples(file) if isinstance(file, str) else file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in zip(batch.column("first").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield from long_rows(file, Range(file.url, first, first, n, file.offset))

    schema = "idat long, ichan int, ipol int, " + ("v double" if file.obs.ndim == 1 else "re double, im double")
    return Signal(plan.select("first", "n").mapInArrow(run, schema), file.obs)


def synthetic(spark: SparkSession, obs: Observation, partitions: int | None = None) -> Signal:
    """Noise of zero mean and unit variance made where it is needed, the same for any partitioning:
    for benchmarks and tests."""
    n = obs.nchan * obs.npol
    rows = spark.range(0, obs.ndat * n, 1, partitions) if partitions else spark.range(obs.ndat * n)
    u, w = ((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40)) + 0.5) / (1 << 40) for k in (1, 2))
    radius, turn = F.sqrt(-2 * F.log(u)), 2 * np.pi * w
    base = [F.expr(f"id div {n}").alias("idat"), (F.expr(f"id div {obs.npol}") % obs.nchan).cast("int").alias("ichan"), (F.col("id") % obs.npol).cast("int").alias("ipol")]
    values = [(radius * F.cos(turn)).alias("re"), (radius * F.sin(turn)).alias("im")] if obs.state == "Analytic" else [(radius * F.cos(turn)).alias("v")]
    return Signal(rows.select(*base, *values), obs)
