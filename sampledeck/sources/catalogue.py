"""Which file of a series holds which samples.

Tasks read the files' headers; what they say (a row a file) is checked and kept as one small file in
the shared folder, where readers look up by bisection which files the samples that they want are in.
A file's place in the series follows from its start, so where a file is missing, or ends early, its
samples are missing and all others keep their numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from sampledeck.plans.nodes import new_folder
from sampledeck.plans.observation import Observation
from sampledeck.sources import raw

#: Files whose headers the driver reads itself; more are read by tasks.
FEW_FILES = 16


@dataclass(frozen=True)
class Placed:
    """Files in order of their first sample `at` of the series: n samples each, after `offset` bytes."""

    file: raw.SampleFile
    urls: Sequence[str]
    at: np.ndarray
    n: np.ndarray
    offset: np.ndarray

    @property
    def ndat(self) -> int:
        return int((self.at + self.n).max(initial=0))

    def parts(self, first: int, last: int) -> Iterator[raw.Range]:
        """The ranges of files that hold the samples first <= k < last."""
        for k in range(int(np.searchsorted(self.at, first, "right")) - 1, int(np.searchsorted(self.at, last, "left"))):
            if k >= 0:
                low, high = max(first, int(self.at[k])), min(last, int(self.at[k] + self.n[k]))
                if low < high:
                    yield raw.Range(self.urls[k], low, low - int(self.at[k]), high - low, int(self.offset[k]))

    def write(self, url: str) -> None:
        table = pa.table({"url": list(self.urls), "at": self.at, "n": self.n, "offset": self.offset})
        table = table.replace_schema_metadata({"file": raw.to_text(self.file)})
        system, path = raw.opened(url)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out, pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)


@functools.lru_cache(maxsize=4)
def placed(url: str) -> Placed:
    """What write() wrote; a worker keeps the last few."""
    system, path = raw.opened(url)
    with system.open_input_file(path) as file:
        table = pa.ipc.open_stream(file).read_all()
    columns = [table.column(c).to_numpy() for c in ("at", "n", "offset")]
    return Placed(raw.from_text(table.schema.metadata[b"file"].decode()), table.column("url").to_pylist(), *columns)


def layout(file: raw.SampleFile) -> str:
    """What files of one series have in common, as text."""
    obs = {k: v for k, v in asdict(file.obs).items() if k not in ("ndat", "start_us", "start_fraction", "identifier", "history", "scale")}
    return repr((sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in obs.items()), file.lsb_first, file.encoding))


def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([raw.to_text(raw.open_samples(u)) for u in batch.column(0).to_pylist()])], ["url", "file"])


def placed_files(spark: SparkSession, urls: Sequence[str], force: bool = False) -> Placed:
    """The files of a series in order of their start. Their headers must combine, and each must begin
    where the one before ends, to within 0.9 of a sample; with force there may be gaps, and files that
    overlap or have no sampling rate follow each other in that order."""
    if len(urls) <= FEW_FILES:
        files = [raw.open_samples(u) for u in urls]
    else:
        rows = spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(len(urls), 1024)).mapInArrow(headers, "url string, file string")
        files = [raw.from_text(r["file"]) for r in rows.collect()]  # as many rows as the caller has URLs
    files.sort(key=lambda f: (f.obs.start_us, f.obs.start_fraction, f.url))
    odd = next((f for f in files if layout(f) != layout(files[0])), None)
    if odd and not force:
        raise ValueError(f"{odd.url} doesn't follow on {files[0].url}: another header")
    first = files[0].obs
    n = np.array([f.obs.ndat for f in files], np.int64)
    since = np.array([f.obs.start_us - first.start_us + f.obs.start_fraction - first.start_fraction for f in files])
    at = since * 1e-6 * first.rate
    apart = at[1:] - at[:-1] - n[:-1]
    wrong = np.flatnonzero(abs(apart) >= 0.9)
    if len(wrong) and not force:
        raise ValueError(f"{files[wrong[0] + 1].url} doesn't follow on {files[wrong[0]].url}")
    if not first.rate or (apart <= -0.9).any():
        at = np.append(0, np.cumsum(n)[:-1]).astype(float)
    return Placed(files[0], [f.url for f in files], np.rint(at).astype(np.int64), n, np.array([f.offset for f in files], np.int64))


@dataclass(frozen=True)
class Catalogue:
    """url: where Placed is written; obs: the series' header, of samples to the end of the last file."""

    url: str
    obs: Observation
    files: Placed


def catalogue(spark: SparkSession, urls: Sequence[str], force: bool = False) -> Catalogue:
    """As placed_files(), written to the shared folder."""
    files = placed_files(spark, urls, force)
    url = f"{new_folder(spark, 'catalogue')}/files"
    files.write(url)
    return Catalogue(url, replace(files.file.obs, ndat=files.ndat), files)
