"""Chains of kernels on arrays, from the source to profiles without a shuffle of samples.

A piece is a stretch of the series that a chain gives, with all its channels and polarizations.  What
each stage needs for its output follows from the stage's shape (transforms of nfft samples, one each
step, that leave `kept` of them), so the samples that a piece needs of the source are known before
anything is read: pieces read their stretch, overlapping their neighbours, straight from the files by
byte ranges, or gather it from a table's rows.  In a task the stages work on numpy arrays (channel,
polarization, sample) one after another; polarizations are side by side.  Weights travel as an array
of what is good: samples that no file holds aren't, excision adds to them, and a transform with a
sample that isn't good gives none that is.  Folds add up each piece's bins before they leave the task,
so one exchange of bins is all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.functions.numeric import dispersion_delay
from sampledeck.operators import fold as folds
from sampledeck.operators.kernels import convolved_header, dedispersion_responses, shifted, spectrum
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources import raw
from sampledeck.sources.catalogue import catalogue, placed

#: Values of the source that a piece holds, about.
PIECE_VALUES = 1 << 21
#: Partitions of a chain's pieces at most.
MOST_PARTITIONS = 1 << 17


@dataclass(frozen=True)
class Stage:
    """run(x, good) with x[channel, polarization, transform, nfft] and good[channel, polarization,
    transform] gives such arrays of `kept` samples a transform, good like x's first three. A stage
    of samples (nfft = step = kept = 1) gets and gives [channel, polarization, sample]."""

    name: str
    run: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    obs: Observation
    nfft: int = 1
    step: int = 1
    kept: int = 1

    def needs(self, low: int, high: int) -> tuple[int, int]:
        """The samples it takes to give low <= k < high, and maybe others around them."""
        return low // self.kept * self.step, (-(-high // self.kept) - 1) * self.step + self.nfft

    def apply(self, first: int, x: np.ndarray, good: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The same for samples from number `first` on: (number of the first given, values, good)."""
        if self.nfft == self.step == self.kept == 1:
            return first, *self.run(x, good)
        begin = -(-first // self.step)
        at = begin * self.step - first
        parts = max(0, (x.shape[2] - at - self.nfft) // self.step + 1)
        if not parts:
            empty = np.zeros((self.obs.nchan, self.obs.npol, 0))
            return begin * self.kept, empty.astype(complex if self.obs.state == "Analytic" else float), empty.astype(bool)
        view = lambda a: np.lib.stride_tricks.sliding_window_view(a[:, :, at:], self.nfft, axis=2)[:, :, :: self.step][:, :, :parts]
        out, fine = self.run(view(x), view(good).all(3))
        out = out.reshape(*out.shape[:2], -1)
        return begin * self.kept, out, fine if fine.shape[2] == out.shape[2] else np.repeat(fine, self.kept, axis=2)


@dataclass(frozen=True)
class Chain:
    """A source's samples and the stages that they go through."""

    source: Source
    stages: tuple[Stage, ...] = ()

    @property
    def obs(self) -> Observation:
        history = (*self.source.obs.history, *(s.name for s in self.stages))
        return replace(self.stages[-1].obs if self.stages else self.source.obs, history=history)

    def then(self, maker: Callable[..., Stage], *args, **kwargs) -> Chain:
        return Chain(self.source, (*self.stages, maker(self.obs, *args, **kwargs)))

    def samples(self) -> int:
        """Samples of the result that make a piece: about PIECE_VALUES of the source, and at least as
        many as the longest transform takes anew."""
        obs, out = self.source.obs, 1.0
        for s in self.stages:
            out *= s.kept / s.step
        least = 1.0
        for s in self.stages:
            least = max(least, (s.nfft - s.step) * 4) * s.kept / s.step
        return max(1, math.ceil(max(PIECE_VALUES / (obs.nchan * obs.npol * obs.ndim) * out, least)))

    def pieces(self, size: int = 0) -> DataFrame:
        size = size or self.samples()
        return self.source.frame([(s.nfft, s.step, s.kept) for s in self.stages], -(-self.obs.ndat // size), size, self.obs.ndat)

    def arrays(self, schema: str, finish: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], size: int = 0) -> DataFrame:
        """finish(first, x, good) of every piece: its samples from number first on, no other's."""
        stages, decode = self.stages, self.source.decode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    low, high, first, n = (batch.column(c)[row].as_py() for c in ("low", "high", "first", "n"))
                    x, good = decode(batch.column("parts")[row], n)
                    for s in stages:
                        first, x, good = s.apply(first, x, good)
                    yield finish(low, x[:, :, low - first : high - first], good[:, :, low - first : high - first])

        return self.pieces(size).mapInArrow(run, schema)

    def rows(self, size: int = 0) -> Signal:
        """The good samples in long form."""
        values = ("re", "im") if self.obs.state == "Analytic" else ("v",)

        def finish(first: int, x: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
            ichan, ipol, at = np.nonzero(good)
            v = x[ichan, ipol, at]
            columns = [at + first, ichan.astype(np.int32), ipol.astype(np.int32), *((v.real, v.imag) if len(values) == 2 else (v.real,))]
            return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], ["idat", "ichan", "ipol", *values])

        return Signal(self.arrays("idat long, ichan int, ipol int, " + ", ".join(f"{c} double" for c in values), finish, size), self.obs)

    def fold(self, period_us: int, nbin: int, epoch_us: int | None = None, subint_us: int = 0, size: int = 0) -> DataFrame:
        """fold_by() a constant period, in sub-integrations of that length or none."""
        epoch = self.obs.start_us if epoch_us is None else epoch_us

        def binning(us: np.ndarray, idat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            since = us - epoch
            return since // subint_us if subint_us else np.zeros(len(us), np.int64), since % period_us * nbin // period_us

        return self.fold_by(binning, nbin, size)

    def fold_by(self, binning: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], nbin: int, size: int = 0) -> DataFrame:
        """subint, ichan, ipol, ibin, sum, hits of detected samples; binning(microseconds, sample numbers)
        gives each one's sub-integration and bin, a negative bin if it isn't folded. Each piece adds
        up its own bins."""
        obs = self.obs
        if not obs.detected:
            raise ValueError("voltages are detected before they are folded")

        def finish(first: int, x: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
            idat = first + np.arange(x.shape[2])
            subint, ibin = binning(obs.start_us + np.floor((idat + 0.5) * (1e6 / obs.rate)).astype(np.int64), idat)
            x, good, subint, ibin = (a[..., ibin >= 0] for a in (x, good, subint, ibin))
            low = int(subint.min(initial=0)) if len(subint) else 0
            key = (subint - low) * nbin + ibin
            size = int(key.max(initial=-1)) + 1
            out: list[list[np.ndarray]] = [[], [], [], []]
            for c in range(x.shape[0]):
                for p in range(x.shape[1]):
                    hits = np.bincount(key, good[c, p], size)
                    total = np.bincount(key, np.where(good[c, p], x[c, p], 0.0), size)
                    there = np.flatnonzero(hits)
                    for column, values in zip(out, (there, np.full(len(there), c * x.shape[1] + p), total[there], hits[there]), strict=True):
                        column.append(values)
            key, cell, total, hits = (np.concatenate([np.zeros(0), *c]) for c in out)
            key, cell = key.astype(np.int64), cell.astype(np.int64)
            columns = [key // nbin + low, (cell // x.shape[1]).astype(np.int32), (cell % x.shape[1]).astype(np.int32), (key % nbin).astype(np.int32), total, hits.astype(np.int64)]
            return pa.record_batch([pa.array(c) for c in columns], ["subint", "ichan", "ipol", "ibin", "sum", "hits"])

        keys = ["subint", "ichan", "ipol", "ibin"]
        return folds.combine(self.arrays("subint long, ichan int, ipol int, ibin int, sum double, hits long", finish, size), *keys)


# Sources --------------------------------------------------------------------------------------

PARTS = "piece long, low long, high long, first long, n long, parts array<struct<at: long, n: long, early: long, raw: binary>>"


@dataclass(frozen=True)
class Source:
    """frame(shapes, pieces, samples, ndat) gives rows (PARTS) for so many pieces of so many of the ndat
    samples that stages of those shapes give: a piece's own samples low <= k < high, the n samples
    from first on that it needs, and the parts that hold them. decode(parts, n) makes arrays of them."""

    obs: Observation
    frame: Callable[[list[tuple[int, int, int]], int, int, int], DataFrame]
    decode: Callable[[pa.ListScalar, int], tuple[np.ndarray, np.ndarray]]


def stretch(shapes: Sequence[tuple[int, int, int]], low: int, high: int) -> tuple[int, int]:
    """The source's samples that stages of those shapes (nfft, step, kept) need to give low <= k < high."""
    for nfft, step, kept in reversed(shapes):
        low, high = low // kept * step, (-(-high // kept) - 1) * step + nfft
    return low, high


def from_files(spark: SparkSession, urls: list[str], force: bool = False) -> Chain:
    """The chain of a series of files. Each piece reads the bytes that it needs from whichever files hold
    them; what no file holds isn't good. With force there may be gaps between files."""
    series = catalogue(spark, urls, force)
    file, url = series.files.file, series.url

    def frame(shapes: list[tuple[int, int, int]], pieces: int, size: int, ndat: int) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in batch.column("id").to_pylist():
                    low, high = piece * size, min((piece + 1) * size, ndat)
                    first, last = stretch(shapes, low, high)
                    parts = []
                    for part in placed(url).parts(first, last):
                        data, early = part.read(file)
                        parts.append({"at": part.at - first, "n": part.n, "early": early, "raw": data})
                    if parts:
                        yield pa.RecordBatch.from_pylist([{"piece": piece, "low": low, "high": high, "first": first, "n": last - first, "parts": parts}], parts_schema())

        return spark.range(0, pieces, 1, max(1, min(pieces, MOST_PARTITIONS))).mapInArrow(read, PARTS)

    return Chain(Source(series.obs, frame, decoder(file)))


def parts_schema() -> pa.Schema:
    part = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("early", pa.int64()), ("raw", pa.binary())])
    return pa.schema([(c, pa.int64()) for c in ("piece", "low", "high", "first", "n")] + [("parts", pa.list_(part))])


def decoder(file: raw.SampleFile) -> Callable[[pa.ListScalar, int], tuple[np.ndarray, np.ndarray]]:
    obs = file.obs

    def decode(parts: pa.ListScalar, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((obs.nchan, obs.npol, n), complex if obs.ndim == 2 else float)
        good = np.zeros(x.shape, bool)
        for part in parts:
            at, length = part["at"].as_py(), part["n"].as_py()
            cube = raw.decoded(file, part["raw"].as_buffer(), part["early"].as_py(), length)
            values = cube[..., 0] + 1j * cube[..., 1] if obs.ndim == 2 else cube[..., 0]
            x[:, :, at : at + length], good[:, :, at : at + length] = values.transpose(1, 2, 0), True
        return x, good

    return decode


def from_rows(rows: DataFrame, obs: Observation) -> Chain:
    """The chain of a table with a row a sample: idat and values, its floats by channel, polarization
    and, if complex, part. Rows go to the pieces that need them as arrays, in one exchange; samples
    that aren't there, or whose array isn't whole, aren't good."""
    width = obs.nchan * obs.npol * obs.ndim
    file = raw.SampleFile("", replace(obs, nbit=32), 0, False, "float")

    def frame(shapes: list[tuple[int, int, int]], pieces: int, size: int, ndat: int) -> DataFrame:
        def piece_of(idat: Column, first: bool) -> Column:
            """The least or greatest piece that needs the sample."""
            at = idat
            for nfft, step, kept in shapes:
                low = F.ceil((at - (nfft - 1)) / step) * kept
                at = low if first else F.floor(at / step) * kept + (kept - 1)
            return F.floor(at / size).cast("long")

        low, high = F.greatest(F.lit(0), piece_of(F.col("idat"), True)), F.least(F.lit(pieces - 1), piece_of(F.col("idat"), False))
        dealt = rows.select("idat", F.col("values").cast("array<float>").alias("values")).filter(f"size(values) = {width}").withColumns({"low": low, "high": high}).filter("low <= high").select("idat", "values", F.explode(F.sequence("low", "high")).alias("piece"))

        def gather(table: pa.Table) -> pa.Table:
            piece = table.column("piece")[0].as_py()
            low, high = piece * size, min((piece + 1) * size, ndat)
            first, last = stretch(shapes, low, high)
            idat = np.asarray(table.column("idat"))
            order = np.argsort(idat, kind="stable")
            order = order[(idat[order] >= first) & (idat[order] < last)]
            values = np.asarray(table.column("values").combine_chunks().flatten()).reshape(-1, width)[order]
            idat = idat[order]
            cuts = np.flatnonzero(np.diff(idat, prepend=-2) != 1)
            ends = np.append(cuts[1:], len(idat))
            parts = [{"at": int(idat[a]) - first, "n": int(b - a), "early": 0, "raw": values[a:b].astype("<f4").tobytes()} for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            return pa.Table.from_pylist([{"piece": piece, "low": low, "high": high, "first": first, "n": last - first, "parts": parts}], parts_schema())

        return dealt.groupBy("piece").applyInArrow(gather, PARTS)

    return Chain(Source(obs, frame, decoder(file)))


# Stages ---------------------------------------------------------------------------------------


def filterbank(obs: Observation, nchan: int, freq_res: int = 1, response: np.ndarray | None = None, wings: tuple[int, int] = (0, 0)) -> Stage:
    """As kernels.filterbank."""
    real = obs.state == "Nyquist"
    kept = freq_res - sum(wings)
    nfft, step = nchan * freq_res * (2 if real else 1), nchan * kept * (2 if real else 1)

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bands = shifted(x) if response is None else shifted(x) * response
        z = bands.reshape(*x.shape[:3], nchan, freq_res)
        if freq_res > 1:
            z = np.fft.ifft(np.fft.ifftshift(z, axes=4), axis=4)[..., wings[0] : freq_res - wings[1]]
        z = np.moveaxis(z, 3, 1)  # channel, band, polarization, transform, sample
        return z.reshape(x.shape[0] * nchan, *z.shape[2:]), np.repeat(good, nchan, axis=0)

    parts = (obs.ndat - nfft) // step + 1 if obs.ndat >= nfft else 0
    out = replace(obs, state="Analytic", ndim=2, nchan=obs.nchan * nchan, rate=obs.rate * kept / step, ndat=parts * kept, dc_centred=freq_res % 2 == 1)
    return Stage("filterbank", run, out.later(wings[0]) if obs.rate else out, nfft, step, kept)


def tfp_filterbank(obs: Observation, nchan: int, sum_polarizations: bool = False) -> Stage:
    """As kernels.tfp_filterbank."""
    nfft = nchan * (2 if obs.state == "Nyquist" else 1)

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.moveaxis(np.abs(shifted(x)) ** 2, 3, 1)  # channel, band, polarization, transform
        power = power.reshape(x.shape[0] * nchan, *power.shape[2:])[..., None]
        good = np.repeat(good, nchan, axis=0)
        return (power.sum(1, keepdims=True), good.all(1, keepdims=True)) if sum_polarizations else (power, good)

    out = replace(obs, state="PPQQ" if obs.npol == 2 else "Intensity", ndim=1, nchan=obs.nchan * nchan, ndat=obs.ndat // nfft, rate=obs.rate / nfft)
    return Stage("tfp_filterbank", run, out.with_state("Intensity") if sum_polarizations else out, nfft, nfft, 1)


def polyphase_filterbank(obs: Observation, nchan: int, taps: np.ndarray) -> Stage:
    """As kernels.polyphase_filterbank."""
    branches = len(taps) // nchan

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.fft.fftshift(np.fft.fft((x * taps).reshape(*x.shape[:3], branches, nchan).sum(3)), axes=3)
        z = np.moveaxis(z, 3, 1)
        return z.reshape(x.shape[0] * nchan, *z.shape[2:])[..., None], np.repeat(good, nchan, axis=0)

    out = replace(obs, state="Analytic", ndim=2, nchan=obs.nchan * nchan, rate=obs.rate / nchan, ndat=max(0, obs.ndat // nchan - branches + 1))
    return Stage("polyphase_filterbank", run, out, len(taps), nchan, 1)


def convolve(obs: Observation, response: np.ndarray | dict[int, np.ndarray], wings: tuple[int, int], apodization: np.ndarray | None = None) -> Stage:
    """As kernels.convolve."""
    real = obs.state == "Nyquist"
    own = np.stack([response[c] for c in range(obs.nchan)])[:, None, None] if isinstance(response, dict) else response
    n = own.shape[-1]
    kept = n - sum(wings)
    nfft, step = (2 * n, 2 * kept) if real else (n, kept)

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.fft.ifft(spectrum(x if apodization is None else x * apodization) * own)[..., wings[0] : n - wings[1]], good

    return Stage("convolve", run, convolved_header(obs, nfft, step, kept, wings), nfft, step, kept)


def dedisperse(obs: Observation, n: int, wings: tuple[int, int], fractional: bool = False) -> Stage:
    """As kernels.coherent_dedispersion."""
    return replace(convolve(obs, dedispersion_responses(obs, n, fractional), wings), name="dedisperse")


def convolve_matrix(obs: Observation, jones: np.ndarray, wings: tuple[int, int]) -> Stage:
    """As kernels.convolve_matrix: of polarizations together, so bad in one is bad in both."""
    real = obs.state == "Nyquist"
    n = len(jones)
    kept = n - sum(wings)
    nfft, step = (2 * n, 2 * kept) if real else (n, kept)

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.fft.ifft(np.einsum("kij,cjbk->cibk", jones, spectrum(x)))
        return z[..., wings[0] : n - wings[1]], np.broadcast_to(good.all(1, keepdims=True), good.shape)

    return Stage("convolve_matrix", run, convolved_header(obs, nfft, step, kept, wings), nfft, step, kept)


def excise(obs: Observation, samples: int, threshold: float, least: float, most: float, together: bool = True) -> Stage:
    """As weights.excised: blocks of samples whose share of values under the threshold is outside
    least..most, or that aren't whole, aren't good, and are 0; with together in all channels and
    polarizations."""

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (abs(x.real) < threshold).mean(3)
        if np.iscomplexobj(x):
            low = (low + (abs(x.imag) < threshold).mean(3)) / 2
        fine = good & (low >= least) & (low <= most)
        fine = np.broadcast_to(fine.all((0, 1), keepdims=True), fine.shape) if together else fine
        return np.where(fine[..., None], x, 0), fine

    return Stage("excise", run, replace(obs, ndat=obs.ndat // samples * samples), samples, samples, samples)


def zap(obs: Observation, samples: int, low: float, high: float) -> Stage:
    """Of voltages, parts of so many samples whose power's spectral kurtosis is outside low..high in a
    polarization aren't good in any; see rfi.mask_parts. What is left after the last part isn't given."""

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = x.real**2 + x.imag**2 if np.iscomplexobj(x) else x * x
        s1, s2 = power.sum(3), (power * power).sum(3)
        with np.errstate(divide="ignore", invalid="ignore"):
            sk = np.where(s1 == 0, 0.0, (samples + 1) / (samples - 1) * (samples * s2 / (s1 * s1) - 1))
        fine = (good & (sk >= low) & (sk <= high)).all(1, keepdims=True)
        return x, np.broadcast_to(fine, good.shape)

    return Stage("zap", run, replace(obs, ndat=obs.ndat // samples * samples), samples, samples, samples)


@dataclass(frozen=True)
class Delays(Stage):
    """Channels moved by whole samples: sample k of a channel was k + its shift."""

    shifts: tuple[int, ...] = ()

    def apply(self, first: int, x: np.ndarray, good: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        n = max(0, x.shape[2] - self.nfft + 1)
        cut = lambda a: np.stack([a[c, :, s : s + n] for c, s in enumerate(self.shifts)])
        return first, cut(x), cut(good)


def delays(obs: Observation, by_channel: Sequence[int]) -> Stage:
    """As delay.sample_delay: each channel moves back by the largest delay less its own."""
    most, least = max(by_channel), min(by_channel)
    out = replace(obs, ndat=max(0, obs.ndat - (most - least)))
    return Delays("delays", lambda x, good: (x, good), out.later(most) if obs.rate else out, most - least + 1, 1, 1, tuple(most - d for d in by_channel))


def interchannel(obs: Observation) -> Stage:
    """As delay.dedisperse."""
    return delays(obs, [math.floor(dispersion_delay(obs.dispersion_measure, obs.centre_frequency, obs.frequency(c)) * obs.rate + 0.5) for c in range(obs.nchan)])


def detect(obs: Observation, state: str = "Intensity") -> Stage:
    """Intensity, PPQQ, Coherence (PP, QQ, Re, Im) or Stokes of voltages; a sample that is bad in one
    polarization is so in what is made of both."""
    if obs.detected:
        raise ValueError("detected already")
    if state in ("Coherence", "Stokes") and (obs.npol != 2 or obs.state != "Analytic"):
        raise ValueError("products are of two polarizations of analytic voltages")

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = x.real**2 + x.imag**2 if np.iscomplexobj(x) else x * x
        if state == "PPQQ":
            return power, good
        both = good.all(1, keepdims=True)
        if state == "Intensity":
            return power.sum(1, keepdims=True), both
        cross = x[:, 0] * np.conj(x[:, 1])  # re and im of the second's product with the first's conjugate differ in sign
        products = np.stack([power[:, 0], power[:, 1], cross.real, -cross.imag], 1)
        if state == "Stokes":
            products = np.stack([products[:, 0] + products[:, 1], products[:, 0] - products[:, 1], 2 * products[:, 2], 2 * products[:, 3]], 1)
        return products, np.repeat(both, 4, axis=1)

    npol = {"PPQQ": obs.npol, "Intensity": 1}.get(state, 4)
    return Stage(f"detect_{state}", run, replace(obs, state=state, ndim=1, npol=npol))


def scrunch(obs: Observation, time: int = 1, frequency: int = 1) -> Stage:
    """As scrunch.scrunch: one bad sample makes a sum bad."""
    if not obs.detected:
        raise ValueError("voltages can't be scrunched")
    nchan = obs.nchan // frequency

    def run(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, good = (x, good) if time > 1 else (x[..., None], good)
        x, good = x[: nchan * frequency].reshape(nchan, frequency, *x.shape[1:]), good[: nchan * frequency].reshape(nchan, frequency, *good.shape[1:])
        return x.sum((1, 4)) if time == 1 else x.sum((1, 4))[..., None], good.all(1)

    width = obs.bandwidth / obs.nchan
    kept = nchan * frequency
    out = replace(obs, ndat=obs.ndat // time, rate=obs.rate / time, nchan=nchan, bandwidth=width * kept, centre_frequency=obs.centre_frequency - width * (obs.nchan - kept) / 2, scale=obs.scale * time * frequency)
    return Stage("scrunch", run, out, time, time, 1)
