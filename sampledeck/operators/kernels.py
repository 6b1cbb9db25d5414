"""Fourier kernels: runs of blocks of samples as arrays, in Arrow tasks grouped by channel,
polarization and run.

Block b takes the samples b * step <= idat < b * step + nfft. Blocks are worked on in runs of about
RUN_SAMPLES samples, so overlap-save copies only the samples at the ends of runs before the shuffle
and numpy transforms a whole run at once; a block's result doesn't depend on its run. Blocks that
aren't full are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sampledeck.functions.numeric import chirp, dispersion_delay
from sampledeck.plans.observation import Observation, Signal


#: Samples of a run of blocks, about.
RUN_SAMPLES = 1 << 15


def into_runs(data: DataFrame, nfft: int, step: int, blocks: int) -> DataFrame:
    """data with irun, a row for each run of `blocks` blocks that uses the sample."""
    span = blocks * step
    first = F.greatest(F.lit(0), F.ceil((F.col("idat") - (span - step + nfft - 1)) / span)).cast("long")
    last = F.floor(F.col("idat") / span).cast("long")
    return data.withColumn("irun", F.explode(F.sequence(first, last)))


def by_block(signal: Signal, nfft: int, step: int, schema: str, kernel: Callable[..., dict[str, np.ndarray]], together: bool = False) -> DataFrame:
    """kernel(ichan, ipol, iblock, x) of every run's full blocks: their numbers and samples, x[block,
    sample]. together: of all polarizations at once, kernel(ichan, iblock, x[ipol, block, sample]).
    Real samples (v) come as floats, complex ones as complex numbers. The kernel's arrays, of any
    shapes that broadcast together, become the columns of schema."""
    complex_data = signal.obs.state == "Analytic"
    blocks = max(1, RUN_SAMPLES // step)
    rows = into_runs(signal.data, nfft, step, blocks)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    npol = signal.obs.npol if together else 1

    def run(table: pa.Table) -> pa.Table:
        irun, ichan = table.column("irun")[0].as_py(), table.column("ichan")[0].as_py()
        at = np.asarray(table.column("idat")) - irun * blocks * step
        pol = np.asarray(table.column("ipol")) if together else np.zeros(len(at), int)
        x = np.zeros((npol, blocks * step - step + nfft), complex if complex_data else float)
        there = np.zeros(x.shape, bool)
        x[pol, at] = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im")) if complex_data else np.asarray(table.column("v"))
        there[pol, at] = True
        windows, whole = (np.lib.stride_tricks.sliding_window_view(a, nfft, axis=1)[:, ::step] for a in (x, there))
        full = np.flatnonzero(whole.all(axis=(0, 2)))
        if not len(full):
            return pa.table({n: pa.array([], to_arrow_type(t)) for n, t in types.items()})
        found = kernel(ichan, irun * blocks + full, windows[:, full]) if together else kernel(ichan, table.column("ipol")[0].as_py(), irun * blocks + full, windows[0, full])
        columns = np.broadcast_arrays(*(found[n] for n in types))
        return pa.table({n: pa.array(c.ravel()).cast(to_arrow_type(t)) for (n, t), c in zip(types.items(), columns, strict=True)})

    return rows.groupBy("ichan", *([] if together else ["ipol"]), "irun").applyInArrow(run, schema)


VOLTS = "idat long, ichan int, ipol int, re double, im double"


def spectrum(x: np.ndarray) -> np.ndarray:
    """The analytic spectrum of each row: all of complex rows', half of real ones'."""
    return np.fft.fft(x) if np.iscomplexobj(x) else np.fft.rfft(x)[..., :-1]


def shifted(x: np.ndarray) -> np.ndarray:
    """A spectrum in order of frequency: real voltages' is so already."""
    return np.fft.fftshift(spectrum(x), axes=-1) if np.iscomplexobj(x) else spectrum(x)


def filterbank(signal: Signal, nchan: int, freq_res: int = 1, response: np.ndarray | None = None, wings: tuple[int, int] = (0, 0)) -> Signal:
    """nchan channels from each: one long transform, cut into nchan bands, each transformed back to
    freq_res samples, of which `wings` at either end are dropped. response: (nchan * freq_res)
    points to multiply the spectrum by, for convolution during channelization."""
    real = signal.obs.state == "Nyquist"
    kept = freq_res - sum(wings)
    nfft = nchan * freq_res * (2 if real else 1)
    step = nchan * kept * (2 if real else 1)

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        bands = shifted(x) if response is None else shifted(x) * response
        z = bands.reshape(len(x), nchan, freq_res)
        if freq_res > 1:
            z = np.fft.ifft(np.fft.ifftshift(z, axes=2), axis=2)[:, :, wings[0] : freq_res - wings[1]]
        return {"idat": (iblock[:, None] * kept + np.arange(kept))[:, None, :], "ichan": ichan * nchan + np.arange(nchan)[:, None], "ipol": np.array(ipol), "re": z.real, "im": z.imag}

    obs = signal.obs
    parts = (obs.ndat - nfft) // step + 1 if obs.ndat >= nfft else 0
    out = replace(obs, state="Analytic", ndim=2, nchan=obs.nchan * nchan, rate=obs.rate * kept / step, ndat=parts * kept, dc_centred=freq_res % 2 == 1)
    moved = signal.weighing(lambda w: w.of_blocks(nfft, step, kept, parts, obs, nchan))
    return Signal(by_block(signal, nfft, step, VOLTS, run), out.later(wings[0]) if obs.rate else out, moved)


def convolve(signal: Signal, response: np.ndarray | dict[int, np.ndarray], wings: tuple[int, int], apodization: np.ndarray | None = None) -> Signal:
    """Overlap-save convolution: each block's spectrum times the response (one, or by channel, in
    FFT order), back, and `wings` samples dropped at the ends. A real signal becomes analytic."""
    real = signal.obs.state == "Nyquist"
    first = next(iter(response.values())) if isinstance(response, dict) else response
    n, kept = len(first), len(first) - sum(wings)
    nfft, step = (2 * n, 2 * kept) if real else (n, kept)

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        own = response[ichan] if isinstance(response, dict) else response
        z = np.fft.ifft(spectrum(x if apodization is None else x * apodization) * own)[:, wings[0] : n - wings[1]]
        return {"idat": iblock[:, None] * kept + np.arange(kept), "ichan": np.array(ichan), "ipol": np.array(ipol), "re": z.real, "im": z.imag}

    out = convolved_header(signal.obs, nfft, step, kept, wings)
    return Signal(by_block(signal, nfft, step, VOLTS, run), out, signal.weighing(lambda w: w.of_blocks(nfft, step, kept, out.ndat // kept, signal.obs)))


def convolved_header(obs: Observation, nfft: int, step: int, kept: int, wings: tuple[int, int]) -> Observation:
    """Of what overlap-save leaves: whole blocks, from the first one's first kept sample on."""
    real = obs.state == "Nyquist"
    parts = (obs.ndat - nfft) // step + 1 if obs.ndat >= nfft else 0
    out = replace(obs, state="Analytic", ndim=2, rate=obs.rate / 2 if real else obs.rate, ndat=parts * kept)
    return out.later(wings[0]) if obs.rate else out


def convolve_matrix(signal: Signal, jones: np.ndarray | dict[int, np.ndarray], wings: tuple[int, int]) -> Signal:
    """As convolve, of both polarizations together by a 2x2 matrix for each spectral point:
    jones has the shape (points, 2, 2), or is such an array by channel."""
    real = signal.obs.state == "Nyquist"
    n = len(next(iter(jones.values())) if isinstance(jones, dict) else jones)
    kept = n - sum(wings)
    nfft, step = (2 * n, 2 * kept) if real else (n, kept)

    def run(ichan: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        own = jones[ichan] if isinstance(jones, dict) else jones
        z = np.fft.ifft(np.einsum("kij,jbk->ibk", own, spectrum(x)))[:, :, wings[0] : n - wings[1]]
        return {"idat": iblock[:, None] * kept + np.arange(kept), "ichan": np.array(ichan), "ipol": np.arange(2)[:, None, None], "re": z.real, "im": z.imag}

    out = convolved_header(signal.obs, nfft, step, kept, wings)
    return Signal(by_block(signal, nfft, step, VOLTS, run, together=True), out, signal.weighing(lambda w: w.across("ipol").of_blocks(nfft, step, kept, out.ndat // kept, signal.obs)))


def passband(signal: Signal, response: np.ndarray | dict[int, np.ndarray], wings: tuple[int, int]) -> DataFrame:
    """The power of each point of the spectrum that convolve() multiplies, summed over its blocks:
    ichan, ipol, point (in FFT order), total, n. Each run adds up its own blocks first."""
    real = signal.obs.state == "Nyquist"
    n = len(next(iter(response.values())) if isinstance(response, dict) else response)
    nfft, step = (2 * n, 2 * (n - sum(wings))) if real else (n, n - sum(wings))

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        own = response[ichan] if isinstance(response, dict) else response
        return {"ichan": np.array(ichan), "ipol": np.array(ipol), "point": np.arange(n), "total": (np.abs(spectrum(x) * own) ** 2).sum(0), "n": np.array(len(x))}

    rows = by_block(signal, nfft, step, "ichan int, ipol int, point int, total double, n long", run)
    return rows.groupBy("ichan", "ipol", "point").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fractions_of_delays(obs: Observation) -> list[float]:
    """What is left of each channel's dispersion delay, in samples, when delay.dedisperse has moved it by
    whole ones: from -0.5 to 0.5, positive where it must come later still."""
    delays = [dispersion_delay(obs.dispersion_measure, obs.centre_frequency, obs.frequency(c)) * obs.rate for c in range(obs.nchan)]
    return [d - np.floor(d + 0.5) for d in delays]


def gradient(n: int, samples: float) -> np.ndarray:
    """The response of n points, in FFT order, that delays by that many samples, or parts of one."""
    return np.exp(-2j * np.pi * np.fft.fftfreq(n) * samples)


def fractional_delay(signal: Signal, n: int, wings: tuple[int, int]) -> Signal:
    """Each channel moved by the part of a sample that delay.dedisperse leaves, so that after it all
    channels are aligned to far less than a sample."""
    return convolve(signal, {c: gradient(n, x) for c, x in enumerate(fractions_of_delays(signal.obs))}, wings)


def dedispersion_responses(obs: Observation, n: int, fractional: bool = False) -> dict[int, np.ndarray]:
    """Each channel's response of n points to the header's dispersion measure; fractional: with
    fractional_delay() besides."""
    width = obs.bandwidth / obs.nchan
    parts = fractions_of_delays(obs) if fractional else [0.0] * obs.nchan
    return {c: chirp(obs.dispersion_measure, obs.frequency(c), width, n) * gradient(n, parts[c]) for c in range(obs.nchan)}


def coherent_dedispersion(signal: Signal, n: int, wings: tuple[int, int], fractional: bool = False) -> Signal:
    return convolve(signal, dedispersion_responses(signal.obs, n, fractional), wings)


def tfp_filterbank(signal: Signal, nchan: int, sum_polarizations: bool = False) -> Signal:
    """Powers of nchan channels by non-overlapping transforms; polarizations can be added."""
    nfft = nchan * (2 if signal.obs.state == "Nyquist" else 1)

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"idat": iblock[:, None], "ichan": ichan * nchan + np.arange(nchan), "ipol": np.array(ipol), "v": np.abs(shifted(x)) ** 2}

    data = by_block(signal, nfft, nfft, "idat long, ichan int, ipol int, v double", run)
    obs = replace(signal.obs, state="PPQQ" if signal.obs.npol == 2 else "Intensity", ndim=1, nchan=signal.obs.nchan * nchan, ndat=signal.obs.ndat // nfft, rate=signal.obs.rate / nfft)
    if sum_polarizations:
        data = data.groupBy("idat", "ichan").agg(F.sum("v").alias("v")).select("idat", "ichan", F.lit(0).alias("ipol"), "v")
        obs = obs.with_state("Intensity")
    moved = signal.weighing(lambda w: (w.across("ipol") if sum_polarizations else w).of_blocks(nfft, nfft, 1, obs.ndat, signal.obs, nchan))
    return Signal(data, obs, moved)


def incoherent_filterbank(signal: Signal, nchan: int, state: str = "Intensity") -> Signal:
    """nchan channels of real voltages of two polarizations by non-overlapping transforms of a power
    of two: detected as Intensity or PPQQ, or Analytic, undetected."""
    obs = signal.obs
    if obs.state != "Nyquist" or obs.npol != 2 or nchan & (nchan - 1):
        raise ValueError("real voltages of two polarizations and a power of two of channels are needed")
    return filterbank(signal, nchan) if state == "Analytic" else tfp_filterbank(signal, nchan, state == "Intensity")


def products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """PP, QQ, Re and Im of x's conjugate times y."""
    cross = np.conj(x) * y
    return np.abs(x) ** 2, np.abs(y) ** 2, cross.real, cross.imag


def voltage_bandpass(signal: Signal, nchan: int, full: bool = False) -> DataFrame:
    """Mean power spectrum by channel and polarization: ichan (input channel * nchan + bin), ipol,
    total, n. full: of both polarizations' four products (PP, QQ, Re, Im), which ipol counts; they
    meet side by side, and each run adds up its own transforms first."""
    if full:
        nfft = nchan * (2 if signal.obs.state == "Nyquist" else 1)

        def run(ichan: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
            sums = np.stack([p.sum(0) for p in products(*shifted(x))])
            return {"ichan": ichan * nchan + np.arange(nchan), "ipol": np.arange(4)[:, None], "total": sums, "n": np.array(len(iblock))}

        rows = by_block(signal, nfft, nfft, "ichan int, ipol int, total double, n long", run, together=True)
        return rows.groupBy("ichan", "ipol").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    power = tfp_filterbank(signal, nchan)
    return power.data.groupBy("ichan", "ipol").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def polyphase_filterbank(signal: Signal, nchan: int, taps: np.ndarray) -> Signal:
    """nchan channels by a polyphase filter: len(taps) = nchan * branches weights, a new spectrum
    every nchan samples."""
    branches = len(taps) // nchan

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        z = np.fft.fftshift(np.fft.fft((x * taps).reshape(len(x), branches, nchan).sum(1)), axes=1)
        return {"idat": iblock[:, None], "ichan": ichan * nchan + np.arange(nchan), "ipol": np.array(ipol), "re": z.real, "im": z.imag}

    obs = signal.obs
    out = replace(obs, state="Analytic", ndim=2, nchan=obs.nchan * nchan, rate=obs.rate / nchan, ndat=max(0, obs.ndat // nchan - branches + 1))
    return Signal(by_block(signal, len(taps), nchan, VOLTS, run), out, signal.weighing(lambda w: w.of_blocks(len(taps), nchan, 1, out.ndat, obs, nchan)))


def autocorrelation_fft(signal: Signal, nlag: int) -> DataFrame:
    """Lag products of parts of nlag samples, zero-padded: idat (the part), ichan, ipol, lag, re, im."""

    def run(ichan: int, ipol: int, iblock: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        r = np.fft.ifft(np.abs(np.fft.fft(x, 2 * nlag)) ** 2)[:, :nlag]
        return {"idat": iblock[:, None], "ichan": np.array(ichan), "ipol": np.array(ipol), "lag": np.arange(nlag), "re": r.real, "im": r.imag}

    return by_block(signal, nlag, nlag, "idat long, ichan int, ipol int, lag int, re double, im double", run)


def lag_products(data: DataFrame, nlag: int, samples: int, value: Column) -> DataFrame:
    """By channel, polarization and part of `samples` samples: sum of x[i] x[i + lag] within the
    part, lags 0..nlag-1. Whole parts meet in runs and are summed there; a lag of which no two
    samples are there has no row."""
    parts = max(1, RUN_SAMPLES // samples)
    span = parts * samples
    rows = data.select("ichan", "ipol", "idat", value.cast("double").alias("x")).withColumn("irun", F.expr(f"idat div {int(span)}"))

    def run(table: pa.Table) -> pa.Table:
        irun = table.column("irun")[0].as_py()
        at = np.asarray(table.column("idat")) - irun * span
        x, there = np.zeros((parts, samples)), np.zeros((parts, samples), bool)
        x.ravel()[at], there.ravel()[at] = np.asarray(table.column("x")), True
        most = min(nlag, samples)
        sums = np.stack([(x[:, : samples - k] * x[:, k:]).sum(1) for k in range(most)], 1)
        pairs = np.stack([(there[:, : samples - k] & there[:, k:]).any(1) for k in range(most)], 1)
        part, lag = np.nonzero(pairs)
        n = len(part)
        columns = {"part": irun * parts + part, "ichan": np.full(n, table.column("ichan")[0].as_py(), np.int32), "ipol": np.full(n, table.column("ipol")[0].as_py(), np.int32), "lag": lag.astype(np.int32), "r": sums[part, lag]}
        return pa.table({k: pa.array(v) for k, v in columns.items()})

    return rows.groupBy("ichan", "ipol", "irun").applyInArrow(run, "part long, ichan int, ipol int, lag int, r double")


def dft(data: DataFrame, n: int, columns: tuple[str, str] = ("re", "im")) -> DataFrame:
    """A small transform in column expressions, over arrays of a block's n samples in order: data
    has keys and arrays `columns`; out come k, re, im. For n up to some dozens."""
    re, im = (F.col(c) for c in columns)
    k = F.col("k")

    def term(array: Column, angle: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform(array, lambda x, j: x * angle(F.lit(-2 * np.pi / n) * k * j)), F.lit(0.0), lambda a, b: a + b)

    keys = [c for c in data.columns if c not in columns]
    rows = data.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*keys, "k", (term(re, F.cos) - term(im, F.sin)).alias("re"), (term(re, F.sin) + term(im, F.cos)).alias("im"))
