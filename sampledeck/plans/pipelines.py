"""The programs: folding, and two ways of writing search-mode data, as chains of operators.

A chain is one lazy plan; Catalyst fuses its projections, and scrunches that follow each other are
made in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.functions.numeric import chirp, optimal_fft, smearing_samples
from sampledeck.functions.turns import Turns
from sampledeck.operators import blocks, delay, detect, digitize, fold, kernels, rfi, scrunch, stats, weights
from sampledeck.plans import nodes
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources.raw import write_filterbank


@dataclass(frozen=True)
class Filterbank:
    """As N, N:D (dedisperse during), N:B (before), N:A (after, the default) or N:n (with n samples
    a channel at a time)."""

    nchan: int
    when: str = "A"
    freq_res: int = 1

    @classmethod
    def parse(cls, text: str) -> Filterbank:
        head, _, tail = text.partition(":")
        if not tail:
            return cls(int(head))
        return cls(int(head), freq_res=int(tail)) if tail.isdigit() else cls(int(head), tail.upper())


@dataclass(frozen=True)
class FoldConfig:
    """ephemeris, where it is given, says what to fold by in place of period_us. Sub-integrations by
    time are of whole samples with snapped; those by turns count from first_turn. excision: what
    weights.excised() takes; samples of weight 0, from here or from the signal, aren't folded. birdies: what stats.birdie_mask() takes (samples of an interval, half a
    window, cutoff); channels that stand off aren't folded in that interval."""

    period_us: int = 0
    nbin: int = 0
    ephemeris: Ephemeris | None = None
    epoch_us: int | None = None
    filterbank: Filterbank | None = None
    coherent: bool = False
    state: str = "Intensity"
    sk_samples: int = 0
    sk_sigmas: float = 3.0
    sk_limits: tuple[float, float] | None = None
    subint_us: int = 0
    snapped: bool = False
    subint_turns: int = 0
    first_turn: int = 0
    interchannel: bool = False
    excision: tuple[int, float, float, float] | None = None
    birdies: tuple[int, int, float] | None = None


@dataclass(frozen=True)
class SearchConfig:
    """Numbers of bits 0: no digitizing."""

    polarization: int | None = None
    filterbank: int = 0
    dedisperse: bool = False
    state: str = "Intensity"
    fscrunch: int = 1
    tscrunch: int = 1
    rescale_seconds: float = 10.0
    constant: bool = False
    bits: int = 2
    blocks: int = 1


def detected(signal: Signal, state: str) -> Signal:
    by = {"Intensity": detect.intensity, "PPQQ": detect.square_law, "NthPower": detect.nth_power, "Coherence": detect.coherence, "Stokes": detect.stokes}
    if signal.obs.detected:
        return signal
    out = signal.then(by[state])
    return out.then(detect.reshape_products) if state in ("Coherence", "Stokes") else out


def dedispersed(signal: Signal) -> Signal:
    """Each channel convolved with the response that undoes its dispersion, at the length of
    transform that costs least."""
    return signal.then(kernels.coherent_dedispersion, *dedispersion_shape(signal.obs))


def dedispersion_shape(obs: Observation) -> tuple[int, tuple[int, int]]:
    """(points of the response, samples to drop at its ends) for channels as they are."""
    width = obs.bandwidth / obs.nchan
    edge = min(abs(obs.centre_frequency) - abs(obs.bandwidth) / 2 + abs(width) / 2, abs(obs.centre_frequency))
    wing = max(1, smearing_samples(obs.dispersion_measure, edge, width, obs.rate))
    return optimal_fft(2 * wing, 1 << 20), (wing, wing)


def channelized(signal: Signal, bank: Filterbank | None, coherent: bool) -> Signal:
    """B convolves the undivided band and divides it then; D multiplies the long transform's
    spectrum; A divides first and convolves each channel."""
    if bank is None:
        return dedispersed(signal) if coherent else signal
    if coherent and bank.when == "B":
        signal = dedispersed(signal)
    if coherent and bank.when == "D":
        return signal.then(kernels.filterbank, bank.nchan, *during(signal.obs, bank.nchan))
    out = signal.then(kernels.filterbank, bank.nchan, bank.freq_res)
    return dedispersed(out) if coherent and bank.when == "A" else out


def during(obs: Observation, nchan: int) -> tuple[int, np.ndarray, tuple[int, int]]:
    """(points a channel, response of the whole band, samples to drop at the ends) for dedispersion in
    a filterbank's long transform."""
    if obs.nchan != 1:
        raise ValueError("dedispersion during channelization takes one input channel")
    sub = abs(obs.bandwidth) / nchan
    wing = max(1, smearing_samples(obs.dispersion_measure, abs(obs.centre_frequency) - abs(obs.bandwidth) / 2 + sub / 2, sub, obs.rate / nchan))
    freq_res = optimal_fft(2 * wing, 1 << 16)
    whole = np.fft.fftshift(chirp(obs.dispersion_measure, obs.centre_frequency, obs.bandwidth, nchan * freq_res, dc_zero=False))
    # each band keeps the delay of its own middle, for the inter-channel step to remove
    return freq_res, whole, (wing, wing)


def mitigated(signal: Signal, power: Signal, config: FoldConfig) -> DataFrame:
    """signal's good samples with zapped, whether their part is one whose spectral kurtosis, of power, is out of
    bounds: the bounds of the configuration for single parts, or else the whole mask at its number of sigmas."""
    clean = replace(signal, data=signal.good())
    if config.birdies:
        bad = stats.birdie_mask(replace(power, data=power.good()), *config.birdies)
        if not config.sk_samples:
            return rfi.mark(clean, bad, config.birdies[0])
        clean = rfi.drop_masked(clean, bad, config.birdies[0])
        power = rfi.drop_masked(power, bad, config.birdies[0])
    m = config.sk_samples
    estimates = rfi.kurtosis(power, m)
    if config.sk_limits:
        mask = rfi.mask_parts(estimates, config.sk_limits)
    else:
        mask = rfi.mask_all(estimates, m, max(1, power.obs.ndat // m), config.sk_sigmas, ndat=power.obs.ndat)
    return rfi.mark(clean, mask, m)


@dataclass(frozen=True)
class Ephemeris:
    """What a source is folded by: a constant period, or a phase predictor's segments (as
    fold.predictor takes them, each good for span_us from first_us on in turn); and its bins."""

    source: str
    period_us: int = 0
    segments: tuple = ()
    span_us: int = 0
    first_us: int = 0
    nbin: int = 0
    reference_phase: float = 0.0

    def frequency(self) -> float:
        """Turns a second, in the middle of the predictor."""
        return 1e6 / self.period_us if self.period_us else self.segments[len(self.segments) // 2][2]


def prepared(signal: Signal, config: FoldConfig) -> tuple[Signal, Signal]:
    """The voltages in their channels, and what is folded."""
    if config.excision:
        signal = signal.then(weights.excised, *config.excision)
    work = channelized(signal, config.filterbank, config.coherent) if not signal.obs.detected else signal
    if config.interchannel:
        work = work.then(delay.dedisperse)
    return work, detected(work, config.state)


def timed(rows: DataFrame, obs: Observation) -> DataFrame:
    return rows if "us" in rows.columns else rows.withColumn("us", fold.sample_us(F.col("idat"), obs.rate, obs.start_us))


def with_turns(rows: DataFrame, source: Ephemeris, epoch_us: int, how: str = "inner") -> DataFrame:
    """rows (us) with ibin and turn, the number of whole turns, by that source's ephemeris. Rows that no
    segment of a predictor covers are dropped, or have nulls with how="left"."""
    if source.period_us:
        turn = F.floor(fold.since(F.col("us"), epoch_us) / source.period_us).cast("long")
        return rows.withColumn("ibin", fold.constant_bin(F.col("us"), epoch_us, source.period_us, source.nbin)).withColumn("turn", turn)
    segments = fold.predictor(rows.sparkSession, source.segments, source.span_us, source.first_us)
    rows = fold.predicted(rows, segments, source.span_us, source.first_us, how)
    return rows.withColumn("ibin", fold.turn_bin(source.nbin, source.reference_phase)).withColumn("turn", F.floor(F.col("turns") - F.lit(source.reference_phase)).cast("long")).drop("turns")


def folded(rows: DataFrame, obs: Observation, config: FoldConfig, source: Ephemeris, valid=None, *more: str) -> DataFrame:
    """Profiles of one source: sub-integrations of whole samples where they go by time, of whole
    turns where they go by turns."""
    epoch = obs.start_us if config.epoch_us is None else config.epoch_us
    source = replace(source, nbin=fold.choose_nbin(1 / source.frequency(), obs.rate, source.nbin or config.nbin))
    rows = with_turns(timed(rows, obs), source, epoch)
    keys = (*more, "subint", "ichan", "ipol")
    return fold.normalise(fold.fold(rows.withColumn("subint", subint_of(config, obs, epoch)), *keys, valid=valid), source.nbin, *keys, scale=obs.scale)


def subint_of(config: FoldConfig, obs: Observation, epoch_us: int) -> Column:
    """The sub-integration of rows (idat, us, turn)."""
    if config.subint_us and config.snapped:
        return fold.snapped_division(F.col("idat"), obs.rate, obs.start_us + obs.start_fraction, epoch_us, config.subint_us)
    if config.subint_us:
        return fold.division(F.col("us"), epoch_us, config.subint_us)
    return F.floor((F.col("turn") - config.first_turn) / config.subint_turns).cast("long") if config.subint_turns else F.lit(0).cast("long")


def fold_signal(signal: Signal, config: FoldConfig) -> DataFrame:
    """The folded profile: subint, ichan, ipol, ibin, amp, hits (or products of the state asked). With
    mitigation, channels that a kernel makes are made once, see fold_forked()."""
    work, power = prepared(signal, config)
    source = config.ephemeris or Ephemeris(power.obs.source, config.period_us)
    if not config.sk_samples and not config.birdies:
        return folded(power.good(), power.obs, config, source)
    made = config.filterbank or config.coherent
    node = nodes.materialised(work) if made else None
    if node:
        work, power = node.signal, detected(node.signal, config.state)
    out = folded(mitigated(power, detected(work, "PPQQ"), config), power.obs, config, source, ~F.col("zapped"))
    return node.finished(out) if node else out


def fold_sources(signal: Signal, config: FoldConfig, sources: Sequence[Ephemeris]) -> DataFrame:
    """Several sources, each by its own ephemeris and bins, from one preparation and one pass over what
    it gives: source and the columns of fold_signal()."""
    work, power = prepared(signal, config)
    if not config.sk_samples and not config.birdies:
        return folded_many(power.good(), power.obs, config, sources)
    node = nodes.materialised(work)
    power = detected(node.signal, config.state)
    rows = mitigated(power, detected(node.signal, "PPQQ"), config)
    return node.finished(folded_many(rows, power.obs, config, sources, ~F.col("zapped")))


def folded_many(rows: DataFrame, obs: Observation, config: FoldConfig, sources: Sequence[Ephemeris], valid=None) -> DataFrame:
    """Profiles of several sources: each sample becomes a row a source before the partial sums."""
    epoch = obs.start_us if config.epoch_us is None else config.epoch_us
    rows = timed(rows, obs)
    columns, cells, bins = rows.columns, [], []
    for k, source in enumerate(sources):
        source = replace(source, nbin=fold.choose_nbin(1 / source.frequency(), obs.rate, source.nbin or config.nbin))
        rows = with_turns(rows, source, epoch, "left").withColumn("_subint", subint_of(config, obs, epoch))
        rows = rows.withColumnsRenamed({"ibin": f"_ibin{k}", "_subint": f"_subint{k}"}).drop("turn")
        cells.append(F.struct(F.lit(k).alias("place"), F.col(f"_ibin{k}").alias("ibin"), F.col(f"_subint{k}").alias("subint")))
        bins.append(source.nbin)
    dealt = rows.withColumn("cell", F.explode(F.array(*cells))).select(*columns, "cell.*").filter("ibin is not null")
    keys = ("place", "subint", "ichan", "ipol")
    nbin, names = (F.array(*map(F.lit, x))[F.col("place")] for x in (bins, [s.source for s in sources]))
    out = fold.normalise(fold.fold(dealt, *keys, valid=valid), nbin, *keys, scale=obs.scale)
    return out.select(names.alias("source"), *[c for c in out.columns if c != "place"])


def fold_forked(signal: Signal, config: FoldConfig) -> DataFrame:
    """Folded with and without mitigation: mitigated and the columns of fold_signal(). The channels are
    made once and written to the shared folder, from which mitigation and fold read them; each sample
    goes to both folds before the partial sums."""
    node = nodes.materialised(prepared(signal, config)[0])
    power = detected(node.signal, config.state)
    marked = mitigated(power, detected(node.signal, "PPQQ"), config)
    rows = marked.withColumn("mitigated", F.explode(F.array(F.lit(False), F.lit(True))))
    source = config.ephemeris or Ephemeris(power.obs.source, config.period_us)
    return node.finished(folded(rows, power.obs, config, source, ~(F.col("zapped") & F.col("mitigated")), "mitigated"))


def fold_chain(chain: blocks.Chain, config: FoldConfig) -> DataFrame:
    """fold_signal() of a chain, so of files or rows as arrays: what leaves a task are bins. Mitigation
    takes limits (sk_limits) of single parts; whole masks and channels that stand off need sums over
    parts that no piece has, which fold_signal() makes. Samples after the last whole part, or block
    of excision, aren't folded."""
    if config.birdies or config.sk_samples and not config.sk_limits:
        raise ValueError("masks that need more than single parts are made by fold_signal()")
    if config.excision:
        chain = chain.then(blocks.excise, *config.excision)
    bank, coherent = config.filterbank, config.coherent
    if coherent and (bank is None or bank.when == "B"):
        chain = chain.then(blocks.dedisperse, *dedispersion_shape(chain.obs))
    if bank is not None:
        chain = chain.then(blocks.filterbank, bank.nchan, *during(chain.obs, bank.nchan)) if coherent and bank.when == "D" else chain.then(blocks.filterbank, bank.nchan, bank.freq_res)
        if coherent and bank.when == "A":
            chain = chain.then(blocks.dedisperse, *dedispersion_shape(chain.obs))
    if config.interchannel:
        chain = chain.then(blocks.interchannel)
    if config.sk_samples:
        chain = chain.then(blocks.zap, config.sk_samples, *config.sk_limits)
    if not chain.obs.detected:
        chain = chain.then(blocks.detect, config.state)
    obs = chain.obs
    source = config.ephemeris or Ephemeris(obs.source, config.period_us)
    nbin = fold.choose_nbin(1 / source.frequency(), obs.rate, source.nbin or config.nbin)
    epoch = obs.start_us if config.epoch_us is None else config.epoch_us
    turns = Turns(source.period_us, epoch, source.segments, source.span_us, source.first_us)

    def binning(us: np.ndarray, idat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if source.period_us:
            whole, ibin = (us - epoch) // source.period_us, (us - epoch) % source.period_us * nbin // source.period_us
        else:
            phase = turns.at(us) - source.reference_phase
            there = np.isfinite(phase)
            phase = np.where(there, phase, 0.0)
            whole = np.floor(phase).astype(np.int64)
            ibin = np.where(there, np.minimum(np.floor((phase - whole) * nbin).astype(np.int64), nbin - 1), -1)
        if config.subint_us and config.snapped:
            return fold.snapped_divisions(idat, obs.rate, obs.start_us + obs.start_fraction, epoch, config.subint_us), ibin
        if config.subint_us:
            return (us - epoch) // config.subint_us, ibin
        return (whole - config.first_turn) // config.subint_turns if config.subint_turns else np.zeros(len(us), np.int64), ibin

    keys = ("subint", "ichan", "ipol")
    return fold.normalise(chain.fold_by(binning, nbin), nbin, *keys, scale=obs.scale)


def fold_files(spark: SparkSession, urls: list[str], config: FoldConfig, force: bool = False) -> DataFrame:
    """fold_chain() of a series of files, read as arrays; with force there may be gaps between them."""
    return fold_chain(blocks.from_files(spark, urls, force), config)


def search_mode(signal: Signal, config: SearchConfig) -> Signal:
    """Selection, channels, delays, detection, scrunching, rescaling; a Signal to digitize."""
    was_detected = signal.obs.detected
    work = signal if config.polarization is None else signal.then(detect.select_polarization, config.polarization)
    if not was_detected and config.filterbank:
        work = work.then(kernels.filterbank, config.filterbank)
    if config.dedisperse:
        work = work.then(delay.dedisperse)
    work = detected(work, config.state)
    work = work.then(scrunch.scrunch, config.tscrunch, config.fscrunch)
    if config.rescale_seconds:
        work = work.then(stats.rescale, max(1, round(config.rescale_seconds * work.obs.rate)) if work.obs.rate else None, config.constant)
    return work.then(scrunch.pscrunch) if was_detected and work.obs.npol > 1 else work


def search_codes(signal: Signal, config: SearchConfig) -> DataFrame:
    return digitize.digitize(search_mode(signal, config), config.bits)


def fits_mode(signal: Signal, config: SearchConfig, samples: int) -> DataFrame:
    """Codes with each block's scales and offsets; here delays come after detection and scrunching."""
    was_detected = signal.obs.detected
    work = signal if was_detected or not config.filterbank else signal.then(kernels.filterbank, config.filterbank)
    work = detected(work, config.state).then(scrunch.scrunch, config.tscrunch, config.fscrunch)
    if config.dedisperse:
        work = work.then(delay.dedisperse)
    if was_detected and work.obs.npol > 1:
        work = work.then(scrunch.pscrunch)
    return digitize.digitize_by_block(work, config.bits, samples, config.blocks)


def decimate(signal: Signal, config: SearchConfig, folder: str, samples_per_file: int) -> DataFrame:
    """A detected file scrunched, rescaled and digitized anew, as filterbank files in folder, a URL;
    returns them as write_filterbank() does."""
    out = search_mode(signal, config)
    return write_filterbank(digitize.digitize(out, config.bits), replace(out.obs, nbit=config.bits), folder, samples_per_file)
