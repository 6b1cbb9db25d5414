"""The header that travels with sampled data, and what operators do to it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampledeck.plans.weights import Weights

#: Undetected states; all others are detected.
UNDETECTED = ("Nyquist", "Analytic")
#: (values a sample, polarizations) that a state fixes; None leaves them as they are.
STATE_SHAPES = {"Nyquist": (1, None), "Analytic": (2, None), "Intensity": (1, 1), "NthPower": (1, 1), "PPQQ": (1, 2), "Coherence": (1, 4), "Stokes": (1, 4), "FourthMoment": (14, 1)}


@dataclass(frozen=True)
class Observation:
    """Frequencies are in MHz, the rate in samples a second; bandwidth can be negative. start_us is
    the first sample's time in microseconds since 1970 and start_fraction what lies below one."""

    source: str = "unknown"
    telescope: str = "unknown"
    receiver: str = "unknown"
    type: str = "Pulsar"
    basis: str = "Linear"
    state: str = "Intensity"
    ndim: int = 1
    nchan: int = 1
    npol: int = 1
    nbit: int = 0
    ndat: int = 0
    centre_frequency: float = 0.0
    bandwidth: float = 0.0
    rate: float = 0.0
    scale: float = 1.0
    start_us: int = 0
    start_fraction: float = 0.0
    dc_centred: bool = False
    swap: bool = False
    nsub_swap: int = 0
    dispersion_measure: float = 0.0
    rotation_measure: float = 0.0
    calfreq: float = 0.0
    identifier: str = ""
    machine: str = ""
    format: str = ""
    mode: str = ""
    history: tuple[str, ...] = ()

    @property
    def detected(self) -> bool:
        return self.state not in UNDETECTED

    @property
    def seconds(self) -> float:
        return self.ndat / self.rate if self.ndat else 0.0

    @property
    def end_us(self) -> float:
        """Time after the last sample; the start where there are no samples."""
        return self.start_us + self.start_fraction + self.seconds * 1e6

    def with_state(self, state: str) -> Observation:
        """The header in that state; becoming Analytic from Nyquist halves rate and samples."""
        ndim, npol = STATE_SHAPES.get(state, (None, None))
        half = self.state == "Nyquist" and state == "Analytic"
        return replace(self, state=state, ndim=ndim or self.ndim, npol=npol or self.npol, rate=self.rate / 2 if half else self.rate, ndat=self.ndat // 2 if half else self.ndat)

    def later(self, samples: float) -> Observation:
        """Starting that many samples later."""
        total = self.start_fraction + samples / self.rate * 1e6
        return replace(self, start_us=self.start_us + math.floor(total), start_fraction=total - math.floor(total))

    def nbytes(self, samples: int) -> int:
        return samples * self.nbit * self.npol * self.nchan * self.ndim // 8

    def nsamples(self, size: int) -> int:
        return size * 8 // (self.nbit * self.npol * self.nchan * self.ndim)

    def unswapped(self, ichan: int) -> int:
        """The channel's place in order of frequency."""
        if self.swap:
            ichan = (ichan + self.nchan // 2) % self.nchan
        if self.nsub_swap:
            size = self.nchan // self.nsub_swap
            ichan = ichan // size * size + (ichan % size + size // 2) % size
        return ichan

    @property
    def lowest(self) -> float:
        """Centre frequency of the channel that comes first in order of frequency."""
        base = self.centre_frequency - self.bandwidth / 2
        return base if self.dc_centred else base + self.bandwidth / (2 * self.nchan)

    def frequency(self, ichan: int) -> float:
        return self.lowest + self.unswapped(ichan) * self.bandwidth / self.nchan

    def frequency_column(self, ichan: Column) -> Column:
        """frequency() as an expression."""
        if self.swap:
            ichan = (ichan + self.nchan // 2) % self.nchan
        if self.nsub_swap:
            size = self.nchan // self.nsub_swap
            ichan = F.floor(ichan / size) * size + (ichan % size + size // 2) % size
        return F.lit(self.lowest) + ichan * (self.bandwidth / self.nchan)

    def combinable(self, other: Observation) -> bool:
        """Whether data under both headers can stand in one table."""
        loose = {"ndat", "start_us", "start_fraction", "identifier", "history", "scale"}
        close = {"centre_frequency", "bandwidth", "rate", "dispersion_measure", "rotation_measure", "calfreq"}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            if f.name in close and not math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or f.name not in loose | close and a != b:
                return False
        return True

    def contiguous(self, other: Observation) -> bool:
        """Whether other begins where this ends, to within 0.9 of a sample."""
        gap = (other.start_us - self.end_us + other.start_fraction) / 1e6
        return self.combinable(other) and abs(gap) < 0.9 / self.rate

    def patched(self, **changes) -> Observation:
        """With the changes that aren't None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Signal:
    """Samples, their header and, where some don't count, their weights, which operators carry on. data
    is long: idat, ichan, ipol and v, or re and im."""

    data: DataFrame
    obs: Observation
    weights: Weights | None = None

    def then(self, operator, *args, **kwargs) -> Signal:
        out = operator(self, *args, **kwargs)
        return replace(out, obs=replace(out.obs, history=(*self.obs.history, operator.__name__)))

    def good(self) -> DataFrame:
        """The data whose weight isn't 0."""
        return self.weights.good(self.data) if self.weights else self.data

    def weighing(self, change: Callable[[Weights], Weights]) -> Weights | None:
        """The weights changed, where there are any."""
        return change(self.weights) if self.weights else None
