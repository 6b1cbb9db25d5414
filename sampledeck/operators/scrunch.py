"""Sums over neighbouring samples, channels and polarizations, and selections of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sampledeck.plans.observation import Signal
from sampledeck.plans.weights import followed


def quotient(column: str, by: int) -> Column:
    return F.expr(f"{column} div {int(by)}")


def _detected(signal: Signal) -> None:
    if not signal.obs.detected:
        raise ValueError("voltages can't be scrunched")


def factor_for(signal: Signal, microseconds: float) -> int:
    """How many samples make that time resolution: at least one."""
    return max(1, math.floor(microseconds * 1e-6 * signal.obs.rate + 0.5))


def scrunch(signal: Signal, time: int = 1, frequency: int = 1) -> Signal:
    """Sums of `time` samples and `frequency` channels at once. The samples and channels that are
    left over at the end are dropped. Both sums commute, so one aggregation makes both."""
    _detected(signal)
    if time < 1 or frequency < 1:
        raise ValueError("factors must be at least 1")
    if time == frequency == 1:
        return signal
    obs, data = signal.obs, signal.data
    if time > 1:
        data = data.filter(F.col("idat") < obs.ndat // time * time)
    if frequency > 1:
        data = data.filter(F.col("ichan") < obs.nchan // frequency * frequency)
    data = data.groupBy(quotient("idat", time).alias("idat"), quotient("ichan", frequency).cast("int").alias("ichan"), "ipol").agg(F.sum("v").alias("v"))
    kept = obs.nchan // frequency * frequency
    width = obs.bandwidth / obs.nchan if obs.nchan else 0.0
    obs = replace(obs, ndat=obs.ndat // time, rate=obs.rate / time, nchan=obs.nchan // frequency, bandwidth=width * kept, centre_frequency=obs.centre_frequency - width * (obs.nchan - kept) / 2, scale=obs.scale * time * frequency)
    return Signal(data, obs, signal.weighing(lambda w: w.scrunched(time, frequency, signal.obs)))


def tscrunch(signal: Signal, factor: int) -> Signal:
    return scrunch(signal, time=factor)


def fscrunch(signal: Signal, factor: int) -> Signal:
    return scrunch(signal, frequency=factor)


def pscrunch(signal: Signal) -> Signal:
    """The two polarizations' sum over the square root of two."""
    _detected(signal)
    if signal.obs.npol < 2 or signal.obs.ndim != 1:
        raise ValueError("two polarizations of one value each are added")
    data = signal.data.filter("ipol < 2").groupBy("idat", "ichan").agg((F.sum("v") / math.sqrt(2)).alias("v")).withColumn("ipol", F.lit(0))
    return Signal(data.select("idat", "ichan", "ipol", "v"), signal.obs.with_state("Intensity"), signal.weighing(lambda w: w.across("ipol")))


def zoom_bounds(signal: Signal, centre: float, bandwidth: float) -> tuple[int, int]:
    """The first and last channel (in order of frequency) that the band touches."""
    obs = signal.obs
    width = obs.bandwidth / obs.nchan
    lowest = obs.lowest - width / 2
    ends = sorted((centre + side * abs(bandwidth) / 2 - lowest) / width for side in (-1, 1))
    low, high = math.floor(ends[0] + 1e-9), math.ceil(ends[1] - 1e-9) - 1
    if low < 0 or high >= obs.nchan:
        raise ValueError("the band isn't within the data")
    return low, high


def zoom(signal: Signal, centre: float, bandwidth: float) -> Signal:
    """The channels that cover that band, renumbered from 0."""
    low, high = zoom_bounds(signal, centre, bandwidth)
    obs, n = signal.obs, high - low + 1
    width = obs.bandwidth / obs.nchan
    data = signal.data.filter(F.col("ichan").between(low, high)).withColumn("ichan", (F.col("ichan") - low).cast("int"))
    return Signal(data, replace(obs, nchan=n, bandwidth=width * n, centre_frequency=obs.centre_frequency + width * (low - (obs.nchan - high - 1)) / 2), signal.weighing(lambda w: w.of_channels(low, high)))


def chomp(signal: Signal, ndat: int | None = None, multiple: int = 1, by: float = 1.0) -> Signal:
    """The first samples, as many as a multiple allows, times a factor."""
    n = min(signal.obs.ndat, signal.obs.ndat if ndat is None else ndat) // multiple * multiple
    data = signal.data.filter(F.col("idat") < n)
    return Signal(data if by == 1.0 else data.withColumn("v", F.col("v") * by), replace(signal.obs, ndat=n), signal.weights)


def resize(signal: Signal, extra: int) -> Signal:
    """extra samples fewer (negative) at the end, no fewer than none. More samples than there are
    have no rows, so a positive number changes the header only."""
    n = max(0, signal.obs.ndat + extra)
    return Signal(signal.data.filter(F.col("idat") < n), replace(signal.obs, ndat=n), signal.weights)


def seek(signal: Signal, seconds: float = 0.0, total: float | None = None) -> Signal:
    """From `seconds` on, `total` seconds of it; a range filter on idat, for the scan to use."""
    rate = signal.obs.rate
    first = math.floor(seconds * rate + 0.5)
    last = signal.obs.ndat if total is None else min(signal.obs.ndat, first + math.floor(total * rate + 0.5))
    data = signal.data.filter((F.col("idat") >= first) & (F.col("idat") < last)).withColumn("idat", F.col("idat") - first)
    return Signal(data, replace(signal.obs.later(first), ndat=max(0, last - first)), signal.weighing(lambda w: w.advanced(first)))


def append(signal: Signal, other: Signal) -> Signal:
    """other's samples after signal's."""
    if not signal.obs.combinable(other.obs):
        raise ValueError("the headers don't combine")
    moved = other.data.withColumn("idat", F.col("idat") + signal.obs.ndat)
    return Signal(signal.data.unionByName(moved), replace(signal.obs, ndat=signal.obs.ndat + other.obs.ndat), followed(signal.weights, signal.obs.ndat, other.weights, signal.obs))


def accumulate(signal: Signal, capacity: int) -> Signal:
    """As many of the first samples as a buffer of that capacity takes."""
    return chomp(signal, capacity)


def accumulated(blocks: Sequence[Signal], capacity: int) -> tuple[Signal, bool, bool]:
    """Blocks appended in order until a buffer of that capacity is full: (what is in it, whether it
    is full, whether another block as long as the last would fill it). Headers alone tell; blocks
    past a full buffer are never read."""
    if not blocks:
        raise ValueError("no blocks to accumulate")
    out = blocks[0]
    for block in blocks[1:]:
        if out.obs.ndat >= capacity:
            break
        out = append(out, block)
    held = min(out.obs.ndat, capacity)
    return chomp(out, capacity), held == capacity, held + blocks[-1].obs.ndat >= capacity


def add(signal: Signal, other: Signal) -> Signal:
    """Sample by sample sums of two signals of one shape; bad in either is bad."""
    data = signal.data.unionByName(other.data).groupBy("idat", "ichan", "ipol").agg(F.sum("v").alias("v"))
    both = [followed(w, signal.obs.ndat, None, signal.obs) for w in (signal.weights, other.weights) if w]
    return Signal(data, signal.obs, replace(both[0], table=both[0].table.union(both[1].table)) if len(both) == 2 else both[0] if both else None)


def multiply(signal: Signal, by: float) -> Signal:
    """Samples times a factor, kept in the header's scale."""
    return Signal(signal.data.withColumn("v", F.col("v") * by), replace(signal.obs, scale=signal.obs.scale * by), signal.weights)


def time_order(signal: Signal, polarization_fastest: bool = False):
    """A row for each sample: idat and spec, its values by channel and polarization."""
    cell = F.struct("ipol", "ichan", "v") if not polarization_fastest else F.struct("ichan", "ipol", "v")
    rows = signal.data.groupBy("idat").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("idat", F.transform("cells", lambda c: c["v"]).alias("spec"))


def out_of_range(signal: Signal, low: float, high: float):
    """Counts of values that are no finite numbers and that lie outside low..high, by channel and
    polarization."""
    bad = F.isnan("v") | F.col("v").isNull() | (F.abs("v") == float("inf"))
    return signal.data.groupBy("ichan", "ipol").agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(~bad & ~F.col("v").between(low, high)).alias("outside"))
