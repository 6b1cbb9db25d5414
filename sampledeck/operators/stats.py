"""Statistics by channel and polarization, rescaling, histograms and digitizer levels."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampledeck.operators.scrunch import quotient
from sampledeck.plans.observation import Signal

KEYS = ("ichan", "ipol")


def channel_stats(signal: Signal) -> DataFrame:
    """ichan, ipol, n, mean and sigma (of the population)."""
    return signal.data.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"))


def bandpass(signal: Signal) -> DataFrame:
    """Total of detected data by channel and polarization."""
    return signal.data.groupBy(*KEYS).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def moments(data: DataFrame, *keys: str) -> DataFrame:
    """Per group: offset = -mean and scale = 1 / sigma, 1 where the variance is 0."""
    sigma = F.stddev_pop("v")
    return data.groupBy(*keys).agg((-F.avg("v")).alias("offset"), F.when(sigma > 0, F.lit(1.0) / sigma).otherwise(1.0).alias("scale"))


def rescale(signal: Signal, samples: int | None = None, constant: bool = False) -> Signal:
    """Zero mean and unit variance by channel and polarization, in intervals of `samples` samples of
    the whole series' count; constant: by the first interval's moments throughout.

    The moments have a row an interval, channel and polarization: Spark broadcasts them if small and
    else joins by sorting.
    """
    samples = samples or max(1, signal.obs.ndat)
    data = signal.data.withColumn("interval", quotient("idat", samples))
    if constant:
        known = moments(data.filter(F.col("interval") == 0), *KEYS)
        joined = data.join(known, list(KEYS))
    else:
        known = moments(data, "interval", *KEYS)
        joined = data.join(known, ["interval", *KEYS])
    return Signal(joined.select("idat", *KEYS, ((F.col("v") + F.col("offset")) * F.col("scale")).alias("v")), replace(signal.obs, scale=1.0), signal.weights)


def rescale_updates(signal: Signal, samples: int) -> tuple[DataFrame, DataFrame]:
    """What a monitor of rescale() records at each interval's end: (interval, at_us, ichan, ipol, mean,
    sigma), and (interval, at_us, idat, ipol, total over channels). Both are sums by interval."""
    obs = signal.obs
    at = lambda interval: (F.lit(obs.start_us) + F.floor((interval + 1) * samples * 1e6 / obs.rate)).cast("long")
    data = signal.data.withColumn("interval", quotient("idat", samples))
    bands = data.groupBy("interval", *KEYS).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"))
    times = data.groupBy("interval", "idat", "ipol").agg(F.sum("v").alias("total"))
    return bands.select("interval", at(F.col("interval")).alias("at_us"), *KEYS, "mean", "sigma"), times.select("interval", at(F.col("interval")).alias("at_us"), "idat", "ipol", "total")


def time_totals(signal: Signal) -> DataFrame:
    """Sum over channels and polarizations by sample."""
    return signal.data.groupBy("idat").agg(F.sum("v").alias("total"))


def decay_baseline(signal: Signal, samples: float, block: int = 65536) -> Signal:
    """Samples less a baseline that follows them with a decay of that many samples:
    b = b + (v - b) / samples, from b = the first v, by channel and polarization in order of idat.

    A step is affine in b, so a block of sample numbers is too. A row a block carries the baseline
    on from block to block; the samples are taken in groups of a block that start from it.
    """
    import numpy as np
    import pandas as pd

    weight = 1.0 / samples

    def alone(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the values that aren't missing, the baseline of a block that begins with
        itself, and after each value the share in it of the baseline at the first one."""
        known = np.flatnonzero(~np.isnan(v))
        share = np.ones(len(v))
        old = (1.0 - weight) ** np.diff(known)
        share[known[1:]] = old / (old + weight)
        return known, pd.Series(v).ewm(alpha=weight, adjust=False).mean().to_numpy(), np.cumprod(share)

    def joined(base: float, gap: int, lead: int, value: float) -> float:
        """The baseline at a block's first value: missing values make the one before count less."""
        if np.isnan(base):
            return value
        old = (1.0 - weight) ** (gap + lead + 1)
        return (old * base + weight * value) / (old + weight)

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("idat", kind="stable")["v"].to_numpy(float)
        known, base, share = alone(v)
        some = len(known) > 0
        ends = (int(known[0]), v[known[0]], base[-1], share[-1], len(v) - 1 - int(known[-1])) if some else (len(v), np.nan, np.nan, 1.0, 0)
        return pd.DataFrame([(*rows[["_block", *KEYS]].iloc[0], some, *ends)], columns=["_block", *KEYS, "some", "lead", "value", "last", "share", "trail"])

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        base, gap, out = np.nan, 0, []
        rows = rows.sort_values("at")
        for x in rows.itertuples(index=False):
            out.append((base, gap))
            if x.some:
                base, gap = x.last + x.share * (joined(base, gap, x.lead, x.value) - x.value), x.trail
            else:
                gap += x.lead
        return pd.DataFrame({"at": rows["at"].to_numpy(), **{k: rows[k].to_numpy() for k in KEYS}, "base": [x[0] for x in out], "gap": [x[1] for x in out]})

    def follow(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idat", kind="stable")
        v, (before, gap) = rows["v"].to_numpy(float), start[["base", "gap"]].iloc[0]
        known, base, share = alone(v)
        if len(known):
            first = v[known[0]]
            base = base + share * (joined(before, int(gap), int(known[0]), first) - first)
        return rows.assign(v=v - base)[["idat", *KEYS, "v"]]

    data = signal.data.select("idat", *KEYS, F.col("v").cast("double").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    blocks = data.withColumn("_block", quotient("idat", block).cast("long"))
    ends = blocks.groupBy("_block", *KEYS).applyInPandas(summary, f"_block long, {keys}, some boolean, lead long, value double, last double, share double, trail long")
    ends = ends.withColumnRenamed("_block", "at")
    starts = ends.groupBy(*KEYS).applyInPandas(carried, f"at long, {keys}, base double, gap long").withColumnRenamed("at", "_block")
    return Signal(blocks.groupBy("_block", *KEYS).cogroup(starts.groupBy("_block", *KEYS)).applyInPandas(follow, data.schema), signal.obs, signal.weights)


def histogram(signal: Signal, low: float, high: float, bins: int) -> DataFrame:
    """Counts by channel, polarization and bin of equal width; values outside go to the end bins."""
    code = F.floor((F.col("v") - low) * bins / (high - low))
    code = F.greatest(F.lit(0), F.least(F.lit(bins - 1), code)).cast("int")
    return signal.data.groupBy(*KEYS, code.alias("code")).agg(F.count("*").alias("n"))


def level_stats(signal: Signal) -> DataFrame:
    """Mean, variance and power of each digitizer (channel and polarization)."""
    return signal.data.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.avg(F.col("v") * F.col("v")).alias("power"))


def gain_correction(signal: Signal, variance: float = 1.0) -> DataFrame:
    """Gain that brings each digitizer to that variance, and the offset to take off first."""
    stats = level_stats(signal)
    return stats.select(*KEYS, "mean", F.when(F.col("variance") > 0, F.sqrt(F.lit(variance) / F.col("variance"))).otherwise(1.0).alias("gain"))


def level_monitor(signal: Signal, variance: float = 1.0) -> DataFrame:
    """The gains and offsets with which every digitizer has no mean and that variance. One pass of
    moments gives them: what they are applied to has exactly these, so nothing is left to iterate."""
    return gain_correction(signal, variance)


def running_moments(signal: Signal, samples: int, blocks: int) -> DataFrame:
    """Mean and sigma of each block of samples over it and the blocks before it, `blocks` in all.
    Windows run over one row a block, not over samples."""
    data = signal.data.withColumn("block", quotient("idat", samples))
    sums = data.groupBy("block", *KEYS).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    w = Window.partitionBy(*KEYS).orderBy("block").rowsBetween(1 - blocks, 0)
    n, s, q = (F.sum(c).over(w) for c in ("n", "s", "q"))
    return sums.select("block", *KEYS, (s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sigma"))


def median_birdies(signal: Signal, half_window: int = 8, sigmas: float = 4.0) -> DataFrame:
    """Channels whose bandpass stands off the running median of their neighbours by more than
    `sigmas` of the residuals' spread: ichan, ipol, total, baseline, bad. One row a channel."""
    near = Window.partitionBy("ipol").orderBy("ichan").rowsBetween(-half_window, half_window)
    total = bandpass(signal).select(*KEYS, "total").withColumn("baseline", F.percentile("total", F.lit(0.5)).over(near))
    spread = F.sqrt(F.avg((F.col("total") - F.col("baseline")) * (F.col("total") - F.col("baseline"))).over(Window.partitionBy("ipol")))
    return total.withColumn("bad", F.abs(F.col("total") - F.col("baseline")) > F.lit(sigmas) * spread)


def birdies(total: np.ndarray, half_window: int, cutoff: float) -> np.ndarray:
    """Which of a bandpass's channels, in order, stand off, found again and again: residuals from a
    running median beyond cutoff standard deviations, or twice that off the channel before (the one
    further from the median goes), until no more are found."""
    good = np.ones(len(total), bool)
    if not len(total):
        return good
    padded = np.pad(total, half_window, mode="reflect" if len(total) > half_window else "edge")
    residual = total - np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half_window + 1), axis=1)
    while good.any():
        sigma = math.sqrt(float(np.mean(residual[good] ** 2)))
        before = np.concatenate([residual[:1], residual[:-1]])
        jump = (np.abs(residual - before) > 2 * cutoff * sigma) & (np.abs(residual) >= np.abs(before))
        bad = good & ((np.abs(residual) > cutoff * sigma) | jump)
        if not bad.any():
            break
        good &= ~bad
    return ~good


def birdie_channels(signal: Signal, half_window: int = 8, cutoff: float = 4.0) -> list[int]:
    """Channels to zap over the whole series, see birdies(). The bandpass (a row a channel and
    polarization) is all that the driver holds."""
    rows = bandpass(signal).groupBy("ichan").agg(F.sum("total").alias("total")).orderBy("ichan").toPandas()
    return [int(c) for c in rows["ichan"].to_numpy()[birdies(rows["total"].to_numpy(float), half_window, cutoff)]]


def birdie_mask(signal: Signal, samples: int, half_window: int = 8, cutoff: float = 4.0) -> DataFrame:
    """ipart, ichan: the channels that stand off in each interval of that many samples, see birdies(). A
    task gets an interval's bandpass, a row a channel; samples only meet in its partial sums."""
    totals = signal.data.groupBy(quotient("idat", samples).alias("ipart"), "ichan").agg(F.sum("v").alias("total"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ichan")
        return table.filter(pa.array(birdies(table.column("total").to_numpy(), half_window, cutoff))).select(["ipart", "ichan"])

    return totals.groupBy("ipart").applyInArrow(run, "ipart long, ichan int")
