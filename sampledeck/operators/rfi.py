"""Interference: spectral kurtosis estimates, masks from them, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampledeck.functions.numeric import sk_limits, sk_variance
from sampledeck.operators.scrunch import quotient
from sampledeck.plans.observation import Signal


def estimate(s1: Column, s2: Column, m: Column | int) -> Column:
    """(m+1)/(m-1) (m S2/S1^2 - 1), 0 where S1 is 0."""
    m = F.lit(float(m)) if isinstance(m, int) else m.cast("double")
    return F.when(s1 == 0, 0.0).otherwise((m + 1) / (m - 1) * (m * s2 / (s1 * s1) - 1))


def kurtosis(power: Signal, m: int, first: int = 0) -> DataFrame:
    """sk and its sums by ipart (of m samples from `first` on), channel and polarization; whole
    parts only."""
    ndat = (power.obs.ndat - first) // m * m
    data = power.data.filter((F.col("idat") >= first) & (F.col("idat") < first + ndat)).withColumn("ipart", F.expr(f"(idat - {int(first)}) div {int(m)}"))
    sums = data.groupBy("ipart", "ichan", "ipol").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    return sums.withColumn("sk", estimate(F.col("s1"), F.col("s2"), m))


def block_kurtosis(sk: DataFrame, m: int, parts: int) -> DataFrame:
    """sk over blocks of `parts` parts, from the parts' sums: iblock, channel, polarization."""
    n = F.count("*") * m
    return sk.groupBy(quotient("ipart", parts).alias("iblock"), "ichan", "ipol").agg(estimate(F.sum("s1"), F.sum("s2"), n).alias("sk"), n.alias("n"))


def outside(sk: Column, limits: tuple[float, float]) -> Column:
    return (sk < limits[0]) | (sk > limits[1])


def mask_parts(sk: DataFrame, limits: tuple[float, float]) -> DataFrame:
    """(ipart, ichan) where any polarization leaves the limits."""
    return sk.filter(outside(F.col("sk"), limits)).select("ipart", "ichan").distinct()


def mask_blocks(sk: DataFrame, m: int, parts: int, sigmas: float = 3.0, ndat: int | None = None) -> DataFrame:
    """(iblock, ichan) where the whole block's estimate leaves its own, narrower limits. Every block
    is judged by the limits for the samples that it has. ndat: samples of the series, which tell the
    size of the last block; where it isn't given the sizes are looked up."""
    found = block_kurtosis(sk, m, parts)
    if ndat is None:
        sizes = [r["n"] for r in found.select("n").distinct().collect()]
    else:
        sizes = {min(parts, ndat // m) * m, ndat // m % parts * m} - {0}  # the full size and the last block's
    bad = F.lit(False)
    for n in sizes:
        bad = bad | ((F.col("n") == n) & outside(F.col("sk"), sk_limits(int(n), sigmas)))
    return found.filter(bad).select("iblock", "ichan").distinct()


def spread_limit(m: int, sigmas: float, count: Column) -> Column:
    return (1.0 + sigmas) * F.sqrt(F.lit(sk_variance(m)) / count)


def mask_times(sk: DataFrame, masked: DataFrame, m: int, sigmas: float = 3.0, channels: tuple[int, int] | None = None) -> DataFrame:
    """iparts of which the mean estimate over channels not masked yet, in the range, leaves
    1 +- (1 + sigmas) sqrt(variance / count) in any polarization."""
    rows = sk if channels is None else sk.filter(F.col("ichan").between(channels[0], channels[1] - 1))
    means = rows.join(masked, ["ipart", "ichan"], "left_anti").groupBy("ipart", "ipol").agg(F.avg("sk").alias("mean"), F.count("*").alias("n"))
    return means.filter(F.abs(F.col("mean") - 1) > spread_limit(m, sigmas, F.col("n"))).select("ipart").distinct()


def mask_all(sk: DataFrame, m: int, parts: int, sigmas: float = 3.0, times: bool = True, blocks: bool = True, single: bool = True, ndat: int | None = None) -> DataFrame:
    """(ipart, ichan) flagged by whole blocks, single parts and then whole times, in that order;
    each step can be left out. ndat as in mask_blocks()."""
    spots = sk.select("ipart", "ichan").distinct()
    flagged = spots.limit(0)
    if blocks:
        flagged = flagged.union(spots.withColumn("iblock", quotient("ipart", parts)).join(mask_blocks(sk, m, parts, sigmas, ndat), ["iblock", "ichan"], "left_semi").select("ipart", "ichan"))
    if single:
        flagged = flagged.union(mask_parts(sk, sk_limits(m, sigmas)))
    flagged = flagged.distinct()
    if times:
        flagged = flagged.union(spots.join(mask_times(sk, flagged, m, sigmas), "ipart", "left_semi")).distinct()
    return flagged


def mark(signal: Signal, mask: DataFrame, m: int, offset: int = 0) -> DataFrame:
    """The samples as they are with zapped, whether their (ipart, ichan) is masked."""
    part = F.expr(f"(idat + {int(offset)}) div {int(m)}")
    rows = signal.data.withColumn("ipart", part).join(mask.select("ipart", "ichan", F.lit(True).alias("hit")), ["ipart", "ichan"], "left")
    return rows.withColumn("zapped", F.col("hit").isNotNull()).drop("ipart", "hit").select(*signal.data.columns, "zapped")


def apply_mask(signal: Signal, mask: DataFrame, m: int, offset: int = 0) -> DataFrame:
    """The samples with those of masked (ipart, ichan) set to 0, and zapped, whether they were."""
    rows = mark(signal, mask, m, offset)
    return rows.select("idat", "ichan", "ipol", F.when(F.col("zapped"), 0.0).otherwise(F.col("v")).alias("v"), "zapped")


def drop_masked(signal: Signal, mask: DataFrame, m: int) -> Signal:
    """Only the samples that aren't masked."""
    rows = signal.data.withColumn("ipart", quotient("idat", m)).join(mask.select("ipart", "ichan"), ["ipart", "ichan"], "left_anti")
    return Signal(rows.select(*signal.data.columns), signal.obs, signal.weights)


def mask_counts(masked: DataFrame) -> DataFrame:
    """By channel and polarization: sums and hits of all samples and of those left."""
    left = ~F.col("zapped")
    return masked.groupBy("ichan", "ipol").agg(F.count("*").alias("hits"), F.count_if(left).alias("hits_left"), F.sum("v").alias("sum_left"), F.count_if(~left).alias("hits_zapped"))


def zap_by_estimate(signal: Signal, sk: DataFrame, m: int, factor: float = 3.0, most: int = 30, far: float = 10.0) -> DataFrame:
    """As apply_mask: a (ipart, ichan) is zapped if any polarization leaves 1 +- factor * sigma, and
    a whole ipart if more than `most` of its channels leave 1 +- far * sigma."""
    sigma = sk_variance(m) ** 0.5
    off = F.abs(F.col("sk") - 1)
    spots = sk.groupBy("ipart", "ichan").agg(F.bool_or(off > factor * sigma).alias("bad"), F.bool_or(off > far * sigma).alias("very"))
    whole = spots.groupBy("ipart").agg(F.count_if("very").alias("n")).filter(F.col("n") > most).select("ipart", F.lit(True).alias("whole"))
    mask = spots.join(whole, "ipart", "left").filter("bad or whole").select("ipart", "ichan")
    return apply_mask(signal, mask, m)
