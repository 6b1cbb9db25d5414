"""Detection of voltages, products of polarizations and their moments."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from sampledeck.plans.observation import Signal

STOKES = ("s0", "s1", "s2", "s3")
PRODUCTS = tuple((i, j) for i in range(4) for j in range(i, 4))


def square_law(signal: Signal) -> Signal:
    """Power of each polarization: v^2, or re^2 + im^2. Detected data stay as they are."""
    if signal.obs.detected:
        return signal
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im") if signal.obs.state == "Analytic" else F.col("v") * F.col("v")
    obs = signal.obs
    state = "PPQQ" if obs.npol == 2 else "Intensity"
    return Signal(signal.data.select("idat", "ichan", "ipol", power.alias("v")), replace(obs, state=state, ndim=1), signal.weights)


def intensity(signal: Signal) -> Signal:
    """Total power: the polarizations' powers, added."""
    if signal.obs.state == "Intensity":
        return signal
    power = square_law(signal)
    data = power.data.groupBy("idat", "ichan").agg(F.sum("v").alias("v")).withColumn("ipol", F.lit(0))
    return Signal(data.select("idat", "ichan", "ipol", "v"), power.obs.with_state("Intensity"), power.weighing(lambda w: w.across("ipol")))


def nth_power(signal: Signal) -> Signal:
    """The square of total power."""
    total = intensity(signal)
    return Signal(total.data.withColumn("v", F.col("v") * F.col("v")), total.obs.with_state("NthPower"), total.weights)


def polarization_pairs(signal: Signal, *columns: str):
    """A row for each sample and channel with both polarizations' columns, suffixed 0 and 1. One
    hash aggregation instead of a self-join; a polarization that isn't there gives nulls."""
    cells = [F.max(F.when(F.col("ipol") == p, F.col(c))).alias(f"{c}{p}") for p in (0, 1) for c in columns]
    return signal.data.groupBy("idat", "ichan").agg(*cells)


def coherence(signal: Signal) -> Signal:
    """PP, QQ, Re and Im of the product of polarization 0 with polarization 1's conjugate."""
    pairs = polarization_pairs(signal, "re", "im")
    p0, p1 = [(F.col(f"re{p}"), F.col(f"im{p}")) for p in (0, 1)]
    products = {"pp": p0[0] * p0[0] + p0[1] * p0[1], "qq": p1[0] * p1[0] + p1[1] * p1[1], "re": p0[0] * p1[0] + p0[1] * p1[1], "im": p0[0] * p1[1] - p0[1] * p1[0]}
    return Signal(pairs.select("idat", "ichan", *[c.alias(k) for k, c in products.items()]), replace(signal.obs.with_state("Coherence"), ndim=4, npol=1), signal.weighing(lambda w: w.across("ipol")))


def stokes(signal: Signal) -> Signal:
    """Stokes parameters s0 = PP+QQ, s1 = PP-QQ, s2 = 2 Re, s3 = 2 Im."""
    products = coherence(signal) if signal.obs.state != "Coherence" else signal
    pp, qq, re, im = (F.col(c) for c in ("pp", "qq", "re", "im"))
    columns = [c.alias(k) for k, c in zip(STOKES, (pp + qq, pp - qq, 2 * re, 2 * im), strict=True)]
    return Signal(products.data.select("idat", "ichan", *columns), replace(products.obs, state="Stokes"), products.weights)


def fourth_moment(signal: Signal) -> Signal:
    """The Stokes parameters and their ten products m<i><j>, i <= j."""
    if signal.obs.state != "Stokes":
        raise ValueError("fourth moments are of Stokes parameters")
    products = [(F.col(STOKES[i]) * F.col(STOKES[j])).alias(f"m{i}{j}") for i, j in PRODUCTS]
    return Signal(signal.data.select("idat", "ichan", *STOKES, *products), signal.obs.with_state("FourthMoment"), signal.weights)


def central_moments(signal: Signal, *keys: str):
    """Per group of keys: n and c<i><j> = (mean of SiSj - mean of Si times mean of Sj) / n."""
    mean: dict[str, Column] = {s: F.avg(s) for s in STOKES}
    cells = [((F.avg(f"m{i}{j}") - mean[STOKES[i]] * mean[STOKES[j]]) / F.count("*")).alias(f"c{i}{j}") for i, j in PRODUCTS]
    return signal.data.groupBy(*keys).agg(F.count("*").alias("n"), *cells)


def select_polarization(signal: Signal, ipol: int) -> Signal:
    """Only that polarization, renumbered 0. A filter, so it reaches the scan."""
    if not 0 <= ipol < signal.obs.npol:
        raise ValueError(f"polarization {ipol} of {signal.obs.npol}")
    kept = {"PPQQ": ("PP", "QQ")}.get(signal.obs.state, (signal.obs.state,) * signal.obs.npol)[ipol]
    data = signal.data.filter(F.col("ipol") == ipol).withColumn("ipol", F.lit(0))
    return Signal(data, replace(signal.obs, npol=1, state=kept), signal.weighing(lambda w: w.of_polarization(ipol)))


def reshape_products(signal: Signal) -> Signal:
    """Products side by side to a row for each: ipol counts them in the columns' order."""
    columns = [c for c in signal.data.columns if c not in ("idat", "ichan")]
    data = signal.data.select("idat", "ichan", F.posexplode(F.array(*columns)).alias("ipol", "v"))
    return Signal(data, replace(signal.obs, ndim=1, npol=len(columns)), signal.weights)
