"""Polarization calibration: receivers' parameters from a reference signal, and the responses that
undo them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampledeck.functions.responses import single_axis, undone
from sampledeck.plans.observation import Signal


def receiver_parameters(products: Signal, on=None) -> DataFrame:
    """ichan, gain (of the first probe), ratio (the second's to it), phase (the second against the
    first, radians): of a receiver whose linear probes see a reference signal of unit power at 45
    degrees. products: coherence products (pp, qq, re, im). on: where the reference is on; what is
    measured where it isn't true is taken off. A channel without power gets nulls."""
    columns = ("pp", "qq", "re", "im")
    if on is None:
        mean = {c: F.avg(c) for c in columns}
    else:
        mean = {c: F.avg(F.when(on, F.col(c))) - F.avg(F.when(~on, F.col(c))) for c in columns}
    found = products.data.groupBy("ichan").agg(*[mean[c].alias(c) for c in columns])
    ok = (F.col("pp") > 0) & (F.col("qq") > 0)
    return found.select("ichan", F.when(ok, F.sqrt(2 * F.col("pp"))).alias("gain"), F.when(ok, F.sqrt(F.col("qq") / F.col("pp"))).alias("ratio"), F.when(ok, F.atan2("im", "re")).alias("phase"))


def calibration_responses(parameters: DataFrame, points: int) -> dict[int, np.ndarray]:
    """For each channel of receiver_parameters() the (points, 2, 2) response that undoes it. A row a
    channel comes to the driver."""
    out = {}
    for row in parameters.filter("gain is not null").collect():
        jones = undone(single_axis(*(np.array([row[c]]) for c in ("gain", "ratio", "phase"))))[0]
        out[row["ichan"]] = np.broadcast_to(jones, (points, 2, 2))
    return out


def calibrated(signal: Signal, parameters: DataFrame) -> Signal:
    """Voltages of two polarizations with their channel's receiver undone, sample by sample: each
    probe over its own gain. Channels without parameters are dropped."""
    first = F.col("ipol") == 0
    gain = F.when(first, F.col("gain")).otherwise(F.col("gain") * F.col("ratio"))
    turn = F.when(first, 0.0).otherwise(-F.col("phase"))
    rows = signal.data.join(parameters.filter("gain is not null"), "ichan")
    c, s = F.cos(turn) / gain, F.sin(turn) / gain
    return Signal(rows.select("idat", "ichan", "ipol", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im")), signal.obs, signal.weights)
