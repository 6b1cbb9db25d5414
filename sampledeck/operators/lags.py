"""Spectra from autocorrelation lags, with the correction for coarse quantizers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampledeck.functions.quantizers import surface


def one_bit_correction(value, zero_lag):
    """The correlation of the signals behind one-bit samples: sin(pi/2 r) of the measured r."""
    return zero_lag * F.sin(F.lit(math.pi / 2) * value / zero_lag)


def lag_spectra(lags: DataFrame, nlag: int, *keys: str, one_bit: bool = False) -> DataFrame:
    """keys, ichan, v: the even (cosine) transform of lags 0..nlag-1 (keys, lag, r), nlag channels.
    A group's nlag values gather into one array; groups without all lags are dropped."""
    cells = lags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("cells")).filter(F.size("cells") == nlag)
    rows = cells.select(*keys, F.col("cells.r").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(nlag - 1))).alias("ichan"))
    zero = F.element_at("r", 1)
    term = lambda x, k: F.when(k == 0, x).otherwise(2.0 * (one_bit_correction(x, zero) if one_bit else x) * F.cos(F.lit(math.pi / nlag) * k * (F.col("ichan") + 0.5)))
    return rows.select(*keys, "ichan", F.aggregate(F.transform("r", term), F.lit(0.0), lambda a, b: a + b).alias("v"))


def cubic(part: Column) -> list[Column]:
    """Weights of four evenly spaced points of which the second is `part` of a step before the place."""
    return [
        -part * (part - 1) * (part - 2) / 6, (part + 1) * (part - 1) * (part - 2) / 2,
        -(part + 1) * part * (part - 2) / 2, (part + 1) * part * (part - 1) / 6,
    ]


def quantizer_corrected(lags: DataFrame, nlag: int, levels: int, *keys: str) -> DataFrame:
    """keys, lag, r: correlations of the samples behind quantized ones of an odd number of levels,
    from the mean products (keys, lag, r) of the quantized. Groups without all lags are dropped, as
    are those whose zero lag no quantizer of so many levels gives, with its steps between 0.02 and 8
    standard deviations apart.

    The relation is worked out once, on a surface of fixed size by zero lag and lag, and looked up in
    column expressions: a group meets the four rows around its zero lag by an equi-join with a
    broadcast table, and each lag takes a cubic between four points of each."""
    first, step, angles = surface(levels)
    rows, points = angles.shape
    cells = lags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "r"))).alias("cells")).filter(F.size("cells") == nlag)
    zero, most = F.element_at("cells", 1)["r"], float((levels // 2) ** 2)
    place = (F.log(zero / (most - zero)) - first) / step
    cells = cells.filter((zero > 0) & (zero < most)).select(*keys, F.col("cells.r").alias("r"), zero.alias("_zero"), place.alias("_place")).filter((F.col("_place") >= 0) & (F.col("_place") <= rows - 1))
    row = F.least(F.greatest(F.floor("_place"), F.lit(1)), F.lit(rows - 3)).cast("int")
    near = {f"_t{j}": list(angles[j : rows - 3 + j]) for j in range(4)}
    table = lags.sparkSession.createDataFrame(pa.table({"_row": pa.array(np.arange(1, rows - 2), pa.int32()), **{k: pa.array(v, pa.list_(pa.float64())) for k, v in near.items()}}))
    joined = cells.withColumn("_row", row).join(F.broadcast(table), "_row").withColumn("_part", F.col("_place") - F.col("_row"))

    def look(x: Column) -> Column:
        at = (F.least(F.greatest(x / F.col("_zero"), F.lit(-1.0)), F.lit(1.0)) + 1) * ((points - 1) / 2)
        low = F.least(F.greatest(F.floor(at), F.lit(1)), F.lit(points - 3)).cast("int")
        across = cubic(at - low)
        return F.sin(sum((w * sum((v * F.element_at(f"_t{j}", low + k) for k, v in enumerate(across)), F.lit(0.0)) for j, w in enumerate(cubic(F.col("_part")))), F.lit(0.0)))

    out = joined.select(*keys, F.posexplode(F.transform("r", lambda x, k: F.when(k == 0, F.lit(1.0)).otherwise(look(x)))).alias("lag", "r"))
    return out.withColumn("lag", F.col("lag").cast("int"))
