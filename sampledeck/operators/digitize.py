"""Digitizers, bit packing and the decoding of packed samples, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampledeck.operators.scrunch import quotient
from sampledeck.operators.stats import KEYS, running_moments
from sampledeck.plans.observation import Signal

#: Mean and scale that map unit variance to codes, by bits.
CODE_MEAN = {1: 0.5, 2: 1.5, 4: 7.5, 8: 127.5, 16: 32768.0}
CODE_SCALE = {1: 1.0, 2: 1.0, 4: 7.5 / 6, 8: 127.5 / 6, 16: 32768.0 / 6}
#: Outputs of the four two-bit codes, in units of the inner level, for the three
#: encodings; the outer level is that of an optimal four-level quantizer of normal samples.
OUTER = 3.3359
TWO_BIT = {"offset binary": (-OUTER, -1.0, 1.0, OUTER), "sign magnitude": (1.0, OUTER, -1.0, -OUTER), "two's complement": (1.0, OUTER, -OUTER, -1.0)}


def clipped(value: Column, bits: int) -> Column:
    """Cut towards zero after a half was added, and kept within the codes."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), value.cast("long"))).cast("int")


def digitize(signal: Signal, bits: int, factor: float = 1.0, rescaled: bool = True) -> DataFrame:
    """idat, ichan, ipol, code: samples of unit variance over the header's scale. Channels come in
    order of falling frequency. Without rescaling, products past the second straddle zero, so they
    get the codes' mean and the others don't. 32 bits: the value itself, as a float."""
    obs = signal.obs
    ichan = F.col("ichan") if obs.bandwidth <= 0 else (F.lit(obs.nchan - 1) - F.col("ichan")).cast("int")
    value = F.col("v") / (obs.scale * factor)
    if bits == 32:
        code = value.cast("float")
    else:
        mean = F.lit(CODE_MEAN[bits]) if rescaled else F.when(F.col("ipol") > 1, CODE_MEAN[bits]).otherwise(0.0)
        code = clipped(value * CODE_SCALE[bits] + mean + 0.5, bits)
    return signal.data.select("idat", ichan.alias("ichan"), "ipol", code.alias("code"))


def digitize_by_block(signal: Signal, bits: int, samples: int, blocks: int = 1) -> DataFrame:
    """As digitize, with each block's mean and sigma, or those of the last `blocks` blocks, as
    offset and scale; codes are for v = (code - mean) / scale * sigma + offset."""
    known = running_moments(signal, samples, blocks)
    rows = signal.data.withColumn("block", quotient("idat", samples)).join(known, ["block", *KEYS])
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    code = clipped((F.col("v") - F.col("mean")) / sigma * CODE_SCALE[bits] + CODE_MEAN[bits] + 0.5, bits)
    return rows.select("idat", *KEYS, code.alias("code"), F.col("mean").alias("offset"), sigma.alias("scale"))


def pack_bits(codes: DataFrame, bits: int, *keys: str, msb_first: bool = False) -> DataFrame:
    """Codes of `bits` bits (1, 2, 4 or 8) packed to bytes along idat: keys, ibyte, byte."""
    per = 8 // bits
    place = F.expr(f"idat % {per}")
    shift = (F.lit(per - 1) - place if msb_first else place) * bits
    value = F.call_function("shiftleft", F.col("code"), shift.cast("int"))
    return codes.groupBy(*keys, quotient("idat", per).alias("ibyte")).agg(F.bit_or(value).alias("byte"))


def unpack_bits(packed: DataFrame, bits: int, *keys: str, msb_first: bool = False) -> DataFrame:
    """The codes again: keys, idat, code. No shuffle: each byte explodes in place."""
    per, full = 8 // bits, (1 << bits) - 1
    rows = packed.select(*keys, "ibyte", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"), "byte")
    shift = (F.lit(per - 1) - F.col("k") if msb_first else F.col("k")) * bits
    return rows.select(*keys, (F.col("ibyte") * per + F.col("k")).alias("idat"), F.call_function("shiftright", F.col("byte"), shift.cast("int")).bitwiseAND(full).cast("int").alias("code"))


def levels(bits: int, encoding: str = "offset binary") -> list[float]:
    """The level of each code: evenly spaced about zero with unit step, or the two-bit tables."""
    if bits == 2 and encoding in TWO_BIT:
        return list(TWO_BIT[encoding])
    n = 1 << bits
    even = [k - (n - 1) / 2 for k in range(n)]
    return even[n // 2 :] + even[: n // 2] if encoding == "two's complement" else even


def decode(codes: DataFrame, bits: int, encoding: str = "offset binary") -> DataFrame:
    """v for each code, by the table of levels (for up to 8 bits) or by arithmetic."""
    if bits <= 8:
        v = F.element_at(F.array(*[F.lit(float(x)) for x in levels(bits, encoding)]), F.col("code") + 1)
    else:
        half = (1 << bits) / 2
        v = F.col("code") - (half - 0.5) if encoding != "two's complement" else F.when(F.col("code") >= half, F.col("code") - 2 * half).otherwise(F.col("code")) + 0.5
    return codes.withColumn("v", v.cast("double"))


def scale_offset(codes: DataFrame, scales: DataFrame, keys: list[str], zero: float = 0.0) -> DataFrame:
    """v = (code - zero) * scale + offset, with a row of scales for each of keys."""
    rows = codes.join(scales, keys)
    return rows.withColumn("v", (F.col("code") - zero) * F.col("scale") + F.col("offset")).drop("scale", "offset")


def one_bit(codes: DataFrame, level: float = 1.0) -> DataFrame:
    return codes.withColumn("v", F.when(F.col("code") == 1, level).otherwise(-level))


def code_histogram(codes: DataFrame) -> DataFrame:
    """Counts of the digitizers' states."""
    return codes.groupBy("ichan", "ipol", "code").agg(F.count("*").alias("n"))
