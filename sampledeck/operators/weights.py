"""Integer weights for blocks of samples, and excision by counts of low states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.functions.quantizers import two_bit_levels as levels_for
from sampledeck.operators.scrunch import quotient
from sampledeck.plans.observation import Signal
from sampledeck.plans.weights import Weights


def block_of(samples: int, offset: int = 0) -> Column:
    return F.expr(f"(idat + {int(offset)}) div {int(samples)}")


def weighted(signal: Signal, weights: DataFrame, samples: int, offset: int = 0) -> DataFrame:
    """The samples with their block's weight; an equi-join on the block's number, and on channel
    and polarization where the weights have them. Blocks without a weight get 1."""
    keys = ["iweight", *(k for k in ("ichan", "ipol") if k in weights.columns)]
    rows = signal.data.withColumn("iweight", block_of(samples, offset))
    return rows.join(weights, keys, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))


def drop_bad(signal: Signal, weights: DataFrame, samples: int, offset: int = 0) -> Signal:
    """Only the samples whose weight isn't 0."""
    rows = weighted(signal, weights, samples, offset).filter("weight <> 0")
    return Signal(rows.select(*signal.data.columns), signal.obs, signal.weights)


def mask_across(weights: DataFrame, across: tuple[str, ...] = ("ichan", "ipol")) -> DataFrame:
    """A block bad in any of those dimensions is bad in all: one weight for what is left."""
    keys = [c for c in weights.columns if c not in (*across, "weight")]
    return weights.groupBy(*keys).agg(F.min("weight").alias("weight"))


def convolved(weights: DataFrame, samples: int, nfft: int, step: int, blocks: int) -> DataFrame:
    """Weights of overlap-save blocks: block b takes samples from b * step to b * step + nfft, and
    any bad sample in them makes it bad. Each weight goes to the few blocks that it touches."""
    first, last = F.col("iweight") * samples, F.col("iweight") * samples + (samples - 1)
    low = F.greatest(F.lit(0), F.ceil((first - (nfft - 1)) / step)).cast("long")
    high = F.least(F.lit(blocks - 1), F.floor(last / step)).cast("long")
    rows = weights.select("weight", low.alias("low"), high.alias("high")).filter("low <= high").select("weight", F.explode(F.sequence("low", "high")).alias("iblock"))
    return rows.groupBy("iblock").agg(F.min("weight").alias("weight"))


def scrunched(weights: DataFrame, factor: int) -> DataFrame:
    """Weights of groups of blocks: the sum, or 0 if any is 0."""
    keys = [c for c in ("ichan", "ipol") if c in weights.columns]
    return weights.groupBy(quotient("iweight", factor).alias("iweight"), *keys).agg(F.when(F.min("weight") == 0, 0).otherwise(F.sum("weight")).cast("long").alias("weight"))


def low_counts(signal: Signal, samples: int, threshold: float) -> DataFrame:
    """By block, channel and polarization: n and nlow, the values (v, or re and im of a sample) under
    the threshold in size."""
    rows = signal.data.withColumn("iweight", block_of(samples))
    parts = ("re", "im") if signal.obs.state == "Analytic" else ("v",)
    low = sum((F.count_if(F.abs(c) < threshold) for c in parts[1:]), F.count_if(F.abs(parts[0]) < threshold))
    return rows.groupBy("iweight", "ichan", "ipol").agg((F.count("*") * len(parts)).alias("n"), low.alias("nlow"))


def excise(signal: Signal, samples: int, threshold: float, least: float, most: float) -> DataFrame:
    """The samples with weight 0 and value 0 where the block's share of low states is outside
    least..most."""
    share = F.col("nlow") / F.col("n")
    weights = low_counts(signal, samples, threshold).select("iweight", "ichan", "ipol", F.when(share.between(least, most), 1).otherwise(0).alias("weight"))
    rows = weighted(signal, weights, samples)
    return rows.select("idat", "ichan", "ipol", F.when(F.col("weight") == 0, 0.0).otherwise(F.col("v")).alias("v"), "weight")


def excised(signal: Signal, samples: int, threshold: float, least: float, most: float, together: bool = True) -> Signal:
    """signal with weights: 0 for blocks whose share of low states is outside least..most, and their
    samples 0. together: a block that is bad in one channel or polarization is so in all. Samples
    after the last whole block are judged by what there is of it."""
    share = F.col("nlow") / F.col("n")
    bad = low_counts(signal, samples, threshold).filter(~share.between(least, most)).select("iweight", "ichan", "ipol", F.lit(0).alias("weight"))
    weights = Weights(bad, samples)
    weights = weights.across("ichan", "ipol") if together else weights
    return Signal(zeroed(Signal(signal.data, signal.obs, weights)), signal.obs, weights)


def zeroed(signal: Signal) -> DataFrame:
    """signal's data with 0 for the samples of weight 0. For weights that were never shifted."""
    weights = signal.weights
    rows = signal.data.withColumn("iweight", block_of(weights.samples, weights.offset)).join(weights.bad().withColumn("_bad", F.lit(True)), ["iweight", *weights.keys], "left")
    values = {c: F.when(F.col("_bad"), 0.0).otherwise(F.col(c)) for c in signal.data.columns if c in ("v", "re", "im")}
    return rows.withColumns(values).select(*signal.data.columns)


def two_bit_levels(signal: Signal, samples: int, levels: DataFrame) -> DataFrame:
    """Two-bit samples (code 0..3) with output levels by their block's count of low codes (1 and 2):
    levels has a row for each nlow, with lo and hi. Counts outside the table give weight 0."""
    rows = signal.data.withColumn("iweight", block_of(samples))
    low = rows.groupBy("iweight", "ichan", "ipol").agg(F.count_if(F.col("code").isin(1, 2)).alias("nlow"))
    known = low.join(levels, "nlow", "left")
    joined = rows.join(known, ["iweight", "ichan", "ipol"])
    level = F.when(F.col("code").isin(1, 2), F.col("lo")).otherwise(F.col("hi")) * F.when(F.col("code") < 2, -1.0).otherwise(1.0)
    return joined.select("idat", "ichan", "ipol", F.coalesce(level, F.lit(0.0)).alias("v"), F.when(F.col("lo").isNull(), 0).otherwise(1).alias("weight"))


def dynamic_levels(spark: SparkSession, samples: int, least: float = 0.3, most: float = 0.9) -> DataFrame:
    """nlow, lo, hi for two_bit_levels(): of blocks of that many samples, the output levels that
    follow the power that a count of low codes tells; shares outside least..most have none."""
    counts = [k for k in range(1, samples) if least <= k / samples <= most]
    return spark.createDataFrame([(k, *levels_for(k / samples)) for k in counts], "nlow long, lo double, hi double")
