"""Delays by channel: dispersion and fixed tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampledeck.functions.numeric import DISPERSION_K
from sampledeck.plans.observation import Observation, Signal


def channel_table(spark, obs: Observation) -> DataFrame:
    """ichan and freq, its centre frequency in MHz: one row a channel."""
    ichan = F.col("id").cast("int")
    return spark.range(obs.nchan).select(ichan.alias("ichan"), obs.frequency_column(F.col("id")).alias("freq"))


def delay_seconds(obs: Observation, frequency: Column, reference: Column | float | None = None) -> Column:
    """Dispersion delay against the centre frequency: positive where the channel arrives earlier."""
    against = F.lit(obs.centre_frequency) if reference is None else reference if isinstance(reference, Column) else F.lit(reference)
    return F.lit(obs.dispersion_measure / DISPERSION_K) * (F.lit(1.0) / (against * against) - F.lit(1.0) / (frequency * frequency))


def dispersion_delays(spark, obs: Observation) -> DataFrame:
    """ichan, freq and delay in samples, rounded half up (so -2.5 gives -2)."""
    table = channel_table(spark, obs)
    return table.withColumn("delay", F.floor(delay_seconds(obs, F.col("freq")) * obs.rate + 0.5).cast("long"))


def geometric_delays(spark) -> DataFrame:
    """The placeholder of two antennas: 0 and 4 samples, by polarization."""
    return spark.range(2).select(F.col("id").cast("int").alias("ipol"), (F.col("id") * 4).alias("delay"))


def smearing_table(spark, obs: Observation) -> DataFrame:
    """ichan, freq and the seconds over which dispersion spreads each channel."""
    width = abs(obs.bandwidth) / obs.nchan / 2
    f = F.col("freq")
    low, high = f - width, f + width
    return channel_table(spark, obs).withColumn("smearing", F.lit(obs.dispersion_measure / DISPERSION_K) * (F.lit(1.0) / (low * low) - F.lit(1.0) / (high * high)))


def sample_delay(signal: Signal, delays: DataFrame, absolute: bool = False) -> Signal:
    """Shifts samples by their channel's (or polarization's) delay, and drops what not all have.

    Relative: each moves back by the largest delay less its own, and the start moves on by the
    largest. Absolute: each moves back by its own delay. delays has a row a channel or polarization,
    a bounded table, so the join is a broadcast and no sample is shuffled.
    """
    keys = [k for k in ("ichan", "ipol") if k in delays.columns]
    least, most = delays.agg(F.coalesce(F.min("delay"), F.lit(0)), F.coalesce(F.max("delay"), F.lit(0))).first()
    shift = F.col("delay") if absolute else F.lit(most) - F.col("delay")
    total = max(most, 0) - min(least, 0) if absolute else most - least
    kept = max(0, signal.obs.ndat - total)
    data = signal.data.join(F.broadcast(delays.select(*keys, "delay")), keys).withColumn("idat", F.col("idat") - shift).filter((F.col("idat") >= 0) & (F.col("idat") < kept)).drop("delay")
    obs = replace(signal.obs, ndat=kept)
    moved = signal.weighing(lambda w: w.delayed(delays.select(*keys, shift.alias("shift"))))
    return Signal(data.select(*signal.data.columns), obs if absolute or not obs.rate else obs.later(most), moved)


def dedisperse(signal: Signal) -> Signal:
    """Inter-channel dispersion removed."""
    return sample_delay(signal, dispersion_delays(signal.data.sparkSession, signal.obs).select("ichan", "delay"))
