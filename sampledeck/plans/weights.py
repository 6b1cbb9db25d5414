"""Weights that travel with a signal: which stretches of samples don't count.

A weight is of a block of samples, of one channel and polarization or of all. Operators that move,
combine or transform samples move the weights along, so what was bad at the start is left out of a
fold at the end. A transform mixes all the samples that it takes, so one bad sample makes all that
it gives bad.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """table: iweight and weight, and ichan or ipol where they differ by these; what has no row weighs
    1. Sample k belongs to weight (k + offset + its shifts) div samples; channel c to that of channel
    c div channels. shifts: tables (ichan or ipol, shift) of a row a channel or polarization."""

    table: DataFrame
    samples: int
    offset: int = 0
    channels: int = 1
    shifts: tuple[DataFrame, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [k for k in ("ichan", "ipol") if k in self.table.columns]

    def bad(self) -> DataFrame:
        """The weights that are 0: iweight and the keys, each once."""
        return self.table.filter("weight = 0").select("iweight", *self.keys).distinct()

    def _with(self, bad: DataFrame, **changes) -> Weights:
        return replace(self, table=bad.withColumn("weight", F.lit(0)), **changes)

    def good(self, data: DataFrame) -> DataFrame:
        """The rows of data (idat, ichan, ipol) whose weight isn't 0. Bad blocks are few, so Spark
        broadcasts them as long as they are small."""
        at, rows = F.col("idat") + self.offset, data
        for k, shift in enumerate(self.shifts):
            rows = rows.join(F.broadcast(shift.withColumnRenamed("shift", f"_shift{k}")), [c for c in shift.columns if c != "shift"])
            at = at + F.col(f"_shift{k}")
        bad = self.bad()
        for c in bad.columns:
            bad = bad.withColumnRenamed(c, f"_bad_{c}")
        rows = rows.withColumn("_weight", F.floor(at / self.samples).cast("long"))
        on = F.col("_weight") == F.col("_bad_iweight")
        if "ichan" in self.keys:
            on = on & (F.expr(f"ichan div {self.channels}") == F.col("_bad_ichan"))
        if "ipol" in self.keys:
            on = on & (F.col("ipol") == F.col("_bad_ipol"))
        return rows.join(bad, on, "left_anti").select(*data.columns)

    def across(self, *dims: str) -> Weights:
        """Bad in any of those dimensions is bad in all."""
        moved = [s for s in self.shifts if set(s.columns) & set(dims)]
        if moved:
            raise ValueError(f"weights shifted by {dims} can't be combined across them")
        kept = [k for k in self.keys if k not in dims]
        return self._with(self.bad().select("iweight", *kept).distinct(), channels=self.channels if "ichan" in kept else 1)

    def advanced(self, samples: int) -> Weights:
        """Of a signal that begins that many samples later."""
        return replace(self, offset=self.offset + samples)

    def delayed(self, shifts: DataFrame) -> Weights:
        """Of a signal whose sample k was sample k + shift before; (ichan or ipol, shift)."""
        return replace(self, shifts=(*self.shifts, shifts))

    def ranges(self, nchan: int, npol: int) -> DataFrame:
        """The bad samples: keys (those of the shifts, too), first, last."""
        rows, first, channels = self.bad(), F.col("iweight") * self.samples - self.offset, self.channels
        for k, shift in enumerate(self.shifts):
            (key,) = (c for c in shift.columns if c != "shift")
            if key not in rows.columns:
                rows = rows.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit((nchan if key == "ichan" else npol) - 1))))
            elif key == "ichan" and channels > 1:
                rows = rows.withColumn(key, F.explode(F.sequence(F.col(key) * channels, F.col(key) * channels + channels - 1)))
            channels = 1 if key == "ichan" else channels
            rows = rows.join(F.broadcast(shift.withColumnRenamed("shift", f"_shift{k}")), key)
            first = first - F.col(f"_shift{k}")
        if "ichan" in rows.columns and channels > 1:
            rows = rows.withColumn("ichan", F.explode(F.sequence(F.col("ichan") * channels, F.col("ichan") * channels + channels - 1)))
        keys = [k for k in ("ichan", "ipol") if k in rows.columns]
        return rows.select(*keys, first.cast("long").alias("first"), (first + (self.samples - 1)).cast("long").alias("last"))

    def of_blocks(self, nfft: int, step: int, kept: int, parts: int, obs, nchan: int = 1) -> Weights:
        """Of what blocks of nfft samples, one each step, give: `kept` samples each, in nchan channels
        for one. A bad sample makes the blocks bad that take it."""
        rows = self.ranges(obs.nchan, obs.npol)
        keys = [k for k in rows.columns if k not in ("first", "last")]
        low = F.greatest(F.lit(0), F.ceil((F.col("first") - (nfft - 1)) / step)).cast("long")
        high = F.least(F.lit(parts - 1), F.floor(F.col("last") / step)).cast("long")
        blocks = rows.select(*keys, low.alias("low"), high.alias("high")).filter("low <= high").select(*keys, F.explode(F.sequence("low", "high")).alias("iweight")).distinct()
        return self._with(blocks, samples=kept, offset=0, channels=nchan, shifts=())

    def scrunched(self, time: int, frequency: int, obs) -> Weights:
        """Of sums of so many samples and channels: one bad makes the sum bad."""
        aligned = self.samples % time == 0 and self.offset % time == 0 and not self.shifts
        out = replace(self, samples=self.samples // time, offset=self.offset // time) if aligned else self.of_blocks(time, time, 1, obs.ndat // time, obs)
        if frequency == 1 or "ichan" not in out.keys:
            return out
        if out.channels % frequency == 0:
            return replace(out, channels=out.channels // frequency)
        rows = out.bad().withColumn("ichan", F.explode(F.sequence(F.col("ichan") * out.channels, F.col("ichan") * out.channels + out.channels - 1)))
        summed = rows.withColumn("ichan", F.expr(f"cast(ichan div {frequency} as int)")).distinct()
        return out._with(summed, channels=1)

    def of_channels(self, low: int, high: int) -> Weights:
        """Of the channels low..high, numbered from 0."""
        if "ichan" not in self.keys and not any("ichan" in s.columns for s in self.shifts):
            return self
        move = lambda df: df.filter(F.col("ichan").between(low, high)).withColumn("ichan", (F.col("ichan") - low).cast("int"))
        bad = self.bad()
        if "ichan" in bad.columns:
            bad = move(bad.withColumn("ichan", F.explode(F.sequence(F.col("ichan") * self.channels, F.col("ichan") * self.channels + self.channels - 1))))
        return self._with(bad, channels=1, shifts=tuple(move(s) if "ichan" in s.columns else s for s in self.shifts))

    def of_polarization(self, ipol: int) -> Weights:
        """Of one polarization, numbered 0 from now on."""
        bad = self.bad()
        bad = bad.filter(F.col("ipol") == ipol).drop("ipol") if "ipol" in bad.columns else bad
        moved = tuple(s.filter(F.col("ipol") == ipol).withColumn("ipol", F.lit(0)) if "ipol" in s.columns else s for s in self.shifts)
        return self._with(bad, shifts=moved)


def followed(first: Weights | None, ndat: int, second: Weights | None, obs) -> Weights | None:
    """Of a signal of ndat samples and another after it, as weights of single samples."""
    if first is None and second is None:
        return None
    parts = []
    for weights, before, low in ((first, 0, 0), (second, ndat, 0)):
        if weights is not None:
            rows = weights.ranges(obs.nchan, obs.npol)
            for key, n in (("ichan", obs.nchan), ("ipol", obs.npol)):
                if key not in rows.columns:
                    rows = rows.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            last = F.least(F.col("last"), F.lit(ndat - 1)) if not before else F.col("last")
            rows = rows.withColumn("last", last).withColumn("first", F.greatest(F.col("first"), F.lit(low))).filter("first <= last")
            parts.append(rows.select("ichan", "ipol", F.explode(F.sequence(F.col("first") + before, F.col("last") + before)).alias("iweight")))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return Weights(rows.withColumn("weight", F.lit(0)), 1)
