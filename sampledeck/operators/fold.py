"""Folding: profiles by phase bin, sub-integrations, and what is done to profiles.

Phases come from integer microseconds wherever the period is constant, so no rounding accumulates
and a sample's bin depends on nothing but its own time.  A fold is one hash aggregation with partial
sums on the map side: few bins make no skew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bins at most, and the least width of a bin in samples, when the number of bins is chosen.
MOST_BINS, LEAST_WIDTH = 1024, 1.2


def choose_nbin(period: float, rate: float, requested: int = 0, force_sensible: bool = False) -> int:
    """The requested number of bins, or the power of two that the sampling supports."""
    sensible = period * rate / LEAST_WIDTH
    sensible = min(MOST_BINS, 1 << max(0, math.floor(math.log2(sensible)))) if sensible >= 1 else 1
    return sensible if not requested or force_sensible and requested > sensible else requested


def fold_period(obs_type: str, period: float, calfreq: float = 0.0) -> float:
    """Seconds of a turn: calibrators fold at their own frequency."""
    return 1.0 / calfreq if obs_type == "PolnCal" and calfreq else period


def sample_us(idat: Column, rate: float, start_us: int) -> Column:
    """Microseconds of each sample's middle."""
    return (F.lit(start_us) + F.floor((idat + 0.5) * (1e6 / rate))).cast("long")


def since(us: Column, epoch_us: int) -> Column:
    return us - F.lit(epoch_us)


def constant_bin(us: Column, epoch_us: int, period_us: int, nbin: int) -> Column:
    """The phase bin of a time, before the epoch too."""
    return F.floor(F.pmod(since(us, epoch_us), F.lit(period_us)) * nbin / period_us).cast("int")


def division(us: Column, epoch_us: int, length_us: int) -> Column:
    """Which sub-integration of that length a time falls in."""
    return F.floor(since(us, epoch_us) / length_us).cast("long")


def snapped_terms(rate: float, start_us: float, epoch_us: int, length_us: int) -> tuple[int, int, int]:
    """Whole numbers q, a and b: sample idat is in snapped division
    floor((idat * q + a - idat mod 2) / b). Rate and start count as the decimals they are written as.

    Boundary d is at or before a sample if it lies less than half a sample after it, or just half a
    sample after an even one; so which division a sample is in takes no rounding."""
    unit = Fraction(str(rate)) / 1_000_000
    samples, first = length_us * unit, (epoch_us - Fraction(str(start_us))) * unit
    q = 2 * math.lcm(samples.denominator, first.denominator)
    return q, int(q // 2 - first * q), int(samples * q)


def snapped_division(idat: Column, rate: float, start_us: float, epoch_us: int, length_us: int) -> Column:
    """Which sub-integration of that length, counted from the epoch on, a sample is in, where each
    begins with the sample nearest its boundary; so all have whole samples and none is split.
    Boundary d lies at sample lrint((epoch + d * length - start) * rate), halves to even, exactly."""
    terms = snapped_terms(rate, start_us, epoch_us, length_us)
    small = terms[0] < 1 << 20 and max(map(abs, terms)) < 1 << 62
    q, a, b = (F.lit(x) if small else F.lit(Decimal(x)) for x in terms)
    place = idat.cast("long" if small else "decimal(20,0)") * q + a - F.pmod(idat, F.lit(2))
    return F.call_function("div", place - F.pmod(place, b), b).cast("long")


def snapped_divisions(idat: np.ndarray, rate: float, start_us: float, epoch_us: int, length_us: int) -> np.ndarray:
    """As snapped_division(), of an array."""
    q, a, b = snapped_terms(rate, start_us, epoch_us, length_us)
    small = max(int(np.abs(idat).max(initial=0)) * q + abs(a), b) < 1 << 62
    whole = idat.astype(np.int64 if small else object)
    return ((whole * q + a - whole % 2) // b).astype(np.int64)


def phase_division(turns: Column, parts: int, start_phase: float = 0.0) -> Column:
    """Divisions of less than a turn: which of `parts` equal parts of a turn, from start_phase on, a
    phase in turns is in, counted on from turn to turn."""
    return F.floor((turns - F.lit(start_phase)) * parts).cast("long")


def first_whole_turn(turns: float, reference_phase: float = 0.0) -> int:
    """The number of the first turn, counted from the reference phase, that begins at or after a
    phase in turns; where sub-integrations of whole turns start."""
    return math.ceil(turns - reference_phase)


def fold(data: DataFrame, *keys: str, ibin: str = "ibin", valid: Column | None = None) -> DataFrame:
    """sum and hits by keys and bin. valid: samples for which it isn't true don't count (zeros that
    mitigation left, say), and neither does a null value."""
    there = F.col("v").isNotNull() if valid is None else F.col("v").isNotNull() & valid
    return data.groupBy(*keys, ibin).agg(F.sum(F.when(there, F.col("v"))).alias("sum"), F.count_if(there).alias("hits"))


def combine(profiles: DataFrame, *keys: str) -> DataFrame:
    """Partial profiles added up."""
    return profiles.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("hits").alias("hits"))


def normalise(profile: DataFrame, nbin: int | Column, *keys: str, scale: float = 1.0) -> DataFrame:
    """amp = sum / (scale * hits) for all nbin bins (a number, or an expression of the keys) of every
    group of keys; bins without hits get
    the mean of those with. One array a group, so no bins table is crossed with the groups."""
    cells = profile.filter("hits > 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ibin", F.struct((F.col("sum") / (F.col("hits") * F.lit(scale))).alias("amp"), "hits")))).alias("m"), F.avg(F.col("sum") / (F.col("hits") * F.lit(scale))).alias("mean"))
    rows = cells.select(*keys, "m", "mean", F.explode(F.sequence(F.lit(0), (F.lit(nbin) - 1).cast("int"))).alias("ibin"))
    cell = F.try_element_at("m", F.col("ibin"))
    return rows.select(*keys, "ibin", F.coalesce(cell["amp"], F.col("mean")).alias("amp"), F.coalesce(cell["hits"], F.lit(0)).cast("long").alias("hits"))


def channel_weights(profile: DataFrame, ndat_total: int, *keys: str) -> DataFrame:
    """Share of the samples that went into each group's profile; 0 where a sum isn't finite."""
    finite = F.bool_and(F.coalesce(~F.isnan("sum") & (F.abs("sum") < float("inf")), F.lit(True)))
    return profile.groupBy(*keys).agg(F.when(finite, F.sum("hits") / F.lit(float(ndat_total))).otherwise(0.0).alias("weight"))


def long_enough(profile: DataFrame, spans: DataFrame, length_us: int, share: float = 0.1) -> DataFrame:
    """Sub-integrations whose span (first, last by subint) is at least that share of the length."""
    kept = spans.filter((F.col("last") - F.col("first")) >= F.lit(share * length_us)).select("subint")
    return profile.join(kept, "subint", "left_semi")


def subint_spans(data: DataFrame) -> DataFrame:
    """first and last time, and the number of samples, by subint."""
    return data.groupBy("subint").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))


def expected(spans: DataFrame, per_subint: float, share: float = 0.9) -> DataFrame:
    """Sub-integrations with their completeness against the samples that each should have."""
    return spans.select("subint", "n", (F.col("n") >= F.lit(share * per_subint)).alias("complete"))


def fold_many(data: DataFrame, periods_us: Sequence[int], epoch_us: int, nbin: int, *keys: str) -> DataFrame:
    """Several periods folded in one pass: each sample becomes a row a period before the partial
    aggregation, which takes them down to nbin rows a period and task."""
    rows = data.withColumn("period_us", F.explode(F.array(*[F.lit(int(p)).cast("long") for p in periods_us])))
    ibin = F.floor(F.pmod(since(F.col("us"), epoch_us), F.col("period_us")) * nbin / F.col("period_us")).cast("int")
    return fold(rows.withColumn("ibin", ibin), "period_us", *keys)


def parse_polynomials(text: str) -> list[tuple[int, float, float, list[float]]]:
    """The segments of a polynomial phase predictor in its usual text form, as predictor() takes them.
    Each has a line of name, date, time, middle (days) and more, a line of phase, frequency, site,
    span (minutes), number of coefficients and more, and its coefficients; of these the first adds to
    the phase. Spans are dealt with by the caller, see polynomial_span()."""
    words, at, out = [line.split() for line in text.splitlines() if line.strip()], 0, []
    number = lambda x: float(x.upper().replace("D", "E"))
    while at + 1 < len(words):
        day, _, part = words[at][3].partition(".")
        middle = (int(day) - 40587) * 86_400_000_000 + round(float(f"0.{part or 0}") * 86_400_000_000)
        phase, frequency, n = number(words[at + 1][0]), number(words[at + 1][1]), int(words[at + 1][4])
        at += 2
        coefficients: list[float] = []
        while len(coefficients) < n:
            coefficients += map(number, words[at])
            at += 1
        out.append((middle, phase, frequency, coefficients))
    return out


def polynomial_span(text: str) -> tuple[int, int]:
    """(microseconds that each segment of such a text is good for, where the first one's begin)."""
    lines = [line.split() for line in text.splitlines() if line.strip()]
    span = int(lines[1][3]) * 60_000_000
    return span, parse_polynomials(text)[0][0] - span // 2


#: Segments of a predictor that are broadcast: each is a row of some hundred bytes at most.
FEW_SEGMENTS = 1 << 16


def predictor(spark: SparkSession, segments: Sequence[tuple[int, float, float, Sequence[float]]], span_us: int, epoch_us: int) -> DataFrame:
    """A phase predictor's segments: (middle in microseconds, phase there in turns, frequency in Hz,
    further coefficients of powers of minutes), each good for span_us from epoch_us on in turn. The
    coefficients are columns c0, c1, ..., 0 where a segment has fewer."""
    most = max((len(x[3]) for x in segments), default=0)
    rows = [((int(m) - epoch_us) // span_us, int(m), float(p), float(f), *map(float, cs), *[0.0] * (most - len(cs))) for m, p, f, cs in segments]
    schema = "segment long, tmid_us long, rphase double, f0 double" + "".join(f", c{k} double" for k in range(most))
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= FEW_SEGMENTS else table


def predicted(data: DataFrame, segments: DataFrame, span_us: int, epoch_us: int, how: str = "inner") -> DataFrame:
    """data with turns, the predicted phase: rphase + 60 dt f0 + sum of c_k dt^k, dt in minutes from
    the segment's middle. Segments are as-of by time: an equi-join on the span that a time is in.
    Times that no segment covers are dropped, or get no turns with how="left". The polynomial is
    worked out from the highest power down."""
    rows = data.withColumn("segment", division(F.col("us"), epoch_us, span_us)).join(segments, "segment", how)
    dt = (F.col("us") - F.col("tmid_us")) / F.lit(60e6)
    powers = [c for c in segments.columns if c[0] == "c" and c[1:].isdigit()]
    tail = F.lit(0.0)
    for c in reversed(powers):
        tail = tail * dt + F.col(c)
    return rows.withColumn("turns", F.col("rphase") + 60.0 * dt * F.col("f0") + tail).drop("tmid_us", "rphase", "f0", "segment", *powers)


def turn_bin(nbin: int, reference_phase: float = 0.0) -> Column:
    """The bin of the column turns, null where that is."""
    turns = F.col("turns") - F.lit(reference_phase)
    return F.when(turns.isNotNull(), F.least(F.floor((turns - F.floor(turns)) * nbin), F.lit(nbin - 1))).cast("int")


def folded_seconds(profile: DataFrame, rate: float, *keys: str) -> DataFrame:
    """Integration length: samples folded over the rate."""
    return profile.groupBy(*keys).agg((F.sum("hits") / F.lit(rate)).alias("seconds"))


def pulse_phase_order(profile: DataFrame, *keys: str) -> DataFrame:
    """Each profile rotated so that its highest bin comes first; of equal ones the first."""
    best = Window.partitionBy(*keys)
    peak = F.min_by("ibin", F.struct((-F.col("amp")).alias("a"), "ibin")).over(best)
    return profile.withColumn("nbin", F.count("*").over(best)).withColumn("ibin", F.pmod(F.col("ibin") - peak, F.col("nbin")).cast("int")).drop("nbin")
