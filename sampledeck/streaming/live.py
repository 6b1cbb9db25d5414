"""Kernels and sub-integrations of samples that are still coming.

Transforms overlap, so a kernel on a stream needs the end of what came before.  A file that grows holds
it: a chain's pieces read their overlap from the file, and no state is kept.  Any other stream of
samples keeps it as state: by channel, the samples from the first of the next transform on.  Results
don't depend on how the samples were cut into triggers.

A sub-integration is a state machine: it opens with its first sample, adds up, and closes when the
watermark, which is behind every contributor's time, has passed its end.  Its end is that of whole
turns, of a constant period or a predictor.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sampledeck.functions.turns import Turns
from sampledeck.operators import blocks
from sampledeck.plans.observation import Observation
from sampledeck.sources import raw

# Files that grow --------------------------------------------------------------------------------


class PieceReader(raw.LiveReader):
    """Of a file that grows the pieces of a chain whose samples are all there: an offset is a piece's
    number."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.shapes, self.size = [tuple(s) for s in json.loads(options["shapes"])], int(options["size"])
        self.total = int(options.get("total", 0))

    def span(self, piece: int) -> tuple[int, int, int, int]:
        """(low, high, first, last) of a piece: its samples, and those that it needs of the file."""
        low, high = piece * self.size, (piece + 1) * self.size
        high = min(high, self.total) if self.total else high
        return low, high, *blocks.stretch(self.shapes, low, high)

    def initialOffset(self) -> dict:
        return {"piece": 0}

    def latestOffset(self) -> dict:
        there, low = self.recorded(), 0
        high = -(-self.total // self.size) if self.total else there + 1
        while low < high:  # the first piece that isn't there
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.span(middle)[3] <= there else (low, middle)
        return {"piece": low}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [raw.Range(self.file.url, piece, 0, 0, self.file.offset) for piece in range(start["piece"], end["piece"])]

    def read(self, part: raw.Range) -> Iterator[pa.RecordBatch]:
        low, high, first, last = self.span(part.at)
        data, early = replace(part, first=first, n=last - first).read(self.file)
        parts = [{"at": 0, "n": last - first, "early": early, "raw": data}]
        yield pa.RecordBatch.from_pylist([{"piece": part.at, "low": low, "high": high, "first": first, "n": last - first, "parts": parts}], blocks.parts_schema())


class PieceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return blocks.PARTS

    def streamReader(self, schema) -> PieceReader:
        return PieceReader(dict(self.options))


def from_growing_file(spark: SparkSession, url: str, total: int = 0) -> blocks.Chain:
    """The chain of a file that grows. Its rows() are a stream; a piece comes as soon as all its samples
    are recorded. total: how many samples the series will have, whose last piece may be short; without
    it, only whole pieces come."""
    file = raw.open_samples(url)
    obs = replace(file.obs, ndat=total or 1 << 62)

    def frame(shapes: list[tuple[int, int, int]], pieces: int, size: int, ndat: int) -> DataFrame:
        spark.dataSource.register(PieceSource)
        options = {"shapes": json.dumps(shapes), "size": str(size), **({"total": str(ndat)} if total else {})}
        return spark.readStream.format("pieces").options(**options).load(url)

    return blocks.Chain(blocks.Source(obs, frame, blocks.decoder(file)))


# Streams of samples -------------------------------------------------------------------------------


def kernel_stream(samples: DataFrame, obs: Observation, maker: Callable[[Observation, int], blocks.Stage]) -> tuple[DataFrame, Observation]:
    """A stream of samples (idat, ichan, ipol, and v or re and im) through a kernel, and the header of
    what comes. maker(header of one channel, channel) gives the stage, see blocks.

    State, by channel: the samples from the next transform's first on. Samples come in order from
    trigger to trigger, in any order within one; transforms with a sample that didn't come are left
    out, and samples that come after the transforms that need them are too late.
    """
    complex_data = obs.state == "Analytic"
    values = ("re", "im") if complex_data else ("v",)
    one = replace(obs, nchan=1, bandwidth=obs.bandwidth / obs.nchan)
    made = maker(replace(one, centre_frequency=obs.frequency(0)), 0)
    nchan, npol = made.obs.nchan, obs.npol
    out = replace(made.obs, nchan=nchan * obs.nchan, bandwidth=obs.bandwidth, centre_frequency=obs.centre_frequency)
    given = ("re", "im") if made.obs.state == "Analytic" else ("v",)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (ichan,) = key
        first, tail, fine = state.get if state.exists else (0, b"", b"")
        rows = pd.concat(list(parts))
        idat, ipol = rows["idat"].to_numpy(np.int64), rows["ipol"].to_numpy(np.int64)
        last = max(int(idat.max()) + 1, first + len(fine) // npol)
        x, good = np.zeros((1, npol, last - first), complex if complex_data else float), np.zeros((1, npol, last - first), bool)
        n = len(fine) // npol
        x[0, :, :n], good[0, :, :n] = np.frombuffer(tail, x.dtype).reshape(npol, n), np.frombuffer(fine, bool).reshape(npol, n)
        there = idat >= first
        at, ipol = idat[there] - first, ipol[there]
        x[0, ipol, at] = rows["re"].to_numpy()[there] + 1j * rows["im"].to_numpy()[there] if complex_data else rows["v"].to_numpy()[there]
        good[0, ipol, at] = True
        stage = maker(replace(one, centre_frequency=obs.frequency(ichan)), ichan)
        begin, y, kept = stage.apply(first, x, good)
        done = begin // stage.kept + y.shape[2] // stage.kept  # the number of the next transform
        cut = min(max(done * stage.step - first, 0), x.shape[2])
        state.update((first + cut, x[0, :, cut:].tobytes(), good[0, :, cut:].tobytes()))
        c, p, at = np.nonzero(kept)
        v = y[c, p, at]
        columns = dict(zip(given, (v.real, v.imag) if len(given) == 2 else (v.real,), strict=True))
        yield pd.DataFrame({"idat": begin + at, "ichan": (ichan * nchan + c).astype(np.int32), "ipol": p.astype(np.int32), **columns})

    schema = "idat long, ichan int, ipol int, " + ", ".join(f"{c} double" for c in given)
    rows = samples.select("idat", "ichan", "ipol", *(F.col(c).cast("double").alias(c) for c in values))
    return rows.groupBy("ichan").applyInPandasWithState(step, schema, "first long, tail binary, good binary", "append", GroupStateTimeout.NoTimeout), out


def filterbank_stream(samples: DataFrame, obs: Observation, nchan: int, freq_res: int = 1, response: np.ndarray | None = None, wings: tuple[int, int] = (0, 0)) -> tuple[DataFrame, Observation]:
    """kernels.filterbank of a stream."""
    return kernel_stream(samples, obs, lambda one, _: blocks.filterbank(one, nchan, freq_res, response, wings))


def convolve_stream(samples: DataFrame, obs: Observation, response: np.ndarray | dict[int, np.ndarray], wings: tuple[int, int]) -> tuple[DataFrame, Observation]:
    """kernels.convolve of a stream."""
    return kernel_stream(samples, obs, lambda one, c: blocks.convolve(one, response[c] if isinstance(response, dict) else response, wings))


# Sub-integrations ---------------------------------------------------------------------------------


def fold_divisions(samples: DataFrame, turns: Turns, per: int, nbin: int, first_turn: int = 0, late: str = "1 hour", least: float = 0.0, time: str = "ts", keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """samples (time, keys, v) folded by sub-integrations of `per` whole turns from first_turn on: subint,
    keys, ibin, sum, hits, first_us, last_us, complete.

    Each task adds up its bins before they are shuffled. A sub-integration of a key closes when the
    watermark passes its end; complete says whether it began with its first turn, so whether the data
    didn't begin within it. One whose samples span less than `least` of its length isn't given.
    Samples before first_turn, and those that no segment covers, aren't folded.
    """
    types = dict(samples.dtypes)
    names = ", ".join(f"{k} {types[k]}" for k in keys)
    begin = int(turns.when(first_turn))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            us = rows["us"].to_numpy(np.int64)
            phase = turns.at(us)
            # time goes on for samples that aren't folded, too
            mark = rows.iloc[[int(us.argmax())]][list(keys)].assign(subint=-1, ibin=0, sum=0.0, hits=0, first_us=us.max(), last_us=us.max())
            yield timed(mark)
            rows = rows.assign(phase=phase)[np.isfinite(phase) & (phase >= first_turn) & rows["v"].notna().to_numpy()]
            if not len(rows):
                continue
            whole = np.floor(rows["phase"].to_numpy())
            rows["subint"] = ((whole - first_turn) // per).astype(np.int64)
            rows["ibin"] = np.minimum(np.floor((rows["phase"].to_numpy() - whole) * nbin), nbin - 1).astype(np.int32)
            sums = rows.groupby([*keys, "subint", "ibin"], sort=False, dropna=False).agg(sum=("v", "sum"), hits=("v", "size"), first_us=("us", "min"), last_us=("us", "max")).reset_index()
            yield timed(sums)

    def timed(sums: pd.DataFrame) -> pd.DataFrame:
        return sums.assign(_time=pd.to_datetime(sums["last_us"], unit="us", utc=True))[[*keys, "subint", "ibin", "sum", "hits", "first_us", "last_us", "_time"]]

    def machine(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *own, subint = key
        if subint < 0:
            return
        opens, ends = (turns.when(first_turn + (subint + k) * per) for k in (0, 1))
        if state.hasTimedOut:
            total, hits, low, high = state.get
            state.remove()
            if high - low >= least * (ends - opens):
                total, hits = np.frombuffer(total), np.frombuffer(hits, np.int64)
                there = np.flatnonzero(hits)
                yield pd.DataFrame({"subint": subint, **dict(zip(keys, own, strict=True)), "ibin": there.astype(np.int32), "sum": total[there], "hits": hits[there], "first_us": low, "last_us": high, "complete": bool(opens >= begin and low - opens < (ends - opens) / per)})
            return
        rows = pd.concat(list(parts))
        total, hits, low, high = state.get if state.exists else (bytes(8 * nbin), bytes(8 * nbin), int(rows["first_us"].min()), 0)
        total = np.frombuffer(total) + np.bincount(rows["ibin"], rows["sum"], nbin)
        hits = np.frombuffer(hits, np.int64) + np.bincount(rows["ibin"], rows["hits"], nbin).astype(np.int64)
        state.update((total.tobytes(), hits.tobytes(), min(low, int(rows["first_us"].min())), max(high, int(rows["last_us"].max()))))
        state.setTimeoutTimestamp(max(-(-ends // 1000), state.getCurrentWatermarkMs() + 1))
        yield from ()

    rows = samples.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.col("v").cast("double").alias("v"))
    sums = rows.mapInPandas(partial, f"{names}, subint long, ibin int, sum double, hits long, first_us long, last_us long, _time timestamp").withWatermark("_time", late)
    schema = f"subint long, {names}, ibin int, sum double, hits long, first_us long, last_us long, complete boolean"
    return sums.groupBy(*keys, "subint").applyInPandasWithState(machine, schema, "total binary, hits binary, first_us long, last_us long", "append", GroupStateTimeout.EventTimeTimeout)
