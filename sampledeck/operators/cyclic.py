"""Folds that look inside a turn: cyclic (lags by phase) and phase-locked (spectra by phase)."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampledeck.operators.kernels import RUN_SAMPLES, into_runs
from sampledeck.operators.kernels import products as four_products
from sampledeck.plans.observation import Signal


def lags_for(nchan: int, mover: int = 1) -> int:
    return mover * nchan // 2 + 1


#: Which polarizations are multiplied, and the output that each product adds to, by how many there are.
PAIRS = {1: {(0, 0): 0, (1, 1): 0}, 4: {(0, 0): 0, (1, 1): 1, (0, 1): 2, (1, 0): 3}}


def by_run(rows: DataFrame, products: int):
    """Groups of a run: each polarization's on its own, or both together where products mix them."""
    return rows.groupBy("ichan", *([] if products in PAIRS else ["ipol"]), "irun")


def gathered(table: pa.Table, first: int, n: int, products: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], int]]:
    """(values[polarization, sample], whether they are there, pairs to multiply) of a run's rows."""
    together = products in PAIRS
    pol = np.asarray(table.column("ipol")) if together else np.zeros(len(table), int)
    x, there = np.zeros((2 if together else 1, n), complex), np.zeros((2 if together else 1, n), bool)
    at = np.asarray(table.column("idat")) - first
    x[pol, at] = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im"))
    there[pol, at] = True
    return x, there, PAIRS.get(products) or {(0, 0): table.column("ipol")[0].as_py()}


def cyclic_lags(signal: Signal, nlag: int, period: int, nbin: int, subint: int = 0, products: int = 2) -> DataFrame:
    """ichan, ipol, lag, ibin, re, im, hits: sums of x[i] conj(x[i + lag]) at the phase of the
    middle, i + lag / 2 samples, for a period of whole samples. The whole series counts once. With
    subint, also by subint: the i of that many samples.

    products: 2, of each polarization by itself; 1, their sum; or 4, also of the first with the second,
    conjugated and lagged, and of the second with the first (ipol 2 and 3).

    Runs of samples with an overlap of nlag - 1 are summed where they meet, so a row a run, lag and
    bin is all that is shuffled on. A sample that isn't there counts in no product."""
    span = -(-max(RUN_SAMPLES, subint or 1) // (subint or 1)) * (subint or 1)  # whole sub-integrations
    data = signal.data.select("ichan", "ipol", "idat", "re", "im")
    rows = into_runs(data, nlag, 1, span)

    def run(table: pa.Table) -> pa.Table:
        irun = table.column("irun")[0].as_py()
        x, there, pairs = gathered(table, irun * span, span + nlag - 1, products)
        number = np.arange(span) + irun * span
        part = number // subint if subint else np.zeros(span, np.int64)
        part0, parts = part[0], int(part[-1] - part[0]) + 1
        out = []
        for ((p, q), ipol), lag in itertools.product(pairs.items(), range(nlag)):
            product, both = x[p, :span] * x[q, lag : lag + span].conj(), there[p, :span] & there[q, lag : lag + span]
            ibin = (2 * number + lag) % (2 * period) * nbin // (2 * period)
            cell = (part - part0) * nbin + ibin
            sums = [np.bincount(cell[both], w, parts * nbin) for w in (product.real[both], product.imag[both], None)]
            some = np.flatnonzero(sums[2])
            out.append(pd.DataFrame({"subint": part0 + some // nbin, "ipol": ipol, "lag": lag, "ibin": some % nbin, "re": sums[0][some], "im": sums[1][some], "hits": sums[2][some]}))
        found = pd.concat(out)
        found["ichan"] = table.column("ichan")[0].as_py()
        return pa.Table.from_pandas(found[["subint", "ichan", "ipol", "lag", "ibin", "re", "im", "hits"]], pa.schema([("subint", pa.int64()), ("ichan", pa.int32()), ("ipol", pa.int32()), ("lag", pa.int32()), ("ibin", pa.int32()), ("re", pa.float64()), ("im", pa.float64()), ("hits", pa.int64())]), preserve_index=False)

    partial = by_run(rows, products).applyInArrow(run, "subint long, ichan int, ipol int, lag int, ibin int, re double, im double, hits long")
    keys = [*(["subint"] if subint else []), "ichan", "ipol", "lag", "ibin"]
    return partial.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("hits").alias("hits"))


def cyclic_spectra(lags: DataFrame, nlag: int, mover: int = 1) -> DataFrame:
    """ipol, ichan (2 nlag - 2 channels from each, divided by mover), ibin, v: the real transform
    of each bin's mean lag products; with mover > 1 tapered, and every mover-th channel."""
    out = (2 * nlag - 2) // mover

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ichan, ipol, ibin = key
        z = np.zeros(nlag, complex)
        z[rows["lag"]] = (rows["re"] + 1j * rows["im"]) / rows["hits"]
        if mover > 1:
            x = np.arange(nlag) / nlag
            z *= np.sinc(x) * 0.5 * (1 + np.cos(np.pi * x))
        v = np.fft.irfft(z, 2 * nlag - 2)[::mover][:out]
        return pd.DataFrame({"ichan": ichan * out + np.arange(out), "ipol": ipol, "ibin": ibin, "v": v})

    return lags.groupBy("ichan", "ipol", "ibin").applyInPandas(run, "ichan int, ipol int, ibin int, v double")


def phase_locked(signal: Signal, nchan: int, period: int, nbin: int, subint: int = 0, products: int = 2) -> DataFrame:
    """ichan (input * nchan + bin), ipol, ibin, v, hits: each turn of `period` samples has nbin
    slots; nchan samples from a slot's start are transformed and their powers added by slot. Slots
    whose samples aren't all there don't count. With subint, also by subint: the turns that begin in
    that many samples. products: 2, each polarization's power; 1, their sum; or 4, PP, QQ, Re and Im of
    the first's conjugate times the second, which ipol counts. Runs of whole turns are transformed
    and summed where they meet."""
    if nchan > period // nbin:
        raise ValueError("a slot's samples must fit in it")
    turns = max(1, RUN_SAMPLES // period)
    span = turns * period
    begins = np.arange(nbin) * period // nbin
    rows = signal.data.select("ichan", "ipol", "idat", "re", "im").withColumn("irun", F.expr(f"idat div {int(span)}"))

    def run(table: pa.Table) -> pa.Table:
        irun, ichan = table.column("irun")[0].as_py(), table.column("ichan")[0].as_py()
        x, there, pairs = gathered(table, irun * span, span, products)
        first = (np.arange(turns)[:, None] * period + begins).ravel()  # of each slot of each turn
        where = first[:, None] + np.arange(nchan)
        whole = np.flatnonzero(there[:, where].all((0, 2)))
        spectra = np.fft.fft(x[:, where[whole]])
        if products == 4:
            power = np.stack(four_products(spectra[0], spectra[1]), 1)
        else:  # of one polarization, or both added
            power = (np.abs(spectra) ** 2).sum(0)[:, None]
        ipols = np.arange(4) if products == 4 else np.array([min(pairs.values())])
        slot, turn = whole % nbin, irun * turns + whole // nbin
        part = turn * period // subint if subint else np.zeros(len(whole), np.int64)
        cells, of = np.unique(part * nbin + slot, return_inverse=True)
        total, hits = np.zeros((len(cells), len(ipols), nchan)), np.bincount(of, minlength=len(cells))
        np.add.at(total, of, power)
        each = len(ipols) * nchan
        columns = {"subint": np.repeat(cells // nbin, each), "ichan": np.tile(ichan * nchan + np.arange(nchan), len(cells) * len(ipols)).astype(np.int32), "ipol": np.tile(np.repeat(ipols, nchan), len(cells)).astype(np.int32), "ibin": np.repeat(cells % nbin, each).astype(np.int32), "v": total.ravel(), "hits": np.repeat(hits, each)}
        return pa.table({k: pa.array(v) for k, v in columns.items()})

    partial = by_run(rows, products).applyInArrow(run, "subint long, ichan int, ipol int, ibin int, v double, hits long")
    keys = [*(["subint"] if subint else []), "ichan", "ipol", "ibin"]
    return partial.groupBy(*keys).agg(F.sum("v").alias("v"), F.sum("hits").alias("hits"))
