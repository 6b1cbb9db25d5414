"""Weights through every operator that changes where samples are, against numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.operators import delay, detect, kernels, scrunch, weights
from sampledeck.plans import nodes, pipelines
from sampledeck.plans.observation import Observation, Signal
from sampledeck.plans.weights import Weights

NDAT, NCHAN, NPOL = 203, 4, 2


@pytest.fixture(scope="module")
def volts(spark):
    """(signal, bad[idat, ichan, ipol]): weights of 10 samples, the first of which began 3 earlier."""
    g = np.random.default_rng(1)
    cells = [(t, c, p, float(g.normal()), float(g.normal())) for t in range(NDAT) for c in range(NCHAN) for p in range(NPOL)]
    data = spark.createDataFrame(cells, "idat long, ichan int, ipol int, re double, im double")
    obs = Observation(state="Analytic", ndim=2, nchan=NCHAN, npol=NPOL, ndat=NDAT, centre_frequency=1400.0, bandwidth=4.0, rate=1000.0, dispersion_measure=1.0)
    blocks = [(k, c, p, int(g.random() > 0.1)) for k in range(21) for c in range(NCHAN) for p in range(NPOL)]
    table = spark.createDataFrame(blocks, "iweight long, ichan int, ipol int, weight int")
    bad = np.zeros((NDAT, NCHAN, NPOL), bool)
    for k, c, p, w in blocks:
        if not w:
            bad[max(0, k * 10 - 3) : max(0, k * 10 + 7), c, p] = True
    return Signal(data, obs, Weights(table, 10, 3)), bad


def left(signal):
    return sorted((r.idat, r.ichan, r.ipol) for r in signal.good().select("idat", "ichan", "ipol").collect())


def cells(good):
    return sorted(map(tuple, np.argwhere(good).tolist()))


def test_good_samples(volts):
    signal, bad = volts
    assert left(signal) == cells(~bad) and 0 < bad.mean() < 0.5


def test_detection(volts):
    signal, bad = volts
    assert left(detect.square_law(signal)) == cells(~bad)
    assert left(detect.intensity(signal)) == cells(~bad.any(2, keepdims=True))
    assert left(detect.reshape_products(detect.coherence(signal))) == cells(np.repeat(~bad.any(2, keepdims=True), 4, 2))
    assert left(detect.select_polarization(signal, 1)) == cells(~bad[:, :, 1:])


@pytest.mark.parametrize("time,frequency", [(5, 1), (1, 2), (4, 3), (20, 4)])
def test_scrunches(volts, time, frequency):
    signal, bad = volts
    n, m = NDAT // time, NCHAN // frequency
    expected = bad[: n * time, : m * frequency].reshape(n, time, m, frequency, NPOL).any((1, 3))
    assert left(scrunch.scrunch(detect.square_law(signal), time, frequency)) == cells(~expected)


def test_scrunch_of_weights_that_divide(spark, volts):
    signal, _ = volts
    even = replace(signal, weights=Weights(spark.createDataFrame([(1, 0), (4, 0)], "iweight long, weight int"), 10, 0))
    found = scrunch.scrunch(detect.square_law(even), 5, 2)
    assert found.weights.samples == 2 and {i for i, *_ in left(found)} == set(range(40)) - {2, 3, 8, 9}


def test_selection_and_shifts(volts):
    signal, bad = volts
    assert left(scrunch.seek(signal, 0.017, 0.1)) == cells(~bad[17:117])
    assert left(scrunch.zoom(signal, 1400.0, 1.9)) == cells(~bad[:, 1:3])
    both = scrunch.append(detect.square_law(signal), detect.square_law(signal))
    assert left(both) == cells(~np.concatenate([bad, bad]))
    spark = signal.data.sparkSession
    moved = delay.sample_delay(signal, spark.createDataFrame([(0, 0), (1, 3), (2, 5), (3, 1)], "ichan int, delay long"))
    expected = np.stack([bad[s : s + NDAT - 5, c] for c, s in enumerate((5, 2, 0, 4))], 1)
    assert left(moved) == cells(~expected)
    again = delay.sample_delay(moved, spark.createDataFrame([(0, 2), (1, 0)], "ipol int, delay long"))
    assert left(again) == cells(~np.stack([expected[s : s + NDAT - 7, :, p] for p, s in enumerate((0, 2))], 2))
    blocks = kernels.convolve(again, np.ones(8), (2, 1))
    assert left(blocks) == cells(~of_blocks(np.stack([expected[s : s + NDAT - 7, :, p] for p, s in enumerate((0, 2))], 2), 8, 5, 5))
    assert left(scrunch.zoom(moved, 1400.0, 1.9)) == cells(~expected[:, 1:3])
    assert left(scrunch.scrunch(detect.square_law(moved), 3, 2)) == cells(~expected[:198].reshape(66, 3, 2, 2, NPOL).any((1, 3)))


def of_blocks(bad, nfft, step, kept, nchan=1):
    parts = (len(bad) - nfft) // step + 1
    hit = np.stack([bad[b * step : b * step + nfft].any(0) for b in range(parts)])
    return np.repeat(np.repeat(hit, kept, 0), nchan, 1)


def test_kernels(volts):
    signal, bad = volts
    assert left(kernels.convolve(signal, np.ones(16), (3, 2))) == cells(~of_blocks(bad, 16, 11, 11))
    assert left(kernels.filterbank(signal, 4, 4, None, (1, 1))) == cells(~of_blocks(bad, 16, 8, 2, 4))
    banked = kernels.filterbank(signal, 4)
    assert left(banked) == cells(~of_blocks(bad, 4, 4, 1, 4))
    assert left(scrunch.scrunch(detect.square_law(banked), 1, 2)) == cells(~of_blocks(bad, 4, 4, 1, 2))
    assert left(scrunch.scrunch(detect.square_law(banked), 1, 8)) == cells(~of_blocks(bad, 4, 4, 1).reshape(-1, 2, 2, NPOL).any(2))
    matrix = np.tile(np.eye(2), (8, 1, 1))
    assert left(kernels.convolve_matrix(signal, matrix, (1, 1))) == cells(~of_blocks(np.repeat(bad.any(2, keepdims=True), 2, 2), 8, 6, 6))
    assert left(kernels.polyphase_filterbank(signal, 4, np.ones(12))) == cells(~of_blocks(bad, 12, 4, 1, 4))
    assert left(kernels.tfp_filterbank(signal, 4, True)) == cells(~of_blocks(bad.any(2, keepdims=True), 4, 4, 1, 4))


def test_excision_and_fold(spark, volts):
    signal, _ = volts
    plain = Signal(signal.data, signal.obs)
    x = np.zeros((NDAT, NCHAN, NPOL), complex)
    for r in signal.data.collect():
        x[r.idat, r.ichan, r.ipol] = r.re + 1j * r.im
    low = (abs(x.real) < 0.6).astype(int) + (abs(x.imag) < 0.6)
    bad = np.zeros((NDAT, NCHAN, NPOL), bool)
    for k in range(0, NDAT, 10):
        share = low[k : k + 10].sum(0) / (2 * len(low[k : k + 10]))
        bad[k : k + 10] = (share < 0.3) | (share > 0.6)
    assert 0 < bad.mean() < 0.9
    excised = weights.excised(plain, 10, 0.6, 0.3, 0.6, together=False)
    assert left(excised) == cells(~bad)
    assert {(r.idat, r.ichan, r.ipol) for r in excised.data.collect() if r.re == 0 and r.im == 0} == set(cells(bad))
    whole = bad.any((1, 2))
    assert left(weights.excised(plain, 10, 0.6, 0.3, 0.6)) == cells(np.broadcast_to(~whole[:, None, None], bad.shape))
    config = pipelines.FoldConfig(period_us=7000, nbin=7, epoch_us=0, excision=(10, 0.6, 0.1, 0.7), filterbank=pipelines.Filterbank(4))
    share = np.stack([low[k : k + 10].sum(0) / (2 * len(low[k : k + 10])) for k in range(0, NDAT, 10)])
    gone = np.repeat(((share < 0.1) | (share > 0.7)).any((1, 2)), 10)[:NDAT]
    kept = [b for b in range(NDAT // 4) if not gone[b * 4 : b * 4 + 4].any()]
    hits = np.bincount([int((b * 4 + 2) % 7) for b in kept], minlength=7)
    found = {r.ibin: r.hits for r in pipelines.fold_signal(plain, config).filter("ichan = 5").collect()}
    assert [found[k] for k in range(7)] == hits.tolist() and 0 < len(kept) < NDAT // 4


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_forked_programs_prepare_once(spark, volts, tmp_path, monkeypatch):
    signal, _ = volts
    signal.data.write.parquet(f"file://{tmp_path}/volts")
    stored = Signal(spark.read.parquet(f"file://{tmp_path}/volts"), replace(signal.obs, start_us=0))
    seen = []
    write = nodes.kept
    monkeypatch.setattr(nodes, "kept", lambda df, url: seen.append(df._jdf.queryExecution().executedPlan().toString().count("/volts")) or write(df, url))
    config = pipelines.FoldConfig(period_us=7000, nbin=7, epoch_us=0, sk_samples=20, sk_limits=(0.5, 1.5), filterbank=pipelines.Filterbank(2))
    forked = pipelines.fold_forked(stored, config)
    assert seen == [1, 0]
    plain = {(r.ichan, r.ibin): (round(r.amp, 9), r.hits) for r in pipelines.fold_signal(stored, replace(config, sk_samples=0)).collect()}
    cut = {(r.ichan, r.ibin): (round(r.amp, 9), r.hits) for r in pipelines.fold_signal(stored, config).collect()}
    for flag, expected in ((False, plain), (True, cut)):
        assert {(r.ichan, r.ibin): (round(r.amp, 9), r.hits) for r in forked.filter(F.col("mitigated") == flag).collect()} == expected
    assert plain != cut


def test_several_sources_are_one_pass(spark, tmp_path):
    spark.createDataFrame([(k, 0, 0, float(k % 7)) for k in range(500)], "idat long, ichan int, ipol int, v double").write.parquet(f"file://{tmp_path}/power")
    signal = Signal(spark.read.parquet(f"file://{tmp_path}/power"), Observation(ndat=500, rate=1000.0))
    segments = ((250_000, 0.25, 40.0, (0.0, 1.0)),)
    sources = [pipelines.Ephemeris("a", 10_000, nbin=5), pipelines.Ephemeris("b", segments=segments, span_us=400_000, first_us=0, nbin=4)]
    config = pipelines.FoldConfig(epoch_us=0, subint_us=100_000)
    both = pipelines.fold_sources(signal, config, sources)
    assert scans(both) == 1
    row = lambda r: (r.subint, r.ibin, round(r.amp, 9), r.hits)
    for source in sources:
        alone = pipelines.fold_signal(signal, replace(config, ephemeris=source))
        assert sorted(map(row, both.filter(F.col("source") == source.source).collect())) == sorted(map(row, alone.collect()))
