"""Chains of kernels on arrays against the same operators on long rows, from files and from tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.operators import blocks, detect, fold, kernels, scrunch, weights
from sampledeck.plans.observation import Observation
from sampledeck.sources import raw, unload

N = 700
OBS = Observation(state="Analytic", ndim=2, nchan=2, npol=2, nbit=8, ndat=N, rate=1000.0, centre_frequency=1400.0, bandwidth=-4.0, dispersion_measure=20.0)
REAL = Observation(state="Nyquist", ndim=1, nchan=1, npol=2, nbit=2, ndat=N, rate=1000.0, centre_frequency=1400.0, bandwidth=8.0, dispersion_measure=1.0)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("blocks")
    out = {}
    for name, obs in (("complex", OBS), ("real", REAL)):
        codes = np.random.default_rng(7).integers(0, 1 << obs.nbit, (N, obs.nchan, obs.npol, obs.ndim))
        out[name] = []
        for k, (a, b) in enumerate(((0, 250), (250, 311), (311, N))):
            out[name].append(f"file://{folder}/{name},{k}.raw")  # a comma in a name is none of our business
            if obs.nbit < 8:
                a, b = a // 4 * 4, b // 4 * 4
            raw.write_raw(codes[a:b], obs.later(a), out[name][-1])
    return out


def table(signal, *columns):
    return {tuple(r[:3]): tuple(r[3:]) for r in signal.data.select("idat", "ichan", "ipol", *columns).collect()}


def alike(a, b):
    assert a.keys() == b.keys() and len(a) > 100
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("size", [0, 1, 37])
def test_chain_of_kernels_is_that_of_long_rows(spark, files, size):
    g = np.random.default_rng(1)
    taps = g.standard_normal(16) + 1j * g.standard_normal(16)
    chain = blocks.from_files(spark, files["complex"]).then(blocks.filterbank, 4, 8, None, (1, 2)).then(blocks.convolve, taps, (3, 2))
    signal = raw.read_samples(spark, files["complex"])
    expected = kernels.convolve(kernels.filterbank(signal, 4, 8, None, (1, 2)), taps, (3, 2))
    found = chain.rows(size)
    assert replace(found.obs, history=()) == expected.obs
    alike(table(found, "re", "im"), table(expected, "re", "im"))
    detected = chain.then(blocks.detect, "Stokes").then(blocks.scrunch, 3, 2)
    long = scrunch.scrunch(detect.reshape_products(detect.stokes(expected)), 3, 2)
    alike(table(detected.rows(size), "v"), table(long, "v"))
    assert (detected.obs.ndat, detected.obs.nchan, detected.obs.rate) == (long.obs.ndat, long.obs.nchan, long.obs.rate)


def test_real_voltages_of_two_bits(spark, files):
    signal = raw.read_samples(spark, files["real"])
    chain = blocks.from_files(spark, files["real"])
    alike(table(chain.rows(11), "v"), table(signal, "v"))
    alike(table(chain.then(blocks.filterbank, 4).rows(5), "re", "im"), table(kernels.filterbank(signal, 4), "re", "im"))
    alike(table(chain.then(blocks.dedisperse, 16, (2, 2)).then(blocks.detect).rows(13), "v"), table(detect.intensity(kernels.coherent_dedispersion(signal, 16, (2, 2))), "v"))


def test_matrix_and_excision(spark, files):
    signal = raw.read_samples(spark, files["complex"])
    g = np.random.default_rng(2)
    jones = g.standard_normal((8, 2, 2)) + 1j * g.standard_normal((8, 2, 2))
    for together in (False, True):
        limits = (20, 40.0, 0.22, 0.40)
        excised = weights.excised(signal, *limits, together=together)
        expected = kernels.convolve_matrix(excised, jones, (1, 2))
        found = blocks.from_files(spark, files["complex"]).then(blocks.excise, *limits, together=together).then(blocks.convolve_matrix, jones, (1, 2))
        good = replace(expected, data=expected.good())
        alike(table(found.rows(23), "re", "im"), table(good, "re", "im"))
        assert good.data.count() < expected.data.count()


def test_fold_and_gaps(spark, files):
    urls = [files["complex"][0], files["complex"][2]]
    signal = raw.read_samples(spark, urls, force=True)
    assert signal.obs.ndat == N
    chain = blocks.from_files(spark, urls, force=True).then(blocks.dedisperse, 32, (5, 4)).then(blocks.detect, "PPQQ")
    expected = detect.square_law(kernels.coherent_dedispersion(signal, 32, (5, 4)))
    rows = expected.data.withColumn("us", fold.sample_us(F.col("idat"), 1000.0, expected.obs.start_us))
    rows = rows.withColumn("ibin", fold.constant_bin(F.col("us"), 0, 7000, 7)).withColumn("subint", fold.division(F.col("us"), 0, 200_000))
    long = {tuple(r[:4]): tuple(r[4:]) for r in fold.fold(rows, "subint", "ichan", "ipol").collect()}
    for size in (0, 50):
        profile = chain.fold(7000, 7, 0, 200_000, size)
        found = {tuple(r[:4]): tuple(r[4:]) for r in profile.collect()}
        alike(found, long)
        assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in long.items()}


def test_one_exchange_from_files_to_the_profile(spark, files):
    profile = blocks.from_files(spark, files["complex"]).then(blocks.dedisperse, 32, (5, 4)).then(blocks.detect).fold(7000, 7, 0, size=100)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan parquet" not in plan and plan.count("MapInArrow") == 2


def test_chain_of_a_table(spark):
    g = np.random.default_rng(4)
    values = g.standard_normal((300, 8)).astype(np.float32)
    obs = replace(OBS, ndat=300)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values) if k not in (50, 51, 200)] + [(290, [1.0])], "idat long, values array<float>").filter("not (idat = 290 and size(values) = 8)")
    cells = [(k, c, p, *values[k].reshape(2, 2, 2)[c, p].astype(float).tolist()) for k in range(300) if k not in (50, 51, 200, 290) for c in range(2) for p in range(2)]
    from sampledeck.plans.observation import Signal

    signal = Signal(spark.createDataFrame(cells, "idat long, ichan int, ipol int, re double, im double"), obs)
    expected = kernels.convolve(kernels.filterbank(signal, 2, 8, None, (1, 1)), np.arange(8) + 1j, (2, 1))
    for size in (0, 9):
        found = blocks.from_rows(rows, obs).then(blocks.filterbank, 2, 8, None, (1, 1)).then(blocks.convolve, np.arange(8) + 1j, (2, 1)).rows(size)
        alike(table(found, "re", "im"), table(expected, "re", "im"))


def test_whole_series_files_and_their_places(spark, tmp_path):
    """What is written has all samples, whatever is missing; where a file is missing the others stay."""
    obs = Observation(nchan=2, npol=1, nbit=8, ndat=100, rate=1000.0, centre_frequency=1400.0, bandwidth=-40.0)
    rows = [(i, c, 0, (i * 3 + c) % 256) for i in range(100) for c in range(2) if i not in (8, 9, 99) and not 20 <= i < 30]
    files = raw.write_filterbank(spark.createDataFrame(rows, "idat long, ichan int, ipol int, code int"), obs, f"file://{tmp_path}/a,b", 10).collect()
    assert sorted((f["file_no"], f["first"], f["n"]) for f in files) == [(k, 10 * k, 10) for k in range(10)]
    expected = {(i, c): float(v) for i, c, _, v in rows}
    back = raw.read_samples(spark, [f["url"] for f in files])
    assert {(r.idat, r.ichan): r.v + 127.5 for r in back.data.collect()} == {(i, c): expected.get((i, c), 0.0) for i in range(100) for c in range(2)}
    less = raw.read_samples(spark, [f["url"] for f in files if f["file_no"] not in (4, 9)], force=True)
    assert less.obs.ndat == 90
    assert {(r.idat, r.ichan): r.v + 127.5 for r in less.data.collect()} == {(i, c): expected.get((i, c), 0.0) for i in range(90) for c in range(2) if not 40 <= i < 50}


def test_very_many_files_and_prime_lengths(spark, tmp_path, monkeypatch):
    from sampledeck.sources import catalogue

    obs = replace(REAL, nbit=8, npol=1, ndat=3)
    urls = [f"file://{tmp_path}/{k}.raw" for k in range(40)]
    for k, url in enumerate(urls):
        raw.write_raw(np.full((3, 1, 1, 1), k), obs.later(3 * k), url)
    found = raw.read_samples(spark, urls[::-1], samples=2)
    assert found.obs.ndat == 120 and sorted((r.idat, r.v - 0.5) for r in found.data.collect()) == [(k, float(k // 3)) for k in range(120)]
    opened = []
    one = raw.open_samples
    monkeypatch.setattr(raw, "open_samples", lambda url: opened.append(url) or one(url))
    catalogue.placed_files(spark, urls)
    assert not opened  # tasks did
    with pytest.raises(ValueError, match="follow"):
        raw.read_samples(spark, [*urls[:20], *urls[21:]])
    (tmp_path / "p.inf").write_text(" Epoch of observation (MJD) = 58849.5\n Number of bins in the time series = 65537\n Width of each time series bin (sec) = 0.001\n")
    (tmp_path / "p.dat").write_bytes(np.arange(65537, dtype="<f4").tobytes())
    series = raw.read_series(spark, f"file://{tmp_path}/p.inf")
    assert series.obs.ndat == 65537 and series.data.filter("idat = v").count() == 65537
    assert series.data.rdd.getNumPartitions() <= 8


SEGMENTS = ((100_000, 0.25, 130.0, (0.0, 3.0)), (350_000, 40.0, 131.0, (0.0,)), (600_000, 80.5, 129.0, ()))


@pytest.mark.parametrize(
    "changes",
    [
        {"filterbank": "4", "coherent": True, "subint_us": 150_000},
        {"filterbank": "4:B", "coherent": True, "interchannel": True, "state": "Stokes"},
        {"filterbank": "8", "excision": (20, 40.0, 0.2, 0.42), "subint_us": 33_370, "snapped": True},
        {"coherent": True, "interchannel": True, "state": "PPQQ", "subint_turns": 7, "first_turn": 2},
        {"sk_samples": 25, "sk_limits": (0.3, 1.2)},
        {"ephemeris": True, "subint_turns": 5, "filterbank": "2"},
    ],
)
def test_fold_program_of_files_is_that_of_long_rows(spark, files, changes):
    from sampledeck.plans import pipelines

    changes = dict(changes)
    if "filterbank" in changes:
        changes["filterbank"] = pipelines.Filterbank.parse(changes["filterbank"])
    if "ephemeris" in changes:
        changes["ephemeris"] = pipelines.Ephemeris("x", segments=SEGMENTS, span_us=250_000, first_us=0, nbin=5)
    config = pipelines.FoldConfig(**{"period_us": 7000, "nbin": 7, "epoch_us": 0, **changes})
    long = pipelines.fold_signal(raw.read_samples(spark, files["complex"]), config)
    found = pipelines.fold_files(spark, files["complex"], config)
    row = lambda r: ((r.subint, r.ichan, r.ipol, r.ibin), r.hits)
    assert sorted(map(row, found.collect())) == sorted(map(row, long.collect())) and sum(r.hits for r in found.collect()) > 300
    a, b = ({(r.subint, r.ichan, r.ipol, r.ibin): r.amp for r in df.collect()} for df in (found, long))
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-9, atol=1e-6)


def test_dedispersion_during_channelization_on_arrays(spark, files):
    from sampledeck.plans import pipelines

    config = pipelines.FoldConfig(period_us=7000, nbin=7, epoch_us=0, filterbank=pipelines.Filterbank.parse("4:D"), coherent=True)
    a, b = ({(r.subint, r.ichan, r.ipol, r.ibin): (r.amp, r.hits) for r in df.collect()} for df in (pipelines.fold_files(spark, files["real"], config), pipelines.fold_signal(raw.read_samples(spark, files["real"]), config)))
    alike_or_few(a, b)
    with pytest.raises(ValueError, match="single parts"):
        pipelines.fold_files(spark, files["real"], replace(config, sk_samples=10))


def alike_or_few(a, b):
    assert a.keys() == b.keys() and a and np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-9, atol=1e-6)


def test_power_and_polyphase_filterbanks_on_arrays(spark, files):
    signal, chain = raw.read_samples(spark, files["complex"]), blocks.from_files(spark, files["complex"])
    taps = np.hanning(24)
    for size in (0, 9):
        alike(table(chain.then(blocks.polyphase_filterbank, 8, taps).rows(size), "re", "im"), table(kernels.polyphase_filterbank(signal, 8, taps), "re", "im"))
        for both in (False, True):
            expected = kernels.tfp_filterbank(signal, 8, both)
            found = chain.then(blocks.tfp_filterbank, 8, both).rows(size)
            alike(table(found, "v"), table(expected, "v"))
            assert replace(found.obs, history=()) == expected.obs
    real = raw.read_samples(spark, files["real"])
    alike(table(blocks.from_files(spark, files["real"]).then(blocks.tfp_filterbank, 16).rows(7), "v"), table(kernels.tfp_filterbank(real, 16), "v"))


def test_archives_hold_what_goes_with_a_profile(spark, tmp_path):
    from sampledeck.functions.numeric import normalised, window

    profile = spark.createDataFrame([(s, 0, 0, b, float(b), 1) for s in range(2) for b in range(3)], "subint long, ichan int, ipol int, ibin int, amp double, hits long")
    counts = spark.createDataFrame([(0, 0, 1, 5)], "ichan int, ipol int, code int, n long")
    unload.write_archive(profile, replace(OBS, history=("convolve", "intensity")), f"file://{tmp_path}/a", counts=counts)
    back = unload.read_archive(spark, f"file://{tmp_path}/a")
    assert set(back) == {"profile", "counts", "provenance"} and back["counts"].collect() == counts.collect()
    assert sorted(map(tuple, back["profile"].select(profile.columns).collect())) == sorted(map(tuple, profile.collect()))
    assert [r["value"] for r in back["provenance"].filter("step is not null").orderBy("step").collect()] == ["convolve", "intensity"]
    with pytest.raises(ValueError, match="shapes"):
        unload.write_archive(profile, OBS, f"file://{tmp_path}/b", shapes=counts)
    taps = normalised(window("hann", 33))
    assert taps.sum() == pytest.approx(1) and taps.argmax() == 16
