"""Operators against numpy and closed forms, and their invariants."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.functions import numeric
from sampledeck.operators import cyclic, delay, detect, digitize, fold, kernels, rfi, scrunch, stats, weights
from sampledeck.plans import pipelines
from sampledeck.plans.observation import Observation, Signal

LONG = "idat long, ichan int, ipol int, v double"
VOLTS = "idat long, ichan int, ipol int, re double, im double"


def real(spark, x, **header):
    """A signal of x[sample, channel, polarization]."""
    n, c, p = x.shape
    rows = [(i, j, k, float(x[i, j, k])) for i in range(n) for j in range(c) for k in range(p)]
    return Signal(spark.createDataFrame(rows, LONG), Observation(nchan=c, npol=p, ndat=n, centre_frequency=1400.0, bandwidth=-100.0, rate=1000.0, **header))


def volts(spark, z):
    n, c, p = z.shape
    rows = [(i, j, k, float(z[i, j, k].real), float(z[i, j, k].imag)) for i in range(n) for j in range(c) for k in range(p)]
    return Signal(spark.createDataFrame(rows, VOLTS), Observation(state="Analytic", ndim=2, nchan=c, npol=p, ndat=n, centre_frequency=1400.0, bandwidth=-100.0, rate=1000.0))


def cube(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["idat"], r["ichan"], r["ipol"]] = r[column]
    return out


def noise(*shape, seed=1):
    g = np.random.default_rng(seed)
    return g.standard_normal(shape)


def cnoise(*shape, seed=1):
    return noise(*shape, seed=seed) + 1j * noise(*shape, seed=seed + 1)


def test_scrunch_twice_is_scrunch_by_four(spark):
    s = real(spark, noise(23, 3, 2))
    twice = scrunch.tscrunch(scrunch.tscrunch(s, 2), 2)
    assert twice.obs.ndat == 5 and twice.obs.scale == 4
    np.testing.assert_allclose(cube(twice.data, (5, 3, 2)), cube(scrunch.tscrunch(s, 4).data, (5, 3, 2)))


def test_scrunch_drops_the_remainder_and_keeps_the_band(spark):
    x = noise(10, 5, 1)
    out = scrunch.fscrunch(real(spark, x), 2)
    np.testing.assert_allclose(cube(out.data, (10, 2, 1))[:, :, 0], x[:, :4, 0].reshape(10, 2, 2).sum(2))
    s = real(spark, x).obs
    assert out.obs.frequency(0) == pytest.approx((s.frequency(0) + s.frequency(1)) / 2)


def test_factor_one_returns_the_signal_itself(spark):
    s = real(spark, noise(2, 1, 1))
    assert scrunch.scrunch(s) is s and detect.square_law(s) is s


def test_pscrunch_wants_two_polarizations(spark):
    with pytest.raises(ValueError):
        scrunch.pscrunch(real(spark, noise(2, 1, 1)))
    x = noise(4, 2, 2)
    np.testing.assert_allclose(cube(scrunch.pscrunch(real(spark, x)).data, (4, 2, 1))[:, :, 0], x.sum(2) / math.sqrt(2))


def test_voltages_do_not_scrunch(spark):
    with pytest.raises(ValueError):
        scrunch.tscrunch(volts(spark, cnoise(4, 1, 1)), 2)


def test_stokes_of_a_sample_is_fully_polarized(spark):
    rows = detect.stokes(volts(spark, cnoise(9, 2, 2))).data.collect()
    assert len(rows) == 18
    for r in rows:
        assert r["s0"] ** 2 == pytest.approx(r["s1"] ** 2 + r["s2"] ** 2 + r["s3"] ** 2)


def test_zoom_refuses_what_is_outside(spark):
    s = real(spark, noise(2, 8, 1))
    out = scrunch.zoom(s, 1400.0, 50.0)
    assert out.obs.nchan == 4 and out.obs.centre_frequency == pytest.approx(1400.0)
    assert [out.obs.frequency(c) for c in range(4)] == pytest.approx([s.obs.frequency(c) for c in range(2, 6)])
    with pytest.raises(ValueError):
        scrunch.zoom(s, 1460.0, 50.0)


@pytest.mark.parametrize("parts", [1, 3])
def test_fold_counts_every_sample_whatever_the_partitions(spark, parts):
    rows = spark.range(1000).repartition(parts).select((F.col("id") * 12345 - 3_000_000).alias("us"), (F.col("id") % 7).cast("double").alias("v"))
    out = fold.fold(rows.withColumn("ibin", fold.constant_bin(F.col("us"), 0, 37_000, 16))).collect()
    assert sum(r["hits"] for r in out) == 1000 and sum(r["sum"] for r in out) == sum(i % 7 for i in range(1000))
    expected = {}
    for i in range(1000):
        b = (i * 12345 - 3_000_000) % 37_000 * 16 // 37_000
        expected[b] = expected.get(b, 0) + 1
    assert {r["ibin"]: r["hits"] for r in out} == expected


def test_normalise_fills_empty_bins_with_the_mean(spark):
    rows = spark.createDataFrame([(0, 0, 6.0, 2), (0, 2, 5.0, 1), (0, 3, None, 0)], "ichan int, ibin int, sum double, hits long")
    out = {r["ibin"]: (r["amp"], r["hits"]) for r in fold.normalise(rows, 4, "ichan").collect()}
    assert out == {0: (3.0, 2), 1: (4.0, 0), 2: (5.0, 1), 3: (4.0, 0)}


def test_nothing_folds_to_nothing(spark):
    rows = spark.createDataFrame([], "ichan int, ibin int, v double")
    assert fold.normalise(fold.fold(rows, "ichan"), 4, "ichan").count() == 0


def test_fold_valid_skips_zapped_and_nulls(spark):
    rows = spark.createDataFrame([(0, 1.0, True), (0, 2.0, False), (0, None, True)], "ibin int, v double, ok boolean")
    (r,) = fold.fold(rows, valid=F.col("ok")).collect()
    assert (r["sum"], r["hits"]) == (1.0, 1)


def test_choose_nbin():
    assert fold.choose_nbin(1.0, 1000.0) == 512
    assert fold.choose_nbin(10.0, 1e6) == 1024
    assert fold.choose_nbin(0.001, 1000.0) == 1
    assert fold.choose_nbin(1.0, 1000.0, 2048) == 2048
    assert fold.choose_nbin(1.0, 1000.0, 2048, force_sensible=True) == 512


def test_predictor_covers_its_segments_only(spark):
    seg = fold.predictor(spark, [(50, 0.25, 1.0, [])], 100, 0)
    rows = spark.createDataFrame([(50, 1.0), (250, 1.0)], "us long, v double")
    (r,) = fold.predicted(rows, seg, 100, 0).collect()
    assert r["turns"] == 0.25


def test_kurtosis_of_constant_power_is_zero(spark):
    found = rfi.kurtosis(real(spark, np.ones((100, 2, 2))), 50).collect()
    assert len(found) == 8 and all(abs(r["sk"]) < 1e-12 for r in found)
    assert all(r["sk"] == 0 for r in rfi.kurtosis(real(spark, np.zeros((50, 1, 1))), 50).collect())


def test_kurtosis_is_one_for_noise_and_masks_a_pulse(spark):
    power = np.abs(cnoise(512, 4, 2)) ** 2
    power[128:136, 2] *= 400
    s = real(spark, power, state="PPQQ")
    found = rfi.kurtosis(s, 128)
    mask = {(r["ipart"], r["ichan"]) for r in rfi.mask_parts(found, numeric.sk_limits(128, 4.0)).collect()}
    assert mask == {(1, 2)}
    zapped = rfi.apply_mask(s, rfi.mask_parts(found, numeric.sk_limits(128, 4.0)), 128)
    assert zapped.filter("zapped").count() == 256 and zapped.filter("zapped and v <> 0").count() == 0
    counts = {(r["ichan"], r["ipol"]): r["hits_left"] for r in rfi.mask_counts(zapped).collect()}
    assert counts[2, 0] == 384 and counts[0, 1] == 512


@pytest.mark.parametrize(("m", "low", "high"), [(50, 0.452965, 2.348475), (128, 0.601904, 1.762968), (1024, 0.834186, 1.216955)])
def test_kurtosis_limits(m, low, high):
    assert numeric.sk_limits(m, 3.0) == pytest.approx((low, high), abs=2e-5)


@pytest.mark.parametrize("m", [8, 16, 23])
def test_kurtosis_limits_of_few_spectra(m):
    """Both tails of the exact ones, and the upper of Pearson's, against a simulation."""
    x = np.random.default_rng(m).exponential(size=(600_000, m))
    sk = (m + 1) / (m - 1) * (m * (x * x).sum(1) / x.sum(1) ** 2 - 1)
    for sigmas, chance in ((2.0, 0.02275), (3.0, 0.00135)):
        low, high = numeric.sk_exact_limits(m, sigmas)
        assert (sk < low).mean() == pytest.approx(chance, rel=0.12) and (sk > high).mean() == pytest.approx(chance, rel=0.12)
        assert (sk > numeric.sk_limits(m, sigmas)[1]).mean() == pytest.approx(chance, rel=0.25)


def test_kurtosis_limits_have_no_jump():
    found = np.array([numeric.sk_limits(m, 3.0) for m in range(3, 60)])
    assert (np.diff(found[:, 0]) > 0).all() and (np.diff(found[4:, 1]) < 0).all()
    assert abs(np.diff(found[15:], 2, axis=0)).max() < 0.01  # m from 18 on, across 24
    with pytest.raises(ValueError):
        numeric.sk_limits(2)


def test_kurtosis_limits_of_many_spectra():
    assert numeric.sk_limits(40000, 3.0) == pytest.approx((0.97, 1.03))


def test_quadrature_against_the_error_function():
    def f(x):
        return 2 / math.sqrt(math.pi) * np.exp(-x * x)

    assert numeric.integrate(f, 0, 1) == pytest.approx(math.erf(1))
    assert numeric.integrate(f, 1, math.inf) == pytest.approx(math.erfc(1))
    assert numeric.integrate(f, -math.inf, -1) == pytest.approx(math.erfc(1))
    assert math.erf(numeric.solve(lambda x: math.erf(x) - 0.6, 0, 2)) == pytest.approx(0.6)


def test_delays_round_half_up_and_shift(spark):
    x = noise(40, 3, 1)
    table = spark.createDataFrame([(0, 0), (1, 3), (2, -2)], "ichan int, delay long")
    out = delay.sample_delay(real(spark, x), table)
    got = cube(out.data, (35, 3, 1))[:, :, 0]
    # relative: the most delayed channel stays and the others are moved up to it
    np.testing.assert_allclose(got, np.stack([x[3:38, 0, 0], x[0:35, 1, 0], x[5:40, 2, 0]], 1))
    assert out.obs.ndat == 35 and out.obs.start_us == 3000


def test_dedispersion_aligns_a_pulse(spark):
    s = real(spark, np.zeros((400, 8, 1)))
    obs = replace(s.obs, dispersion_measure=50.0)
    table = {r["ichan"]: r["delay"] for r in delay.dispersion_delays(spark, obs).collect()}
    assert len(set(table.values())) > 3
    x = np.zeros((400, 8, 1))
    for c, late in table.items():
        x[200 - late, c] = 1.0
    out = delay.dedisperse(Signal(real(spark, x).data, obs))
    assert out.data.filter("v = 1").select("idat").distinct().count() == 1


def test_rescale_by_interval_and_zero_variance(spark):
    x = noise(40, 2, 1)
    x[:, 1] = 3.0
    out = cube(stats.rescale(real(spark, x), 20).data, (40, 2, 1))
    np.testing.assert_allclose(out[:20, 0, 0].mean(), 0, atol=1e-12)
    np.testing.assert_allclose(out[20:, 0, 0].std(), 1)
    assert (out[:, 1] == 0).all()


def test_decay_baseline_is_the_recurrence(spark):
    x = noise(50, 1, 1)
    base, expected = x[0, 0, 0], []
    for v in x[:, 0, 0]:
        base += (v - base) / 8
        expected.append(v - base)
    np.testing.assert_allclose(cube(stats.decay_baseline(real(spark, x), 8.0).data, (50, 1, 1))[:, 0, 0], expected)


def test_birdies(spark):
    x = np.ones((4, 32, 1)) + 0.01 * noise(4, 32, 1)
    x[:, 11] += 5
    assert stats.birdie_channels(real(spark, x), 4, 4.0) == [11]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
@pytest.mark.parametrize("msb", [False, True])
def test_bits_go_round(spark, bits, msb):
    rows = spark.range(64).select((F.col("id")).alias("idat"), F.pmod(F.xxhash64("id"), F.lit(1 << bits)).cast("int").alias("code"), F.lit(0).alias("ichan"))
    back = digitize.unpack_bits(digitize.pack_bits(rows, bits, "ichan", msb_first=msb), bits, "ichan", msb_first=msb)
    assert sorted(map(tuple, back.select("idat", "code").collect())) == sorted(map(tuple, rows.select("idat", "code").collect()))


def test_digitizer_clips_and_truncates(spark):
    x = np.array([-100.0, -0.1, 0.0, 0.49, 0.51, 100.0]).reshape(-1, 1, 1)
    codes = [r["code"] for r in digitize.digitize(real(spark, x), 2).orderBy("idat").collect()]
    assert codes == [0, 1, 2, 2, 2, 3]


def test_convolution_with_unit_response_is_identity(spark):
    z = cnoise(100, 1, 1)
    out = kernels.convolve(volts(spark, z), np.ones(16, complex), (3, 2))
    got = cube(out.data, (out.obs.ndat, 1, 1), "re")[:, 0, 0]
    np.testing.assert_allclose(got, z[3 : 3 + out.obs.ndat, 0, 0].real, atol=1e-12)
    assert out.obs.ndat == ((100 - 16) // 11 + 1) * 11


def test_real_voltages_become_analytic(spark):
    t = np.arange(256)
    x = np.cos(2 * np.pi * t / 16)
    s = replace(real(spark, x.reshape(-1, 1, 1)).obs, state="Nyquist")
    out = kernels.convolve(Signal(real(spark, x.reshape(-1, 1, 1)).data, s), np.ones(32, complex), (0, 0))
    power = cube(out.data, (128, 1, 1), "re") ** 2 + cube(out.data, (128, 1, 1), "im") ** 2
    np.testing.assert_allclose(power, power[0, 0, 0])
    assert out.obs.rate == 500.0


def test_filterbank_keeps_power_and_one_channel_is_identity(spark):
    z = cnoise(64, 1, 1)
    bank = kernels.filterbank(volts(spark, z), 8)
    power = bank.data.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0]
    assert power == pytest.approx(8 * float((np.abs(z) ** 2).sum()))
    same = kernels.filterbank(volts(spark, z), 1, 16)
    np.testing.assert_allclose(cube(same.data, (64, 1, 1), "im")[:, 0, 0], z[:, 0, 0].imag, atol=1e-12)


def test_coherent_dedispersion_gathers_a_dispersed_pulse(spark):
    n = 1024
    response = numeric.chirp(50.0, 1400.0, -1.0, n, dc_zero=False)
    z = np.zeros(n, complex)
    z[n // 2] = 1
    smeared = np.fft.ifft(np.fft.fft(z) * np.conj(response))
    assert np.abs(smeared).max() < 0.5
    s = volts(spark, smeared.reshape(-1, 1, 1))
    out = kernels.convolve(s, response, (0, 0))
    assert np.nanmax(cube(out.data, (n, 1, 1), "re")) == pytest.approx(1.0)


def test_cyclic_lags_against_brute_force(spark):
    z = cnoise(60, 1, 1)[:, 0, 0]
    found = {(r["lag"], r["ibin"]): complex(r["re"], r["im"]) for r in cyclic.cyclic_lags(volts(spark, z.reshape(-1, 1, 1)), 4, 12, 3).collect()}
    expected = {}
    for lag in range(4):
        for i in range(60 - lag):
            b = (2 * i + lag) % 24 * 3 // 24
            expected[lag, b] = expected.get((lag, b), 0) + z[i] * np.conj(z[i + lag])
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k] == pytest.approx(v)


def test_weights_spread_over_the_blocks_that_use_them(spark):
    w = spark.createDataFrame([(k, 0 if k == 3 else 1) for k in range(12)], "iweight long, weight int")
    out = {r["iblock"]: r["weight"] for r in weights.convolved(w, 10, 32, 16, 6).collect()}
    assert out == {b: 0 if b * 16 <= 39 and b * 16 + 31 >= 30 else 1 for b in range(6)}


def test_excised_blocks_are_zero(spark):
    x = np.full((40, 1, 1), 5.0)
    x[:20] = 0.1
    rows = weights.excise(real(spark, x), 20, 1.0, 0.5, 1.0).orderBy("idat").collect()
    assert [r["weight"] for r in rows] == [1] * 20 + [0] * 20 and rows[-1]["v"] == 0


def test_channel_frequencies():
    obs = Observation(nchan=4, centre_frequency=1000.0, bandwidth=40.0)
    assert [obs.frequency(c) for c in range(4)] == [985.0, 995.0, 1005.0, 1015.0]
    assert replace(obs, dc_centred=True).frequency(0) == 980.0
    assert [replace(obs, swap=True).frequency(c) for c in range(4)] == [1005.0, 1015.0, 985.0, 995.0]
    assert [replace(obs, nsub_swap=2).frequency(c) for c in range(4)] == [995.0, 985.0, 1015.0, 1005.0]


def test_headers_follow_their_data():
    a = Observation(rate=10.0, ndat=20, state="Nyquist")
    assert a.with_state("Analytic").rate == 5.0 and a.with_state("Analytic").ndat == 10
    assert a.contiguous(a.later(20)) and not a.contiguous(a.later(21)) and not a.contiguous(replace(a, nchan=2))
    assert a.end_us == 2e6 and replace(a, ndat=0).end_us == 0


@pytest.mark.parametrize("text", ["128", "128:D", "64:B", "16:1024"])
def test_filterbank_option(text):
    bank = pipelines.Filterbank.parse(text)
    assert bank.nchan == int(text.split(":")[0])
    assert (bank.when, bank.freq_res) == {"128": ("A", 1), "128:D": ("D", 1), "64:B": ("B", 1), "16:1024": ("A", 1024)}[text]


def test_fold_program_finds_the_pulse(spark):
    z = 0.1 * cnoise(2000, 2, 2)
    z[::20] += 3
    config = pipelines.FoldConfig(period_us=20_000, nbin=10, epoch_us=0, subint_us=1_000_000)
    rows = pipelines.fold_signal(volts(spark, z), config).collect()
    assert len(rows) == 2 * 2 * 10
    for r in rows:
        assert (r["amp"] > 5) == (r["ibin"] == 0) and r["hits"] == 100


def test_optimal_fft_beats_its_neighbours():
    for taps in (10, 1000, 70000):
        n = numeric.optimal_fft(taps)
        assert n > taps and numeric.fft_cost(n, taps) <= numeric.fft_cost(2 * n, taps)


@pytest.mark.parametrize("samples", [1, 40, 1 << 15])
def test_runs_of_blocks_do_not_show(spark, monkeypatch, samples):
    monkeypatch.setattr(kernels, "RUN_SAMPLES", samples)
    z = cnoise(200, 2, 1)
    s = volts(spark, z)
    holed = Signal(s.data.filter("not (idat = 70 and ichan = 1)"), s.obs)
    out = kernels.convolve(holed, np.ones(16, complex), (3, 2))
    got = cube(out.data, (out.obs.ndat, 2, 1), "im")
    np.testing.assert_allclose(got[:, 0, 0], z[3 : 3 + out.obs.ndat, 0, 0].imag, atol=1e-12)
    lost = {b for b in range(out.obs.ndat // 11) if b * 11 <= 70 < b * 11 + 16}
    assert {k // 11 for k in np.flatnonzero(np.isnan(got[:, 1, 0]))} == lost


def test_convolution_by_a_response_is_a_circular_filter(spark):
    z, taps = cnoise(400, 1, 1), cnoise(5, seed=8)
    out = kernels.convolve(volts(spark, z), np.fft.fft(taps, 64), (4, 0))
    np.testing.assert_allclose(cube(out.data, (out.obs.ndat, 1, 1), "re")[:, 0, 0], np.convolve(z[:, 0, 0], taps)[4 : 4 + out.obs.ndat].real, atol=1e-10)
