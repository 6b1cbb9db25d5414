"""Responses, calibration, quantizers, channelizers and dedispersion against plain numpy."""

import math
from dataclasses import replace

import numpy as np
import pytest

from sampledeck.functions import quantizers, responses
from sampledeck.functions.numeric import chirp
from sampledeck.operators import calibrate, cyclic, detect, fold, kernels, lags
from sampledeck.plans import pipelines
from sampledeck.plans.observation import Observation, Signal


def volts(spark, x, **more):
    """A signal of x[sample, channel, polarization], complex or real."""
    n, nchan, npol = x.shape
    analytic = np.iscomplexobj(x)
    obs = Observation(**({"state": "Analytic" if analytic else "Nyquist", "ndim": 2 if analytic else 1, "nchan": nchan, "npol": npol, "ndat": n, "rate": 1e6, "centre_frequency": 1400.0, "bandwidth": 1.0} | more))
    rows = [(i, c, p, *((float(x[i, c, p].real), float(x[i, c, p].imag)) if analytic else (float(x[i, c, p]),))) for i in range(n) for c in range(nchan) for p in range(npol)]
    return Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, " + ("re double, im double" if analytic else "v double")), obs)


def cube(signal):
    rows = signal.data.toPandas()
    out = np.zeros((int(rows.idat.max()) + 1, int(rows.ichan.max()) + 1, int(rows.ipol.max()) + 1), complex)
    out[rows.idat, rows.ichan, rows.ipol] = rows.re + 1j * rows.im if "re" in rows else rows.v
    return out


def noise(*shape, seed=0):
    g = np.random.default_rng(seed)
    return g.standard_normal(shape) + 1j * g.standard_normal(shape)


@pytest.mark.parametrize("real", [False, True])
def test_headers_say_what_kernels_make(spark, real):
    x = noise(1000, 1, 2)
    signal = volts(spark, x.real if real else x)
    response = np.fft.fft([0.5, 0.25j], 64)
    jones = np.zeros((64, 2, 2), complex)
    jones[:, 0, 0], jones[:, 1, 1] = response, 1
    made = [kernels.convolve(signal, response, (8, 4)), kernels.convolve_matrix(signal, jones, (8, 4)), kernels.filterbank(signal, 4), kernels.filterbank(signal, 4, 8, None, (2, 1)), kernels.tfp_filterbank(signal, 8)]
    made += [] if real else [kernels.polyphase_filterbank(signal, 8, np.hanning(32))]
    for out in made:
        found = cube(out)
        assert found.shape == (out.obs.ndat, out.obs.nchan, out.obs.npol)
        assert out.obs.rate == pytest.approx(1e6 * out.obs.ndat / 1000, rel=0.2)
    assert np.allclose(cube(made[0])[:, 0, 0], cube(made[1])[:, 0, 0])
    assert made[0].obs == made[1].obs and made[0].obs.start_us == (16 if real else 8)


def test_a_matrix_that_varies_with_frequency_and_channel(spark):
    x = noise(300, 2, 2)
    by_channel = {c: np.fft.fft(noise(3, 2, 2, seed=c + 5), 64, axis=0) for c in range(2)}
    found = cube(kernels.convolve_matrix(volts(spark, x), by_channel, (8, 8)))
    for c in range(2):
        taps = np.fft.ifft(by_channel[c], axis=0)[:3]
        for n in range(0, 200, 17):
            assert np.allclose(found[n, c], sum(taps[k] @ x[n + 8 - k, c] for k in range(3)))


def test_apodization_and_filterbank_in_blocks(spark):
    x = noise(256, 2, 1)
    window = np.hanning(64)
    found = cube(kernels.convolve(volts(spark, x), np.ones(64, complex), (8, 8), window))
    assert np.allclose(found[:48, 1, 0], (x[:64, 1, 0] * window)[8:56])
    found = cube(kernels.filterbank(volts(spark, x), 4, 16))
    block = np.fft.fftshift(np.fft.fft(x[64:128, 1, 0])).reshape(4, 16)
    assert np.allclose(found[16:32, 4:8, 0].T, np.fft.ifft(np.fft.ifftshift(block, axes=1), axis=1))


def dispersed(n, obs, at):
    """An impulse as dispersion leaves it: the inverse of the response that undoes it."""
    x = np.zeros(n, complex)
    x[at] = 1
    return np.fft.ifft(np.fft.fft(x) * chirp(obs.dispersion_measure, obs.centre_frequency, obs.bandwidth, n, dc_zero=False).conj())


@pytest.mark.parametrize("option", ["8:A", "8:B", "8:D", "8"])
def test_filterbank_options_bring_a_pulse_together(spark, option):
    obs = Observation(state="Analytic", ndim=2, nchan=1, npol=1, ndat=1 << 14, rate=1e6, centre_frequency=150.0, bandwidth=1.0, dispersion_measure=0.4)
    x = dispersed(1 << 14, obs, 9000)
    signal = volts(spark, x[:, None, None], **{k: getattr(obs, k) for k in ("centre_frequency", "bandwidth", "dispersion_measure")})
    bank = pipelines.Filterbank.parse(option)
    out = pipelines.channelized(signal, bank, coherent=True)
    power = np.abs(cube(out)[:, :, 0]) ** 2
    assert power.shape == (out.obs.ndat, 8)
    sharp = power.max(0) / power.sum(0)  # of each channel's power, what its best sample has
    plain = np.abs(cube(kernels.filterbank(signal, 8))[:, :, 0]) ** 2
    assert sharp.mean() > 2.5 * (plain.max(0) / plain.sum(0)).mean()
    if option == "8:B":
        assert sharp.min() > 0.9


@pytest.mark.parametrize("state", ["Intensity", "PPQQ", "Analytic"])
def test_incoherent_filterbank(spark, state):
    x = noise(160, 1, 2).real
    found = cube(kernels.incoherent_filterbank(volts(spark, x), 8, state))
    spectra = np.fft.rfft(x[:, 0].reshape(10, 16, 2), axis=1)[:, :-1]
    expected = spectra if state == "Analytic" else np.abs(spectra) ** 2
    assert np.allclose(found, expected.sum(2, keepdims=True) if state == "Intensity" else expected)
    with pytest.raises(ValueError):
        kernels.incoherent_filterbank(volts(spark, x), 6)


def test_products_of_responses():
    a, b = noise(4, 8), noise(1, 32, seed=1)
    assert np.allclose(responses.product([a, b]), a * b.reshape(4, 8))
    m, k = noise(4, 8, 2, 2, seed=2), noise(1, 8, 2, 2, seed=3)
    assert np.allclose(responses.product([m, k]), m @ k) and np.allclose(responses.product([m, a, k]), (m * a[..., None, None]) @ k)
    assert np.allclose(responses.product([a, m]), m * a[..., None, None])
    assert np.allclose(responses.product([b, a], 1), a * b.reshape(4, 8))
    for wrong in ([a, noise(3, 8)], [], [a, noise(4, 6)]):
        with pytest.raises(ValueError):
            responses.product(wrong)


def test_shapes_of_responses():
    a = noise(4, 8)
    assert (responses.fft_order(responses.by_frequency(a)) == a).all() and (responses.by_frequency(a)[2, 4] == a[2, 0]).all()
    assert (responses.rotated(a, 9).ravel()[:5] == a.ravel()[9:14]).all() and (responses.rotated(responses.rotated(a, 5), -5) == a).all()
    assert (responses.halves_swapped(a)[0] == a[2]).all()
    assert np.allclose(responses.scrunched(a, 2)[1], [a[1, :4].sum(), a[1, 4:].sum()])
    with pytest.raises(ValueError):
        responses.scrunched(a, 3)
    x = noise(5, 4, 8, seed=4)
    assert np.allclose(responses.power(x, a)[3, 3], sum(abs(x[k, 3, 3] * a[3, 3]) ** 2 for k in range(5)))


def test_calibration_undoes_the_receiver(spark):
    """A reference at 45 degrees through known receivers: parameters come out, and voltages go back."""
    g = np.random.default_rng(6)
    gain, ratio, phase = np.array([1.5, 0.7]), np.array([0.8, 1.3]), np.array([0.4, -2.0])
    one = noise(20_000, 1, 1, seed=7)[:, :, 0] / 2  # power 1/2 a probe, the same voltage on both
    jones = responses.single_axis(gain, ratio, phase)[0]
    sky = np.repeat(one[:, :, None], 2, axis=2)
    seen = np.einsum("cij,ncj->nci", jones, np.repeat(sky, 2, axis=1))
    seen[10_000:] = 0.1 * noise(10_000, 2, 2, seed=8)  # the reference is off
    rows = seen[:2000]
    signal = volts(spark, rows, bandwidth=2.0)
    found = {r.ichan: r for r in calibrate.receiver_parameters(detect.coherence(signal)).collect()}
    power = np.mean(np.abs(one[:2000]) ** 2) * 2
    for c in range(2):
        assert found[c].gain == pytest.approx(gain[c] * math.sqrt(power)) and found[c].ratio == pytest.approx(ratio[c]) and found[c].phase == pytest.approx(phase[c])
    back = cube(calibrate.calibrated(signal, calibrate.receiver_parameters(detect.coherence(signal))))
    assert np.allclose(back, np.repeat(sky[:2000], 2, axis=1) / math.sqrt(power))
    half = volts(spark, np.concatenate([seen[:2000], seen[10_000:12_000]]), bandwidth=2.0)
    from pyspark.sql import functions as F

    on = {r.ichan: r for r in calibrate.receiver_parameters(detect.coherence(half), F.col("idat") < 2000).collect()}
    assert on[0].ratio == pytest.approx(0.8, rel=0.02) and on[1].phase == pytest.approx(-2.0, abs=0.02) and g is not None
    inverse = responses.undone(np.array([[[[1, 2], [3, 4j]], [[0, 0], [0, 0]]]], complex))
    assert np.allclose(inverse[0, 0] @ np.array([[1, 2], [3, 4j]]), np.eye(2)) and not inverse[0, 1].any()


@pytest.mark.parametrize(("levels", "spacing"), [(3, 1.224), (3, 0.8), (9, 0.5), (9, 0.9), (5, 0.7)])
def test_quantizer_correction(levels, spacing):
    """Against the mean products of quantized normal samples, by quadrature of the joint density."""
    node = np.linspace(-8, 8, 1601)
    weight = np.exp(-node * node / 2) / np.sqrt(2 * np.pi) * (node[1] - node[0])
    q = lambda v: np.clip(np.round(v / spacing), -(levels // 2), levels // 2)
    lag = [(weight * q(node) ** 2).sum()]
    wanted = [1.0, 0.9, 0.5, 0.1, 0.0, -0.3, -0.8]
    for rho in wanted[1:]:
        inner = q(rho * node[:, None] + math.sqrt(1 - rho * rho) * node[None, :]) @ weight
        lag.append((weight * q(node) * inner).sum())
    assert quantizers.spacing_for(levels, lag[0]) == pytest.approx(spacing, abs=2e-2)
    assert quantizers.corrected(levels, np.array(lag)) == pytest.approx(wanted, abs=8e-3)
    with pytest.raises(ValueError):
        quantizers.corrected(levels, np.array([5.0 * levels**2, 0.0]))


def test_corrected_lags_of_groups(spark):
    rows = [(part, lag, r) for part, values in ((1, [0.54, 0.2, 0.0]), (2, [0.4, -0.1, 0.39]), (3, [0.54, 0.2]), (4, [0.0, 0.0, 0.0]), (5, [1.0, 0.5, 0.2])) for lag, r in enumerate(values)]
    found = lags.quantizer_corrected(spark.createDataFrame(rows, "part int, lag int, r double"), 3, 3, "part").collect()
    assert {r.part for r in found} == {1, 2}
    for part, values in ((1, [0.54, 0.2, 0.0]), (2, [0.4, -0.1, 0.39])):
        assert [r.r for r in sorted(found) if r.part == part] == pytest.approx(quantizers.corrected(3, np.array(values), 8193).tolist(), abs=1e-6)


@pytest.mark.parametrize("levels", [3, 9])
def test_the_surface_is_the_integral_to_a_millionth(spark, levels):
    g, rows, expected = np.random.default_rng(levels), [], {}
    rho = np.sin(np.linspace(-math.pi / 2, math.pi / 2, 4001))
    for part, spacing in enumerate(np.exp(g.uniform(math.log(0.2), math.log(4.0), 6)).tolist()):
        at = g.integers(0, 4001, 15)
        products = quantizers.correlation(levels, spacing, rho)[at]
        rows += [(part, lag, float(r)) for lag, r in enumerate([quantizers.output_power(levels, spacing), *products])]
        expected |= {(part, lag + 1): rho[k] for lag, k in enumerate(at.tolist())}
    found = lags.quantizer_corrected(spark.createDataFrame(rows, "part int, lag int, r double"), 16, levels, "part")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.part, r.lag): r.r for r in found.collect()}
    assert all(abs(got[k] - v) < 2e-6 for k, v in expected.items()) and all(got[part, 0] == 1.0 for part in range(6))


def test_two_bit_levels_keep_power():
    for low in (0.3, 0.5, 0.66, 0.9):
        within, beyond = quantizers.two_bit_voltages(low)
        assert low * within**2 + (1 - low) * beyond**2 == pytest.approx(1)
        inner, outer = quantizers.two_bit_levels(low)
        assert inner < 1 < outer and inner / outer == pytest.approx(within / beyond)
    x = np.random.default_rng(0).standard_normal(1_000_000)
    low = (np.abs(x) < 0.7).mean()
    within, beyond = quantizers.two_bit_voltages(low)
    assert within == pytest.approx(np.sqrt((x[np.abs(x) < 0.7] ** 2).mean()), rel=5e-3) and beyond == pytest.approx(np.sqrt((x[np.abs(x) >= 0.7] ** 2).mean()), rel=5e-3)


POLYNOMIAL = """0833-45   25-Feb-99   31200.00   51234.36111111111            67.990  0.001 -6.000
 1234567.891234   11.1946499395   7  120    6    1400.000
  1.25000000000000000D-07  2.00000000000000000D-03 -3.00000000000000000D-05
  4.00000000000000000D-09 -5.00000000000000000D-12  0.00000000000000000D+00
0833-45   25-Feb-99  103200.00   51234.44444444444            67.990  0.001 -6.000
 1315168.500000   11.1946499395   7  120    6    1400.000
  1.0D-07  2.0D-03 -3.0D-05
  4.0D-09 -5.0D-12  0.0D+00
"""


def test_polynomial_predictor(spark):
    segments = fold.parse_polynomials(POLYNOMIAL)
    span, begin = fold.polynomial_span(POLYNOMIAL)
    assert span == 7_200_000_000 and len(segments) == 2 and segments[0][0] - begin == span // 2
    middle, phase, frequency, c = segments[0]
    assert middle == (51234 - 40587) * 86_400_000_000 + 31_200_000_000 and len(c) == 6
    times = [middle - 3_000_000_000, middle, middle + 1_234_567, segments[1][0] + 5_000_000, begin - 5, begin + 2 * span + 10]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, us long")
    found = {r.k: r.turns for r in fold.predicted(rows, fold.predictor(spark, segments, span, begin), span, begin).collect()}
    assert found.keys() == {0, 1, 2, 3}
    for k in found:
        mid, phase, frequency, c = segments[k == 3]
        dt = (times[k] - mid) / 60e6
        assert found[k] == pytest.approx(phase + 60 * dt * frequency + sum(x * dt**n for n, x in enumerate(c)), abs=1e-6)


def test_snapped_divisions(spark):
    from pyspark.sql import functions as F

    for rate, start, epoch, length in ((1000.0, 0.25, 3_300, 33_370), (333.3, 7.0, 0, 12_345), (10.0, 0.0, 50_000, 1_000_000)):
        rows = spark.range(2000).select(F.col("id").alias("idat"), fold.snapped_division(F.col("id"), rate, start, epoch, length).alias("d")).collect()
        begins = {d: round((epoch + d * length - start) * 1e-6 * rate) for d in range(-3, 3000)}
        assert all(begins[r.d] <= r.idat < begins[r.d + 1] for r in rows)
    assert (fold.first_whole_turn(12.3), fold.first_whole_turn(12.3, 0.5), fold.first_whole_turn(12.0)) == (13, 12, 12)


def test_snapped_divisions_of_boundaries_just_between_samples(spark):
    from fractions import Fraction

    from pyspark.sql import functions as F

    # 3.3 + 60 * 33.37 is 2005.5, and as doubles a little less
    for rate, start, epoch, length in ((1000.0, 0.0, 3_300, 33_370), (0.1, 0.0, 15_000_000, 70_000_000), (1000.0000000001, 0.25, 3_300, 33_370)):
        rows = spark.range(-50, 9000).select(F.col("id").alias("idat"), fold.snapped_division(F.col("id"), rate, start, epoch, length).alias("d")).collect()
        begins = {d: round((epoch + d * length - Fraction(str(start))) * Fraction(str(rate)) / 1_000_000) for d in range(-20, 2000)}
        assert all(begins[r.d] <= r.idat < begins[r.d + 1] for r in rows)
        assert fold.snapped_divisions(np.array([r.idat for r in rows]), rate, start, epoch, length).tolist() == [r.d for r in rows]


def test_cyclic_and_phase_locked_folds_in_runs(spark, monkeypatch):
    x = noise(400, 1, 1)
    x[37] = np.nan
    rows = volts(spark, x)
    holed = Signal(rows.data.filter("idat <> 37"), rows.obs)
    monkeypatch.setattr(cyclic, "RUN_SAMPLES", 64)
    z = x[:, 0, 0]
    found = {(r.lag, r.ibin): (r.re + 1j * r.im, r.hits) for r in cyclic.cyclic_lags(holed, 4, 20, 5).collect()}
    expected = {}
    for i in range(400):
        for lag in range(4):
            if i + lag < 400 and 37 not in (i, i + lag):
                key = lag, (2 * i + lag) % 40 * 5 // 40
                a, n = expected.get(key, (0, 0))
                expected[key] = a + z[i] * z[i + lag].conj(), n + 1
    assert found.keys() == expected.keys() and all(found[k][1] == expected[k][1] and found[k][0] == pytest.approx(expected[k][0]) for k in found)
    spectra = {(r.ichan, r.ibin): r.v for r in cyclic.cyclic_spectra(cyclic.cyclic_lags(holed, 4, 20, 5), 4).collect()}
    for ibin in range(5):
        mean = np.array([expected[lag, ibin][0] / expected[lag, ibin][1] for lag in range(4)])
        assert [spectra[k, ibin] for k in range(6)] == pytest.approx(np.fft.irfft(mean, 6).tolist())
    locked = {(r.ichan, r.ibin): (r.v, r.hits) for r in cyclic.phase_locked(holed, 4, 20, 5).collect()}
    for ibin in range(5):
        slots = [z[t * 20 + ibin * 4 : t * 20 + ibin * 4 + 4] for t in range(20) if not t * 20 + ibin * 4 <= 37 < t * 20 + ibin * 4 + 4]
        power = sum(np.abs(np.fft.fft(s)) ** 2 for s in slots)
        assert [locked[k, ibin][0] for k in range(4)] == pytest.approx(power.tolist()) and locked[0, ibin][1] == len(slots)


def test_polyphase_filterbank_is_numpys(spark):
    x = noise(200, 1, 1)
    taps = np.random.default_rng(1).standard_normal(32)
    found = cube(kernels.polyphase_filterbank(volts(spark, x), 8, taps))
    for b in (0, 3, 20):
        expected = np.fft.fftshift(np.fft.fft((x[b * 8 : b * 8 + 32, 0, 0] * taps).reshape(4, 8).sum(0)))
        assert np.allclose(found[b, :, 0], expected)
    assert replace(volts(spark, x).obs, ndat=3).ndat == 3
