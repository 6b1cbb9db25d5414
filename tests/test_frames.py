"""Frames dropped, swapped, doubled and invalid; delays of parts of a sample; products of polarizations."""

from dataclasses import replace

import numpy as np
import pytest

from sampledeck.operators import cyclic, delay, detect, kernels, stats
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources import frames

OBS = Observation(state="Analytic", ndim=2, nchan=2, nbit=8, rate=800.0, centre_frequency=1400.0, bandwidth=-4.0, start_us=1_000_000)
EACH, RATE = 8, 100


def written(folder, codes, lost=(), invalid=(), extra=b""):
    """Files of frames from second 5, frame 97 on: codes[frame, ipol, sample, channel, part]."""
    g = np.random.default_rng(0)
    all_frames = []
    for k in range(len(codes)):
        for p in range(2):
            second, number = divmod(5 * RATE + 97 + k, RATE)
            if (k, p) not in lost:
                all_frames.append(frames.frame_header(second, number, 10 + p, 64, (k, p) in invalid) + codes[k, p].astype(np.uint8).tobytes())
    order = np.argsort(np.arange(len(all_frames)) + g.integers(0, 5, len(all_frames)), kind="stable")
    out = [all_frames[i] for i in order]
    out.insert(7, frames.frame_header(5, 99, 3, 64) + bytes(32))  # of a thread that isn't ours
    out.append(all_frames[4])  # once more
    urls = []
    for k, part in enumerate((out[:31], out[31:32], out[32:])):
        (folder / f"{k}.frames").write_bytes(b"".join(part) + (extra if k == 2 else b""))
        urls.append(f"file://{folder}/{k}.frames")
    return urls


def test_frames_lost_swapped_and_invalid(spark, tmp_path):
    codes = np.random.default_rng(1).integers(0, 256, (260, 2, EACH, 2, 2))
    lost = {(0, 0), (3, 1), (4, 1), (259, 1)} | {(k, p) for k in range(120, 230) for p in range(2)}
    invalid = {(10, 0), (11, 1)}
    layout = frames.Layout(64, RATE, (10, 11))
    found = frames.read_frames(spark, written(tmp_path, codes, lost, invalid, b"half a frame"), layout, replace(OBS, nbit=8))
    assert (found.obs.ndat, found.obs.npol, found.obs.rate) == (260 * EACH, 2, 800.0)
    assert found.obs.start_us == 1_000_000 + (5 * RATE + 97) * EACH * 1250
    gone = lost | invalid
    rows = {tuple(r[:3]): (r.re, r.im) for r in found.data.collect()}
    expected = {(k * EACH + t, c, p): tuple(codes[k, p, t, c] - 127.5) for k in range(260) for p in range(2) if (k, p) not in gone for t in range(EACH) for c in range(2)}
    assert rows == expected
    assert {(r.iweight, r.ipol) for r in found.weights.table.collect()} == gone
    both = kernels.convolve(found, np.ones(16), (2, 2))
    whole = {(r.idat, r.ipol) for r in both.good().filter("ichan = 0").select("idat", "ipol").collect()}
    blocks = [(b, p) for b in range((260 * EACH - 16) // 12 + 1) for p in range(2) if not any((k, p) in gone for k in range(b * 12 // EACH, (b * 12 + 15) // EACH + 1))]
    assert whole == {(b * 12 + j, p) for b, p in blocks for j in range(12)}


def test_no_frames(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"")
    found = frames.read_frames(spark, [f"file://{tmp_path}/x"], frames.Layout(64, RATE), OBS)
    assert found.obs.ndat == 0 and found.data.count() == 0 and found.weights.table.count() == 0
    with pytest.raises(ValueError, match="rate"):
        frames.read_frames(spark, [f"file://{tmp_path}/x"], frames.Layout(64, RATE), replace(OBS, rate=5.0))
    with pytest.raises(ValueError, match="whole"):
        frames.Layout(65, RATE).samples(OBS)


def test_channels_are_aligned_to_parts_of_a_sample(spark):
    n, obs = 512, Observation(state="Analytic", ndim=2, nchan=4, npol=1, ndat=512, rate=1000.0, centre_frequency=1400.0, bandwidth=-80.0, dispersion_measure=7.0)
    delays = np.array([obs.dispersion_measure / 2.41e-4 * (1 / 1400.0**2 - 1 / obs.frequency(c) ** 2) * 1000 for c in range(4)])
    assert abs(delays - np.round(delays)).max() > 0.2
    pulse = lambda t: np.exp(-(((t - 250) / 6) ** 2)) * np.exp(0.3j * t)
    t = np.arange(n)
    rows = [(k, c, 0, float(z.real), float(z.imag)) for c in range(4) for k, z in enumerate(pulse(t + delays[c]))]
    signal = Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), obs)

    def spread(found):
        z = np.zeros((4, found.obs.ndat), complex)
        for r in found.data.collect():
            z[r.ichan, r.idat] = r.re + 1j * r.im
        return abs(z - z[:1]).max()

    assert spread(delay.dedisperse(signal)) > 0.05
    assert spread(delay.dedisperse(kernels.fractional_delay(signal, 128, (32, 32)))) < 0.01
    responses = kernels.dedispersion_responses(obs, 16, fractional=True)
    plain = kernels.dedispersion_responses(obs, 16)
    assert all(np.allclose(responses[c], plain[c] * kernels.gradient(16, x)) for c, x in enumerate(kernels.fractions_of_delays(obs)))


@pytest.fixture(scope="module")
def volts(spark):
    g = np.random.default_rng(8)
    x = g.standard_normal((90, 2, 2)) + 1j * g.standard_normal((90, 2, 2))
    rows = [(t, c, p, float(x[t, c, p].real), float(x[t, c, p].imag)) for t in range(90) for c in range(2) for p in range(2) if (t, c, p) != (40, 1, 0)]
    return x, Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), Observation(state="Analytic", ndim=2, nchan=2, npol=2, ndat=90, rate=1000.0))


def test_cyclic_products(volts):
    x, signal = volts
    pairs = {(0, 0): 0, (1, 1): 1, (0, 1): 2, (1, 0): 3}
    for products, outs in ((4, pairs), (1, {(0, 0): 0, (1, 1): 0}), (2, {(0, 0): 0, (1, 1): 1})):
        expected = {}
        for (p, q), out in outs.items():
            for c in range(2):
                for lag in range(3):
                    for i in range(90 - lag):
                        if (i, c, p) != (40, 1, 0) and (i + lag, c, q) != (40, 1, 0):
                            cell = expected.setdefault((c, out, lag, (2 * i + lag) % 20 * 5 // 20), [0, 0])
                            cell[0] += x[i, c, p] * np.conj(x[i + lag, c, q])
                            cell[1] += 1
        found = {(r.ichan, r.ipol, r.lag, r.ibin): (r.re + 1j * r.im, r.hits) for r in cyclic.cyclic_lags(signal, 3, 10, 5, products=products).collect()}
        assert found.keys() == expected.keys() and all(found[k][1] == expected[k][1] and abs(found[k][0] - expected[k][0]) < 1e-9 for k in found)


def test_phase_locked_and_passband_products(volts):
    x, signal = volts
    for products in (1, 2, 4):
        expected = {}
        for c in range(2):
            for turn in range(9):
                for slot in range(2):
                    at = turn * 10 + slot * 5
                    if products == 2:
                        cells = [(p, abs(np.fft.fft(x[at : at + 4, c, p])) ** 2) for p in range(2) if not (c == 1 and p == 0 and at <= 40 < at + 4)]
                    elif c == 1 and at <= 40 < at + 4:
                        continue
                    else:
                        a, b = (np.fft.fft(x[at : at + 4, c, p]) for p in range(2))
                        four = [abs(a) ** 2, abs(b) ** 2, (a.conj() * b).real, (a.conj() * b).imag]
                        cells = list(enumerate(four)) if products == 4 else [(0, four[0] + four[1])]
                    for p, v in cells:
                        for k in range(4):
                            cell = expected.setdefault((c * 4 + k, p, slot), [0.0, 0])
                            cell[0] += v[k]
                            cell[1] += 1
        found = {(r.ichan, r.ipol, r.ibin): (r.v, r.hits) for r in cyclic.phase_locked(signal, 4, 10, 2, products=products).collect()}
        assert found.keys() == expected.keys() and all(found[k] == (pytest.approx(expected[k][0]), expected[k][1]) for k in found)
    full = {(r.ichan, r.ipol): (r.total, r.n) for r in kernels.voltage_bandpass(signal, 8, full=True).collect()}
    parts = [b for b in range(11) if b != 5]
    for c in range(2):
        own = parts if c else list(range(11))
        a, b = (np.stack([np.fft.fftshift(np.fft.fft(x[8 * k : 8 * k + 8, c, p])) for k in own]) for p in range(2))
        for p, v in enumerate((abs(a) ** 2, abs(b) ** 2, (a.conj() * b).real, (a.conj() * b).imag)):
            assert all(full[c * 8 + k, p] == (pytest.approx(v.sum(0)[k]), len(own)) for k in range(8))


def test_channels_that_stand_off_in_an_interval(spark):
    g = np.random.default_rng(5)
    v = g.normal(10, 1, (200, 32))
    v[50:100, 7] += 40
    v[150:, 20] += 40
    rows = [(t, c, 0, float(v[t, c])) for t in range(200) for c in range(32)]
    signal = Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, v double"), Observation(nchan=32, ndat=200, rate=1000.0))
    found = {(r.ipart, r.ichan) for r in stats.birdie_mask(signal, 50, 4, 4.0).collect()}
    assert found == {(1, 7), (3, 20)} and 7 in stats.birdie_channels(signal, 4, 4.0)
    assert detect.intensity(signal) is signal
