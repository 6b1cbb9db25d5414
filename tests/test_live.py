"""Kernels and sub-integrations of streams against the same in batch, however triggers cut them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.operators import blocks, fold, kernels
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources import raw
from sampledeck.streaming import folding, live

N = 300
OBS = Observation(state="Analytic", ndim=2, nchan=2, npol=2, nbit=8, ndat=N, rate=1000.0, centre_frequency=1400.0, bandwidth=-4.0, dispersion_measure=20.0)


@pytest.fixture(scope="module")
def volts(spark):
    g = np.random.default_rng(3)
    rows = [(t, c, p, *g.standard_normal(2).tolist()) for t in range(N) for c in range(2) for p in range(2)]
    return Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), OBS)


def table(df, *columns):
    return {(r.idat, r.ichan, r.ipol): tuple(r[c] for c in columns) for r in df.collect()}


def alike(a, b):
    assert a.keys() == b.keys() and len(a) > 100
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("cuts", [[150], [3, 5, 40, 41, 200, 290], list(range(25, 300, 25))])
def test_kernels_keep_the_overlap_as_state(spark, volts, tmp_path, cuts):
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, N], strict=True)):
        volts.data.filter(f"idat >= {a} and idat < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    g = np.random.default_rng(1)
    responses = {c: g.standard_normal(16) + 1j * g.standard_normal(16) for c in range(2)}
    stream, obs = live.convolve_stream(folding.read_stream(spark, f"{tmp_path}/in", 1), OBS, responses, (3, 2))
    expected = kernels.convolve(volts, responses, (3, 2))
    alike(table(folding.run_available(stream, f"{tmp_path}/a"), "re", "im"), table(expected.data, "re", "im"))
    assert obs == expected.obs
    if len(cuts) < 8:
        stream, obs = live.filterbank_stream(folding.read_stream(spark, f"{tmp_path}/in", 1), OBS, 4, 8, None, (1, 2))
        expected = kernels.filterbank(volts, 4, 8, None, (1, 2))
        alike(table(folding.run_available(stream, f"{tmp_path}/b"), "re", "im"), table(expected.data, "re", "im"))
        assert obs == expected.obs


def test_missing_samples_leave_transforms_out(spark, volts, tmp_path):
    gone = [40, 41, 42, 160]
    for a in range(0, N, 100):
        volts.data.filter(F.col("idat").between(a, a + 99) & ~F.col("idat").isin(gone)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream, _ = live.convolve_stream(folding.read_stream(spark, f"{tmp_path}/in", 1), OBS, np.arange(8) + 1j, (2, 1))
    expected = kernels.convolve(replace(volts, data=volts.data.filter(~F.col("idat").isin(gone))), np.arange(8) + 1j, (2, 1))
    alike(table(folding.run_available(stream, f"{tmp_path}/a"), "re", "im"), table(expected.data, "re", "im"))


@pytest.mark.parametrize("total", [0, N])
def test_chain_of_a_file_that_grows(spark, tmp_path, total):
    path, url = tmp_path / "live.raw", f"file://{tmp_path}/live.raw"
    codes = np.random.default_rng(5).integers(0, 256, (N, 2, 2, 2))
    raw.write_raw(codes[:70], replace(OBS, ndat=0), url)
    chain = live.from_growing_file(spark, url, total).then(blocks.filterbank, 2, 8, None, (1, 1)).then(blocks.convolve, np.arange(8) + 1j, (2, 1)).then(blocks.detect)
    query = chain.rows(7).data.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        for a, b in ((70, 71), (71, 190), (190, N)):
            with path.open("ab") as file:
                file.write(codes[a:b].astype(np.uint8).tobytes())
            query.processAllAvailable()
    finally:
        query.stop()
    raw.write_raw(codes, OBS, f"file://{tmp_path}/whole.raw")
    whole = blocks.from_files(spark, [f"file://{tmp_path}/whole.raw"]).then(blocks.filterbank, 2, 8, None, (1, 1)).then(blocks.convolve, np.arange(8) + 1j, (2, 1)).then(blocks.detect).rows()
    last = whole.obs.ndat if total else whole.obs.ndat // 7 * 7
    alike(table(spark.read.parquet(f"{tmp_path}/out"), "v"), table(whole.data.filter(F.col("idat") < last), "v"))


SEGMENTS = [(500_000_000 * (2 * k + 1), 100.0 * k + 50 + 0.25, 0.1 + 0.001 * k, (0.0, 0.01)) for k in range(4)]


@pytest.mark.parametrize("files", [1, 3])
def test_sub_integrations_of_turns(spark, tmp_path, files):
    rows = spark.range(4000).select((F.timestamp_micros(F.col("id") * 1_000_000 + 37_000_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).cast("int").alias("ichan"), (F.col("id") % 11).cast("double").alias("v"))
    for k in range(6):
        rows.filter(f"minute(ts) * 60 + hour(ts) * 3600 + second(ts) - 37 >= {k * 667} and minute(ts) * 60 + hour(ts) * 3600 + second(ts) - 37 < {(k + 1) * 667}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: folding.read_stream(spark, f"{tmp_path}/in", files)
    machines = {"period": (live.Turns(7_000_000, 1_000_000), 3), "predictor": (live.Turns(segments=SEGMENTS, span_us=1_000_000_000), 7)}
    for name, (turns, per) in machines.items():
        found = folding.run_available(live.fold_divisions(stream(), turns, per, 8, 2, "100 seconds", 0.3), f"{tmp_path}/{name}").collect()
        us = np.array([r.us for r in rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).orderBy("us").collect()])
        phase = turns.at(us)
        if name == "predictor":
            data = spark.createDataFrame([(int(u),) for u in us], "us long")
            byspark = {r.us: r.turns for r in fold.predicted(data, fold.predictor(spark, SEGMENTS, 1_000_000_000, 0), 1_000_000_000, 0).collect()}
            assert np.allclose([byspark.get(u, np.nan) for u in us.tolist()], phase, rtol=0, atol=1e-9, equal_nan=True)
        expected, spans = {}, {}
        for k, (u, p) in enumerate(zip(us.tolist(), phase.tolist(), strict=True)):
            if p >= 2:
                subint, c = int((np.floor(p) - 2) // per), k % 2
                cell = expected.setdefault((subint, c, min(7, int((p % 1) * 8))), [0.0, 0])
                cell[0] += k % 11
                cell[1] += 1
                span = spans.setdefault((subint, c), [u, u])
                span[1] = u
        mark = us[-1] - 100_000_000
        closed = {key for key, (a, b) in spans.items() if turns.when(2 + (key[0] + 1) * per) <= mark and b - a >= 0.3 * (turns.when(2 + (key[0] + 1) * per) - turns.when(2 + key[0] * per))}
        assert {(r.subint, r.ichan, r.ibin): (r.sum, r.hits) for r in found} == {k: tuple(v) for k, v in expected.items() if k[:2] in closed} and len(closed) > 10
        assert all([r.first_us, r.last_us] == spans[r.subint, r.ichan] for r in found)
        opens = {r.subint: turns.when(2 + r.subint * per) for r in found}
        assert all(r.complete == (r.first_us - opens[r.subint] < (turns.when(2 + (r.subint + 1) * per) - opens[r.subint]) / per) for r in found)
        assert name == "period" or not all(r.complete for r in found if r.subint == min(opens))


def test_times_of_turns():
    turns = live.Turns(segments=SEGMENTS, span_us=1_000_000_000)
    for turn in (3, 77.5, 120, 250):
        at = turns.when(turn)
        assert turns.at(np.array([at]))[0] >= turn > turns.at(np.array([at - 1]))[0] or at % 1_000_000_000 == 0
    assert turns.when(1e9) == 4_000_000_000 and np.isnan(turns.at(np.array([-5, 4_000_000_000]))).all()
    assert live.Turns(7, 3).when(2) == 17 and live.Turns(7, 3).at(np.array([17, 2]))[0] == 2.0
