"""Files in parts, blocks, packets and cut-down forms; series that go on while they are read."""

import math
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.operators import digitize, scrunch
from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources import headers, raw, unload

RAW = Observation(state="Nyquist", nchan=1, npol=2, nbit=8, ndat=100, rate=100.0, centre_frequency=1400.0, bandwidth=10.0)


def codes(seed, n=100, nbit=8):
    return np.random.default_rng(seed).integers(0, 1 << nbit, (n, 1, 2, 1))


def in_order(signal, *values):
    return [tuple(r) for r in signal.data.orderBy("idat", "ichan", "ipol").select("idat", "ichan", "ipol", *(values or ("v",))).collect()]


@pytest.fixture
def two_files(tmp_path):
    for nbit in (8, 2):
        for k in range(2):
            raw.write_raw(codes(k, 100, nbit), replace(RAW.later(100 * k), nbit=nbit), f"file://{tmp_path}/{nbit}-{k}.raw")
    return lambda nbit: [f"file://{tmp_path}/{nbit}-{k}.raw" for k in (1, 0)]


@pytest.mark.parametrize("nbit", [8, 2])
@pytest.mark.parametrize(("start", "total"), [(0.0, None), (0.5, None), (0.9, 0.31), (1.25, 0.5), (0.03, 0.02), (5.0, None), (0.33, 99.0)])
def test_seek_goes_over_files(spark, two_files, nbit, start, total):
    """Samples are those of the series, whichever files they are in; the header says what comes."""
    whole = in_order(raw.read_samples(spark, two_files(nbit)))
    assert [r[0] for r in whole[::2]] == list(range(200))
    more = {} if total is None else {"total": total}
    found = raw.read_samples(spark, two_files(nbit), samples=7, start=start, **more)
    first = min(200, round(start * 100))
    last = 200 if total is None else min(200, first + round(total * 100))
    assert in_order(found) == [(i - first, c, p, v) for i, c, p, v in whole if first <= i < last]
    assert found.obs.ndat == last - first and found.obs.start_us == RAW.start_us + first * 10_000


def test_multiplexed_files(spark, tmp_path):
    data = codes(3, 120).astype(np.uint8).tobytes()
    for k in range(3):
        (tmp_path / f"m{k}").write_bytes(b"HEAD" + b"".join(data[a : a + 16] for a in range(16 * k, len(data), 48)))
    (tmp_path / "m0").write_bytes((tmp_path / "m0").read_bytes() + b"part")
    urls = [f"file://{tmp_path}/m{k}" for k in range(3)]
    found = raw.read_multiplexed(spark, urls, 16, RAW, offset=4)
    assert found.obs.ndat == 120
    assert [r[3] for r in in_order(found)] == (np.frombuffer(data, np.uint8) - 127.5).tolist()
    (tmp_path / "m1").write_bytes((tmp_path / "m1").read_bytes()[:-3])
    assert raw.read_multiplexed(spark, urls, 16, RAW, offset=4).obs.ndat == 104  # to the first packet that isn't whole
    with pytest.raises(ValueError):
        raw.read_multiplexed(spark, urls, 15, RAW)


def test_blocks_with_headers_and_tails(spark, tmp_path):
    data = codes(4, 60).astype(np.uint8).tobytes()
    body = b"".join(b"hdr" + data[a : a + 20] + b"tail!" for a in range(0, 120, 20))
    (tmp_path / "b").write_bytes(b"XX" + body + b"hdr1234")
    found = raw.read_blocks(spark, f"file://{tmp_path}/b", 28, RAW, 3, 5, 2)
    assert found.obs.ndat == 60
    assert [r[3] for r in in_order(found)] == (np.frombuffer(data, np.uint8) - 127.5).tolist()
    with pytest.raises(ValueError):
        raw.read_blocks(spark, f"file://{tmp_path}/b", 28, RAW, 20, 8)


INF = """ Data file name without suffix          =  x
 Telescope used                         =  Dish
 Instrument used                        =  Backend
 Object being observed                  =  B 1234 +5
 Epoch of observation (MJD)             =  58849.500000001
 Number of bins in the time series      =  1000
 Width of each time series bin (sec)    =  0.001
 Dispersion measure (cm-3 pc)           =  12.5
 Central freq of low channel (Mhz)      =  1300
 Total bandwidth (Mhz)                  =  100
"""


def test_series_with_inf_header(spark, tmp_path):
    values = np.random.default_rng(0).standard_normal(1000).astype("<f4")
    (tmp_path / "x.inf").write_text(INF)
    (tmp_path / "x.dat").write_bytes(values.tobytes())
    found = raw.read_series(spark, f"file://{tmp_path}/x.inf")
    assert (found.obs.source, found.obs.telescope, found.obs.centre_frequency, found.obs.dispersion_measure) == ("B1234+5", "Dish", 1350.0, 12.5)
    assert found.obs.rate == pytest.approx(1000) and found.obs.start_us == 1577880000000086
    assert [r[3] for r in in_order(found)] == values.astype(float).tolist()


def test_header_from_keys():
    obs = headers.header_from({"NBIT": "4", "FREQ": "1400", "TSAMP": "64"}, nchan=16, npol=None)
    assert (obs.nbit, obs.centre_frequency, obs.rate, obs.nchan, obs.npol) == (4, 1400.0, 15625.0, 16, 1)
    with pytest.raises(ValueError, match="WRONG"):
        headers.header_from({"WRONG": "1"})


def test_cut_down_plan(spark, two_files):
    url = two_files(8)[1]
    whole = in_order(raw.read_samples(spark, [url]))
    plan = raw.byte_plan(spark, RAW, 4096, 30, [0, 2, 3, 9])
    assert [tuple(r) for r in plan.orderBy("subint").collect()] == [(0, 0, 30, 4096, 4156), (2, 60, 30, 4216, 4276), (3, 90, 10, 4276, 4296)]
    found = in_order(raw.read_planned(spark, url, plan))
    assert found == [r for r in whole if r[0] < 30 or r[0] >= 60]


def test_a_file_that_grows_is_a_stream(spark, tmp_path):
    url, path = f"file://{tmp_path}/live.raw", tmp_path / "live.raw"
    data = codes(5, 90)
    raw.write_raw(data[:40], replace(RAW, ndat=0), url)
    stream = raw.live_samples(spark, url, samples=16)
    query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == 80
        with path.open("ab") as file:
            file.write(data[40:].astype(np.uint8).tobytes() + b"x")  # and half a sample
        for _ in range(60):
            query.processAllAvailable()
            if spark.read.parquet(f"file://{tmp_path}/out").count() == 180:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.read.parquet(f"file://{tmp_path}/out").orderBy("idat", "ipol").collect()
    expected = raw.unpack(data.astype(np.uint8).ravel(), 8, False, "two's complement")
    assert [(r.idat, r.ipol) for r in rows] == [(k // 2, k % 2) for k in range(180)] and [r.v for r in rows] == expected.tolist()


def test_search_files_are_tables_of_rows(spark, tmp_path):
    g = np.random.default_rng(2)
    obs = Observation(source="x", nchan=4, npol=2, ndat=50, rate=100.0, centre_frequency=1400.0, bandwidth=-40.0, start_us=1577934245500000, state="PPQQ")
    rows = [(i, c, p, float(g.normal(c, 1 + p))) for i in range(50) for c in range(4) for p in range(2)]
    signal = Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, v double"), obs)
    for nbit in (2, 4, 8):
        done = digitize.digitize_by_block(signal, nbit, 20)
        files = unload.write_search_files(done, obs, nbit, 20, f"file://{tmp_path}/{nbit}", 2).collect()
        assert [(f["first"], f["rows"]) for f in sorted(files)] == [(0, 2), (40, 1)]
        data = open(sorted(files)[0]["url"].removeprefix("file://"), "rb").read()
        assert len(data) % 2880 == 0 and data.startswith(b"SIMPLE  =                    T") and b"XTENSION= 'BINTABLE'  " in data and b"STT_IMJD=                58850" in data
        found = {tuple(r)[:4]: tuple(r)[4:] for r in unload.read_search_rows(spark.createDataFrame(files), nbit, 4, 2, 20).collect() if r["idat"] < 50}
        expected = {(r["idat"], r["ichan"], r["ipol"], r["code"]): (r["offset"], r["scale"]) for r in done.collect()}
        assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], rel=1e-6) for k in found)


def test_search_files_give_back_only_what_was_written(spark, tmp_path):
    g = np.random.default_rng(4)
    obs = Observation(nchan=2, npol=1, ndat=47, rate=100.0, centre_frequency=1400.0, bandwidth=-40.0)
    rows = [(i, c, 0, float(g.normal(1000 * c, 1))) for i in range(47) for c in range(2)]
    done = digitize.digitize_by_block(Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, v double"), obs), 4, 20)
    for per_file in (1, 2, 3):
        files = unload.write_search_files(done, obs, 4, 20, f"file://{tmp_path}/{per_file}", per_file).collect()
        found = unload.read_search_rows(spark.createDataFrame(files), 4, 2, 1, 20)
        # 13 samples fill up the last row; offsets of 1000 have no room in floats for their last digits
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, done.select(*found.columns).collect())) and found.count() == 94


def test_dump_of_voltages_reads_back(spark, tmp_path):
    g = np.random.default_rng(3)
    obs = Observation(state="Analytic", ndim=2, nchan=2, npol=2, ndat=50, rate=100.0, centre_frequency=1400.0, bandwidth=-40.0)
    values = g.standard_normal((50, 2, 2, 2)).astype(np.float32).astype(float)
    rows = [(i, c, p, *values[i, c, p].tolist()) for i in range(50) for c in range(2) for p in range(2)]
    signal = Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), obs)
    files = unload.dump_binary(signal, f"file://{tmp_path}/d", 20).collect()
    found = raw.read_samples(spark, [f["url"] for f in files])
    assert found.obs.ndat == 50 and found.obs.rate == 100.0
    assert in_order(found, "re", "im") == rows


def test_dump_as_text_and_profiles(spark, tmp_path):
    rows = [(i, c, 0, float(i + c)) for i in range(30) for c in range(2)]
    data = spark.createDataFrame(rows, "idat long, ichan int, ipol int, v double")
    unload.dump(data, f"file://{tmp_path}/t")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("*.csv"))).splitlines()
    assert text[0] == "idat,ichan,ipol,v" and len(text) == 21 and text[-1] == "9,1,0,10.0"
    profile = data.select((F.col("idat") % 3).alias("subint"), "ichan", "ipol", F.col("idat").cast("int").alias("ibin"), F.col("v").alias("amp"), F.lit(1).cast("long").alias("hits"))
    unload.write_profiles(profile, f"file://{tmp_path}/p")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["subint=0", "subint=1", "subint=2"]
    back = spark.read.parquet(f"file://{tmp_path}/p").select(*profile.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, profile.collect()))


def test_accumulated_blocks(spark):
    obs = Observation(nchan=1, npol=1, ndat=10, rate=10.0)
    block = lambda k: Signal(spark.range(10).select(F.col("id").alias("idat"), F.lit(0).alias("ichan"), F.lit(0).alias("ipol"), (F.col("id") + 10 * k).cast("double").alias("v")), obs)
    for n, capacity, held, full, nearly in ((1, 25, 10, False, False), (2, 25, 20, False, True), (3, 25, 25, True, True), (4, 20, 20, True, True)):
        found, is_full, nearly_full = scrunch.accumulated([block(k) for k in range(n)], capacity)
        assert (found.obs.ndat, is_full, nearly_full) == (held, full, nearly)
        assert [r[3] for r in in_order(found)] == [float(k) for k in range(held)]


def test_provenance(spark):
    signal = Signal(spark.range(1), Observation(source="x", nchan=4, ndat=10, rate=1.0)).then(lambda s: s)
    rows = {(r["name"], r["value"], r["step"]) for r in unload.provenance(spark, signal.obs).collect()}
    assert ("source", "x", None) in rows and ("nchan", "4", None) in rows and ("operator", "<lambda>", 0) in rows
    assert not math.isnan(len(rows))
