"""Files of samples, and streams against batches."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampledeck.operators import digitize
from sampledeck.plans.observation import Observation
from sampledeck.sources import headers, raw
from sampledeck.streaming import folding

HEADER = """HDR_VERSION 1.0   # version
TELESCOPE DISH
SOURCE B1234+56
MODE PSR
FREQ 1450
BW -320
NCHAN 1
NPOL 2
NDIM 1
NBIT 8
TSAMP 0.0025 # us
UTC_START 2020-01-02-03:04:05
OBS_OFFSET 0
"""


def test_text_header():
    obs = headers.observation(HEADER)
    assert (obs.source, obs.type, obs.state, obs.nbit, obs.npol) == ("B1234+56", "Pulsar", "Nyquist", 8, 2)
    assert obs.rate == pytest.approx(4e8) and obs.start_us == 1577934245000000
    assert headers.observation("HDR_VERSION 1.0").nbit == 2
    with pytest.raises(ValueError, match="FREQ"):
        headers.observation("NBIT 8", required=("FREQ",))
    again = headers.observation(headers.text_header(obs).decode())
    assert replace(again, mode="PSR", type="Pulsar") == obs


def test_header_rows(spark):
    rows = headers.header_rows(spark.createDataFrame([(1, HEADER), (2, ""), (3, None)], "id int, text string")).collect()
    found = {r["key"]: r["value"] for r in rows}
    assert found == headers.parse_text(HEADER) and {r["id"] for r in rows} == {1}


def test_filterbank_header():
    obs = Observation(source="x", nchan=4, npol=1, nbit=8, ndat=10, centre_frequency=1400.0, bandwidth=-40.0, rate=1000.0, start_us=1_000_000)
    fields, n = headers.parse_filterbank(headers.filterbank_header(obs) + bytes(40))
    back = headers.filterbank_observation(fields, 40)
    assert (back.nchan, back.ndat, back.source) == (4, 10, "x") and back.frequency(0) == pytest.approx(obs.frequency(0))
    assert back.start_us + back.start_fraction == pytest.approx(1_000_000, abs=2)
    with pytest.raises(ValueError):
        headers.parse_filterbank(b"\x05\x00\x00\x00hello")


@pytest.mark.parametrize("nbit", [1, 2, 4, 8, 16])
def test_raw_files_in_blocks_are_the_whole(spark, tmp_path, nbit):
    codes = np.random.default_rng(nbit).integers(0, 1 << nbit, (100, 2, 2, 1))
    obs = Observation(state="Nyquist", nchan=2, npol=2, nbit=nbit, ndat=100, rate=100.0, centre_frequency=1400.0, bandwidth=10.0)
    url = f"file://{tmp_path}/a-raw.bin"
    raw.write_raw(codes, obs, url)
    values = []
    for samples in (7, 1000):
        signal = raw.read_samples(spark, [url], samples=samples)
        rows = signal.data.collect()
        assert signal.obs.ndat == 100 and len(rows) == 400
        values.append({(r["idat"], r["ichan"], r["ipol"]): r["v"] for r in rows})
    assert values[0] == values[1]
    expected = raw.unpack(np.frombuffer(raw.pack(codes.ravel(), nbit, False), np.uint8), nbit, False, "offset binary" if nbit < 8 else "two's complement").reshape(100, 2, 2)
    assert all(expected[k] == v for k, v in values[0].items())


def test_seek_reads_only_what_is_asked(spark, tmp_path):
    obs = Observation(state="Nyquist", nchan=1, npol=1, nbit=8, ndat=100, rate=100.0)
    url = f"file://{tmp_path}/a-raw.bin"
    raw.write_raw(np.arange(100).reshape(100, 1, 1, 1), obs, url)
    found = raw.read_samples(spark, [url], start=0.5, total=0.1)  # numbered from the header's new start on
    assert sorted(r["idat"] for r in found.data.collect()) == list(range(10))
    assert (found.obs.ndat, found.obs.start_us) == (10, 500_000)


def test_files_must_follow_on(spark, tmp_path):
    obs = Observation(state="Nyquist", nbit=8, ndat=100, rate=100.0, start_us=1_000_000)
    urls = []
    for k, late in enumerate((0, 100, 300)):
        urls.append(f"file://{tmp_path}/{k}-raw.bin")
        raw.write_raw(np.full((100, 1, 1, 1), k), obs.later(late), urls[-1])
    assert raw.read_samples(spark, urls[1::-1]).data.count() == 200
    with pytest.raises(ValueError, match="follow"):
        raw.read_samples(spark, urls)
    gap = raw.read_samples(spark, urls, force=True)  # a gap stays one
    assert gap.obs.ndat == 400 and {r.idat for r in gap.data.select("idat").distinct().collect()} == {*range(200), *range(300, 400)}


def test_unknown_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError, match="no format"):
        raw.open_samples(f"file://{tmp_path}/x")


def test_filterbank_files_go_round(spark, tmp_path):
    noise = raw.synthetic(spark, Observation(nchan=4, npol=1, ndat=90, rate=1000.0, centre_frequency=1400.0, bandwidth=-40.0))
    codes = digitize.digitize(noise, 8)
    files = raw.write_filterbank(codes, replace(noise.obs, nbit=8), f"file://{tmp_path}/out", 40).collect()
    assert sorted(f["n"] for f in files) == [10, 40, 40]
    back = raw.read_samples(spark, [f["url"] for f in files], force=True)
    got = {(r["idat"], r["ichan"]): r["v"] + 127.5 for r in back.data.collect()}
    assert got == {(r["idat"], r["ichan"]): r["code"] for r in codes.collect()}


def test_synthetic_noise_does_not_depend_on_partitions(spark):
    obs = Observation(nchan=2, npol=2, ndat=500, rate=1.0)
    a, b = ({tuple(r) for r in raw.synthetic(spark, obs, n).data.collect()} for n in (1, 5))
    assert a == b
    v = np.array([r[3] for r in a])
    assert abs(v.mean()) < 0.1 and abs(v.std() - 1) < 0.1


def events(spark, folder):
    rows = spark.range(2000).select((F.timestamp_micros(F.col("id") * 301_000_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).cast("int").alias("ichan"), F.col("id").alias("idat"), (F.col("id") % 11).cast("double").alias("v"))
    for k in range(4):  # a stream takes files in order of their time
        rows.filter(F.expr(f"idat div 500 = {k}")).coalesce(1).write.mode("append").parquet(folder)
    return rows


def test_stream_fold_is_the_batch_fold(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/in")
    out = folding.run_available(folding.fold_stream(folding.read_stream(spark, f"{tmp_path}/in", 1), 7_000_000, 8), str(tmp_path / "run"))
    got = {(r["start_us"], r["ichan"], r["ibin"]): (r["sum"], r["hits"]) for r in out.collect()}
    day, last, expected = 86_400_000_000, 1999 * 301_000_000 - 3_600_000_000, {}
    for r in batch.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ichan", "v").collect():
        if r["us"] // day * day + day <= last:
            key = (r["us"] // day * day, r["ichan"], r["us"] % 7_000_000 * 8 // 7_000_000)
            s, n = expected.get(key, (0.0, 0))
            expected[key] = (s + r["v"], n + 1)
    assert got == expected and got


def test_stream_baseline_carries_state_over_triggers(spark, tmp_path):
    batch = events(spark, f"{tmp_path}/in")
    stream = folding.read_stream(spark, f"{tmp_path}/in", 1)
    out = folding.run_available(folding.follow_baseline(stream, 16.0), str(tmp_path / "run")).collect()
    assert len(out) == 2000
    for c in range(3):
        base, expected = None, []
        for r in batch.filter(F.col("ichan") == c).orderBy("idat").collect():
            base = r["v"] if base is None else base
            base += (r["v"] - base) / 16
            expected.append(r["v"] - base)
        assert [r["v"] for r in sorted((r for r in out if r["ichan"] == c), key=lambda r: r["idat"])] == pytest.approx(expected)


def test_baseline_holds_a_keys_numbers_and_no_frames():
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, order = 400_000, np.random.default_rng(9).permutation(40)

    def parts():
        for k in order:
            idat = np.arange(k * 10_000, (k + 1) * 10_000)
            yield pd.DataFrame({"ichan": 1, "idat": idat, "v": idat * 0.5, "more": ["x" * 100 + str(i) for i in idat]})

    tracemalloc.start()
    try:
        idat, v = folding.in_order(parts())
        assert tracemalloc.get_traced_memory()[1] < 50 * n
    finally:
        tracemalloc.stop()
    assert (idat == np.arange(n)).all() and (v == np.arange(n) * 0.5).all()
