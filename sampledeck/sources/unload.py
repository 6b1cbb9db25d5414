"""How results are laid out when they are written: rows of search-mode tables, names of profiles."""

from __future__ import annotations

import uuid
from dataclasses import fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.plans.observation import Observation, Signal
from sampledeck.sources.headers import MJD_1970, text_header
from sampledeck.sources.raw import opened, pack, write_file, write_series


def search_rows(codes: DataFrame, obs: Observation, samples: int) -> DataFrame:
    """irow, offset_seconds (of the row's middle), data: `samples` samples to a row, in order of
    sample, polarization and channel; the last row may be short. A row's samples meet in one task."""
    row = F.expr(f"idat div {int(samples)}")
    cells = codes.groupBy(row.alias("irow")).agg(F.array_sort(F.collect_list(F.struct("idat", "ipol", "ichan", "code"))).alias("cells"))
    return cells.select("irow", ((F.col("irow") + 0.5) * (samples / obs.rate)).alias("offset_seconds"), F.col("cells.code").alias("data"))


def name_by_epoch(start_us: Column, pattern: str = "yyyy-MM-dd-HH:mm:ss") -> Column:
    """A profile's name from its start; UTC is the session's time zone."""
    return F.date_format(F.timestamp_micros(start_us), pattern)


def name_by_pulse(subint: Column) -> Column:
    return F.concat(F.lit("pulse_"), F.lpad(subint.cast("string"), 10, "0"))


def name_in_sequence(subint: Column, per_directory: int = 1000) -> Column:
    """directory/number, so no directory gets more than that many."""
    return F.format_string("%04d/%08d", F.floor(subint / per_directory), subint)


def write_profiles(profile: DataFrame, folder: str) -> None:
    """Profiles as Parquet, a directory for each sub-integration, for readers to prune by."""
    profile.repartition("subint").write.partitionBy("subint").mode("overwrite").parquet(folder)


#: Tables that an archive can hold beside its profile.
EXTENSIONS = ("passband", "counts", "weights", "spans")


def write_archive(profile: DataFrame, obs: Observation, folder: str, **tables: DataFrame) -> None:
    """A profile and what goes with it in one folder, a URL: profile, a directory for each
    sub-integration; provenance, the header and the operators that made it; and any EXTENSIONS: the
    passband of the transforms, counts of the digitizers' states, the channels' weights, the
    sub-integrations' spans."""
    if unknown := set(tables) - set(EXTENSIONS):
        raise ValueError(f"an archive has no {', '.join(sorted(unknown))}")
    write_profiles(profile, f"{folder}/profile")
    for name, table in {**tables, "provenance": provenance(profile.sparkSession, obs)}.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an archive by name; an extension that wasn't written isn't there."""
    system, path = opened(folder)
    found = {name: system.get_file_info(f"{path}/{name}").type.name == "Directory" for name in EXTENSIONS}
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("profile", *(n for n, there in found.items() if there), "provenance")}


def dump(data: DataFrame, folder: str, samples: int = 10) -> None:
    """The first samples as text, a line each."""
    data.filter(F.col("idat") < samples).sort("idat", "ichan", "ipol").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def dump_binary(signal: Signal, folder: str, samples_per_file: int) -> DataFrame:
    """Samples as files in folder, a URL, of a text header of 4096 bytes and floats, each of that many
    samples, but for the last; read_samples() reads them as one series. Returns file_no, url, first, n.
    A file's samples meet in one task; those that are missing are 0, whole files of them, too."""
    obs = replace(signal.obs, nbit=32)
    values = ("re", "im") if obs.ndim == 2 else ("v",)

    def write(number: int, table: pa.Table, first: int, n: int) -> str:
        idat, ichan, ipol = (np.asarray(table.column(c)) for c in ("idat", "ichan", "ipol"))
        cube = np.zeros((n, obs.nchan, obs.npol, obs.ndim))
        for k, c in enumerate(values):
            cube[idat - first, ichan, ipol, k] = np.asarray(table.column(c))
        return write_file(f"{folder}/{number:08d}-{uuid.uuid4().hex}.dump", text_header(replace(obs.later(first), ndat=n)) + pack(cube.ravel(), 32, False))

    return write_series(signal.data.select("idat", "ichan", "ipol", *values), obs.ndat, samples_per_file, write)


def provenance(spark: SparkSession, obs: Observation) -> DataFrame:
    """name, value: every field of a header that isn't empty, and a row for each operator that made
    the data, in order (step, not null for those)."""
    rows = [(f.name, str(getattr(obs, f.name)), None) for f in fields(obs) if f.name != "history" and getattr(obs, f.name) not in ("", None)]
    return spark.createDataFrame(rows + [("operator", name, k) for k, name in enumerate(obs.history)], "name string, value string, step int")


def card(key: str, value, comment: str = "") -> bytes:
    text = "T" if value is True else "F" if value is False else f"'{value:<8}'" if isinstance(value, str) else repr(value)
    text = text.ljust(20) if isinstance(value, str) else text.rjust(20)
    return f"{key:<8}= {text}{' / ' if comment else ''}{comment}"[:80].ljust(80).encode("ascii", "replace")


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % 2880)


def table_file(obs: Observation, nbit: int, samples: int, rows: list[dict[str, np.ndarray]], total: int) -> bytes:
    """A FITS file of one binary table of search-mode rows: each has the seconds of its middle, its
    channels' frequencies and weights, offsets and scales by polarization and channel (in doubles, so
    that they come back as they were), and its packed codes, sample by polarization by channel, most
    significant bits first. total: its samples without those that fill up the last row (NSTOT)."""
    cells = obs.npol * obs.nchan
    widths = {"OFFS_SUB": (1, "D", ">f8"), "DAT_FREQ": (obs.nchan, "D", ">f8"), "DAT_WTS": (obs.nchan, "E", ">f4"), "DAT_OFFS": (cells, "D", ">f8"), "DAT_SCL": (cells, "D", ">f8"), "DATA": (samples * cells * nbit // 8, "B", "u1")}
    size = sum(n * np.dtype(kind).itemsize for n, _, kind in widths.values())
    days = MJD_1970 + obs.start_us // 86_400_000_000
    seconds = obs.start_us % 86_400_000_000 / 1e6
    primary = [card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True), card("OBS_MODE", "SEARCH"), card("SRC_NAME", obs.source), card("TELESCOP", obs.telescope), card("OBSFREQ", obs.centre_frequency), card("OBSBW", obs.bandwidth), card("STT_IMJD", days), card("STT_SMJD", int(seconds)), card("STT_OFFS", seconds % 1 + obs.start_fraction * 1e-6), b"END".ljust(80)]
    table = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", size), card("NAXIS2", len(rows)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(widths))]
    for k, (name, (n, code, _)) in enumerate(widths.items(), 1):
        table += [card(f"TTYPE{k}", name), card(f"TFORM{k}", f"{n}{code}")]
    table += [card("EXTNAME", "SUBINT"), card("NBITS", nbit), card("NCHAN", obs.nchan), card("NPOL", obs.npol), card("NSBLK", samples), card("NSTOT", total), card("TBIN", 1 / obs.rate), b"END".ljust(80)]
    body = b"".join(np.ascontiguousarray(row[name], kind).tobytes() for row in rows for name, (_, _, kind) in widths.items())
    return padded(b"".join(primary), b" ") + padded(b"".join(table), b" ") + padded(body)


def write_search_files(codes: DataFrame, obs: Observation, nbit: int, samples: int, folder: str, rows_per_file: int) -> DataFrame:
    """Digitized blocks (idat, ichan, ipol, code, offset, scale) as search-mode table files in folder,
    a URL: a row for each `samples` samples, rows_per_file rows a file. Returns file_no, url, first,
    rows. The last row is filled up with code 0, which the header's count of samples leaves out. A
    file's rows meet in one task, so they bound it."""
    if samples * obs.npol * obs.nchan * nbit % 8:
        raise ValueError("a row must have whole bytes")
    span = samples * rows_per_file

    def run(table: pa.Table) -> pa.Table:
        number = table.column("file_no")[0].as_py()
        idat, ichan, ipol = (np.asarray(table.column(c)) for c in ("idat", "ichan", "ipol"))
        row = (idat - number * span) // samples
        n = int(row.max()) + 1
        cube = np.zeros((n, samples, obs.npol, obs.nchan))
        cube[row, idat % samples, ipol, ichan] = np.asarray(table.column("code"))
        moved = np.zeros((2, n, obs.npol, obs.nchan))
        for k, c in enumerate(("offset", "scale")):
            moved[k, row, ipol, ichan] = np.asarray(table.column(c))
        freq = np.array([obs.frequency(c) for c in range(obs.nchan)])
        rows = [{"OFFS_SUB": (number * rows_per_file + k + 0.5) * samples / obs.rate, "DAT_FREQ": freq, "DAT_WTS": np.ones(obs.nchan), "DAT_OFFS": moved[0, k], "DAT_SCL": moved[1, k], "DATA": np.frombuffer(pack(cube[k].ravel(), nbit, False), np.uint8)} for k in range(n)]
        url = f"{folder}/{number:08d}-{uuid.uuid4().hex}.sf"
        system, path = opened(url)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            out.write(table_file(obs, nbit, samples, rows, int(idat.max()) + 1 - number * span))
        return pa.table({"file_no": pa.array([number], pa.int64()), "url": [url], "first": pa.array([number * span], pa.int64()), "rows": pa.array([n], pa.int64())})

    rows = codes.select("idat", "ichan", "ipol", "code", "offset", "scale").withColumn("file_no", F.expr(f"idat div {int(span)}"))
    return rows.groupBy("file_no").applyInArrow(run, "file_no long, url string, first long, rows long")


def read_search_rows(files: DataFrame, nbit: int, nchan: int, npol: int, samples: int) -> DataFrame:
    """The samples of such files (url), as idat, ichan, ipol, code, offset, scale, without those that
    fill up a last row; files are read by the tasks that decode them. Columns lie where the header
    says; offsets and scales may be floats (E) or doubles (D)."""

    def run(batches):
        for batch in batches:
            for url, first in zip(batch.column("url").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, path = opened(url)
                with system.open_input_file(path) as stream:
                    data = stream.read()
                at, head = 0, {}
                for _ in range(2):
                    while True:
                        line = data[at : at + 80]
                        at += 80
                        if line.startswith(b"END"):
                            break
                        head[line[:8].decode().strip()] = line[10:].split(b"/")[0].decode().strip(" '")
                    at += -at % 2880
                cells, size = npol * nchan, int(head["NAXIS1"])
                kinds, places, place = {"D": ">f8", "E": ">f4", "B": "u1"}, {}, 0
                for k in range(1, int(head["TFIELDS"]) + 1):
                    n, kind = int(head[f"TFORM{k}"][:-1]), kinds[head[f"TFORM{k}"][-1]]
                    places[head[f"TTYPE{k}"]] = kind, n, place
                    place += n * np.dtype(kind).itemsize
                total = int(head.get("NSTOT", int(head["NAXIS2"]) * samples))
                for row in range(int(head["NAXIS2"])):
                    body = data[at + row * size : at + (row + 1) * size]
                    offset, scale, raw = (np.frombuffer(body, *places[name]) for name in ("DAT_OFFS", "DAT_SCL", "DATA"))
                    offset, scale = offset.astype(float), scale.astype(float)
                    per = 8 // nbit if nbit < 8 else 1
                    codes = ((raw[:, None] >> ((per - 1 - np.arange(per)) * nbit)) & ((1 << nbit) - 1)).ravel() if nbit < 8 else raw.view("u1" if nbit == 8 else "<u2")
                    index = np.arange(min(samples, total - row * samples) * cells)
                    place, codes = index % cells, codes[: len(index)]
                    yield pa.record_batch([pa.array(first + row * samples + index // cells), pa.array((place % nchan).astype(np.int32)), pa.array((place // nchan).astype(np.int32)), pa.array(codes.astype(np.int32)), pa.array(offset[place]), pa.array(scale[place])], ["idat", "ichan", "ipol", "code", "offset", "scale"])

    return files.select("url", "first").mapInArrow(run, "idat long, ichan int, ipol int, code int, offset double, scale double")
