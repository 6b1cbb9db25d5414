"""Headers of sampled data: text of keys and values, and the keyword-tagged binary of filterbanks."""

from __future__ import annotations

import math
import struct
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampledeck.plans.observation import Observation

#: Keys of the text header, the attribute that each sets, and its type.
TEXT_KEYS = {
    "SOURCE": ("source", str), "TELESCOPE": ("telescope", str), "RECEIVER": ("receiver", str), "INSTRUMENT": ("machine", str),
    "STATE": ("state", str), "BASIS": ("basis", str), "NBIT": ("nbit", int), "NDIM": ("ndim", int), "NPOL": ("npol", int),
    "NCHAN": ("nchan", int), "NDAT": ("ndat", int), "FREQ": ("centre_frequency", float), "BW": ("bandwidth", float),
    "DM": ("dispersion_measure", float), "RM": ("rotation_measure", float), "CALFREQ": ("calfreq", float),
}
#: What MODE calls the kinds of sources.
MODES = {"PSR": "Pulsar", "CAL": "PolnCal", "LEVCAL": "PolnCal", "PHASE": "PolnCal"}
DEFAULT_NBIT = 2


def parse_text(text: str) -> dict[str, str]:
    """Keys and values; '#' begins a comment. Of a key that repeats the last value counts."""
    out = {}
    for line in text.replace("\0", "\n").splitlines():
        words = line.split("#", 1)[0].split(None, 1)
        if len(words) == 2:
            out[words[0].upper()] = words[1].strip()
    return out


def observation(text: str, required: tuple[str, ...] = ()) -> Observation:
    """The header of a text. Without NBIT it is 2; the rate is from TSAMP, in microseconds; the
    state is Nyquist or Analytic by NDIM unless STATE names one."""
    found = parse_text(text)
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"the header has no {', '.join(missing)}")
    values = {name: kind(found[key].split()[0]) for key, (name, kind) in TEXT_KEYS.items() if key in found}
    values.setdefault("nbit", DEFAULT_NBIT)
    values.setdefault("ndim", 1)
    values.setdefault("state", "Analytic" if values["ndim"] == 2 else "Nyquist")
    if "TSAMP" in found:
        values["rate"] = 1e6 / float(found["TSAMP"])
    if "MODE" in found:
        values |= {"mode": found["MODE"], "type": MODES.get(found["MODE"].upper(), found["MODE"])}
    out = Observation(**values)
    if "UTC_START" in found:
        start = datetime.strptime(found["UTC_START"], "%Y-%m-%d-%H:%M:%S").replace(tzinfo=UTC)
        out = out.patched(start_us=int(start.timestamp()) * 1_000_000)
    if "OBS_OFFSET" in found and out.rate and (skipped := out.nsamples(int(found["OBS_OFFSET"]))):
        out = out.later(skipped)
    return out


def header_rows(texts: DataFrame, column: str = "text") -> DataFrame:
    """A row for each key of each header text: the columns of texts but that one, key, value. All in
    column expressions, for many headers at once."""
    lines = F.explode(F.split(F.col(column), r"[\n\x00]")).alias("line")
    rows = texts.select(*[c for c in texts.columns if c != column], lines)
    plain = F.trim(F.split("line", "#", 2)[0])
    rows = rows.withColumn("line", plain).filter(F.col("line").rlike(r"^\S+\s+\S"))
    return rows.withColumn("key", F.upper(F.regexp_extract("line", r"^(\S+)", 1))).withColumn("value", F.regexp_extract("line", r"^\S+\s+(.*\S)\s*$", 1)).drop("line")


def text_header(obs: Observation, size: int = 4096) -> bytes:
    """A text header of that many bytes, or of the next power of two that holds it."""
    lines = ["HDR_VERSION 1.0"]
    for key, (name, kind) in TEXT_KEYS.items():
        value = getattr(obs, name)
        if value not in ("", "unknown"):
            lines.append(f"{key} {value!r}" if kind is float else f"{key} {value}")
    if obs.rate:
        lines.append(f"TSAMP {1e6 / obs.rate!r}")
    lines.append(f"UTC_START {datetime.fromtimestamp(obs.start_us // 1_000_000, UTC):%Y-%m-%d-%H:%M:%S}")
    skipped = round((obs.start_us % 1_000_000 + obs.start_fraction) * 1e-6 * obs.rate)  # what lies within the second
    if skipped and obs.nbit:
        lines.append(f"OBS_OFFSET {obs.nbytes(skipped)}")
    while True:
        text = "\n".join([*lines, f"HDR_SIZE {size}", ""]).encode()
        if len(text) <= size:
            return text.ljust(size, b"\0")
        size *= 2


#: Fields of filterbank headers that are doubles or strings; all others are 32-bit integers.
DOUBLES = {"az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "fch1", "foff", "refdm", "period"}
STRINGS = {"source_name", "rawdatafile"}
MJD_1970 = 40587


def parse_filterbank(data: bytes) -> tuple[dict, int]:
    """The fields of a filterbank header and its length in bytes."""
    at, out = 0, {}

    def string() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<i", data, at)
        if not 0 < n < 256:
            raise ValueError("no filterbank header")
        at += 4 + n
        return data[at - n : at].decode("latin-1")

    if string() != "HEADER_START":
        raise ValueError("no filterbank header")
    while (key := string()) != "HEADER_END":
        if key in STRINGS:
            out[key] = string()
        else:
            kind = "<d" if key in DOUBLES else "<i"
            (out[key],) = struct.unpack_from(kind, data, at)
            at += struct.calcsize(kind)
    return out, at


def filterbank_observation(fields: dict, data_bytes: int) -> Observation:
    nchan, nbit, npol = fields["nchans"], fields["nbits"], fields.get("nifs", 1)
    width = fields["foff"]
    days = fields.get("tstart", float(MJD_1970)) - MJD_1970
    us = days * 86400e6
    return Observation(source=fields.get("source_name", "unknown"), state={1: "Intensity", 2: "PPQQ", 4: "Coherence"}.get(npol, "Intensity"), nchan=nchan, npol=npol, nbit=nbit, ndat=data_bytes * 8 // (nbit * nchan * npol), centre_frequency=fields["fch1"] + width * (nchan - 1) / 2, bandwidth=width * nchan, rate=1.0 / fields["tsamp"], start_us=math.floor(us), start_fraction=us - math.floor(us), dispersion_measure=fields.get("refdm", 0.0), format="filterbank")


def filterbank_header(obs: Observation) -> bytes:
    def string(text: str) -> bytes:
        return struct.pack("<i", len(text)) + text.encode("latin-1")

    width = obs.bandwidth / obs.nchan
    fields = {"source_name": obs.source, "machine_id": 0, "telescope_id": 0, "data_type": 1, "fch1": obs.centre_frequency - width * (obs.nchan - 1) / 2, "foff": width, "nchans": obs.nchan, "nbits": obs.nbit, "tstart": MJD_1970 + (obs.start_us + obs.start_fraction) / 86400e6, "tsamp": 1.0 / obs.rate, "nifs": obs.npol}
    body = b"".join(string(k) + (string(v) if k in STRINGS else struct.pack("<d" if k in DOUBLES else "<i", v)) for k, v in fields.items())
    return string("HEADER_START") + body + string("HEADER_END")


#: What lines of an .inf file begin with, and the field that each gives.
INF_LINES = {"Telescope used": "telescope", "Instrument used": "machine", "Object being observed": "source", "Epoch of observation (MJD)": "epoch", "Number of bins in the time series": "ndat", "Width of each time series bin (sec)": "tsamp", "Dispersion measure (cm-3 pc)": "dm", "Central freq of low channel (Mhz)": "low", "Total bandwidth (Mhz)": "bandwidth", "Number of channels": "nchan"}


def inf_observation(text: str) -> Observation:
    """The header of a series of floats that an .inf text describes: name = value lines, each named
    by what it begins with. Its frequency is that of the band's low edge; white space in the source's
    name goes. The series has one channel, of the whole band."""
    found = {}
    for line in text.splitlines():
        name, equals, value = line.partition("=")
        if equals:
            found |= {field: value.strip() for begin, field in INF_LINES.items() if name.strip().startswith(begin)}
    day, _, part = found["epoch"].partition(".")
    us = float(f"0.{part or 0}") * 86400e6
    width = float(found.get("bandwidth", 0))
    return Observation(source="".join(found.get("source", "unknown").split()), telescope=found.get("telescope", "unknown"), machine=found.get("machine", ""), state="Intensity", nchan=1, npol=1, nbit=32, ndat=int(float(found["ndat"])), centre_frequency=float(found.get("low", 0)) + abs(width) / 2, bandwidth=width, rate=1 / float(found["tsamp"]), start_us=(int(day) - MJD_1970) * 86_400_000_000 + math.floor(us), start_fraction=us - math.floor(us), dispersion_measure=float(found.get("dm", 0)), format="inf")


def header_from(pairs: dict[str, str], **defaults) -> Observation:
    """A header from keys and values alone, as on a command line: those of text headers."""
    known = "\n".join(f"{k} {v}" for k, v in pairs.items())
    if unknown := [k for k in pairs if k.upper() not in {*TEXT_KEYS, "TSAMP", "MODE", "UTC_START", "OBS_OFFSET"}]:
        raise ValueError(f"no header has {', '.join(unknown)}")
    return observation(known).patched(**{k: v for k, v in defaults.items() if v is not None})
