"""Embedding near-duplicates by randomised-rotation binary codes (operator 1).

A unit vector o, rotated at random, is coded by its signs: o' = sign(Po)/sqrt(D), with the
correction factor f = <o', Po> stored.  For any other vector q, <o', Pq>/f is an unbiased estimate
of <o, q>, and at similarity c its error stays within
e * sqrt((1 - c^2) * (1 - f^2) / (f^2 * (D - 1))), but for a chance that shrinks as exp(-e^2 / 2).
Pairs whose estimate lies below the wanted similarity by more than that bound are dropped; the rest
are recomputed in double precision.

Which pairs are looked at: the codes' bits are also cut into bands, and vectors that share a band
meet.  Two vectors at the wanted similarity share a bit with a chance of p = 1 - angle/pi, so the
number of bands L follows from the band width k (about log2(n/GROUP), so that a band's groups stay
small) by (1 - p^k)^L <= MISS; more similar pairs are missed far more rarely.

Vectors, codes and factors are written once.  What is sent to every band is a row of a few numbers,
with the first 128 bits of the code: two of its vectors can be similar only if not too many of these
differ.  Vectors alone that have such a partner in a band are fetched for it, and there the estimates
and their bounds decide which pairs are recomputed.  A pair counts in its first common band only.
Equal vectors are one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components, labels_of

#: Chance that a pair exactly at the wanted similarity shares no band.
MISS = 1e-7
#: Vectors that share a band's key, about.
GROUP = 2048
#: Bits of a code that go with a band's row, as words of 64.
WORDS = 2
#: Width of the confidence bounds, in standard errors.
ERRORS = 6.0
#: Vectors of one key that meet in one task; more are split into blocks that meet in pairs.
BLOCK = 4096
SEED = 20240521


def rotations(dim: int, count: int) -> np.ndarray:
    """count random orthogonal matrices of the least multiple of 64 that holds dim, first columns."""
    size = -(-max(dim, 1) // 64) * 64
    draw = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(draw.standard_normal((size, size)))[0][:, :dim] for _ in range(count)])


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=-1, keepdims=True)  # squares neither overflow nor vanish
    return raw / np.linalg.norm(raw, axis=-1, keepdims=True)


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors as bytes of their floats; null where a vector is null, empty, zero or has a component
    that is null or not finite."""
    for batch in batches:
        column = batch.column("embedding")
        offsets = np.asarray(column.offsets, dtype=np.int64)
        values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        missing = np.asarray(values.is_null())
        raw = np.asarray(values.fill_null(0)) + values.type.to_pandas_dtype()(0)  # no zero below zero
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(column)), sizes)
        bad = np.bincount(row, missing | ~np.isfinite(raw), len(column)) > 0
        some = np.bincount(row, raw != 0, len(column)) > 0
        ok = np.asarray(column.is_valid()) & ~bad & some
        ends = ((offsets - offsets[0]) * raw.itemsize).astype(np.int32)
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        yield pa.record_batch([batch.column("vec_id"), pa.compute.if_else(pa.array(ok), whole, pa.scalar(None, pa.binary()))], ["vec_id", "vec"])


class Bands:
    """How codes are cut: `per` bands of `width` bits a word of 64."""

    def __init__(self, n: int, least: float) -> None:
        self.width = min(32, max(4, round(math.log2(max(n, 1) / GROUP + 1))))
        share = (1 - math.acos(least) / math.pi) ** self.width
        self.bands, self.per = math.ceil(math.log(MISS) / math.log(1 - share)), 64 // self.width
        self.words = max(WORDS, -(-self.bands // self.per))
        flips = math.acos(least) / math.pi
        bits = 64 * WORDS
        self.most = math.ceil(bits * flips + ERRORS * math.sqrt(bits * flips * (1 - flips)))  # that differ among the first

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The signs of the rotated unit vectors as words."""
        dim = vectors.shape[1]
        size = -(-dim // 64) * 64
        turns = rotations(dim, -(-64 * self.words // size))
        bits = np.concatenate([vectors @ r.T >= 0 for r in turns], axis=1)[:, : 64 * self.words]
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Each band's bits as a number."""
        band = np.arange(self.bands)
        return (words[:, band // self.per] >> (band % self.per * self.width).astype(np.uint64)) & np.uint64((1 << self.width) - 1)


def coded(bands: Bands, double: bool):
    """rep, copies, vec, dim, factor and code (all words) of distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            dims = np.array([len(b) // (8 if double else 4) for b in blobs], np.int32)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                vectors = unit(floats([blobs[i] for i in mine], int(dim), double))
                words = bands.codes(vectors)
                turned = vectors @ rotations(int(dim), 1)[0].T
                factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                own = batch.take(pa.array(mine))
                yield pa.record_batch([own.column("rep"), own.column("copies"), own.column("vec"), pa.array(dims[mine]), pa.array(factor), pa.array([w.tobytes() for w in words], pa.binary())], ["rep", "copies", "vec", "dim", "factor", "code"])

    return run


def floats(blobs: list[bytes], dim: int, double: bool) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8" if double else "<f4").astype(np.float64).reshape(-1, dim)


def banded(bands: Bands):
    """Of each vector a row for each band: band, dim, key, rep and the first words of its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u8").reshape(batch.num_rows, -1)
                n, b = batch.num_rows, bands.bands
                columns = {"band": np.tile(np.arange(b, dtype=np.int32), n), "dim": np.repeat(np.asarray(batch.column("dim")), b), "key": bands.keys(words).astype(np.int64).ravel(), "rep": np.repeat(np.asarray(batch.column("rep")), b)}
                columns |= {f"w{k}": np.repeat(words[:, k].view(np.int64), b) for k in range(WORDS)}
                yield pa.record_batch([pa.array(x) for x in columns.values()], list(columns))

    return run


def partnered(bands: Bands):
    """Of a group's vectors those that may have a similar one in it, in a band before which the first
    words show no other in common: the rows' keys without the code."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.asarray(table.column("key")), kind="stable")))
        band, split = table.column("band")[0].as_py(), table.column("low")[0].as_py() != table.column("high")[0].as_py()
        key, side = np.asarray(table.column("key")), np.asarray(table.column("block"))
        words = np.stack([np.asarray(table.column(f"w{k}")) for k in range(WORDS)], 1).view(np.uint64)
        known = bands.keys(np.concatenate([words, np.zeros((len(words), bands.words - WORDS), np.uint64)], 1))[:, : min(band, WORDS * bands.per)]
        wanted = np.zeros(len(key), bool)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            for i in range(a, b - 1, 256):
                j = min(b, i + 256)
                differ = sum(np.bitwise_count(words[i:j, None, k] ^ words[None, i:b, k]) for k in range(WORDS))
                one, two = np.nonzero(differ <= bands.most)
                one, two = one + i, two + i
                new = (one < two) & ((side[one] != side[two]) if split else True)
                one, two = one[new], two[new]
                for part in range(0, len(one), 1 << 16):
                    x, y = one[part : part + (1 << 16)], two[part : part + (1 << 16)]
                    first = ~(known[x] == known[y]).any(1)
                    wanted[x[first]] = wanted[y[first]] = True
        return table.filter(pa.array(wanted)).select(["band", "dim", "key", "rep", "block", "near", "low", "high"])

    return run


def meeting(least: float, bands: Bands, double: bool):
    """Within a group of vectors: links that no earlier band has, as (rep, number of links, root)."""

    def run(table: pa.Table) -> pa.Table:
        band, dim = table.column("band")[0].as_py(), table.column("dim")[0].as_py()
        split = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        table = table.take(pa.array(np.argsort(np.asarray(table.column("key")), kind="stable")))
        key, reps, copies, side, factor = (np.asarray(table.column(c)) for c in ("key", "rep", "copies", "block", "factor"))
        exact = unit(floats(table.column("vec").to_pylist(), dim, double))
        turned = (exact @ rotations(dim, 1)[0].T).astype(np.float32)
        size = turned.shape[1]
        code = np.where(turned >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(size))
        keys = bands.keys(np.frombuffer(b"".join(table.column("code").to_pylist()), "<u8").reshape(len(key), -1))[:, :band]
        spread = ERRORS * np.sqrt((1 - least**2) * np.maximum(1 - factor**2, 0) / (factor**2 * (size - 1)))
        floor = ((least - spread - 1e-5) * factor)[:, None].astype(np.float32)
        left, right = [], []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            for i in range(a, b - 1, 512):
                j = min(b, i + 512)
                rough = code[i:j] @ turned[i:b].T >= floor[i:j]
                one, two = np.nonzero(rough)
                one, two = one + i, two + i
                wanted = (one < two) & ((side[one] != side[two]) if split else True)
                one, two = one[wanted], two[wanted]
                for part in range(0, len(one), 1 << 16):
                    x, y = one[part : part + (1 << 16)], two[part : part + (1 << 16)]
                    new = ~(keys[x] == keys[y]).any(1)
                    x, y = x[new], y[new]
                    linked = np.einsum("ij,ij->i", exact[x], exact[y]) >= least
                    left.append(x[linked])
                    right.append(y[linked])
        none = np.zeros(0, np.int64)
        left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
        links = np.bincount(left, copies[right], len(key)) + np.bincount(right, copies[left], len(key))
        some = np.flatnonzero(links)
        by_rep = np.argsort(reps, kind="stable")  # the root is the smallest rep
        place = np.empty(len(reps), np.int64)
        place[by_rep] = np.arange(len(reps))
        root = reps[by_rep][labels_of(len(reps), place[left], place[right])][place]
        return pa.table({"rep": pa.array(reps[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some])})

    return run


def embedding_links(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links (other vectors with cosine >= least), component_id (smallest
    vec_id that links reach, its own included), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Rows that repeat a vec_id are one vector, the smallest by
    array order that isn't null; rows with a null vec_id are left out. No rows give no rows; other
    columns are ignored, whatever their names.
    """
    if not 0 < least < 1:
        raise ValueError("the least cosine must be between 0 and 1")
    double = vectors.schema[embedding].dataType.simpleString() != "array<float>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>" if double else "array<float>").alias("embedding")).filter("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(as_bytes, "vec_id long, vec binary")
    rows = written(rows.withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    classes = written(rows.filter("vec is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    bands = Bands(classes.count(), least)
    codes = written(classes.mapInArrow(coded(bands, double), "rep long, copies long, vec binary, dim int, factor double, code binary"), "vector-codes")
    met = codes.select("rep", "dim", "code").mapInArrow(banded(bands), "band int, dim int, key long, rep long, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    hot = written(met.groupBy("band", "dim", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "hot-bands")
    met = met.join(hot, ["band", "dim", "key"], "left") if not hot.isEmpty() else met.withColumn("blocks", F.lit(None).cast("int"))
    blocks = F.coalesce("blocks", F.lit(1))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    near = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(-1 - F.col("key"))
    met = met.select("band", "dim", "key", "rep", "block", near.alias("near"), F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), *[f"w{k}" for k in range(WORDS)])
    group = ["band", "dim", "near", "low", "high"]
    some = written(met.groupBy(*group).applyInArrow(partnered(bands), "band int, dim int, key long, rep long, block int, near long, low int, high int"), "vector-partners")
    fetched = some.join(codes.drop("dim"), "rep")
    found = written(fetched.groupBy(*group).applyInArrow(meeting(least, bands, double), "rep long, links long, root long"), "vector-links")
    roots = components(found.filter("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    of_rep = classes.select("digest", "rep", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = of_rep.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.filter("vec is not null").select("vec_id", "digest").join(of_rep, "digest").select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("vec is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
with recursive e as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, root) as (select vec_id, vec_id from e union select p.b, reach.root from reach join p on p.a = reach.vec_id),
least as (select vec_id, min(root) as root from reach group by vec_id),
links as (select a as vec_id, count(*) as n from p group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id)::bigint as component_id, coalesce(root, vec_id) = vec_id as kept
from embeddings left join least using (vec_id) left join links using (vec_id)
"""
