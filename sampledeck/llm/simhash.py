"""SimHash near-duplicates found by multi-index hashing (operator 4).

A fingerprint is two 32-bit segments.  Two fingerprints that differ in 3 bits or fewer differ in 1
bit or none in one of the segments, so each enumerates the Hamming ball of radius 1 around each of
its segments (only by setting bits: of two segments one bit apart, one has that bit clear), fetches
the fingerprints filed under those keys, and complete distances are verified.  Documents with equal
fingerprints are one entry.  Keys that very many fingerprints share are left to tasks that search
the links of a block or a pair of blocks breadth first, so no pairs are written out for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_column, written
from .components import components

#: Fingerprints under one key that a join pairs with each probe; more go to blocks.
KEY_LIMIT = 64
#: Fingerprints in a block.
BLOCK = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a lower-cased text's word shingles (see the module's contract)."""
    tokens = text.split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    stops = ends[-n:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return print_of(np.array([hashed(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8"))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes (unsigned 64-bit): bits set in over half of them."""
    seen = np.zeros(2048, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # a hash takes 64 bytes here
        bytes_at = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
        seen += np.bincount(bytes_at.ravel(), minlength=2048)
    return int.from_bytes(np.packbits((2 * (seen.reshape(8, 256) @ _BITS) > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([0 if t is None else fingerprint(t.encode("utf-8", "surrogatepass").lower()) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def linked_trees(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(print, seed) for every print that links reach from a seed, breadth first."""
    left, found, seeds = prints, [], []
    while len(left):
        seed, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            nearest = np.zeros(len(left), bool)
            for part in np.array_split(wave, -(-len(wave) // 256)):
                nearest |= (np.bitwise_count(part[:, None] ^ left[None, :]) <= distance).any(0)
            wave, left = left[nearest], left[~nearest]
            found.append(wave)
            seeds.append(np.full(len(wave), seed))
    none = np.zeros(0, prints.dtype)
    return np.concatenate([none, *found]), np.concatenate([none, *seeds])


def block_links(distance: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(np.asarray(table.column("fp"), dtype=np.int64)).view(np.uint64)
        found, seeds = linked_trees(prints, distance)
        return pa.table({"src": pa.array(found.view(np.int64)), "dst": pa.array(seeds.view(np.int64))})

    return run


def fingerprint_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (src, dst) that connect exactly the fingerprints (distinct longs in column fp) that
    chains of distances of at most 3 connect."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 cover distances up to 3")
    segment = lambda c: F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(c, 32).alias("key")), F.struct(F.lit(1).alias("seg"), F.col(c).bitwiseAND(0xFFFFFFFF).alias("key")))
    filed = prints.select("fp", F.inline(segment("fp")))
    ball = F.array_union(F.array("key"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    probes = filed.select("seg", F.explode(ball).alias("key"), "fp", F.col("key").alias("own"))
    hot = written(filed.groupBy("seg", "key").count().filter(F.col("count") > KEY_LIMIT), "hot-keys")
    some = not hot.isEmpty()
    cold = filed.join(hot, ["seg", "key"], "left_anti") if some else filed
    links = probes.alias("p").join(cold.alias("c"), ["seg", "key"]).filter(F.bit_count(F.col("p.fp").bitwiseXOR(F.col("c.fp"))) <= distance).filter("p.own <> key or p.fp < c.fp").select(F.col("p.fp").alias("src"), F.col("c.fp").alias("dst"))
    if some:
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        near = probes.join(hot, ["seg", "key"], "left_semi")
        sizes = near.groupBy("seg", "key").agg(F.count("*").alias("n"))
        split = near.join(sizes, ["seg", "key"]).withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        split = split.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select("seg", "key", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "fp")
        links = links.union(split.groupBy("seg", "key", "low", "high").applyInArrow(block_links(distance), "src long, dst long"))
    return links


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that
    links reach, its own included).

    Links join fingerprints that differ in `distance` bits or fewer. Null text counts as empty and,
    as every text without words, has fingerprint zero, which links like any other. Repeated rows
    each get a row. A null doc_id gets its group's smallest id, or null if the group has none.
    No rows give no rows; other columns of docs are ignored, whatever their names.
    """
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = written(rows.mapInArrow(fingerprints, "doc_id long, fp long"), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(classes.select("fp"), distance))
    grouped = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    grouped = written(grouped, "fingerprint-groups")
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(of_root, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
