"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

An item is the set of its word shingles; a document holds it if at least `least` of them are among
the document's.  An item of n shingles that is held shares ceil(least * n) with the document, so of
its n - ceil(least * n) + 1 shingles with the smallest hashes, its MinHash sketch, at least one is
in the document: looking up sketches loses nothing.  Items are partitioned by the size a document
needs to hold them (powers of two of ceil(least * n)); a document searches the partitions that its
own size reaches, and candidates are verified by exact shingle containment over the whole document.

Items are looked up in blocks of about BLOCK_BYTES of text.  A task makes a block's sketches and writes
them to the shared folder, where the tasks that search read them; the driver sees none.  Documents
are read once a block and never shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, new_path, text_column, written
from .files import Reader, Writer
from .tokens import slices_of

#: Bytes of item texts that one pass over the documents looks up.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, item_shingles long, matched long, containment double"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def shingle_rows(ids: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, size) if len(ids) >= size else np.zeros((0, size), ids.dtype)


def row_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of word ids; equal rows have equal ones."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * _MIX[k % 8]
        out ^= out >> np.uint64(29)
    return out


class Items:
    """A block of items, ready to look up. Word ids start at 1; 0 is any word that no item has."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, least: float) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items, sketches = [], {}
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            size = min(shingle, len(words))
            shingles = np.unique(shingle_rows(ids, size), axis=0)
            need = math.ceil(least * len(shingles) - 1e-9)
            spelled = dict(zip(ids.tolist(), words, strict=True))
            hashes = [xxhash.xxh64_intdigest(b" ".join(map(spelled.__getitem__, row)), 17) for row in shingles.tolist()]
            lowest = np.argsort(np.array(hashes, np.uint64), kind="stable")[: len(shingles) - need + 1]
            place = len(self.items)
            self.items.append((item_id, shingles, need))
            keys = row_keys(shingles)
            # (words in a shingle, size class): documents with fewer shingles than 2 ** class skip it
            into = sketches.setdefault((size, need.bit_length() - 1), [])
            into += [(int(keys[k]), place) for k in lowest]
        self.sketches = {}
        for part, pairs in sketches.items():
            pairs.sort()
            keys = np.array([k for k, _ in pairs], np.uint64)
            self.sketches[part] = (keys, np.array([p for _, p in pairs]))

    def held_by(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item_id, shingles, shingles also in the document) of the items that it holds."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        out = []
        for size in {part[0] for part in self.sketches}:
            if len(ids) < size:
                continue
            known = np.convolve(ids != 0, np.ones(size, int), "valid") == size
            at = np.flatnonzero(known)  # a window with a word of no item matches nothing
            if not len(at):
                continue
            rows = shingle_rows(ids, size)[at]
            keys, first = np.unique(row_keys(rows), return_index=True)
            found: set[int] = set()
            for (own, level), (sketch, places) in self.sketches.items():
                if own == size and len(ids) - size + 1 >= 1 << level:
                    left, right = np.searchsorted(sketch, keys, "left"), np.searchsorted(sketch, keys, "right")
                    for a, b in zip(left[right > left], right[right > left], strict=True):
                        found.update(places[a:b].tolist())
            for place in sorted(found):
                item_id, shingles, need = self.items[place]
                spot = np.minimum(np.searchsorted(keys, row_keys(shingles)), len(keys) - 1)
                matched = int((rows[first[spot]] == shingles).all(1).sum())
                if matched >= need:
                    out.append((item_id, len(shingles), matched))
        return out


def make_block(folder: str, shingle: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        out = Writer(folder, ".items")
        out.write(pickle.dumps(Items(rows, shingle, least), protocol=5))
        out.close()
        return pa.table({"url": [out.url], "size": pa.array([out.position], pa.int64())})

    return run


#: The block that a worker searches, by its file.
_held: dict[str, Items] = {}


def block_of(url: str, size: int) -> Items:
    """A worker's copy of that file, which a task of this job wrote to the shared folder."""
    if url not in _held:
        _held.clear()
        _held[url] = pickle.loads(Reader(url).read(0, size))
    return _held[url]


def row_key(docs: DataFrame):
    """A column that tells rows of one doc_id with different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def held_items(docs: DataFrame, items: DataFrame, least: float, shingle: int, block_bytes: int) -> DataFrame:
    """As contained_items(), a row for each row of docs and item that it holds, with row_key."""
    items = text_column(items).select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    docs = text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(docs).alias("row_key"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    split = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-total // block_bytes) or 1)))
    blocks = written(split.groupBy("block").applyInArrow(make_block(new_path(docs.sparkSession, "items"), shingle, least), "url string, size long"), "item-blocks")

    def search(url: str, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
                found = [(ids[begin + k], keys[begin + k], *held) for begin, texts in slices_of(batch.column("text"), 1 << 21) for k, text in enumerate(texts.to_pylist()) for held in block_of(url, size).held_by(words_of(text))]
                if found:
                    doc, key, item, n, m = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array([a / b for a, b in zip(m, n, strict=True)], pa.float64())], ["doc_id", "row_key", "item_id", "item_shingles", "matched", "containment"])
                give_back()

        return run

    schema = SCHEMA.replace("item_id", "row_key long, item_id")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks.collect():  # a row of a few bytes for each block_bytes of items
        out = out.union(docs.mapInArrow(search(block["url"], block["size"]), schema))
    return out


def contained_items(docs: DataFrame, items: DataFrame, least: float = 0.8, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (SCHEMA) of a document and an item of which it holds at least `least` of the distinct
    shingles: sequences of `shingle` lower-cased words; of a shorter item, all its words.

    Null and empty items match nothing and null and empty documents hold nothing; rows with a null
    item_id are left out; documents with a null id are reported with it. Each distinct pair with its
    counts comes once, however often rows repeat. Other columns are ignored, whatever their names.
    """
    return held_items(docs, items, least, shingle, block_bytes).drop("row_key").distinct()


def op6_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
with iw as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark where text is not null),
items as (select item_id, w, least(5, len(w)) as n from iw where len(w) > 0),
ish as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from items)),
sized as (select item_id, count(*) as total from ish group by item_id),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents where text is not null),
dsh as (
  select doc_id, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from items) where len(w) >= n)),
hits as (select doc_id, item_id, count(distinct s) as matched from dsh join ish using (n, s) group by doc_id, item_id)
select doc_id, item_id, total::bigint as item_shingles, matched::bigint as matched, matched::double / total as containment
from hits join sized using (item_id) where matched >= 0.8 * total - 1e-9
"""


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; each row is judged by its own text, whether its doc_id
    repeats or is null."""
    key, id_, held_key = fresh(docs, "_key"), fresh(docs, "_id"), fresh(docs, "_held")
    # written, so that Spark knows its size: a small one is broadcast and no text is shuffled
    held = written(held_items(docs, items, 0.8, 5, BLOCK_BYTES).select(F.col("doc_id").alias(id_), F.col("row_key").alias(held_key)).distinct(), "contaminated")
    marked = docs.withColumn(key, row_key(docs))
    return marked.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(held_key)), "left_anti").select(*docs.columns)
