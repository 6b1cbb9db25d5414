"""Context-tree weighting over binary-decomposed bytes (operator 3), and the word-unigram base.

A text is its bytes, A-Z lower-cased, and one end symbol 0xFF (never a byte of UTF-8); it begins in
a context of end symbols.  The next byte is eight binary decisions; each of the 255 decision nodes
has a context tree over the last 0..DEPTH bytes.  A tree node keeps the training counts of zeros and
ones and weighs its own Krichevsky-Trofimov estimate Pe against its children:
Pw = Pe at the deepest level, else (Pe + product of the children's Pw) / 2.  A bit's probability is
Pw(training data and the bit) / Pw(training data): the estimates along the context's path, mixed
with weights Pe / 2Pw; contexts never seen in training give 1/2.

The probability of a byte depends on the byte and the depth bytes before it only.  So each chunk of
documents asks for its distinct grams (context and byte); a bucket holds whole subtrees (a hash of the
last two bytes of context), merges all chunks' training counts, works out every asked gram, and
answers each chunk.  Depths 1 and 0 (at most 256*255+255 nodes) are summed by Spark and are the only
part of the model that the driver sees.  The base's word counts travel the same way.

Log probabilities are rounded to multiples of 2^-32 and added as whole numbers, so a score is the same
in whatever order, chunk or bucket its parts were worked out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BLOB, CHUNK_BYTES, blob_rows, chunked, give_back, grouped, pack_arrays, text_column, unpack_arrays, unpack_arrow, written

#: Bytes of context; 7 at most.
DEPTH = 6
END = 255
#: Bytes of texts whose grams, or words, stand in memory at once, place by place, at most.
BLOCK_BYTES = 12 << 20
#: Log probabilities are multiples of 1 / UNIT, and of magnitude under 2^40 / UNIT.
UNIT = float(1 << 32)
LN_HALF = float(np.log(0.5))
_BUCKET = "bucket int, merged binary, chunks array<long>, blobs array<binary>"
_NODES = "ctx int, node int, n0 double, n1 double, lw double"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up by 8: good to 1e-12 for x >= 0.5."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - ln_gamma(n0 + n1 + 1.0) - 1.1447298858494002


def kt_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


class Level:
    """The nodes of one depth: counts, log Pw, and where each child's parent stands."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.n0, self.n1 = n0, n1
        pe = ln_kt(n0, n1)
        self.lw = pe if below is None else LN_HALF + np.logaddexp(pe, below)
        self.own = np.exp(LN_HALF + pe - self.lw)  # weight of the node's own estimate
        self.kt = kt_one(n0, n1)


def subtrees(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], list[Level], list[np.ndarray], np.ndarray]:
    """From distinct grams (depth bytes of context, then the byte) and training counts, the levels
    depth, ..., 2: (nodes' keys at depth, parents' indices for each level, levels, keys, and the
    index of each gram's eight nodes). A key is context << 8 | node."""
    byte = grams & np.uint64(255)
    base = (grams >> np.uint64(8)) << np.uint64(8)
    keys = np.concatenate([base | np.uint64(1 << b) | (byte >> np.uint64(8 - b)) for b in range(8)])
    ones = np.concatenate([(byte >> np.uint64(7 - b)) & np.uint64(1) for b in range(8)]).astype(np.float64)
    weight = np.tile(counts.astype(np.float64), 8)
    key, path = np.unique(keys, return_inverse=True)
    n1 = np.bincount(path, weight * ones, len(key))
    levels, parents, all_keys = [Level(np.bincount(path, weight, len(key)) - n1, n1, None)], [], [key]
    for level in range(depth - 1, 1, -1):
        key, parent = np.unique(all_keys[-1] & np.uint64((1 << (8 * level + 8)) - 1), return_inverse=True)
        child = levels[-1]
        levels.append(Level(*(np.bincount(parent, x, len(key)) for x in (child.n0, child.n1)), np.bincount(parent, child.lw, len(key))))
        child.n0 = child.n1 = child.lw = None  # summed up, and not asked for again
        parents.append(parent)
        all_keys.append(key)
    return all_keys[0], parents, levels, all_keys, path.reshape(8, -1)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """log10 of each gram's byte given its context. top: own weight and estimate at depth 1 (index
    context << 8 | node) and depth 0 (index node)."""
    keys, parents, levels, _, path = subtrees(grams, counts, depth)
    p, at = levels[0].kt, np.arange(len(keys))
    for parent, level in zip(parents, levels[1:], strict=True):
        at = parent[at]
        p = level.own[at] * level.kt[at] + (1 - level.own[at]) * p
    own1, kt1, own0, kt0 = top
    for own, kt, mask in ((own1, kt1, 0xFFFF), (own0, kt0, 0xFF)):
        k = (keys & np.uint64(mask)).astype(np.int64)
        p = own[k] * kt[k] + (1 - own[k]) * p
    byte = (grams & np.uint64(255)).astype(np.int64)
    return sum(np.log10(np.where((byte >> (7 - b)) & 1, p[path[b]], 1 - p[path[b]])) for b in range(8))


def top_levels(depth2: DataFrame) -> tuple[np.ndarray, ...]:
    """Depths 1 and 0 from the nodes of depth 2, summed by Spark; at most 65,280 rows come back."""
    rows = depth2.groupBy(F.col("ctx").bitwiseAND(255).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("lw")).toPandas()
    n0, n1, lw = (np.zeros(1 << 16) for _ in range(3))
    at = rows["ctx"].to_numpy() << 8 | rows["node"].to_numpy()
    n0[at], n1[at], lw[at] = rows["n0"], rows["n1"], rows["lw"]
    one = Level(n0, n1, lw)
    zero = Level(*(x.reshape(256, 256).sum(0) for x in (one.n0, one.n1, one.lw)))
    return one.own, one.kt, zero.own, zero.kt


class Grams:
    """The distinct grams of texts and where they stand. texts: bytes, already lower-cased; parts of
    texts have the depth bytes before them in `before`, and end with their text where `last` says so."""

    def __init__(self, texts: list[bytes], depth: int, before: list[bytes] | None = None, last: list[bool] | None = None) -> None:
        pad, end = bytes([END]) * depth, bytes([END])
        if before is None or last is None:
            data = np.frombuffer(pad + (pad + end).join(texts) + end + pad, np.uint8)
            self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        else:
            data = np.frombuffer(b"".join(x for a, t, z in zip(before, texts, last, strict=True) for x in (a, t, end if z else b"")) + pad, np.uint8)
            self.sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + np.array(last, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.first[-1])
        every = np.zeros(len(data) - depth, np.uint64)  # from each byte on, across texts too
        for k in range(depth + 1):
            every <<= np.uint64(8)
            every |= data[k : k + len(every)]
        where = np.arange(n, dtype=np.int32)
        where += np.repeat(np.arange(len(texts), dtype=np.int32) * depth, self.sizes)
        key = every[where]
        del where, data, every
        # sorted by a hash of the gram with the place in its low bits: equal grams make a run (or, where
        # hashes collide, several), and no sort of indices is needed
        bits = np.uint64(max(1, int(n - 1).bit_length()))
        mixed = key * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        mixed >>= bits
        mixed <<= bits
        mixed |= np.arange(n, dtype=np.uint32)
        mixed.sort()
        mixed &= (np.uint64(1) << bits) - np.uint64(1)
        self.order = mixed.astype(np.int32)
        del mixed
        key = key[self.order]
        self.starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.grams, self.run = np.unique(key[self.starts], return_inverse=True)

    def counts(self, of_text: np.ndarray) -> np.ndarray:
        """How often each gram stands in the texts marked by of_text."""
        runs = np.add.reduceat(np.repeat(of_text, self.sizes)[self.order], self.starts, dtype=np.int64)
        return np.bincount(self.run, runs, len(self.grams)).astype(np.int64)

    def sums(self, of_gram: np.ndarray) -> np.ndarray:
        """For each text the sum over its grams of whole numbers."""
        at = np.empty(len(self.order), np.int64)
        at[self.order] = np.repeat(of_gram[self.run], np.diff(np.append(self.starts, len(self.order))))
        return np.add.reduceat(at, self.first[:-1])


def by_bucket(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the grams by bucket, where each bucket begins and the last ends)"""
    context = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
    bucket = ((context * np.uint64(2654435761)) % np.uint64(1 << 32) % np.uint64(buckets)).astype(np.uint16)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


class ChunkGrams:
    """The distinct grams of a chunk. Texts are looked at in blocks of BLOCK_BYTES at most, long ones in parts
    that take the context before them along, so what a chunk needs besides its distinct grams is
    bounded however long a text is. Sums of whole numbers don't depend on parts."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        self.depth, self.n, self.blocks = depth, len(texts), []
        pad, held, total = bytes([END]) * depth, 0, max(1, sum(map(len, texts)))
        size = -(-total // -(-total // BLOCK_BYTES))  # blocks of about one size
        for k, text in enumerate(texts):
            for a in range(0, max(1, len(text)), size):
                b = min(len(text), a + size)
                if not self.blocks or held + b - a > BLOCK_BYTES:
                    self.blocks.append([])
                    held = 0
                self.blocks[-1].append((k, text, a, b, (pad + text[max(0, a - depth) : a])[-depth:]))
                held += b - a
        self.only = self.grams_of(0) if len(self.blocks) == 1 else None

    def grams_of(self, block: int) -> Grams:
        parts = self.blocks[block]
        return Grams([t if a == 0 and b == len(t) else t[a:b] for _, t, a, b, _ in parts], self.depth, [x for *_, x in parts], [b == len(t) for _, t, _, b, _ in parts])

    def each(self) -> Iterator[tuple[np.ndarray, Grams]]:
        """(text of each part, grams) of every block."""
        for block, parts in enumerate(self.blocks):
            yield np.fromiter((x[0] for x in parts), np.int64, len(parts)), self.only or self.grams_of(block)

    def counted(self, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct grams in order, how often each stands in the texts marked by of_text)"""
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for text, own in self.each():
            some = own.counts(of_text[text])
            if not len(grams):
                grams, counts = own.grams, some
            else:
                grams, at = np.unique(np.concatenate([grams, own.grams]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, some]).astype(np.float64), len(grams)).astype(np.int64)
        return grams, counts

    def distinct(self) -> np.ndarray:
        return self.only.grams if self.only else self.counted(np.zeros(self.n, bool))[0]

    def sums(self, grams: np.ndarray, of_gram: np.ndarray) -> np.ndarray:
        """For each text the sum over its grams of whole numbers; grams: distinct(), in order."""
        out = np.zeros(self.n, np.int64)
        for text, own in self.each():
            np.add.at(out, text, own.sums(of_gram if own is self.only else of_gram[np.searchsorted(grams, own.grams)]))
        return out


def lowered(table: pa.Table) -> list[bytes]:
    return [b"" if x is None else x.lower() for x in table.column("text").cast(pa.binary()).to_pylist()]


_GAP = re.compile(rb"[\t-\r ]")


def word_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, Words]]:
    """(text of each part, words) of texts in blocks of about BLOCK_BYTES; long ones are cut at white space."""
    parts, whose, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = len(text)
            if end - at > BLOCK_BYTES:
                gap = _GAP.search(text, at + BLOCK_BYTES)
                end = gap.start() if gap else end
            if parts and held + end - at > BLOCK_BYTES:
                yield np.array(whose, np.int64), Words(parts)
                parts, whose, held = [], [], 0
            parts.append(text if end - at == len(text) else text[at:end])
            whose.append(k)
            held += end - at
            at = max(end, 1)
    if parts:
        yield np.array(whose, np.int64), Words(parts)


class Words:
    """The words of texts: distinct (in order of sight), number (which each word is) and text (whose)."""

    def __init__(self, texts: list[bytes]) -> None:
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        flat = cut.flatten()
        there = np.asarray(pc.binary_length(flat)) > 0  # white space at an end leaves an empty one
        coded = flat.filter(pa.array(there)).dictionary_encode()
        self.distinct, self.number = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        self.text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[there]


def pack_words(counts: dict[bytes, int]) -> bytes:
    return pack_arrays(np.frombuffer(b"\n".join(counts), np.uint8), np.fromiter(counts.values(), np.int64, len(counts)))


def unpack_words(blob: bytes) -> dict[bytes, int]:
    words, counts = unpack_arrays(blob)
    return dict(zip(words.tobytes().split(b"\n"), counts.tolist(), strict=True)) if len(counts) else {}


def ask(buckets: int, depth: int):
    """Of each chunk: its distinct grams and words with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                table = unpack_arrow(payload.as_py())
                texts, train = lowered(table), ~np.asarray(table.column("held_out"), dtype=bool)
                grams, counts = ChunkGrams(texts, depth).counted(train)
                order, ends = by_bucket(grams, buckets)
                blobs = [pack_grams(grams[part], counts[part]) if len(part) else None for part in np.split(order, ends[1:-1])]
                del grams, counts, order
                split: list[dict[bytes, int]] = [{} for _ in range(buckets)]
                for whose, words in word_parts(texts):
                    counted = np.bincount(words.number, train[whose][words.text], len(words.distinct)).astype(np.int64)
                    for word, n in zip(words.distinct, counted.tolist(), strict=True):
                        own = split[zlib.crc32(word) % buckets]
                        own[word] = own.get(word, 0) + n
                    del words, counted
                del texts, table
                yield blob_rows([*blobs, *(pack_words(x) if x else None for x in split)], chunk)
                del blobs, split
                give_back()

    return run


def pack_grams(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct grams in order, by their distances, and counts."""
    small = [x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x for x in (np.diff(grams, prepend=np.uint64(0)), counts)]
    return pack_arrays(*small)


def unpack_grams(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    distances, counts = unpack_arrays(blob)
    return np.cumsum(distances, dtype=np.uint64), counts


def gather(buckets: int):
    """A bucket as one row: its chunks' questions, and their counts added up."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), [x.as_py() for x in table.column("blob")]
        if bucket < buckets:
            parts = [unpack_grams(x) for x in blobs]
            grams, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            merged = pack_grams(grams, np.bincount(at, np.concatenate([x[1] for x in parts]).astype(np.float64), len(grams)).astype(np.int64))
        else:
            words: Counter[bytes] = Counter()
            for x in blobs:
                words.update(unpack_words(x))
            merged = pack_words(words)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "merged": pa.array([merged], pa.binary()), "chunks": pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())), "blobs": pa.array([blobs], pa.list_(pa.binary()))})

    return run


def depth_two(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("merged"):
                _, _, levels, keys, _ = subtrees(*unpack_grams(blob.as_py()), depth)
                last, key = levels[-1], keys[-1].astype(np.int64)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"ctx": (key >> 8).astype(np.int32), "node": (key & 255).astype(np.int32), "n0": last.n0, "n1": last.n1, "lw": last.lw}), preserve_index=False)

    return run


def word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("merged"):
            counts = unpack_arrays(blob.as_py())[1]
            yield pa.record_batch([pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64())], ["tokens", "types"])


def pack_logs(logs: np.ndarray) -> bytes:
    """Whole numbers from 0 to under 2^40, a byte of all after another, as the upper ones compress."""
    return pack_arrays(*((logs >> 8 * k & 0xFF).astype(np.uint8) for k in range(5)))


def unpack_logs(blob: bytes) -> np.ndarray:
    out = np.int64(0)
    for k, part in enumerate(unpack_arrays(blob)):
        out = out | part.astype(np.int64) << 8 * k
    return out


def answer(buckets: int, top, depth: int):
    """Of each bucket the answers to its chunks: for their grams -log10 of the probability, for their
    words the counts, of those that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, merged, chunks, asked in zip(batch.column("bucket").to_pylist(), batch.column("merged"), batch.column("chunks"), batch.column("blobs"), strict=True):
                if bucket < buckets:
                    grams, counts = unpack_grams(merged.as_py())
                    logs = np.rint(-UNIT * log_probabilities(grams, counts, top.value, depth)).astype(np.int64)
                    blobs = [pack_logs(logs[np.searchsorted(grams, unpack_grams(x.as_py())[0])]) for x in asked]
                else:
                    words = unpack_words(merged.as_py())
                    blobs = [pack_words({w: words[w] for w in unpack_words(x.as_py()) if words[w]}) for x in asked]
                numbers = chunks.as_py()
                yield pa.record_batch([pa.array([bucket] * len(blobs), pa.int32()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])
                give_back()

    return run


def scored(buckets: int, tokens: int, types: int, ends: int, depth: int):
    total, divisor = tokens + ends, tokens + ends + 0.5 * (types + (ends > 0) + 1)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpack_arrow(chunk.column("payload")[0].as_py())
        texts = lowered(table)
        blobs = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob"), strict=True))
        chunk_grams = ChunkGrams(texts, depth)
        grams = chunk_grams.distinct()
        order, ends_at = by_bucket(grams, buckets)
        logs = np.empty(len(order), np.int64)
        for k in range(buckets):
            if ends_at[k + 1] > ends_at[k]:
                logs[order[ends_at[k] : ends_at[k + 1]]] = unpack_logs(blobs[k].as_py())
        score = chunk_grams.sums(grams, logs) / -UNIT
        del chunk_grams, grams, logs, order
        give_back()
        known: dict[bytes, int] = {}
        for k, blob in blobs.items():
            if k >= buckets:
                known.update(unpack_words(blob.as_py()))
        unknown, end = float(np.log10(0.5 / divisor)), float(np.log10((ends + 0.5) / divisor))
        n_words, n_found, total_value = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        for whose, words in word_parts(texts):
            times = np.fromiter((known.get(w, 0) for w in words.distinct), np.float64, len(words.distinct))
            value = np.where(times > 0, np.log10((times + 0.5) / divisor), unknown)
            for out, x in ((n_words, None), (n_found, (times > 0)[words.number]), (total_value, value[words.number])):
                np.add.at(out, whose, np.bincount(words.text, x, len(whose)).astype(out.dtype))
            del words
        n_tokens, n_known, base = n_words + 1, n_found.astype(np.int64) + (ends > 0), total_value + end
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = {"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": [total] * len(texts), "base_score": base, "score": score, "n_bytes": sizes, "bits_per_byte": -score * np.log2(10.0) / (sizes + 1)}
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in out.items()})

    return run


def context_tree_scores(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, depth: int = DEPTH) -> DataFrame:
    """Score every text of docs by a context-tree model and by a word-unigram base, both learned
    from the rows for which the SQL expression held_out isn't true.

    A row for each row of docs (repeated rows each get one): SCHEMA. Null text counts as empty; a
    null held_out as false; null ids are carried through; no rows give no rows. Other columns of
    docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    if not 2 <= depth <= 7:
        raise ValueError("the depth must be from 2 to 7")
    chunks = chunked(rows, ["doc_id", "held_out", "text"], "ctw-chunks", chunk_bytes)
    n_bytes = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = min(1 << 15, max(24, n_bytes // (8 << 20)))  # a bucket holds whole two-byte contexts
    known = written(grouped(chunks.mapInArrow(ask(buckets, depth), CHUNK_BLOB), gather(buckets), _BUCKET, "bucket"), "ctw-buckets")
    top = spark.sparkContext.broadcast(top_levels(known.filter(F.col("bucket") < buckets).mapInArrow(depth_two(depth), _NODES)))
    words = known.filter(F.col("bucket") >= buckets).mapInArrow(word_totals, "tokens long, types long")
    tokens, types = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    ends = rows.filter(~F.col("held_out")).count()
    answers = known.mapInArrow(answer(buckets, top, depth), CHUNK_BLOB)
    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored(buckets, tokens, types, ends, depth), SCHEMA)


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), "crc32(cast(doc_id as string)) % 5 = 1")
