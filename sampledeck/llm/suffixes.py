"""Removal of passages that an earlier document has, by depth-limited radix sort (operator 8).

Suffixes are ordered through the first LENGTH bytes only, by most-significant-digit passes of eight
bytes; the groups still equal after the last digit are exactly the windows that repeat, and each
group's smallest document keeps its copy.

So that few suffixes need sorting, windows first meet by their minimizer: of the hashes of a
window's strings of seed_of(LENGTH) bytes the smallest, which equal windows share.  Runs of windows with
one minimizer make a stretch, a fourteenth as many as windows.  Chunks ask which of their minimizers two
documents have; only stretches of those are sent, each text once a chunk with its smallest document,
to the bucket of their minimizer.  There each text is kept once, and where a minimizer has several
their windows are radix-sorted: a text that whole copies share is settled by its documents alone.  The
chunks get back each window's smallest document.

Seeds must be long for that: of 16 bytes of prose from few syllables more and more are in other
documents as a corpus grows, of 24 hardly more than the windows that do repeat.

A minimizer of very many different texts - a phrase that all documents share, in ever other
surroundings - would put them all into one bucket.  Where over HOT texts have it, or texts with over
HOT * TYPICAL windows, its windows are sent one by one, to buckets by a hash of the window itself, which
splits the group as a first digit would: equal windows still meet, and no bucket gets more than its
share.  Texts are counted, not their copies: of a sample of texts, by their hash, chunks send hash and
windows along with their minimizers.  Stretches are cut at LONGEST windows, so their number bounds
their bytes.

A chunk's texts stay in the buffer that they were read in, and are looked at in blocks of 64 KB, which
stay in a core's cache, a long one's overlapping by a window; what a chunk does for its buckets is sorted
by bucket once, so its work doesn't depend on how many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BLOB, CHUNK_BYTES, chunked, exchange, give_back, grouped, pack_arrays, text_column, unpack_arrays, unpack_arrow, written

#: Bytes of a string whose hash can be a window's minimizer, at least; windows must be longer.
SEED = 16
#: Different texts that have a minimizer from which on its windows go to buckets of their own.
HOT = 2048
#: Windows of a text, about, for which HOT stands.
TYPICAL = 16
#: Windows of a stretch at most.
LONGEST = 512
#: Bytes of text that are looked at as one.
BLOCK = 1 << 16
#: Windows, or bytes of texts, that are looked at as one.
PIECE = 1 << 18
SCHEMA = "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>"
_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def seed_of(length: int) -> int:
    return 24 if length >= 40 else SEED


def rate_of(hot: int) -> int:
    """One text in so many is counted, a power of two; 32 or more of what is too much are."""
    return 1 << max(0, (hot // 32).bit_length() - 1)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = int(_A)
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


def pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of items that have PIECE together, or a single one that has more."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        yield slice(a, b)
        a = b


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each item, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def changes(values: np.ndarray) -> np.ndarray:
    """Where runs of one value begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        part = out[k::8]
        part[:] = padded[k : k + 8 * len(part)].view(">u8")
    return out


class Stretches:
    """Of texts, one after another in data with text k at first[k] : first[k + 1], the runs of windows
    with one minimizer, LONGEST windows at most: key (40 mixed bits), doc (index of the text), start
    (in data), windows (how many), text (a hash of the bytes that the windows cover)."""

    def __init__(self, data: np.ndarray, first: np.ndarray, use: np.ndarray, length: int) -> None:
        self.length, self.first, self.sizes = length, first, np.diff(first)
        found, a, n = [], 0, len(self.sizes)
        while a < n:
            b = max(a + 1, int(np.searchsorted(first, first[a] + BLOCK, "right")) - 1)
            if b == a + 1:  # maybe a long text, in blocks that overlap by a window but for a byte
                for at in range(0, max(1, int(self.sizes[a]) - length + 1), BLOCK):
                    end = min(int(self.sizes[a]), at + BLOCK + length - 1)
                    if end - at >= length and use[a]:
                        found.append(self.of_block(data[first[a] + at : first[a] + end], np.array([0, end - at]), use[a:b], int(first[a]) + at, a))
            elif self.sizes[a:b].max() >= length:
                found.append(self.of_block(data[first[a] : first[b]], first[a : b + 1] - first[a], use[a:b], int(first[a]), a))
            a = b
        self.key, self.start, self.windows, self.doc, self.text = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.uint64)))

    def of_block(self, data: np.ndarray, begins: np.ndarray, use: np.ndarray, offset: int, text: int) -> tuple[np.ndarray, ...]:
        word, sizes, seed = words_at(data), np.diff(begins), seed_of(self.length)
        low = word * _A
        low[:-8] += word[8:] * _B
        if seed > 16:
            low[:-16] += word[16:] * _E
        low ^= low >> np.uint64(32)
        low *= _C
        low ^= low >> np.uint64(29)
        power, inverse = powers(BLOCK + self.length)
        sums = np.append(np.uint64(0), np.cumsum(low * power[: len(low)]))
        wide, width = 1, self.length - seed + 1
        while 2 * wide <= width:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if width > wide:
            low = np.minimum(low[: wide - width], low[width - wide :])
        n = len(data) - self.length + 1
        low = low[:n]
        valid = np.zeros(n + 1, np.int32)
        long = np.flatnonzero((sizes >= self.length) & use)
        valid[begins[long]] += 1
        valid[begins[long + 1] - self.length + 1] -= 1
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        start = np.flatnonzero(new)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        windows = np.flatnonzero(last) - start + 1
        if len(windows) and windows.max() > LONGEST:
            parts = -(-windows // LONGEST)
            step = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
            windows = np.minimum(np.repeat(windows, parts) - step, LONGEST)
            start = np.repeat(start, parts) + step
        texts = (sums[start + windows + self.length - seed] - sums[start]) * inverse[start]
        return low[start] * _D >> np.uint64(24), start + offset, windows, np.searchsorted(begins, start, "right") - 1 + text, texts


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(8)).astype(np.int64) * buckets >> 32


class Chunk:
    def __init__(self, payload: bytes, length: int) -> None:
        table = unpack_arrow(payload)
        self.ids = table.column("doc_id")
        self.null = np.asarray(self.ids.is_null())
        self.doc_ids = np.asarray(self.ids.fill_null(0))
        texts = pc.fill_null(table.column("text").combine_chunks(), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.found = Stretches(self.data, offsets - offsets[0], ~self.null, length)

    def keys(self, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, whether several document ids have each; of the texts in the sample
        the index of their key, and windows << 32 | 32 bits of their hash)"""
        rank = np.unique(self.doc_ids, return_inverse=True)[1]
        both = np.sort(self.found.key << np.uint64(24) | rank[self.found.doc].astype(np.uint64))
        mine = both >> np.uint64(24)
        begins = changes(mine)
        keys = mine[begins]
        counted = np.flatnonzero(self.found.text & np.uint64(rate - 1) == 0)
        at, text = np.searchsorted(keys, self.found.key[counted]), self.found.windows[counted].astype(np.uint64) << np.uint64(32) | self.found.text[counted] >> np.uint64(32)
        order = np.lexsort((text, at))
        return keys, both[begins] != both[np.append(begins[1:], len(both))[: len(begins)] - 1], at[order], text[order]

    def contents(self, flags: dict[int, bytes], buckets: int) -> Contents:
        """What is sent of the stretches whose keys are shared. flags: a bucket's marks of its keys, 1
        shared, 2 hot."""
        marks = np.concatenate([np.zeros(0, np.uint8), *(unpack_arrays(flags[k])[0] for k in sorted(flags))])
        order = np.argsort(self.found.key)
        begins = changes(self.found.key[order])
        mark = np.repeat(marks, np.diff(np.append(begins, len(order))))
        there = np.flatnonzero(mark)
        return Contents(self, order[there], mark[there] == 2, buckets)


def same_texts(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same, as many as each size."""
    out = np.zeros(len(a), bool)
    for k in pieces(sizes):
        equal = data[spread(a[k], sizes[k])] == data[spread(b[k], sizes[k])]
        out[k] = np.logical_and.reduceat(equal, np.cumsum(sizes[k]) - sizes[k])
    return out


def hashes_at(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of data at places."""
    digits = -(-length // 8)
    factor = powers(digits + 1)[0][1:]
    out = np.empty(len(places), np.uint64)
    for k in range(0, len(places), PIECE // 8):
        part = places[k : k + PIECE // 8]
        rows = np.zeros((len(part), 8 * digits), np.uint8)
        rows[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[part]
        word = rows.view(np.uint64)
        mixed = (word ^ word >> np.uint64(29)) * factor
        out[k : k + len(part)] = (mixed ^ mixed >> np.uint64(32)).sum(axis=1) * _C
    return out ^ out >> np.uint64(32)


class Contents:
    """Distinct texts of a chunk's stretches, and where each stretch finds its answer.

    start, windows, doc, hot: of every stretch, in the order of their keys; group: the number of its
    text. A cold text is an entry, and of the hot ones' windows each distinct one: bucket, entry_start,
    entry_windows, entry_doc (the smallest document), by bucket, the cold ones first and in the order of
    their keys. entry_of has the entry of every cold text and then of every distinct hot window;
    hot_first has a hot text's first window among all hot ones, whose numbers are hot_window."""

    def __init__(self, chunk: Chunk, which: np.ndarray, hot: np.ndarray, buckets: int) -> None:
        found, length = chunk.found, chunk.found.length
        self.chunk, self.length = chunk, length
        order = np.argsort(found.key[which] << np.uint64(24) | found.text[which] >> np.uint64(40))
        which, self.hot = which[order], hot[order]
        self.start, self.windows, self.doc, key, text = found.start[which], found.windows[which], found.doc[which], found.key[which], found.text[which]
        new = np.ones(len(which), bool)
        maybe = np.flatnonzero((text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (self.windows[1:] == self.windows[:-1])) + 1
        new[maybe] = ~same_texts(chunk.data, self.start[maybe - 1], self.start[maybe], self.windows[maybe] + length - 1)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        docs = np.minimum.reduceat(chunk.doc_ids[self.doc], first) if len(first) else np.zeros(0, np.int64)
        cold, warm = np.flatnonzero(~self.hot[first]), np.flatnonzero(self.hot[first])

        sizes = self.windows[first[warm]]
        places, place_docs = spread(self.start[first[warm]], sizes), np.repeat(docs[warm], sizes)
        hashes = hashes_at(chunk.data, places, length) if len(places) else np.zeros(0, np.uint64)
        by = np.argsort(hashes)
        differs = np.ones(len(by), bool)
        maybe = np.flatnonzero(hashes[by[1:]] == hashes[by[:-1]]) + 1
        differs[maybe] = ~same_texts(chunk.data, places[by[maybe - 1]], places[by[maybe]], np.full(len(maybe), length))
        heads = np.flatnonzero(differs)
        window = np.empty(len(by), np.int64)
        window[by] = np.cumsum(differs) - 1
        window_docs = np.minimum.reduceat(place_docs[by], heads) if len(heads) else np.zeros(0, np.int64)

        self.key = key[first[cold]]
        bucket = np.concatenate([bucket_of(self.key, buckets), bucket_of(hashes[by[heads]] >> np.uint64(24), buckets)])
        deal = np.argsort(bucket, kind="stable")
        self.bucket, self.entry_is_cold = bucket[deal], deal < len(cold)
        self.entry_start = np.concatenate([self.start[first[cold]], places[by[heads]]])[deal]
        self.entry_windows = np.concatenate([self.windows[first[cold]], np.ones(len(heads), np.int64)])[deal]
        self.entry_doc = np.concatenate([docs[cold], window_docs])[deal]
        entry_of = np.empty(len(deal), np.int64)
        entry_of[deal] = np.arange(len(deal))
        begins = np.cumsum(self.entry_windows) - self.entry_windows
        at = np.empty(len(first), np.int64)  # where a text's windows begin, among all cold or among hot ones
        at[cold], at[warm] = begins[entry_of[: len(cold)]], np.cumsum(sizes) - sizes
        self.at, self.hot_at = at[group], begins[entry_of[len(cold) + window]]

    def texts(self, entries: slice = slice(None)) -> list[bytes]:
        data, start = memoryview(self.chunk.data), self.entry_start[entries]
        return [data[a:b].tobytes() for a, b in zip(start.tolist(), (start + self.entry_windows[entries] + self.length - 1).tolist(), strict=True)]

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        begins = changes(self.bucket)
        return ((int(self.bucket[a]), slice(a, b)) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(self.bucket)], strict=True)) if len(begins) else iter(())

    @cached_property
    def sent(self) -> dict[int, list[bytes]]:
        """By bucket, the texts that it gets."""
        return {bucket: self.texts(k) for bucket, k in self.by_bucket()}

    def blobs(self) -> tuple[list[int], list[bytes]]:
        """Buckets, and what each of them gets: texts, their sizes and smallest documents, and of the cold
        ones, which stand first, how far keys are from one another."""
        buckets, blobs, before = [], [], 0
        for bucket, k in self.by_bucket():
            n = int(np.count_nonzero(self.entry_is_cold[k]))
            docs = self.entry_doc[k]
            packed = small(np.diff(self.key[before : before + n], prepend=np.uint64(0)))
            buckets.append(bucket)
            blobs.append(pack_arrays(np.frombuffer(b"".join(self.texts(k)), np.uint8), (self.entry_windows[k] + self.length - 1).astype(np.uint32), small(docs) if docs.min() >= 0 else docs, packed))
            before += n
        return buckets, blobs

    def mark_earlier(self, told: dict[int, bytes], doc_ids: np.ndarray, starts: np.ndarray) -> None:
        """Sets starts where a window begins that a smaller document has, by the buckets' answers."""
        answers = [unpack_arrays(told[k])[:2] for k in sorted(told)]
        values, runs = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in answers)]) for k in (0, 1))
        flat = np.repeat(values, runs)
        self.mark(np.flatnonzero(~self.hot), flat, doc_ids, starts)
        self.mark(np.flatnonzero(self.hot), flat[self.hot_at], doc_ids, starts)

    def mark(self, mine: np.ndarray, smallest: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> None:
        for k in pieces(self.windows[mine]):
            part = mine[k]
            n = self.windows[part]
            before = smallest[spread(self.at[part], n)] < np.repeat(doc_ids[self.doc[part]], n)
            starts[spread(self.start[part], n)[before]] = True


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def pack_keys(keys: np.ndarray, several: np.ndarray, at: np.ndarray, text: np.ndarray) -> bytes:
    return pack_arrays(small(np.diff(keys, prepend=np.uint64(0))), several.astype(np.uint8), at.astype(np.uint32), text)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    deltas, several, at, text = unpack_arrays(blob)
    return np.cumsum(deltas.astype(np.uint64)), several, at, text


def asking(buckets: list[int], blobs: list[bytes], chunk: int) -> pa.RecordBatch:
    """Rows of CHUNK_BLOB for the buckets that a chunk asks, no others."""
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array([chunk] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])


def ask_keys(length: int, buckets: int, rate: int = rate_of(HOT)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                keys, several, at, text = Chunk(payload.as_py(), length).keys(rate)
                bucket = bucket_of(keys, buckets)
                begins = changes(bucket)
                ends = np.append(begins[1:], len(keys))[: len(begins)]
                rows = zip(begins.tolist(), ends.tolist(), np.searchsorted(at, begins).tolist(), np.searchsorted(at, ends).tolist(), strict=True)
                yield asking(bucket[begins].tolist(), [pack_keys(keys[a:b], several[a:b], at[c:d] - a, text[c:d]) for a, b, c, d in rows], number)
                give_back()

    return run


def combine_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all chunks' keys, whether several documents of the chunk have each; of the texts in the sample
    the key, and windows and hash)"""
    parts = [unpack_keys(b) for b in blobs]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[0][p[2]] for p in parts]), np.concatenate([p[3] for p in parts])


def shared_keys(hot: int, rate: int = rate_of(HOT)):
    """Of a bucket's keys those of several documents, and their marks. A document that is in two chunks
    under one id counts twice, which sends more than need be and changes nothing."""

    def run(asked: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, several, sampled, text = asked
        both = np.sort(keys << np.uint64(1) | several)
        begins = changes(both >> np.uint64(1))
        last = both[np.append(begins[1:], len(both))[: len(begins)] - 1]
        keys = (last >> np.uint64(1))[(np.diff(np.append(begins, len(both))) > 1) | (last & np.uint64(1) == 1)]
        order = np.lexsort((text, sampled))
        sampled, text = sampled[order], text[order]
        once = np.ones(len(order), bool)
        once[1:] = (sampled[1:] != sampled[:-1]) | (text[1:] != text[:-1])
        sampled, windows = sampled[once], (text[once] >> np.uint64(32)).astype(float)
        begin, end = np.searchsorted(sampled, keys), np.searchsorted(sampled, keys, "right")
        total = np.append(0, np.cumsum(windows))
        return keys, np.where(((end - begin) * rate > hot) | ((total[end] - total[begin]) * rate > hot * TYPICAL), 2, 1).astype(np.uint8)

    return run


def flag_keys(shared: tuple[np.ndarray, np.ndarray], blob: bytes) -> bytes:
    keys = unpack_keys(blob)[0]
    if not len(shared[0]):
        return pack_arrays(np.zeros(len(keys), np.uint8))
    at = np.minimum(np.searchsorted(shared[0], keys), len(shared[0]) - 1)
    return pack_arrays(np.where(shared[0][at] == keys, shared[1][at], 0).astype(np.uint8))


def unpack_contents(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, their smallest documents, the keys of the cold ones)"""
    data, sizes, docs, deltas = unpack_arrays(blob)
    data, ends = data.tobytes(), np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], docs.astype(np.int64), np.cumsum(deltas.astype(np.uint64))


def blobs_of(table: pa.Table, kind: int | None = None) -> dict[int, bytes]:
    """By bucket, the blobs of rows (bucket, blob, and kind where one is asked for)."""
    rows = zip(table.column("bucket").to_pylist(), table.column("blob"), table.column("kind").to_pylist() if kind is not None else [None] * len(table), strict=True)
    return {bucket: blob.as_py() for bucket, blob, own in rows if own == kind}


def ask_contents(length: int, buckets: int):
    def run(chunk: pa.Table, flags: pa.Table) -> pa.Table:
        sent = Chunk(chunk.column("payload")[0].as_py(), length).contents(blobs_of(flags), buckets)
        out = pa.Table.from_batches([asking(*sent.blobs(), chunk.column("chunk")[0].as_py())])
        give_back()
        return out

    return run


def smallest_documents(data: np.ndarray, places: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For the windows of data at places, each from a document, the smallest document with an equal
    window: most-significant-digit passes over groups of windows equal so far."""
    word = words_at(data)
    order = np.arange(len(places))
    firsts = np.zeros(min(1, len(places)), np.int64)  # where each group begins in order
    out = docs.copy()
    for digit in range(0, length, 8):
        value = word[places[order] + digit]
        if digit + 8 > length:
            value = value >> np.uint64(8 * (digit + 8 - length))
        sizes = np.diff(np.append(firsts, len(order)))
        group = np.repeat(np.arange(len(firsts)), sizes)
        unequal = np.zeros(len(firsts), bool)
        unequal[group[value != value[firsts][group]]] = True
        mixed = np.flatnonzero(unequal[group])  # only groups that the digit splits are sorted
        if len(mixed):
            by = np.lexsort((value[mixed], group[mixed])) if digit else np.argsort(value[mixed])
            order[mixed], value[mixed] = order[mixed][by], value[mixed][by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(order)))
        stays = np.repeat(sizes > 1, sizes)  # a window alone in its group is settled
        order = order[stays]
        firsts = np.concatenate([[0], np.cumsum(sizes[sizes > 1])[:-1]]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(docs[order], firsts), np.diff(np.append(firsts, len(order))))
    return out


def window_documents(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's windows begin, and end; each window's smallest document) of a bucket's distinct
    texts and their smallest documents. keys: of the texts with those numbers; the others' windows are
    alone. Only windows of one key can be equal, so texts alone with theirs are settled."""
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
    ends = np.append(0, np.cumsum(windows))
    found = np.repeat(docs, windows)
    order = np.argsort(keys, kind="stable")
    begins = changes(keys[order])
    n = np.diff(np.append(begins, len(keys)))
    begins, n = begins[n > 1], n[n > 1]
    mine = numbers[order[spread(begins, n)]]  # with others, by key
    several = np.add.reduceat(windows[mine], np.cumsum(n) - n) if len(n) else n
    done = np.append(0, np.cumsum(n))
    for k in pieces(several):
        part = mine[done[k.start] : done[k.stop]]
        data = np.frombuffer(b"".join([texts[x] for x in part.tolist()]), np.uint8)
        sizes = windows[part] + length - 1
        places = spread(np.cumsum(sizes) - sizes, windows[part])
        found[spread(ends[part], windows[part])] = smallest_documents(data, places, np.repeat(docs[part], windows[part]), length)
    return ends, found


def tell_documents(length: int):
    """Answers a bucket's chunks: of each text that one sent, in order, runs of windows with one
    smallest document."""

    def run(table: pa.Table) -> pa.Table:
        places: dict[bytes, int] = {}
        at, docs, keys = [], [], []
        for blob in table.column("blob"):
            texts, own, key = unpack_contents(blob.as_py())
            at.append(np.fromiter((places.setdefault(x, len(places)) for x in texts), np.int64, len(texts)))
            docs.append(own)
            keys.append(key)
        smallest = np.full(len(places), np.iinfo(np.int64).max)
        np.minimum.at(smallest, np.concatenate(at), np.concatenate(docs))
        numbers, first = np.unique(np.concatenate([x[: len(k)] for x, k in zip(at, keys, strict=True)]), return_index=True)
        ends, found = window_documents(list(places), smallest, np.concatenate(keys)[first], numbers, length)
        blobs = []
        for mine in at:
            flat = found[spread(ends[mine], ends[mine + 1] - ends[mine])]
            runs = changes(flat)
            values = flat[runs]
            blobs.append(pack_arrays(small(values) if values.min() >= 0 else values, small(np.diff(np.append(runs, len(flat))))))
        out = pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "blob": pa.array(blobs, pa.binary())})
        give_back()
        return out

    return run


def cut_out(length: int, buckets: int):
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        own = Chunk(chunk.column("payload")[0].as_py(), length)
        starts = np.zeros(len(own.data) + 1, bool)
        own.contents(blobs_of(told, 0), buckets).mark_earlier(blobs_of(told, 1), own.doc_ids, starts)
        seen = np.cumsum(starts[:-1], dtype=np.int32)
        gone = seen > 0
        gone[length:] = seen[length:] > seen[:-length]
        first = own.found.first
        begin = gone.copy()  # spans don't go on from text to text
        begin[1:] &= ~gone[:-1]
        heads = first[:-1][first[:-1] < len(gone)]
        begin[heads] = gone[heads]
        end = gone.copy()
        end[:-1] &= ~gone[1:]
        tails = first[1:][first[1:] > 0] - 1
        end[tails] = gone[tails]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        offsets = np.searchsorted(begin, first)
        origin = np.repeat(first[:-1], np.diff(offsets))
        spans = pa.StructArray.from_arrays([pa.array(begin - origin), pa.array(end - origin)], ["start", "end"])
        kept = np.append(0, np.cumsum(~gone))[first].astype(np.int32)
        left = pa.Array.from_buffers(pa.binary(), len(own.ids), [None, pa.py_buffer(kept), pa.py_buffer(own.data[~gone])])
        out = pa.table({"doc_id": own.ids, "n_bytes": pa.array(own.found.sizes), "kept": left, "removed": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)})
        give_back()
        return out

    return run


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """Per row of docs, as UTF-8 bytes: doc_id, n_bytes, kept (the bytes left), removed (the
    maximal spans cut out, judged on the whole input).

    A byte goes if some window of `length` bytes that covers it also starts in a document with a
    smaller doc_id. Null text counts as empty. Rows that repeat a doc_id are judged by that id, so
    they never remove from each other; rows with a null doc_id stay whole and remove nothing. No
    rows give no rows; other columns are ignored, whatever their names.
    """
    if length <= SEED:
        raise ValueError(f"windows must be longer than {SEED} bytes")
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = chunked(rows, ["doc_id", "text"], "suffix-chunks", chunk_bytes)
    n_bytes = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(6, n_bytes // CHUNK_BYTES)
    flags = written(exchange(chunks.mapInArrow(ask_keys(length, buckets, rate_of(hot)), CHUNK_BLOB), combine_keys, shared_keys(hot, rate_of(hot)), flag_keys), "shared-keys")
    payload = chunks.select("chunk", "payload").groupBy("chunk")
    asked = payload.cogroup(flags.groupBy("chunk")).applyInArrow(ask_contents(length, buckets), CHUNK_BLOB)
    windows = grouped(asked, tell_documents(length), CHUNK_BLOB, "bucket")
    told = flags.withColumn("kind", F.lit(0)).union(windows.withColumn("kind", F.lit(1)))
    return payload.cogroup(told.groupBy("chunk")).applyInArrow(cut_out(length, buckets), SCHEMA)


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
