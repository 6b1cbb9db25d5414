"""Ranked lexical search over an impact-ordered index (operator 11).

A term's part in a document's score is its weight times a whole number that depends on how often the
document has it and on the document's length only.  So within a term the order of these numbers,
its *impacts*, is the same whatever the weights: the index orders a term's postings by impact,
highest first, in groups of exactly equal impact, and serves any items.

Documents are dealt over *shards*: a scan partition's documents, about SHARD_BYTES of text each.
Shards are made in two steps, as impacts need the mean length of all documents: tasks count each
shard's terms (written to the shared folder), then, with the totals, order each shard's postings
(written again).  Searching reads each shard once.  An item is answered score-at-a-time: its terms'
groups are merged by weighted impact and added up from the highest on.  What is left of a term bounds
what it can still add; once a document that has shown no term yet can't reach the k-th score, and few
others can, reading stops and the scores of those that can are completed from the rest of their
postings.  A task carries the k best of each item from shard to shard, so later shards stop earlier.
Only these leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, new_path, pack_arrow, text_column, unpack_arrow, written
from .files import Reader, Writer
from .tokens import slices_of

#: Bytes of text in a shard, about; one document more may go over it.
SHARD_BYTES = 16 << 20
#: Bytes of item texts in a block, about: what a task holds of the items at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of a text that are cut into terms at once; a longer term is whole all the same.
WINDOW = 4 << 20
#: Postings of an item that are added before the first look at the bounds; twice as many before the next.
FIRST_STEP = 512
#: Documents whose scores are completed at most before reading goes on instead.
FEW = 256
#: Items whose best documents a task carries from shard to shard.
CARRIED = 1 << 15
#: Stands for a null doc_id, which ranks before others.
NULL = -(1 << 63)

SHARD = "shard long, n_docs long, n_filled long, n_terms long, words binary, postings binary"
INDEX = "shard long, words binary, postings binary"
_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes to bytes: letters A-Z to lower case, all that is in no term to a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms_of(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(distinct terms, number of each term in order, text of each term)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2].slice(first, last - first).to_pybytes().translate(TABLE) if last > first else b""
    plain = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets - first), pa.py_buffer(data)])
    cut = pc.split_pattern(plain, b" ")
    numbered = cut.flatten().dictionary_encode()
    words, number = numbered.dictionary, numbered.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():
        there = ~empty[number]
        number, text = (np.cumsum(~empty) - 1)[number[there]], text[there]
        words = words.filter(pa.array(~empty))
    return words, number.astype(np.int64), text


def windows(text: pa.StringScalar) -> Iterator[pa.StringArray]:
    """A long text in pieces that end before a space; a piece without one goes on to the next."""
    data, at = memoryview(text.as_buffer()), 0
    while at < len(data):
        end = len(data)
        if end - at > WINDOW:
            found = bytes(data[at + WINDOW : at + 2 * WINDOW]).translate(TABLE).find(b" ")
            step = 2
            while found < 0 and at + step * WINDOW < len(data):
                found = bytes(data[at + step * WINDOW : at + (step + 1) * WINDOW]).translate(TABLE).find(b" ")
                found = found + (step - 1) * WINDOW if found >= 0 else -1
                step += 1
            end = at + WINDOW + found if found >= 0 else end
        yield pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, end - at], np.int32)), pa.py_buffer(bytes(data[at:end])))
        at = end


class Counts:
    """How often each document of a shard has each term: term and document numbers of the shard."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.binary())
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: pa.StringArray, docs: np.ndarray) -> None:
        words, number, text = terms_of(texts)
        if not len(number):
            return
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            missing = pc.is_null(at)
            place = np.asarray(pc.fill_null(at, 0), dtype=np.int64)
            place[np.asarray(missing)] = len(self.words) + np.arange(at.null_count)
            self.words = pa.concat_arrays([self.words, words.filter(missing)])
        else:
            place = np.asarray(at, dtype=np.int64)
        code, count = np.unique((place[number] << 32) | docs[text], return_counts=True)
        self.parts.append((code, count))
        self.held += len(code)
        if self.held > 1 << 22:  # of a long text, mostly the same again
            self.parts = [self.merged()]
            self.held = min(len(self.parts[0][0]), 1 << 21)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        code = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in self.parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.parts)])
        order = np.argsort(code, kind="stable")
        code = code[order]
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        return code[begins], np.add.reduceat(count[order], begins) if len(begins) else count

    def pack(self) -> tuple[bytes, bytes, np.ndarray]:
        """(terms and in how many documents each is; postings by term, then document; the documents'
        numbers of terms, up to the last that has any)."""
        code, count = self.merged()
        term, doc = code >> 32, code & 0xFFFFFFFF
        df = np.bincount(term, minlength=len(self.words))
        words = pack_arrow(pa.record_batch([self.words, pa.array(df)], ["term", "df"]))
        return words, pack_arrow(pa.record_batch([pa.array(doc.astype(np.uint32)), pa.array(count.astype(np.uint32))], ["doc", "tf"])), np.bincount(doc, weights=count).astype(np.int64)


def count_shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, ids, size = TaskContext.get().partitionId() << 32, Counts(), [], 0

        def row() -> pa.RecordBatch:
            words, postings, n = counts.pack()
            names = pa.concat_arrays(ids)
            n = np.concatenate([n, np.zeros(len(names) - len(n), np.int64)])
            table = pack_arrow(pa.record_batch([names, pa.array(n)], ["doc_id", "n"]))
            return pa.RecordBatch.from_pylist([{"shard": number, "n_docs": len(names), "n_filled": int((n > 0).sum()), "n_terms": int(n.sum()), "words": words, "postings": postings, "docs": table}])

        for batch in batches:
            texts, names = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            for begin, part in slices_of(texts, WINDOW):
                if size >= shard_bytes:
                    yield row()
                    number, counts, ids, size = number + 1, Counts(), [], 0
                    give_back()
                done = sum(map(len, ids))
                ids.append(names.slice(begin, len(part)))
                if len(part) == 1 and len(part[0].as_buffer()) > WINDOW:
                    for piece in windows(part[0]):
                        counts.add(piece, np.array([done]))
                        size += len(piece[0].as_buffer())
                else:
                    counts.add(part, done + np.arange(len(part)))
                    size += sum(pc.binary_length(part).to_pylist()) + 64 * len(part)
        if ids:
            yield row()
        give_back()

    return run


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, before the term's weight."""
    m = 100 - 90 + (90 * n * docs) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def order_shard(words: bytes, postings: bytes, docs: bytes, n_filled: int, n_terms: int) -> tuple[bytes, bytes]:
    """A shard's postings by term, then impact, highest first, in groups of equal impact. words gets each
    term's first group, postings the groups (impact, first posting) and the documents in order."""
    table, posted = unpack_arrow(words), unpack_arrow(postings)
    n = unpack_arrow(docs).column("n").to_numpy()
    df = table.column("df").to_numpy()
    term, doc = np.repeat(np.arange(len(df)), df), posted.column("doc").to_numpy()
    worth = impact(posted.column("tf").to_numpy().astype(np.int64), n[doc], n_filled, n_terms)
    order = np.lexsort((doc, -worth, term))
    worth, doc = worth[order], doc[order]
    begins = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(worth, prepend=-1) != 0))
    first = np.searchsorted(begins, np.append(0, np.cumsum(df)))
    out = pa.record_batch([table.column("term").combine_chunks(), pa.array(df), pa.array(first[:-1])], ["term", "df", "first"])
    groups = pa.record_batch([pa.array([worth[begins]]), pa.array([np.append(begins, len(doc))]), pa.array([doc])], ["impact", "begin", "doc"])
    return pack_arrow(out), pack_arrow(groups)


def order_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
            words, postings = order_shard(get("words"), get("postings"), get("docs"), get("all_filled"), get("all_terms"))
            yield pa.record_batch([batch.column("shard").slice(row, 1), pa.array([words]), pa.array([postings]), batch.column("docs").slice(row, 1)], ["shard", "words", "postings", "docs"])
            give_back()


class Index:
    """shards: rows (shard, words, postings, docs), packed; filled: documents with a term."""

    def __init__(self, shards: DataFrame, filled: int) -> None:
        self.shards, self.filled = shards, filled


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of docs, written to the shared folder.

    A null or empty text, or one without terms, is in no posting and doesn't count for N. A null doc_id
    is carried, repeated rows are documents of their own; no rows make an index without shards; other
    columns are ignored. A text over WINDOW bytes is cut into terms window by window.
    """
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = written(rows.mapInArrow(count_shards(shard_bytes), SHARD + ", docs binary"), "counted-shards")
    filled, terms = counted.agg(F.coalesce(F.sum("n_filled"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    ready = counted.select("shard", "words", "postings", "docs", F.lit(filled).cast("long").alias("all_filled"), F.lit(terms).cast("long").alias("all_terms"))
    return Index(written(ready.mapInArrow(order_shards, INDEX + ", docs binary"), "impact-shards"), filled)


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in slices_of(pc.fill_null(batch.column("text"), ""), WINDOW):
            words, number, text = terms_of(texts)
            code = np.unique(text << 32 | number)
            own = pa.array(begin + (code >> 32))
            yield pa.record_batch([batch.column("item").take(own), batch.column("item_id").take(own), words.take(pa.array(code & 0xFFFFFFFF))], ["item", "item_id", "term"])


def document_counts(blocks: list[tuple[str, int]]):
    """How many of each shard's documents have each term of those files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("words"):
                table = unpack_arrow(blob.as_py())
                for url, size in blocks:
                    wanted = unpack_arrow(Reader(url).read(0, size)).column("term").combine_chunks()
                    at = pc.index_in(wanted, value_set=table.column("term").combine_chunks())
                    there = at.is_valid()
                    yield pa.record_batch([wanted.filter(there), table.column("df").combine_chunks().take(at.filter(there))], ["term", "df"])

    return run


def write_block(folder: str):
    def run(table: pa.Table) -> pa.Table:
        out = Writer(folder, ".block")
        out.write(pack_arrow(table.drop_columns("block").combine_chunks()))
        out.close()
        return pa.table({"url": [out.url], "size": pa.array([out.position], pa.int64())})

    return run


class Block:
    """A block of items: their terms and weights, item by item."""

    def __init__(self, url: str, size: int) -> None:
        table = unpack_arrow(Reader(url).read(0, size)).sort_by([("item", "ascending"), ("term", "ascending")]).combine_chunks()
        item = table.column("item").to_numpy()
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        self.items, self.item_ids = item[begins], table.column("item_id").combine_chunks().take(pa.array(begins))
        self.bounds = np.append(begins, len(item))
        coded = table.column("term").combine_chunks().dictionary_encode()
        self.terms, self.number = coded.dictionary, coded.indices.to_numpy()
        self.weights = table.column("weight").to_numpy()


def best_of(scores: np.ndarray, docs: np.ndarray, shards: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((docs, shards, names, -scores))[:k]
    return scores[order], docs[order], shards[order], names[order]


class Shard:
    def __init__(self, number: int, words: bytes, postings: bytes, docs: bytes) -> None:
        table = unpack_arrow(words)
        self.number, self.words = number, table.column("term").combine_chunks()
        groups = unpack_arrow(postings)
        self.impact, self.begin, self.doc = (groups.column(c).combine_chunks().flatten().to_numpy() for c in ("impact", "begin", "doc"))
        self.first = np.append(table.column("first").to_numpy(), len(self.impact))
        names = unpack_arrow(docs).column("doc_id").combine_chunks()
        self.names = np.asarray(pc.fill_null(names, NULL), dtype=np.int64)

    def places(self, terms: pa.BinaryArray) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(terms, value_set=self.words), -1), dtype=np.int64)

    def postings_of(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, which of the groups) of those groups."""
        sizes = self.begin[groups + 1] - self.begin[groups]
        at = np.repeat(self.begin[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.doc[at], np.repeat(np.arange(len(groups)), sizes)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, their scores): all that are among the shard's k best with a score of floor or
        more, and maybe others of its documents. terms: places of an item's terms."""
        term = np.repeat(np.arange(len(terms)), self.first[terms + 1] - self.first[terms])
        groups = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms.tolist()])
        worth = self.impact[groups] * weights[term]
        order = np.argsort(-worth, kind="stable")  # of one term, groups are in this order already
        term, groups, worth = term[order], groups[order], worth[order]
        sizes = np.cumsum(self.begin[groups + 1] - self.begin[groups])
        score = np.zeros(len(self.names), np.int64)
        seen = np.zeros(len(self.names), bool)
        # what a term adds at most after each group: the worth of its next group
        after = np.zeros(len(groups), np.int64)
        last = np.argsort(term, kind="stable")
        same = term[last][1:] == term[last][:-1]
        after[last[:-1]] = np.where(same, worth[last][1:], 0)
        rest = np.array([self.impact[self.first[t]] for t in terms.tolist()], np.int64) * weights
        done, step = 0, FIRST_STEP
        while done < len(groups):
            end = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + step, "right")))
            docs, group = self.postings_of(groups[done:end])
            np.add.at(score, docs, worth[done:end][group])
            seen[docs] = True
            rest[term[done:end]] = after[done:end]  # the last of a term's groups stays
            done, step = end, 2 * step
            bound = int(rest.sum())
            there = np.flatnonzero(seen)
            reached = max(floor, int(np.partition(score[there], len(there) - k)[len(there) - k])) if len(there) >= k else floor
            if bound < reached:  # no document that has shown no term gets there
                able = there[score[there] + bound >= reached]
                if len(able) <= FEW and done < len(groups):
                    return able, score[able] + self.remaining(able, groups[done:], worth[done:])
        there = np.flatnonzero(seen)
        return there, score[there]

    def remaining(self, docs: np.ndarray, groups: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """What postings that weren't read add to the scores of docs, which ascend."""
        out, sizes = np.zeros(len(docs), np.int64), np.cumsum(self.begin[groups + 1] - self.begin[groups])
        at = 0
        while len(docs) and at < len(groups):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), "right")))
            found, group = self.postings_of(groups[at:end])
            spot = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            there = docs[spot] == found
            np.add.at(out, spot[there], worth[at:end][group[there]])
            at = end
        return out


def search_shards(blocks: list[tuple[str, int]], k: int):
    """The k best documents of a task's shards for each item of those files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        ids: dict[int, int | None] = {}
        only = Block(*blocks[0]) if len(blocks) == 1 else None

        def rows() -> Iterator[pa.RecordBatch]:
            for item, (scores, docs, shards, names) in kept.items():
                n = len(scores)
                yield pa.record_batch([pa.array([item] * n, pa.int64()), pa.array([ids[item]] * n, pa.int64()), pa.array(shards), pa.array(docs.astype(np.int64)), pa.array(names, mask=names == NULL), pa.array(scores)], ["item", "item_id", "shard", "place", "doc_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[row].as_py() for c in ("shard", "words", "postings", "docs")))
                for file in blocks:
                    block = only or Block(*file)
                    place = shard.places(block.terms)
                    for i, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
                        terms, weights = place[block.number[a:b]], block.weights[a:b]
                        there = (terms >= 0) & (weights > 0)
                        if not there.any():
                            continue
                        item = int(block.items[i])
                        before = kept.get(item)
                        floor = int(before[0][-1]) if before and len(before[0]) == k else 1
                        docs, scores = shard.best(terms[there], weights[there], k, floor)
                        docs, scores = docs[scores >= floor], scores[scores >= floor]
                        if len(docs):
                            found = scores, docs, np.full(len(docs), shard.number), shard.names[docs]
                            kept[item] = best_of(*(np.concatenate(x) for x in zip(before, found, strict=True)), k) if before else best_of(*found, k)
                            ids[item] = block.item_ids[i].as_py()
                    if len(kept) > CARRIED:
                        yield from rows()
                        kept, ids = {}, {}
                give_back()
        yield from rows()

    return run


def search(index: Index, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per row of items its k highest-scoring documents with a score above 0, fewer where there are
    fewer: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id (null first), repeated
    doc_ids in the index's order. A repeated row of items, with its ranks, comes as often as it does in
    items; null and empty texts have no rows. Other columns are ignored.
    """
    spark = items.sparkSession
    rows = text_column(items, text).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    numbered = written(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count("*")).first()[0]
    # an item is whole in one block, so the largest item bounds a block as well
    block = lambda by: F.pmod(F.xxhash64(by), F.lit(max(1, -(-total // block_bytes)))).cast("int")
    terms = written(numbered.mapInArrow(item_terms, "item long, item_id long, term binary").withColumn("block", block("item")), "item-terms")

    def blocks_of(frame: DataFrame) -> list[tuple[str, int]]:
        done = written(frame.groupBy("block").applyInArrow(write_block(new_path(spark, "search-blocks")), "url string, size long"), "search-block-files")
        return [tuple(x) for x in done.collect()]  # a row of a few bytes for each block_bytes of items

    wanted = blocks_of(terms.select("term").distinct().withColumn("block", block("term")))
    if not wanted:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = index.shards.select("words").mapInArrow(document_counts(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((2 * F.lit(index.filled) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = terms.join(df, "term").select("block", "item", "item_id", "term", weight.alias("weight"))
    blocks = blocks_of(weighed)
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = index.shards.mapInArrow(search_shards(blocks, k), "item long, item_id long, shard long, place long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id"), "shard", "place"]
    # many tasks' best of an item first meet in groups of some tasks
    part = F.pmod(F.xxhash64("shard"), F.lit(64))
    some = found.withColumn("part", part).withColumn("_r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
totals as (select count(*)::bigint as n_all, sum(len(w))::bigint as l_all from d where len(w) > 0),
postings as (select doc_id, n, t, count(*)::bigint as tf from (select doc_id, len(w)::bigint as n, unnest(w) as t from d) group by all),
wanted as (select distinct item_id, t from (select item_id, unnest(w) as t from b)),
weights as (select t, floor(1000 * ln((2 * any_value(n_all) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, totals where t in (select t from wanted) group by t),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all))))::bigint as score
  from wanted join weights using (t) join postings using (t), totals group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""
