"""Quality by nearest-neighbour voting among labelled latent-semantic vectors (operator 7).

A text's terms, of all of it: its bytes three by three and its lower-cased words, both hashed, and for
each word how long ago the text had it last (in powers of two; so repetition is a term like others).
Weights are square roots of a term's share of its kind, times its global weight, the log-entropy form
of inverse document frequency.  The weights of a bounded sample of labelled texts give a truncated singular value decomposition; its
vectors and labels, a few megabytes whatever the corpus, are broadcast.  Every document's vector is
compared exactly with all of them, in blocks; the NEIGHBOURS nearest vote, with their cosines as
weights.  Cosines are rounded to 1e-10, so scores don't depend on the batch that a text comes in, and
of equal ones the labelled text with the smaller doc_id is nearer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, text_column, written
from .tokens import slices_of

#: Labelled texts of each label that are learned from, at most (those with the least hashed ids).
LABELLED = 1500
DIMENSIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Hashed terms of bytes and of words, and classes of distance to a word's last place.
BYTE_TERMS, WORD_TERMS, DISTANCES = 1 << 13, 1 << 12, 16
TERMS = BYTE_TERMS + WORD_TERMS + DISTANCES
#: Bytes of a long text that are looked at at once.
WINDOW = 1 << 20
#: Texts whose weights stand in memory at once, in full.
BLOCK = 128
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\t-\r ]")


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """The numbers hashed to so many bits."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(_ODD[2])
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def shares(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row * TERMS + term, its share among the row's) of a list of terms, in order."""
    keys = np.sort(rows * TERMS + terms)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, counts = keys[first], np.diff(np.append(first, len(keys)))
    total = np.bincount(rows)
    return keys, counts / total[keys // TERMS]


def word_hashes(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words of data, in order; the row of each). row: of each byte."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(begins) - 1  # of bytes that aren't space
    place = np.arange(len(data)) - start[np.maximum(word, 0)]
    letters = np.where(space, np.uint64(0), _LOWER[data] + np.uint64(1))
    powers = np.cumprod(np.full(int(np.diff(np.append(start, len(data))).max()), _ODD[1], np.uint64))
    letters[start[0] :] *= powers[place[start[0] :]]
    return np.add.reduceat(letters, start), row[start]


def three_bytes(data: np.ndarray) -> np.ndarray:
    """A term for each place at which three bytes begin."""
    wide = data.astype(np.uint64)
    return mixed((wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) * np.uint64(_ODD[0]), BYTE_TERMS.bit_length() - 1)


def word_kinds(hashed: np.ndarray, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shares of the words' terms and of the distances to their last places."""
    order = np.lexsort((hashed, of)) if len(of) and of[-1] else np.argsort(hashed, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = (hashed[order][1:] == hashed[order][:-1]) & (of[order][1:] == of[order][:-1])
    distance = np.zeros(len(order), np.int64)
    distance[again] = np.minimum(np.frexp(np.diff(order, prepend=0)[again])[1], DISTANCES - 1)
    rows = of[order]
    del order, again
    return [shares(of, BYTE_TERMS + mixed(hashed, WORD_TERMS.bit_length() - 1)), shares(rows, BYTE_TERMS + WORD_TERMS + distance)]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight before the global one) of all terms of all texts, in order of row and term. A
    text over WINDOW bytes alone is looked at window by window."""
    if len(texts) == 1 and len(texts[0]) > WINDOW:
        kinds = long_kinds(texts[0])
    else:
        data = np.frombuffer(b"".join(texts), np.uint8)
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        inside = row[:-2] == row[2:]
        kinds = [shares(row[:-2][inside], three_bytes(data)[inside])]
        hashed, of = word_hashes(data, row)
        if len(hashed):
            kinds += word_kinds(hashed, of)
    keys, weights = (np.concatenate([k[i] for k in kinds]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    return keys[order] // TERMS, keys[order] % TERMS, np.sqrt(weights[order])


def long_kinds(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """What features() gathers, of one text: byte terms are counted window by window, and of its words
    eight bytes each are kept. Windows end before white space; a word is in one window, however long."""
    data, counts, hashed, at = np.frombuffer(text, np.uint8), np.zeros(BYTE_TERMS, np.int64), [], 0
    while at < len(data):
        end = len(data)
        if end - at > WINDOW:
            gap = _GAP.search(text, at + WINDOW)
            end = gap.start() if gap else end
        counts += np.bincount(three_bytes(data[at : end + 2]), minlength=BYTE_TERMS)
        hashed.append(word_hashes(data[at:end], np.zeros(end - at, np.int8))[0])
        at = end
    words = np.concatenate(hashed)
    there = np.flatnonzero(counts)
    kinds = [(there, counts[there] / counts.sum())]
    if len(words):
        order = np.argsort(words, kind="stable")
        again = np.append(False, words[order[1:]] == words[order[:-1]])
        distance = np.zeros(len(order), np.int64)
        distance[again] = np.minimum(np.frexp(np.diff(order, prepend=0)[again])[1], DISTANCES - 1)
        del order, again
        for first, terms, n in ((BYTE_TERMS, mixed(words, WORD_TERMS.bit_length() - 1), WORD_TERMS), (BYTE_TERMS + WORD_TERMS, distance, DISTANCES)):
            counts = np.bincount(terms, minlength=n)
            there = np.flatnonzero(counts)
            kinds.append((first + there, counts[there] / counts.sum()))
    return kinds


def as_bytes(texts: pa.StringArray) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of labelled texts."""
    for batch in batches:
        for begin, texts in slices_of(batch.column("text"), 1 << 19):
            row, term, weight = features(as_bytes(texts))
            ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.record_batch([batch.column("doc_id").slice(begin, len(texts)), batch.column("label").slice(begin, len(texts)), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight.astype(np.float32)))], ["doc_id", "label", "terms", "weights"])


class Weights:
    """Texts' weights without the zeros: text k has weights[ends[k] : ends[k + 1]] at terms[...]."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.ends, self.terms, self.weights = ends, terms, weights.astype(np.float64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def blocks(self, by_term: np.ndarray) -> Iterator[np.ndarray]:
        """The rows in full, times a factor for each term, BLOCK at a time."""
        for k in range(0, len(self), BLOCK):
            ends = self.ends[k : k + BLOCK + 1]
            x, part = np.zeros((len(ends) - 1, TERMS)), slice(ends[0], ends[-1])
            x[np.repeat(np.arange(len(x)), np.diff(ends)), self.terms[part]] = self.weights[part] * by_term[self.terms[part]]
            yield x

    def specificity(self) -> np.ndarray:
        """Each term's global weight: 1 less the entropy of its spread over the texts, as a part of
        the most there can be. A term of one text weighs 1, one that all texts have alike 0."""
        p = self.weights**2
        total, spread = (np.bincount(self.terms, x, TERMS) for x in (p, p * np.log(np.maximum(p, 1e-300))))
        some = total > 0
        out = np.ones(TERMS)
        out[some] += (spread[some] / total[some] - np.log(total[some])) / np.log(max(2, len(self)))
        return np.maximum(out, 0)


class Model:
    """axes (terms x dimensions, times terms' global weights), vectors (unit), labels, prior."""

    def __init__(self, x: Weights, labels: np.ndarray, dimensions: int, prior: float) -> None:
        """From the weights of labelled texts in order of doc_id; rows are in full BLOCK at a time."""
        self.prior, self.labels = prior, labels.astype(np.float64)
        glob = x.specificity()
        base = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, min(dimensions + 16, max(1, len(x))))))[0]
        for _ in range(4):
            base = np.linalg.qr(sum((rows.T @ (rows @ base) for rows in x.blocks(glob)), np.zeros_like(base)))[0]
        seen = np.concatenate([np.zeros((0, base.shape[1])), *(rows @ base for rows in x.blocks(glob))])
        axes = base @ np.linalg.svd(seen, full_matrices=False)[2][:dimensions].T if len(x) else base
        self.vectors = np.concatenate([np.zeros((0, axes.shape[1])), *(self.unit(rows @ axes)[0] for rows in x.blocks(glob))])
        self.axes = axes * glob[:, None]

    @staticmethod
    def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors, whether there is one)"""
        norms = np.linalg.norm(v, axis=1)
        return v / np.maximum(norms, 1e-12)[:, None], norms > 1e-12

    def project(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        row, term, weight = features(texts)
        x = np.zeros((len(texts), TERMS))
        x[row, term] = weight
        return self.unit(x @ self.axes)

    def scores(self, texts: list[bytes], neighbours: int) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        k, n = min(neighbours, len(self.labels)), len(self.labels)
        for begin in range(0, len(texts) if k else 0, BLOCK):
            v, some = self.project(texts[begin : begin + BLOCK])
            near = np.rint(np.maximum(v @ self.vectors.T, 0) * 1e10).astype(np.int64)
            ranked = near << 20 | (n - 1 - np.arange(n))  # all different: of equal ones the first is larger
            top = np.argpartition(ranked, n - k, axis=1)[:, -k:]
            top.sort(axis=1)
            votes = np.take_along_axis(near, top, 1)
            total = votes.sum(1)
            some &= total > 0
            out[begin : begin + BLOCK][some] = ((votes * self.labels[top]).sum(1)[some] / total[some])
        return out


def learn(docs: DataFrame, known: DataFrame, per_label: int = LABELLED, dimensions: int = DIMENSIONS) -> Model:
    """A model from docs (doc_id, text) with known (doc_id once, label 0 or 1): at most per_label
    documents of each label, and the share of label 1 among all. Ids alone are joined and picked;
    the few that are picked, a bounded table, then filter the texts where they are read."""
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    prior = there.agg(F.avg("label")).first()[0]
    picked = [there.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    texts = docs.join(F.broadcast(written(picked[0].union(picked[1]), "labelled")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(feature_rows, "doc_id long, label int, terms array<int>, weights array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if len(rows) >= 1 << 20:
        raise ValueError("at most a million labelled texts are compared")
    if not len(rows):
        return Model(Weights(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.zeros(0), dimensions, 0.5)
    terms, weights = rows.column("terms").chunk(0), rows.column("weights").chunk(0)
    x = Weights(np.asarray(terms.offsets, dtype=np.int64), np.asarray(terms.values), np.asarray(weights.values))
    return Model(x, np.asarray(rows.column("label")), dimensions, 0.5 if prior is None else float(prior))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: str, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if
    score >= threshold, else 0), learned from labels (doc_id, quality) of docs that aren't held out.

    The score is the similarity-weighted share of label 1 among the nearest. A text that shares no
    term with the labelled ones (an empty or null one, say) scores
    the share of label 1 among all that is learned from (0.5 without any); so do all texts without
    labels.
    Repeated rows each get a row; of the texts of one doc_id the least is learned from; a null
    doc_id isn't. Null or other labels than 0 and 1 are left out; of several labels of a doc_id the
    least counts. Columns of docs named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = text_column(docs).drop("held_out", "score", "predicted").withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    learned = docs.filter(~F.col("held_out")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(learn(learned, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            for begin, texts in slices_of(batch.column(at), 1 << 19):
                found = model.value.scores(as_bytes(texts), neighbours)
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(texts)).columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])
            give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(score, schema)


HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), HELD_OUT).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return quality_scores(docs, labels, HELD_OUT).filter("predicted = 1").select(*docs.columns)
