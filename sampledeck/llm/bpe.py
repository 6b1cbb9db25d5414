"""Byte-level BPE by a file of ranks, and back (operator 13).

A file of ranks names each token's bytes and its rank.  The tokenizers library spells a byte as a
character: printable ones of Latin-1 as themselves, the 68 others as the characters from 256 on.  So
ranks become a model of that library: a token is the characters of its bytes, and every way to cut
it in two tokens is a merge, in order of rank.  Texts are encoded a slice of a batch at a time; long
ones in windows that end before white space, where no match of the pattern goes on.  Decoding looks
ids up in a table of the tokens' bytes, which reverses the spelling, and gathers them with numpy.

A token may end inside a character.  Whole documents don't notice; parts of them do: a part's text
has the characters that begin in it, and a token that begins inside a character counts as standing
at that character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, text_column
from .tokens import WORDWISE, Encoder, gathered, slices_of

#: Bytes of a text that are encoded at once, about; a run without white space may be longer.
WINDOW = 4 << 20
#: Fixed value: the splitting pattern for which the library has a rule of its own.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED = "n_tokens long, ids binary, char_starts binary"
PART = "part long, start long, text string"
#: A line feed or space after what is neither, for windows.
_GAP = re.compile(rb"(?<=[\x21-\x7e])[\n ]")


def byte_characters() -> list[str]:
    """The character that spells each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def rules_of_ranks(path: str, pattern: str) -> dict:
    """What a file of the tokenizers library would hold for those ranks: BPE, each match of the pattern
    on its own. One special token more than there are ranks marks words in Encoder; texts never become it."""
    with open(path, "rb") as file:
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    spell = byte_characters()
    spelled = {token: "".join(map(spell.__getitem__, token)) for token in tokens}
    merges = [[spelled[t[:k]], spelled[t[k:]]] for t in sorted(tokens, key=tokens.get) for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
    whole = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    split = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, whole]}
    mark = {"id": max(tokens.values()) + 1, "content": "<|endofword|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    return {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [mark], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": WORDWISE[0][1] if pattern == USUAL else split,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {spelled[t]: k for t, k in tokens.items()}, "merges": merges},
    }


class RankEncoder(Encoder):
    """Ids of ordinary text, and the bytes of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        rules = rules_of_ranks(path, pattern)
        self.load(rules)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        size = rules["added_tokens"][0]["id"]
        spelled: list[str | None] = [None] * size
        for token, k in rules["model"]["vocab"].items():
            spelled[k] = token
        self.sizes = np.fromiter((len(t or "") for t in spelled), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(bytes(byte_of[c] for t in spelled for c in t or ""), np.uint8)
        self.known = np.fromiter((t is not None for t in spelled), bool, size)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.library.encode_special_tokens = True
        try:
            return super().whole(texts)
        finally:
            self.library.encode_special_tokens = False

    def encode_text(self, text: pa.StringScalar) -> np.ndarray:
        """A long text's ids, window by window."""
        data, at, out = memoryview(text.as_buffer()), 0, []
        while at < len(data):
            end = len(data)
            if end - at > WINDOW:
                gap = _GAP.search(data, at + WINDOW)
                end = gap.start() if gap else end
            out.append(self.encode(pa.array([str(data[at:end], "utf-8")]))[0])
            at = end
        return np.concatenate(out)

    def bytes_of_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes that ids stand for, how many each stands for)."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the ranks don't have")
        sizes = self.sizes[ids]
        return self.table[gathered(self.starts[ids], sizes)], sizes


_encoders: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """A worker's own encoder for those ranks; the file must be there on every executor."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    return _encoders[path, pattern]


def characters_before(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The character at which each token begins, of tokens of so many bytes each of data; a token that
    begins inside a character counts as beginning with it."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    leads = (data & 0xC0) != 0x80
    return np.cumsum(leads)[np.cumsum(sizes) - sizes] - 1


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode_batches(path: str, pattern: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for begin, texts in slices_of(column):
                coder = rank_encoder(path, pattern)
                if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > WINDOW:
                    ids = coder.encode_text(texts[0])
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = coder.encode(texts)
                ids = ids.astype("<u4")
                places = pa.nulls(len(texts), pa.binary())
                if offsets:
                    data, sizes = coder.bytes_of_ids(ids)
                    # a text begins with a character, so the first token of each tells what came before
                    first = characters_before(data, sizes)
                    counts = np.diff(bounds)
                    first -= np.repeat(first[np.minimum(bounds[:-1], max(len(first) - 1, 0))] if len(first) else first, counts)
                    places = binaries(first.astype("<i4"), bounds)
                own = [batch.column(k).slice(begin, len(texts)) for k in range(batch.num_columns - 1)]
                yield pa.record_batch([*own, pa.array(np.diff(bounds)), binaries(ids, bounds), places], [*batch.schema.names[:-1], "n_tokens", "ids", "char_starts"])
                give_back()

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers one after another)
    by the ranks in the file at path, each match of the pattern on its own; nothing in a text is a
    special token. With offsets also char_starts (little-endian 32-bit numbers): the character of the
    text at which each token begins, or inside which it does; null without.

    A null text counts as empty and has no ids. Repeated rows come as often as they do in docs, a null
    doc_id is carried; no rows give none; other columns are ignored. A text over WINDOW bytes is encoded
    in windows that end before a space or line feed, so besides its ids it needs memory for one window;
    a run without either is one window, as its ids depend on all of it.
    """
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode_batches(path, pattern, offsets), "doc_id long, " + ENCODED)


def runs_of(column: pa.BinaryArray, size: int = 4 << 20):
    """(first row, rows, their ids in one array, where each row's begin and the last's end)."""
    for begin, part in slices_of(column, size):
        bounds = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(part), 0), dtype=np.int64))) // 4
        raw = b"".join(x.as_buffer() for x in part if x.is_valid)
        yield begin, len(part), np.frombuffer(raw, "<u4"), bounds


def decode_batches(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            for begin, n, ids, bounds in runs_of(batch.column(k)):
                data, sizes = rank_encoder(path, pattern).bytes_of_ids(ids)
                own = batch.slice(begin, n)
                yield pa.record_batch([*own.columns, binaries(data, np.append(0, np.cumsum(sizes))[bounds])], [*batch.schema.names, "decoded"])
                give_back()

    return run


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with a column decoded: the bytes that its column ids stands for, none for null ids. An id
    that the ranks don't have is an error."""
    kept = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    return kept.mapInArrow(decode_batches(path, pattern), T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def part_batches(path: str, pattern: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_buffer() if batch.column(1)[row].is_valid else b""
                ids = np.frombuffer(raw, "<u4")
                starts = np.arange(0, max(1, len(ids)), size)
                texts = []
                for a in starts.tolist():
                    own, _ = rank_encoder(path, pattern).bytes_of_ids(ids[a : a + size])
                    after, _ = rank_encoder(path, pattern).bytes_of_ids(ids[a + size : a + size + 3])  # a character's other bytes, three at most
                    skip = int(np.argmax(np.append((own & 0xC0) != 0x80, True))) if a else 0
                    more = int(np.argmax(np.append((after & 0xC0) != 0x80, True))) if skip < len(own) else 0
                    texts.append(bytes(np.concatenate([own[skip:], after[:more]])).decode("utf-8", "replace"))
                yield pa.record_batch([batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(starts), np.int64))), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(texts, pa.string())], ["doc_id", "part", "start", "text"])

    return run


def decode_parts(encoded: DataFrame, path: str, pattern: str, part_ids: int) -> DataFrame:
    """Texts of parts of at most part_ids ids each: doc_id, part (from 0), start (ids before it), text.
    A part's text has the characters that begin in it, with those of their bytes that later ids hold,
    so parts in order make the document, wherever ids split characters. Bytes that are no UTF-8
    become U+FFFD. A row without ids is one empty part."""
    return encoded.select("doc_id", "ids").mapInArrow(part_batches(path, pattern, part_ids), "doc_id long, " + PART)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern).drop("char_starts")
    decoded = decode_documents(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
