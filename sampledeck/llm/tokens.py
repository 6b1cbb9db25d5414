"""Token ids of whole texts by the tokenizers library at its defaults, a batch at a time.

Encoding by the library takes about a second a megabyte; words repeat.  For the tokenizers in
WORDWISE a text can be encoded word by word: Arrow cuts the texts of a batch at their spaces and
numbers the distinct words, the library encodes those that the worker doesn't know yet, and the ids
are gathered by number.  A byte-level BPE with the usual splitting pattern joins no text across a
space but for the space itself, which goes to the word after it; where a word inside a text begins
or ends with other white space, or two spaces meet, the pattern looks further.  The lower-casing
word BPE drops white space, so its words are independent always.

To the library whole go texts whose words aren't independent, texts with a word of over LONG
characters (so words that are remembered are short), texts that hold the content of an added token,
which the library takes out before it looks at words, and all texts of any other tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a worker remembers; beyond, it keeps those of the latest batch.
KEPT_BYTES = 24 << 20
#: Characters of the longest word that is looked up.
LONG = 64
#: Words that the library encodes in one call.
CALL = 512
#: Normalizer and pre-tokenizer rules, as the files spell them, for which words are known
#: to be independent, and what stands before a word that isn't a text's first.
WORDWISE = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, " "),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "",
    ),
]


class Memo:
    """Words and their ids: word k has ids[starts[k] : starts[k] + sizes[k]]; bound[k] is 1 if it
    begins with white space, 2 if it ends so, 3 if both or empty. The empty word is always known; it
    has no ids where it counts, as a text's only word."""

    def __init__(self) -> None:
        self.words = pa.array([""])
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.bound = np.array([3], np.uint8)

    def places(self, words: pa.StringArray, learn) -> np.ndarray:
        """Where the distinct words stand; learn(words, bound, their bytes) gives the ids of each in a
        row, and the number of ids of each."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            missing = words.filter(pc.is_null(at))
            new, known = missing.to_pylist(), len(self.words)
            bound = white(pc.utf8_slice_codeunits(missing, 0, 1)) + 2 * white(pc.utf8_slice_codeunits(missing, -1))
            ids, sizes = learn(new, bound, np.asarray(pc.binary_length(missing), dtype=np.int64))
            self.words = pa.concat_arrays([self.words, missing])
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.bound = np.concatenate([self.bound, bound])
            unknown = np.asarray(pc.is_null(at))
            at = np.asarray(pc.fill_null(at, 0), dtype=np.int64)
            at[unknown] = np.arange(known, known + len(new))
        return np.asarray(at, dtype=np.int64)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def bounded(self, used: np.ndarray) -> None:
        """Forgets all words but those at the places used, if there are too many."""
        if self.words.nbytes + self.ids.nbytes > KEPT_BYTES:
            used = np.union1d(0, used)
            sizes = self.sizes[used]
            self.ids = self.ids[gathered(self.starts[used], sizes)]
            self.words, self.bound = self.words.take(pa.array(used)), self.bound[used]
            self.starts = np.append(0, np.cumsum(sizes))


def white(characters: pa.StringArray) -> np.ndarray:
    """1 for each that is white space, else 0; few are distinct."""
    numbered = characters.dictionary_encode()
    return np.array([c.isspace() for c in numbered.dictionary.to_pylist()], np.uint8)[numbered.indices.to_numpy()]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    begins = np.cumsum(sizes) - sizes
    total, end = int(sizes.sum()), int(starts.max(initial=0)) + int(sizes.max(initial=0))
    kind = np.int32 if max(total, end) < 1 << 31 else np.int64
    out = np.repeat((starts - begins).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self.load(json.load(file))

    def load(self, rules: dict) -> None:
        """rules: what a file of the library holds."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json.dumps(rules))
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        plain = rules["model"]["type"] == "BPE" and not rules["model"].get("dropout") and not rules["truncation"] and not rules["padding"]
        known = [before for normalizer, splitter, before in WORDWISE if plain and (normalizer, splitter) == (rules["normalizer"], rules["pre_tokenizer"])]
        if not rules["added_tokens"] or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in rules["added_tokens"]):
            known = []  # no mark between words, or tokens that are found by more than their content
        self.before = known[0] if known else None
        self.added = [x["content"] for x in rules["added_tokens"]]
        if known:
            self.mark = rules["added_tokens"][0]["id"]
            end = rules["model"].get("end_of_word_suffix") or ""
            self.bytes_of = np.zeros(self.vocabulary, np.int64)  # a byte is one character of a byte-level token
            for token, k in rules["model"]["vocab"].items():
                self.bytes_of[k] = len(token.removesuffix(end))
        self.first, self.inner = Memo(), Memo()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library: (ids of all texts, how many each has)."""
        found = [np.array(x.ids, np.uint32) for k in range(0, len(texts), CALL) for x in self.library.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), of short words that hold no added token: many in a text, each followed by the
        first added token, at which the library splits a text before all else, and whose id tells
        where words end."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), CALL):
            (found,) = self.library.encode_batch_fast([self.added[0].join([*words[k : k + CALL], ""])], add_special_tokens=False)
            own = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(own == self.mark)
            ids.append(np.delete(own, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def of_inner(self, words: list[str], bound: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of_words(), of words as they stand after a space. Those that are independent in a text of
        words go to the library as one; where each ends follows from the bytes that its ids stand
        for, which must end where words do. White space that is dropped has none."""
        if self.before:
            plain, seen = bound == 0, 1 + n_bytes
        else:
            plain, seen = np.fromiter(map(str.isascii, words), bool, len(words)), np.array([len(w) if b == 0 and w.isprintable() else len("".join(w.split())) for w, b in zip(words, bound.tolist(), strict=True)], np.int64)
        order = np.flatnonzero(plain)
        ids, sizes, done, left = [], [], [np.zeros(0, np.int64)], np.ones(len(words), bool)
        for k in range(0, len(order), CALL):
            part = order[k : k + CALL]
            (found,) = self.library.encode_batch_fast([self.before + " ".join([words[i] for i in part.tolist()])], add_special_tokens=False)
            own = np.array(found.ids, np.uint32)
            reached, wanted = np.cumsum(self.bytes_of[own]), np.cumsum(seen[part])
            ends = np.searchsorted(reached, wanted)
            if len(own) and ends[-1] == len(own) - 1 and (reached[ends] == wanted).all():
                ids.append(own)
                sizes.append(np.diff(ends, prepend=-1))
                done.append(part)
                left[part] = False
        rest = np.flatnonzero(left)
        own, own_sizes = self.of_words([self.before + words[i] for i in rest])
        ids, sizes = np.concatenate([*ids, own]), np.concatenate([*sizes, own_sizes])
        if not len(rest):  # they are in order
            return ids, sizes
        back = np.argsort(np.concatenate([*done, rest]))
        return ids[gathered((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after another; where each text begins and the last ends).
        A null is an empty text."""
        texts = pc.fill_null(texts, "")
        if self.before is None or not len(texts):
            ids, sizes = self.whole(texts.to_pylist())
            return ids, np.append(0, np.cumsum(sizes))
        # where white space is dropped, line feeds may be spaces, so more words are alike
        cut = pc.split_pattern(texts if self.before else pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        offsets -= offsets[0]
        words, number = numbered.dictionary, numbered.indices.to_numpy()
        alone = np.zeros(len(texts), bool)
        for content in self.added:
            alone |= np.asarray(pc.match_substring(texts, content))
        long = np.asarray(pc.greater(pc.utf8_length(words), LONG))
        if long.any():
            alone |= np.logical_or.reduceat(long[number], offsets[:-1])
        before = self.before
        whole = np.repeat(alone, np.diff(offsets))
        inner = np.ones(len(number), bool)
        if before:
            inner[offsets[:-1]] = False
        used = [np.flatnonzero(np.bincount(number[mask & ~whole], minlength=len(words))) for mask in (inner, ~inner)]
        at = np.zeros(len(number), np.int32)
        place = np.zeros(len(words), np.int32)
        place[used[0]] = self.inner.places(words.take(pa.array(used[0])), self.of_inner)
        at[inner] = place[number[inner]]
        if before:
            place[used[1]] = self.first.places(words.take(pa.array(used[1])), lambda new, *_: self.of_words(new))
            at[~inner] = place[number[~inner]]
        inner_ids = len(self.inner.ids)
        first, at_inner = offsets[:-1], np.where(inner, at, 0)
        starts, sizes = self.inner.starts[:-1][at_inner], self.inner.sizes[at_inner]
        if before:
            starts[first], sizes[first] = inner_ids + self.first.starts[:-1][at[first]], self.first.sizes[at[first]]
            bound = self.inner.bound[at_inner]
            bound[first] = self.first.bound[at[first]] & 2
            bound[offsets[1:] - 1] &= 1
            alone |= np.bitwise_or.reduceat(bound, offsets[:-1]) > 0
            whole = np.repeat(alone, np.diff(offsets))
        odd = np.flatnonzero(alone)
        odd_ids, odd_sizes = self.whole(texts.take(pa.array(odd)).to_pylist()) if len(odd) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        sizes[whole] = 0
        starts[offsets[odd]], sizes[offsets[odd]] = inner_ids + len(self.first.ids) + np.cumsum(odd_sizes) - odd_sizes, odd_sizes
        ids = np.concatenate([self.inner.ids, self.first.ids, odd_ids])[gathered(starts, sizes)]
        self.inner.bounded(at[inner & ~whole])
        if before:
            self.first.bounded(at[~inner & ~whole])
        return ids, np.append(0, np.cumsum(sizes))[offsets]

    def with_end(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), each text followed by end_id."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's own encoder for that tokenizer file, which must be there on every executor."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices_of(column: pa.StringArray, size: int = 5 << 20):
    """(first row, texts) of about `size` bytes of a column; a text counts for 64 more than it has."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 64
    ends, begin = np.cumsum(lengths), 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, column.slice(begin, end - begin)
        begin = end

