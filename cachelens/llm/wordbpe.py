"""ids of texts by a word BPE with end-of-word symbols, as the `tokenizers` library gives them.

A batch of texts is cut at spaces, equal pieces are encoded once, and ids go back to the
texts by their places: Python sees no single word. Pieces become words by the
vocabulary's own pattern; the distinct words are merged together, one merge for each word and
round, the lowest rank first and the leftmost of equals. Nothing is kept from batch to
batch, so memory is bounded by the batch.

The library itself encodes what this does not cover: texts with characters beyond SAFE
(for which its normaliser does more than lower()), words of more than LONG bytes, and
every text if the file's normaliser or pattern is another.

Defined results: a null or empty text has no ids; equal texts have equal ids; a text of any
length is one entry; an empty batch gives no ids.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which the normaliser is lower() and the pattern's classes are those of RE2; its only spaces are those that cut here.
SAFE = r"\t\n\r -~\x{a1}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17f}\x{2010}-\x{2027}\x{2030}-\x{2038}"
LONG = 64
END = "</w>"
_NONE = np.iinfo(np.int64).max
#: The normaliser and the pattern that this module follows, as the vocabulary file states them.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of every i, lens[i] of them, end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def _byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary uses for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _cut(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of an array of strings."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _class_of_ascii() -> np.ndarray:
    """1 letter, 2 digit, 3 any other."""
    out = np.full(128, 3, np.uint8)
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[48:58] = 2
    return out


_CLASSES = _class_of_ascii()


def words_of(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of pieces without spaces, end to end, and how many each piece has."""
    letters = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False)
    plain = ~letters & pc.and_not(pc.string_is_ascii(pieces), pc.match_substring(pieces, "'")).to_numpy(zero_copy_only=False)
    counts = letters.astype(np.int64)
    parts = [pieces.filter(pa.array(letters))]
    rows = [np.flatnonzero(letters)]
    if plain.any():  # runs of a class, and single digits
        data, starts, lens = _cut(pieces.filter(pa.array(plain)))
        data = data[ragged(starts, lens)]
        kind, new = _CLASSES[data], np.zeros(len(data) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[np.cumsum(lens) - lens] = True  # an empty piece marks the start of the next one
        begin = np.flatnonzero(new[:-1])
        counts[plain] = np.diff(np.searchsorted(begin, np.append(0, np.cumsum(lens))))
        parts.append(pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pieces.type))
        rows.append(np.repeat(np.flatnonzero(plain), counts[plain]))
    rest = np.flatnonzero(~letters & ~plain)
    if len(rest):
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pieces.take(pa.array(rest)), f"({_PATTERN})", r"\1 "))
        flat = split.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        of = np.repeat(rest, pc.list_value_length(split).to_numpy())[full]
        counts[rest] = np.bincount(of, minlength=len(pieces))[rest]
        parts.append(flat.filter(pa.array(full)))
        rows.append(of)
    order = np.argsort(np.concatenate(rows), kind="stable")
    return pa.concat_arrays(parts).take(pa.array(order)), counts


class Merger:
    """Merges of a BPE vocabulary over many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list):
        symbols = _byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + END] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.pairs = pd.Index(np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get_indexer(a * self.size + b).astype(np.int64)
        r[r < 0] = _NONE >> 32
        return r

    def ids(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids end to end and their counts, of words (none of them empty) given by their bytes."""
        n = len(lens)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = ragged(starts, lens)
        word, at = np.repeat(np.arange(n), lens), data[where]
        ends = np.cumsum(lens) - 1
        ids = self.first[at]
        ids[ends] = self.last[at[ends]]
        rank = np.empty(len(ids), np.int64)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[ends] = _NONE >> 32  # a word's last symbol has no pair
        done_ids, done_word = [], []
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # rank and place in one number: the leftmost of the lowest
            best = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), begin)
            more = (best >> 32) < _NONE >> 32
            still = np.repeat(more, np.diff(np.append(begin, len(ids))))
            if not more.all():
                done_ids.append(ids[~still])
                done_word.append(word[~still])
            place = best[more] & 0xFFFFFFFF
            ids[place] = self.made[rank[place]]
            still[place + 1] = False
            rank[place] = rank[place + 1]  # _NONE where the pair was a word's end
            new = np.cumsum(still)[place] - 1
            ids, word, rank = ids[still], word[still], rank[still]
            right = new[rank[new] < _NONE >> 32] if len(new) else new
            # the pairs on both sides of a merge are new ones
            right = new[np.append(word[1:] == word[:-1], False)[new]] if len(new) else right
            rank[right] = self.ranks(ids[right], ids[right + 1])
            left = new[(new > 0) & (word[new - 1] == word[new])] - 1 if len(new) else new
            rank[left] = self.ranks(ids[left], ids[left + 1])
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)


class WordTokenizer:
    """ids of whole batches of texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.dtype = np.dtype("<u4" if self.lib.get_vocab_size() > 65_536 else "<u2")
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        known = [x["type"] for x in (plain["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS
        splits = (plain["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = known and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": _PATTERN}
        model = plain["model"]
        known = known and model["type"] == "BPE" and model["end_of_word_suffix"] == END
        self.merger = Merger(model["vocab"], model["merges"]) if known else None

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.lib.encode(t, add_special_tokens=False).ids for t in texts]
        return np.array([i for ids in got for i in ids], np.int64), np.array([len(ids) for ids in got], np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of distinct words; an empty one has none."""
        data, starts, lens = _cut(words)
        usual, long = np.flatnonzero((lens > 0) & (lens <= LONG)), np.flatnonzero(lens > LONG)
        ids, counts = self.merger.ids(data, starts[usual], lens[usual])
        if not len(long):
            out = np.zeros(len(lens), np.int64)
            out[usual] = counts
            return ids, out
        more, n_more = self._by_library(words.take(pa.array(long)).to_pylist())
        return _interleaved([(usual, ids, counts), (long, more, n_more)], len(lens))

    def _batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = pieces.flatten().dictionary_encode()
        flat, per_piece = words_of(coded.dictionary)
        words = flat.dictionary_encode()
        ids, counts = self._words(words.dictionary)
        ids = ids.astype(self.dtype)
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        for codes, ends in ((words.indices, np.concatenate([[0], np.cumsum(per_piece)])), (coded.indices, bounds - bounds[0])):  # words to pieces, pieces to texts
            codes = codes.to_numpy()
            lens = counts[codes]
            ids = ids[ragged((np.cumsum(counts) - counts)[codes], lens)]
            total = np.concatenate([[0], np.cumsum(lens)])
            counts = np.diff(total[ends])
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts end to end, and how many each has."""
        texts = texts.fill_null("")
        if self.merger is None:
            return self._by_library(texts.to_pylist())
        other = pc.match_substring_regex(texts, f"[^{SAFE}]").to_numpy(zero_copy_only=False)
        if not other.any():
            return self._batch(texts)
        rest, whole = np.flatnonzero(~other), np.flatnonzero(other)
        parts = [(whole, *self._by_library(texts.take(pa.array(whole)).to_pylist()))]
        if len(rest):
            parts.append((rest, *self._batch(texts.take(pa.array(rest)))))
        return _interleaved(parts, len(texts))


def _interleaved(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of n entries, from (entries, ids, counts) of each part."""
    counts = np.zeros(n, np.int64)
    for rows, _, c in parts:
        counts[rows] = c
    starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
    for rows, ids, c in parts:
        out[ragged(starts[rows], c)] = ids
    return out, counts


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
