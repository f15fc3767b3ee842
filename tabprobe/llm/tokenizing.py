"""Whole-text token ids by a ``tokenizers`` file, word by word.

The byte-level pre-tokeniser never joins what stands before a single space to what follows it, so that a text can
be cut before each space whose neighbours are no white space. Each distinct word of a batch is then encoded
once, and a bounded number of words is remembered as Arrow and numpy arrays. New words are encoded many at a time,
with a space before each; the ids are dealt to the words by the bytes they stand for. Texts with other runs of
white space, or with the string of a special token, are encoded whole: all ids are those of the plain call with
``add_special_tokens=False``.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN_SPACE = f"{_SPACE} | {_SPACE}"
EDGE_SPACE = f"^{_SPACE}|{_SPACE}$|^$"
KEPT_WORDS = 300_000
JOINED = 500  # new words encoded together


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of all ranges, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Encodes batches of texts; remembers a bounded number of words, the ones of the last batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([UNEVEN_SPACE, *map(re.escape, special)])
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a letter for each byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.words = pa.array([], pa.large_string())
        self.ids, self.at = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(found)), "<u4"), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, each with a space before it."""
        edge = pc.match_substring_regex(words, EDGE_SPACE).to_numpy(zero_copy_only=False)
        plain, odd = np.flatnonzero(~edge), np.flatnonzero(edge)
        texts = words.take(pa.array(plain)).to_pylist()
        ids, count = self.encode_each([" " + " ".join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)])
        ends = np.cumsum(pc.binary_length(words.take(pa.array(plain))).to_numpy().astype(np.int64) + 1)
        spelt = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(spelt, ends) + 1
        if len(ends) and (spelt[-1] != ends[-1] or (spelt[cut - 1] != ends).any()):  # not a byte-level vocabulary
            ids, sizes = self.encode_each([" " + t for t in texts])
        else:
            sizes = np.diff(np.concatenate([[0], cut]))
        odd_ids, odd_sizes = self.encode_each([" " + w for w in words.take(pa.array(odd)).to_pylist()])
        at = np.concatenate([[0], np.cumsum(np.concatenate([sizes, odd_sizes]))])
        back = np.empty(len(words), np.int64)
        back[np.concatenate([plain, odd])] = np.arange(len(words))
        size = np.diff(at)[back]
        return np.concatenate([ids, odd_ids])[_ranges(at[back], size)], size

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of distinct words, from memory or new ones."""
        place = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        old = len(self.words)
        more = words.take(pa.array(new))
        ids, size = self._encode_words(more)
        place[new] = old + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, more])
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        size = (self.at[1:] - self.at[:-1])[place]
        found = self.ids[_ranges(self.at[place], size)]
        if len(self.words) > KEPT_WORDS:  # go on with the words of this batch
            keep = min(len(words), KEPT_WORDS)
            self.at = np.concatenate([[0], np.cumsum(size[:keep])])
            self.words, self.ids = pa.concat_arrays([words.slice(0, keep)]), found[:self.at[-1]].copy()
        return found, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has the ids ``ids[offsets[i]:offsets[i + 1]]``, as little-endian unsigned 32 bits."""
        apart = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(apart), pa.scalar("", texts.type), texts), " ")
        apart = np.flatnonzero(apart)
        encoded = lists.flatten().dictionary_encode()
        codes, count = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
        starts = np.asarray(lists.offsets).astype(np.int64)
        starts -= starts[0]
        codes[starts[:-1]] += count  # a text's first word has no space before it
        used, codes = np.unique(codes, return_inverse=True)
        spaced = int(np.searchsorted(used, count))
        words = self._known(encoded.dictionary.take(pa.array(used[:spaced])).cast(pa.large_string()))
        first = self.encode_each(encoded.dictionary.take(pa.array(used[spaced:] - count)).to_pylist())
        # whole texts stand behind the words and in place of their (empty) first word
        whole = self.encode_each(texts.take(pa.array(apart)).to_pylist())
        codes[starts[apart]] = len(used) + np.arange(len(apart))
        flat, sizes = (np.concatenate(x) for x in zip(words, first, whole))
        at = np.concatenate([[0], np.cumsum(sizes)])
        each = sizes[codes]
        return flat[_ranges(at[codes], each)], np.concatenate([[0], np.cumsum(each)])[starts]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file."""
    return WordEncoder(path)
