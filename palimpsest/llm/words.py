"""Words by number: the words of many texts are found and told apart by Arrow, and only distinct ones reach Python."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a task keeps. Words that become Python strings at a time: a call takes memory of its own for each.
MOST_WORDS, STRINGS = 600_000, 1 << 13


def distinct_words(texts: pa.Array, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts, in a row, and each text's count of words. Words lie between the six ASCII
    white-space characters; null texts have none. lower: A-Z become a-z first."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    del texts, lists
    parts = (coded.dictionary.slice(k, STRINGS) for k in range(0, len(coded.dictionary), STRINGS))
    found, numbers = [w for part in parts for w in part.to_numpy(zero_copy_only=False).tolist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in found:  # before a leading and after a trailing gap
        real = numbers != found.index("")
        counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(counts)])])
        numbers = numbers[real]
    return found, numbers, counts


class WordIds(dict):
    """Word -> number; ids of word k are flat[starts[k] : starts[k] + lens[k]].

    `encode` turns new words into their ids, in a row, and each word's count of ids. It's right wherever a tokenizer treats the words of a text independently of
    each other, and white space only parts them.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_WORDS):
        super().__init__()
        self.encode, self.most = encode, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts, self.lens, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, each given once; new ones are tokenized."""
        if len(self) > self.most:
            self.reset()
        found, first = np.fromiter(map(self.get, words, itertools.repeat(-1)), np.int64, len(words)), len(self)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = np.arange(first, first + len(fresh))
            new = [words[i] for i in fresh.tolist()]
            self.update(zip(new, range(first, first + len(new)), strict=True))
            got, lens = self.encode(new)
            total = len(got)
            if len(self) > len(self.starts):
                self.starts, self.lens = (np.concatenate([x, np.zeros(2 * len(self) - len(x), np.int64)]) for x in (self.starts, self.lens))
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(self.used + 2 * total, np.int32)])
            self.flat[self.used : self.used + total] = got
            self.lens[first : len(self)] = lens
            self.starts[first : len(self)] = self.used + np.cumsum(lens) - lens
            self.used += total
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, in a row, and each word's count of ids."""
        lens = self.lens[numbers]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - ends + lens, lens)
        at += np.arange(total)
        return self.flat[at], lens

    def of_texts(self, texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, in a row, and each text's count of ids."""
        words, numbers, counts = distinct_words(texts, lower)
        flat, lens = self.ids(self.numbers(words)[numbers])
        return flat, np.diff(np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])])
