"""Ids of documents from the ids of their words, each different word worked out once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

KNOWN_WORDS = 600_000


class WordTable:
    """Word to ids, kept from batch to batch; of bounded size, begun anew when full.

    ``solve`` gives the ids of new words; ``end`` are the ids after each document.
    """

    def __init__(self, solve: Callable[[list], Iterable[list[int]]], end: list[int], known_words: int = KNOWN_WORDS):
        self.solve, self.end, self.known_words = solve, end, known_words
        self.reset()

    def reset(self) -> None:
        self.code: dict = {None: 0}  # the end of a document
        self.start, self.size = np.zeros(1, np.int64), np.array([len(self.end)])
        self.ids = np.array(self.end, np.uint32)

    def learn(self, words: list) -> None:
        found = list(self.solve(words))
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.array(list(chain.from_iterable(found)), np.uint32)))
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words)), strict=True))

    def encode(self, documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each with its end; ids per document) from lists of words."""
        words = set().union(*documents)
        unknown = list(words.difference(self.code))
        if len(self.code) + len(unknown) > self.known_words:
            self.reset()
            unknown = list(words)
        if unknown:
            self.learn(unknown)
        for words in documents:
            words.append(None)
        counts = np.fromiter(map(len, documents), np.int64, len(documents))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(documents)), np.int64, int(counts.sum()))
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[np.cumsum(counts) - 1], prepend=0)
