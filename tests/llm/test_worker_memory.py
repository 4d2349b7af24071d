"""What a Python worker holds: it lives on from stage to stage, so each stage must leave it small."""

import tracemalloc
import weakref

import numpy as np
import public_tokenizers

from visilake.llm import base, contamination, language, lattice, simhash


def most_held(work) -> int:
    """The most bytes that ``work`` holds beyond what was there before."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        work()
        return tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


def test_a_worker_keeps_the_tables_of_one_operator():
    model, items = public_tokenizers.path("piece_bpe_32k.model"), [(1, "some words of a benchmark passage")]
    words = weakref.ref(lattice._model(model)[1])
    assert lattice._model(model)[1] is words()  # kept from task to task
    index = weakref.ref(contamination._items(1, items, 0.1))
    assert words() is None
    assert contamination._items(1, items, 0.1) is index()
    base.worker_tables()
    assert index() is None


def test_no_fold_table_is_built_of_a_million_strings(monkeypatch):
    monkeypatch.setattr(contamination, "_folds", [])
    assert most_held(contamination._fold) < 20e6
    low, blank = contamination._fold()
    assert [chr(low[ord(c)]) for c in "AÉßİΣ1"] == list("aéßİσ1")
    assert blank[0x20] and blank[0x3000] and not blank[0x41]


def test_languages_of_many_texts_take_a_small_slice_at_a_time():
    texts = ["The quick brown fox jumps over the lazy dog. " * 20] * 2000
    language._is_letter()
    assert most_held(lambda: [language._ranked(part, 300) for _, _, part in language._slices(texts)]) < 60e6


def test_pairs_of_a_group_of_near_copies_come_a_few_at_a_time():
    points, home = np.full(4096, 7, np.uint64), np.ones(4096, bool)
    more = np.zeros((4096, 3), np.uint64)

    def walk():
        assert sum(len(a) for a, _ in simhash._pairs(points, more, home, 24, 72)) == 4096**2

    assert most_held(walk) < 40e6
