"""Spelling variants against brute force."""

import collections
import re
import zlib

import pytest

from visilake.llm import spelling

SCHEMA = "doc_id long, text string"
STEMS = "colour centre theatre language running garden window market silver Müller straße naïve".split()


def variants(word):
    return [word, word[:2] + word[3:], word[:1] + "x" + word[2:], word + "s", word[:3] + word[3] + word[3:], word[::-1], word[1] + word[0] + word[2:]]


def brute(counts, times=2):
    keys = collections.defaultdict(set)
    for w in counts:
        keys["whole", w].add(w)
        for k in range(len(w)):
            keys["whole", w[:k] + w[k + 1 :]].add(w)
            keys[w[:k], w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for (kind, rest), group in keys.items():
        near_here = lambda a, b: a != b and (kind != "whole" or rest in (a, b))  # noqa: B023, E731
        for a in group:
            near[a] |= {b for b in group if near_here(a, b)}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f and counts[f] >= times * counts[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("block", [8192, 7])
def test_variants_equal_brute_force(spark, block):
    counts = {v: 1 + zlib.crc32(v.encode()) % 60 for s in STEMS for w in variants(s) for v in [w, *variants(w)] if len(v) >= 2}
    found = [tuple(r) for r in spelling.variants(words(spark, counts), block=block).collect()]
    assert len(found) == len(counts) and set(found) == brute(counts)


def test_ties_chains_and_long_words(spark):
    long = "ab" * 3000
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 4, "zzzza": 8, "azzzz": 8, "cdefg": 5, "gfedc": 9, long: 4, long + "a": 9, long[:-1]: 2, "qqqqq": 5, "qqqqqq": 9}
    found = {r["word"]: r for r in spelling.variants(words(spark, counts)).collect()}
    assert {tuple(r) for r in found.values()} == brute(counts)
    assert found["aaaaa"]["root"] == "aabbb" and found["zzzzz"]["form"] == "azzzz"  # the chain to its end; ties by code point
    assert found["cdefg"]["n_near"] == 0  # an anagram is no variant
    assert found["qqqqq"]["form"] is None and found["qqqqq"]["n_near"] == 1  # less than twice as often
    assert found[long]["form"] == long + "a" and found[long[:-1]]["root"] == long + "a"


def counted(rows, slip):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


@pytest.mark.parametrize("slip", [97, 2, None])
def test_word_counts(spark, slip):
    text = " ".join(v for s in STEMS for v in variants(s))
    rows = [(1, text), (1, text), (2, text.upper() + " ÀÉ×÷ÿŸ x"), (3, None), (4, ""), (5, "123 _-"), (None, text), (6, "Straße" * 20_000), (7, text + "\n" + text), (-8, "\x00abc\x01def")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA + ", n long, word string")
    found = {r["word"]: r["n"] for r in spelling.word_counts(docs, slip=slip).collect()}
    assert found == counted(rows, slip)


def test_rows_of_documents(spark):
    rows = [(i, " ".join(v for s in STEMS for v in variants(s)[: 1 + i % 7])) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = {w: n for w, n in counted(rows, spelling.SLIP).items() if n >= 3 and len(w) >= 5}
    assert {tuple(r) for r in spelling.variant_rows(docs).collect()} == brute(counts)
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variant_rows(empty).collect() == [] and spelling.variant_rows(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variant_rows(spark.createDataFrame([(1, None), (2, "too few words here")], SCHEMA)).collect() == []
