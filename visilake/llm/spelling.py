"""Spelling variants by blocked Gram matrices of letter counts.

Words are counted by Spark over all documents. Two words with one edit between them have letter counts at a
squared distance of one (an insertion) or two (a replacement), so distances come from matrix
products: |a|^2 + |b|^2 - 2 ab over blocks of words. Pairs at most two apart, of equal or adjacent
length, are then compared letter by letter.

Blocks are the words of one length, split again by how many letters fall into each of ``GROUPS``
groups of the alphabet: an insertion adds one letter to one group and a replacement moves at most
one from one group to another, so a block meets itself, the blocks one move away and those with one
letter more. Each word goes to its own block (home) and, as a visitor, to those blocks that come
after it in the order of keys; so every pair of neighbours meets in one task. A block of over ``BLOCK``
words is dealt into parts, and every part meets every other: no task holds more than a bounded number of
words, whatever the vocabulary. A task returns one row a word (how many near words, the best of
them), never pairs.

Null and empty texts have no words; a null id counts as the empty string where ids are hashed; repeated rows
count each. Very long runs are words like any other. Ties between forms go to the least in code-point order. Columns of other
names play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, whole_text

RUN = r"[A-Za-zÀ-ÿ]+"
GROUPS = 5
BLOCK = 8192
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: a word of at least so many times another's count can be its form
TIMES = 2
#: one run in so many loses a letter
SLIP = 97
#: cells of a Gram matrix, and letters compared, at once
TILE, LETTERS = 1 << 22, 1 << 22


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip: int | None = SLIP) -> DataFrame:
    """(word, n): how often each run occurs, lower-cased in A-Z; with ``slip``, runs lose letters by their hash."""
    runs = F.regexp_extract_all(whole_text(text), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    word = F.col("word")
    if slip:
        hashed = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (hashed % F.char_length("word")).cast("int")
        word = F.when(hashed % slip == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(word)
    return rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, lengths)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def _group_counts(words: list[str]) -> np.ndarray:
    """Letters of each word in each group of the alphabet."""
    points, sizes = _points(words)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * GROUPS + points % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _moves() -> list[np.ndarray]:
    """Differences of group counts one edit can make: a letter moved, or one added."""
    one = np.eye(GROUPS, dtype=np.int64)
    moved = [b - a for a in one for b in one if (a != b).any()]
    return [*moved, *one, *-one]


def _keys(counts: np.ndarray) -> list[str]:
    return [",".join(map(str, row)) for row in counts.tolist()]


def _placed(words: DataFrame, parts: int) -> DataFrame:
    """(cell, home_part, guest_part, home, word, n): each word at home and where it visits."""
    schema = "cell string, home_part int, guest_part int, home boolean, word string, n long"
    names = ["cell", "home_part", "guest_part", "home", "word", "n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _group_counts(batch.column("word").to_pylist())
            own = batch.column("part").to_numpy()
            every = np.arange(len(own))
            order = lambda c: tuple(c.T[::-1])
            for move in [np.zeros(GROUPS, np.int64), *_moves()]:
                there = counts + move
                # a visitor goes to cells that come later in the order of their counts
                first = np.flatnonzero(move)
                at = every if not len(first) else every[(there >= 0).all(1)] if move[first[0]] > 0 else every[:0]
                cells = pa.array(_keys(there[at]), pa.string())
                for part in range(parts):
                    other = np.full(len(at), part, np.int32)
                    sides = [(own[at], other, True), (other, own[at], False)] if not len(first) else [(other, own[at], False)]
                    for home, guest, is_home in sides:
                        keep = np.flatnonzero(home < guest) if not len(first) and not is_home else np.arange(len(at))
                        chosen = batch.take(pa.array(at[keep]))
                        yield pa.RecordBatch.from_arrays(
                            [cells.take(pa.array(keep)), pa.array(home[keep], pa.int32()), pa.array(guest[keep], pa.int32()), pa.array(np.full(len(keep), is_home)), chosen.column("word"), chosen.column("n")], names=names)

    return words.mapInArrow(place, schema)


class _Words:
    """Words of one side, with their letters and letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, alphabet: np.ndarray):
        self.words, self.n = words, n
        points, self.sizes = _points(words)
        codes, row = np.searchsorted(alphabet, points), np.repeat(np.arange(len(words)), self.sizes)
        self.letters, self.first = codes.astype(np.uint8), np.cumsum(self.sizes) - self.sizes
        counts = np.bincount(row * len(alphabet) + codes, minlength=len(words) * len(alphabet)).reshape(len(words), len(alphabet))
        kind = np.float32 if not counts.size or counts.max() < 2000 else np.float64  # sums of squares stay exact
        self.counts = counts.astype(kind)
        self.square = (self.counts.astype(np.float64) ** 2).sum(1).astype(kind)


def _one_edit(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Whether one edit makes word i of a, which is as long or a letter shorter, word j of b."""
    out = np.zeros(len(i), bool)
    order = np.argsort(a.sizes[i], kind="stable")
    sizes = a.sizes[i][order]
    start = 0
    while start < len(order):
        size = int(sizes[start])
        stop = min(np.searchsorted(sizes, size, "right"), start + max(1, LETTERS // (size + 1)))
        at = order[start:stop]
        longer = b.sizes[j[at]] - size
        places = np.arange(size)
        one = a.letters[a.first[i[at]][:, None] + places]
        left = one == b.letters[b.first[j[at]][:, None] + places]
        right = one == b.letters[(b.first[j[at]] + longer)[:, None] + places]
        ahead = np.where(left.all(1), size, np.argmin(left, 1))
        behind = np.where(right.all(1), size, np.argmin(right[:, ::-1], 1))
        out[at] = np.where(longer == 1, ahead + behind >= size, ahead + behind == size - 1)
        start = stop
    return out


def _close(a: _Words, b: _Words, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one edit, by letter counts first; of two equal sides each pair once."""
    found = []
    step = max(1, TILE // max(1, len(b.words)))
    for start in range(0, len(a.words), step):
        rows = slice(start, start + step)
        far = a.square[rows, None] + b.square[None, :] - 2 * (a.counts[rows] @ b.counts.T)
        i, j = np.nonzero((far > 0.5) & (far < 2.5))
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for x, y, swap in ((a, b, False), (b, a, True)):
            p, q = (j, i) if swap else (i, j)
            wanted = y.sizes[q] - x.sizes[p]
            chosen = np.flatnonzero((wanted == 1) | ((wanted == 0) & (not swap)))
            near = chosen[_one_edit(x, p[chosen], y, q[chosen])]
            found.append((i[near], j[near]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _best(n_words: int, word: np.ndarray, other: np.ndarray, other_n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with a near word, how many, the near word of the largest n and then least rank)."""
    if not len(word):
        return word, word, word
    order = np.lexsort((rank[other], -other_n[other], word))
    told, at, count = np.unique(word[order], return_index=True, return_counts=True)
    return told, count, other[order][at]


def _near_in_block(table: pa.Table) -> pa.Table:
    """(word, n_near, form_n, form) from the words of one block and its visitors."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    home = table.column("home").to_numpy()
    here, guests = np.flatnonzero(home), np.flatnonzero(~home)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    if not len(here):
        return schema.empty_table()
    alphabet = np.unique(_points(words)[0])
    one = _Words([words[i] for i in here], n[here], alphabet)
    two = _Words([words[i] for i in guests], n[guests], alphabet)
    pairs = []
    if table.column("home_part")[0].as_py() == table.column("guest_part")[0].as_py():
        i, j = _close(one, one, True)
        pairs.append((here[i], here[j]))
    i, j = _close(one, two, False)
    pairs.append((here[i], guests[j]))
    left = np.concatenate([p[0] for p in pairs] + [p[1] for p in pairs])
    right = np.concatenate([p[1] for p in pairs] + [p[0] for p in pairs])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    told, count, best = _best(len(words), left, right, n, rank)
    return pa.table([pa.array([words[i] for i in told], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())], schema=schema)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near): per word with near words, how many and the one of the largest n."""
    count_cells = lambda batches: (pa.RecordBatch.from_arrays([pa.array(_keys(_group_counts(b.column("word").to_pylist())), pa.string())], names=["cell"]) for b in batches)
    cells = stored(words.mapInArrow(count_cells, "cell string").groupBy("cell").count(), "cells")
    largest = cells.agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // block))
    dealt = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part"))
    # nobody visits a cell without a word at home
    blocks = _placed(dealt, parts).join(cells.select("cell"), "cell", "left_semi").groupBy("cell", "home_part", "guest_part")
    found = blocks.applyInArrow(_near_in_block, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.form").alias("near"))


def variants(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) with different words."""
    near = near_words(words, block)
    joined = words.join(near, "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    told = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    # n doubles along forms, so a chain has few links, and each round halves what is left of it
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_rows(docs: DataFrame) -> DataFrame:
    """Variants among the words of five letters and more that occur three times and more."""
    counted = word_counts(docs).where((F.col("n") >= LEAST_TIMES) & (F.char_length("word") >= LEAST_LETTERS))
    return variants(stored(counted, "words"))
