"""Benchmark decontamination by the q-gram lemma and banded alignment.

Documents and benchmark items are compared as lower-cased code points with runs of white space
as one blank. An item is looked for by segments of one length, ``SEGMENT`` code points, that
begin every ``STEP`` (a shorter item is one segment), so any ``SEGMENT + STEP - 1`` code points of an
item hold a whole segment. A segment may differ from a document's region by an edit budget of
``RATE`` of its length. If it does, region and segment share at least ``length - Q + 1 - Q * budget``
q-grams, all on diagonals no further apart than the budget. So shared q-grams are counted in
overlapping bands of diagonals, bands that reach the bound are kept, and a banded alignment of the
segment with each kept region decides. Regions of one item that overlap become one; its ``edits`` are
the most that one of its segments needs.

Items under ``SHORTEST`` code points have no room for edits: they are found where they stand
exactly, between word boundaries, by one automaton of all of them. Items without a letter or a digit
are never looked for.

The items are the query set: they go to the executors in blocks of at most ``BLOCK_CHARS``
characters, so what is sent has a fixed bound; every block meets all documents. Documents never
move and are read whole; long ones are folded and searched in overlapping pieces, with white space
folded across their edges, so that the size of a text changes nothing.

Null and empty texts match nothing. Repeated rows and equal items of different ids each give their own rows. Empty
tables give an empty result; columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, worker_tables
from .windows import _mixed, _rolled

Q = 8
RATE = 0.1
SEGMENT = 96
STEP = 32
SHORTEST = 32
BLOCK_CHARS = 8_000_000
SLICE_CHARS = 1 << 18
#: documents whose texts are Python objects at a time
SLICE_ROWS = 256
#: folded code points of a long text that its next piece has again: more than a region and its bands span
OVERLAP = 4 * SEGMENT
_BASE = 0x9FB21C651E98DF25
_U = np.uint64

_folds: list[np.ndarray] = []


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point that has a single one, and which are white space."""
    if not _folds:
        _folds.append(np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000))
        _folds.append(np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000))
    return _folds[0], _folds[1]


def normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points with single blanks, their places in the input)."""
    low, blank = _fold()
    space = blank[points]
    at = np.flatnonzero(~(space & np.concatenate(([False], space[:-1]))))
    return np.where(space[at], 32, low[points[at]]), at


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place that has one."""
    starts = np.arange(max(0, len(points) - Q + 1))
    return _mixed(_rolled(points.astype(_U) + _U(1), starts, starts + Q, _BASE))


def segments(points: np.ndarray) -> list[np.ndarray]:
    """Segments of one length that begin every step and at the last place, or the whole of a shorter item."""
    last = max(0, len(points) - SEGMENT)
    return [points[at : at + SEGMENT] for at in sorted({*range(0, last + 1, STEP), last})]


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Items:
    """Segments of a block of items, with postings by q-gram; an automaton of the short items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.item, self.points, self.budget = [], [], []
        self.short: dict[str, list[int]] = {}
        for item, text in items:
            points = normal(code_points(text.strip()))[0]
            if len(points) < SHORTEST:
                folded = as_text(points)
                if any(map(str.isalnum, folded)):
                    self.short.setdefault(folded, []).append(item)
            else:
                for part in segments(points):
                    self.item.append(item)
                    self.points.append(part)
                    self.budget.append(min(int(rate * len(part)), (len(part) - Q) // Q))
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.budgets = np.array(self.budget, np.int64)
        self.bound = self.length - Q + 1 - Q * self.budgets
        found = [grams(p) for p in self.points]
        key = np.concatenate([np.empty(0, _U), *found])
        owner = np.repeat(np.arange(len(found)), [len(g) for g in found]) if found else np.empty(0, np.int64)
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in found)])
        order = np.argsort(key, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = max(12, int(len(self.keys)).bit_length() + 6)  # about one mark in 64
        self.marked = np.zeros(1 << self.bits, bool)
        self.marked[self.keys >> _U(64 - self.bits)] = True
        self.automaton = ahocorasick.Automaton()
        for text in self.short:
            self.automaton.add_word(text, text)
        if self.short:
            self.automaton.make_automaton()

    def exact(self, points: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """(short item, start, end) between word boundaries."""
        if not self.short:
            return
        text = as_text(points)
        for last, item in self.automaton.iter(text):
            start, end = last + 1 - len(item), last + 1
            inside = start and item[0].isalnum() and text[start - 1].isalnum()
            if not inside and not (end < len(text) and item[-1].isalnum() and text[end].isalnum()):
                yield item, start, end

    def candidates(self, points: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, segment, first diagonal of a band) where the lemma's bound is reached.

        ``points`` are several documents' normal code points, ``doc`` whose each is.
        """
        hashed = grams(points)
        at = np.flatnonzero(self.marked[hashed >> _U(64 - self.bits)])
        if not len(self.keys) or not len(at):
            return
        at = at[doc[at] == doc[at + Q - 1]]
        gram = np.minimum(np.searchsorted(self.keys, hashed[at]), len(self.keys) - 1)
        same = self.keys[gram] == hashed[at]
        at, gram = at[same], gram[same]
        n = self.count[gram]
        ends = np.cumsum(n)
        if not len(ends):
            return
        post = np.repeat(self.first[gram] - ends + n, n) + np.arange(ends[-1])
        at, seg = np.repeat(at, n), self.owner[post]
        diagonal = at - self.place[post]
        pair = doc[at].astype(np.int64) * len(self.length) + seg
        # too few shared q-grams in the whole document: too few in any band
        keep = _counts(pair) >= self.bound[seg]
        diagonal, seg, place = diagonal[keep], seg[keep], self.place[post[keep]]
        pairs, pair = np.unique(pair[keep], return_inverse=True)
        band = diagonal // (self.budgets[seg] + 1)
        shift = len(points) + 1  # bands can start before the text
        key = pair * (4 * shift) + band + shift
        # an item's q-gram counts once in a band, however often the document has it
        once = np.unique(np.concatenate((key, key - 1)) * SEGMENT + np.concatenate((place, place))) // SEGMENT
        key, count = np.unique(once, return_counts=True)
        pair, band = pairs[key // (4 * shift)], key % (4 * shift) - shift
        seg = pair % len(self.length)
        for i in np.flatnonzero(count >= self.bound[seg]).tolist():
            yield int(pair[i] // len(self.length)), int(seg[i]), int(band[i] * (self.budget[seg[i]] + 1))

    def verify(self, seg: int, text: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best region of a band of diagonals, if within the budget."""
        item, budget = self.points[seg], self.budget[seg]
        low = max(0, diagonal - budget)
        region = text[low : max(0, diagonal + 2 * (budget + 1) + len(item) + budget)]
        exact = region.tobytes().find(item.tobytes())
        while exact > 0 and exact % 4:
            exact = region.tobytes().find(item.tobytes(), exact + 1)
        if exact >= 0:
            return low + exact // 4, low + exact // 4 + len(item), 0
        end, edits = align(item, region, free_start=True)
        if edits > budget:
            return None
        start, _ = align(item[::-1], region[:end][::-1], free_start=False)
        return low + end - start, low + end, edits


def _counts(values: np.ndarray) -> np.ndarray:
    span = int(values.max()) + 1 if len(values) else 0
    if span <= 4 * len(values) + (1 << 16):
        return np.bincount(values, minlength=span)[values]
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[back]


def align(item: np.ndarray, region: np.ndarray, free_start: bool) -> tuple[int, int]:
    """(end in the region, edits) of the best alignment of the whole item; the end is free.

    Row by row over the region's band, insertions by a running minimum.
    """
    steps = np.arange(len(region) + 1)
    row = np.zeros_like(steps) if free_start else steps.copy()
    for i, sign in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != sign))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return end, int(row[end])


def _items(name: int, chosen: list[tuple[int, str]], rate: float) -> Items:
    """A worker's index of a block of items; it keeps the last one."""
    return worker_tables(("items", name), lambda: Items(chosen, rate))


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """(rows, folded points, whose each is, its place in the text, whether the text began and goes on elsewhere).

    Short texts together, about a slice at a time; a long one in pieces that share ``OVERLAP`` folded
    points. Every text stands between blanks.
    """
    part, size = [], 0
    for i, text in enumerate(texts):
        if part and size + len(text) > SLICE_CHARS:
            yield _together(part, texts)
            part, size = [], 0
        if len(text) <= SLICE_CHARS:
            part.append(i)
            size += len(text)
            continue
        points, place = np.array([32], np.uint32), np.array([-1])
        for at in range(0, len(text), SLICE_CHARS):
            new, where = normal(code_points(text[at : at + SLICE_CHARS]))
            from_here = int(points[-1] == 32 and new[0] == 32)
            points, place = np.concatenate((points, new[from_here:])), np.concatenate((place, where[from_here:] + at))
            more = at + SLICE_CHARS < len(text)
            if not more and points[-1] != 32:
                points, place = np.append(points, np.uint32(32)), np.append(place, len(text))
            yield [i], points, np.zeros(len(points), np.int64), place, at > 0, more
            points, place = points[-OVERLAP:], place[-OVERLAP:]
    if part:
        yield _together(part, texts)


def _together(part: list[int], texts: list[str]):
    points = [code_points(texts[i]) for i in part]
    whole, at = normal(np.concatenate([np.array([32], np.uint32), *(x for p in points for x in (p, np.array([10], np.uint32)))]))
    starts = np.concatenate(([1], 1 + np.cumsum([len(p) + 1 for p in points])))
    doc = np.clip(np.searchsorted(starts, at, side="right") - 1, 0, len(part) - 1)
    return part, whole, doc, at - starts[doc], False, False


def matches(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits): the regions of an item, those that overlap as one."""
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    for rows, whole, doc, place, begun, more in _pieces(texts):
        first = np.searchsorted(doc, np.arange(len(rows) + 1))
        for d, seg, diagonal in set(items.candidates(whole, doc)):
            text = whole[first[d] : first[d + 1]]
            if found := items.verify(seg, text, diagonal - first[d]):
                at = place[first[d] : first[d + 1]]
                start, end = max(0, int(at[found[0]])), int(at[found[1] - 1]) + 1
                key = (rows[d], seg, start)
                best[key] = min(best.get(key, (1 << 30, 0)), (found[2], end))
        for item, start, end in items.exact(whole):
            # what touches the edge of a piece is whole, with what stands beside it, in the one before or after
            if not (begun and start == 0 or more and end == len(whole)) and doc[start] == doc[end - 1]:
                out += [(rows[doc[start]], name, int(place[start]), int(place[end - 1]) + 1, 0) for name in items.short[item]]
    alone: list[tuple[int, int, int, int, int]] = []
    for (row, seg, start), (edits, end) in sorted(best.items()):  # of one segment's regions that overlap the best
        last = alone[-1] if alone else None
        if last and last[:2] == (row, seg) and start < last[3]:
            if edits < last[4]:
                alone[-1] = (row, seg, start, end, edits)
            continue
        alone.append((row, seg, start, end, edits))
    joined: list[tuple[int, int, int, int, int]] = []
    for row, item, start, end, edits in sorted((row, items.item[seg], *rest) for row, seg, *rest in alone):
        if joined and joined[-1][:2] == (row, item) and start < joined[-1][3]:
            _, _, begin, stop, most = joined[-1]
            joined[-1] = (row, item, begin, max(stop, end), max(most, edits))
        else:
            joined.append((row, item, start, end, edits))
    return sorted({*out, *joined})


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): every region of a document that holds a segment of an item.

    Places are code points of the document. Ids of documents keep their type, whatever it is.
    """
    usable = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = usable.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, start long, end long, edits int"
    found = []
    for block in range(blocks):
        chosen = [tuple(r) for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]

        def search(batches, chosen=chosen, name=hash((rate, *chosen))):
            items = _items(name, chosen, rate)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(at, SLICE_ROWS)
                    hits = matches(items, batch.column(1).to_pylist())
                    numbers = [pa.array([h[i] for h in hits], pa.int32() if i == 4 else pa.int64()) for i in range(5)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(numbers[0]), *numbers[1:]], names=["doc_id", "item_id", "start", "end", "edits"])
            give_back()

        found.append(rows.mapInArrow(search, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
