"""Exact substring dedup by Rabin-Karp hashes of every window of ``size`` words.

A window repeats if its word sequence also starts in a document with a smaller id; every word it
covers goes, judged on the input. Overlapping repeated windows merge into maximal intervals.

What moves is kept small without losing a window:

* of documents with the same text only the one with the smallest id is compared; the others'
  windows all start there too;
* equal windows have equal least hashes among their ``GRAM``-word grams, so a window can only
  repeat if that hash occurs in two documents. About one gram in five is such a least one, and only
  these are counted over the corpus first, with the smallest and the largest document that holds each;
* a document's windows under a gram are told to others unless it is the largest that holds the gram,
  and judged unless it is the smallest; both sides are hashed, the first counted by Spark with the
  smallest document a window starts in, the second joined to that;
* texts are dealt by document once; Spark reuses that exchange.

Counts are pre-aggregated, so a passage in a third of all documents is one row a task. Each count
joins back to rows, never a group to a list; the counts are dealt anew for that, so that Spark can
split the rows of a hot passage. Windows are told apart by 80 bits, a hash and an independent check:
at 100 TB some 4 * 10^11 windows have a shared gram, and the odds that any two different ones meet are below one in ten.

Rows are named by their id where ids are unique, else by id and a hash of the text.

Null and empty texts have no words. A document shorter than a window loses nothing. Rows of one id
never repeat each other; equal rows are each returned. A row with a null id loses nothing and takes
nothing from others. Very long texts are worked on whole, others in batches. An empty table gives an
empty result, and columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, whole_text

SIZE = 13
GRAM = 6
SLICE_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
#: odd bases of the rolling hashes
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASE = 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> _U(27)) * _U(0x94D049BB133111EB)
    return h ^ h >> _U(31)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo two to the 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, _U)
        if n:
            p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: powers a worker keeps; a longer text's are let go with it
KEPT_POWERS = 1 << 21


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS + 1:
        return _powers(base, n)
    if base not in _tables or len(_tables[base][0]) < n:
        _tables[base] = _powers(base, n)
    return _tables[base]


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, from prefix sums."""
    power, inverse = _power_tables(base, len(values) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(values * power[: len(values)], dtype=_U)))
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, a second one, first word of each document and the total)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    values = data.astype(_U) + _U(1)
    one, two = (_rolled(values, starts, ends, b) for b in _BYTE_BASES)
    return _mixed(one + _mixed(two)), _mixed(two + _mixed(one ^ _U(_WORD_BASE))), np.searchsorted(starts, at)


class Windows:
    """Hashes of all windows of some documents, in order."""

    def __init__(self, texts: list[bytes], size: int, gram: int):
        words, again, first = word_hashes(texts)
        place = np.arange(len(words))
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        left = first[doc + 1] - place if len(words) else place
        at = np.flatnonzero(left >= size)  # a window starts here
        self.doc, self.pos = doc[at], at - first[doc[at]]
        self.words, self.again, self.at, self.size = words, again, at, size
        grams = np.zeros(0, _U)
        if len(at):
            starts = np.arange(len(words) - gram + 1)
            # 48 bits are enough for a filter; what they confuse, the windows' own keys tell apart
            grams = _mixed(_rolled(words, starts, starts + gram, _WORD_BASE)) >> _U(16)
        # least gram of each window: minima over runs of doubling length
        span, run, need = 1, grams, size - gram + 1
        while len(grams) and 2 * span <= need:
            run, span = np.minimum(run[:-span], run[span:]), 2 * span
        self.least = np.minimum(run[at], run[at + need - span]) if len(at) else grams

    def keys(self, chosen: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``bits`` bits of the chosen windows, and 16 bits to check them by."""
        starts = self.at[chosen]
        hashed, check = (_mixed(_rolled(w, starts, starts + self.size, _WORD_BASE)) for w in (self.words, self.again))
        return (hashed >> _U(64 - bits)).view(np.int64), (check >> _U(48)).astype(np.uint16).view(np.int16)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive rows whose texts fill a slice, or one long text."""
    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield start, i, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts), texts[start:]


def _least_grams(texts: DataFrame, key: list[str], size: int, gram: int) -> DataFrame:
    """(gram, key): each document's window minima, adjacent repeats once."""
    schema = pa.schema([("gram", pa.int64()), *((k, pa.int64()) for k in key)])

    def find(batches):
        for batch in batches:
            names = [batch.column(k).to_numpy() for k in key]
            for first, _, part in _sliced(batch):
                w = Windows(part, size, gram)
                new = np.concatenate(([True], (w.least[1:] != w.least[:-1]) | (w.doc[1:] != w.doc[:-1])))[: len(w.doc)]
                doc = first + w.doc[new]
                yield pa.RecordBatch.from_arrays([pa.array(w.least[new].view(np.int64)), *(pa.array(n[doc]) for n in names)], schema=schema)

    return texts.mapInArrow(find, ", ".join(f"{c} long" for c in ("gram", *key)))


#: what a document does with its windows under a shared gram, in the lowest bits of the gram
TELLS, ASKS = 1, 2


def _windows(texts: DataFrame, key: list[str], size: int, gram: int, bits: int, does: int) -> DataFrame:
    """(hash, check, key) of the windows whose least gram is in ``grams`` for ``does``; with their place, if they ask."""
    place = [("pos", pa.int32())] if does == ASKS else []
    schema = pa.schema([("hash", pa.int64()), ("check", pa.int16()), *place, *((k, pa.int64()) for k in key)])

    def find(batches):
        for batch in batches:
            names = [batch.column(k).to_numpy() for k in key]
            for first, last, part in _sliced(batch):
                w = Windows(part, size, gram)
                allowed = batch.column("grams").slice(first, last - first)
                owner = np.repeat(np.arange(last - first), np.diff(np.asarray(allowed.offsets)))
                named = allowed.flatten().to_numpy().view(_U)
                mine = named & _U(does) != 0
                # (document, gram) pairs as one hash each, looked up together
                mark = lambda doc, g: _mixed(g + _U(0x9E3779B97F4A7C15) * doc.astype(_U))
                chosen = np.flatnonzero(np.isin(mark(w.doc, w.least), mark(owner[mine], named[mine] >> _U(2))))
                doc = first + w.doc[chosen]
                places = [pa.array(w.pos[chosen].astype(np.int32))] if place else []
                yield pa.RecordBatch.from_arrays([*map(pa.array, w.keys(chosen, bits)), *places, *(pa.array(n[doc]) for n in names)], schema=schema)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short"}
    return texts.mapInArrow(find, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _kept(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_words, removed, kept_text) from (doc_id, text, copied, places)."""
    schema = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept_text string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def cut(text: bytes, copied: bool | None, places: list[int] | None):
        words = text.split()
        if copied and len(words) >= size:
            return len(words), [{"start": 0, "end": len(words)}], ""
        spans: list[dict] = []
        for at in sorted(places or ()):
            if spans and at <= spans[-1]["end"]:
                spans[-1]["end"] = at + size
            else:
                spans.append({"start": at, "end": at + size})
        ends = [0, *(s["end"] for s in spans)]
        starts = [*(s["start"] for s in spans), len(words)]
        kept = [w for a, b in zip(ends, starts, strict=True) for w in words[a:b]]
        return len(words), spans, b" ".join(kept).decode()

    def cut_all(batches):
        for batch in batches:
            for first, last, texts in _sliced(batch):
                part = batch.slice(first, last - first)
                done = list(map(cut, texts, part.column("copied").to_pylist(), part.column("places").to_pylist()))
                columns = [part.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), list(arrow)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(cut_all, schema)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_words, removed: array of word spans, kept_text), one row per document; ``bits`` of a window's hash."""
    # no alias where none is needed: Spark must see one and the same exchange of texts in each use
    named_id = F.col(doc_id) if doc_id == "doc_id" and dict(docs.dtypes)[doc_id] == "bigint" else F.col(doc_id).cast("long").alias("doc_id")
    rows = docs.select(named_id, whole_text(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    named = rows.where(F.col("doc_id").isNotNull())
    narrow = stored(named.select("doc_id", "row_key", F.md5("text").alias("same")), "keys")
    texts_of = narrow.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("b"))
    key = ["doc_id"] if texts_of.where("a <> b").isEmpty() else ["doc_id", "row_key"]
    named = named.select(*key, "text")
    first = narrow.groupBy("same").agg(F.min("doc_id").alias("first"))
    told = narrow.join(first, "same").select(*key, (F.col("doc_id") > F.col("first")).alias("copied")).distinct()
    told = stored(told, "copies")

    texts = named.join(told.where("not copied").select(*key), key)
    grams = _least_grams(texts, key, size, gram)
    # a count by the inverse is dealt anew for the join, whose hot keys Spark can then split
    counted = grams.groupBy(F.bitwise_not("gram").alias("inverse")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    shared = counted.select(F.bitwise_not("inverse").alias("gram"), "least", "most")
    does = F.when(F.col("doc_id") < F.col("most"), TELLS).otherwise(0) + F.when(F.col("doc_id") > F.col("least"), ASKS).otherwise(0)
    marked = grams.join(shared, "gram").groupBy(*key).agg(F.collect_set(F.col("gram") * 4 + does).alias("grams"))
    asked = texts.join(marked, key).select(*key, "text", "grams")
    told_by = _windows(asked, key, size, gram, bits, TELLS)
    begun = told_by.groupBy(F.bitwise_not("hash").alias("inverse"), "check").agg(F.min("doc_id").alias("first"))
    again = _windows(asked, key, size, gram, bits, ASKS).join(begun.select(F.bitwise_not("inverse").alias("hash"), "check", "first"), ["hash", "check"]).where("doc_id > first")
    again = again.groupBy(*key).agg(F.collect_set("pos").alias("places"))
    fate = again.select(*key, F.lit(False).alias("copied"), "places").unionByName(told.where("copied").select(*key, "copied", F.expr("cast(null as array<int>)").alias("places")))
    judged = named.join(fate, key, "left").select("doc_id", "text", "copied", "places")
    unnamed = rows.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(False).alias("copied"), F.expr("cast(null as array<int>)").alias("places"))
    return _kept(judged.unionByName(unnamed), size)


def repeat_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    done = remove_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
