"""Hard negatives by rotated one-bit codes with exact integer scores.

A vector is scaled to integers and rotated: its signs are flipped by a fixed pattern and a Hadamard
transform spreads them, all in integers, so inner products grow by exactly the dimension. The code of
the rotated vector is its signs; stored beside it is its alignment, the part of the vector that
lies along the code. What is left over is coded again, ``LEVELS`` times, and the length of the last
rest is stored. For an anchor, the products with the codes come from popcounts over the bit planes of its
rotated components. They give an estimate of the score, and by Cauchy-Schwarz (rest of the row
times what of the anchor is not along the last code) an interval that surely holds the score.

Two rounds of blocks, each block some rows against some anchors:

* positives: in each block the likeliest rows are scored first; only rows whose interval reaches the score
  of the last place are scored besides;
* negatives: the same inside the band that each positive allows.

Every block gives at most the places asked for, and ranks over these give the whole table's. Both
sides of a block have a bounded size, so the hottest label or vector splits like any other; the
anchors are a stated query set.

Rows with a null id, label, vector or a null or non-finite component take no part. Of rows with one
id the one with the least (label, components) counts. Shorter vectors count as padded with zeros, an empty one as
zeros. Scaled components beyond 2^24 in size count as that. Equal scores order by id. A positive without a negative
in its band, or an anchor without a positive, gives no row; an empty table gives none. Columns of other names play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored

SCALE = 256
LEVELS = 4
BLOCK = 8192
ANCHOR_BLOCK = 8192
LARGEST = 1 << 24
POSITIVES, NEGATIVES = 5, 10
#: a negative's score, in hundredths of its positive's
LEAST, MOST = 30, 90
CODED = "vec_id long, label long, parts array<long>, codes binary, along array<double>, rest double"


def scaled(vectors: DataFrame, vec_id: str, embedding: str, label: str | Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, parts): integer components, one row an id."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("x"), finite.alias("finite"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND finite")
    bound = lambda v: F.greatest(F.least(v, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    parts = F.transform("x", lambda v: F.floor(bound(v.cast("double") * float(scale))).cast("long"))
    least = F.min(F.struct("label", parts.alias("parts")))
    return rows.groupBy("vec_id").agg(least.alias("row")).select("vec_id", "row.label", "row.parts")


def padded(parts: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(parts), dim), np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def rotated(x: np.ndarray) -> np.ndarray:
    """Signs flipped and Hadamard-transformed, along the last axis (a power of two)."""
    dim = x.shape[1]
    out, half = x * np.random.RandomState(dim).choice([-1, 1], dim), 1
    while half < dim:
        pairs = out.reshape(len(x), dim // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), dim)
        half *= 2
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    return np.ascontiguousarray(np.packbits(bits, axis=-1)).view(np.uint64)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: row, level, word; alignment: row, level; length of the rest) of rotated vectors."""
    rest, dim = x.astype(float), x.shape[1]
    codes, along = [], []
    for _ in range(LEVELS):
        up = rest >= 0
        signs = np.where(up, 1.0, -1.0)
        along.append(np.abs(rest).sum(1) / dim)
        codes.append(packed(up))
        rest = rest - along[-1][:, None] * signs
    return np.stack(codes, 1), np.stack(along, 1), np.sqrt((rest**2).sum(1))


class Rows:
    """Coded rows of a block, ordered by label and id."""

    def __init__(self, table: pa.Table, dim: int):
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.dim = ids[order], labels[order], dim
        self.parts = padded(table.column("parts").to_pandas().to_list(), dim)[order]
        words = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64)
        self.codes = np.ascontiguousarray(words.reshape(len(ids), LEVELS, dim // 64)[order].transpose(1, 2, 0))
        self.along = np.array(table.column("along").to_pylist(), float).reshape(len(ids), LEVELS)[order].T
        self.rest = table.column("rest").to_numpy()[order]
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        # products and sums of doubles are exact below 2^53, and then faster
        self.exact = self.parts.astype(float) if len(ids) and float(np.abs(self.parts).max()) * LARGEST * dim < 2.0**53 else None

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]))

    def interval(self, turned: np.ndarray, span: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, least, most) of the scores of a rotated anchor with the rows of ``span``."""
        low, total = int(turned.min()), int(turned.sum())
        bits = int(turned.max() - low).bit_length()
        planes = [packed((turned - low >> p) & 1) for p in reversed(range(bits))]
        n, kind = len(self.ids[span]), np.int32 if self.dim << bits < 1 << 31 else np.int64
        estimate, both, count = np.zeros(n), np.empty(n, np.uint64), np.empty(n, np.uint8)
        for level in range(LEVELS):
            sums = np.zeros(n, kind)
            for plane in planes:  # from the highest bit down
                sums <<= 1
                for word, codes in zip(plane, self.codes[level][:, span], strict=True):
                    np.bitwise_and(codes, word, out=both)
                    sums += np.bitwise_count(both, out=count)
            product = 2.0 * (sums + low * self.ones[level][span]) - total
            estimate += self.along[level][span] * product
        length = float((turned.astype(float) ** 2).sum())
        beside = np.sqrt(np.maximum(length - product**2 / self.dim, 0) + 1e-9 * length)
        estimate /= self.dim
        width = self.rest[span] * beside / self.dim + 1e-9 * (np.abs(estimate) + length / self.dim) + 1e-6
        return estimate, estimate - width, estimate + width

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.exact is None:
            return self.parts[at] @ anchor
        return (self.exact[at] @ anchor.astype(float)).astype(np.int64)

    def best(self, anchor: np.ndarray, at: np.ndarray, estimate: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, low: float = -np.inf, high: float = np.inf):
        """(places, scores) of the best ``k`` of the rows ``at`` with a score from ``low`` to ``high``."""
        likely = np.where(estimate <= high, estimate, -np.inf)
        first = np.argpartition(likely, -4 * k)[-4 * k :] if len(at) > 4 * k else np.arange(len(at))
        sure = self.scores(anchor, at[first])
        sure = np.sort(sure[(sure >= low) & (sure <= high)])[::-1]
        at = at[(most >= (sure[k - 1] if len(sure) >= k else low)) & (least <= high)]
        score = self.scores(anchor, at)
        held = (score >= low) & (score <= high)
        at, score = at[held], score[held]
        order = np.lexsort((self.ids[at], -score))[:k]
        return at[order], score[order]


def _coded_rows(rows: DataFrame, dim: int) -> DataFrame:
    """Rows with their codes, alignments and rests."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, along, rest = coded(rotated(padded(batch.column("parts").to_pandas().to_list(), dim)))
            added = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(along), pa.list_(pa.float64())), pa.array(rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["vec_id", "label", "parts", "codes", "along", "rest"])

    return rows.mapInArrow(work, CODED)


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _meet(rows: DataFrame, n_rows: int, asks: DataFrame, n_asks: int, work, names: list[str]) -> DataFrame:
    """``work(rows, asks)`` for each block of rows with each block of anchors: tuples of ``names``."""

    def table(left: pa.Table, right: pa.Table) -> pa.Table:
        found = work(left, right) if left.num_rows and right.num_rows else []
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(names))], names=names)

    row_blocks, ask_blocks = _blocks(n_rows, BLOCK), _blocks(n_asks, ANCHOR_BLOCK)
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", number(row_blocks).alias("row_block"), each(ask_blocks).alias("ask_block"))
    right = asks.select("*", number(ask_blocks).alias("ask_block"), each(row_blocks).alias("row_block"))
    key = ["row_block", "ask_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(table, ", ".join(f"{n} long" for n in names))


def _positive_scores(rows: DataFrame, n_rows: int, asks: DataFrame, n_asks: int, dim: int, k: int) -> DataFrame:
    """(anchor_id, other_id, score): the best of each block."""

    def work(left: pa.Table, right: pa.Table) -> list[tuple]:
        block, found = Rows(left, dim), []
        parts = padded(right.column("parts").to_pandas().to_list(), dim)
        turned = rotated(parts)
        for i, (anchor, label) in enumerate(zip(right.column("vec_id").to_pylist(), right.column("label").to_pylist(), strict=True)):
            start, end = block.of_label(label)
            at = np.arange(start, end)
            others = block.ids[start:end] != anchor
            told = (v[others] for v in block.interval(turned[i], slice(start, end)))
            best, score = block.best(parts[i], at[others], *told, k)
            found += zip([anchor] * len(best), block.ids[best].tolist(), score.tolist(), strict=True)
        return found

    return _meet(rows, n_rows, asks, n_asks, work, ["anchor_id", "other_id", "score"])


def _negative_scores(rows: DataFrame, n_rows: int, asks: DataFrame, n_asks: int, dim: int, k: int, least: int, most: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, score): the best in the band of each block."""
    def work(left: pa.Table, right: pa.Table) -> list[tuple]:
        block, found = Rows(left, dim), []
        parts = padded(right.column("parts").to_pandas().to_list(), dim)
        turned, every = rotated(parts), np.arange(left.num_rows)
        asked = zip(right.column("vec_id").to_pylist(), right.column("label").to_pylist(), right.column("positives").to_pylist(), strict=True)
        for i, (anchor, label, positives) in enumerate(asked):
            start, end = block.of_label(label)
            other = np.concatenate((every[:start], every[end:]))
            told = [v[other] for v in block.interval(turned[i], slice(None))]
            for p in positives:
                low, high = -(-least * p["score"] // 100), most * p["score"] // 100
                best, score = block.best(parts[i], other, *told, k, low, high)
                found += zip([anchor] * len(best), [p["other_id"]] * len(best), [p["score"]] * len(best), block.ids[best].tolist(), score.tolist(), strict=True)
        return found

    return _meet(rows, n_rows, asks, n_asks, work, ["anchor_id", "positive_id", "positive_score", "negative_id", "score"])


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``.
    """
    plain = stored(scaled(vectors, vec_id, embedding, label), "parts")
    n_rows, widest = plain.agg(F.count("*"), F.max(F.size("parts"))).first()
    dim = 64
    while dim < (widest or 0):
        dim *= 2
    rows = stored(_coded_rows(plain, dim), "codes")
    is_anchor = F.col("vec_id") % every == 0
    asks = rows.where(is_anchor).select("vec_id", "label", "parts")
    n_asks = asks.count()
    order = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    near = _positive_scores(rows, n_rows, asks, n_asks, dim, positives).withColumn("place", F.row_number().over(order("anchor_id"))).where(F.col("place") <= positives)
    chosen = near.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"))
    told = stored(asks.join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")
    found = _negative_scores(rows, n_rows, told, n_asks, dim, negatives, least, most).withColumnRenamed("negative_id", "other_id")
    ranked = found.withColumn("rank", F.row_number().over(order("anchor_id", "positive_id"))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negative_rows(vectors: DataFrame) -> DataFrame:
    """Hard negatives where every seventh id takes the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label=moved)
