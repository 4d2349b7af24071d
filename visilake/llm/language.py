"""Language identification with rank-order n-gram profiles.

A language's profile is its most frequent character n-grams (one to three code points, words
padded by a blank) in rank order. A document's own most frequent n-grams are compared with each
profile by the out-of-place distance: the difference of the two ranks, or the profile's length
where the profile lacks the n-gram. The least distance wins; ties go to the first language by name.

Profiles are fitted on a bounded sample of labelled documents (``TRAIN_DOCS`` a language, chosen
by a hash of the id); only their text and label are read. Every document is then read whole.

Null text, empty text and text without a letter give ``und`` with score 0; so does everything if
nothing could be learned. The score is one minus the distance's share of the largest possible
distance. A text longer than a slice is counted slice by slice, to the same counts. Repeated rows get
equal answers; an empty table gives an empty result; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import give_back, worker_tables

PROFILE = 300
TRAIN_DOCS = 4000
SLICE_CHARS = 1 << 18
HELD_OUT = 5

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _slices(texts: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """(first, last + 1, parts): consecutive documents of about a slice, or one long document."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_CHARS:
            yield start, i, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts), texts[start:]


def _keys(points: np.ndarray, who: np.ndarray, known: int = 1) -> np.ndarray:
    """Sorted (owner, n-gram) integers of folded code points; n-grams within the first ``known`` are left out.

    An n-gram is a 40-bit hash, so that owner and n-gram sort as one integer.
    """
    blank = points == 32
    one = ~blank
    one[:known] = False
    two = points[:-1] << np.uint64(21) | points[1:]
    three = points[:-2] << np.uint64(42) | two[1:]
    whole = ~blank[1:-1]  # a blank may stand at either end only
    last = np.where(blank[2:], who[1:-1], who[2:])
    pair_owner = np.where(blank[1:], who[:-1], who[1:])
    keys = []
    for gram, of in ((points[one], who[one]), (two[known - 1 :], pair_owner[known - 1 :]), (three[whole], last[whole])):
        mixed = gram * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        keys.append(of << np.uint64(40) | mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24))
    key = np.concatenate(keys)
    key.sort()
    return key


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, count) of sorted keys."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    return key[edge], np.diff(np.append(edge, len(key)))


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram key, count) of texts, sorted by owner and key; owners are small numbers."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    who = np.repeat(owner.astype(np.uint64), sizes)
    letter = _is_letter()[points]
    kept = letter | np.concatenate(([False], letter[:-1]))  # one blank after each run of letters
    points = np.where(letter, points, 32)[kept].astype(np.uint64)
    points = np.concatenate((np.array([32], dtype=np.uint64), points))
    key, count = _counted(_keys(points, np.concatenate((who[:1], who[kept]))))
    return key >> np.uint64(40), key & np.uint64((1 << 40) - 1), count


def long_gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram key, count) of one long text, a slice at a time; the last two points go on to the next slice."""
    lowered = text.lower() + " "
    tail, in_word, found = np.array([32], dtype=np.uint64), False, {}
    for at in range(0, len(lowered), SLICE_CHARS):
        points = np.frombuffer(lowered[at : at + SLICE_CHARS].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _is_letter()[points]
        kept = letter | np.concatenate(([in_word], letter[:-1]))
        points = np.concatenate((tail, np.where(letter, points, 32)[kept].astype(np.uint64)))
        if len(points) > len(tail):
            for k, n in zip(*(c.tolist() for c in _counted(_keys(points, np.zeros(len(points), np.uint64), len(tail)))), strict=True):
                found[k] = found.get(k, 0) + n
        tail, in_word = points[-2:], bool(letter[-1])
    key = np.array(sorted(found), dtype=np.uint64)
    return key, np.array([found[k] for k in key.tolist()], dtype=np.int64)


def _ranked(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, rank) of each document's most frequent n-grams; ties in rank by key."""
    if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
        key, count = long_gram_counts(texts[0])
        doc = np.zeros(len(key), dtype=np.uint64)
    else:
        doc, key, count = gram_counts(texts, np.arange(len(texts)))
    order = np.argsort((doc.astype(np.int64) << 32) - np.minimum(count, (1 << 31) - 1), kind="stable")
    doc, key = doc[order].astype(np.int64), key[order]
    starts = np.searchsorted(doc, np.arange(len(texts)))
    rank = np.arange(len(doc)) - starts[doc]
    top = rank < size
    return doc[top], key[top], rank[top]


def learned_rows(docs: DataFrame, train_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The labelled rows profiles are fitted on: about ``train_docs`` a language."""
    remainder = F.crc32(F.col(doc_id).cast("string")) % HELD_OUT
    usable = docs.where((remainder != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[0]: row[1] for row in usable.groupBy(lang).count().collect()}  # a row a language
    if not counts:
        return usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, train_docs / n))])
    chosen = F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20)
    return usable.where(chosen).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def train_profiles(rows: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Language to its n-gram keys in rank order, from (lang, text) rows; ``size`` keys a language."""

    def count(batches):
        worker_tables()
        for batch in batches:
            names, codes = np.unique(batch["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            for first, last, texts in _slices(batch["text"].tolist()):
                owner, key, n = gram_counts(texts, codes[first:last])
                # owners may repeat in a slice; equal keys are already together
                yield pd.DataFrame({"lang": names[owner.astype(np.int64)], "gram": key.astype(np.int64), "n": n})
        give_back()

    counted = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # at most ``size`` rows a language
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``margin`` (lead over the second language) added.

    Columns of these names in ``docs`` are replaced.
    """
    names = sorted(profiles)
    table = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.uint64)
    ranks = np.full((len(table) + 1, max(1, len(names))), size, dtype=np.int32)
    for j, name in enumerate(names):
        ranks[np.searchsorted(table, np.array(profiles[name], dtype=np.uint64)), j] = np.arange(len(profiles[name]))

    def judge(texts: list[str]) -> pd.DataFrame:
        doc, key, rank = _ranked(texts, size)
        best = np.full(len(texts), -1)
        score, margin = np.zeros(len(texts)), np.zeros(len(texts))
        if len(doc) and names:
            at = np.searchsorted(table, key)
            at[(at == len(table)) | (table[np.minimum(at, len(table) - 1)] != key)] = len(table)
            place = ranks[at]
            apart = np.where(place == size, size, np.abs(place - rank[:, None]))
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            have = doc[starts]
            used = np.diff(np.append(starts, len(doc)))
            share = np.add.reduceat(apart, starts, axis=0) / (used * size)[:, None]
            best[have] = share.argmin(axis=1)
            ordered = np.sort(share, axis=1)
            score[have] = 1 - ordered[:, 0]
            if len(names) > 1:
                margin[have] = ordered[:, 1] - ordered[:, 0]
        lang = np.array([*names, "und"], dtype=object)[best]
        return pd.DataFrame({"lang_pred": lang, "score": score, "margin": margin})

    @F.pandas_udf("struct<lang_pred string, score double, margin double>")
    def guess(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_tables()
        for column in columns:
            texts = column.fillna("").tolist()
            parts = [judge(part) for _, _, part in _slices(texts)]
            yield pd.concat(parts, ignore_index=True) if parts else judge([])
        give_back()

    added = ("lang_pred", "score", "margin")
    kept = docs.select(*[F.col(c) for c in docs.columns if c not in added], guess(F.col(text)).alias("_guess"))
    return kept.select("*", *[F.col(f"_guess.{c}") for c in added]).drop("_guess")


def has_letter(text: str = "text") -> Column:
    """Whether the text holds a letter: where profiles were learned, those ``identify`` doesn't call ``und``."""

    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        return column.fillna("").map(lambda t: any(map(str.isalpha, t.lower()))).astype(bool)

    return holds(F.col(text))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin): profiles fitted on rows that aren't held out."""
    profiles = train_profiles(learned_rows(docs))
    found = identify(docs.select("doc_id", "text"), profiles)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin")
