"""Licence scans with a positional index of rare words, in column expressions only.

Every licence notice is a word sequence with a mandatory key phrase. Its postings are its
rarest words with their places; rarity is measured as document frequency over the whole corpus.
A document's occurrences of a notice's rarest mandatory word propose offsets, the postings of
the other rare words must stand at the same relative places (all of a key phrase's, most of a
longer notice's), and then the key phrase is verified word by word. A notice needs ``MIN_SHARE``
of its words at their places. A short phrase is its own notice and key phrase, so every place
of it is found: each holds the phrase's rarest word.

The work is row-local: one pass for the frequencies of the few notice words, one for the scan.
Null and empty texts have no words and no labels. Repeated rows get equal answers, a word that
fills a long document costs a constant per occurrence, and other columns stay untouched. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3
MIN_SHARE = 0.8

#: phrases whose every place counts: label, phrase
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: notices: label, words, mandatory key phrase (public licence texts)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("agpl-3", "gnu affero general public license", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
)


def words_of(text: str = "text") -> Column:
    """The words of a text, A-Z folded; the two signs that Unicode folds into ASCII are kept out."""
    plain = F.replace(F.replace(whole_text(text), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def _templates() -> list[tuple[str, list[str], int, int, bool]]:
    """(label, words, first and last place of the key phrase, whether a base phrase)."""
    found = [(label, phrase.split(), 0, len(phrase.split()) - 1, True) for label, phrase in PHRASES]
    for label, notice, key in NOTICES:
        words, must = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        found.append((label, words, at, at + len(must) - 1, False))
    return found


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each notice word stands; as many rows as there are notice words."""
    vocabulary = sorted({w for _, words, *_ in _templates() for w in words})
    present = F.array_intersect(words_of(text), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {row["word"]: row["count"] for row in counted}


def _index(frequency: dict[str, int]) -> tuple[Column, set[str]]:
    """The templates with their postings as one literal array, and the words that propose offsets."""
    rows, anchors = [], set()
    for label, words, first, last, base in _templates():
        rare = sorted(range(len(words)), key=lambda i: (frequency[words[i]], i))[:RARE]
        anchor = min(range(first, last + 1), key=lambda i: (frequency[words[i]], i))
        anchors.add(words[anchor])
        rows.append(F.struct(
            F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(words[anchor]).alias("anchor"), F.lit(anchor).alias("at"),
            F.array(*map(F.lit, words)).alias("words"), F.array(*map(F.lit, rare)).alias("rare"),
            F.lit(min(len(rare), 2 if last - first + 1 < len(words) else len(rare))).alias("votes"),
            F.sequence(F.lit(first), F.lit(last)).alias("must"),
        ))
    return F.array(*rows), anchors


def scan(docs: DataFrame, frequency: dict[str, int], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``found``: array of (label, base, start, share) by start.

    Columns of these names in ``docs`` are replaced.
    """
    templates, anchors = _index(frequency)
    words = F.col("_words")
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*sorted(anchors)), i)), lambda i: i.isNotNull())

    def proposals(hit: Column) -> Column:
        mine = F.filter(templates, lambda t: t["anchor"] == F.get(words, hit))
        return F.transform(mine, lambda t: F.struct(t.alias("t"), (hit - t["at"]).alias("offset")))

    def stands(c: Column, place: Column) -> Column:
        return F.coalesce(F.get(words, c["offset"] + place) == F.get(c["t"]["words"], place), F.lit(False))

    def agrees(c: Column) -> Column:
        votes = F.size(F.filter(c["t"]["rare"], lambda r: stands(c, r)))
        return (votes >= c["t"]["votes"]) & F.forall(c["t"]["must"], lambda j: stands(c, j))

    def measured(c: Column) -> Column:
        size = F.size(c["t"]["words"])
        there = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda j: stands(c, j)))
        return F.struct(c["offset"].alias("start"), c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), (there / size).alias("share"))

    proposed = F.filter(F.flatten(F.transform(hits, proposals)), agrees)
    found = F.filter(F.array_sort(F.array_distinct(F.transform(proposed, measured))), lambda m: m["share"] >= MIN_SHARE)
    kept = [F.col(c) for c in docs.columns if c not in ("n_words", "found")]
    return docs.withColumn("_words", words_of(text)).select(*kept, F.size("_words").cast("bigint").alias("n_words"), found.alias("found"))


def licence_rows(docs: DataFrame) -> DataFrame:
    """Per document the places of the base phrases and the labels of all notices."""
    found = scan(docs.select("doc_id", "text"), document_frequencies(docs)).select("doc_id", "n_words", "found")
    base = F.filter("found", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("bigint"))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
