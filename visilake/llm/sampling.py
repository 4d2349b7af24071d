"""Consistent weighted sampling of word counts, in DataFrame operations only.

A document is its weighted terms: lower-cased words with their counts. For each of ``SAMPLES``
samples every term draws r and c from Gamma(2, 1) and b from [0, 1) by hashes of (term, sample);
with t = floor(ln(weight) / r + b) the term's value is ln(c) - r (t - b + 1), and the least value
wins. A winner's value is equal in two documents if and only if (term, t) is, which happens with
probability equal to the generalised Jaccard similarity of the weights. The signature holds 32
bits of each winner; likeness is the share of equal samples.

Counting is row-local (sorted hashes of the words), so only signatures meet in aggregates. The
edited text needs the next document's first characters: a narrow table of ids is put in global
order by range blocks, and the asked-for prefixes alone move to their askers.

Null texts count as empty. Texts without a word share one signature, which equals only its like.
Next goes by descending id, then by a hash of the text; equal rows count as one document in that
order and each row is returned; a null id comes last. A single document is its own next. Very long texts
are read whole. An empty table gives no rows; columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import in_blocks, stored, whole_text
from .licences import words_of

SAMPLES = 32
STEP = 8
NO_ID = -(1 << 63)


def term_weights(text: str) -> Column:
    """Array of (term hash, ln count) of a text column, each term once."""
    hashes = F.sort_array(F.transform(words_of(text), lambda w: F.xxhash64(w)))
    first = lambda h: F.filter(F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
    # one-element arrays bind the hashes and the places once
    bound = F.transform(F.array(hashes), lambda h: F.struct(h.alias("h"), F.coalesce(first(h), F.array().cast("array<int>")).alias("at")))
    runs = F.transform(bound, lambda b: F.transform(b["at"], lambda s, j: F.struct(
        F.get(b["h"], s).alias("term"), F.log((F.coalesce(F.get(b["at"], j + 1), F.size(b["h"])) - s).cast("double")).alias("weight"))))
    return F.element_at(runs, 1)


def _uniform(bits: Column) -> Column:
    return (bits.cast("double") + 0.5) * F.lit(2.0**-32)


def _two(h: Column) -> Column:
    """The product of two uniforms from the halves of a hash."""
    return _uniform(h.bitwiseAND(F.lit(0xFFFFFFFF))) * _uniform(F.shiftrightunsigned(h, 32))


def sample_value(term: Column, weight: Column, sample: Column) -> Column:
    """What a term with this ln(weight) bids for a sample; the least bid wins."""
    r = -F.log(_two(F.xxhash64(term, sample)))
    c = F.log(-F.log(_two(F.xxhash64(term, sample + 1000))))
    b = F.shiftrightunsigned(F.xxhash64(term, sample + 2000), 11).cast("double") * F.lit(2.0**-53)
    return c - r * (F.floor(weight / r + b) - b + 1)


def signatures(rows: DataFrame, *keys: str, text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, print): the hexadecimal signature of each key's text; rows of a key share a text.

    If ``rows`` are dealt by some of the keys already, nothing moves again.
    """
    terms = rows.select(*keys, F.explode_outer(term_weights(text)).alias("t"))
    steps = terms.select(*keys, "t.term", "t.weight", F.explode(F.sequence(F.lit(0), F.lit(samples - STEP), F.lit(STEP))).alias("step"))
    bids = steps.select(*keys, "step", *[sample_value(F.col("term"), F.col("weight"), F.col("step") + j).alias(f"v{j}") for j in range(STEP)])
    won = bids.groupBy(*keys, "step").agg(*[F.min(f"v{j}").alias(f"v{j}") for j in range(STEP)])
    sign = F.concat(*[F.substring(F.lpad(F.hex(F.xxhash64(F.coalesce(f"v{j}", F.lit(0.0)))), 16, "0"), 9, 8) for j in range(STEP)])
    parts = won.select(*keys, "step", sign.alias("sign")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "sign"))).alias("parts"))
    return parts.select(*keys, F.lower(F.array_join(F.col("parts.sign"), "")).alias("print"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of samples in which two signatures agree."""
    same = lambda i: F.substring(F.col(a), 8 * i + 1, 8) == F.substring(F.col(b), 8 * i + 1, 8)
    return sum((same(i).cast("int") for i in range(samples)), F.lit(0)) / F.lit(float(samples))


def with_next(rows: DataFrame) -> DataFrame:
    """(id, row_key, n, copies, next_id, next_key), a row per different document."""
    narrow = rows.groupBy("id", "row_key").agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).cast("bigint").alias("n"))
    blocks = in_blocks(narrow, F.desc("id"), F.asc("row_key"))
    order = W.partitionBy("block").orderBy(F.desc("id"), "row_key")
    me = F.struct("id", "row_key")
    inside = blocks.select("*", F.lead(me).over(order).alias("after"), F.row_number().over(order).alias("place"))
    # one row a block: the head of the next block, and of the first one after the last
    along = W.orderBy("block")
    heads = inside.where("place = 1").select("block", me.alias("head"))
    heads = heads.select("block", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("head"))
    return inside.join(heads, "block").select("id", "row_key", "n", "copies", F.coalesce("after", "head").alias("next")).select(
        "id", "row_key", "n", "copies", F.col("next.id").alias("next_id"), F.col("next.row_key").alias("next_key")
    )


def fingerprint_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its signature, its edited text's, and their likeness to it and its next."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), whole_text(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "text"))
    key = ["id", "row_key"]
    asks = stored(with_next(rows), "asks")
    wanted = asks.select(F.col("id").alias("ask_id"), F.col("row_key").alias("ask_key"), F.col("next_id").alias("id"), F.col("next_key").alias("row_key"), F.expr("n div 3").cast("int").alias("part"))
    moved = rows.join(wanted, key).select(F.col("ask_id").alias("id"), F.col("ask_key").alias("row_key"), F.expr("substring(text, 1, part)").alias("moved"))
    moved = moved.groupBy(*key).agg(F.max("moved").alias("moved"))
    both = rows.join(asks.select(*key, "n"), key).join(moved, key)
    edited = F.concat(F.expr("substring(text, 1, cast(n - n div 3 as int))"), "moved")
    sides = both.select(*key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))).alias("s"))
    sides = sides.select(*key, "s.side", "s.text")
    printed = signatures(sides.select(*key, F.struct("side", F.when(F.col("side") == 1, F.sha2("text", 256)).alias("sha")).alias("what"), "text"), *key, "what")
    pick = lambda side, c: F.max(F.when(F.col("what.side") == side, F.col(c)))
    prints = stored(printed.groupBy(*key).agg(
        pick(0, "print").alias("fingerprint"), pick(1, "print").alias("edited_fingerprint"), pick(1, "what.sha").alias("edited_sha256")), "prints")
    following = prints.select(F.col("id").alias("next_id"), F.col("row_key").alias("next_key"), F.col("fingerprint").alias("next_print"))
    told = asks.join(prints, key).join(following, ["next_id", "next_key"])
    done = told.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_print").alias("near_next"), "copies",
    )
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies")
