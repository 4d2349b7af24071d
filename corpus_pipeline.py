"""A corpus pipeline over ``documents``: each stage applies one document operator to all its predecessor kept.

language    drops texts in none of the learned languages (null, empty, letterless, or too far from every profile)
near_copies keeps one document, the smallest id, of each group of copies: linked where the sets of
            five-word shingles have a similarity of 0.8 or more
leaks       drops documents that hold a benchmark passage within its edit budget
secrets     replaces secrets that look live and belong to few owners by a mark, in place
pieces      encodes what is left: the last stage returns (doc_id, n_tokens, ids)

All but the last return the columns of documents. Rows are told apart by id, length and text, so rows of
one id with different texts are judged each, equal rows become one, and null ids take part. Very long texts are
worked on whole; columns of other names are left behind; an empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visilake.llm import contamination, language, lattice, secret_scan, simhash
from visilake.llm.base import stored, whole_text

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: score (one minus the share of the largest distance) below which a text of so many letters is in no learned
#: language; of 10 000 test documents, mixed and damaged ones included, none is under 0.37, and strange scripts are near 0
MIN_SCORE, MIN_LETTERS = 0.25, 20
SHINGLE_WORDS = 5
#: permutations whose least shingle is a key; texts of similarity 0.8 share one of six but for 0.2^6
KEYS = 6
#: similarity (shared shingles of all different ones) from which texts are copies, as a fraction
SIMILAR = (4, 5)
#: of 64 and of 256 bits, the most in which texts may differ to have their shingles compared: at similarity
#: 0.8 some 10 and 39 are expected (12 and 48 for the shortest texts), four or more deviations fewer
CANDIDATE_BITS = 24
NEAR_BITS = 72
#: benchmark items of fewer words stand in clean documents too
LEAK_WORDS = 3
MARK = "[secret]"


def _named(docs: DataFrame) -> DataFrame:
    """Documents with the name of their row: the id, and the length and a hash of the text."""
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.char_length(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("print"))
    return docs.select(*COLUMNS, name.alias("row_name"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the learned languages: without a letter, or too far from every profile.

    A text of fewer than ``MIN_LETTERS`` letters says too little to be dropped for its distance. If no row
    teaches a language, every document with a letter stays.
    """
    profiles = language.train_profiles(language.learned_rows(docs))
    if not profiles:
        return docs.where(language.has_letter()).select(*COLUMNS)
    judged = language.identify(docs.select(*COLUMNS), profiles).where("lang_pred <> 'und'")
    return judged.where((F.col("score") >= MIN_SCORE) | (F.regexp_count("text", F.lit(r"\p{L}")) < MIN_LETTERS)).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, one row of equal rows."""
    named = _named(docs)
    grouped = simhash.similar_groups(named, SHINGLE_WORDS, 4, KEYS, CANDIDATE_BITS, NEAR_BITS, SIMILAR, doc_id="row_name")
    kept = grouped.where("doc_id = component_id").select(F.col("doc_id").alias("row_name")).distinct()
    return named.join(kept, "row_name").dropDuplicates(["row_name"]).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a region within a benchmark item's edit budget; items of a word or two don't count."""
    named = _named(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.size(F.split(F.trim("text"), r"\s+")) >= LEAK_WORDS)
    found = contamination.find(named, items, doc_id="row_name")
    return named.join(found.select(F.col("doc_id").alias("row_name")).distinct(), "row_name", "left_anti").select(*COLUMNS)


def mask_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every live secret of a document by a mark; no document goes."""
    live = secret_scan.scan(docs.select(*COLUMNS)).where("live")
    longest_first = F.transform(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("secret").alias("n"), "secret")))), lambda s: s["secret"])
    held = live.groupBy("row_key").agg(longest_first.alias("secrets"))
    # rows that share a key share a list; only what a text holds is replaced in it
    joined = docs.select(*COLUMNS, F.xxhash64("doc_id", whole_text()).alias("row_key")).join(held, "row_key", "left")
    masked = F.aggregate("secrets", F.col("text"), lambda text, secret: F.replace(text, secret, F.lit(MARK)))
    done = joined.withColumn("text", F.when(F.col("secrets").isNull(), F.col("text")).otherwise(masked))
    size = F.when(F.col("secrets").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return done.withColumn("n_chars", size).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    ids = lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_copies),
    ("leaks", drop_benchmark_leaks),
    ("secrets", mask_live_secrets),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
