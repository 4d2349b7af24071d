"""Registered document queries: name → (DataFrame builder, SQL twin or None)."""

from __future__ import annotations

import public_tokenizers

from . import bitplane, contamination, language, lattice, licences, negatives, sampling, secret_scan, shards, simhash, spelling, url_filter, windows
from .twins import NEGATIVE_SQL, SHARD_SQL, SPELLING_SQL, URL_SQL


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark, sf_dir):
    return language.predict_languages(documents(spark, sf_dir))


def op2_token_planes(spark, sf_dir, tokenizer=None):
    return bitplane.token_rows(documents(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_shards(spark, sf_dir):
    return shards.shard_by_bytes(documents(spark, sf_dir))


def op4_simhash_vantage(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_licences(spark, sf_dir):
    return licences.licence_rows(documents(spark, sf_dir))


def op6_weighted_sampling(spark, sf_dir):
    return sampling.fingerprint_rows(documents(spark, sf_dir))


def op7_word_windows(spark, sf_dir):
    return windows.repeat_rows(documents(spark, sf_dir))


def op8_benchmark_leaks(spark, sf_dir):
    return contamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secret_owners(spark, sf_dir):
    return secret_scan.secret_rows(documents(spark, sf_dir))


def op10_piece_lattice(spark, sf_dir, model=None):
    return lattice.encoded_rows(documents(spark, sf_dir), model or public_tokenizers.path("piece_bpe_32k.model"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.variant_rows(documents(spark, sf_dir))


def op12_url_cascade(spark, sf_dir):
    return url_filter.verdict_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_hard_negatives(spark, sf_dir):
    return negatives.negative_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_language": (op1_language, None),
    "op2_token_planes": (op2_token_planes, None),
    "op3_byte_shards": (op3_byte_shards, SHARD_SQL),
    "op4_simhash_vantage": (op4_simhash_vantage, None),
    "op5_licences": (op5_licences, None),
    "op6_weighted_sampling": (op6_weighted_sampling, None),
    "op7_word_windows": (op7_word_windows, None),
    "op8_benchmark_leaks": (op8_benchmark_leaks, None),
    "op9_secret_owners": (op9_secret_owners, None),
    "op10_piece_lattice": (op10_piece_lattice, None),
    "op11_spelling_variants": (op11_spelling_variants, SPELLING_SQL),
    "op12_url_cascade": (op12_url_cascade, URL_SQL),
    "op13_hard_negatives": (op13_hard_negatives, NEGATIVE_SQL),
}
