"""Daily roll-ups of result documents that answer "since when" questions without the documents.

A roll-up row holds, for a day, a region and a domain, what adds up (appearances, best place, sum of
places) and the exact set of queries as a bitmap of their codes, in buckets of 32 768. Sets of
several days are united bit by bit, so a query seen on many days counts once. Codes come
from a dictionary that only grows, so days rolled up earlier stay valid when later loads bring
new queries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..session import checkpointed


def query_codes(queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query, code): ``known`` codes and the next free numbers for queries that have none.

    New queries are dealt by range and numbered block by block: only one row a block meets in the
    ordered sum. Null queries have no code.
    """
    new = queries.select("query").where("query IS NOT NULL").distinct()
    first = 0
    if known is not None:
        new = new.join(known.select("query"), "query", "left_anti")
        first = known.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    blocks = checkpointed(new.repartitionByRange("query").withColumn("_block", F.spark_partition_id()))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("_block").orderBy("query"))
    coded = blocks.withColumn("_n", place).join(sizes, "_block").select("query", (F.lit(first) + F.col("_before") + F.col("_n") - 1).cast("long").alias("code"))
    return coded if known is None else known.select("query", "code").unionByName(coded)


def daily_rollup(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(day, region, domain, bucket, hits, best, total, queries) of the documents of good snapshots."""
    rows = docs.where("error IS NULL").select(F.to_date("fetched_at").alias("day"), "region", "domain", "query", "position")
    # a row a query first, so that a bitmap is built from different queries only
    by_query = rows.groupBy("day", "region", "domain", "query").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("best"), F.sum("position").alias("total"))
    coded = by_query.join(codes, "query", "left")
    keys = ["day", "region", "domain", F.coalesce(F.bitmap_bucket_number("code"), F.lit(-1)).alias("bucket")]
    return coded.groupBy(*keys).agg(
        F.sum("n").alias("hits"), F.min("best").alias("best"), F.sum("total").alias("total"),
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("queries"),
    )


def domains_since(rollup: DataFrame, region=None, since=None, docs: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """(domain, hits, best, avg_position, queries) from a moment on, of one region or of all.

    Whole days come from the roll-up. If ``since`` falls inside a day, that day's documents are read,
    for which ``docs`` and ``codes`` are needed.
    """
    rows = rollup
    if since is not None:
        moment = dt.datetime.fromisoformat(str(since))
        whole = moment.date() if moment.time() == dt.time() else moment.date() + dt.timedelta(days=1)
        rows = rows.where(F.col("day") >= F.lit(whole))
        if whole != moment.date():
            if docs is None or codes is None:
                raise ValueError("documents and codes are needed for a moment inside a day")
            edge = docs.where((F.col("fetched_at") >= K.moment(since)) & (F.col("fetched_at") < F.lit(whole).cast("timestamp")))
            rows = rows.unionByName(daily_rollup(edge, codes))
    if region is not None:
        rows = rows.where(F.col("region") == region)
    merged = rows.groupBy("domain", "bucket").agg(
        F.sum("hits").alias("hits"), F.min("best").alias("best"), F.sum("total").alias("total"), F.bitmap_or_agg("queries").alias("queries"))
    return merged.groupBy("domain").agg(
        F.sum("hits").alias("hits"), F.min("best").alias("best"), F.round(F.sum("total") / F.sum("hits"), 1).alias("avg_position"),
        F.sum(F.when(F.col("bucket") >= 0, F.bitmap_count("queries")).otherwise(0)).alias("queries"))


def top_domains_since(rollup: DataFrame, region=None, since=None, limit: int = 25, docs: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """:func:`~visilake.operators.serp.top_domains` from a roll-up."""
    return domains_since(rollup, region, since, docs, codes).orderBy(F.desc("hits"), "avg_position", "domain").limit(limit)
