"""Roll-ups against counts over the documents themselves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from visilake.operators import rollups as RU
from visilake.operators import serp as S

DOCS = "query string, region int, fetched_at timestamp, error string, domain string, position int"


def made(spark, seed, n, first_query=0):
    rnd = random.Random(seed)
    rows = [
        (f"q{first_query + rnd.randrange(60)}", rnd.choice([1, 2, None]), dt.datetime(2024, 1, rnd.randrange(1, 9), rnd.randrange(24), rnd.randrange(60)),
         rnd.choice([None, None, None, "timeout"]), rnd.choice(["a.ru", "b.ru", "c.ru", "", None]), rnd.randrange(1, 30)) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, 1, dt.datetime(2024, 1, 3), None, "a.ru", 5)], DOCS)


def answers(df):
    return {r["domain"]: (r["hits"], r["best"], r["avg_position"], r["queries"]) for r in df.collect()}


def counted(docs, region, since):
    rows = docs.where("error IS NULL")
    rows = rows if region is None else rows.where(F.col("region") == region)
    rows = rows if since is None else rows.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    return answers(rows.groupBy("domain").agg(F.count("*").alias("hits"), F.min("position").alias("best"), F.round(F.avg("position"), 1).alias("avg_position"), F.countDistinct("query").alias("queries")))


@pytest.mark.parametrize("since", [None, "2024-01-01", "2024-01-04", "2024-01-04 13:30:00", "2024-01-08 23:59:59", "2025-01-01"])
def test_any_range_equals_a_count_of_the_documents(spark, since):
    early, late = made(spark, 1, 400), made(spark, 2, 300, first_query=40)  # some queries are known, some new
    codes = RU.query_codes(early).cache()
    rollup = RU.daily_rollup(early, codes)
    more = RU.query_codes(late, codes).cache()
    assert more.join(codes, ["query", "code"]).count() == codes.count()  # codes never change
    assert sorted(r["code"] for r in more.collect()) == list(range(more.count()))
    both = rollup.unionByName(RU.daily_rollup(late, more))
    docs = early.unionByName(late)
    for region in (None, 1):
        assert answers(RU.domains_since(both, region, since, docs, more)) == counted(docs, region, since)
    if since is None:
        kept = [tuple(r) for r in RU.top_domains_since(both, 1, limit=2).collect()]
        assert kept == [tuple(r) for r in S.top_domains(docs, 1, limit=2).select("domain", "hits", "best", "avg_position", "queries").collect()]


def test_queries_beyond_one_bucket_and_odd_input(spark):
    docs = spark.range(70_000).select(F.concat(F.lit("q"), "id").alias("query"), F.lit(1).alias("region"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"), F.lit(None).cast("string").alias("error"), F.lit("a").alias("domain"), F.lit(1).alias("position"))
    codes = RU.query_codes(docs)
    assert answers(RU.domains_since(RU.daily_rollup(docs, codes))) == {"a": (70_000, 1, 1.0, 70_000)}
    assert RU.domains_since(RU.daily_rollup(docs.limit(0), codes)).collect() == []
    assert RU.query_codes(docs.limit(0), codes.limit(0)).collect() == []
    with pytest.raises(ValueError):
        RU.domains_since(RU.daily_rollup(docs, codes), since="2024-01-01 10:00:00")
