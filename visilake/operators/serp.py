"""Result-page composition: competition, competitors, gaps and keyword metrics.

``docs`` rows carry their snapshot's query, region, fetched_at and error. Organic places
are stored with the document, so "the first N sites" is a filter, not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L


def top_sites(docs: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` documents that are sites."""
    return docs.where(~F.col("is_wizard") & (F.col("organic_position") <= top))


def competition_band(score) -> Column:
    score = K._c(score)
    return (
        F.when(score.isNull(), L.BAND_NONE).when(score < L.BAND_LOW_BELOW, L.BAND_LOW)
        .when(score <= L.BAND_MIDDLE_UP_TO, L.BAND_MIDDLE).otherwise(L.BAND_HIGH)
    )


def competition_factors(docs: DataFrame, as_of, top: int = 10) -> DataFrame:
    """The five factors per snapshot, from one aggregation of at most ``top`` documents."""
    moment = K.moment(as_of)
    fresh_from = F.add_months(moment, -12 * L.FRESH_YEARS).cast("timestamp") + (
        F.expr("make_dt_interval(0, 0, 0, 0)") + (moment - F.date_trunc("day", moment))
    )
    modified = K.parse_modtime("modtime")
    fit = F.least(F.col("title_hlwords") / K.query_words("query"), F.lit(1.0))
    grouped = top_sites(docs, top).groupBy("snapshot_id", "query", "region").agg(
        F.count(F.lit(1)).alias("docs_analysed"),
        F.avg(fit).alias("title_fit"),
        F.percentile("domain_doccount", F.lit(0.5)).alias("_median"),
        F.avg(K.is_portal("domain").cast("int")).alias("portal_share"),
        F.avg((F.col("url_depth") == 0).cast("int")).alias("homepage_share"),
        F.count(modified).alias("_dated"),
        F.count_if(modified >= fresh_from).alias("_fresh"),
    )
    return grouped.withColumns(
        {
            "depth_coverage": F.least(F.log10(F.greatest(F.col("_median"), F.lit(1.0)) + 1) / 3, F.lit(1.0)),
            "freshness": F.when(F.col("_dated") > 0, F.col("_fresh") / F.col("_dated")).otherwise(F.lit(0.5)),
        }
    ).drop("_median", "_dated", "_fresh")


def competition_score(docs: DataFrame, as_of, top: int = 10, snapshots: DataFrame | None = None, our_domain: str | None = None) -> DataFrame:
    """Score 0..100 per snapshot; contributions are rounded before they are summed.

    With ``snapshots`` every snapshot gets a row: failed ones and those without sites have
    no score and the band "no data".
    """
    good = docs.where("error IS NULL")
    scored = competition_factors(good, as_of, top)
    parts = [F.round(F.col(name) * weight * 100, 1) for name, weight in L.WEIGHTS.items()]
    score = F.round(sum(parts[1:], parts[0]), 1)
    out = scored.select(
        "snapshot_id", "query", "region", "docs_analysed",
        *[F.round(name, 3).alias(name) for name in L.WEIGHTS],
        *[p.alias(f"{name}_points") for name, p in zip(L.WEIGHTS, parts)],
        score.alias("score"),
    )
    if our_domain is not None:
        from .ranks import domain_hits

        ours = domain_hits(good, our_domain).select("snapshot_id", F.col("rank").alias("our_position"))
        out = out.join(ours, "snapshot_id", "left")
    else:
        out = out.withColumn("our_position", F.lit(None).cast("int"))
    if snapshots is not None:
        base = snapshots.select("snapshot_id", "query", "region", F.col("fetched_at").alias("calculated_at"), "error")
        out = base.join(out.drop("query", "region"), "snapshot_id", "left").withColumn(
            "error", F.coalesce("error", F.when(F.col("score").isNull(), F.lit("no usable documents")))
        )
    return out.withColumn("band", competition_band("score"))


def serp_competitors(docs: DataFrame, top: int = 10) -> DataFrame:
    """Domains that recur in the tops of a set of queries.

    The queries behind a domain are rows of :func:`serp_competitor_queries`, not a list: a
    platform domain may stand on most of them.
    """
    rows = top_sites(docs.where("error IS NULL"), top).withColumn("domain", K.bare_domain("domain")).where("domain <> ''")
    by_query = rows.groupBy("domain", "query").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("best"), F.sum("position").alias("total")
    )
    return (
        by_query.groupBy("domain")
        .agg(
            F.sum("n").alias("appearances"), F.count(F.lit(1)).alias("queries"), F.min("best").alias("best_position"),
            F.round(F.sum("total") / F.sum("n"), 1).alias("avg_position"),
        )
        .withColumn("is_portal", K.is_portal("domain"))
        .orderBy(F.desc("appearances"), "avg_position", "domain")
    )


def serp_competitor_queries(docs: DataFrame, top: int = 10) -> DataFrame:
    """(domain, query) pairs behind :func:`serp_competitors`, with the best place."""
    rows = top_sites(docs.where("error IS NULL"), top).withColumn("domain", K.bare_domain("domain")).where("domain <> ''")
    return rows.groupBy("domain", "query").agg(F.min("position").alias("best_position"), F.count(F.lit(1)).alias("appearances"))


def top_domains(docs: DataFrame, region=None, since=None, limit: int = 25) -> DataFrame:
    """Who turns up most often in the collected snapshots."""
    rows = docs.where("error IS NULL")
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if since is not None:
        rows = rows.where(F.col("fetched_at") >= K.moment(since))
    by_query = rows.groupBy("domain", "query").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("best"), F.sum("position").alias("total")
    )
    return (
        by_query.groupBy("domain")
        .agg(
            F.sum("n").alias("hits"), F.min("best").alias("best"),
            F.round(F.sum("total") / F.sum("n"), 1).alias("avg_position"), F.count("query").alias("queries"),
        )
        .orderBy(F.desc("hits"), "avg_position", "domain")
        .limit(limit)
    )


def domain_queries(docs: DataFrame, domain: str, region=None, limit: int | None = None) -> DataFrame:
    """Queries a domain was seen for: best and last place, last date, hits."""
    rows = docs.where(F.col("error").isNull() & (K.bare_domain("domain") == domain.lower().removeprefix("www.")))
    if region is not None:
        rows = rows.where(F.col("region") == region)
    out = rows.groupBy("query").agg(
        F.min("position").alias("best_position"),
        F.max_by("position", F.struct("fetched_at", "snapshot_id", -F.col("position"))).alias("last_position"),
        F.max("fetched_at").alias("checked_at"),
        F.count(F.lit(1)).alias("hits"),
    )
    out = out.orderBy("best_position", "query")
    return out if limit is None else out.limit(limit)


def competitor_gap(docs: DataFrame, ours: str, theirs: str, region=None, limit: int | None = None) -> DataFrame:
    """A rival's queries with our place beside it; what we miss comes first. A limit cuts the finished list."""
    their = domain_queries(docs, theirs, region).select(
        "query", F.coalesce(F.nullif(F.col("last_position"), F.lit(0)), "best_position").alias("their_position")
    )
    our = domain_queries(docs, ours, region).select("query", F.col("last_position").alias("our_position"))
    ahead = (
        F.when(F.col("our_position").isNull(), "missing").when(F.col("our_position") < F.col("their_position"), "we")
        .when(F.col("our_position") > F.col("their_position"), "they").otherwise("equal")
    )
    gap = (
        their.join(our, "query", "left").withColumn("ahead", ahead)
        .orderBy(F.col("our_position").isNotNull(), F.coalesce("their_position", F.lit(999)), "query")
    )
    return gap if limit is None else gap.limit(limit)


def keyword_metrics(frequencies: DataFrame, competition: DataFrame, positions: DataFrame, min_freq: int = 0, limit: int | None = None) -> DataFrame:
    """Demand beside competition and our place; a side that is missing stays NULL.

    ``frequencies``: phrase, freq, optional seed (then ``limit`` is per seed).
    """
    score = competition.select("query_key", "score", "band").dropDuplicates(["query_key"])
    place = positions.groupBy(K.squeezed("query").alias("query_key")).agg(F.max_by("position", F.struct("checked_at", "query")).alias("our_position"))
    rows = frequencies.where(F.coalesce("freq", F.lit(0)) >= min_freq) if min_freq else frequencies
    if limit is not None:
        order = [F.desc_nulls_last("freq"), F.asc("phrase")]
        if "seed" in rows.columns:
            rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
        else:
            rows = rows.orderBy(*order).limit(limit)
    return (
        rows.withColumn("query_key", K.squeezed("phrase"))
        .join(score, "query_key", "left").join(place, "query_key", "left").drop("query_key")
    )
