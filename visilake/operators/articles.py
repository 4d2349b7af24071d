"""Articles: measured places, verdicts, effectiveness and taken queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L
from ..functions import words as WD
from .ranks import newest_two


def article_queries(articles: DataFrame) -> DataFrame:
    """Target and extra queries of each article, trimmed, each once, in order."""
    extra = F.coalesce("extra_queries", F.array().cast("array<string>"))
    asked = F.array_distinct(F.filter(F.transform(F.concat(F.array("target_query"), extra), lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != "")))
    return articles.select("article_id", "url", F.col("target_query").alias("target_query"), F.posexplode(asked).alias("place", "query"))


def queries_to_measure(pairs: DataFrame) -> DataFrame:
    """A query shared by several articles is measured once."""
    return pairs.select("query").distinct()


def doc_host(url: Column, domain: Column) -> Column:
    host = K.page_domain(url)
    return F.when(host != "", host).otherwise(K.bare_domain(domain))


def measure_articles(pairs: DataFrame, docs: DataFrame, run: str = "run_id") -> DataFrame:
    """Place of the very page, first place of any page of its site, and that page's address.

    A query is measured once per region and ``run``, by its newest snapshot, however many
    articles claim it: one row per article, query, region and run. Pairs that name a
    ``region`` meet the snapshots of that region only. Wizard blocks do not count as pages but
    keep their slot in the numbering. The pages of a snapshot (at most 50) travel
    with it, so articles meet their snapshots in one join, and what it makes is not dealt again.
    """
    newest = docs.groupBy("query", "region", run).agg(F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("snapshot_id"))
    docs = docs.join(newest.select("snapshot_id"), "snapshot_id", "left_semi")
    good = docs.where(~F.col("is_wizard") & F.col("error").isNull())
    found = good.groupBy("snapshot_id", "query").agg(F.collect_set(F.struct("position", "url", "domain")).alias("found"))
    host = lambda d: doc_host(d["url"], d["domain"])
    pages = F.transform("found", lambda d: F.struct(
        d["position"].alias("position"), d["url"].alias("doc_url"), host(d).alias("host"), K.article_url_key(d["url"]).alias("key")))
    on = ["query", "region"] if "region" in pairs.columns else ["query"]
    asked = pairs.select("article_id", "url", *on, K.page_domain("url").alias("host"), K.article_url_key("url").alias("key"))
    snaps = docs.select("snapshot_id", "query", "region", "fetched_at", "error").distinct()
    snaps = snaps.join(found.select("snapshot_id", "query", pages.alias("pages")), ["snapshot_id", "query"], "left")
    own = F.filter("pages", lambda d: d["host"] == F.col("host"))
    first = lambda places: F.array_min(F.transform(places, lambda d: F.struct(d["position"], d["doc_url"])))
    rows = asked.join(snaps, on).withColumn("own", own).select(
        "*", first(F.col("own")).alias("any"), F.array_min(F.transform(F.filter("own", lambda d: d["key"] == F.col("key")), lambda d: d["position"])).alias("position")
    )
    return rows.select(
        "article_id", "url", "query", "snapshot_id", "region", F.col("fetched_at").alias("checked_at"), "error",
        "position", F.col("any.position").alias("domain_position"), F.col("any.doc_url").alias("ranking_url"),
        F.coalesce(F.col("position") == F.col("any.position"), F.lit(False)).alias("is_target"),
    )


def article_verdict(position="position", domain_position="domain_position", measured: Column | None = None) -> Column:
    """Works, replaced by another own page, coming, missing; no data if never measured."""
    p, d = K._c(position), K._c(domain_position)
    ladder = (
        F.when(p <= L.ARTICLE_TOP, L.WORKS)
        .when(d.isNotNull() & (p.isNull() | (d < p)), L.REPLACED)
        .when(p <= L.ARTICLE_NEAR, L.COMING)
        .otherwise(L.MISSING)
    )
    return ladder if measured is None else F.when(measured, ladder).otherwise(L.NO_DATA)


def articles_latest(articles: DataFrame, checks: DataFrame) -> DataFrame:
    """Last check of each article's target query, the change since the previous one and the verdict.

    Articles that name a ``region`` take the checks of that region only.
    """
    on = ["article_id", "query", *(["region"] if "region" in articles.columns else [])]
    target = articles.withColumnRenamed("target_query", "query").select(*on)
    own, keys = checks.where("error IS NULL"), ["article_id", "query"]
    value = F.struct("checked_at", "id", "position", "domain_position", "ranking_url", "is_target")
    if on == keys:  # one state a key, not all its checks, is dealt to meet the articles
        both = newest_two(own, keys, value).join(target, on, "left_semi")
    else:
        both = newest_two(own.join(target, on, "left_semi"), keys, value)
    rows = articles.join(both.drop("query"), "article_id", "left")
    out = rows.select(
        *articles.columns,
        *[F.col(f"cur.{c}").alias(c) for c in ("position", "domain_position", "ranking_url", "is_target", "checked_at")],
        F.col("prev.position").alias("previous"),
        (F.col("prev.position") - F.col("cur.position")).alias("delta"),
        F.coalesce("measurements", F.lit(0)).alias("measurements"),
    )
    return out.withColumn("verdict", article_verdict(measured=F.col("checked_at").isNotNull()))


def article_effectiveness(report: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """How many articles work, come, are replaced, missing or unmeasured."""
    verdicts = (L.WORKS, L.COMING, L.REPLACED, L.MISSING, L.NO_DATA)
    return report.groupBy(*by).agg(
        F.count(F.lit(1)).alias("articles"), F.count("checked_at").alias("measured"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts],
    )


def replaced_articles(report: DataFrame) -> DataFrame:
    """Articles another own page stands in for."""
    return report.where(F.col("verdict") == L.REPLACED).select("article_id", "url", F.col("target_query").alias("query"), "ranking_url", "domain_position")


def query_is_taken(queries: DataFrame, report: DataFrame, in_work: DataFrame | None = None) -> DataFrame:
    """Is a query already served: by a published page, by work in progress, by a ranking page.

    ``queries``: query, optional exclude_id (the material that asks about its own topic);
    ``in_work``: art_id, topic. Each source is reduced to one row per stem key before it
    meets the queries.
    """
    asked = queries if "exclude_id" in queries.columns else queries.withColumn("exclude_id", F.lit(None).cast("string"))
    asked = asked.select("query", "exclude_id", WD.stem_key("query").alias("stem_key"))
    keyed = report.withColumn("stem_key", WD.stem_key("target_query"))
    claimed = keyed.groupBy("stem_key").agg(F.count(F.lit(1)).alias("claimed"), F.min("url").alias("claimed_url"))
    ranking = keyed.where(F.col("ranking_url").isNotNull() | F.col("domain_position").isNotNull()).groupBy("stem_key").agg(
        F.countDistinct("ranking_url").alias("ranking"), F.min("ranking_url").alias("ranking_url")
    )
    rows = asked.join(claimed, "stem_key", "left").join(ranking, "stem_key", "left")
    if in_work is None:
        rows = rows.withColumn("in_work", F.lit(0).cast("bigint"))
    else:
        works = in_work.select("art_id", WD.stem_key("topic").alias("stem_key"))
        counts = works.groupBy("stem_key").agg(F.count(F.lit(1)).alias("_all"))
        own = works.groupBy("stem_key", F.col("art_id").alias("exclude_id")).agg(F.count(F.lit(1)).alias("_own"))
        rows = rows.join(counts, "stem_key", "left").join(own, ["stem_key", "exclude_id"], "left").withColumn(
            "in_work", F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))
        )
    claims, work, ranks = F.coalesce("claimed", F.lit(0)), F.col("in_work"), F.coalesce("ranking", F.lit(0))
    reasons = F.array_compact(F.array(F.when(claims > 0, F.lit("claimed")), F.when(work > 0, F.lit("in_work")), F.when(ranks > 0, F.lit("ranking"))))
    return rows.select(
        "query", "stem_key", F.when(F.size(reasons) > 0, "taken").otherwise("free").alias("verdict"), reasons.alias("reasons"),
        claims.alias("claimed"), "claimed_url", work.alias("in_work"), ranks.alias("ranking"), "ranking_url",
    )


def set_published(articles: DataFrame, dates: DataFrame) -> DataFrame:
    """Registry with publication dates written to every row of a page.

    ``dates``: url, published_at. All rows of one path get the date; the previous value
    stays in ``published_before``. The site root is never matched.
    """
    new = dates.groupBy(K.normalize_path("url").alias("path_key")).agg(F.max("published_at").alias("_new"), F.lit(True).alias("_hit"))
    new = new.where("path_key <> '' AND path_key <> '/'")
    rows = articles.withColumn("path_key", K.normalize_path("url")).join(new, "path_key", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.coalesce("active", F.lit(True))
    return rows.select(
        *[c for c in articles.columns if c != "published_at"],
        F.when(hit, F.col("_new")).otherwise(F.col("published_at")).alias("published_at"),
        F.col("published_at").alias("published_before"), hit.alias("changed"),
    )
