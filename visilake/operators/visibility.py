"""Visibility in AI answers: citations, rivals, history and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.keys import let
from ..sources.answers import is_redirect_host


def _with_spellings(rows: DataFrame) -> DataFrame:
    """Both spellings of each row's own domain, worked out once per distinct domain."""
    known = rows.select("domain").distinct()
    one, two = K.spellings_of("domain")
    known = known.select(F.col("domain").alias("_of"), one.alias("_unicode"), two.alias("_ascii"))
    return rows.join(known, F.col("domain").eqNullSafe(F.col("_of")), "left").drop("_of")


def _distinct_sources(sources: Column) -> Column:
    """Repeated sources folded into the first one; any use makes it used."""
    keyed = F.transform(
        sources,
        lambda s: F.struct(
            F.concat(s["url"], F.lit("|"), F.coalesce(F.nullif(s["hint"], F.lit("")), F.when(s["url"] != "", F.lit("")).otherwise(s["title"]))).alias("key"),
            s.alias("s"),
        ),
    )

    def fold(k: Column) -> Column:
        names = F.transform(k, lambda x: x["key"])
        firsts = F.filter(k, lambda x, i: F.array_position(names, x["key"]) == i + 1)

        # each address is taken apart once; what follows works on its hosts
        parted = F.transform(firsts, lambda x: F.struct(
            x["key"].alias("key"), x["s"].alias("s"), K.host_of(x["s"]["url"]).alias("host"), K.host_of(x["s"]["hint"]).alias("hinted")))

        def one(x: Column, i: Column) -> Column:
            s = x["s"]
            return F.struct(
                (i + 1).cast("int").alias("position"),
                s["url"].alias("url"),
                F.trim(s["title"]).alias("title"),
                K.registered_of(F.when(x["hinted"] != "", x["hinted"]).otherwise(x["host"])).alias("domain"),
                F.when(F.exists(k, lambda y: (y["key"] == x["key"]) & F.coalesce(y["s"]["used"], F.lit(False))), F.lit(True))
                .otherwise(s["used"]).alias("used"),
                x["host"].alias("host"),
            )

        return F.transform(parted, one)

    return let(keyed, fold)


def resolve_citations(answers: DataFrame, domain: str | None = None, mode: str = "site") -> DataFrame:
    """Where our domain stands in each answer.

    ``domain`` is a literal, or None to use the ``domain`` column; an internationalised
    domain counts in either spelling. Everything is worked out inside the answer row.
    """
    if domain is None:
        answers = _with_spellings(answers)

    def ours_in(host: Column, how: str) -> Column:
        return K.host_matches(host, domain, how) if domain is not None else K.host_matches_column(host, (F.col("_unicode"), F.col("_ascii")), how)

    def mark(s: Column) -> Column:
        by_url = (s["url"] != "") & ~is_redirect_host(s["host"]) & ours_in(s["host"], mode)
        return F.struct(
            *[s[f].alias(f) for f in ("position", "url", "title", "domain", "used")],
            (by_url | ((s["domain"] != "") & ours_in(s["domain"], mode))).alias("ours"),
        )

    text = F.lower("text")
    if domain is None:
        own = K.host_of("domain")
        mentioned = (own != "") & (F.contains(text, F.col("_unicode")) | F.contains(text, F.col("_ascii")))
    else:
        names = K.host_spellings(domain)
        own = F.lit(names[-1])
        mentioned = F.lit(False)
        for name in names:
            mentioned = mentioned | (F.lit(name != "") & F.contains(text, F.lit(name)))
    rows = answers.withColumn("sources", _distinct_sources(F.col("sources")))
    rows = rows.withColumn("sources", F.transform("sources", mark))
    hits = F.filter("sources", lambda s: s["ours"])
    best = F.get(F.filter("sources", lambda s: s["ours"] & (F.coalesce(s["used"], F.lit(True)))), F.lit(0))
    keep = [c for c in rows.columns if c not in ("sources", "domain", "_unicode", "_ascii")]
    return rows.select(
        *keep,
        own.alias("domain"),
        "sources",
        best.isNotNull().alias("cited"),
        best["url"].alias("cited_url"),
        best["position"].alias("cited_position"),
        (F.size(hits) > 0).alias("in_sources"),
        mentioned.alias("mentioned"),
        F.size("sources").alias("sources_count"),
        F.size(F.filter("sources", lambda s: F.coalesce(s["used"], F.lit(True)))).alias("used_count"),
    )


def rival_domains(resolved: DataFrame, n: int = 3) -> DataFrame:
    """Domains of the used sources other than ours, most frequent first, ``n`` per answer."""
    resolved = _with_spellings(resolved)
    others = F.transform(
        F.filter(
            "sources",
            lambda s: F.coalesce(s["used"], F.lit(True)) & (s["domain"] != "") & (s["domain"] != F.col("domain"))
            & ~K.host_matches_column(s["domain"], (F.col("_unicode"), F.col("_ascii"))),
        ),
        lambda s: s["domain"],
    )

    def rank(found: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.array_distinct(found),
                lambda d, i: F.struct(
                    (-F.size(F.filter(found, lambda x: x == d))).alias("minus"), i.alias("seen"), d.alias("domain")
                ),
            )
        )

    ranked = F.transform(F.slice(let(others, rank), 1, n), lambda r: F.struct(r["domain"].alias("domain"), (-r["minus"]).alias("count")))
    return resolved.withColumn("rivals", ranked).drop("_unicode", "_ascii")


def visibility_history(checks: DataFrame, domain=None, query=None, provider=None, limit: int = 50) -> DataFrame:
    """Checks, newest first."""
    for name, value in (("domain", domain), ("query", query), ("provider", provider)):
        if value is not None:
            checks = checks.where(F.col(name) == value)
    return checks.orderBy(F.desc("checked_at"), F.desc("id")).limit(limit)


def citation_share(checks: DataFrame, top: int = 3) -> DataFrame:
    """Runs, errors, citations, share of the good runs and frequent rivals by query and provider.

    ``rivals`` of a check is an array of domains. Rivals are counted before they are
    ranked, so a hot query reaches the ranking as one row per domain.
    """
    keys = ["query", "provider"]
    good = F.col("error").isNull()
    totals = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~good).alias("errors"),
        F.count_if(good & F.col("cited")).alias("cited"),
        F.max("checked_at").alias("last_run"),
    ).withColumn("share", F.bround(F.lit(100.0) * F.col("cited") / F.nullif(F.col("runs") - F.col("errors"), F.lit(0)), 0).cast("int"))
    counted = (
        checks.where(good)
        .select(*keys, "checked_at", "id", F.posexplode("rivals").alias("place", "rival"))
        .groupBy(*keys, "rival")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("checked_at", "id", (-F.col("place")).alias("place"))).alias("seen"))
    )
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("seen"), "rival")
    best = (
        counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rival", "n"))), lambda r: r["rival"]).alias("rivals"))
    )
    return totals.join(best, keys, "left")


def visibility_table(resolved: DataFrame) -> DataFrame:
    """Verdict of each answer: error, yes, in sources but not used, no."""
    verdict = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("cited"), "cited")
        .when(F.col("in_sources"), "in_sources").otherwise("no")
    )
    return resolved.withColumn("verdict", verdict).withColumn("named_in_text", F.col("mentioned") & ~F.col("cited"))


def visibility_totals(resolved: DataFrame) -> DataFrame:
    """Cited in how many of the good answers."""
    good = F.col("error").isNull()
    return resolved.groupBy().agg(
        F.count_if(good).alias("answers"),
        F.count_if(good & F.col("cited")).alias("cited"),
        F.count_if(~good).alias("errors"),
    )
