"""Site audit over tables of page facts, for all sites at once.

Inputs: ``pages`` from :func:`visilake.sources.html.page_facts` (write it to a table or
checkpoint it first: every rule reads it, and the HTML should be parsed once),
``sitemap(site, url)`` and ``disallowed(site, url)``. Every finding is
``(site, severity, code, url, evidence)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L

FINDING = ("site", "severity", "code", "url", "evidence")


def _finding(severity: str, code: str, evidence: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), evidence.cast("string").alias("evidence"))


def _rows(pages: DataFrame, rules: list[Column]) -> DataFrame:
    """One pass: each page yields the rules it breaks."""
    return pages.select("site", "url", F.inline(F.array_compact(F.array(*rules)))).select(*FINDING)


def short_url(url) -> Column:
    """Path with query."""
    rest = F.regexp_replace(K._c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def auditable() -> Column:
    return F.col("error").isNull() & F.col("status").isNotNull() & F.col("status").between(200, 299)


def closed() -> Column:
    return F.coalesce(F.contains(F.lower("robots_meta"), F.lit("noindex")), F.lit(False))


def keyed(urls: DataFrame) -> DataFrame:
    """Distinct page keys of an address list."""
    return urls.select("site", K.dedup_key("url").alias("page_key")).distinct()


def incoming_links(pages: DataFrame) -> DataFrame:
    """Edges of the internal link graph: (site, target_key, source_url); self-links are out."""
    return (
        pages.select("site", F.col("url").alias("source_url"), "page_key", F.explode("internal_links").alias("link"))
        .select("site", "source_url", "page_key", K.dedup_key("link").alias("target_key"))
        .where("target_key <> page_key")
        .select("site", "target_key", "source_url")
    )


def link_counts(pages: DataFrame) -> DataFrame:
    """Incoming links and linking pages of every target; combined before the shuffle."""
    return incoming_links(pages).groupBy("site", "target_key").agg(
        F.count(F.lit(1)).alias("links"), F.min("source_url").alias("first_source")
    )


def availability_findings(pages: DataFrame) -> DataFrame:
    """No answer, 5xx, broken or unlinked 4xx pages, and redirect chains."""
    hops = F.size("redirect_chain")
    status = F.col("status")
    own = _rows(
        pages,
        [
            F.when(status.isNull(), _finding("critical", "page-unavailable", F.coalesce("error", F.lit("no answer")))),
            F.when(status >= 500, _finding("critical", "page-unavailable", F.concat(F.lit("HTTP "), status.cast("string")))),
            F.when(hops > L.MAX_REDIRECT_HOPS, _finding("critical", "redirect-chain", F.concat(hops.cast("string"), F.lit(" hops: "), F.concat_ws(" > ", "url", "redirect_chain")))),
        ],
    )
    gone = pages.where(status.between(400, 499)).select("site", "url", "page_key", "status")
    # only links to gone pages are ranked, and the ranking keeps three per target before it shuffles
    order = W.partitionBy("site", "target_key").orderBy("source_url")
    sources = (
        incoming_links(pages)
        .join(gone.select("site", F.col("page_key").alias("target_key")).distinct(), ["site", "target_key"], "left_semi")
        .withColumn("n", F.row_number().over(order))
        .where("n <= 3")
        .groupBy("site", F.col("target_key").alias("page_key"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source_url"))), lambda s: short_url(s["source_url"])), ", ").alias("places"))
    )
    linked = gone.join(sources, ["site", "page_key"], "left")
    answer = F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    broken = _rows(
        linked,
        [
            F.when(F.col("places").isNotNull(), _finding("critical", "broken-internal-link", F.concat(answer, F.lit(", from "), F.col("places"))))
            .otherwise(_finding("critical", "page-unavailable", answer))
        ],
    )
    return own.unionByName(broken)


def _first_five(rows: DataFrame, code: str, what: str) -> DataFrame:
    """One summary row per site: how many addresses, and the first five page names."""
    counts = rows.groupBy("site").agg(F.countDistinct("url").alias("n"))
    order = W.partitionBy("site").orderBy("name", "page_key")
    names = (
        rows.select("site", "page_key", short_url("url").alias("name"))
        .withColumn("i", F.row_number().over(order)).where("i <= 5")
        .groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ", ").alias("names"))
    )
    joined = counts.join(names, "site").withColumn("url", F.col("site"))
    return _rows(joined, [_finding("minor", code, F.concat(F.col("n").cast("string"), F.lit(what), F.col("names")))])


def contradiction_findings(pages: DataFrame, sitemap: DataFrame, disallowed: DataFrame) -> DataFrame:
    """Pages closed from the index or from robots and yet listed in the sitemap."""
    listed = keyed(sitemap)
    shut = pages.where(auditable() & closed())
    barred = disallowed.select("site", "url", K.dedup_key("url").alias("page_key"))
    return (
        _rows(shut.join(listed, ["site", "page_key"], "left_semi"), [_finding("critical", "noindex-in-sitemap", F.col("robots_meta"))])
        .unionByName(_first_five(shut, "noindex-not-checked", " pages closed: "))
        .unionByName(_rows(barred.join(listed, ["site", "page_key"], "left_semi"), [_finding("critical", "robots-disallow-in-sitemap", F.lit("Disallow"))]))
        .unionByName(_first_five(barred, "robots-disallow-not-checked", " pages closed: "))
    )


def with_shown(pages: DataFrame) -> DataFrame:
    """Readable pages with ``shown``: a page key that any of its addresses closes is closed."""
    ok = pages.where(auditable())
    shut = ok.where(closed()).select("site", "page_key").distinct().withColumn("_shut", F.lit(True))
    return ok.join(shut, ["site", "page_key"], "left").withColumn("shown", F.col("_shut").isNull()).drop("_shut")


def shown_pages(pages: DataFrame) -> DataFrame:
    """Pages that may enter the results."""
    return with_shown(pages).where("shown").drop("shown")


def duplicate_groups(pages: DataFrame, field: str) -> DataFrame:
    """Values shared by two or more indexable pages of a site."""
    value = K.squeezed(field)
    return (
        shown_pages(pages).select("site", "url", value.alias("value")).where("value <> ''")
        .groupBy("site", "value")
        .agg(F.count(F.lit(1)).alias("pages"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
        .where("pages > 1")
    )


def duplicate_members(pages: DataFrame, field: str) -> DataFrame:
    """Members of every duplicate group: (site, field, value, url, pages); the value names the group."""
    value = K.squeezed(field)
    groups = duplicate_groups(pages, field).select("site", "value", "pages")
    rows = shown_pages(pages).select("site", "url", value.alias("value"))
    return rows.join(groups, ["site", "value"]).select("site", F.lit(field).alias("field"), "value", "url", "pages")


def duplicate_findings(pages: DataFrame, field: str) -> DataFrame:
    """Each page of a duplicate group, with the group's size and another member.

    No page carries the list of all the others: :func:`duplicate_members` has them.
    """
    value = K.squeezed(field)
    rows = shown_pages(pages).withColumn("value", value).join(duplicate_groups(pages, field), ["site", "value"])
    other = F.when(F.col("url") == F.col("first_url"), F.col("last_url")).otherwise(F.col("first_url"))
    evidence = F.concat(F.col("pages").cast("string"), F.lit(" pages, also "), short_url(other), F.lit(": "), F.substring(F.col(field), 1, 60))
    return _rows(rows, [_finding("major", f"duplicate-{field}", evidence)])


def page_rule_findings(
    pages: DataFrame,
    title_min: int = L.TITLE_MIN, title_max: int = L.TITLE_MAX,
    description_min: int = L.DESCRIPTION_MIN, description_max: int = L.DESCRIPTION_MAX,
    thin_words: int = L.THIN_WORDS,
) -> DataFrame:
    """Rules that need nothing but the page itself; closed pages skip the snippet rules."""
    if description_min > description_max:
        raise ValueError("lower description bound above the upper one")
    shown = F.col("shown")
    has_title = F.coalesce(F.col("title"), F.lit("")) != ""
    has_description = F.coalesce(F.col("description"), F.lit("")) != ""
    canonical = F.coalesce(F.col("canonical"), F.lit(""))
    og_missing = F.filter(K.strings(["og:title", "og:description", "og:image"]), lambda k: ~F.array_contains(F.map_keys("og"), k))
    ok = with_shown(pages)
    title_size = F.concat(F.col("title_len").cast("string"), F.lit(" chars"))
    description_size = F.concat(F.col("description_len").cast("string"), F.lit(" chars"))
    return _rows(
        ok,
        [
            F.when(shown & ~has_title, _finding("major", "missing-title", F.lit("no <title>"))),
            F.when(shown & (F.col("title_len") > title_max), _finding("major", "title-too-long", title_size)),
            F.when(shown & has_title & (F.col("title_len") < title_min), _finding("minor", "title-too-short", title_size)),
            F.when(shown & ~has_description, _finding("major", "missing-description", F.lit("no description"))),
            F.when(shown & has_description & (F.col("description_len") < description_min), _finding("minor", "description-too-short", description_size)),
            F.when(shown & (F.col("description_len") > description_max), _finding("minor", "description-too-long", description_size)),
            F.when(F.size("h1") == 0, _finding("major", "missing-h1", F.lit("no <h1>"))),
            F.when(F.size("h1") > 1, _finding("major", "multiple-h1", F.concat(F.size("h1").cast("string"), F.lit(" tags <h1>")))),
            F.when(canonical == "", _finding("major", "missing-canonical", F.lit("no canonical")))
            .when(~K.same_site(canonical, "site"), _finding("major", "canonical-external", canonical))
            .when(K.dedup_key(canonical) != F.col("page_key"), _finding("major", "canonical-mismatch", canonical)),
            F.when(shown & (F.col("images_no_alt") > 0), _finding("minor", "images-no-alt", F.concat_ws(" of ", F.col("images_no_alt").cast("string"), F.col("images_total").cast("string")))),
            F.when(shown & (F.col("word_count") < thin_words), _finding("minor", "thin-content", F.concat(F.col("word_count").cast("string"), F.lit(" words")))),
            F.when(shown & (F.size(og_missing) > 0), _finding("minor", "missing-og", F.array_join(og_missing, ", "))),
            F.when(shown & (F.size("schema_types") == 0), _finding("minor", "missing-schema", F.lit("no JSON-LD or microdata"))),
        ],
    )


def orphan_findings(pages: DataFrame) -> DataFrame:
    """Indexable pages other than the root that no page links to."""
    targets = link_counts(pages).select("site", F.col("target_key").alias("page_key"))
    candidates = shown_pages(pages).where(F.col("page_key") != K.dedup_key("site"))
    return _rows(
        candidates.join(targets, ["site", "page_key"], "left_anti"), [_finding("major", "orphan-page", F.lit("no incoming links"))]
    )


def sitemap_findings(expanded: DataFrame) -> DataFrame:
    """Maps on another domain, and maps whose reading was stopped."""
    return _rows(
        expanded,
        [
            F.when(F.col("foreign"), _finding("minor", "sitemap-foreign-host", F.lit("another domain, not read"))),
            F.when(F.col("error").isNotNull(), _finding("major", "sitemap-too-large", F.col("error"))),
        ],
    )


def links_to_check(pages: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` internal links per site that were never fetched."""
    known = pages.select("site", F.col("page_key").alias("link_key"))
    links = (
        pages.select("site", F.col("url").alias("source_url"), F.posexplode("internal_links").alias("place", "link"))
        .where(K.crawlable("link"))
        .withColumn("link_key", K.dedup_key("link"))
        .join(known, ["site", "link_key"], "left_anti")
        .groupBy("site", "link_key")
        .agg(F.min(F.struct("source_url", "place", "link")).alias("at"))
    )
    order = W.partitionBy("site").orderBy("at.source_url", "at.place", "link_key")
    return (
        links.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
        .select("site", F.col("at.link").alias("url"), F.col("at.source_url").alias("source_url"), "n")
    )


def audit_findings(pages: DataFrame, sitemap: DataFrame, disallowed: DataFrame, expanded: DataFrame | None = None, **limits) -> DataFrame:
    """All findings of all sites."""
    parts = [
        availability_findings(pages),
        contradiction_findings(pages, sitemap, disallowed),
        duplicate_findings(pages, "title"),
        duplicate_findings(pages, "description"),
        page_rule_findings(pages, **limits),
        orphan_findings(pages),
    ]
    if expanded is not None:
        parts.append(sitemap_findings(expanded))
    return reduce(DataFrame.unionByName, parts)


def severity_rank(column: str = "severity") -> Column:
    place = F.array_position(K.strings(L.SEVERITIES), F.col(column))
    return F.when(place > 0, place - 1).otherwise(9).cast("int")


def audit_summary(findings: DataFrame) -> DataFrame:
    """Findings by site and code, most severe first."""
    return (
        findings.groupBy("site", "severity", "code")
        .agg(F.count(F.lit(1)).alias("findings"), F.min("url").alias("first_url"))
        .withColumn("severity_rank", severity_rank())
        .orderBy("site", "severity_rank", "code")
    )


def audit_totals(findings: DataFrame) -> DataFrame:
    """Findings by site and severity."""
    return findings.groupBy("site").pivot("severity", list(L.SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)
