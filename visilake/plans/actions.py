"""Prioritised action plan of every site.

Every rule yields the same columns (:data:`ACTION`): where the item stands (section and
sort keys), what it is about and up to five dated pieces of evidence. Evidence is ranked
per item with a bound, so a page with a million queries still makes one small row; the
full evidence stays in the item tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions import lists as L
from ..functions import words as WD
from ..operators.audit import severity_rank

EVIDENCE = "array<struct<text:string,source:string,measured_at:timestamp>>"
ACTION = ("site", "section", "rule", "url", "query", "count", "evidence", "k1", "k2", "k3", "k4", "tie")


def _evidence(text: Column, source: Column, at: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), source.cast("string").alias("source"), at.cast("timestamp").alias("measured_at"))


def _first(rows: DataFrame, keys: list[str], order: list, limit: int, value: Column, name: str) -> DataFrame:
    """First ``limit`` values of each key in order, as an array."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit)
    pick = F.array_sort(F.collect_list(F.struct("_n", value.alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(pick, lambda x: x["v"]).alias(name))


def _action(rows: DataFrame, section: Column | str, rule: Column | str, **columns) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    out = {"section": lit(section), "rule": lit(rule), **columns}
    for k in ("k1", "k2", "k3", "k4"):
        out[k] = out.get(k, F.lit(0)).cast("double")
    out["count"] = out.get("count", F.lit(1)).cast("bigint")
    out["evidence"] = out["evidence"].cast(EVIDENCE)
    return rows.select("site", *[out[c].alias(c) for c in ACTION[1:]])


# --- queries that nearly win ------------------------------------------------------------


def query_items(queries: DataFrame, pages: DataFrame, tracker: DataFrame, demand: DataFrame) -> DataFrame:
    """Every query a quick-win or snippet item rests on, with the reason it was left out.

    ``queries``: latest owner window (site, query, shows, clicks, avg_show_position,
    fetched_at); ``pages``: site, query_key, url; ``tracker``: latest ranks (site, query,
    position, url, checked_at); ``demand``: site, query_key, freq. The snippet rule is
    tried first. A tracked query counts only where the owner data did not route it, its
    demand is known and its page is known.
    """
    shows, clicks, place = F.coalesce("shows", F.lit(0)), F.coalesce("clicks", F.lit(0)), F.col("avg_show_position")
    section = F.when((shows >= L.SNIPPET_MIN_SHOWS) & (clicks == 0) & (place <= L.SNIPPET_MAX_POSITION), "snippet").when(
        place.between(L.QUICK_MIN_POSITION, L.QUICK_MAX_POSITION) & (shows >= L.QUICK_MIN_SHOWS), "quick_wins"
    )
    routed = queries.withColumn("section", section).where("section IS NOT NULL").withColumn("query_key", K.squeezed("query"))
    owner = routed.join(pages.select("site", "query_key", "url"), ["site", "query_key"], "left").select(
        "site", "section", "query_key", F.trim("query").alias("query"), "url", shows.cast("bigint").alias("shows"), clicks.cast("bigint").alias("clicks"),
        place.cast("double").alias("position"), F.lit(None).cast("bigint").alias("freq"), F.lit("owner").alias("source"),
        F.col("fetched_at").cast("timestamp").alias("measured_at"),
        F.when(F.col("url").isNull(), "no_page").alias("skipped"),
    )
    band = tracker.where(F.col("position").between(L.QUICK_MIN_POSITION, L.QUICK_MAX_POSITION)).withColumn("query_key", K.squeezed("query"))
    fresh = band.join(routed.select("site", "query_key").distinct(), ["site", "query_key"], "left_anti")
    ranked = fresh.join(demand.select("site", "query_key", "freq"), ["site", "query_key"], "left").select(
        "site", F.lit("quick_wins").alias("section"), "query_key", F.trim("query").alias("query"), "url", F.lit(None).cast("bigint").alias("shows"),
        F.lit(None).cast("bigint").alias("clicks"), F.col("position").cast("double").alias("position"), F.col("freq").cast("bigint").alias("freq"),
        F.lit("tracker").alias("source"), F.col("checked_at").cast("timestamp").alias("measured_at"),
        F.when(F.coalesce("freq", F.lit(0)) <= 0, "no_demand").when(F.coalesce("url", F.lit("")) == "", "no_page").alias("skipped"),
    )
    return owner.unionByName(ranked).withColumns({"page_key": K.page_key("url"), "path": K.page_path("url")})


def skipped_queries(items: DataFrame) -> DataFrame:
    """Queries that fit a rule but could not become an item."""
    return items.where("skipped IS NOT NULL").groupBy("site", "skipped").agg(F.count(F.lit(1)).alias("queries"))


def page_actions(items: DataFrame) -> DataFrame:
    """One item per page and section: an edit of the page serves all of its queries.

    Totals and evidence both read ``items``: store or checkpoint them first.
    """
    rows = items.where("skipped IS NULL")
    keys = ["site", "section", "page_key"]
    place = F.when(F.col("source") == "tracker", F.col("position")).otherwise(99)
    rows = rows.withColumn("_o", F.struct((-F.coalesce("shows", F.lit(0))).alias("s"), place.alias("p"), F.col("query").alias("q")))
    grouped = rows.groupBy(*keys).agg(
        F.sum(F.coalesce("shows", F.lit(0))).alias("total"), F.count(F.lit(1)).alias("count"),
        F.min_by(F.struct("query", "path", "freq", "source"), F.col("_o")).alias("main"),
    )
    text = F.concat_ws(" ", F.col("query"), F.concat(F.lit("position="), F.col("position").cast("string")),
                       F.concat(F.lit("shows="), F.col("shows").cast("string")), F.concat(F.lit("clicks="), F.col("clicks").cast("string")),
                       F.concat(F.lit("freq="), F.col("freq").cast("string")))
    told = _first(rows, keys, [F.col("_o")], L.QUERIES_PER_ITEM, _evidence(text, F.col("source"), F.col("measured_at")), "evidence")
    joined = grouped.join(told, keys)
    rule = F.when(F.col("section") == "snippet", "shows_without_clicks").otherwise(F.concat(F.col("main.source"), F.lit("_position_band")))
    return _action(
        joined, F.col("section"), rule, url=F.col("main.path"), query=F.col("main.query"), count=F.col("count"), evidence=F.col("evidence"),
        k1=-F.col("total"), k2=-F.coalesce("main.freq", F.lit(0)), tie=F.col("main.path"),
    )


def quick_wins(items: DataFrame) -> DataFrame:
    return page_actions(items.where("section = 'quick_wins'"))


def snippet_actions(items: DataFrame) -> DataFrame:
    return page_actions(items.where("section = 'snippet'"))


def page_sections(actions: DataFrame) -> DataFrame:
    """Quick-win and snippet items, flagged where one page stands in both."""
    rows = actions.where(F.col("section").isin("quick_wins", "snippet")).withColumn("page_key", K.page_key("url"))
    both = rows.groupBy("site", "page_key").agg(F.countDistinct("section").alias("sections"))
    return rows.join(both, ["site", "page_key"]).withColumn("in_both", F.col("sections") > 1).drop("sections", "page_key")


# --- two pages for one query ------------------------------------------------------------

_RULES = ("registry", "replaced", "owner", "serp", "tracker")


def cannibalization_evidence(
    articles: DataFrame, report: DataFrame, owner_pages: DataFrame, own_docs: DataFrame, tracker_history: DataFrame,
) -> DataFrame:
    """Pages that claim one need, from five kinds of evidence, in long form.

    ``articles``: site, url, target_query, created_at; ``report``: site, url, target_query,
    verdict, ranking_url, checked_at; ``owner_pages``: latest window (site, query, url,
    shows, fetched_at); ``own_docs``: own documents of the newest snapshot of each query and
    region (site, query, region, url, position, fetched_at); ``tracker_history``: the last two ranks
    (site, query, n, url, checked_at).
    """
    def stream(rows: DataFrame, rule: str, source: str, query, url, at) -> DataFrame:
        return rows.select(
            "site", "stem_key", F.col(query).alias("query"), K.page_key(url).alias("page_key"), K.page_path(url).alias("path"),
            F.lit(rule).alias("rule"), F.lit(_RULES.index(rule)).alias("rule_order"), F.lit(source).alias("source"),
            F.col(at).cast("timestamp").alias("measured_at"),
        )

    def key(column: str) -> Column:
        made = WD.stem_key(column)
        return F.when(made != "", made).otherwise(F.lower(column))

    registry = articles.withColumn("stem_key", key("target_query")).withColumn("_p", K.page_key("url"))
    claims = registry.groupBy("site", "stem_key").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    disputed = claims.where("_lo <> _hi").select("site", "stem_key")
    parts = [stream(registry.join(disputed, ["site", "stem_key"], "left_semi"), "registry", "article registry", "target_query", "url", "created_at")]

    replaced = report.where((F.col("verdict") == L.REPLACED) & F.col("ranking_url").isNotNull()).withColumn("stem_key", key("target_query"))
    parts += [stream(replaced, "replaced", "article check", "target_query", u, "checked_at") for u in ("url", "ranking_url")]

    shown = owner_pages.where((F.coalesce("shows", F.lit(0)) >= L.QUICK_MIN_SHOWS) & (F.coalesce("url", F.lit("")) != "")).withColumn("stem_key", key("query")).withColumn("_p", K.page_key("url"))
    stray = shown.join(registry.select("site", "stem_key", "_p").distinct(), ["site", "stem_key", "_p"], "left_anti")
    first_claim = registry.groupBy("site", "stem_key").agg(F.min_by("url", F.struct("created_at", "url")).alias("claimed_url"))
    stray = stray.join(first_claim, ["site", "stem_key"])
    parts += [stream(stray, "owner", "owner data", "query", u, "fetched_at") for u in ("claimed_url", "url")]

    keyed_docs = own_docs.withColumn("stem_key", key("query")).withColumn("_p", K.page_key("url"))
    # two pages in the results of one region; one page in each of two regions is no dispute
    double = keyed_docs.groupBy("site", "query", "region").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).where("_lo <> _hi").select("site", "query", "region")
    parts.append(stream(keyed_docs.join(double, ["site", "query", "region"], "left_semi"), "serp", "result snapshot", "query", "url", "fetched_at"))

    last = tracker_history.where(F.coalesce("url", F.lit("")) != "").withColumn("_p", K.page_key("url"))
    moved = last.groupBy("site", "query").agg(F.count(F.lit(1)).alias("_c"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).where("_c = 2 AND _lo <> _hi").select("site", "query")
    parts.append(stream(last.join(moved, ["site", "query"], "left_semi").withColumn("stem_key", key("query")), "tracker", "rank history", "query", "url", "checked_at"))
    return reduce(DataFrame.unionByName, parts)


def cannibalization_actions(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Needs claimed by two or more pages; two pages in one snapshot alone are not enough."""
    keys = ["site", "stem_key"]
    grouped = evidence.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("rule_order", "rule"))).alias("rules"),
        F.min_by("query", F.struct("rule_order", "query")).alias("query"),
    )
    pages = evidence.groupBy(*keys, "page_key").agg(F.min(F.struct("rule_order", "path")).alias("at"))
    counts = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    names = _first(pages, keys, [F.col("at"), F.col("page_key")], 2, F.col("at.path"), "paths")
    rule = F.array_join(F.transform("rules", lambda r: r["rule"]), "+")
    chosen = grouped.join(counts, keys).where(F.col("pages") >= 2).withColumn("rule", rule).where("rule <> 'serp'")
    told = _first(
        evidence, keys, [F.col("rule_order"), F.col("query"), F.col("path"), F.desc("measured_at")], L.QUERIES_PER_ITEM,
        _evidence(F.concat_ws(" ", "query", "path"), F.col("source"), F.col("measured_at")), "evidence",
    )
    shows = queries.groupBy("site", K.squeezed("query").alias("query_key")).agg(F.max(F.coalesce("shows", F.lit(0))).alias("shows"))
    rows = chosen.join(names, keys).join(told, keys).withColumn("query_key", F.lower("query")).join(shows, ["site", "query_key"], "left")
    return _action(
        rows, "cannibalization", F.concat(F.lit("cannibalization:"), F.col("rule")), url=F.array_join("paths", " and "), query=F.col("query"),
        count=F.col("pages"), evidence=F.col("evidence"), k1=-F.coalesce("shows", F.lit(0)), tie=F.col("query"),
    )


# --- what rivals have and we do not -----------------------------------------------------


def gap_rivals(candidates: DataFrame, docs: DataFrame, sites: DataFrame) -> DataFrame:
    """Domains seen for at least two of a site's queries in its regions, platforms aside, five per site."""
    stand = docs.select("query", "region", K.normalize_domain("domain").alias("domain")).distinct()
    seen = candidates.select("site", "query", "region").distinct().join(stand, ["query", "region"])
    seen = seen.join(sites.select("site", F.col("domain").alias("own")), "site").where((F.col("domain") != "") & (F.col("domain") != F.col("own")) & ~K.is_portal("domain"))
    counts = seen.groupBy("site", "domain").agg(F.count(F.lit(1)).alias("queries")).where(F.col("queries") >= L.GAP_MIN_QUERIES)
    order = W.partitionBy("site").orderBy(F.desc("queries"), "domain")
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= L.GAP_MAX_COMPETITORS).drop("_n")


def newest_snapshots(docs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Documents of the newest good snapshot of each query and region."""
    newest = snapshots.where("error IS NULL").groupBy("query", "region").agg(
        F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("snapshot_id")
    )
    return docs.join(newest.select("snapshot_id"), "snapshot_id", "left_semi")


def gap_actions(
    candidates: DataFrame, docs: DataFrame, sites: DataFrame, articles: DataFrame, queries: DataFrame, pages: DataFrame, demand: DataFrame,
    rivals: DataFrame | None = None,
) -> DataFrame:
    """Queries with demand where a rival stands in the newest results of a region and we do not.

    ``candidates``: site, query, region (tracked phrases and core goals); ``docs`` from
    :func:`newest_snapshots`; ``sites``: site, domain; the rest as in the other rules.
    """
    places = docs.withColumn("domain", K.normalize_domain("domain")).groupBy("query", "region", "domain").agg(
        F.min(F.struct("position", "url", "fetched_at")).alias("at")
    )
    asked = candidates.select("site", "query", "region").distinct().join(sites.select("site", F.col("domain").alias("own")), "site")
    asked = asked.withColumns({"query_key": F.lower("query"), "stem_key": WD.stem_key("query")})
    ours = places.select("query", "region", F.col("domain").alias("own"))
    free = (
        asked.join(ours, ["query", "region", "own"], "left_anti")
        .join(articles.select("site", WD.stem_key("target_query").alias("stem_key")).distinct(), ["site", "stem_key"], "left_anti")
        .join(queries.where("shows > 0").select("site", K.squeezed("query").alias("query_key")).distinct(), ["site", "query_key"], "left_anti")
        .join(pages.select("site", "query_key").distinct(), ["site", "query_key"], "left_anti")
        .join(demand.where("freq > 0").select("site", "query_key", "freq"), ["site", "query_key"])
    )
    rivals = gap_rivals(candidates, docs, sites) if rivals is None else rivals
    standing = free.join(rivals.select("site", "domain"), "site").join(places, ["query", "region", "domain"])
    keys = ["site", "query", "region"]
    best = standing.groupBy(*keys).agg(F.max("freq").alias("freq"), F.count(F.lit(1)).alias("count"), F.min(F.struct("at.position", "domain", "at.url")).alias("best"))
    told = _first(
        standing, keys, [F.col("at.position"), F.col("domain")], 3,
        _evidence(F.concat_ws(" ", F.col("domain"), F.col("at.position").cast("string"), F.col("at.url")), F.lit("result snapshot"), F.col("at.fetched_at")), "evidence",
    )
    return _action(
        best.join(told, keys), "competitor_gaps", "rival_in_results", url=F.col("best.url"), query=F.col("query"), count=F.col("count"),
        evidence=F.col("evidence"), k1=-F.col("freq"), tie=F.concat_ws(" ", "query", "region"),
    )


# --- findings ---------------------------------------------------------------------------


def finding_actions(audit: DataFrame, readiness: DataFrame | None = None) -> DataFrame:
    """Findings as items: what blocks indexing one by one, the rest one item per kind.

    Both inputs: site, severity, code, url, evidence, measured_at. Codes that only inform
    are left out.
    """
    path = K.page_path("url")
    rank = severity_rank()

    def single(rows: DataFrame, source: str, section, k2, k3, tie) -> DataFrame:
        told = F.array(_evidence(F.concat_ws(": ", path, "evidence"), F.lit(source), F.col("measured_at")))
        return _action(rows, section, F.concat(F.lit(source + ":"), F.col("code")), url=F.col("url"), query=F.lit(None).cast("string"), evidence=told, k1=rank, k2=k2, k3=k3, tie=tie)

    def grouped(rows: DataFrame, source: str, k2, k3, tie) -> DataFrame:
        keys = ["site", "severity", "code"]
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(path.alias("path"), "url")).alias("first"))
        told = _first(rows, keys, [path, F.col("url"), F.col("evidence")], L.QUERIES_PER_ITEM, _evidence(F.concat_ws(": ", path, "evidence"), F.lit(source), F.col("measured_at")), "evidence")
        return _action(
            counts.join(told, keys), "other", F.concat(F.lit(source + ":"), F.col("code")), url=F.col("first.url"), query=F.lit(None).cast("string"),
            count=F.col("n"), evidence=F.col("evidence"), k1=rank, k2=k2, k3=k3, tie=tie,
        )

    useful = audit.where(~F.col("code").isin(*L.AUDIT_INFO_CODES))
    critical = F.col("severity") == "critical"
    parts = [
        single(useful.where(critical), "audit", "indexing", F.lit(-1), F.lit(0), F.concat_ws(" ", "code", path)),
        grouped(useful.where(~critical), "audit", -F.col("n"), F.lit(0), F.concat_ws(" ", "code", "first.path")),
    ]
    if readiness is not None:
        rows = readiness.where(~F.col("code").isin(*L.READINESS_SKIP))
        code = F.col("code")
        kind = F.when(code.startswith("robots"), 0).when(code.startswith("llms"), 1).when(code.startswith("jsonld"), 2).otherwise(3)
        part = F.when(F.contains("evidence", F.lit("whole site")), 0).otherwise(1)
        indexing = code.isin(*L.READINESS_INDEXING)
        ai = code.startswith("robots-blocks-") | code.isin(*L.READINESS_MAIN) | ((code == "jsonld-missing") & (F.col("severity") != "minor"))
        parts += [
            single(rows.where(indexing), "readiness", "indexing", kind, part, code),
            single(rows.where(~indexing & ai), "readiness", "ai_search", kind, part, code),
            grouped(rows.where(~indexing & ~ai), "readiness", kind, F.lit(1), code),
        ]
    return reduce(DataFrame.unionByName, parts)


# --- the plan ---------------------------------------------------------------------------


def reusable_audits(audits: DataFrame, as_of) -> DataFrame:
    """Newest good stored audit of each address, and whether it is young enough to reuse."""
    newest = audits.where("error IS NULL").groupBy("url").agg(F.max_by(F.struct("id", "started_at", "pages", "findings"), F.struct("started_at", "id")).alias("a"))
    age = K.age_days("started_at", K.moment(as_of))
    return newest.select("url", "a.*").withColumn("age_days", age).withColumn("reusable", F.col("age_days") <= L.AUDIT_MAX_AGE_DAYS)


def section_rank() -> Column:
    return F.array_position(K.strings(L.SECTIONS), F.col("section")).cast("int")


def _plan_order() -> list[Column]:
    return [section_rank(), F.col("k1"), F.col("k2"), F.col("k3"), F.col("k4"), F.col("tie"), F.col("rule"), F.col("url")]


def action_plan(actions: DataFrame, limit: int = 10, sections=None) -> DataFrame:
    """First ``limit`` items of each site: section order first, then the section's own keys."""
    rows = actions if sections is None else actions.where(F.col("section").isin(*sections))
    order = W.partitionBy("site").orderBy(*_plan_order())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, limit))


def build_plan(
    sites: DataFrame, items: DataFrame, queries: DataFrame, cannibalization: DataFrame, gap_candidates: DataFrame, docs: DataFrame, articles: DataFrame,
    pages: DataFrame, demand: DataFrame, audit: DataFrame, readiness: DataFrame | None = None, limit: int = 10, sections=None,
) -> tuple[DataFrame, DataFrame]:
    """All items of all seven sections, and the first ``limit`` of each site: (actions, plan).

    Every input is keyed by the same ``site`` and read by one rule or more, so pass stored
    tables: ``items`` from :func:`query_items`, ``cannibalization`` from
    :func:`cannibalization_evidence`, ``docs`` from :func:`newest_snapshots`, ``audit`` and
    ``readiness`` as findings. Store the actions before both frames are read.
    """
    parts = [
        page_actions(items), cannibalization_actions(cannibalization, queries),
        gap_actions(gap_candidates, docs, sites, articles, queries, pages, demand), finding_actions(audit, readiness),
    ]
    actions = reduce(DataFrame.unionByName, parts)
    return actions, action_plan(actions, limit, sections)


def hidden_counts(actions: DataFrame, shown: DataFrame) -> DataFrame:
    """How many items of each section the limit folded away."""
    total = actions.groupBy("site", "section").agg(F.count(F.lit(1)).alias("total"))
    seen = shown.groupBy("site", "section").agg(F.count(F.lit(1)).alias("shown"))
    out = total.join(seen, ["site", "section"], "left").withColumn("hidden", F.col("total") - F.coalesce("shown", F.lit(0)))
    return out.where("hidden > 0").select("site", "section", "total", "hidden")


def missing_notes(sites: DataFrame, queries: DataFrame, tracker: DataFrame, docs_queries: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """What the plan of a site could not use: (site, note, count)."""
    owner = queries.groupBy("site").agg(F.count(F.lit(1)).alias("owner_rows"), F.max("fetched_at").alias("fetched_at"))
    ranks = tracker.groupBy("site").agg(F.count(F.lit(1)).alias("rank_rows"))
    snaps = docs_queries.groupBy("site").agg(F.count(F.lit(1)).alias("snapshot_rows"))
    left = items.where("skipped IS NOT NULL").groupBy("site").agg(
        F.count_if(F.col("skipped") == "no_page").alias("no_page"), F.count_if(F.col("skipped") == "no_demand").alias("no_demand")
    )
    rows = sites.select("site").join(owner, "site", "left").join(ranks, "site", "left").join(snaps, "site", "left").join(left, "site", "left")
    age = K.age_days("fetched_at", K.moment(as_of))

    def note(when, name, count=None):
        return F.when(when, F.struct(F.lit(name).alias("note"), (F.lit(None) if count is None else count).cast("bigint").alias("count")))

    notes = F.array_compact(F.array(
        note(F.col("owner_rows").isNull(), "no_owner_data"), note(age > L.OWNER_STALE_DAYS, "owner_data_stale", F.floor(age)),
        note(F.col("rank_rows").isNull(), "no_ranks"), note(F.col("snapshot_rows").isNull(), "no_snapshots"),
        note(F.col("no_page") > 0, "queries_without_page", F.col("no_page")), note(F.col("no_demand") > 0, "queries_without_demand", F.col("no_demand")),
    ))
    return rows.select("site", F.inline(notes))
