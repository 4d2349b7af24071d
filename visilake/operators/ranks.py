"""Rank tracking: medians over repeated snapshots, history, movement and run planning.

Tables: ``snapshots`` (snapshot_id, query, region, run_id, fetched_at, error), ``docs``
(snapshot_id, position, organic_position, is_wizard, url, domain, …) and ``positions``
(id, query, region, domain, position, url, checked_at, samples). A NULL position means
"measured, not in the collected top".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..functions import keys as K
from ..functions import lists as L
from ..functions.keys import let
from ..sources.serp import pages_for

SAMPLES = "array<struct<position:int,n:bigint>>"


# --- medians ------------------------------------------------------------------------


def median_position(position: str) -> Column:
    """Aggregate: median rank, where "not in the top" takes part as the worst rank.

    Odd counts give the middle value, even ones the lower of the two middle values, and
    "not in the top" as soon as the upper one is absent. Both percentiles keep one counter
    per distinct rank, so a hot key stays small on both sides of the shuffle.
    """
    value = f"coalesce({position}, {L.BEYOND})"
    low = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")
    high = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")
    return F.when(high < L.BEYOND, low).cast("int")


def _rank_at(hist: Column, index: Column) -> Column:
    """Value at a zero-based place of a counted, sorted list of ranks."""
    state = F.aggregate(
        hist,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")),
        lambda acc, h: F.struct(
            (acc["seen"] + h["n"]).alias("seen"),
            F.when(acc["at"].isNull() & (acc["seen"] + h["n"] > index), h["rank"]).otherwise(acc["at"]).alias("at"),
        ),
    )
    return state["at"]


def _counted_median(hist: Column, total: Column) -> Column:
    high = _rank_at(hist, F.floor(total / 2))
    low = _rank_at(hist, F.floor((total - 1) / 2))
    return F.when(high < L.BEYOND, low)


def median_of_samples(samples: Column) -> Column:
    """Median rank of an array of ranks (NULL = not in the top)."""
    ranks = F.array_sort(F.transform(samples, lambda p: F.coalesce(p.cast("int"), F.lit(L.BEYOND))))
    size = F.size(samples)
    high = F.get(ranks, F.floor(size / 2).cast("int"))
    low = F.get(ranks, F.floor((size - 1) / 2).cast("int"))
    return F.when(high < L.BEYOND, low)


# --- measuring ----------------------------------------------------------------------


def domain_hits(docs: DataFrame, domain: str | None = None) -> DataFrame:
    """First organic document of a domain (of every domain, if none is named) per snapshot."""
    sites = docs.where(~F.col("is_wizard")).withColumn("domain", K.bare_domain("domain"))
    if domain is not None:
        sites = sites.where(F.col("domain") == domain.lower().removeprefix("www."))
    place = F.coalesce(F.nullif(F.col("organic_position"), F.lit(0)), F.col("position"))
    return (
        sites.groupBy("snapshot_id", "domain")
        .agg(F.min(F.struct("position", place.alias("rank"), "url")).alias("hit"))
        .select("snapshot_id", "domain", F.col("hit.rank").alias("rank"), F.col("hit.url").alias("url"))
    )


def measure(snapshots: DataFrame, docs: DataFrame, domain: str, keys=("query", "region", "run_id")) -> DataFrame:
    """Median, spread and samples of a domain by query and run, with the snapshot that stands for it.

    Snapshots are first counted by rank, so at most one row per possible rank reaches the
    group; samples are kept as counts by rank. The representative snapshot is the first
    whose rank equals the median, else the first of all.
    """
    keys = list(keys)
    hits = domain_hits(docs, domain).select("snapshot_id", "rank", "url")
    measured = snapshots.select(*keys, "snapshot_id", "fetched_at", F.col("error").isNull().alias("ok")).join(hits, "snapshot_id", "left")
    counted = measured.groupBy(*keys, "ok", F.when(F.col("ok"), F.coalesce("rank", F.lit(L.BEYOND))).alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("fetched_at", "snapshot_id", "url")).alias("first")
    )
    grouped = counted.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("rank", "n", "first")))).alias("hist"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("snapshots"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok") & (F.col("rank") < L.BEYOND), F.col("n"))), F.lit(0)).alias("found_in"),
        F.min(F.when(F.col("rank") < L.BEYOND, F.col("rank"))).alias("min"),
        F.max(F.when(F.col("rank") < L.BEYOND, F.col("rank"))).alias("max"),
        F.min(F.when(F.col("ok"), F.col("first"))).alias("_first"),
    )
    with_median = grouped.withColumn("median", _counted_median(F.col("hist"), F.col("snapshots")))
    same = F.get(F.filter("hist", lambda h: h["rank"] == F.col("median")), F.lit(0))["first"]
    chosen = F.coalesce(same, "_first")
    samples = F.transform("hist", lambda h: F.struct(F.when(h["rank"] < L.BEYOND, h["rank"]).cast("int").alias("position"), h["n"].alias("n")))
    return with_median.select(
        *keys, F.col("median").cast("int").alias("median"), "min", "max", samples.cast(SAMPLES).alias("samples"),
        "found_in", "snapshots", "failed",
        chosen["snapshot_id"].alias("snapshot_id"), chosen["fetched_at"].alias("fetched_at"), chosen["url"].alias("url"),
    )


def representative_snapshot(measured: DataFrame) -> DataFrame:
    """The snapshot that feeds competition, address and positions of a measured query."""
    return measured.where("snapshot_id IS NOT NULL").drop("url")


def record_positions(snapshots: DataFrame, docs: DataFrame, domains: list[str], primary: str | None = None) -> DataFrame:
    """One row per query and watched domain; absence is a row with a NULL position.

    With ``primary``, ``snapshots`` is the output of :func:`representative_snapshot`: the
    primary domain gets the median and the samples instead of its place in one snapshot.
    """
    names = list(dict.fromkeys(d.lower().removeprefix("www.") for d in domains))
    rows = snapshots if "error" not in snapshots.columns else snapshots.where("error IS NULL")
    rows = rows.withColumn("domain", F.explode(K.strings(names)))
    hits = domain_hits(docs.where(K.bare_domain("domain").isin(names)))
    joined = rows.join(hits, ["snapshot_id", "domain"], "left")
    position, samples = F.col("rank"), F.lit(None).cast(SAMPLES)
    if primary is not None:
        ours = F.col("domain") == primary.lower().removeprefix("www.")
        position = F.when(ours, F.col("median")).otherwise(position)
        samples = F.when(ours, F.col("samples"))
    return joined.select(
        F.col("snapshot_id").alias("id"), "snapshot_id", "query", "region", "domain",
        position.cast("int").alias("position"), "url", F.col("fetched_at").alias("checked_at"), samples.alias("samples"),
    )


# --- history ------------------------------------------------------------------------


def newest_two(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Newest (cur) and previous (prev) value per key and the number of rows (measurements).

    ``value`` is a struct that begins with what it is ordered by. The state of a key, its two greatest
    values and a count, is merged like any aggregate: each task passes on one such state a
    key, and the input is read and dealt once.
    """
    top = F.reverse(F.array_sort(InternalFunction.collect_top_k(value, 2, False)))
    both = rows.groupBy(*keys).agg(top.alias("_top"), F.count(F.lit(1)).alias("measurements"))
    return both.select(*keys, F.get("_top", F.lit(0)).alias("cur"), F.get("_top", F.lit(1)).alias("prev"), "measurements")


def latest_positions(positions: DataFrame, domain: str, region=None, queries: DataFrame | None = None) -> DataFrame:
    """Current rank of every query, its change and whether the change is measurement noise."""
    rows = positions.where(F.col("domain") == domain.lower().removeprefix("www."))
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if queries is not None:
        rows = rows.withColumn("_q", K.squeezed("query")).join(queries.select(K.squeezed("query").alias("_q")).distinct(), "_q", "left_semi").drop("_q")
    value = F.struct("checked_at", "id", "position", "samples")
    both = newest_two(rows, ["query", "region"], value)
    delta = F.col("prev.position") - F.col("cur.position")
    found = F.filter(F.col("cur.samples.position"), lambda p: p.isNotNull())
    several = F.array_min(found) != F.array_max(found)
    low, high = F.when(several, F.array_min(found)), F.when(several, F.array_max(found))
    return both.select(
        "query", "region",
        F.col("cur.position").alias("position"), F.col("prev.position").alias("previous"), delta.alias("delta"),
        low.alias("spread_low"), high.alias("spread_high"),
        F.coalesce((delta != 0) & (F.abs(delta) <= high - low), F.lit(False)).alias("within_noise"),
        F.col("cur.checked_at").alias("checked_at"), "measurements",
    )


def movers(latest: DataFrame, limit: int = 10) -> DataFrame:
    """Largest rises and largest falls."""
    up = latest.where("delta > 0").orderBy(F.desc("delta"), "query", "region").limit(limit).withColumn("direction", F.lit("up"))
    down = latest.where("delta < 0").orderBy("delta", "query", "region").limit(limit).withColumn("direction", F.lit("down"))
    return up.unionByName(down)


def position_history(positions: DataFrame, query: str, domain: str, region, limit: int = 50) -> DataFrame:
    return (
        positions.where((F.col("query") == query) & (F.col("domain") == domain.lower().removeprefix("www.")) & (F.col("region") == region))
        .orderBy(F.desc("checked_at"), F.desc("id")).limit(limit)
        .select("checked_at", "position", "url")
    )


def article_history(checks: DataFrame, article_id, query: str | None = None, limit: int = 50) -> DataFrame:
    rows = checks.where(F.col("article_id") == article_id)
    rows = rows if query is None else rows.where(F.col("query") == query)
    return rows.orderBy(F.desc("checked_at"), F.desc("id")).limit(limit)


def competition_history(competition: DataFrame, query: str, region, limit: int = 20) -> DataFrame:
    rows = competition.where((F.col("query") == query) & (F.col("region") == region) & F.col("error").isNull())
    return rows.orderBy(F.desc("calculated_at"), F.desc("snapshot_id")).limit(limit).select("calculated_at", "score", "band", "our_position")


def list_audits(audits: DataFrame, url: str | None = None, limit: int = 20) -> DataFrame:
    rows = audits if url is None else audits.where(F.col("url") == url)
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def latest_competition(competition: DataFrame, region=None, queries: DataFrame | None = None) -> DataFrame:
    """Newest good score of every query, whatever its spelling."""
    rows = competition.where("error IS NULL").withColumn("query_key", K.squeezed("query")).where("query_key <> ''")
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if queries is not None:
        rows = rows.join(queries.select(K.squeezed("query").alias("query_key")).distinct(), "query_key", "left_semi")
    newest = F.max_by(F.struct("query", "score", "band", "our_position", "calculated_at"), F.struct("calculated_at", "snapshot_id"))
    return rows.groupBy("query_key", "region").agg(newest.alias("c")).select("query_key", "region", "c.*")


def calibration_report(calibration: DataFrame, domain: str | None = None, region=None) -> DataFrame:
    """How far measured ranks are from the ranks people see; trustworthy from five checks on."""
    rows = calibration
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if domain:
        rows = rows.where(F.col("domain") == domain.lower().removeprefix("www."))
    both = (F.coalesce("seen_position", F.lit(0)) != 0) & (F.coalesce("api_position", F.lit(0)) != 0)
    offset = F.when(both, F.col("api_position") - F.col("seen_position"))
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("checks"),
        F.count(offset).alias("comparable"),
        F.round(F.avg(offset), 1).alias("avg_offset"),
        F.max_by(offset, F.when(both, F.struct(F.abs(offset).alias("size"), F.col("checked_at"), F.col("id")))).alias("max_offset"),
        (F.count(offset) >= 5).alias("trustworthy"),
    )


# --- planning a run -----------------------------------------------------------------


def measurement_plan(queries: DataFrame, latest: DataFrame, n: int = 10, hot: int = L.REPEATS_HOT, cold: int = L.REPEATS_COLD) -> DataFrame:
    """Samples and calls per phrase: one sample where the last rank was "not in the top".

    ``queries``: query, ord; phrases equal up to case and spaces are measured once, in
    their first spelling.
    """
    phrases = (
        queries.withColumn("query_key", K.squeezed("query")).where("query_key <> ''")
        .groupBy("query_key").agg(F.min_by("query", "ord").alias("query"), F.min("ord").alias("ord"))
    )
    known = latest.groupBy(K.squeezed("query").alias("query_key")).agg(
        F.max_by(F.struct("position"), F.struct("checked_at", "query")).alias("last")
    )
    state = F.when(F.col("last").isNull(), "new").when(F.col("last.position").isNull(), "cold").otherwise("hot")
    planned = phrases.join(known, "query_key", "left").withColumn("state", state)
    samples = F.when(F.col("state") == "cold", F.lit(max(1, cold))).otherwise(F.lit(max(1, hot)))
    return planned.select("query", "query_key", "ord", "state", samples.alias("samples"), (samples * pages_for(n)).alias("calls"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy().agg(
        F.count(F.lit(1)).alias("phrases"),
        F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.count_if(F.col("state") != "cold").alias("hot"),
        F.count_if(F.col("state") == "cold").alias("cold"),
        F.count_if(F.col("state") == "new").alias("new"),
    )


def run_gate(
    plan: DataFrame, positions: DataFrame, domain: str, region, as_of,
    interval_days: int = L.MIN_INTERVAL_DAYS, cap: int = L.MAX_CALLS, rate: float | None = None,
) -> DataFrame:
    """May the run start: the interval since the last measurement, then the cap on calls, and the cost.

    Both sides are single rows joined on a constant.
    """
    last = positions.where((F.col("domain") == domain.lower().removeprefix("www.")) & (F.col("region") == region)).groupBy().agg(F.max("checked_at").alias("last_measured"))
    totals = plan_totals(plan)
    one = totals.withColumn("_k", F.lit(1)).join(last.withColumn("_k", F.lit(1)), "_k").drop("_k")
    passed = K.age_days("last_measured", K.moment(as_of))
    due = F.lit(interval_days == 0) | F.col("last_measured").isNull() | (passed >= interval_days)
    over = F.lit(cap > 0) & (F.col("calls") > cap)
    return one.select(
        "*",
        F.round(passed, 1).alias("days_passed"),
        due.alias("due"),
        F.when(F.col("phrases") == 0, "nothing_to_measure").when(~due, "too_early").when(over, "over_cap").alias("stopped"),
        (F.col("calls") * F.lit(rate).cast("double")).alias("cost"),
    )


def tracking_targets(projects: DataFrame, tracked: DataFrame, region, orphan_owner: int | None = None) -> DataFrame:
    """What each active project measures in a region: one row per phrase.

    Phrases without a project go to ``orphan_owner`` only; a project without phrases keeps
    one row with a NULL query.
    """
    active = projects.where(F.col("active") & (F.coalesce("region", F.lit(region)) == region)).select("project_id", "project", "domain")
    phrases = tracked.where(F.col("active") & (F.col("region") == region)).select(
        F.coalesce("project_id", F.lit(orphan_owner).cast("bigint")).alias("project_id"),
        "query",
        F.col("project_id").isNull().alias("inherited"),
    )
    return active.join(phrases.where("project_id IS NOT NULL"), "project_id", "left")
