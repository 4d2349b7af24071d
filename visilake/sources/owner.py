"""Owner-side statistics: search queries, their pages, index history, landing pages, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import let

#: Names of crawl indicators in reports (fixed values).
CRAWL_INDICATORS = {
    "SEARCHABLE": "в поиске",
    "DOWNLOADED": "робот скачал",
    "HTTP_2XX": "отвечают нормально",
    "HTTP_3XX": "переадресуют",
    "HTTP_4XX": "отвечают ошибкой 4xx",
    "HTTP_5XX": "отвечают ошибкой 5xx",
}
#: Order of numbers in a landing-page row (fixed values).
LANDING_METRICS = ("visits", "bounce_rate", "page_depth", "avg_duration")

_QUERIES = "struct<queries:array<struct<query_text:string,query_id:string,indicators:map<string,double>>>>"
_PAGES = (
    "struct<text_indicator_to_statistics:array<struct<"
    "text_indicator:struct<value:string>,popular_complementary_indicator:struct<value:string>,"
    "statistics:array<struct<date:string,field:string,value:double>>>>>"
)
_POINTS = "array<struct<date:string,value:double>>"
_LANDING = "struct<data:array<struct<dimensions:array<struct<name:string>>,metrics:array<double>>>>"


def _others(raw: DataFrame, payload: str) -> list[str]:
    return [c for c in raw.columns if c != payload]


def query_stats_from_json(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Shows, clicks and average positions by query; absent counts are zero."""
    keep = _others(raw, payload)
    rows = raw.select(*keep, F.explode(F.from_json(F.col(payload), _QUERIES)["queries"]).alias("q"))

    def indicator(name: str) -> Column:
        return F.try_element_at(F.col("q.indicators"), F.lit(name))

    def counted(name: str) -> Column:
        return F.coalesce(indicator(name).cast("bigint"), F.lit(0).cast("bigint"))

    return rows.select(
        *keep,
        F.coalesce("q.query_text", F.lit("")).alias("query"),
        F.col("q.query_id").alias("query_id"),
        counted("TOTAL_SHOWS").alias("shows"),
        counted("TOTAL_CLICKS").alias("clicks"),
        indicator("AVG_SHOW_POSITION").alias("avg_show_position"),
        indicator("AVG_CLICK_POSITION").alias("avg_click_position"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def query_page_stats(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Which page collects the shows of a query; the position is weighted by daily shows.

    All days of a query arrive inside one payload item, so the sums are row-local and
    nothing is shuffled.
    """
    keep = _others(raw, payload)
    items = F.from_json(F.col(payload), _PAGES)["text_indicator_to_statistics"]
    rows = raw.select(*keep, F.explode(items).alias("i"))

    def points(name: str) -> Column:
        return F.filter(F.coalesce("i.statistics", F.array().cast("array<struct<date:string,field:string,value:double>>")), lambda s: s["field"] == name)

    def last_by_date(entries: Column) -> Column:
        """date → value; of repeated dates the last one counts."""
        return F.map_from_entries(
            F.filter(
                F.transform(entries, lambda s: F.struct(F.coalesce(s["date"], F.lit("")).alias("d"), F.coalesce(s["value"], F.lit(0.0)).alias("v"))),
                lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: F.coalesce(later["date"], F.lit("")) == e["d"]),
            )
        )

    daily = rows.select(
        *keep,
        F.coalesce("i.text_indicator.value", F.lit("")).alias("query"),
        F.col("i.popular_complementary_indicator.value").alias("url"),
        last_by_date(points("IMPRESSIONS")).alias("by_day"),
        points("POSITION").alias("positions"),
        _sum(F.transform(points("CLICKS"), lambda s: s["value"])).alias("clicks"),
        _sum(F.transform(points("DEMAND"), lambda s: s["value"])).alias("demand"),
    )
    shows = _sum(F.map_values("by_day"))
    weighted = _sum(
        F.transform(
            "positions",
            lambda s: s["value"] * F.coalesce(F.try_element_at(F.col("by_day"), F.coalesce(s["date"], F.lit(""))), F.lit(0.0)),
        )
    )
    days = F.filter(F.map_keys("by_day"), lambda d: d != "")
    return daily.select(
        *keep, "query", "url",
        shows.cast("bigint").alias("shows"),
        F.col("clicks").cast("bigint").alias("clicks"),
        F.col("demand").cast("bigint").alias("demand"),
        F.round(weighted / F.nullif(shows, F.lit(0.0)), 2).alias("avg_position"),
        F.array_min(days).try_cast("date").alias("date_from"),
        F.array_max(days).try_cast("date").alias("date_to"),
    )


def history_series(raw: DataFrame, key: str, payload: str = "response") -> DataFrame:
    """Index-coverage history: first and last readable point of the window and the change."""
    keep = _others(raw, payload)
    shape = f"struct<{key}:{_POINTS},history:{_POINTS}>"
    parsed = F.from_json(F.col(payload), shape)

    def points(p: Column) -> Column:
        series = F.when(F.size(p[key]) > 0, p[key]).otherwise(p["history"])
        return F.array_sort(
            F.transform(
                F.filter(series, lambda t: t["value"].isNotNull() & (F.substring(F.coalesce(t["date"], F.lit("")), 1, 10) != "")),
                lambda t, i: F.struct(
                    F.substring(t["date"], 1, 10).alias("day"), i.alias("i"), t["value"].cast("bigint").alias("value")
                ),
            )
        )

    rows = raw.select(*keep, let(parsed, points).alias("s"))
    first, last = F.get("s", F.lit(0)), F.get("s", F.size("s") - 1)
    return rows.select(
        *keep,
        last["value"].alias("now"), last["day"].alias("now_day"),
        first["value"].alias("was"), first["day"].alias("was_day"),
        (last["value"] - first["value"]).alias("change"),
        F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0)).alias("points"),
    )


def crawl_stats(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Last readable point of every crawl indicator."""
    keep = _others(raw, payload)
    shape = f"struct<indicators:map<string,{_POINTS}>>"
    rows = raw.select(*keep, F.explode(F.from_json(F.col(payload), shape)["indicators"]).alias("indicator", "p"))
    known = F.filter(F.coalesce("p", F.array().cast(_POINTS)), lambda t: t["value"].isNotNull())
    names = F.create_map(*[F.lit(x) for pair in CRAWL_INDICATORS.items() for x in pair])
    return (
        rows.select(*keep, "indicator", F.try_element_at(known, F.lit(-1)).alias("last"))
        .where("last IS NOT NULL")
        .select(
            *keep, "indicator",
            F.coalesce(F.try_element_at(names, F.col("indicator")), "indicator").alias("label"),
            F.col("last.value").cast("bigint").alias("value"),
        )
    )


def landing_page_stats(raw: DataFrame, source: str | None = None, payload: str = "response") -> DataFrame:
    """Behaviour by landing page; a short row is padded with NULL, which is not zero."""
    keep = _others(raw, payload)
    label = f"organic:{source.strip().lower()}" if source else "organic"
    rows = raw.select(*keep, F.explode(F.from_json(F.col(payload), _LANDING)["data"]).alias("d"))
    metric = [F.get("d.metrics", F.lit(i)) for i in range(len(LANDING_METRICS))]
    return rows.select(
        *keep,
        F.get("d.dimensions", F.lit(0))["name"].alias("url"),
        F.lit(label).alias("source"),
        metric[0].cast("bigint").alias("visits"),
        *[m.alias(n) for m, n in zip(metric[1:], LANDING_METRICS[1:])],
    )


def goal_funnel(facts: DataFrame, goals: list, known=None) -> DataFrame:
    """Visits, then goal reaches in the given order, by landing page and in total.

    ``facts`` has one row per visit (``goal`` NULL) or goal reach. ``known`` names the
    goals that exist on the counter: a wanted goal outside it gets no column, so a
    missing instrument never reads as zero (see :func:`missing_goals`).
    """
    present = [g for g in goals if known is None or g in known]
    counts = [F.count_if(F.col("goal").isNull()).alias("visits")]
    counts += [F.count_if(F.col("goal") == g).alias(f"goal_{g}") for g in present]
    # Totals come from the per-page counts, not from a second expansion of the facts.
    by_page = facts.groupBy("url").agg(*counts)
    names = [c for c in by_page.columns if c != "url"]
    total = by_page.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])
    pages = by_page.select("url", F.lit(False).alias("is_total"), *names)
    return pages.unionByName(total.select(F.lit(None).cast(by_page.schema["url"].dataType).alias("url"), F.lit(True).alias("is_total"), *names))


def missing_goals(wanted: DataFrame, counter_goals: DataFrame) -> DataFrame:
    """Wanted goals that do not exist on the counter."""
    return wanted.join(counter_goals.select("goal"), "goal", "left_anti")
