"""Owner-side statistics over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import keys as K
from ..sinks import warehouse as WH
from ..sources import owner as OW


def _day(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def query_ctr(spark, sf):
    return _day(B.search_queries(spark, sf).select("host_id", "query", "date_from", "date_to", K.ctr("clicks", "shows").alias("ctr")), "date_from", "date_to")


def query_stats_from_json(spark, sf):
    q = B.search_queries(spark, sf)
    raw = q.select(
        "host_id", F.col("date_from"), F.col("date_to"),
        F.concat(
            F.lit('{"queries": [{"query_text": "'), "query", F.lit('", "query_id": "q'), F.col("k").cast("string"),
            F.lit('", "indicators": {"TOTAL_SHOWS": '), F.when(F.col("shows") == 0, "null").otherwise(F.col("shows").cast("string")),
            F.lit(', "TOTAL_CLICKS": '), F.col("clicks").cast("string"), F.lit(', "AVG_SHOW_POSITION": '), F.col("avg_show_position").cast("string"), F.lit("}}]}"),
        ).alias("response"),
    )
    return _day(OW.query_stats_from_json(raw), "date_from", "date_to")


def _daily(spark, sf):
    """Daily facts of a query as the nested payload of the source (a month of days at most)."""
    e = B.owner_events(spark, sf)
    day = e.groupBy("host_id", "k", "day").agg(
        F.count_if(F.col("event_type") == "view").alias("shows"), F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "error").alias("demand"),
        F.max(F.floor("value")).alias("position"),
    )

    def stat(field, col):
        return F.concat(F.lit('{"date": "'), F.col("day").cast("string"), F.lit(f'", "field": "{field}", "value": '), F.col(col).cast("string"), F.lit("}"))

    stats = F.concat_ws(",", stat("IMPRESSIONS", "shows"), stat("CLICKS", "clicks"), stat("DEMAND", "demand"), stat("POSITION", "position"))
    return day.groupBy("host_id", "k").agg(
        F.concat(
            F.lit('{"text_indicator_to_statistics": [{"text_indicator": {"value": "query '), F.col("k").cast("string"),
            F.lit('"}, "popular_complementary_indicator": {"value": "/page-'), F.col("k").cast("string"), F.lit('"}, "statistics": ['),
            F.array_join(F.array_sort(F.collect_list(stats)), ","), F.lit("]}]}"),
        ).alias("response")
    )


def weighted_position(spark, sf):
    return _day(OW.query_page_stats(_daily(spark, sf).drop("k")), "date_from", "date_to")


def history_series(spark, sf):
    day = B.owner_events(spark, sf).groupBy("host_id", "day").agg(F.count(F.lit(1)).alias("n"))
    point = F.concat(F.lit('{"date": "'), F.col("day").cast("string"), F.lit('T00:00:00", "value": '), F.when(F.dayofmonth("day") % 7 == 0, "null").otherwise(F.col("n").cast("string")), F.lit("}"))
    raw = day.groupBy("host_id").agg(F.concat(
        F.lit('{"'), F.when(F.substring("host_id", 12, 1).cast("int") % 2 == 0, "history").otherwise("in_search_url_count"), F.lit('": ['),
        F.array_join(F.sort_array(F.collect_list(point), asc=False), ","), F.lit("]}"),
    ).alias("response"))
    return OW.history_series(raw, "in_search_url_count")


def crawl_stats(spark, sf):
    day = B.owner_events(spark, sf).groupBy("host_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    name = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "SEARCHABLE"), ("click", "DOWNLOADED"), ("signup", "HTTP_2XX"), ("purchase", "HTTP_4XX"), ("error", "OTHER")) for x in p]), F.col("event_type"))
    point = F.concat(F.lit('{"date": "'), F.col("day").cast("string"), F.lit('", "value": '), F.when(F.dayofmonth("day") > 25, "null").otherwise(F.col("n").cast("string")), F.lit("}"))
    series = day.groupBy("host_id", name.alias("indicator")).agg(F.array_join(F.array_sort(F.collect_list(point)), ",").alias("points"))
    raw = series.groupBy("host_id").agg(F.concat(F.lit('{"indicators": {'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "indicator", F.lit('": ['), "points", F.lit("]")))), ","), F.lit("}}")).alias("response"))
    return OW.crawl_stats(raw)


def landing_page_stats(spark, sf):
    e = B.owner_events(spark, sf).groupBy("host_id", "k").agg(F.count(F.lit(1)).alias("visits"), F.count_if(F.col("event_type") == "error").alias("errors"))
    raw = e.select("host_id", F.concat(
        F.lit('{"data": [{"dimensions": [{"name": "https://site.example/page-'), F.col("k").cast("string"), F.lit('"}], "metrics": ['), F.col("visits").cast("string"),
        F.when(F.col("errors") > 0, F.concat(F.lit(", "), F.col("errors").cast("string"))).otherwise(""), F.lit("]}]}"),
    ).alias("response"))
    return OW.landing_page_stats(raw, "Yandex ")


def goal_funnel(spark, sf):
    e = B.owner_events(spark, sf).where(F.col("event_type").isin("view", "signup", "purchase"))
    facts = e.select(F.concat(F.lit("/page-"), F.col("k").cast("string")).alias("url"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("goal"))
    return OW.goal_funnel(facts, ["signup", "purchase", "call"], known={"signup", "purchase"})


def missing_goals(spark, sf):
    have = B.table(spark, sf, "events").select(F.col("event_type").alias("goal")).distinct()
    wanted = B.table(spark, sf, "part").select(F.lower("p_type").alias("goal")).distinct().unionByName(have)
    return OW.missing_goals(wanted, have)


def latest_window(spark, sf):
    return _day(WH.latest_window(B.search_queries(spark, sf), ["host_id"]), "date_from", "date_to", "fetched_at")


def window_totals(spark, sf):
    return _day(WH.window_totals(B.search_queries(spark, sf)), "date_from", "date_to", "fetched_at")


def warehouse_stats(spark, sf):
    return WH.warehouse_stats({"snapshots": B.snapshots(spark, sf), "docs": B.lines(spark, sf), "projects": B.table(spark, sf, "nation")}, B.snapshots(spark, sf), B.search_queries(spark, sf))


def pages_by_query_latest(spark, sf):
    return _day(WH.pages_by_query_latest(B.search_query_pages(spark, sf)), "date_from", "date_to", "fetched_at")


def _loads(spark, sf):
    rows = B.search_query_pages(spark, sf).drop("k")
    # of a page's load the earlier pull knows the position, the later one the counts
    base = rows.withColumn("shows", F.when(F.col("shows") > 0, F.col("shows"))).withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY"))
    new = rows.where(F.dayofmonth("date_from") % 3 > 0).withColumn("avg_position", F.lit(None).cast("double")).withColumn("shows", F.when(F.col("shows") != 1, F.col("shows")))
    return base, new


def upsert_window(spark, sf):
    base, new = _loads(spark, sf)
    return _day(WH.upsert_window(base, new, ["host_id", "query", "date_from", "date_to"]), "date_from", "date_to", "fetched_at")


def landing_pages_map(spark, sf):
    rows = B.search_query_pages(spark, sf).where("url IS NOT NULL").groupBy(
        F.col("host_id").alias("counter"), F.lit("organic").alias("source"), F.concat(F.lit("https://Site.example"), "url").alias("url"), "date_from", "date_to"
    ).agg(F.sum("shows").alias("visits"), F.max("fetched_at").alias("fetched_at"))
    return _day(WH.landing_pages_map(rows), "date_from", "date_to", "fetched_at")


def upsert_core(spark, sf):
    return WH.upsert_core(_core(spark, sf, 1), _core(spark, sf, 2))


def _core(spark, sf, wave):
    """Two collection passes over the parts: the second measures less and drops some."""
    p = B.table(spark, sf, "part")
    key = F.col("p_partkey")
    kept = p.where(key % 5 != wave)
    phrase = F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), key.cast("string"))
    verdict = F.when(key % 7 == wave, WH.DROP).when(F.col("p_size") % 3 == wave, WH.EDGE).otherwise(WH.CORE)
    none = F.lit(None)
    return kept.select(
        (key % 4).cast("bigint").alias("project_id"), phrase.alias("phrase"), F.lit(f"kind{wave}").alias("kind"),
        F.when(key % 3 != wave, F.col("p_size")).alias("freq"), F.lit(f"pass{wave}").alias("source"),
        F.when(key % 2 == wave % 2, F.col("p_size") > 20).alias("commercial"),
        F.when(key % 2 == wave % 2, F.col("p_retailprice")).alias("competition"),
        F.when(key % 6 == wave, F.col("p_size")).alias("our_position"),
        F.when(key % 2 == wave % 2, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("top_domains"),
        verdict.alias("verdict"), F.lit(f"reason{wave}").alias("reason"), none.cast("string").alias("collected_at"),
    )


def upsert_core_flat(spark, sf):
    return upsert_core(spark, sf).withColumn("top_domains", F.array_join("top_domains", ",")).drop("collected_at")


D = "strftime({}, '%Y-%m-%d')".format
_CORE_SQL = """core{w} AS (SELECT CAST(p_partkey % 4 AS BIGINT) AS project_id, p_name || ' ' || p_type || ' ' || p_partkey AS phrase, 'kind{w}' AS kind,
 CASE WHEN p_partkey % 3 <> {w} THEN p_size END AS freq, 'pass{w}' AS source, CASE WHEN p_partkey % 2 = {w} % 2 THEN p_size > 20 END AS commercial,
 CASE WHEN p_partkey % 2 = {w} % 2 THEN p_retailprice END AS competition, CASE WHEN p_partkey % 6 = {w} THEN p_size END AS our_position,
 CASE WHEN p_partkey % 2 = {w} % 2 THEN p_brand ELSE '' END AS top_domains,
 CASE WHEN p_partkey % 7 = {w} THEN 'отбросить' WHEN p_size % 3 = {w} THEN 'периферия' ELSE 'ядро' END AS verdict, 'reason{w}' AS reason FROM part WHERE p_partkey % 5 <> {w})"""
WINDOWS = B.SEARCH_QUERY_PAGES + """,
best AS (
  SELECT host_id, date_from, date_to FROM (
    SELECT host_id, date_from, date_to, row_number() OVER (PARTITION BY host_id ORDER BY date_to DESC, max(fetched_at) DESC, date_from) AS rn
    FROM search_queries GROUP BY host_id, date_from, date_to) WHERE rn = 1
)"""
QUERIES = {
    "query_ctr": (query_ctr, f"WITH {B.SEARCH_QUERIES} SELECT host_id, query, {D('date_from')} AS date_from, {D('date_to')} AS date_to, round(100.0 * clicks / nullif(shows, 0), 2) AS ctr FROM search_queries"),
    "query_stats_from_json": (query_stats_from_json, f"WITH {B.SEARCH_QUERIES} SELECT host_id, {D('date_from')} AS date_from, {D('date_to')} AS date_to, query, 'q' || k AS query_id, shows, clicks, avg_show_position, CAST(NULL AS DOUBLE) AS avg_click_position FROM search_queries"),
    "weighted_position": (weighted_position, f"WITH {B.SEARCH_QUERIES}, d AS (SELECT host_id, k, day, count(*) FILTER (event_type = 'view') AS shows, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS demand, max(floor(value)) AS position FROM owner_events GROUP BY ALL) SELECT host_id, 'query ' || k AS query, '/page-' || k AS url, CAST(sum(shows) AS BIGINT) AS shows, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(demand) AS BIGINT) AS demand, round(sum(position * shows ORDER BY day) / nullif(sum(shows), 0), 2) AS avg_position, strftime(min(day), '%Y-%m-%d') AS date_from, strftime(max(day), '%Y-%m-%d') AS date_to FROM d GROUP BY host_id, k"),
    "history_series": (history_series, f"WITH {B.SEARCH_QUERIES}, d AS (SELECT host_id, day, count(*) AS n FROM owner_events WHERE day(day) % 7 <> 0 GROUP BY ALL) SELECT host_id, arg_max(n, day) AS now, strftime(max(day), '%Y-%m-%d') AS now_day, arg_min(n, day) AS was, strftime(min(day), '%Y-%m-%d') AS was_day, arg_max(n, day) - arg_min(n, day) AS change, count(*) AS points FROM d GROUP BY host_id"),
    "crawl_stats": (crawl_stats, f"WITH {B.SEARCH_QUERIES}, d AS (SELECT host_id, event_type, day, count(*) AS n FROM owner_events WHERE day(day) <= 25 GROUP BY ALL), names AS (SELECT * FROM (VALUES ('view', 'SEARCHABLE', 'в поиске'), ('click', 'DOWNLOADED', 'робот скачал'), ('signup', 'HTTP_2XX', 'отвечают нормально'), ('purchase', 'HTTP_4XX', 'отвечают ошибкой 4xx'), ('error', 'OTHER', 'OTHER')) v(event_type, indicator, label)) SELECT host_id, indicator, label, arg_max(n, day) AS value FROM d JOIN names USING (event_type) GROUP BY host_id, indicator, label"),
    "landing_page_stats": (landing_page_stats, f"WITH {B.SEARCH_QUERIES} SELECT host_id, 'https://site.example/page-' || k AS url, 'organic:yandex' AS source, count(*) AS visits, CAST(nullif(count(*) FILTER (event_type = 'error'), 0) AS DOUBLE) AS bounce_rate, CAST(NULL AS DOUBLE) AS page_depth, CAST(NULL AS DOUBLE) AS avg_duration FROM owner_events GROUP BY host_id, k"),
    "goal_funnel": (goal_funnel, f"WITH {B.SEARCH_QUERIES} SELECT '/page-' || k AS url, grouping(k) = 1 AS is_total, count(*) FILTER (event_type = 'view') AS visits, count(*) FILTER (event_type = 'signup') AS goal_signup, count(*) FILTER (event_type = 'purchase') AS goal_purchase FROM owner_events WHERE event_type IN ('view', 'signup', 'purchase') GROUP BY ROLLUP (k)"),
    "missing_goals": (missing_goals, "SELECT DISTINCT lower(p_type) AS goal FROM part WHERE lower(p_type) NOT IN (SELECT event_type FROM events)"),
    "latest_window": (latest_window, f"WITH {WINDOWS} SELECT s.* REPLACE ({D('s.date_from')} AS date_from, {D('s.date_to')} AS date_to, {D('fetched_at')} AS fetched_at) FROM search_queries s JOIN best b ON s.host_id = b.host_id AND s.date_from = b.date_from AND s.date_to = b.date_to"),
    "window_totals": (window_totals, f"WITH {WINDOWS} SELECT s.host_id, {D('s.date_from')} AS date_from, {D('s.date_to')} AS date_to, {D('max(fetched_at)')} AS fetched_at, count(*) AS queries, CAST(sum(shows) AS BIGINT) AS shows, CAST(sum(clicks) AS BIGINT) AS clicks FROM search_queries s JOIN best b ON s.host_id = b.host_id AND s.date_from = b.date_from AND s.date_to = b.date_to GROUP BY s.host_id, s.date_from, s.date_to"),
    "warehouse_stats": (warehouse_stats, f"WITH {WINDOWS}, t AS (SELECT CAST(sum(shows) AS BIGINT) AS s, CAST(sum(clicks) AS BIGINT) AS c FROM search_queries JOIN best USING (host_id, date_from, date_to)) SELECT 'snapshots' AS metric, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'docs', CAST(count(*) AS VARCHAR) FROM lineitem UNION ALL SELECT 'projects', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'first_snapshot', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'last_snapshot', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'shows_all_hosts', CAST(s AS VARCHAR) FROM t UNION ALL SELECT 'clicks_all_hosts', CAST(c AS VARCHAR) FROM t"),
    "pages_by_query_latest": (pages_by_query_latest, f"WITH {WINDOWS} SELECT host_id, query AS query_key, query, k, shows, clicks, avg_position, url, {D('date_from')} AS date_from, {D('date_to')} AS date_to, {D('fetched_at')} AS fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY host_id, query ORDER BY fetched_at DESC, date_from) AS rn FROM (SELECT *, max(date_to) OVER (PARTITION BY host_id, query) AS own FROM search_query_pages) WHERE date_to = own AND url IS NOT NULL) WHERE rn = 1"),
    "upsert_window": (upsert_window, f"WITH {WINDOWS} SELECT host_id, query, {D('date_from')} AS date_from, {D('date_to')} AS date_to, CASE WHEN day(date_from) % 3 > 0 THEN CASE WHEN shows <> 1 THEN shows ELSE 1 END ELSE nullif(shows, 0) END AS shows, clicks, avg_position, strftime(CASE WHEN day(date_from) % 3 > 0 THEN fetched_at ELSE fetched_at - INTERVAL 1 DAY END, '%Y-%m-%d') AS fetched_at, url FROM search_query_pages"),
    "landing_pages_map": (landing_pages_map, f"WITH {WINDOWS}, m AS (SELECT host_id AS counter, 'https://Site.example' || url AS url, date_from, date_to, CAST(sum(shows) AS BIGINT) AS visits, max(fetched_at) AS fetched_at FROM search_query_pages WHERE url IS NOT NULL GROUP BY ALL), b AS (SELECT counter, date_from, date_to FROM (SELECT counter, date_from, date_to, row_number() OVER (PARTITION BY counter ORDER BY date_to DESC, max(fetched_at) DESC, date_from) AS rn FROM m GROUP BY counter, date_from, date_to) WHERE rn = 1) SELECT * EXCLUDE (rn) REPLACE ({D('date_from')} AS date_from, {D('date_to')} AS date_to, {D('fetched_at')} AS fetched_at) FROM (SELECT m.counter, 'organic' AS source, rtrim(regexp_extract(url, '(/page.*)$', 1), '/') AS path_key, url, m.date_from, m.date_to, visits, fetched_at, row_number() OVER (PARTITION BY m.counter, rtrim(regexp_extract(url, '(/page.*)$', 1), '/') ORDER BY visits, url) AS rn FROM m JOIN b ON m.counter = b.counter AND m.date_from = b.date_from AND m.date_to = b.date_to) WHERE rn = 1"),
    "upsert_core": (upsert_core_flat, f"WITH {_CORE_SQL.format(w=1)}, {_CORE_SQL.format(w=2)} SELECT coalesce(n.project_id, b.project_id) AS project_id, coalesce(n.phrase, b.phrase) AS phrase, CASE WHEN n.verdict IS NULL THEN b.kind ELSE n.kind END AS kind, CASE WHEN n.verdict IS NULL THEN b.freq ELSE n.freq END AS freq, coalesce(n.source, b.source) AS source, coalesce(n.commercial, b.commercial) AS commercial, coalesce(n.competition, b.competition) AS competition, coalesce(n.our_position, b.our_position) AS our_position, CASE WHEN coalesce(n.top_domains, '') <> '' THEN n.top_domains ELSE coalesce(b.top_domains, n.top_domains) END AS top_domains, CASE WHEN n.verdict IS NULL THEN b.verdict WHEN n.verdict = 'отбросить' THEN n.verdict WHEN n.competition IS NULL AND n.our_position IS NULL AND b.verdict = 'ядро' THEN b.verdict ELSE n.verdict END AS verdict, coalesce(n.reason, b.reason) AS reason FROM core1 b FULL JOIN core2 n ON n.project_id = b.project_id AND n.phrase = b.phrase"),
}
