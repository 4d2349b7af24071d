"""Action plan over events (owner data, ranks, registry), orders (results) and pages (findings)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import keys as K
from ..functions import lists as L
from ..operators import ranks as R
from ..plans import actions as P
from ..session import checkpointed
from ..sinks import warehouse as WH
from . import audit as AUDIT


class Inputs:
    """What the rules share, each stored once for one query."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    latest = cached_property(lambda self: _latest(self.spark, self.sf))
    history = cached_property(lambda self: _history(self.spark, self.sf))
    articles = cached_property(lambda self: _articles(self.spark, self.sf))
    newest = cached_property(lambda self: checkpointed(P.newest_snapshots(B.docs(self.spark, self.sf, "nation"), B.snapshots(self.spark, self.sf))))
    items = cached_property(lambda self: checkpointed(P.query_items(self.latest, _pages(self.spark, self.sf), self.history.where("n = 1"), _demand(self.spark, self.sf))))
    own_docs = cached_property(lambda self: _own_docs(self.newest))
    evidence = cached_property(lambda self: checkpointed(
        P.cannibalization_evidence(self.articles, _report(self.articles), _window_pages(self.spark, self.sf), self.own_docs, self.history)))
    gaps = cached_property(lambda self: _gap_inputs(self.spark, self.sf, self.newest))


def _latest(spark, sf):
    """Latest load per site; the shows are scaled so that the published thresholds bite."""
    rows = WH.latest_window(B.search_queries(spark, sf), ["host_id"]).withColumnRenamed("host_id", "site")
    return checkpointed(rows.withColumn("shows", F.col("shows") * 40))


def _pages(spark, sf):
    return WH.pages_by_query_latest(B.search_query_pages(spark, sf)).select(F.col("host_id").alias("site"), "query_key", "url", "date_from", "date_to", "fetched_at")


def _ranks(spark, sf):
    """Daily ranks from the largest value of a query's day; nine in ten days have a page."""
    e = B.owner_events(spark, sf)
    day = e.groupBy("host_id", "k", "day").agg((F.max(F.floor("value")) % 23).cast("int").alias("position"), F.count(F.lit(1)).alias("n"))
    return day.select(
        F.concat_ws("/", "host_id", F.col("k").cast("string"), F.col("day").cast("string")).alias("id"), F.col("host_id").alias("site"),
        F.concat(F.lit("query "), F.col("k").cast("string")).alias("query"), F.col("k"),
        F.when(F.col("position") > 0, F.col("position")).alias("position"),
        F.when((F.col("k") + F.dayofmonth("day")) % 10 > 0, F.concat(F.lit("https://site.example/page-"), ((F.col("k") + F.dayofmonth("day") % 2) % 37).cast("string"), F.lit("/"))).alias("url"),
        F.col("day").cast("timestamp").alias("checked_at"),
    )


def _history(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("site", "query").orderBy(F.desc("checked_at"), F.desc("id"))
    return checkpointed(_ranks(spark, sf).withColumn("n", F.row_number().over(order)).where("n <= 2"))


def _demand(spark, sf):
    e = B.owner_events(spark, sf).where("event_type = 'purchase'")
    return e.groupBy(F.col("host_id").alias("site"), F.concat(F.lit("query "), F.col("k").cast("string")).alias("query_key")).agg((F.count(F.lit(1)) * 10).alias("freq"))


LATEST = B.SEARCH_QUERY_PAGES + """,
best AS (
  SELECT host_id, date_from, date_to FROM (
    SELECT host_id, date_from, date_to, row_number() OVER (PARTITION BY host_id ORDER BY date_to DESC, max(fetched_at) DESC, date_from) AS rn
    FROM search_queries GROUP BY host_id, date_from, date_to) WHERE rn = 1
),
latest AS (SELECT s.* REPLACE (s.shows * 40 AS shows) FROM search_queries s JOIN best USING (host_id, date_from, date_to)),
page_map AS (
  SELECT * FROM (SELECT host_id, query, k, url, row_number() OVER (PARTITION BY host_id, query ORDER BY fetched_at DESC, date_from) AS rn
    FROM (SELECT *, max(date_to) OVER (PARTITION BY host_id, query) AS own FROM search_query_pages) WHERE date_to = own AND url IS NOT NULL) WHERE rn = 1
),
ranks AS (
  SELECT host_id, k, 'query ' || k AS query, day, nullif(CAST(max(floor(value)) AS INTEGER) % 23, 0) AS position,
         CASE WHEN (k + day(day)) % 10 > 0 THEN '/page-' || ((k + day(day) % 2) % 37) END AS page
  FROM owner_events GROUP BY host_id, k, day
),
last_ranks AS (SELECT *, row_number() OVER (PARTITION BY host_id, k ORDER BY day DESC) AS n FROM ranks),
demand AS (SELECT host_id, k, count(*) * 10 AS freq FROM owner_events WHERE event_type = 'purchase' GROUP BY ALL),
routed AS (
  SELECT *, CASE WHEN shows >= 30 AND clicks = 0 AND avg_show_position <= 10 THEN 'snippet' WHEN avg_show_position BETWEEN 4 AND 15 AND shows >= 10 THEN 'quick_wins' END AS section FROM latest
),
items AS (
  SELECT r.host_id AS site, section, r.query, r.shows, r.clicks, r.avg_show_position AS position, NULL AS freq, 'owner' AS source, m.url AS page, CASE WHEN m.url IS NULL THEN 'no_page' END AS skipped
  FROM routed r LEFT JOIN page_map m ON m.host_id = r.host_id AND m.query = r.query WHERE section IS NOT NULL
  UNION ALL
  SELECT t.host_id, 'quick_wins', t.query, NULL, NULL, CAST(t.position AS DOUBLE), d.freq, 'tracker', t.page || '/', CASE WHEN d.freq IS NULL THEN 'no_demand' WHEN t.page IS NULL THEN 'no_page' END
  FROM last_ranks t LEFT JOIN demand d ON d.host_id = t.host_id AND d.k = t.k
  WHERE n = 1 AND t.position BETWEEN 4 AND 15 AND NOT EXISTS (SELECT 1 FROM routed r WHERE r.section IS NOT NULL AND r.host_id = t.host_id AND r.query = t.query)
),
kept AS (SELECT *, rtrim(page, '/') AS page_key FROM items WHERE skipped IS NULL),
main AS (SELECT *, row_number() OVER (PARTITION BY site, section, page_key ORDER BY coalesce(shows, 0) DESC, CASE WHEN source = 'tracker' THEN position ELSE 99 END, query) AS rn FROM kept),
grouped AS (
  SELECT site, section, page_key, CAST(sum(coalesce(shows, 0)) AS BIGINT) AS total, count(*) AS count, max(query) FILTER (rn = 1) AS query, max(page) FILTER (rn = 1) AS url,
         max(freq) FILTER (rn = 1) AS freq, max(source) FILTER (rn = 1) AS source
  FROM main GROUP BY site, section, page_key
)"""


def _flat(actions):
    return actions.select("site", "section", "rule", "url", "query", "count", F.size("evidence").cast("bigint").alias("evidence"), *["k1", "k2", "k3", "k4", "tie"])


def quick_win_items(spark, sf):
    return Inputs(spark, sf).items.select("site", "section", "query", "shows", "clicks", "position", "freq", "source", F.col("path").alias("path"), "skipped")


def skipped_queries(spark, sf):
    return P.skipped_queries(Inputs(spark, sf).items)


def quick_wins(spark, sf):
    return _flat(P.quick_wins(Inputs(spark, sf).items))


def snippet_actions(spark, sf):
    return _flat(P.snippet_actions(Inputs(spark, sf).items))


def pages_in_both(spark, sf):
    items = Inputs(spark, sf).items
    rows = P.page_sections(P.page_actions(items))
    return rows.groupBy("site", "section", "in_both").agg(F.count(F.lit(1)).alias("items"))


# --- cannibalization ----------------------------------------------------------------------


def _articles(spark, sf):
    """One page per query, and a second one in another word order for every seventh."""
    e = B.owner_events(spark, sf).select(F.col("host_id").alias("site"), "k").distinct()
    first = e.select("site", F.concat(F.lit("https://site.example/page-"), (F.col("k") % 41).cast("string"), F.lit("/")).alias("url"), F.concat(F.lit("query "), F.col("k").cast("string")).alias("target_query"))
    second = e.where("k % 7 = 0").select("site", F.concat(F.lit("/post-"), F.col("k").cast("string")).alias("url"), F.concat(F.col("k").cast("string"), F.lit(" query")).alias("target_query"))
    return checkpointed(first.unionByName(second).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))


def _report(articles):
    """Every fifth article is replaced by the next page."""
    a = articles.where("url LIKE 'https%'")
    no = F.regexp_extract("url", r"page-(\d+)", 1).try_cast("int")
    return a.select("site", "url", "target_query", F.when(no % 5 == 0, L.REPLACED).otherwise(L.WORKS).alias("verdict"), F.concat(F.lit("/page-"), (no + 1).cast("string")).alias("ranking_url"), F.col("created_at").alias("checked_at"))


def _own_docs(docs):
    """Own documents of the newest snapshot of each query, spread over the sites by nation."""
    number = F.regexp_extract("domain", r"nation-(\d+)", 1).try_cast("int")
    return docs.where(~F.col("is_wizard")).select(F.concat(F.lit("https:site-"), (number % 10).cast("string"), F.lit(".example:443")).alias("site"), "query", "region", "url", "position", "fetched_at")


def _window_pages(spark, sf):
    rows = WH.latest_window(B.search_query_pages(spark, sf), ["host_id"]).withColumnRenamed("host_id", "site")
    return checkpointed(rows.withColumn("shows", F.col("shows") * 40))


def cannibalization_evidence(spark, sf):
    return Inputs(spark, sf).evidence.groupBy("site", "stem_key", "rule").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("page_key").alias("pages"))


def cannibalization_actions(spark, sf):
    inputs = Inputs(spark, sf)
    return _flat(P.cannibalization_actions(inputs.evidence, inputs.latest))


CANNIBAL = LATEST + "," + B.docs_cte("nation") + """,
arts AS (
  SELECT DISTINCT host_id AS site, '/page-' || (k % 41) AS page, k % 41 AS no, 'query ' || k AS q, k || ' query' AS stem, 'https://site.example/page-' || (k % 41) || '/' AS url, '/page-' || (k % 41) || '/' AS path FROM owner_events
  UNION ALL SELECT DISTINCT host_id, '/post-' || k, NULL, k || ' query', k || ' query', '/post-' || k, '/post-' || k FROM owner_events WHERE k % 7 = 0
),
disputed AS (SELECT site, stem FROM arts GROUP BY site, stem HAVING count(DISTINCT page) > 1),
stray AS (
  SELECT p.host_id AS site, p.k || ' query' AS stem, p.query AS q, rtrim(p.url, '/') AS page, p.url AS path, (SELECT arg_min(a.path, a.url) FROM arts a WHERE a.site = p.host_id AND a.stem = p.k || ' query') AS claimed_path, (SELECT arg_min(a.page, a.url) FROM arts a WHERE a.site = p.host_id AND a.stem = p.k || ' query') AS claimed
  FROM search_query_pages p JOIN best b ON b.host_id = p.host_id AND b.date_from = p.date_from AND b.date_to = p.date_to
  WHERE p.shows * 40 >= 10 AND p.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM arts a WHERE a.site = p.host_id AND a.stem = p.k || ' query' AND a.page = rtrim(p.url, '/'))
),
newest AS (SELECT query, region, last(snapshot_id ORDER BY fetched_at, snapshot_id) AS snapshot_id FROM snapshots WHERE error IS NULL GROUP BY ALL),
own_docs AS (
  SELECT 'https:site-' || (CAST(regexp_extract(domain, 'nation-(\\d+)', 1) AS INTEGER) % 10) || '.example:443' AS site, d.query AS q,
         d.region, list_aggregate(list_sort(regexp_extract_all(lower(d.query), '[0-9a-z]+')), 'string_agg', ' ') AS stem, coalesce(nullif(rtrim(regexp_extract(d.url, '^https://[^/]+(.*)$', 1), '/'), ''), '/') AS page, regexp_extract(d.url, '^https://[^/]+(.*)$', 1) AS path
  FROM docs d JOIN newest n ON n.snapshot_id = d.snapshot_id WHERE NOT is_wizard
),
doubled AS (SELECT site, q, region FROM own_docs GROUP BY site, q, region HAVING count(DISTINCT page) > 1),
moved AS (SELECT host_id AS site, k FROM last_ranks WHERE n <= 2 AND page IS NOT NULL GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT page) = 2),
told AS (
  SELECT a.site, a.stem, a.q, a.page, a.path, 'registry' AS rule, 0 AS ro FROM arts a JOIN disputed USING (site, stem)
  UNION ALL SELECT site, stem, q, page, path, 'replaced', 1 FROM arts WHERE no % 5 = 0
  UNION ALL SELECT site, stem, q, '/page-' || (no + 1), '/page-' || (no + 1), 'replaced', 1 FROM arts WHERE no % 5 = 0
  UNION ALL SELECT site, stem, q, claimed, claimed_path, 'owner', 2 FROM stray WHERE claimed IS NOT NULL
  UNION ALL SELECT site, stem, q, page, path, 'owner', 2 FROM stray WHERE claimed IS NOT NULL
  UNION ALL SELECT o.site, o.stem, o.q, o.page, o.path, 'serp', 3 FROM own_docs o JOIN doubled USING (site, q, region)
  UNION ALL SELECT l.host_id, l.k || ' query', l.query, l.page, l.page || '/', 'tracker', 4 FROM last_ranks l JOIN moved m ON m.site = l.host_id AND m.k = l.k WHERE n <= 2
)"""


# --- gaps ---------------------------------------------------------------------------------


def _sites(spark, sf):
    n = B.table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("site"), F.concat(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit(".example")).alias("domain"), F.col("n_nationkey").alias("no"))


def _candidates(spark, sf):
    """A site asks for the queries of its own region."""
    q = B.snapshots(spark, sf).select("query", "region").distinct()
    return _sites(spark, sf).join(B.table(spark, sf, "nation").select(F.col("n_name").alias("site"), F.col("n_regionkey").alias("region")), "site").join(q, "region").select("site", "query", "region", "no")


def _gap_inputs(spark, sf, docs):
    cand = _candidates(spark, sf)
    articles = cand.where("(length(query) + no) % 4 = 0").select("site", F.col("query").alias("target_query"))
    owner = cand.where("(length(query) + no) % 5 = 0").select("site", "query", F.lit(3).alias("shows"))
    pages = cand.where("(length(query) + no) % 7 = 0").select("site", K.squeezed("query").alias("query_key"))
    freq = B.snapshots(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("freq"))
    demand = cand.join(freq, "query").select("site", F.lower("query").alias("query_key"), "freq")
    return cand.select("site", "query", "region"), docs, _sites(spark, sf).select("site", "domain"), articles, owner, pages, demand


def gap_rivals(spark, sf):
    cand, docs, sites, *_ = Inputs(spark, sf).gaps
    return P.gap_rivals(cand, docs, sites)


def gap_actions(spark, sf):
    return _flat(P.gap_actions(*Inputs(spark, sf).gaps))


GAPS = B.docs_cte("nation") + """,
newest AS (SELECT query, region, last(snapshot_id ORDER BY fetched_at, snapshot_id) AS snapshot_id FROM snapshots WHERE error IS NULL GROUP BY ALL),
"""
GAP_REST = """
top AS (SELECT d.query, d.region, domain, min(position) AS position, arg_min(url, position) AS url FROM docs d JOIN newest n ON n.snapshot_id = d.snapshot_id GROUP BY ALL),
cand AS (SELECT n_name AS site, replace(lower(n_name), '_', '-') || '.example' AS own, n_nationkey AS no, q.query, q.region, q.freq FROM nation JOIN (SELECT query, region, count(*) AS freq FROM snapshots GROUP BY ALL) q ON q.region = n_regionkey),
rival_counts AS (SELECT site, domain, count(*) AS queries FROM cand JOIN top USING (query, region) WHERE domain <> own GROUP BY ALL HAVING count(*) >= 2),
rivals AS (SELECT site, domain, queries FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY queries DESC, domain) AS n FROM rival_counts) WHERE n <= 5),
free AS (SELECT * FROM cand c WHERE (length(query) + no) % 4 <> 0 AND (length(query) + no) % 5 <> 0 AND (length(query) + no) % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query = c.query AND t.region = c.region AND t.domain = c.own)),
standing AS (SELECT f.site, f.query, f.region, f.freq, t.domain, t.position, t.url FROM free f JOIN rivals r ON r.site = f.site JOIN top t ON t.query = f.query AND t.region = f.region AND t.domain = r.domain)"""
GAPS += GAP_REST


# --- findings and the whole plan ----------------------------------------------------------


def _findings(spark, sf, facts=None):
    rows = AUDIT._all(spark, sf, facts)
    return checkpointed(rows).withColumn("measured_at", F.lit("2024-01-31").cast("timestamp"))


def finding_actions(spark, sf):
    facts = AUDIT._stored(spark, sf)
    ready = AUDIT.ready_findings(spark, sf, facts).drop("severity_rank").withColumn("measured_at", F.lit("2024-01-31").cast("timestamp"))
    return _flat(P.finding_actions(_findings(spark, sf, facts), ready))


def finding_actions_audit(spark, sf):
    return P.finding_actions(_findings(spark, sf)).groupBy("site", "section", "rule", "k1").agg(F.sum("count").alias("findings"), F.count(F.lit(1)).alias("items"))


def _one_key(column):
    """The key of an owner's site by its number."""
    return F.concat(F.lit("https:site-"), column.cast("string"), F.lit(".example:443"))


def _owner_of(host):
    """Crawled hosts belong to the ten sites by a hash of their address."""
    return _one_key(F.conv(F.substring(F.md5(host), 1, 4), 16, 10).cast("int") % 10)


def _whole_plan(spark, sf, limit):
    """(actions, plan) of all seven sections, every section under the key of an owner's site; the actions are stored."""
    inputs = Inputs(spark, sf)
    cand, docs, sites, articles, owner, pages, demand = inputs.gaps
    number = _sites(spark, sf).select("site", _one_key(F.col("no")).alias("key"))
    keyed = lambda df: df.join(number, "site").drop("site").withColumnRenamed("key", "site")
    by_host = lambda df: df.withColumn("site", _owner_of(F.col("site"))).withColumn("measured_at", F.lit("2024-01-31").cast("timestamp"))
    facts = AUDIT._stored(spark, sf)  # pages are parsed once
    queries = inputs.latest.select("site", "query", F.col("shows").cast("long").alias("shows")).unionByName(keyed(owner).select("site", "query", F.col("shows").cast("long").alias("shows")))
    actions, _ = P.build_plan(
        keyed(sites), inputs.items, queries, inputs.evidence, keyed(cand), docs, keyed(articles), keyed(pages), keyed(demand),
        by_host(checkpointed(AUDIT._all(spark, sf, facts))), by_host(checkpointed(AUDIT.ready_findings(spark, sf, facts))), limit=limit,
    )
    actions = checkpointed(actions)
    return actions, P.action_plan(actions, limit)


def plan_ranked(spark, sf):
    _, plan = _whole_plan(spark, sf, 10)
    return plan.select("site", "place", "section", "rule", "url", "query", "count", "k1", "k2")


def plan_all_sections(spark, sf):
    """Every item of every section with its place."""
    _, plan = _whole_plan(spark, sf, 1 << 30)
    return plan.select("site", "place", "section", "rule", "url", "query", "count", F.size("evidence").cast("bigint").alias("evidence"), "k1", "k2", "k3", "k4", "tie")


def plan_hidden(spark, sf):
    return P.hidden_counts(*_whole_plan(spark, sf, 10))


def plan_missing(spark, sf):
    sites = B.owner_events(spark, sf).select(F.col("host_id").alias("site")).distinct()
    inputs = Inputs(spark, sf)
    return P.missing_notes(sites, inputs.latest, inputs.history, inputs.own_docs, inputs.items, "2024-03-20 00:00:00")


def reusable_audits(spark, sf):
    """Orders as audit runs of their customers' addresses."""
    o = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://c-"), F.col("o_custkey").cast("string"), F.lit(".example/")).alias("url"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"),
        F.lit(30).alias("pages"), (F.col("o_orderkey") % 9).alias("findings"),
    )
    return P.reusable_audits(o, "2001-08-02 00:00:00").withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


def list_audits(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return R.list_audits(o, limit=20).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


_PAGE_ACTIONS = "SELECT site, section, CASE WHEN section = 'snippet' THEN 'shows_without_clicks' ELSE source || '_position_band' END AS rule, url, query, count, least(count, 5) AS evidence, CAST(-total AS DOUBLE) AS k1, CAST(-coalesce(freq, 0) AS DOUBLE) AS k2, CAST(0 AS DOUBLE) AS k3, CAST(0 AS DOUBLE) AS k4, url AS tie FROM grouped"
_CANNIBAL_ACTIONS = """SELECT g.site, 'cannibalization' AS section, 'cannibalization:' || rules AS rule, paths AS url, g.query, pages AS count, least(n, 5) AS evidence, CAST(-coalesce(l.shows, 0) AS DOUBLE) AS k1,
  CAST(0 AS DOUBLE) AS k2, CAST(0 AS DOUBLE) AS k3, CAST(0 AS DOUBLE) AS k4, g.query AS tie
  FROM (SELECT site, stem, count(*) AS n, count(DISTINCT page) AS pages, first(q ORDER BY ro, q) AS query, list_aggregate(list_transform(list_sort(list(DISTINCT ro || rule)), lambda r: r[2:]), 'string_agg', '+') AS rules FROM told GROUP BY site, stem) g
  JOIN (SELECT site, stem, string_agg(path, ' and ' ORDER BY rn) AS paths FROM (SELECT site, stem, path, row_number() OVER (PARTITION BY site, stem ORDER BY ro, path, page) AS rn
        FROM (SELECT site, stem, page, first(ro ORDER BY ro, path) AS ro, first(path ORDER BY ro, path) AS path FROM told GROUP BY site, stem, page)) WHERE rn <= 2 GROUP BY site, stem) p USING (site, stem)
  LEFT JOIN (SELECT host_id AS site, query, max(shows) AS shows FROM latest GROUP BY ALL) l ON l.site = g.site AND l.query = lower(g.query)
  WHERE pages >= 2 AND rules <> 'serp'"""
_GAP_ACTIONS = "SELECT site, 'competitor_gaps' AS section, 'rival_in_results' AS rule, first(url ORDER BY position, domain) AS url, query, count(*) AS count, least(count(*), 3) AS evidence, -CAST(max(freq) AS DOUBLE) AS k1, CAST(0 AS DOUBLE) AS k2, CAST(0 AS DOUBLE) AS k3, CAST(0 AS DOUBLE) AS k4, query || ' ' || region AS tie FROM standing GROUP BY site, query, region"
_PATH = "coalesce(nullif(regexp_extract({0}, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), ''), '/')".format


def _finding_items(site):
    """SQL of the findings' items, sites named by the expression ``site``; needs FACTS, READY and every."""
    rank = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END"
    main = ", ".join(f"'{c}'" for c in L.READINESS_MAIN)
    return f"""
found_rows AS (SELECT {site} AS site, severity, code, url, {_PATH('url')} AS path, {rank} AS rank FROM every WHERE code NOT IN {L.AUDIT_INFO_CODES}),
ready_rows AS (
  SELECT {site} AS site, severity, code, url, {_PATH('url')} AS path, {rank} AS rank, CASE WHEN code LIKE 'robots%' THEN 0 WHEN code LIKE 'llms%' THEN 1 WHEN code LIKE 'jsonld%' THEN 2 ELSE 3 END AS kind,
         CASE WHEN contains(evidence, 'whole site') THEN 0 ELSE 1 END AS part, code IN {L.READINESS_INDEXING} AS indexing,
         code LIKE 'robots-blocks-%' OR code IN ({main}) OR (code = 'jsonld-missing' AND severity <> 'minor') AS ai
  FROM ready WHERE code <> '{L.READINESS_SKIP[0]}'
),
finding_items AS (
  SELECT site, 'indexing' AS section, 'audit:' || code AS rule, url, CAST(NULL AS VARCHAR) AS query, 1 AS count, 1 AS evidence, CAST(rank AS DOUBLE) AS k1, CAST(-1 AS DOUBLE) AS k2, CAST(0 AS DOUBLE) AS k3, CAST(0 AS DOUBLE) AS k4, code || ' ' || path AS tie FROM found_rows WHERE severity = 'critical'
  UNION ALL SELECT site, 'other', 'audit:' || code, first(url ORDER BY path, url), NULL, count(*), least(count(*), 5), any_value(rank), -count(*), 0, 0, code || ' ' || min(path) FROM found_rows WHERE severity <> 'critical' GROUP BY site, severity, code
  UNION ALL SELECT site, CASE WHEN indexing THEN 'indexing' ELSE 'ai_search' END, 'readiness:' || code, url, NULL, 1, 1, rank, kind, part, 0, code FROM ready_rows WHERE indexing OR ai
  UNION ALL SELECT site, 'other', 'readiness:' || code, first(url ORDER BY path, url), NULL, count(*), least(count(*), 5), any_value(rank), any_value(kind), 1, 0, code FROM ready_rows WHERE NOT indexing AND NOT ai GROUP BY site, severity, code
)"""


_FOUND = f"{AUDIT.FACTS}{AUDIT.READY}, {AUDIT._RULE_ROWS}, {AUDIT._EVERY}"
_OWNER = "'https:site-' || (CAST('0x' || substr(md5(site), 1, 4) AS INTEGER) % 10) || '.example:443'"
_GAPS_BY_OWNER = f"SELECT g.* REPLACE ('https:site-' || n_nationkey || '.example:443' AS site) FROM ({_GAP_ACTIONS}) g JOIN nation ON n_name = g.site"
WHOLE = CANNIBAL + "," + GAP_REST + f""",
{_FOUND.lstrip()},{_finding_items(_OWNER)},
every_action AS ({_PAGE_ACTIONS} UNION ALL {_CANNIBAL_ACTIONS} UNION ALL {_GAPS_BY_OWNER} UNION ALL SELECT * FROM finding_items),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY list_position(['indexing', 'quick_wins', 'snippet', 'cannibalization', 'ai_search', 'competitor_gaps', 'other'], section), k1, k2, k3, k4, tie, rule, url) AS place
  FROM every_action
)"""
QUERIES = {
    "quick_win_items": (quick_win_items, f"WITH {LATEST} SELECT site, section, query, shows, clicks, position, freq, source, coalesce(page, '/') AS path, skipped FROM items"),
    "skipped_queries": (skipped_queries, f"WITH {LATEST} SELECT site, skipped, count(*) AS queries FROM items WHERE skipped IS NOT NULL GROUP BY ALL"),
    "quick_wins": (quick_wins, f"WITH {LATEST} {_PAGE_ACTIONS} WHERE section = 'quick_wins'"),
    "snippet_candidates": (snippet_actions, f"WITH {LATEST} {_PAGE_ACTIONS} WHERE section = 'snippet'"),
    "pages_in_both": (pages_in_both, f"WITH {LATEST} SELECT site, section, n > 1 AS in_both, count(*) AS items FROM (SELECT *, count(*) OVER (PARTITION BY site, page_key) AS n FROM grouped) GROUP BY ALL"),
    "cannibalization_evidence": (cannibalization_evidence, f"WITH {CANNIBAL} SELECT site, stem AS stem_key, rule, count(*) AS rows, count(DISTINCT page) AS pages FROM told GROUP BY ALL"),
    "cannibalization_actions": (cannibalization_actions, f"WITH {CANNIBAL} {_CANNIBAL_ACTIONS}"),
    "gap_rivals": (gap_rivals, f"WITH {GAPS} SELECT * FROM rivals"),
    "gap_actions": (gap_actions, f"WITH {GAPS} {_GAP_ACTIONS}"),
    "finding_actions": (finding_actions, f"WITH {_FOUND},{_finding_items('site')} SELECT * FROM finding_items"),
    "finding_actions_audit": (finding_actions_audit, f"WITH {AUDIT.FACTS}, {AUDIT._RULE_ROWS}, {AUDIT._EVERY} SELECT site, CASE WHEN severity = 'critical' THEN 'indexing' ELSE 'other' END AS section, 'audit:' || code AS rule, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END AS DOUBLE) AS k1, count(*) AS findings, CASE WHEN severity = 'critical' THEN count(*) ELSE 1 END AS items FROM every WHERE code NOT IN ('noindex-not-checked', 'robots-disallow-not-checked') GROUP BY site, severity, code"),
    "plan_ranked": (plan_ranked, f"WITH {WHOLE} SELECT site, CAST(place AS INTEGER) AS place, section, rule, url, query, count, k1, k2 FROM placed WHERE place <= 10"),
    "plan_hidden": (plan_hidden, f"WITH {WHOLE} SELECT site, section, count(*) AS total, count(*) FILTER (place > 10) AS hidden FROM placed GROUP BY site, section HAVING count(*) FILTER (place > 10) > 0"),
    "plan_missing": (plan_missing, f"""
WITH {CANNIBAL},
asked AS (SELECT DISTINCT host_id AS site FROM owner_events),
owner_rows AS (SELECT host_id AS site, max(fetched_at) AS fetched_at FROM latest GROUP BY 1),
rank_rows AS (SELECT DISTINCT host_id AS site FROM last_ranks WHERE n <= 2),
snap_rows AS (SELECT DISTINCT site FROM own_docs),
left_out AS (SELECT site, count(*) FILTER (skipped = 'no_page') AS no_page, count(*) FILTER (skipped = 'no_demand') AS no_demand FROM items GROUP BY site),
known AS (
  SELECT a.site, o.site AS o, r.site AS r, s.site AS s, no_page, no_demand, epoch(TIMESTAMP '2024-03-20 00:00:00' - o.fetched_at) / 86400 AS age
  FROM asked a LEFT JOIN owner_rows o USING (site) LEFT JOIN rank_rows r USING (site) LEFT JOIN snap_rows s USING (site) LEFT JOIN left_out USING (site)
)
SELECT site, 'no_owner_data' AS note, CAST(NULL AS BIGINT) AS count FROM known WHERE o IS NULL
UNION ALL SELECT site, 'owner_data_stale', CAST(floor(age) AS BIGINT) FROM known WHERE age > {L.OWNER_STALE_DAYS}
UNION ALL SELECT site, 'no_ranks', NULL FROM known WHERE r IS NULL
UNION ALL SELECT site, 'no_snapshots', NULL FROM known WHERE s IS NULL
UNION ALL SELECT site, 'queries_without_page', no_page FROM known WHERE no_page > 0
UNION ALL SELECT site, 'queries_without_demand', no_demand FROM known WHERE no_demand > 0"""),
    "plan_all_sections": (plan_all_sections, f"WITH {WHOLE} SELECT site, CAST(place AS INTEGER) AS place, section, rule, url, query, count, evidence, k1, k2, k3, k4, tie FROM placed"),
    "reusable_audits": (reusable_audits, "WITH r AS (SELECT 'https://c-' || o_custkey || '.example/' AS url, o_orderkey AS id, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') SELECT url, id, strftime(o_orderdate, '%Y-%m-%d') AS started_at, 30 AS pages, id % 9 AS findings, CAST(datediff('day', o_orderdate, TIMESTAMP '2001-08-02') AS DOUBLE) AS age_days, datediff('day', o_orderdate, TIMESTAMP '2001-08-02') <= 7 AS reusable FROM r WHERE rn = 1"),
    "list_audits": (list_audits, "SELECT o_orderkey AS id, 'c-' || o_custkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
}
