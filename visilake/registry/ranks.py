"""Rank tracking and result-page composition over the order and line tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import lists as L
from ..operators import ranks as R
from ..operators import rollups as RU
from ..operators import serp as S
from ..session import checkpointed
from ..sinks import warehouse as WH

OURS, RIVAL = "europe.example", "asia.example"
KEYS = ("query", "region", "run_id")


def _measured(spark, sf, domain=OURS):
    return R.measure(B.snapshots(spark, sf), B.docs(spark, sf), domain, KEYS)


MEASURED = B.docs_cte() + f""",
hits AS (
  SELECT snapshot_id, min(position) AS position, arg_min(coalesce(nullif(organic_position, 0), position), position) AS rank, arg_min(url, position) AS url
  FROM docs WHERE NOT is_wizard AND domain = '{OURS}' GROUP BY snapshot_id
),
sampled AS (
  SELECT s.query, s.region, s.run_id, s.snapshot_id, s.fetched_at, s.error IS NULL AS ok,
         CASE WHEN s.error IS NULL THEN coalesce(h.rank, {L.BEYOND}) END AS rank, h.url
  FROM snapshots s LEFT JOIN hits h USING (snapshot_id)
),
medians AS (
  SELECT query, region, run_id,
         CASE WHEN quantile_disc(rank, 0.5 ORDER BY rank DESC) < {L.BEYOND} THEN quantile_disc(rank, 0.5 ORDER BY rank) END AS median,
         min(rank) FILTER (rank < {L.BEYOND}) AS min, max(rank) FILTER (rank < {L.BEYOND}) AS max,
         count(*) FILTER (rank < {L.BEYOND}) AS found_in, count(*) FILTER (ok) AS snapshots, count(*) FILTER (NOT ok) AS failed
  FROM sampled GROUP BY query, region, run_id
)"""
# DuckDB has no descending discrete quantile: the upper middle value is taken by rank.
MEASURED = MEASURED.replace(
    f"CASE WHEN quantile_disc(rank, 0.5 ORDER BY rank DESC) < {L.BEYOND} THEN quantile_disc(rank, 0.5 ORDER BY rank) END AS median",
    f"CASE WHEN list_sort(list(rank) FILTER (ok))[count(*) FILTER (ok) // 2 + 1] < {L.BEYOND} "
    "THEN list_sort(list(rank) FILTER (ok))[(count(*) FILTER (ok) - 1) // 2 + 1] END AS median",
)
CHOSEN = MEASURED + """,
chosen AS (
  SELECT * FROM (
    SELECT m.*, s.snapshot_id, s.fetched_at, s.url,
           row_number() OVER (PARTITION BY m.query, m.region, m.run_id
             ORDER BY s.rank IS NOT DISTINCT FROM m.median DESC, s.fetched_at, s.snapshot_id) AS rn
    FROM medians m JOIN sampled s ON s.query = m.query AND s.region = m.region AND s.run_id = m.run_id AND s.ok)
  WHERE rn = 1
)"""
POSITIONS = CHOSEN + f""",
positions AS (
  SELECT snapshot_id AS id, query, region, '{OURS}' AS domain, median AS position, url, fetched_at AS checked_at, min AS low, max AS high FROM chosen
)"""
LATEST = POSITIONS + """,
latest AS (
  SELECT query, region, position, previous, previous - position AS delta,
         CASE WHEN low <> high THEN low END AS spread_low, CASE WHEN low <> high THEN high END AS spread_high,
         coalesce(previous - position <> 0 AND low <> high AND abs(previous - position) <= high - low, false) AS within_noise,
         checked_at, measurements
  FROM (SELECT *, lead(position) OVER w AS previous, row_number() OVER w AS rn, count(*) OVER (PARTITION BY query, region) AS measurements
        FROM positions WINDOW w AS (PARTITION BY query, region ORDER BY checked_at DESC, id DESC))
  WHERE rn = 1
)"""


def _positions(spark, sf):
    chosen = R.representative_snapshot(_measured(spark, sf))
    return checkpointed(R.record_positions(chosen, B.docs(spark, sf), [OURS], primary=OURS))


def _day(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def rank_median(spark, sf):
    return _measured(spark, sf).select(
        *KEYS, "median", "min", "max", "found_in", "snapshots", "failed",
        F.array_join(F.transform("samples", lambda s: F.concat(F.coalesce(s["position"].cast("string"), F.lit("-")), F.lit("x"), s["n"].cast("string"))), ",").alias("samples"),
    )


def rank_median_aggregate(spark, sf):
    hits = R.domain_hits(B.docs(spark, sf).where("error IS NULL"), OURS)
    rows = B.snapshots(spark, sf).where("error IS NULL").join(hits, "snapshot_id", "left")
    return rows.groupBy(*KEYS).agg(R.median_position("rank").alias("median"))


def rank_representative(spark, sf):
    return _day(_measured(spark, sf).where("snapshot_id IS NOT NULL").select(*KEYS, "median", "snapshot_id", "url", "fetched_at"), "fetched_at")


def record_positions(spark, sf):
    rows = R.record_positions(B.snapshots(spark, sf), B.docs(spark, sf), [OURS, RIVAL, "www.africa.example"])
    return _day(rows.drop("samples", "id"), "checked_at")


def rank_latest_delta(spark, sf):
    return _day(R.latest_positions(_positions(spark, sf), OURS), "checked_at")


def rank_movers(spark, sf):
    return _day(R.movers(R.latest_positions(_positions(spark, sf), OURS), 10), "checked_at")


def position_history(spark, sf):
    return _day(R.position_history(_positions(spark, sf), "BUILDING nation_3", OURS, 3, 50), "checked_at")


def competition_score(spark, sf):
    return _day(
        S.competition_score(B.docs(spark, sf, "nation"), B.AS_OF, 5, B.snapshots(spark, sf), "nation-3.example").drop("run_id"), "calculated_at"
    )


def _points(name, expr, weight):
    return f"round({expr} * {weight} * 100, 1) AS {name}_points, round({expr}, 3) AS {name}"


def scored(top):
    """SQL of the scores over the first ``top`` sites."""
    return B.docs_cte("nation") + f""",
factors AS (
  SELECT snapshot_id, count(*) AS docs_analysed, avg(least(title_hlwords / 2.0, 1.0)) AS title_fit,
         least(log10(greatest(median(domain_doccount), 1) + 1) / 3, 1.0) AS depth_coverage,
         avg(CASE WHEN regexp_matches(domain, '(^|\\.)(vk\\.com|t\\.me)$') THEN 1 ELSE 0 END) AS portal_share,
         avg(CASE WHEN url_depth = 0 THEN 1 ELSE 0 END) AS homepage_share,
         avg(CASE WHEN modified >= TIMESTAMP '1998-06-01 12:00:00' THEN 1 ELSE 0 END) AS freshness
  FROM docs WHERE error IS NULL AND NOT is_wizard AND organic_position <= {top} GROUP BY snapshot_id
),
points AS (
  SELECT snapshot_id, docs_analysed, {", ".join(_points(n, n, w) for n, w in L.WEIGHTS.items())} FROM factors
),
scores AS (
  SELECT *, round({" + ".join(f"{n}_points" for n in L.WEIGHTS)}, 1) AS score FROM points
),
own AS (
  SELECT snapshot_id, arg_min(organic_position, position) AS our_position FROM docs
  WHERE error IS NULL AND NOT is_wizard AND domain = 'nation-3.example' GROUP BY snapshot_id
),
competition AS (
  SELECT s.snapshot_id, s.query, s.region, s.fetched_at AS calculated_at,
         coalesce(s.error, CASE WHEN c.score IS NULL THEN 'no usable documents' END) AS error, c.* EXCLUDE (snapshot_id),
         CASE WHEN c.score IS NULL THEN NULL ELSE o.our_position END AS our_position,
         CASE WHEN score IS NULL THEN 'нет данных' WHEN score < 30 THEN 'низкая' WHEN score <= 60 THEN 'средняя' ELSE 'высокая' END AS band
  FROM snapshots s LEFT JOIN scores c ON c.snapshot_id = s.snapshot_id LEFT JOIN own o ON o.snapshot_id = s.snapshot_id
)"""


SCORED = scored(5)


def _competition(spark, sf):
    return S.competition_score(B.docs(spark, sf, "nation"), B.AS_OF, 5, B.snapshots(spark, sf), "nation-3.example")


def competition_history(spark, sf):
    return _day(R.competition_history(_competition(spark, sf), "BUILDING nation_3", 3, 20), "calculated_at")


def latest_competition(spark, sf):
    return _day(R.latest_competition(_competition(spark, sf)), "calculated_at")


def serp_competitors(spark, sf):
    return S.serp_competitors(B.docs(spark, sf, "nation"), 5)


def serp_competitor_queries(spark, sf):
    return S.serp_competitor_queries(B.docs(spark, sf, "nation"), 5)


def top_domains(spark, sf):
    return S.top_domains(B.docs(spark, sf, "nation"), region=3, since="1996-01-01", limit=10)


def top_domains_rollup(spark, sf):
    """The same from daily roll-ups."""
    docs = B.docs(spark, sf, "nation")
    return RU.top_domains_since(RU.daily_rollup(docs, RU.query_codes(docs)), region=3, since="1996-01-01", limit=10)


def domains_since(spark, sf):
    """Every domain's reach from four moments on, from one stored roll-up."""
    docs = B.docs(spark, sf, "nation")
    codes = checkpointed(RU.query_codes(docs))
    rollup = checkpointed(RU.daily_rollup(docs, codes))
    parts = [RU.domains_since(rollup, None, since, docs, codes).withColumn("since", F.lit(since)) for since in SINCE]
    return reduce(DataFrame.unionByName, parts)


#: moments at and inside a day
SINCE = ("1992-01-01", "1995-03-15 12:00:00", "1997-07-01", "2001-01-01")


def domain_queries(spark, sf):
    return _day(S.domain_queries(B.docs(spark, sf, "nation"), "nation-7.example", None, None), "checked_at")


def competitor_gap(spark, sf):
    return S.competitor_gap(B.docs(spark, sf, "nation"), "nation-3.example", "nation-7.example", 3)


def keyword_metrics(spark, sf):
    freq = B.table(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("n")).agg(F.count(F.lit(1)).alias("freq"))
    phrases = freq.select(F.concat("segment", F.lit(" nation_"), "n").alias("phrase"), F.col("segment").alias("seed"), "freq")
    comp = R.latest_competition(_competition(spark, sf))
    latest = R.latest_positions(_positions(spark, sf), OURS)
    return S.keyword_metrics(phrases, comp, latest, min_freq=2, limit=15)


def _calibration(spark, sf):
    """Seen places come from the line of the same snapshot with the highest part number."""
    return B.docs(spark, sf).where("error IS NULL").groupBy("snapshot_id", "query", "region", "fetched_at").agg(
        F.min(F.when(F.col("domain") == OURS, F.col("position"))).alias("seen_position"),
        F.min(F.when(F.col("domain") == OURS, F.col("organic_position"))).alias("api_position"),
    ).select(F.col("snapshot_id").alias("id"), "query", "region", F.lit(OURS).alias("domain"), "seen_position", "api_position", F.col("fetched_at").alias("checked_at"))


def calibration_report(spark, sf):
    return R.calibration_report(_calibration(spark, sf), OURS)


def _phrases(spark, sf):
    return B.snapshots(spark, sf).select(F.when(F.col("snapshot_id") % 2 == 0, F.upper("query")).otherwise(F.col("query")).alias("query"), F.col("snapshot_id").alias("ord"))


def measurement_plan(spark, sf):
    return R.measurement_plan(_phrases(spark, sf), R.latest_positions(_positions(spark, sf), OURS), n=30)


def run_gate(spark, sf):
    positions = _positions(spark, sf)
    plan = R.measurement_plan(_phrases(spark, sf), R.latest_positions(positions, OURS), n=30)
    return _day(R.run_gate(plan, positions, OURS, 3, "2001-08-10 00:00:00", rate=0.0305), "last_measured").withColumn("cost", F.round("cost", 4))


def tracking_targets(spark, sf):
    projects = B.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("project_id"), F.col("n_name").alias("project"),
        F.concat(F.lower("n_name"), F.lit(".example")).alias("domain"), (F.col("n_nationkey") != 4).alias("active"), F.col("n_regionkey").alias("region"),
    )
    tracked = B.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey").cast("bigint")).alias("project_id"),
        F.col("c_name").alias("query"), F.lit(3).alias("region"), (F.col("c_acctbal") > 0).alias("active"),
    )
    return R.tracking_targets(projects, tracked, 3, orphan_owner=8)


def latest_docs(spark, sf):
    """Appended deliveries of (order, line) slots, the last delivery kept."""
    raw = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("position"), F.col("l_shipdate").alias("ingested_at"), "l_partkey", "l_suppkey"
    )
    return _day(WH.latest_docs(raw), "ingested_at")


D = "strftime({}, '%Y-%m-%d')".format
PLANNED = LATEST + """,
phrases AS (SELECT lower(trim(query)) AS query_key, arg_min(query, ord) AS query, min(ord) AS ord FROM (SELECT CASE WHEN snapshot_id % 2 = 0 THEN upper(query) ELSE query END AS query, snapshot_id AS ord FROM snapshots) GROUP BY 1), known AS (SELECT lower(trim(query)) AS query_key, last(position ORDER BY checked_at, query) AS position FROM latest GROUP BY 1),
planned AS (SELECT p.query, p.query_key, p.ord, CASE WHEN k.query_key IS NULL THEN 'new' WHEN k.position IS NULL THEN 'cold' ELSE 'hot' END AS state, CASE WHEN k.query_key IS NOT NULL AND k.position IS NULL THEN 1 ELSE 3 END AS samples, 3 * CASE WHEN k.query_key IS NOT NULL AND k.position IS NULL THEN 1 ELSE 3 END AS calls FROM phrases p LEFT JOIN known k USING (query_key))"""
QUERIES = {
    "rank_median": (rank_median, f"WITH {MEASURED}, hist AS (SELECT query, region, run_id, string_agg(CASE WHEN rank < {L.BEYOND} THEN CAST(rank AS VARCHAR) ELSE '-' END || 'x' || n, ',' ORDER BY rank) AS samples FROM (SELECT query, region, run_id, rank, count(*) AS n FROM sampled WHERE ok GROUP BY ALL) GROUP BY ALL) SELECT m.*, coalesce(h.samples, '') AS samples FROM medians m LEFT JOIN hist h USING (query, region, run_id)"),
    "rank_median_aggregate": (rank_median_aggregate, f"WITH {MEASURED} SELECT query, region, run_id, median FROM medians WHERE snapshots > 0"),
    "rank_representative": (rank_representative, f"WITH {CHOSEN} SELECT query, region, run_id, median, snapshot_id, url, {D('fetched_at')} AS fetched_at FROM chosen"),
    "record_positions": (record_positions, f"WITH {B.docs_cte()}, watched AS (SELECT unnest(['{OURS}', '{RIVAL}', 'africa.example']) AS domain), hits AS (SELECT snapshot_id, domain, arg_min(organic_position, position) AS position, arg_min(url, position) AS url FROM docs WHERE NOT is_wizard GROUP BY ALL) SELECT s.snapshot_id, s.query, s.region, w.domain, h.position, h.url, {D('s.fetched_at')} AS checked_at FROM snapshots s CROSS JOIN watched w LEFT JOIN hits h ON h.snapshot_id = s.snapshot_id AND h.domain = w.domain WHERE s.error IS NULL"),
    "rank_latest_delta": (rank_latest_delta, f"WITH {LATEST} SELECT * REPLACE ({D('checked_at')} AS checked_at) FROM latest"),
    "rank_movers": (rank_movers, f"WITH {LATEST} (SELECT * REPLACE ({D('checked_at')} AS checked_at), 'up' AS direction FROM latest WHERE delta > 0 ORDER BY delta DESC, query, region LIMIT 10) UNION ALL (SELECT * REPLACE ({D('checked_at')} AS checked_at), 'down' FROM latest WHERE delta < 0 ORDER BY delta, query, region LIMIT 10)"),
    "position_history": (position_history, f"WITH {POSITIONS} SELECT {D('checked_at')} AS checked_at, position, url FROM positions WHERE query = 'BUILDING nation_3' AND region = 3 ORDER BY positions.checked_at DESC, id DESC LIMIT 50"),
    "competition_score": (competition_score, f"WITH {SCORED} SELECT * REPLACE ({D('calculated_at')} AS calculated_at) FROM competition"),
    "competition_history": (competition_history, f"WITH {SCORED} SELECT {D('c.calculated_at')} AS calculated_at, score, band, our_position FROM competition c WHERE query = 'BUILDING nation_3' AND region = 3 AND error IS NULL ORDER BY c.calculated_at DESC, snapshot_id DESC LIMIT 20"),
    "latest_competition": (latest_competition, f"WITH {SCORED} SELECT lower(trim(query)) AS query_key, region, query, score, band, our_position, {D('calculated_at')} AS calculated_at FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(query)), region ORDER BY calculated_at DESC, snapshot_id DESC) AS rn FROM competition WHERE error IS NULL) WHERE rn = 1"),
    "serp_competitors": (serp_competitors, f"WITH {B.docs_cte('nation')} SELECT domain, CAST(count(*) AS BIGINT) AS appearances, count(DISTINCT query) AS queries, min(position) AS best_position, round(avg(position), 1) AS avg_position, false AS is_portal FROM docs WHERE error IS NULL AND NOT is_wizard AND organic_position <= 5 GROUP BY domain"),
    "serp_competitor_queries": (serp_competitor_queries, f"WITH {B.docs_cte('nation')} SELECT domain, query, min(position) AS best_position, count(*) AS appearances FROM docs WHERE error IS NULL AND NOT is_wizard AND organic_position <= 5 GROUP BY domain, query"),
    "top_domains_rollup": (top_domains_rollup, f"WITH {B.docs_cte('nation')} SELECT domain, count(*) AS hits, min(position) AS best, round(avg(position), 1) AS avg_position, count(DISTINCT query) AS queries FROM docs WHERE error IS NULL AND region = 3 AND fetched_at >= TIMESTAMP '1996-01-01' GROUP BY domain ORDER BY hits DESC, avg_position, domain LIMIT 10"),
    "domains_since": (domains_since, f"WITH {B.docs_cte('nation')}, moments AS (SELECT unnest({list(SINCE)}) AS since) SELECT since, domain, count(*) AS hits, min(position) AS best, round(avg(position), 1) AS avg_position, count(DISTINCT query) AS queries FROM docs JOIN moments ON fetched_at >= CAST(since AS TIMESTAMP) WHERE error IS NULL GROUP BY since, domain"),
    "top_domains": (top_domains, f"WITH {B.docs_cte('nation')} SELECT domain, count(*) AS hits, min(position) AS best, round(avg(position), 1) AS avg_position, count(DISTINCT query) AS queries FROM docs WHERE error IS NULL AND region = 3 AND fetched_at >= TIMESTAMP '1996-01-01' GROUP BY domain ORDER BY hits DESC, avg_position, domain LIMIT 10"),
    "domain_queries": (domain_queries, f"WITH {B.docs_cte('nation')} SELECT query, min(position) AS best_position, first(position ORDER BY fetched_at DESC, snapshot_id DESC, position) AS last_position, strftime(max(fetched_at), '%Y-%m-%d') AS checked_at, count(*) AS hits FROM docs WHERE error IS NULL AND domain = 'nation-7.example' GROUP BY query"),
    "competitor_gap": (competitor_gap, f"WITH {B.docs_cte('nation')}, seen AS (SELECT domain, query, min(position) AS best, first(position ORDER BY fetched_at DESC, snapshot_id DESC, position) AS last FROM docs WHERE error IS NULL AND region = 3 AND domain IN ('nation-7.example', 'nation-3.example') GROUP BY domain, query) SELECT t.query, t.last AS their_position, o.last AS our_position, CASE WHEN o.last IS NULL THEN 'missing' WHEN o.last < t.last THEN 'we' WHEN o.last > t.last THEN 'they' ELSE 'equal' END AS ahead FROM seen t LEFT JOIN seen o ON o.query = t.query AND o.domain = 'nation-3.example' WHERE t.domain = 'nation-7.example'"),
    "keyword_metrics": (keyword_metrics, f"""
WITH freq AS (SELECT lower(c_mktsegment) AS seed, lower(c_mktsegment) || ' nation_' || c_nationkey AS phrase, count(*) AS freq FROM customer GROUP BY ALL HAVING count(*) >= 2),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY freq DESC, phrase) AS n FROM freq) WHERE n <= 15),
scores AS (SELECT * FROM (WITH {SCORED} SELECT lower(trim(query)) AS query_key, score, band, row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY calculated_at DESC, snapshot_id DESC) AS n FROM competition WHERE error IS NULL) WHERE n = 1),
places AS (SELECT lower(trim(query)) AS query_key, first(position ORDER BY checked_at DESC, query DESC) AS our_position FROM (WITH {LATEST} SELECT * FROM latest) GROUP BY 1)
SELECT phrase, seed, freq, score, band, our_position FROM cut LEFT JOIN scores s ON s.query_key = phrase LEFT JOIN places p ON p.query_key = phrase"""),
    "calibration_report": (calibration_report, f"WITH {B.docs_cte()}, c AS (SELECT snapshot_id, fetched_at, min(position) FILTER (domain = '{OURS}') AS seen, min(organic_position) FILTER (domain = '{OURS}') AS api FROM docs WHERE error IS NULL GROUP BY ALL), d AS (SELECT *, CASE WHEN seen IS NOT NULL AND api IS NOT NULL THEN api - seen END AS diff FROM c) SELECT count(*) AS checks, count(diff) AS comparable, round(avg(diff), 1) AS avg_offset, first(diff ORDER BY diff IS NULL, abs(diff) DESC, fetched_at DESC, snapshot_id DESC) AS max_offset, count(diff) >= 5 AS trustworthy FROM d"),
    "measurement_plan": (measurement_plan, f"WITH {PLANNED} SELECT * FROM planned"),
    "run_gate": (run_gate, f"WITH {PLANNED}, totals AS (SELECT count(*) AS phrases, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (state <> 'cold') AS hot, count(*) FILTER (state = 'cold') AS cold, count(*) FILTER (state = 'new') AS new FROM planned), last AS (SELECT max(checked_at) AS at_last FROM positions WHERE region = 3) SELECT t.*, strftime(at_last, '%Y-%m-%d') AS last_measured, CAST(datediff('day', at_last, TIMESTAMP '2001-08-10') AS DOUBLE) AS days_passed, datediff('day', at_last, TIMESTAMP '2001-08-10') >= 13 AS due, CASE WHEN datediff('day', at_last, TIMESTAMP '2001-08-10') < 13 THEN 'too_early' WHEN calls > 1000 THEN 'over_cap' END AS stopped, round(calls * CAST(0.0305 AS DOUBLE), 4) AS cost FROM totals t, last"),
    "tracking_targets": (tracking_targets, "SELECT p.project_id, n_name AS project, lower(n_name) || '.example' AS domain, t.query, t.inherited FROM (SELECT *, CAST(n_nationkey AS BIGINT) AS project_id FROM nation WHERE n_nationkey <> 4 AND n_regionkey = 3) p LEFT JOIN (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_nationkey ELSE 8 END AS project_id, c_name AS query, c_custkey % 10 = 0 AS inherited FROM customer WHERE c_acctbal > 0) t ON t.project_id = p.project_id"),
    "latest_docs": (latest_docs, "SELECT l_orderkey AS snapshot_id, l_linenumber AS position, strftime(l_shipdate, '%Y-%m-%d') AS ingested_at, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1"),
}
