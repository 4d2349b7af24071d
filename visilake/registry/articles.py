"""Articles and briefs over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import lists as L
from ..operators import articles as A
from ..operators import brief as BR
from ..operators import ranks as R
from ..operators import serp as S
from ..session import checkpointed
from ..plans.actions import newest_snapshots
from .ranks import scored


def _articles(spark, sf):
    c = B.table(spark, sf, "customer")
    key = F.col("c_custkey")
    n = F.col("c_nationkey").cast("string")
    query = F.concat("c_mktsegment", F.lit(" nation_"), n)
    return c.select(
        key.alias("article_id"), F.col("c_nationkey").cast("bigint").alias("project_id"),
        F.concat(F.lit("https://www.nation-"), n, F.lit(".example/brand-"), (key % 25).cast("string"), F.lit("/"), (key % 20 + 6).cast("string"), F.lit("/?a=1")).alias("url"),
        F.concat(F.lit(" "), query).alias("target_query"),
        F.array(query, F.concat("c_mktsegment", F.lit(" nation_"), ((F.col("c_nationkey") + 1) % 25).cast("string")), F.lit("")).alias("extra_queries"),
        F.when(F.col("c_acctbal") > 0, F.lit("2024-01-01")).alias("published_at"), (key % 9 > 0).alias("active"),
    )


ARTICLES = """
articles AS (
  SELECT c_custkey AS article_id, CAST(c_nationkey AS BIGINT) AS project_id,
         'https://www.nation-' || c_nationkey || '.example/brand-' || (c_custkey % 25) || '/' || (c_custkey % 20 + 6) || '/?a=1' AS url,
         'nation-' || c_nationkey || '.example' AS host, 'nation-' || c_nationkey || '.example/brand-' || (c_custkey % 25) || '/' || (c_custkey % 20 + 6) AS key,
         c_mktsegment || ' nation_' || c_nationkey AS q1, c_mktsegment || ' nation_' || ((c_nationkey + 1) % 25) AS q2,
         CASE WHEN c_acctbal > 0 THEN '2024-01-01' END AS published_at, c_custkey % 9 > 0 AS active
  FROM customer
),
pairs AS (
  SELECT article_id, url, host, key, 0 AS place, q1 AS query, q1 AS target FROM articles
  UNION ALL SELECT article_id, url, host, key, 1, q2, q1 FROM articles
)"""


def _runs(spark, sf):
    """Documents with their quarter as the run: one run measures a query once."""
    rows = B.docs(spark, sf, "nation").withColumn("run_id", F.date_trunc("quarter", "fetched_at"))
    return checkpointed(rows.select("snapshot_id", "query", "region", "run_id", "fetched_at", "error", "is_wizard", "position", "url", "domain"))


MEASURED = B.docs_cte("nation") + "," + ARTICLES + """,
run_snaps AS (SELECT query, last(snapshot_id ORDER BY fetched_at, snapshot_id) AS snapshot_id FROM snapshots WHERE snapshot_id IN (SELECT snapshot_id FROM page_lines) GROUP BY query, region, date_trunc('quarter', fetched_at)),
run_docs AS (SELECT d.* FROM docs d JOIN run_snaps r ON r.snapshot_id = d.snapshot_id),
run_list AS (SELECT DISTINCT snapshot_id, query, region, fetched_at, error FROM run_docs),
by_host AS (SELECT snapshot_id, domain, min(position) AS position, arg_min(url, position) AS url FROM run_docs WHERE NOT is_wizard AND error IS NULL GROUP BY ALL),
by_page AS (SELECT snapshot_id, rtrim(regexp_replace(url, '^https://', ''), '/') AS key, min(position) AS position FROM run_docs WHERE NOT is_wizard AND error IS NULL GROUP BY ALL),
measured AS (
  SELECT p.article_id, p.url, p.query, p.target, r.snapshot_id, r.region, r.fetched_at AS checked_at, r.error, g.position,
         h.position AS domain_position, h.url AS ranking_url, coalesce(g.position = h.position, false) AS is_target
  FROM pairs p JOIN run_list r ON r.query = p.query
  LEFT JOIN by_host h ON h.snapshot_id = r.snapshot_id AND h.domain = p.host
  LEFT JOIN by_page g ON g.snapshot_id = r.snapshot_id AND g.key = p.key
)"""
VERDICT = """CASE WHEN position <= 10 THEN 'works' WHEN domain_position IS NOT NULL AND (position IS NULL OR domain_position < position) THEN 'replaced'
  WHEN position <= 30 THEN 'coming' ELSE 'missing' END"""
REPORT = MEASURED + f""",
ordered AS (
  SELECT *, row_number() OVER w AS rn, lead(position) OVER w AS previous, count(*) OVER (PARTITION BY article_id) AS measurements
  FROM measured WHERE query = target AND error IS NULL WINDOW w AS (PARTITION BY article_id ORDER BY checked_at DESC, snapshot_id DESC)
),
report AS (
  SELECT a.article_id, a.project_id, a.url, a.q1 AS target_query, o.position, o.domain_position, o.ranking_url, o.is_target, o.checked_at, o.previous,
         o.previous - o.position AS delta, coalesce(o.measurements, 0) AS measurements,
         CASE WHEN o.checked_at IS NULL THEN 'no_data' ELSE {VERDICT} END AS verdict
  FROM articles a LEFT JOIN ordered o ON o.article_id = a.article_id AND o.rn = 1
)"""


def _measured(spark, sf):
    return A.measure_articles(A.article_queries(_articles(spark, sf)), _runs(spark, sf))


def _report(spark, sf):
    articles = _articles(spark, sf).withColumn("target_query", F.trim("target_query"))
    checks = _measured(spark, sf).withColumn("id", F.col("snapshot_id"))
    return A.articles_latest(articles.select("article_id", "project_id", "url", "target_query"), checks)


def _day(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def article_queries(spark, sf):
    return A.article_queries(_articles(spark, sf)).select("article_id", "place", "query")


def queries_to_measure(spark, sf):
    return A.queries_to_measure(A.article_queries(_articles(spark, sf)))


def measure_articles(spark, sf):
    return _day(_measured(spark, sf), "checked_at")


def article_verdict(spark, sf):
    return _measured(spark, sf).where("error IS NULL").select("article_id", "query", "snapshot_id", A.article_verdict().alias("verdict"))


def article_report(spark, sf):
    return _day(_report(spark, sf), "checked_at")


def article_history(spark, sf):
    checks = _measured(spark, sf).withColumn("id", F.col("snapshot_id"))
    return _day(R.article_history(checks, 7, limit=50), "checked_at").drop("id")


def article_effectiveness(spark, sf):
    return A.article_effectiveness(_report(spark, sf))


def replaced_articles(spark, sf):
    return A.replaced_articles(_report(spark, sf))


def query_is_taken(spark, sf):
    """Queries and the names of larger parts are asked for, smaller parts are work in progress."""
    asked = B.snapshots(spark, sf).select("query").distinct().unionByName(B.table(spark, sf, "part").where("p_size >= 10").select(F.col("p_name").alias("query")).distinct())
    asked = asked.withColumn("exclude_id", F.when(F.length("query") % 2 == 0, F.lit("w-small ring")))
    work = B.table(spark, sf, "part").where("p_size < 10").select("p_name").distinct().select(
        F.concat(F.lit("w-"), "p_name").alias("art_id"), F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), F.substring_index("p_name", " ", 1)).alias("topic")
    )
    out = A.query_is_taken(asked, _report(spark, sf), work)
    return out.withColumn("reasons", F.array_join("reasons", ",")).drop("claimed_url", "ranking_url")


def set_published(spark, sf):
    dates = B.table(spark, sf, "part").groupBy(F.concat(F.lit("/Brand-"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit("/"), F.col("p_size").cast("string")).alias("url")).agg(
        F.concat(F.lit("2025-"), F.lpad(F.max(F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("-01")).alias("published_at")
    )
    return A.set_published(_articles(spark, sf), dates).select("article_id", "url", "published_at", "published_before", "changed")


# --- briefs ------------------------------------------------------------------------------

#: English constructions that occur in the part titles
PATTERNS = (
    ("how", r"\bhow\b"), ("size", r"\b(small|large)"), ("metal", r"\b(ring|bolt|gear)"), ("hot", r"\bhot\b"),
    ("offer", r"\b(promo|economy)"), ("standard", r"\b(standard|medium)"),
)
FORMATS, SALES, CASES, PRICE = ("size", "metal", "hot"), ("offer", "standard"), r"\b(anvil|plate)", r"\b(widget|price)"


def _expansions(spark, sf):
    """Phrases suggested for a segment query: the part phrases of its snapshots' customers' nations."""
    q = B.snapshots(spark, sf).groupBy("query", "region").agg(F.count(F.lit(1)).alias("n"))
    p = B.table(spark, sf, "part").groupBy("p_name", (F.col("p_partkey") % 5).cast("int").alias("region")).agg(F.min("p_partkey").alias("place"), F.sum("p_size").alias("freq"), F.max("p_size").alias("m"))
    return q.join(p, "region").select("query", F.when(F.col("m") > 45, "top").otherwise("association").alias("kind"), "place", F.initcap("p_name").alias("phrase"), "freq")


BRIEFS = B.docs_cte("nation") + """,
newest AS (SELECT query, region, last(snapshot_id ORDER BY fetched_at, snapshot_id) AS snapshot_id FROM snapshots WHERE error IS NULL GROUP BY query, region),
tops AS (SELECT d.* FROM docs d JOIN newest n ON n.snapshot_id = d.snapshot_id WHERE NOT is_wizard AND organic_position <= 10),
facts AS (
  SELECT snapshot_id, query, region, count(*) AS pages, count(*) FILTER (regexp_matches(lower(title), '\\b(anvil|plate)')) AS cases,
         count(*) FILTER (regexp_matches(lower(title), '\\b(widget|price)')) AS priced, count(*) FILTER (url_depth = 0) AS home,
         count(*) FILTER (title_hlwords >= 2) AS exact, count(*) AS dated, quantile_disc(modified, 0.5) AS median_modified,
         count(*) FILTER (regexp_matches(lower(title), '\\b(small|large)')) AS size, count(*) FILTER (regexp_matches(lower(title), '\\b(ring|bolt|gear)')) AS metal,
         count(*) FILTER (regexp_matches(lower(title), '\\bhot\\b')) AS hot, count(*) FILTER (regexp_matches(lower(title), '\\b(promo|economy)')) AS offer,
         count(*) FILTER (regexp_matches(lower(title), '\\b(standard|medium)')) AS standard
  FROM tops GROUP BY snapshot_id, query, region
),
expansions AS (
  SELECT q.query, CASE WHEN m > 45 THEN 'top' ELSE 'association' END AS kind, place, p_name AS phrase, freq
  FROM (SELECT DISTINCT query, region FROM snapshots) q
  JOIN (SELECT p_name, p_partkey % 5 AS region, min(p_partkey) AS place, CAST(sum(p_size) AS BIGINT) AS freq, max(p_size) AS m FROM part GROUP BY ALL) p ON p.region = q.region
),
related AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY kind <> 'top', freq DESC, place, phrase) AS rank FROM expansions) WHERE rank <= 15
),
asked AS (SELECT query, arg_min(phrase, rank) FILTER (contains(phrase, 'widget')) AS price_asked FROM related GROUP BY query)"""


def _newest(spark, sf):
    return newest_snapshots(B.docs(spark, sf, "nation"), B.snapshots(spark, sf))


def _facts(spark, sf):
    return BR.brief_facts(_newest(spark, sf), B.AS_OF, 10, PATTERNS, CASES, PRICE)


def title_patterns(spark, sf):
    return BR.title_patterns(_facts(spark, sf)).select("snapshot_id", "query", "label", "pages", "of")


def related_queries(spark, sf):
    return BR.related_queries(_expansions(spark, sf))


def _gaps(spark, sf):
    return BR.content_gaps(_facts(spark, sf), BR.related_facts(BR.related_queries(_expansions(spark, sf)), r"(?i)widget"), SALES)


def content_gaps(spark, sf):
    return _gaps(spark, sf).select("snapshot_id", "query", F.array_join(F.transform("gaps", lambda g: F.concat(g["code"], F.lit(":"), g["number"].cast("int").cast("string"))), ",").alias("gaps"))


def brief_recommendations(spark, sf):
    scores = S.competition_score(_newest(spark, sf), B.AS_OF, 10, our_domain="nation-3.example")
    freq = B.snapshots(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("freq"))
    rows = BR.recommendations(_gaps(spark, sf), scores, freq, FORMATS)
    return rows.select("snapshot_id", "query", "format", "our_position", F.array_join("advice", ",").alias("advice"))


def build_briefs(spark, sf):
    freq = B.snapshots(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("freq"))
    docs = checkpointed(_newest(spark, sf))
    snaps = docs.select("snapshot_id", "query", "region", "fetched_at", "error").distinct()
    out = BR.build_briefs(docs, snaps, _expansions(spark, sf), freq, B.AS_OF, 10, "nation-3.example", PATTERNS, SALES, FORMATS, CASES, "(?i)" + PRICE)
    return out.select("snapshot_id", "query", "region", "freq", "score", "band", "our_position", F.size("top_pages").alias("top_pages"), F.size("related").alias("related"), F.size("gaps").alias("gaps"), F.size("advice").alias("advice"))


D = "strftime({}, '%Y-%m-%d')".format
_GAPS = """concat_ws(',', 'no_digits:0', CASE WHEN dated >= 3 AND datediff('day', median_modified, TIMESTAMP '2000-06-01 12:00:00') / 365.25 >= 2 THEN 'stale:' || CAST(floor(round(datediff('day', median_modified, TIMESTAMP '2000-06-01 12:00:00') / 365.25, 1)) AS INTEGER) END,
 CASE WHEN cases = 0 THEN 'no_cases:0' END, CASE WHEN home * 2 > pages THEN 'homepages:' || home END,
 CASE WHEN greatest(offer, standard) > 0 AND greatest(offer, standard) * 2 >= pages THEN 'commercial:' || greatest(offer, standard) END,
 CASE WHEN exact * 3 <= pages THEN 'no_exact_title:' || exact END, CASE WHEN price_asked IS NOT NULL AND priced = 0 THEN 'price_unanswered:0' END)"""
_STALE = "dated >= 3 AND datediff('day', median_modified, TIMESTAMP '2000-06-01 12:00:00') / 365.25 >= 2"
TOLD = BRIEFS + scored(10).removeprefix(B.docs_cte("nation")) + f""",
fmt AS (
  SELECT snapshot_id, arg_max(label, (hits, label)) AS format FROM (SELECT snapshot_id, unnest(['size', 'metal', 'hot']) AS label, unnest([size, metal, hot]) AS hits FROM facts)
  WHERE hits >= {L.MIN_PATTERN_PAGES} GROUP BY snapshot_id
),
freqs AS (SELECT query, count(*) AS freq FROM snapshots GROUP BY query),
told AS (
  SELECT f.snapshot_id, f.query, format, c.our_position, c.score, c.band, q.freq, pages, {_GAPS} AS gaps,
    concat_ws(',', CASE WHEN our_position > 0 THEN 'update_own_page' END, CASE WHEN format IS NOT NULL THEN 'take_format' ELSE 'no_settled_format' END, 'put_number_in_title',
      CASE WHEN {_STALE} THEN 'give_fresh_data' END, CASE WHEN cases = 0 THEN 'build_on_own_case' END, CASE WHEN home * 2 > pages THEN 'answer_closer_than_homepage' END,
      CASE WHEN greatest(offer, standard) > 0 AND greatest(offer, standard) * 2 >= pages THEN 'answer_not_sell' END, CASE WHEN exact * 3 <= pages THEN 'exact_h1' END,
      CASE WHEN price_asked IS NOT NULL AND priced = 0 THEN 'give_prices' END,
      CASE WHEN q.freq IS NULL THEN 'no_frequency' WHEN c.score IS NULL THEN NULL WHEN c.band = '{L.BAND_LOW}' THEN 'take' WHEN c.band = '{L.BAND_HIGH}' THEN 'enter_by_refinements' ELSE 'plan_with_refinements' END,
      CASE WHEN q.freq < {L.LOW_FREQ} THEN 'low_demand' END) AS advice
  FROM facts f LEFT JOIN asked a ON a.query = f.query LEFT JOIN fmt ON fmt.snapshot_id = f.snapshot_id LEFT JOIN competition c ON c.snapshot_id = f.snapshot_id LEFT JOIN freqs q ON q.query = f.query
)"""
_COUNT = "CAST(len(string_split({}, ',')) AS INTEGER)".format
QUERIES = {
    "article_queries": (article_queries, f"WITH {ARTICLES} SELECT article_id, place, query FROM pairs"),
    "queries_to_measure": (queries_to_measure, f"WITH {ARTICLES} SELECT DISTINCT query FROM pairs"),
    "measure_articles": (measure_articles, f"WITH {MEASURED} SELECT * EXCLUDE (target) REPLACE ({D('checked_at')} AS checked_at) FROM measured"),
    "article_verdict": (article_verdict, f"WITH {MEASURED} SELECT article_id, query, snapshot_id, {VERDICT} AS verdict FROM measured WHERE error IS NULL"),
    "article_report": (article_report, f"WITH {REPORT} SELECT * REPLACE ({D('checked_at')} AS checked_at) FROM report"),
    "article_history": (article_history, f"WITH {MEASURED} SELECT * EXCLUDE (target) REPLACE ({D('checked_at')} AS checked_at) FROM measured WHERE article_id = 7 ORDER BY measured.checked_at DESC, snapshot_id DESC LIMIT 50"),
    "article_effectiveness": (article_effectiveness, f"WITH {REPORT} SELECT project_id, count(*) AS articles, count(checked_at) AS measured, count(*) FILTER (verdict = 'works') AS works, count(*) FILTER (verdict = 'coming') AS coming, count(*) FILTER (verdict = 'replaced') AS replaced, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'no_data') AS no_data FROM report GROUP BY project_id"),
    "replaced_articles": (replaced_articles, f"WITH {REPORT} SELECT article_id, url, target_query AS query, ranking_url, domain_position FROM report WHERE verdict = 'replaced'"),
    "query_is_taken": (query_is_taken, f"WITH {REPORT}, asked AS (SELECT DISTINCT query FROM snapshots UNION ALL SELECT DISTINCT p_name FROM part WHERE p_size >= 10), a AS (SELECT query, list_aggregate(list_sort(regexp_extract_all(lower(query), '[0-9a-z]+')), 'string_agg', ' ') AS stem_key, CASE WHEN length(query) % 2 = 0 THEN 'w-small ring' END AS ex FROM asked), r AS (SELECT *, list_aggregate(list_sort(regexp_extract_all(lower(target_query), '[0-9a-z]+')), 'string_agg', ' ') AS stem_key FROM report), w AS (SELECT DISTINCT 'w-' || p_name AS art_id, list_aggregate(list_sort(regexp_extract_all(lower(p_name), '[0-9a-z]+')), 'string_agg', ' ') AS stem_key FROM part WHERE p_size < 10), c AS (SELECT stem_key, count(*) AS claimed, count(DISTINCT ranking_url) FILTER (ranking_url IS NOT NULL) AS ranking FROM r GROUP BY stem_key), j AS (SELECT a.query, a.stem_key, coalesce(c.claimed, 0) AS claimed, (SELECT count(*) FROM w WHERE w.stem_key = a.stem_key AND w.art_id IS DISTINCT FROM a.ex) AS in_work, coalesce(c.ranking, 0) AS ranking FROM a LEFT JOIN c ON c.stem_key = a.stem_key) SELECT *, CASE WHEN claimed + in_work + ranking > 0 THEN 'taken' ELSE 'free' END AS verdict, concat_ws(',', CASE WHEN claimed > 0 THEN 'claimed' END, CASE WHEN in_work > 0 THEN 'in_work' END, CASE WHEN ranking > 0 THEN 'ranking' END) AS reasons FROM j"),
    "set_published": (set_published, f"WITH {ARTICLES}, d AS (SELECT lower(replace(p_brand, '#', '-')) || '/' || p_size AS key, '2025-' || lpad(CAST(max(p_partkey % 12 + 1) AS VARCHAR), 2, '0') || '-01' AS new FROM part GROUP BY 1) SELECT article_id, url, CASE WHEN d.key IS NOT NULL AND active THEN d.new ELSE published_at END AS published_at, published_at AS published_before, d.key IS NOT NULL AND active AS changed FROM articles a LEFT JOIN d ON d.key = split_part(a.key, '/', 2) || '/' || split_part(a.key, '/', 3)"),
    "title_patterns": (title_patterns, f"WITH {BRIEFS} SELECT snapshot_id, query, label, hits AS pages, pages AS \"of\" FROM (SELECT snapshot_id, query, pages, unnest(['size', 'metal', 'hot', 'offer', 'standard']) AS label, unnest([size, metal, hot, offer, standard]) AS hits FROM facts) WHERE hits >= 3"),
    "related_queries": (related_queries, f"WITH {BRIEFS} SELECT query, CAST(rank AS INTEGER) AS rank, upper(phrase[1]) || split_part(phrase, ' ', 1)[2:] || ' ' || upper(split_part(phrase, ' ', 2)[1]) || split_part(phrase, ' ', 2)[2:] AS phrase, freq, kind FROM related"),
    "content_gaps": (content_gaps, f"WITH {BRIEFS} SELECT snapshot_id, f.query, {_GAPS} AS gaps FROM facts f LEFT JOIN asked a ON a.query = f.query"),
    "brief_recommendations": (brief_recommendations, f"WITH {TOLD} SELECT snapshot_id, query, format, our_position, advice FROM told"),
    "build_briefs": (build_briefs, f"""WITH {TOLD},
known AS (SELECT DISTINCT d.snapshot_id, d.query, d.region FROM docs d JOIN newest n ON n.snapshot_id = d.snapshot_id),
counted AS (SELECT query, count(*) AS related FROM related GROUP BY query)
SELECT k.snapshot_id, k.query, k.region, t.freq, t.score, coalesce(t.band, '{L.BAND_NONE}') AS band, t.our_position, CAST(t.pages AS INTEGER) AS top_pages, CASE WHEN t.snapshot_id IS NOT NULL THEN CAST(r.related AS INTEGER) END AS related, {_COUNT('gaps')} AS gaps, {_COUNT('advice')} AS advice
FROM known k LEFT JOIN told t ON t.snapshot_id = k.snapshot_id LEFT JOIN counted r ON r.query = k.query"""),
}
