"""Raw result pages and demand payloads, derived from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..sources import demand as DM
from ..sources import serp as SP

PER_PAGE = 10  # lines of an order per raw page; pages 0 and 1


def raw_pages(spark, sf):
    """Result pages as XML text, ten documents a page; an order's empty second page was never collected."""
    docs = B.page_lines(spark, sf).withColumn("page_no", F.floor((F.col("position") - 1) / PER_PAGE).cast("int"))
    title = F.when(F.col("is_wizard"), F.concat(F.lit("Видео по запросу "), "title")).otherwise(
        F.concat(F.repeat(F.lit("<hlword>w</hlword> "), F.col("title_hlwords")), F.col("title"))
    )
    group = F.concat(
        F.lit('<group><categ attr="d" name="'), "domain", F.lit('"/><doccount>'), F.col("domain_doccount").cast("string"),
        F.lit("</doccount><doc><url>"), "url", F.lit("</url><title>"), title, F.lit("</title><modtime>"), "modtime",
        F.lit("</modtime></doc></group>"),
    )
    pages = docs.groupBy("snapshot_id", "page_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", group.alias("g")))), lambda x: x["g"]), "").alias("groups")
    )
    snaps = B.snapshots(spark, sf).select("snapshot_id", "query", "region", "fetched_at", "error")
    good = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><yandexsearch><response><found priority="phrase">1</found><found priority="all">'),
        (F.col("snapshot_id") + F.col("page_no")).cast("string"),
        F.lit('</found><results><grouping>'), "groups", F.lit("</grouping></results></response></yandexsearch>"),
    )
    bad = F.lit('<yandexsearch><response><error code="32">timeout</error></response></yandexsearch>')
    return pages.join(snaps, "snapshot_id").select(
        F.col("snapshot_id").alias("fetch_id"), "page_no", "query", "region", "fetched_at",
        F.when(F.col("error").isNotNull() & (F.col("page_no") == 1), bad).otherwise(good).alias("xml"),
    )


PAGED = B.docs_cte() + f""",
paged AS (
  SELECT p.*, (position - 1) // {PER_PAGE} AS page_no, s.query, s.region, s.fetched_at, s.error AS failed
  FROM page_lines p JOIN snapshots s USING (snapshot_id)
),
parsed AS (SELECT * FROM paged WHERE NOT (failed IS NOT NULL AND page_no = 1)),
fetches AS (
  SELECT snapshot_id, query, region, fetched_at, max(failed) AS failed,
         bool_or(page_no = 0) AS p0, bool_or(page_no = 1) AS p1
  FROM paged GROUP BY ALL
),
gates AS (
  SELECT *, CAST(p0 AS INTEGER) + CAST(p1 AND failed IS NULL AS INTEGER) AS pages_ok,
         CASE WHEN NOT p0 THEN 'page 1 of 2: not collected' WHEN NOT p1 THEN 'page 2 of 2: not collected'
              WHEN failed IS NOT NULL THEN 'page 2 of 2: timeout' END AS error,
         CASE WHEN NOT p0 THEN 0 WHEN NOT p1 OR failed IS NOT NULL THEN 1 ELSE 2 END AS usable
  FROM fetches
),
stitched AS (
  SELECT d.*, CAST(row_number() OVER w AS INTEGER) AS place,
         CASE WHEN NOT is_wizard THEN CAST(count(*) FILTER (NOT is_wizard) OVER w AS INTEGER) END AS organic,
         row_number() OVER (PARTITION BY d.snapshot_id, lower(trim(d.url)) ORDER BY d.position) AS nth, g.error AS gate
  FROM paged d JOIN gates g ON g.snapshot_id = d.snapshot_id AND d.page_no < g.usable
  WINDOW w AS (PARTITION BY d.snapshot_id ORDER BY d.position)
)"""


def serp_docs_from_xml(spark, sf):
    parsed = SP.page_docs(SP.serp_docs_from_xml(raw_pages(spark, sf)))
    return parsed.withColumnRenamed("fetch_id", "snapshot_id").select(
        "snapshot_id", "page_no", "position", "organic_position", "is_wizard", "url", "domain", "title", "title_hlwords", "url_depth", "domain_doccount", "modtime"
    )


def merge_serp_pages(spark, sf):
    merged = SP.snapshot_docs(SP.merge_serp_pages(SP.serp_docs_from_xml(raw_pages(spark, sf)), 20))
    return merged.select("snapshot_id", "query", "region", "error", "position", "organic_position", "is_wizard", "url", "domain_doccount")


def flag_incomplete(spark, sf):
    return SP.flag_incomplete(SP.serp_docs_from_xml(raw_pages(spark, sf)), 20).withColumnRenamed("fetch_id", "snapshot_id")


# --- demand payloads -------------------------------------------------------------------


def raw_demand(spark, sf):
    """One answer per customer; every tenth is an error, counts are partly text."""
    c = B.table(spark, sf, "customer")
    key = F.col("c_custkey")
    payload = F.when(key % 10 == 3, F.lit('{"_error": "quota"}')).otherwise(
        F.concat(
            F.lit('{"totalCount": "'), ((key * 7) % 500).cast("string"),
            F.lit('", "results": [{"phrase": "'), F.lower("c_mktsegment"), F.lit(' price", "count": '), ((key * 3) % 200).cast("string"),
            F.lit('}, {"phrase": "'), F.lower("c_name"), F.lit('", "count": "bad"}], "associations": [{"phrase": "nation '),
            F.col("c_nationkey").cast("string"), F.lit('", "count": "'), (key % 90).cast("string"), F.lit('"}]}'),
        )
    )
    return c.select(F.col("c_name").alias("phrase"), F.col("c_nationkey").cast("string").alias("region"), key.alias("k"), payload.alias("response"))


def keyword_frequencies(spark, sf):
    return DM.keyword_frequencies_from_json(raw_demand(spark, sf).drop("k"))


def keyword_expansions(spark, sf):
    rows = DM.keyword_expansions_from_json(raw_demand(spark, sf).drop("k").withColumnRenamed("phrase", "seed"))
    return rows


def latest_keyword_snapshot(spark, sf):
    """Parts as lines of one snapshot a size, with broken lines, blanks and refused answers; the newest size counts."""
    p, key = B.table(spark, sf, "part"), F.col("p_partkey")
    line = F.when(key % 13 == 0, F.lit('{"seed": "broken')).when(key % 17 == 0, F.lit(" ")).when(
        key % 11 == 0, F.concat(F.lit('{"seed": "'), "p_name", F.lit('", "response": {"_error": "quota"}}'))
    ).when(key % 7 == 0, F.concat(F.lit('{"seed": "'), "p_name", F.lit('"}'))).otherwise(
        F.concat(F.lit(' {"seed": "'), "p_name", F.lit('", "response": {"totalCount": "'), key.cast("string"), F.lit('"}}')))
    file = F.concat(F.lit("wordstat-2024-01-"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".jsonl"))
    return DM.keyword_snapshot(p.select(file.alias("file"), key.alias("line_no"), line.alias("value")))


def demand_dynamics(spark, sf):
    """Monthly order counts per customer nation as a payload, read back as a series."""
    monthly = (
        B.snapshots(spark, sf).groupBy("query", F.date_format("fetched_at", "yyyy-MM-01").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    )
    point = F.concat(
        F.lit('{"date": "'), "month", F.lit('T00:00:00Z", "count": "'), F.col("n").cast("string"), F.lit('", "share": '),
        F.when(F.col("n") % 2 == 0, F.lit('"x"')).otherwise(F.concat(F.lit('"0.'), F.col("n").cast("string"), F.lit('"'))), F.lit("}"),
    )
    # a month count of a query is bounded by the calendar
    raw = monthly.groupBy("query").agg(F.concat(F.lit('{"results": ['), F.array_join(F.array_sort(F.collect_list(point)), ","), F.lit("]}")).alias("response"))
    return DM.demand_dynamics(raw.withColumnRenamed("query", "phrase")).select("phrase", F.substring("date", 1, 10).alias("date"), "count", "share")


def _regional(spark, sf):
    c = B.table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    point = F.concat(
        F.lit('{"region": "'), F.col("c_nationkey").cast("string"), F.lit('", "count": "'), F.col("n").cast("string"),
        F.lit('", "share": "0.5", "affinityIndex": "'), (F.col("n") / 4).cast("string"), F.lit('"}'),
    )
    return c.groupBy(F.col("c_mktsegment").alias("phrase")).agg(F.concat(F.lit('{"results": ['), F.array_join(F.array_sort(F.collect_list(point)), ","), F.lit("]}")).alias("response"))


def _tree(spark, sf):
    """Regions and their nations as one nested payload per region."""
    nation, region = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    leaf = F.concat(F.lit('{"id": '), F.col("n_nationkey").cast("string"), F.lit(', "label": "'), "n_name", F.lit('"}'))
    leaves = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(leaf)), ",").alias("children"))
    return leaves.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit('{"regions": [{"id": "r'), F.col("r_regionkey").cast("string"), F.lit('", "label": "'), "r_name", F.lit('", "children": ['), "children", F.lit("]}]}")).alias("response")
    )


def demand_by_region(spark, sf):
    return DM.demand_by_region(_regional(spark, sf), DM.flatten_region_tree(_tree(spark, sf)))


def flatten_region_tree(spark, sf):
    return DM.flatten_region_tree(_tree(spark, sf))


QUERIES = {
    "serp_docs_from_xml": (serp_docs_from_xml, f"WITH {PAGED} SELECT snapshot_id, page_no, CAST(row_number() OVER w AS INTEGER) AS position, CASE WHEN NOT is_wizard THEN CAST(count(*) FILTER (NOT is_wizard) OVER w AS INTEGER) END AS organic_position, is_wizard, url, domain, CASE WHEN is_wizard THEN 'Видео по запросу ' || title ELSE repeat('w ', title_hlwords) || title END AS title, CASE WHEN is_wizard THEN 0 ELSE title_hlwords END AS title_hlwords, url_depth, domain_doccount, strftime(modified, '%Y%m%dT%H%M%S') AS modtime FROM parsed WINDOW w AS (PARTITION BY snapshot_id, page_no ORDER BY position)"),
    "merge_serp_pages": (merge_serp_pages, f"WITH {PAGED} SELECT snapshot_id, query, region, gate AS error, place AS position, organic AS organic_position, is_wizard, url, domain_doccount FROM stitched WHERE nth = 1"),
    "flag_incomplete": (flag_incomplete, f"WITH {PAGED} SELECT snapshot_id, query, region, 2 AS pages_needed, pages_ok, error FROM gates"),
    "keyword_frequencies": (keyword_frequencies, "SELECT c_name AS phrase, CAST(c_nationkey AS VARCHAR) AS region, CASE WHEN c_custkey % 10 <> 3 THEN (c_custkey * 7) % 500 END AS freq, CASE WHEN c_custkey % 10 = 3 THEN 'quota' END AS error FROM customer"),
    "keyword_expansions": (keyword_expansions, "WITH c AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS region FROM customer WHERE c_custkey % 10 <> 3) SELECT c_name AS seed, region, 'top' AS kind, 1 AS place, lower(c_mktsegment) || ' price' AS phrase, (c_custkey * 3) % 200 AS freq FROM c UNION ALL SELECT c_name, region, 'top', 2, lower(c_name), 0 FROM c UNION ALL SELECT c_name, region, 'association', 1, 'nation ' || c_nationkey, c_custkey % 90 FROM c"),
    "latest_keyword_snapshot": (latest_keyword_snapshot, "SELECT p_name AS seed, arg_max(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey END, p_partkey) AS freq FROM part WHERE p_size = (SELECT max(p_size) FROM part) AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 11 <> 0 GROUP BY p_name"),
    "demand_dynamics": (demand_dynamics, f"WITH {B.SNAPSHOTS} SELECT query AS phrase, strftime(fetched_at, '%Y-%m-01') AS date, count(*) AS count, CASE WHEN count(*) % 2 <> 0 THEN CAST('0.' || count(*) AS DOUBLE) END AS share FROM snapshots GROUP BY query, strftime(fetched_at, '%Y-%m-01')"),
    "demand_by_region": (demand_by_region, "SELECT c_mktsegment AS phrase, CAST(c_nationkey AS VARCHAR) AS region_id, count(*) AS count, CAST(0.5 AS DOUBLE) AS share, CAST(count(*) / 4.0 AS DOUBLE) AS affinity, any_value(n_name) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, c_nationkey"),
    "flatten_region_tree": (flatten_region_tree, "SELECT 'r' || r_regionkey AS id, r_name AS label, 1 AS level FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 2 FROM nation"),
}
