"""Views of the supplied test tables in the shape of the model tables.

Every view is a DataFrame expression plus the same thing as a SQL common table expression,
so a registered query and its SQL twin start from equal inputs. Work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import dealt

AS_OF = "2000-06-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


# --- result pages: orders are snapshots, their lines are documents ---------------------


def snapshots(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("snapshot_id"),
        F.concat("c_mktsegment", F.lit(" "), F.lower("n_name")).alias("query"),
        F.col("n_regionkey").alias("region"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("timeout")).alias("error"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
    )


SNAPSHOTS = """
snapshots AS (
  SELECT o_orderkey AS snapshot_id, c_mktsegment || ' ' || lower(n_name) AS query, n_regionkey AS region,
         o_orderdate AS fetched_at, CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS error,
         strftime(o_orderdate, '%Y-%m') AS run_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def lines(spark, sf_dir) -> DataFrame:
    """Every line of an order in one running order, with its place and its place among sites.

    One window gives both, so the largest table is shuffled once.
    """
    raw = table(spark, sf_dir, "lineitem")
    pick = ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", *pick)
    site = F.col("l_returnflag") != "R"
    so_far = F.count_if(site).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return raw.select("l_orderkey", "l_linenumber", *pick).select(
        "l_orderkey", *pick, F.row_number().over(order).alias("place"), F.when(site, so_far).alias("organic_place")
    )


LINES = """
lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate,
         CAST(row_number() OVER w AS INTEGER) AS place,
         CASE WHEN l_returnflag <> 'R' THEN CAST(count(*) FILTER (l_returnflag <> 'R') OVER w AS INTEGER) END AS organic_place
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING)
)"""


def _domain(by: str) -> Column:
    name = {"region": F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")), "nation": F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))}[by]
    return F.concat(name, F.lit(".example"))


def page_lines(spark, sf_dir, by: str = "region") -> DataFrame:
    """Numbered documents of orders; up to thirteen each.

    Each small table is joined by itself, so that Spark sees its size, and before the wider part table.
    Lines meet by order again as plain columns; addresses and titles are put together after that.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    joined = (
        lines(spark, sf_dir)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("domain", _domain(by))
    )
    path = F.when(F.col("p_size") <= 5, "/").otherwise(F.concat(F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.col("p_size").cast("string")))
    return joined.select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.col("place").alias("position"),
        F.col("organic_place").alias("organic_position"),
        (F.col("l_returnflag") == "R").alias("is_wizard"),
        F.concat(F.lit("https://"), "domain", path).alias("url"),
        "domain",
        F.concat("p_name", F.lit(" "), "p_type").alias("title"),
        (F.col("l_partkey") % 3).cast("int").alias("title_hlwords"),
        F.when(F.col("p_size") <= 5, 0).otherwise(2).alias("url_depth"),
        F.col("p_size").cast("bigint").alias("domain_doccount"),
        F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss").alias("modtime"),
        (F.col("l_linestatus") == "F").alias("used"),
        F.lit(None).cast("string").alias("passage"),
    )


def docs(spark, sf_dir, by: str = "region") -> DataFrame:
    """Documents with their snapshots."""
    return page_lines(spark, sf_dir, by).join(snapshots(spark, sf_dir), "snapshot_id")


def docs_cte(by: str = "region") -> str:
    domain = {"region": "replace(lower(r_name), ' ', '-')", "nation": "replace(lower(n_name), '_', '-')"}[by]
    return (
        SNAPSHOTS + "," + LINES + f""",
page_lines AS (
  SELECT l_orderkey AS snapshot_id, place AS position, organic_place AS organic_position, l_returnflag = 'R' AS is_wizard,
         'https://' || {domain} || '.example' ||
           CASE WHEN p_size <= 5 THEN '/' ELSE '/' || replace(lower(p_brand), '#', '-') || '/' || p_size END AS url,
         {domain} || '.example' AS domain, p_name || ' ' || p_type AS title,
         CAST(l_partkey % 3 AS INTEGER) AS title_hlwords, CASE WHEN p_size <= 5 THEN 0 ELSE 2 END AS url_depth,
         CAST(p_size AS BIGINT) AS domain_doccount, l_shipdate AS modified, l_linestatus = 'F' AS used
  FROM lines JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
docs AS (
  SELECT p.*, s.query, s.region, s.fetched_at, s.error, s.run_id
  FROM page_lines p JOIN snapshots s ON p.snapshot_id = s.snapshot_id
)"""
    )


# --- owner data: events are shows, clicks and goals -------------------------------------


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def owner_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https:site-"), (F.col("user_id") % 10).cast("string"), F.lit(".example:443")).alias("host_id"),
        (F.col("user_id") % 10).cast("int").alias("host_no"),
        _k().alias("k"),
        F.to_date("ts").alias("day"),
        "event_type", "value",
    )


def search_queries(spark, sf_dir) -> DataFrame:
    """Weekly loads and 28-day loads with the same end; which came later depends on the host."""
    week_end = F.date_add(F.to_date(F.date_trunc("week", "day")), 6)
    loads = F.array(
        F.struct(F.date_sub("week_end", 6).alias("date_from"), F.col("week_end").alias("date_to"), F.lit(True).alias("weekly")),
        *[
            F.struct(F.date_sub(F.date_add("week_end", 7 * i), 27).alias("date_from"), F.date_add("week_end", 7 * i).alias("date_to"), F.lit(False).alias("weekly"))
            for i in range(4)
        ],
    )
    rows = owner_events(spark, sf_dir).withColumn("week_end", week_end).select("*", F.inline(loads))
    lag = F.when((F.col("host_no") % 2 == 0) == F.col("weekly"), 2).otherwise(1)
    return rows.groupBy("host_id", "host_no", "k", "date_from", "date_to", "weekly").agg(
        F.count_if(F.col("event_type") == "view").alias("shows"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.expr("(10 + (sum(cast(round(value * 100) AS bigint)) div count(1) + k * 37) % 2000 div 10) / 10.0D").alias("avg_show_position"),
    ).select(
        "host_id",
        F.concat(F.lit("query "), F.col("k").cast("string")).alias("query"),
        "k", "date_from", "date_to", "shows", "clicks",
        "avg_show_position",
        F.date_add("date_to", lag).cast("timestamp").alias("fetched_at"),
    )


SEARCH_QUERIES = """
owner_events AS (
  SELECT 'https:site-' || (user_id % 10) || '.example:443' AS host_id, CAST(user_id % 10 AS INTEGER) AS host_no,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day, event_type, value
  FROM events
),
loads AS (
  SELECT e.*, w.date_from, w.date_to, w.weekly FROM (
    SELECT *, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end FROM owner_events) e,
  LATERAL (SELECT e.week_end - 6 AS date_from, e.week_end AS date_to, true AS weekly
           UNION ALL SELECT e.week_end + 7 * i - 27, e.week_end + 7 * i, false FROM (VALUES (0), (1), (2), (3)) v(i)) w
),
search_queries AS (
  SELECT host_id, 'query ' || k AS query, k, date_from, date_to,
         count(*) FILTER (event_type = 'view') AS shows, count(*) FILTER (event_type = 'click') AS clicks,
         CAST(10 + (CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*) + k * 37) % 2000 // 10 AS DOUBLE) / 10 AS avg_show_position,
         CAST(date_to + CASE WHEN (host_no % 2 = 0) = weekly THEN 2 ELSE 1 END AS TIMESTAMP) AS fetched_at
  FROM loads GROUP BY host_id, host_no, k, date_from, date_to, weekly
)"""


def search_query_pages(spark, sf_dir) -> DataFrame:
    """The page of a query per load; some loads know none."""
    rows = search_queries(spark, sf_dir)
    page = F.concat(F.lit("/page-"), (F.col("k") % 37).cast("string"), F.when(F.dayofmonth("date_to") % 2 == 0, "/").otherwise(""))
    return rows.withColumn("url", F.when((F.col("k") + F.dayofmonth("date_from")) % 5 > 0, page)).withColumnRenamed("avg_show_position", "avg_position")


SEARCH_QUERY_PAGES = SEARCH_QUERIES + """,
search_query_pages AS (
  SELECT host_id, query, k, date_from, date_to, shows, clicks, avg_show_position AS avg_position, fetched_at,
         CASE WHEN (k + day(date_from)) % 5 > 0 THEN
           '/page-' || (k % 37) || CASE WHEN day(date_to) % 2 = 0 THEN '/' ELSE '' END END AS url
  FROM search_queries
)"""


# --- crawled pages ----------------------------------------------------------------------


def crawl(spark, sf_dir) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages"))
    host = F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1))
    return pages.select(
        "page_id",
        F.concat(F.lit("https://"), host, F.lit("/")).alias("site"),
        "url",
        F.lit(200).alias("status"),
        "html",
    )


CRAWL = r"""
crawl AS (
  SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/]+)', 1)) || '/' AS site, url, html,
         regexp_replace(url, '#.*$', '') AS norm_url
  FROM pages
)"""
