"""Scalar keys over the page, document and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import keys as K
from ..functions import words as WD

TEXT_WORD = "[0-9a-z]+"


def domain_keys(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select(
        "page_id", K.normalize_domain("url").alias("domain"), K.host_of("url").alias("host"), K.registrable_domain("url").alias("registrable"),
        K.is_portal(F.concat(F.lit("m."), F.when(F.col("page_id") % 3 == 0, "vk.com").otherwise("vk.example"))).alias("portal"),
        K.domain_matches("url", "example.com").alias("in_site"), K.domain_matches("url", "blog.tionsh.example.net", "host").alias("same_host"),
        K.same_site("url", F.lit("https://example.org/")).alias("same_site"),
    )


def url_keys(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select(
        "page_id", K.normalize_url("url").alias("normal"), K.dedup_key("url").alias("dedup"), K.normalize_path("url").alias("path_key"),
        K.page_path("url").alias("path"), K.article_url_key("url").alias("article_key"), K.url_depth("url").alias("depth"), K.crawlable("url").alias("crawlable"),
    )


def text_keys(spark, sf):
    d = B.documents(spark, sf)
    return d.select("doc_id", F.md5(K.clean_text("text", 160)).alias("clean"), F.md5(K.clean_text("text", 0)).alias("whole"), K.word_count("text").cast("bigint").alias("words"), F.md5(WD.stem_key("text")).alias("stem_key"))


def contains_query(spark, sf):
    """Do documents hold all significant words of their own first line."""
    d = B.documents(spark, sf)
    return d.select("doc_id", WD.contains_query("text", F.substring_index("text", ".", 1)).alias("own"), WD.contains_query("text", F.lit("thand erst")).alias("other"))


def canonical_forms(spark, sf):
    """Canonical title of the pages whose titles share their words."""
    p = B.table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("a"), F.concat("p_type", F.lit(" "), "p_name").alias("b"), "p_size")
    rows = p.select(F.col("a").alias("phrase"), "p_size").unionByName(p.select(F.col("b").alias("phrase"), "p_size"))
    return rows.groupBy(WD.stem_key("phrase").alias("stem_key")).agg(WD.pick_canonical("phrase", F.col("p_size") == 50).alias("canonical"))


def modtime_age(spark, sf):
    li = B.table(spark, sf, "lineitem")
    text = F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss"))
    age = K.age_days(K.parse_modtime(text), K.moment(B.AS_OF))
    return li.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("lines"), F.count(age).alias("dated"), F.max(age).alias("oldest"), F.min(age).alias("youngest"))


def slugs(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", K.slug(F.concat(F.lit(" "), "p_brand", F.lit(" -- "), "p_name", F.lit("!"))).alias("slug"), K.query_words(F.concat("p_name", F.lit(" x-yz "), "p_brand")).alias("words"))


U = "regexp_replace(url, '#.*$', '')"
_HOST = "regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\\.', '')"
_PATH = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
_STEMS = "list_aggregate(list_sort(regexp_extract_all(lower({}), '[0-9a-zа-я]+(-[0-9a-zа-я]+)*')), 'string_agg', ' ')"
_LONG = "list_filter(regexp_extract_all(lower({}), '[0-9a-z]+(-[0-9a-z]+)*'), lambda w: length(w) > 3)"
QUERIES = {
    "domain_keys": (domain_keys, f"WITH p AS (SELECT page_id, {_HOST} AS h FROM pages) SELECT page_id, h AS domain, h AS host, regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS registrable, page_id % 3 = 0 AS portal, regexp_matches(h, '(^|\\.)example\\.com$') AS in_site, h = 'blog.tionsh.example.net' AS same_host, regexp_matches(h, '(^|\\.)example\\.org$') AS same_site FROM pages JOIN p USING (page_id)"),
    "url_keys": (url_keys, f"SELECT page_id, {U} AS normal, regexp_replace(regexp_replace(regexp_replace({U}, '\\?utm_source=[^&]*$', ''), '(://[^/]+/[^?]*[^/?])/+(\\?|$)', '\\1\\2'), '(://[^/]+/)/+$', '\\1') AS dedup, coalesce(nullif(rtrim(lower({_PATH}), '/'), ''), '/') AS path_key, {_PATH} AS path, {_HOST} || rtrim({_PATH}, '/') AS article_key, CAST(len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) AS INTEGER) AS depth, true AS crawlable FROM pages"),
    "text_keys": (text_keys, f"""WITH c AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[`|«»"<>*“”„\\n]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) > 160 THEN rtrim(left(t, 160)) || '…' ELSE t END) AS clean, md5(t) AS whole, len(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+')) AS words, md5(coalesce({_STEMS.format('text')}, '')) AS stem_key FROM c"""),
    "contains_query": (contains_query, f"WITH d AS (SELECT doc_id, list_distinct({_LONG.format('text')}) AS t, list_distinct({_LONG.format(chr(39).join(['split_part(text, ', '.', ', 1)']))}) AS q FROM documents) SELECT doc_id, len(q) > 0 AND list_has_all(t, q) AS own, list_has_all(t, ['thand', 'erst']) AS other FROM d"),
    "canonical_forms": (canonical_forms, f"WITH r AS (SELECT p_name || ' ' || p_type AS phrase, p_size FROM part UNION ALL SELECT p_type || ' ' || p_name, p_size FROM part) SELECT {_STEMS.format('phrase')} AS stem_key, first(phrase ORDER BY p_size <> 50, length(phrase), phrase) AS canonical FROM r GROUP BY 1"),
    "modtime_age": (modtime_age, f"WITH a AS (SELECT l_linenumber, CASE WHEN l_linenumber <> 7 THEN epoch(TIMESTAMP '{B.AS_OF}' - l_shipdate) / 86400.0 END AS age FROM lineitem) SELECT l_linenumber, count(*) AS lines, count(age) AS dated, CAST(max(age) AS DOUBLE) AS oldest, CAST(min(age) AS DOUBLE) AS youngest FROM a GROUP BY l_linenumber"),
    "slugs": (slugs, "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 2 + CAST(length(regexp_extract(p_name, '^(\\w+)', 1)) > 2 AS INTEGER) + CAST(length(regexp_extract(p_brand, '#(\\d+)', 1)) > 2 AS INTEGER) AS words FROM part"),
}
