"""Site audit and AI readiness over the crawled page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import keys as K
from ..functions import lists as L
from ..operators import audit as AU
from ..operators import readiness as RD
from ..session import checkpointed
from ..sources import html as H
from ..sources import sitefiles as SF


def _crawl(spark, sf):
    """The page table with some addresses answering 404, 500 or not at all."""
    key = F.col("page_id")
    status = F.when(key % 17 == 3, 404).when(key % 23 == 5, 500).when(key % 29 == 7, F.lit(None)).otherwise(200)
    chain = F.when(key % 13 == 1, F.array("url", "url")).otherwise(F.array().cast("array<string>"))
    robots = F.when(key % 11 == 2, F.create_map(F.lit("X-Robots-Tag"), F.lit("noindex, nofollow")))
    return B.crawl(spark, sf).select("site", "url", status.cast("int").alias("status"), "html", chain.alias("redirect_chain"), robots.alias("headers"), "page_id")


def _facts(spark, sf):
    return H.page_facts(_crawl(spark, sf))


def _stored(spark, sf):
    return checkpointed(_facts(spark, sf))


def _sitemap(spark, sf):
    return B.crawl(spark, sf).where("page_id % 2 = 0").select("site", "url")


def _disallowed(spark, sf):
    return B.crawl(spark, sf).where(F.col("url").rlike("/de/")).select("site", "url")


DEDUP = "regexp_replace(regexp_replace(regexp_replace({}, '#.*$', ''), '\\?utm_source=[^&]*$', ''), '(://[^/]+/[^?]*[^/?])/+(\\?|$)', '\\1\\2')"
FACTS = B.CRAWL + f""",
states AS (
  SELECT *, CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 23 = 5 THEN 500 WHEN page_id % 29 = 7 THEN NULL ELSE 200 END AS status,
         {DEDUP.format('url')} AS page_key, page_id % 11 = 2 AS closed
  FROM crawl
),
read AS (SELECT *, CASE WHEN status = 200 THEN html ELSE '' END AS body FROM states),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<title>.*?</title>', ' ', 'gs'), '<style>.*?</style>', ' ', 'gs'),
            '<script>.*?</script>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs') AS stripped
  FROM read
),
facts AS (
  SELECT page_id, site, url, norm_url, page_key, status, closed, body,
         trim(regexp_replace(replace(replace(regexp_extract(body, '<title>(.*?)</title>', 1, 's'), '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS title,
         len(regexp_extract_all(body, '<h1>')) AS h1,
         len(regexp_extract_all(replace(replace(replace(replace(stripped, '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+')) AS word_count,
         list_distinct(regexp_extract_all(body, '<a href="([^"]*)"', 1)) AS hrefs
  FROM plain
),
edges AS (
  SELECT * FROM (SELECT site, norm_url AS source_url, page_key,
    regexp_extract(url, '^(https?://[^/]+)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target_key
    FROM (SELECT *, unnest(hrefs) AS href FROM facts)) WHERE target_key <> page_key
),
shut AS (SELECT DISTINCT site, page_key FROM facts WHERE status = 200 AND closed),
ok AS (SELECT *, NOT EXISTS (SELECT 1 FROM shut s WHERE s.site = facts.site AND s.page_key = facts.page_key) AS shown FROM facts WHERE status = 200),
listed AS (SELECT DISTINCT site, page_key FROM facts WHERE page_id % 2 = 0),
barred AS (SELECT * FROM facts WHERE contains(url, '/de/'))"""


def page_facts(spark, sf):
    f = _facts(spark, sf)
    return f.select(
        "page_id", "site", "url", "page_key", "status", F.coalesce("title", F.lit("")).alias("title"), "title_len", F.size("h1").cast("bigint").alias("h1"),
        F.col("word_count").cast("bigint").alias("word_count"), F.size("internal_links").cast("bigint").alias("internal_links"), F.coalesce("robots_meta", F.lit("")).alias("robots_meta"),
    )


def incoming_links(spark, sf):
    return AU.link_counts(_facts(spark, sf)).select("site", "target_key", "links", "first_source")


def availability_findings(spark, sf):
    return AU.availability_findings(_stored(spark, sf)).select("site", "severity", "code", "url")


def contradiction_findings(spark, sf):
    return AU.contradiction_findings(_stored(spark, sf), _sitemap(spark, sf), _disallowed(spark, sf)).select("site", "severity", "code", "url")


def duplicate_titles(spark, sf):
    """Whole titles; the pages under two shop sections get their section's title, so that some are shared."""
    return AU.duplicate_findings(_shared_titles(spark, sf), "title").select("site", "code", "url", F.substring_index("evidence", " ", 1).cast("int").alias("pages"))


def _shared_titles(spark, sf):
    """Every third page of a site carries its host's title, the others their own."""
    own = F.concat(F.lit("Catalogue of "), F.regexp_extract("url", "^https?://([^/]+)", 1))
    return _stored(spark, sf).withColumn("title", F.when(F.col("page_id") % 3 == 0, own).otherwise(F.col("title")))


def duplicate_members(spark, sf):
    return AU.duplicate_members(_shared_titles(spark, sf), "title").select("site", "field", F.md5("value").alias("value"), "url", "pages")


def duplicate_descriptions(spark, sf):
    """No test page has a description: its host stands in, and the page number for odd ones."""
    told = F.concat(F.lit("About "), F.regexp_extract("url", "^https?://([^/]+)", 1), F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("page_id").cast("string")))
    return AU.duplicate_findings(_stored(spark, sf).withColumn("description", told), "description").select("site", "code", "url", F.substring_index("evidence", " ", 1).cast("int").alias("pages"))


def page_rules(spark, sf):
    return AU.page_rule_findings(_facts(spark, sf)).select("site", "severity", "code", "url", "evidence")


def orphan_pages(spark, sf):
    return AU.orphan_findings(_stored(spark, sf)).select("site", "code", "url")


def links_to_check(spark, sf):
    return AU.links_to_check(_stored(spark, sf), 20).select("site", "n", "source_url")


def _all(spark, sf, facts=None):
    return AU.audit_findings(_stored(spark, sf) if facts is None else facts, _sitemap(spark, sf), _disallowed(spark, sf))


def audit_summary(spark, sf):
    return AU.audit_summary(_all(spark, sf)).select("site", "severity", "code", "findings", "severity_rank")


def audit_totals(spark, sf):
    return AU.audit_totals(_all(spark, sf))


_RULE_ROWS = """
rule_rows AS (
  SELECT site, 'major' AS severity, 'missing-title' AS code, norm_url AS url, 'no <title>' AS evidence FROM ok WHERE shown AND title = ''
  UNION ALL SELECT site, 'major', 'title-too-long', norm_url, length(title) || ' chars' FROM ok WHERE shown AND length(title) > 60
  UNION ALL SELECT site, 'minor', 'title-too-short', norm_url, length(title) || ' chars' FROM ok WHERE shown AND title <> '' AND length(title) < 30
  UNION ALL SELECT site, 'major', 'missing-description', norm_url, 'no description' FROM ok WHERE shown
  UNION ALL SELECT site, 'major', 'missing-h1', norm_url, 'no <h1>' FROM ok WHERE h1 = 0
  UNION ALL SELECT site, 'major', 'multiple-h1', norm_url, h1 || ' tags <h1>' FROM ok WHERE h1 > 1
  UNION ALL SELECT site, 'major', 'missing-canonical', norm_url, 'no canonical' FROM ok
  UNION ALL SELECT site, 'minor', 'thin-content', norm_url, word_count || ' words' FROM ok WHERE shown AND word_count < 300
  UNION ALL SELECT site, 'minor', 'missing-og', norm_url, 'og:title, og:description, og:image' FROM ok WHERE shown
  UNION ALL SELECT site, 'minor', 'missing-schema', norm_url, 'no JSON-LD or microdata' FROM ok WHERE shown
)"""
_ORPHANS = "SELECT o.site, 'major' AS severity, 'orphan-page' AS code, o.norm_url AS url FROM ok o WHERE shown AND o.page_key <> o.site AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.site = o.site AND e.target_key = o.page_key)"
_AVAILABLE = """SELECT site, 'critical' AS severity, 'page-unavailable' AS code, norm_url AS url FROM facts WHERE status IS NULL OR status = 500
  UNION ALL SELECT site, 'critical', CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.site = f.site AND e.target_key = f.page_key) THEN 'broken-internal-link' ELSE 'page-unavailable' END, norm_url FROM facts f WHERE status = 404
  UNION ALL SELECT site, 'critical', 'redirect-chain', norm_url FROM facts WHERE page_id % 13 = 1"""
_CONTRADICTIONS = """SELECT o.site, 'critical' AS severity, 'noindex-in-sitemap' AS code, norm_url AS url FROM ok o JOIN listed USING (site, page_key) WHERE closed
  UNION ALL SELECT DISTINCT site, 'minor', 'noindex-not-checked', site FROM ok WHERE closed
  UNION ALL SELECT b.site, 'critical', 'robots-disallow-in-sitemap', b.url FROM barred b JOIN listed USING (site, page_key)
  UNION ALL SELECT DISTINCT site, 'minor', 'robots-disallow-not-checked', site FROM barred"""
_DUPLICATES = "SELECT site, 'major' AS severity, 'duplicate-title' AS code, norm_url AS url FROM (SELECT *, count(*) OVER (PARTITION BY site, lower(title)) AS n FROM ok WHERE shown AND title <> '') WHERE n > 1"
_EVERY = f"every AS ({_AVAILABLE} UNION ALL {_CONTRADICTIONS} UNION ALL {_DUPLICATES} UNION ALL SELECT site, severity, code, url FROM rule_rows UNION ALL {_ORPHANS})"


# --- robots, sitemaps, llms.txt -----------------------------------------------------------

_ROBOTS = (
    "# all\nUser-agent: *\nDisallow: /",
    "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /en/ # c\nAllow: /\n\nUser-agent: *\nAllow: /en/\nDisallow: /e",
    "Disallow: /x\nUser-agent: PerplexityBot\n\nDisallow: /\nUser-agent: *\nDisallow:\nSitemap: https://a.example/map.xml",
)


def _robots(spark, sf):
    """One robots file per site; the variant depends on how many pages the site has."""
    sites = B.crawl(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("a"), F.max("url").alias("b"))
    text = F.when(F.col("n") % 3 == 0, _ROBOTS[0]).when(F.col("n") % 3 == 1, _ROBOTS[1]).otherwise(_ROBOTS[2])
    return sites.select("site", text.alias("text"), F.when(F.col("n") == 5, 403).otherwise(200).alias("status"), F.array(K.page_path("a"), K.page_path("b")).alias("paths"))


def robots_rules(spark, sf):
    return SF.robots_rules(_robots(spark, sf)).select("site", "group_no", "kind", "path", "line_no", F.array_join(F.transform("agents", lambda a: a["agent"]), ",").alias("agents"))


def bot_access(spark, sf):
    r = _robots(spark, sf)
    out = RD.bot_access(r.select("site", "text", "status"), r.select("site", "paths"))
    return out.select("site", "bot", "role", "severity", "allowed", "whole_site", F.size("blocked_paths").cast("bigint").alias("blocked"), "line_no")


SITES = B.CRAWL + """,
site_list AS (
  SELECT site, count(*) AS n, regexp_extract(min(url), '^https?://[^/]+([^?#]*)', 1) AS a, regexp_extract(max(url), '^https?://[^/]+([^?#]*)', 1) AS b FROM crawl GROUP BY site
),
tried AS (SELECT site, n, unnest(['/', a, b]) AS path FROM site_list),
bots AS (SELECT * FROM (VALUES ('OAI-SearchBot', 'search', 'critical'), ('ChatGPT-User', 'user', 'major'), ('GPTBot', 'training', 'minor'), ('PerplexityBot', 'search', 'critical'),
  ('Perplexity-User', 'user', 'major'), ('Claude-SearchBot', 'search', 'critical'), ('Claude-User', 'user', 'major'), ('ClaudeBot', 'training', 'minor'),
  ('Google-Extended', 'training', 'major'), ('YandexAdditional', 'search', 'critical'), ('YandexAdditionalBot', 'search', 'critical')) v(bot, role, severity)),
access AS (
  SELECT t.site, b.bot, b.role, b.severity, t.path,
    CASE WHEN n = 5 THEN -1 WHEN n % 3 = 0 THEN 3
         WHEN n % 3 = 1 AND b.bot IN ('GPTBot', 'ClaudeBot') THEN CASE WHEN starts_with(path, '/en/') THEN 3 ELSE 0 END
         WHEN n % 3 = 1 THEN CASE WHEN starts_with(path, '/en/') THEN 0 WHEN starts_with(path, '/e') THEN 8 ELSE 0 END ELSE 0 END AS line
  FROM tried t CROSS JOIN bots b
)"""


def sitemap_urls(spark, sf):
    return SF.sitemap_urls(_maps(spark, sf))


def _maps(spark, sf):
    """One declared map per page; every fifth is an index of a nested and a foreign map, every eleventh a refused DTD."""
    c = B.crawl(spark, sf)
    key = F.col("page_id").cast("string")
    one = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.regexp_replace("url", "[?#].*$", ""), F.lit(" </loc><lastmod>2024-01-01</lastmod></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), "site", F.lit("nested-"), key, F.lit(".xml</loc></sitemap><sitemap><loc>https://elsewhere.test/"), key, F.lit(".xml</loc></sitemap></sitemapindex>"))
    dtd = F.lit('<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>')
    body = F.when(F.col("page_id") % 5 == 0, index).when(F.col("page_id") % 11 == 0, dtd).otherwise(one)
    declared = c.select("site", F.concat("site", F.lit("map-"), key, F.lit(".xml")).alias("url"), body.alias("body"))
    nested = c.where("page_id % 5 = 0").select("site", F.concat("site", F.lit("nested-"), key, F.lit(".xml")).alias("url"), one.alias("body"))
    parsed = checkpointed(SF.parse_sitemaps(declared.unionByName(nested)))
    return SF.expand_sitemaps(declared.select("site", "url"), parsed)


def sitemap_findings(spark, sf):
    return AU.sitemap_findings(_maps(spark, sf))


MAPS = B.CRAWL + """,
reached AS (
  SELECT site, 0 AS depth, site || 'map-' || page_id || '.xml' AS url, regexp_replace(crawl.url, '[?#].*$', '') AS loc, page_id % 5 = 0 AS is_index, page_id % 5 <> 0 AND page_id % 11 = 0 AS refused FROM crawl
  UNION ALL SELECT site, 1, site || 'nested-' || page_id || '.xml', regexp_replace(crawl.url, '[?#].*$', ''), false, false FROM crawl WHERE page_id % 5 = 0
),
opened AS (SELECT * FROM reached)"""


def _llms(spark, sf):
    d = B.documents(spark, sf)
    k = F.col("doc_id") % 6
    text = (
        F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("# Site\n> about\n## Pages\n- [a](/x): y\n"), "text"))
        .when(k == 2, F.concat(F.lit("# A\n\nplain\n### deep\n## S\n- nolink\n* [b](c) \n## Empty\n"), F.translate("text", "|", "-")))
        .when(k == 3, F.lit(" \n")).when(k == 4, F.lit("# T\n# T2\n> q\n## S1\ntext\n")).otherwise(F.concat(F.lit("﻿# B\n> q\n## S\n+ [k](u)\n"), "text"))
    )
    site = F.concat(F.lit("https://doc-"), F.col("doc_id").cast("string"), F.lit(".example/"))
    return d.select(site.alias("site"), F.concat(site, F.lit("llms.txt")).alias("url"), text.alias("text"))


def llms_txt_findings(spark, sf):
    return SF.llms_txt_findings(_llms(spark, sf)).select("site", "severity", "code", F.md5("evidence").alias("evidence"))


LLMS = """
files AS (
  SELECT 'https://doc-' || doc_id || '.example/' AS site, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '# Site' || chr(10) || '> about' || chr(10) || '## Pages' || chr(10) || '- [a](/x): y' || chr(10) || text
    WHEN 2 THEN '# A' || chr(10) || chr(10) || 'plain' || chr(10) || '### deep' || chr(10) || '## S' || chr(10) || '- nolink' || chr(10) || '* [b](c) ' || chr(10) || '## Empty' || chr(10) || replace(text, '|', '-')
    WHEN 3 THEN ' ' || chr(10) WHEN 4 THEN '# T' || chr(10) || '# T2' || chr(10) || '> q' || chr(10) || '## S1' || chr(10) || 'text' || chr(10)
    ELSE '# B' || chr(10) || '> q' || chr(10) || '## S' || chr(10) || '+ [k](u)' || chr(10) || text END AS text FROM documents
),
raw_lines AS (SELECT site, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT site, string_split(text, chr(10)) AS l FROM files)),
numbered AS (
  SELECT *, row_number() OVER w AS n, count(*) FILTER (regexp_matches(line, '^##\\s+\\S')) OVER w AS section,
         regexp_matches(line, '^#\\s+\\S') AS h1, regexp_matches(line, '^#{3,6}\\s+\\S') AS deeper, regexp_matches(line, '^\\s*[-*+]\\s+') AS item,
         regexp_matches(line, '\\[[^\\]]+\\]\\([^)\\s]+\\)') AS link
  FROM raw_lines WHERE NOT regexp_matches(line, '^\\s*$') WINDOW w AS (PARTITION BY site ORDER BY i)
),
whole AS (
  SELECT f.site, max(line) FILTER (n = 1) AS first, bool_or(h1) FILTER (n = 1) AS first_h1, max(line) FILTER (n = 2) AS second, count(*) FILTER (h1) AS h1s,
         arg_min(line, i) FILTER (section = 0 AND deeper AND n > 1) AS deep, max(section) AS sections, count(*) FILTER (section > 0 AND item AND link) AS links
  FROM files f LEFT JOIN numbered USING (site) GROUP BY f.site
),
parts AS (
  SELECT site, section, max(line) FILTER (regexp_matches(line, '^##\\s+\\S')) AS heading, count(*) FILTER (item) AS items, arg_min(line, i) FILTER (item AND NOT link) AS bad
  FROM numbered WHERE section > 0 GROUP BY site, section
),
found AS (
  SELECT site, 'major' AS severity, 'llms-txt-empty' AS code, '0 lines' AS evidence FROM whole WHERE first IS NULL
  UNION ALL SELECT site, 'major', 'llms-txt-no-h1', first FROM whole WHERE NOT first_h1
  UNION ALL SELECT site, 'minor', 'llms-txt-many-h1', CAST(h1s AS VARCHAR) FROM whole WHERE h1s > 1
  UNION ALL SELECT site, 'minor', 'llms-txt-no-summary', coalesce(second, '') FROM whole WHERE first_h1 AND NOT coalesce(starts_with(ltrim(second), '>'), false)
  UNION ALL SELECT site, 'minor', 'llms-txt-heading-before-sections', deep FROM whole WHERE deep IS NOT NULL
  UNION ALL SELECT site, 'minor', 'llms-txt-no-sections', '0 sections' FROM whole WHERE first IS NOT NULL AND sections = 0
  UNION ALL SELECT site, 'major', 'llms-txt-no-links', '0 links' FROM whole WHERE sections > 0 AND links = 0
  UNION ALL SELECT site, 'minor', 'llms-txt-item-without-link', bad FROM parts WHERE bad IS NOT NULL
  UNION ALL SELECT site, 'minor', 'llms-txt-section-without-list', heading FROM parts WHERE items = 0
)"""


def ai_page_facts(spark, sf):
    """Pages with structured data added by page number, read back."""
    key = F.col("page_id")
    block = (
        F.when(key % 4 == 0, F.lit('<script type="application/ld+json">{"@graph": [{"@type": ["Organization", "Corporation"]}, {"x": {"@type": "FAQPage"}}]}</script>'))
        .when(key % 4 == 1, F.lit('<script type="application/ld+json">{bad</script><link rel="alternate" type="text/markdown" href="page.md">'))
        .when(key % 4 == 2, F.lit('<div itemtype="https://schema.org/FAQPage/"></div>')).otherwise(F.lit(""))
    )
    crawl = B.crawl(spark, sf).withColumn("html", F.concat(F.col("html"), block))
    f = H.ai_page_facts(H.page_facts(crawl))
    return f.select("url", "jsonld_blocks", F.array_join("jsonld_types", ",").alias("types"), F.size("jsonld_errors").alias("errors"), F.array_join("microdata_types", ",").alias("micro"), "faq", F.coalesce(F.regexp_extract("markdown_alternate", "([^/]*)$", 1), F.lit("")).alias("markdown"))


def ai_readiness(spark, sf):
    """All readiness findings; why a page did not answer is told in words, which are left out."""
    told = F.when(F.col("code") == "page-unavailable", "").otherwise(F.col("evidence"))
    return ready_findings(spark, sf).withColumn("evidence", told)


def ready_findings(spark, sf, facts=None):
    """Robots, llms.txt and page findings of every crawled site."""
    read = H.ai_page_facts(_facts(spark, sf) if facts is None else facts).withColumn("is_home", F.col("url") == F.col("site"))
    facts = checkpointed(read) if facts is None else read
    robots = _robots(spark, sf)
    llms = B.crawl(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") % 2 == 0, 200).otherwise(404)
    files = robots.select("site", F.lit("robots").alias("kind"), F.concat("site", F.lit("robots.txt")).alias("url"), "status", F.lit("text/plain").alias("content_type"), "text").unionByName(
        llms.select("site", F.lit("llms").alias("kind"), F.concat("site", F.lit("llms.txt")).alias("url"), kind.alias("status"), F.lit("text/plain").alias("content_type"), F.lit("# S\n> s\n## A\n- [a](b)\n").alias("text"))
    )
    return RD.ai_readiness(facts, files, robots.select("site", "paths")).select("site", "severity", "code", "url", "evidence", "severity_rank")


#: every readiness finding; needs FACTS and the sites of SITES
READY = SITES.removeprefix(B.CRAWL) + """,
walked AS (SELECT site, n, unnest(p) AS path, generate_subscripts(p, 1) AS i FROM (SELECT site, n, CASE WHEN a = '/' AND b = '/' THEN ['/'] WHEN a = '/' THEN ['/', b] WHEN b = '/' THEN ['/', a] ELSE ['/', a, b] END AS p FROM site_list)),
closed_paths AS (
  SELECT w.site, b.bot, b.severity, string_agg(path, ', ' ORDER BY i) AS paths, bool_or(path = '/') AS whole, min(a.line) FILTER (a.line > 0) AS line
  FROM walked w CROSS JOIN bots b JOIN (SELECT DISTINCT site, bot, path, line FROM access WHERE line <> 0) a USING (site, bot, path) GROUP BY w.site, b.bot, b.severity
),
ready AS (
  SELECT site, 'critical' AS severity, 'robots-txt-forbidden' AS code, site || 'robots.txt' AS url, 'HTTP 403' AS evidence FROM site_list WHERE n = 5
  UNION ALL SELECT site, 'major', 'llms-txt-missing', site || 'llms.txt', 'HTTP 404' FROM site_list WHERE n % 2 = 1
  UNION ALL SELECT site, 'major', 'page-unavailable', norm_url, coalesce(CAST(status AS VARCHAR), '') FROM facts WHERE status IS DISTINCT FROM 200
  UNION ALL SELECT site, 'minor', 'jsonld-missing', norm_url, '0 blocks' FROM facts WHERE status = 200
  UNION ALL SELECT site, 'minor', 'faq-schema-missing', site, '0 of ' || n FROM site_list
  UNION ALL SELECT site, severity, 'robots-blocks-' || lower(bot), site || 'robots.txt', bot || ': ' || CASE WHEN whole THEN 'whole site' ELSE paths END || coalesce(' by line ' || line, '') FROM closed_paths
)"""
_SHARED = FACTS + """,
retitled AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'Catalogue of ' || regexp_extract(norm_url, '^https?://([^/]+)', 1) ELSE title END AS shared FROM ok WHERE shown),
grouped AS (SELECT *, trim(regexp_replace(lower(shared), '\\s+', ' ', 'g')) AS value FROM retitled),
sized AS (SELECT *, count(*) OVER (PARTITION BY site, value) AS n FROM grouped WHERE value <> '')"""
_TOLD = FACTS + """,
told AS (SELECT *, trim(regexp_replace(lower('About ' || regexp_extract(norm_url, '^https?://([^/]+)', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE CAST(page_id AS VARCHAR) END), '\\s+', ' ', 'g')) AS value FROM ok WHERE shown),
sized AS (SELECT *, count(*) OVER (PARTITION BY site, value) AS n FROM told)"""
QUERIES = {
    "page_facts": (page_facts, f"WITH {FACTS} SELECT page_id, site, norm_url AS url, page_key, status, title, CAST(length(title) AS INTEGER) AS title_len, h1, word_count, len(hrefs) AS internal_links, CASE WHEN closed THEN 'X-Robots-Tag: noindex, nofollow' ELSE '' END AS robots_meta FROM facts"),
    "incoming_links": (incoming_links, f"WITH {FACTS} SELECT site, target_key, count(*) AS links, min(source_url) AS first_source FROM edges GROUP BY site, target_key"),
    "availability_findings": (availability_findings, f"WITH {FACTS} {_AVAILABLE}"),
    "contradiction_findings": (contradiction_findings, f"WITH {FACTS} {_CONTRADICTIONS}"),
    "duplicate_titles": (duplicate_titles, f"WITH {_SHARED} SELECT site, 'duplicate-title' AS code, norm_url AS url, CAST(n AS INTEGER) AS pages FROM sized WHERE n > 1"),
    "duplicate_members": (duplicate_members, f"WITH {_SHARED} SELECT site, 'title' AS field, md5(value) AS value, norm_url AS url, n AS pages FROM sized WHERE n > 1"),
    "duplicate_descriptions": (duplicate_descriptions, f"WITH {_TOLD} SELECT site, 'duplicate-description' AS code, norm_url AS url, CAST(n AS INTEGER) AS pages FROM sized WHERE n > 1"),
    "page_rules": (page_rules, f"WITH {FACTS}, {_RULE_ROWS} SELECT * FROM rule_rows"),
    "orphan_pages": (orphan_pages, f"WITH {FACTS} SELECT site, code, url FROM ({_ORPHANS})"),
    "links_to_check": (links_to_check, f"WITH {FACTS}, missing AS (SELECT site, target_key, min(source_url) AS source_url FROM (SELECT site, norm_url AS source_url, regexp_extract(url, '^(https?://[^/]+)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target_key FROM (SELECT *, unnest(hrefs) AS href FROM facts)) e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.site = e.site AND f.page_key = e.target_key) GROUP BY site, target_key) SELECT site, CAST(n AS INTEGER) AS n, source_url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY source_url) AS n FROM missing) WHERE n <= 20"),
    "audit_summary": (audit_summary, f"WITH {FACTS}, {_RULE_ROWS}, {_EVERY} SELECT site, severity, code, count(*) AS findings, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END AS severity_rank FROM every GROUP BY site, severity, code"),
    "audit_totals": (audit_totals, f"WITH {FACTS}, {_RULE_ROWS}, {_EVERY} SELECT site, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM every GROUP BY site"),
    "robots_rules": (robots_rules, f"WITH {SITES} SELECT site, 1 AS group_no, 'disallow' AS kind, '/' AS path, 3 AS line_no, '*' AS agents FROM site_list WHERE n % 3 = 0 UNION ALL SELECT site, v.* FROM site_list, (VALUES (1, 'disallow', '/en/', 3, 'gptbot,claudebot'), (1, 'allow', '/', 4, 'gptbot,claudebot'), (2, 'allow', '/en/', 7, '*'), (2, 'disallow', '/e', 8, '*')) v WHERE n % 3 = 1 UNION ALL SELECT site, 2, 'disallow', '', 6, '*' FROM site_list WHERE n % 3 = 2"),
    "bot_access": (bot_access, f"WITH {SITES} SELECT site, bot, role, severity, count(*) FILTER (line <> 0) = 0 AS allowed, bool_or(line <> 0 AND path = '/') AS whole_site, count(*) FILTER (line <> 0) AS blocked, max(nullif(line, 0)) FILTER (line > 0) AS line_no FROM access GROUP BY site, bot, role, severity"),
    "sitemap_urls": (sitemap_urls, f"WITH {MAPS} SELECT site, loc AS url, url AS map_url FROM opened WHERE NOT is_index AND NOT refused"),
    "sitemap_findings": (sitemap_findings, f"WITH {MAPS} SELECT site, 'major' AS severity, 'sitemap-too-large' AS code, url, 'dtd declared' AS evidence FROM opened WHERE refused UNION ALL SELECT site, 'minor', 'sitemap-foreign-host', 'https://elsewhere.test/' || page_id || '.xml', 'another domain, not read' FROM crawl WHERE page_id % 5 = 0"),
    "llms_txt_findings": (llms_txt_findings, f"WITH {LLMS} SELECT site, severity, code, md5(evidence) AS evidence FROM found"),
    "ai_page_facts": (ai_page_facts, f"WITH {B.CRAWL} SELECT norm_url AS url, CASE WHEN page_id % 4 < 2 THEN 1 ELSE 0 END AS jsonld_blocks, CASE WHEN page_id % 4 = 0 THEN 'Corporation,FAQPage,Organization' ELSE '' END AS types, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS errors, CASE WHEN page_id % 4 = 2 THEN 'FAQPage' ELSE '' END AS micro, page_id % 4 IN (0, 2) AS faq, CASE WHEN page_id % 4 = 1 THEN 'page.md' ELSE '' END AS markdown FROM crawl"),
    "ai_readiness": (ai_readiness, f"WITH {FACTS}{READY} SELECT site, severity, code, url, CASE WHEN code = 'page-unavailable' THEN '' ELSE evidence END AS evidence, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END AS severity_rank FROM ready"),
}
