"""AI answers: order lines as provider payloads, parsed and resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import visibility as V
from ..session import checkpointed
from ..sources import answers as AN

DOMAIN = "nation-3.example"
REDIRECT = "https://vertexaisearch.cloud.google.com/r/"


def raw_answers(spark, sf):
    """One payload per order with lines, in the shape of one of five providers.

    Lines are the sources; an order has at most seven line slots.
    """
    src = B.page_lines(spark, sf, "nation")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = src.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("position", "url", "title", "domain", "used", "is_wizard"))).alias("s"))
    orders = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), "o_orderpriority")
    rows = rows.join(orders, "snapshot_id").join(B.snapshots(spark, sf).select("snapshot_id", "query", "fetched_at", "error"), "snapshot_id")
    link = lambda x: F.concat(F.lit('"url": "'), x["url"], F.lit('", "title": "'), x["title"], F.lit('"'))
    joined = lambda parts: F.array_join(parts, ", ")
    key = F.col("snapshot_id")
    words = F.concat(F.lit("Answer "), key.cast("string"), F.when(key % 5 == 0, F.lit(" see Nation-3.example")).otherwise(""), F.when(key % 2 == 0, F.lit(" [1] and [web:3]")).otherwise(""))
    yandex = F.concat(
        F.lit('[{"message": {"content": "old"}}, {"message": {"content": "'), words, F.lit('"}, "isAnswerRejected": '), F.when(key % 7 == 0, "true").otherwise("false"), F.lit(', "sources": ['),
        joined(F.transform("s", lambda x: F.concat(F.lit("{"), link(x), F.when(x["is_wizard"], "").otherwise(F.concat(F.lit(', "used": '), x["used"].cast("string"))), F.lit("}")))), F.lit("]}]"),
    )
    perplexity = F.concat(
        F.lit('{"choices": [{"message": {"content": "'), words, F.lit('"}}], "search_results": ['),
        joined(F.transform("s", lambda x, i: F.concat(F.lit('{"id": '), (i + 1).cast("string"), F.lit(", "), link(x), F.lit("}")))), F.lit("]}"),
    )
    openai = F.concat(
        F.lit('{"output": [{"type": "web_search_call", "action": {"sources": ['), joined(F.transform("s", lambda x: F.concat(F.lit("{"), link(x), F.lit("}")))),
        F.lit(']}}, {"type": "message", "content": [{"text": "'), words, F.lit('", "annotations": ['),
        joined(F.transform(F.filter("s", lambda x: x["used"]), lambda x: F.concat(F.lit('{"type": "url_citation", '), link(x), F.lit("}")))), F.lit("]}]}]}"),
    )
    chunk = lambda x: F.when(x["is_wizard"], F.concat(F.lit('{"web": {"uri": "' + REDIRECT), x["position"].cast("string"), F.lit('", "title": "'), x["domain"], F.lit('"}}'))).otherwise(
        F.concat(F.lit('{"web": {"uri": "'), x["url"], F.lit('", "title": "'), x["title"], F.lit('"}}'))
    )
    indices = F.filter(F.transform("s", lambda x, i: F.when(x["used"], i.cast("string"))), lambda v: v.isNotNull())
    gemini = F.concat(
        F.lit('{"candidates": [{"content": {"parts": [{"text": "'), words, F.lit('"}]}, "groundingMetadata": {"groundingChunks": ['), joined(F.transform("s", chunk)), F.lit("]"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "groundingSupports": [{"groundingChunkIndices": ['), joined(indices), F.lit("]}]"))), F.lit("}}]}"),
    )
    anthropic = F.concat(
        F.lit('{"content": [{"type": "web_search_tool_result", "content": ['),
        joined(F.transform(F.filter("s", lambda x: ~x["is_wizard"]), lambda x: F.concat(F.lit('{"type": "web_search_result", '), link(x), F.lit("}")))),
        F.lit(']}, {"type": "text", "text": "'), words, F.lit('", "citations": ['),
        joined(F.transform(F.filter("s", lambda x: x["used"]), lambda x: F.concat(F.lit('{"type": "web_search_result_location", '), link(x), F.lit("}")))), F.lit("]}]}"),
    )
    p = F.substring("o_orderpriority", 1, 1)
    provider = F.element_at(F.array(*[F.lit(x) for x in AN.PROVIDERS]), p.cast("int"))
    raw = F.when(p == "1", yandex).when(p == "2", perplexity).when(p == "3", openai).when(p == "4", gemini).otherwise(anthropic)
    return rows.select(F.col("snapshot_id").alias("id"), "query", provider.alias("provider"), F.lit(DOMAIN).alias("domain"), F.col("fetched_at").alias("checked_at"), "error", raw.alias("raw"))


ANSWERS = B.docs_cte("nation") + f""",
lines_of AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.snapshot_id ORDER BY position) AS i, CAST(o_orderpriority[1] AS INTEGER) AS p
  FROM page_lines p JOIN orders ON o_orderkey = p.snapshot_id
),
listed AS (
  SELECT snapshot_id, i AS o, url, title, CAST(NULL AS VARCHAR) AS hint, CASE WHEN p = 1 THEN used AND NOT is_wizard WHEN snapshot_id % 2 = 0 THEN i IN (1, 3) END AS used FROM lines_of WHERE p IN (1, 2)
  UNION ALL
  SELECT snapshot_id, CASE WHEN used THEN i ELSE 100 + i END, url, title, NULL, used FROM lines_of l WHERE p = 3 AND (used OR NOT EXISTS (SELECT 1 FROM lines_of m WHERE m.snapshot_id = l.snapshot_id AND m.used AND m.url = l.url))
  UNION ALL
  SELECT snapshot_id, i, CASE WHEN is_wizard THEN '{REDIRECT}' || position ELSE url END, CASE WHEN is_wizard THEN domain ELSE title END, CASE WHEN is_wizard THEN domain END, CASE WHEN snapshot_id % 3 > 0 THEN used END FROM lines_of WHERE p = 4
  UNION ALL
  SELECT snapshot_id, i, url, title, NULL, EXISTS (SELECT 1 FROM lines_of m WHERE m.snapshot_id = l.snapshot_id AND m.used AND m.url = l.url) FROM lines_of l WHERE p = 5 AND NOT is_wizard
  UNION ALL
  SELECT snapshot_id, 100 + i, url, title, NULL, true FROM lines_of l WHERE p = 5 AND used AND NOT EXISTS (SELECT 1 FROM lines_of m WHERE m.snapshot_id = l.snapshot_id AND NOT m.is_wizard AND m.url = l.url)
),
sourced AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY o) AS n FROM listed),
asked AS (
  SELECT s.snapshot_id AS id, s.query, ['yandex', 'perplexity', 'openai', 'gemini', 'anthropic'][CAST(o_orderpriority[1] AS INTEGER)] AS provider, s.fetched_at AS checked_at, s.error,
         'Answer ' || s.snapshot_id || CASE WHEN s.snapshot_id % 5 = 0 THEN ' see Nation-3.example' ELSE '' END || CASE WHEN s.snapshot_id % 2 = 0 THEN ' [1] and [web:3]' ELSE '' END AS text,
         o_orderpriority[1] = '1' AND s.snapshot_id % 7 = 0 AS rejected
  FROM snapshots s JOIN orders ON o_orderkey = s.snapshot_id WHERE s.snapshot_id IN (SELECT snapshot_id FROM page_lines)
),
folded AS (
  SELECT snapshot_id AS id, url, hint, min(n) AS n, arg_min(used, n) AS first_used, coalesce(bool_or(used), false) AS any_used FROM sourced GROUP BY snapshot_id, url, hint
),
placed AS (
  SELECT id, url, coalesce(hint, regexp_extract(url, '^https://([^/]+)', 1)) AS domain, CASE WHEN any_used THEN true ELSE first_used END AS used,
         CAST(row_number() OVER (PARTITION BY id ORDER BY n) AS INTEGER) AS position
  FROM folded
),
checks AS (
  SELECT a.*, '{DOMAIN}' AS domain, s.position IS NOT NULL AS cited, s.url AS cited_url, s.position AS cited_position,
         EXISTS (SELECT 1 FROM placed p WHERE p.id = a.id AND p.domain = '{DOMAIN}') AS in_sources, contains(lower(a.text), '{DOMAIN}') AS mentioned,
         (SELECT count(*) FROM placed p WHERE p.id = a.id) AS sources_count, (SELECT count(*) FROM placed p WHERE p.id = a.id AND used IS DISTINCT FROM false) AS used_count
  FROM asked a LEFT JOIN (SELECT id, min(position) AS position, arg_min(url, position) AS url FROM placed WHERE domain = '{DOMAIN}' AND used IS DISTINCT FROM false GROUP BY id) s ON s.id = a.id
),
rivals AS (
  SELECT * FROM (SELECT id, domain AS rival, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(position)) AS place
    FROM (SELECT p.*, CASE WHEN starts_with(domain, 'vertex') THEN 'google.com' ELSE domain END AS d FROM placed p) WHERE used IS DISTINCT FROM false AND domain <> '{DOMAIN}' GROUP BY id, domain) WHERE place <= 3
)"""


def _answers(spark, sf):
    return AN.ai_answers_from_json(raw_answers(spark, sf))


def _resolved(spark, sf):
    return V.rival_domains(V.resolve_citations(_answers(spark, sf), DOMAIN))


def ai_answers(spark, sf):
    flat = F.transform("sources", lambda s: F.concat_ws("|", s["url"], s["title"], F.coalesce(s["used"].cast("string"), F.lit("-")), F.coalesce(s["hint"], F.lit("-"))))
    return _answers(spark, sf).select("id", "provider", "text", "rejected", F.md5(F.array_join(flat, ";")).alias("sources"))


def ai_citations(spark, sf):
    r = V.resolve_citations(_answers(spark, sf), DOMAIN)
    return r.select("id", "provider", "query", "cited", "cited_url", "cited_position", "in_sources", "mentioned", F.col("sources_count").cast("bigint").alias("sources_count"), F.col("used_count").cast("bigint").alias("used_count"))


def ai_citations_by_column(spark, sf):
    """The same with the domain taken from each row."""
    r = V.resolve_citations(_answers(spark, sf))
    return r.select("id", "cited", "cited_url", "in_sources", "mentioned")


def rival_domains(spark, sf):
    return _resolved(spark, sf).select("id", F.posexplode("rivals").alias("i", "r")).select("id", (F.col("i") + 1).alias("place"), F.col("r.domain").alias("rival"), F.col("r.count").cast("bigint").alias("n"))


def _checks(spark, sf):
    return _resolved(spark, sf).withColumn("rivals", F.transform("rivals", lambda r: r["domain"]))


def citation_share(spark, sf):
    out = V.citation_share(checkpointed(_checks(spark, sf).drop("sources", "text")))
    return out.withColumns({"rivals": F.coalesce(F.array_join("rivals", ","), F.lit("")), "last_run": F.date_format("last_run", "yyyy-MM-dd")})


def visibility_history(spark, sf):
    rows = V.visibility_history(_checks(spark, sf), domain=DOMAIN, query="BUILDING nation_3", limit=40)
    return rows.select("id", "provider", "cited", "in_sources", "mentioned", "cited_url", "error", F.date_format("checked_at", "yyyy-MM-dd").alias("checked_at"))


def visibility_table(spark, sf):
    return V.visibility_table(_checks(spark, sf)).groupBy("provider", "verdict", "named_in_text").agg(F.count(F.lit(1)).alias("answers"))


def visibility_totals(spark, sf):
    return V.visibility_totals(_checks(spark, sf))


QUERIES = {
    "ai_answers": (ai_answers, f"WITH {ANSWERS}, flat AS (SELECT snapshot_id, string_agg(url || '|' || title || '|' || coalesce(CAST(used AS VARCHAR), '-') || '|' || coalesce(hint, '-'), ';' ORDER BY n) AS s FROM sourced GROUP BY snapshot_id) SELECT id, provider, text, rejected, md5(coalesce(s, '')) AS sources FROM asked LEFT JOIN flat ON snapshot_id = id"),
    "ai_citations": (ai_citations, f"WITH {ANSWERS} SELECT id, provider, query, cited, cited_url, cited_position, in_sources, mentioned, sources_count, used_count FROM checks"),
    "ai_citations_by_column": (ai_citations_by_column, f"WITH {ANSWERS} SELECT id, cited, cited_url, in_sources, mentioned FROM checks"),
    "rival_domains": (rival_domains, f"WITH {ANSWERS} SELECT id, CAST(place AS INTEGER) AS place, rival, n FROM rivals"),
    "citation_share": (citation_share, f"WITH {ANSWERS}, totals AS (SELECT query, provider, count(*) AS runs, count(error) AS errors, count(*) FILTER (error IS NULL AND cited) AS cited, max(checked_at) AS last_run FROM checks GROUP BY ALL), counted AS (SELECT c.query, c.provider, r.rival, count(*) AS n, max((c.checked_at, c.id, -r.place)) AS seen FROM checks c JOIN rivals r ON r.id = c.id WHERE c.error IS NULL GROUP BY ALL), best AS (SELECT query, provider, string_agg(rival, ',' ORDER BY k) AS rivals FROM (SELECT *, row_number() OVER (PARTITION BY query, provider ORDER BY n DESC, seen DESC, rival) AS k FROM counted) WHERE k <= 3 GROUP BY ALL) SELECT t.query, t.provider, runs, errors, cited, strftime(last_run, '%Y-%m-%d') AS last_run, CAST(round_even(100.0 * cited / nullif(runs - errors, 0), 0) AS INTEGER) AS share, coalesce(rivals, '') AS rivals FROM totals t LEFT JOIN best b ON b.query = t.query AND b.provider = t.provider"),
    "visibility_history": (visibility_history, f"WITH {ANSWERS} SELECT id, provider, cited, in_sources, mentioned, cited_url, error, strftime(checked_at, '%Y-%m-%d') AS checked_at FROM checks WHERE query = 'BUILDING nation_3' ORDER BY checks.checked_at DESC, id DESC LIMIT 40"),
    "visibility_table": (visibility_table, f"WITH {ANSWERS} SELECT provider, CASE WHEN error IS NOT NULL THEN 'error' WHEN cited THEN 'cited' WHEN in_sources THEN 'in_sources' ELSE 'no' END AS verdict, mentioned AND NOT cited AS named_in_text, count(*) AS answers FROM checks GROUP BY ALL"),
    "visibility_totals": (visibility_totals, f"WITH {ANSWERS} SELECT count(*) FILTER (error IS NULL) AS answers, count(*) FILTER (error IS NULL AND cited) AS cited, count(error) AS errors FROM checks"),
}
