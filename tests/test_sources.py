"""Payload parsing: result pages, demand, owner data, AI answers, site files, pages."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from visilake.operators import readiness as RD
from visilake.operators import visibility as V
from visilake.sources import answers as AN
from visilake.sources import demand as DM
from visilake.sources import html as H
from visilake.sources import owner as OW
from visilake.sources import serp as SP
from visilake.sources import sitefiles as SF

AT = dt.datetime(2024, 1, 1)


def page(docs, wizard=None, found=100, start=0):
    """Result page with ``docs`` documents; index ``wizard`` is an engine block."""
    groups = "".join(
        f'<group><categ name="g{start + i}.ru"/><doccount>{i + 1}</doccount><doc><url>https://s{start + i}.ru/a/b</url>'
        + (f"<title>Картинки по запросу окна</title>" if i == wizard else f"<title>Купить <hlword>окна</hlword> в <hlword>Москве</hlword></title>")
        + "<modtime>20240101T000000</modtime><passages><passage>первый <hlword>окна</hlword></passage><passage>второй</passage></passages></doc></group>"
        for i in range(docs)
    )
    return f'<yandexsearch><response><found priority="phrase">7</found><found priority="all">{found}</found><results><grouping>{groups}</grouping></results></response></yandexsearch>'


def raw(spark, pages, fetch="f"):
    return spark.createDataFrame([(fetch, i, "окна", 225, AT, x) for i, x in pages], "fetch_id string, page_no int, query string, region int, fetched_at timestamp, xml string")


def test_pages_for():
    assert [SP.pages_for(n) for n in (5, 10, 11, 30, 50, 100, 0)] == [1, 1, 2, 3, 5, 10, 1]


def test_three_pages_number_through(spark):
    parsed = SP.serp_docs_from_xml(raw(spark, [(0, page(10)), (1, page(10, wizard=2, start=10, found=300)), (2, page(10, start=20))]))
    docs = SP.snapshot_docs(SP.merge_serp_pages(parsed, 30)).orderBy("position").collect()
    assert [d.position for d in docs] == list(range(1, 31))
    assert docs[12].is_wizard and docs[12].organic_position is None and docs[13].organic_position == 13
    assert [d.organic_position for d in docs[20:]] == list(range(20, 30))
    assert (docs[0].domain, docs[0].title_hlwords, docs[0].url_depth, docs[1].domain_doccount, docs[0].passage) == ("g0.ru", 2, 2, 2, "первый окна")
    merged = SP.merge_serp_pages(parsed, 15)
    assert merged.select("found_all", F.size("docs")).first()[:] == (300, 15)


def test_repeated_address_keeps_its_slot(spark):
    parsed = SP.serp_docs_from_xml(raw(spark, [(0, page(3)), (1, page(3, start=2))]))
    docs = SP.snapshot_docs(SP.merge_serp_pages(parsed, 20)).orderBy("position").collect()
    assert [(d.position, d.url) for d in docs] == [(1, "https://s0.ru/a/b"), (2, "https://s1.ru/a/b"), (3, "https://s2.ru/a/b"), (5, "https://s3.ru/a/b"), (6, "https://s4.ru/a/b")]


def test_bad_pages_become_error_rows(spark):
    error = '<yandexsearch><response><error code="15">Ничего не найдено</error></response></yandexsearch>'
    bomb = '<!DOCTYPE a [<!ENTITY b "c">]><yandexsearch>&b;</yandexsearch>'
    rows = {r.page_no: r for r in SP.serp_docs_from_xml(raw(spark, [(0, page(2)), (1, error), (2, bomb), (3, "<a><b></a>"), (4, None)])).collect()}
    assert rows[0].error is None and rows[1].error == "Ничего не найдено" and "dtd" in rows[2].error
    assert all(rows[i].error and rows[i].docs == [] for i in (1, 2, 3, 4))
    merged = SP.merge_serp_pages(SP.serp_docs_from_xml(raw(spark, [(0, page(2)), (1, error), (2, page(2, start=9))])), 30).first()
    assert merged.error == "page 2 of 3: Ничего не найдено" and len(merged.docs) == 2
    assert SP.flag_incomplete(SP.serp_docs_from_xml(raw(spark, [(0, page(2)), (2, page(2))])), 30).first()[3:] == (3, 2, "page 2 of 3: not collected")


def test_demand(spark):
    rows = spark.createDataFrame(
        [("a", json.dumps({"totalCount": 0, "results": [{"phrase": "a b", "count": "12"}], "associations": [{"phrase": "c", "count": None}]})), ("e", '{"_error": "quota"}'), ("s", '{"totalCount": "7"}')],
        "phrase string, response string",
    )
    assert {r.phrase: (r.freq, r.error) for r in DM.keyword_frequencies_from_json(rows).collect()} == {"a": (0, None), "e": (None, "quota"), "s": (7, None)}
    got = DM.keyword_expansions_from_json(rows.withColumnRenamed("phrase", "seed")).collect()
    assert [(r.seed, r.kind, r.phrase, r.freq) for r in got] == [("a", "top", "a b", 12), ("a", "association", "c", 0)]
    series = spark.createDataFrame([("a", '{"results": [{"date": "2024-01-01T00:00:00Z", "count": "5", "share": "bad"}, {"date": "2024-02-01", "count": 6, "share": 0.5}]}')], "phrase string, response string")
    assert [(r["count"], r.share) for r in DM.demand_dynamics(series).collect()] == [(5, None), (6, 0.5)]
    tree = spark.createDataFrame([('{"regions": [{"id": "1", "label": "A", "children": [{"id": 2, "label": "B", "children": [{"id": "3", "label": "C"}]}]}, {"id": "4", "label": "D"}]}',), ('{"_error": "x"}',)], "response string")
    assert sorted((r.id, r.label, r.level) for r in DM.flatten_region_tree(tree).collect()) == [("1", "A", 1), ("2", "B", 2), ("3", "C", 3), ("4", "D", 1)]


def test_latest_keyword_snapshot(spark, tmp_path):
    assert DM.latest_keyword_snapshot(spark, str(tmp_path)).collect() == []
    (tmp_path / "wordstat-2024-01-01.jsonl").write_text('{"seed": "old", "response": {"totalCount": 1}}\n')
    (tmp_path / "wordstat-2024-02-01.jsonl").write_text('{"seed": "окна", "response": {"totalCount": "5"}}\nмусор\n{"seed": "err", "response": {"_error": "x"}}\n\n{"seed": "окна", "response": {"totalCount": 9}}\n')
    assert [tuple(r) for r in DM.latest_keyword_snapshot(spark, str(tmp_path)).collect()] == [("окна", 9)]


def test_owner_payloads(spark):
    item = {"text_indicator": {"value": "q"}, "popular_complementary_indicator": {"value": "/p"}, "statistics": [
        {"date": "2024-01-02", "field": "IMPRESSIONS", "value": 70}, {"date": "2024-01-01", "field": "IMPRESSIONS", "value": 1},
        {"date": "2024-01-01", "field": "POSITION", "value": 50}, {"date": "2024-01-02", "field": "POSITION", "value": 5}, {"date": "2024-01-02", "field": "CLICKS", "value": 3}]}
    empty = {"text_indicator": {"value": "e"}, "statistics": []}
    rows = spark.createDataFrame([(json.dumps({"text_indicator_to_statistics": [item, empty]}),)], "response string")
    a, b = OW.query_page_stats(rows).collect()
    assert (a.query, a.url, a.shows, a.clicks, a.demand, a.avg_position, str(a.date_from), str(a.date_to)) == ("q", "/p", 71, 3, 0, 5.63, "2024-01-01", "2024-01-02")
    assert (b.shows, b.avg_position, b.date_from) == (0, None, None)
    landing = spark.createDataFrame([('{"data": [{"dimensions": [{"name": "u"}], "metrics": [3, null]}, {"dimensions": [{"name": "v"}], "metrics": []}]}',)], "response string")
    assert [(r.url, r.source, r.visits, r.bounce_rate) for r in OW.landing_page_stats(landing).collect()] == [("u", "organic", 3, None), ("v", "organic", None, None)]
    history = spark.createDataFrame([('{"history": [{"date": "2024-01-03T00", "value": 9}, {"date": "2024-01-01", "value": 4}, {"date": null, "value": 1}, {"date": "2024-01-04", "value": null}]}',), ("{}",)], "response string")
    first, second = OW.history_series(history, "in_search_url_count").collect()
    assert (first.now, first.was, first.change, first.points) == (9, 4, 5, 2) and (second.now, second.points) == (None, 0)


PAYLOADS = {
    "yandex": [{"message": {"content": "old"}}, {"message": {"content": "Окна делает example.ru"}, "sources": [{"url": "https://w.org/a", "title": "W", "used": False}, {"url": "https://www.example.ru/x", "used": True}, {"url": "https://n.ru/"}]}],
    "perplexity": {"output": [{"type": "search_results", "results": [{"id": 1, "url": "https://example.ru/1"}, {"id": 2, "url": "https://rival.ru/"}]}, {"type": "message", "content": [{"text": "See [web:1]"}]}]},
    "openai": {"output": [{"type": "web_search_call", "action": {"sources": [{"url": "https://example.ru/o"}, {"url": "https://seen.ru/"}]}}, {"type": "message", "content": [{"text": "t", "annotations": [{"type": "url_citation", "url": "https://example.ru/o"}]}]}]},
    "gemini": {"candidates": [{"content": {"parts": [{"text": "g"}]}, "groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://vertexaisearch.cloud.google.com/x", "title": "example.ru"}}, {"web": {"uri": "https://uefa.com/", "title": "UEFA news"}}], "groundingSupports": [{"groundingChunkIndices": [0, 1]}]}}]},
    "anthropic": {"content": [{"type": "web_search_tool_result", "content": [{"type": "web_search_result", "url": "https://example.ru/a"}, {"type": "web_search_result", "url": "https://b.ru"}]}, {"type": "text", "text": "A", "citations": [{"type": "web_search_result_location", "url": "https://example.ru/a"}]}]},
}


def test_ai_answers(spark):
    rows = [(i, p, "окна", json.dumps(x)) for i, (p, x) in enumerate(PAYLOADS.items())]
    rows += [(10, "perplexity", "окна", json.dumps({"choices": [{"message": {"content": "no marks"}}], "citations": ["https://example.ru/c"]})),
             (11, "anthropic", "окна", json.dumps({"content": [{"type": "web_search_tool_result", "content": {"error_code": "max_uses"}}]})), (12, "openai", "окна", "not json")]
    answers = AN.ai_answers_from_json(spark.createDataFrame(rows, "id int, provider string, query string, raw string"))
    got = {r.id: r for r in V.rival_domains(V.resolve_citations(answers, "example.ru")).collect()}
    assert [(got[i].sources_count, got[i].used_count, got[i].cited_position) for i in range(5)] == [(3, 1, 2), (2, 1, 1), (2, 1, 1), (2, 2, 1), (2, 1, 1)]
    assert got[0].mentioned and got[0].text == "Окна делает example.ru" and not got[0].rejected
    assert got[3].cited and got[3].sources[0].domain == "example.ru" and [r.domain for r in got[3].rivals] == ["uefa.com"]
    assert got[10].cited and got[10].sources[0].used is None
    assert got[11].error == "max_uses" and got[12].sources_count == 0


def test_page_facts_and_ai_facts(spark):
    body = """<html><head><title> Окна  <b>ПВХ</b></title><base href="/root/"><meta name="description" content="first"><meta name="description" content="second">
    <meta name="robots" content="noindex"><meta name="yandex" content="nofollow"><meta property="og:title" content="T"><link rel="canonical" href="self">
    <link rel="alternate" type="text/markdown" href="p.md"><script type="application/ld+json">{"@graph": [{"@type": "Organization"}, {"mainEntity": {"@type": ["FAQPage"]}}]}</script>
    <script type="application/ld+json">{oops</script><style>x y z</style></head><body itemtype="https://schema.org/WebPage"><h1><span>Два</span><span>слова</span></h1>
    <a href="a.html#x">a</a><a href="a.html">b</a><a href="#top">c</a><a href="file.pdf">d</a><a href="https://other.ru/">e</a><a href="https://xn--e1afmkfd.example.ru/">f</a>
    <img src=1><img src=2 alt=""><noscript>скрыто</noscript> Текст 25км</body></html>"""
    crawl = spark.createDataFrame(
        [("https://example.ru/", "https://Example.ru:443/p#f", 200, body, {"X-Robots-Tag": "none"}, "text/html; charset=utf-8", None), ("https://example.ru/", "https://example.ru/x", 404, "<title>No</title>", None, None, None),
         ("https://example.ru/", "https://example.ru/y", 200, "%PDF", None, "application/pdf", None), ("https://example.ru/", "https://example.ru/z", None, None, None, None, "timeout")],
        "site string, url string, status int, html string, headers map<string,string>, content_type string, error string",
    )
    facts = {r.url: r for r in H.page_facts(crawl).collect()}
    p = facts["https://example.ru/p"]
    assert (p.title, p.description, p.robots_meta, p.canonical) == ("Окна ПВХ", "first", "noindex; nofollow; X-Robots-Tag: none", "https://example.ru/root/self")
    assert (p.h1, p.og, p.images_total, p.images_no_alt) == (["Два слова"], {"og:title": "T"}, 2, 1)
    assert p.schema_types == ["Organization", "FAQPage", "WebPage"]
    assert p.internal_links == ["https://example.ru/root/a.html", "https://xn--e1afmkfd.example.ru/"] and p.external_links == ["https://other.ru/"]
    assert p.word_count == 11  # two in the heading, six link names, three in the text
    assert facts["https://example.ru/x"].title is None and facts["https://example.ru/y"].error.startswith("not HTML") and facts["https://example.ru/z"].error == "timeout"
    ai = {r.url: r for r in H.ai_page_facts(H.page_facts(crawl)).collect()}["https://example.ru/p"]
    assert (ai.jsonld_blocks, ai.jsonld_types, len(ai.jsonld_errors), ai.faq, ai.markdown_alternate) == (2, ["FAQPage", "Organization"], 1, True, "https://example.ru/root/p.md")


def test_robots_and_bots(spark):
    text = "Disallow: /no\nUser-agent: GPTBot # one\nUser-agent: Perplexity\nDisallow: /private/\n\nUser-agent: *\nAllow: /%D0%BE\nDisallow: /о\n"
    robots = spark.createDataFrame([("https://a.ru/", text, 200), ("https://b.ru/", "x", 403), ("https://c.ru/", "", 404)], "site string, text string, status int")
    rules = [(r.group_no, r.kind, r.path, r.line_no) for r in SF.robots_rules(robots.limit(1)).orderBy("line_no").collect()]
    assert rules == [(1, "disallow", "/private/", 4), (2, "allow", "/о", 7), (2, "disallow", "/о", 8)]
    paths = spark.createDataFrame([("https://a.ru/", ["/private/x", "/о-нас"])], "site string, paths array<string>")
    got = {(r.site, r.bot): r for r in RD.bot_access(robots, paths).collect()}
    assert got["https://a.ru/", "GPTBot"].blocked_paths == ["/private/x"] and got["https://a.ru/", "PerplexityBot"].line_no == 4
    assert got["https://a.ru/", "ClaudeBot"].allowed and not got["https://b.ru/", "ClaudeBot"].allowed and got["https://b.ru/", "GPTBot"].whole_site
    assert got["https://c.ru/", "GPTBot"].allowed


def test_sitemaps(spark):
    site = "https://example.ru/"
    loc = lambda *urls: "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    index = f"<sitemapindex><sitemap><loc>{site}b.xml.gz</loc></sitemap><sitemap><loc>https://other.ru/m.xml</loc></sitemap><sitemap><loc>{site}a.xml</loc></sitemap></sitemapindex>".encode()
    files = [(site, site + "a.xml", index), (site, site + "b.xml.gz", gzip.compress(f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{loc(site + "1", site + "2")}</urlset>'.encode())),
             (site, site + "bomb.xml", gzip.compress(b"\0" * (51 * 1024 * 1024))), (site, site + "html", b"<!DOCTYPE html><html></html>"), (site, site + "torn", b"<urlset><url>")]
    parsed = SF.parse_sitemaps(spark.createDataFrame(files, "site string, url string, body binary"))
    starts = parsed.select("site", "url").where(~F.col("url").endswith("gz"))
    reached = SF.expand_sitemaps(starts, parsed)
    rows = {r.url: r for r in reached.collect()}
    assert rows["https://other.ru/m.xml"].foreign and rows[site + "b.xml.gz"].depth == 1
    assert "unpacked" in rows[site + "bomb.xml"].error and rows[site + "html"].error and rows[site + "torn"].error is None
    assert sorted(r.url for r in SF.sitemap_urls(reached).collect()) == [site + "1", site + "2"]


def test_llms_txt(spark):
    texts = ["", "# S\n> about\n## A\n- [x](y)\n", "plain\n# A\n# B\n## S\n- no link\n## T\ntext", "# S\ntext\n### deep"]
    rows = spark.createDataFrame([(str(i), "u", t) for i, t in enumerate(texts)], "site string, url string, text string")
    codes = {}
    for r in SF.llms_txt_findings(rows).collect():
        codes.setdefault(r.site, set()).add(r.code.removeprefix("llms-txt-"))
    assert codes == {"0": {"empty"}, "2": {"no-h1", "many-h1", "item-without-link", "section-without-list", "no-links"}, "3": {"no-summary", "heading-before-sections", "no-sections"}}


def test_losing_deliveries_are_never_parsed(spark, monkeypatch):
    """Of deliveries of a page a good one wins over a failed one, then the later one; only those asked for are read."""
    doc = lambda u: f"<yandexsearch><response><found priority='all'>1</found><results><grouping><group><doc><url>{u}</url></doc></group></grouping></results></response></yandexsearch>"
    at = lambda n: f"2024-01-{n:02}"
    raw = [
        (1, 0, at(1), doc("old")), (1, 0, at(2), doc("new")), (1, 0, at(2), doc("new")), (1, 1, at(1), doc("one")),
        (2, 0, at(1), doc("good")), (2, 0, at(2), "<broken"), (2, 0, at(3), None), (2, 1, at(1), "x"), (2, 1, at(2), "<y"),
        (3, 0, at(1), doc("only")), (3, 7, at(1), doc("too deep")), *[(4, 0, at(n), doc(f"u{n}")) for n in range(1, 20)],
    ]
    rows = spark.createDataFrame([(*r, "q", None) for r in raw], "fetch_id int, page_no int, fetched_at string, xml string, query string, region int")
    parsed, read = [], SP.serp_docs_from_xml
    monkeypatch.setattr(SP, "serp_docs_from_xml", lambda df, col="xml": (parsed.append(df.count()), read(df, col))[1])
    pages = SP.read_deliveries(rows.repartition(3), 20)
    assert parsed == [6, 2, 1]  # six pages, two whose newest delivery failed, one that failed again
    found = {(r["fetch_id"], r["page_no"]): ([d["url"] for d in r["docs"]], r["error"] is None, r["fetched_at"]) for r in pages.collect()}
    assert found == {(1, 0): (["new"], True, at(2)), (1, 1): (["one"], True, at(1)), (2, 0): (["good"], True, at(1)), (2, 1): ([], False, at(2)), (3, 0): (["only"], True, at(1)), (4, 0): (["u19"], True, at(19))}
    merged = {r["snapshot_id"]: (r["error"] or "", [d["url"] for d in r["docs"]]) for r in SP.merge_serp_pages(pages, 20).collect()}
    plain = {r["snapshot_id"]: (r["error"] or "", [d["url"] for d in r["docs"]]) for r in SP.merge_serp_pages(read(rows), 20).collect()}
    assert merged == plain
