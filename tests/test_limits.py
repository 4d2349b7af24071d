"""What a limit or a shortcut must not lose: depth, late deliveries, closed keys, spellings, first loads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from visilake.functions import keys as K
from visilake.functions import lists as L
from visilake.operators import articles as A
from visilake.operators import audit as AU
from visilake.operators import core as C
from visilake.operators import serp as S
from visilake.operators import visibility as V
from visilake.plans import actions as P
from visilake.sinks import warehouse as WH
from visilake.sources import demand as DM
from visilake.sources import serp as SP
from visilake.sources import sitefiles as SF


def test_region_tree_of_any_depth_keeps_its_keys(spark):
    node = {"id": "15", "label": "L15"}
    for i in range(14, 0, -1):
        node = {"id": str(i), "label": f"L{i}", "children": [node]}
    raw = spark.createDataFrame([("a", json.dumps({"regions": [node]})), ("b", json.dumps({"regions": []})), ("c", '{"_error": "quota"}')], "seed string, response string")
    rows = DM.flatten_region_tree(raw).collect()
    assert sorted((r["seed"], int(r["id"]), r["label"], r["level"]) for r in rows) == [("a", i, f"L{i}", i) for i in range(1, 16)]


def test_sitemaps_beyond_three_levels_and_fifty_files(spark):
    url = "https://a.example/{}.xml".format
    index = lambda *to: ("<sitemapindex>" + "".join(f"<sitemap><loc>{t}</loc></sitemap>" for t in to) + "</sitemapindex>").encode()
    files = [(url(i), index(url(i + 1), url(0))) for i in range(6)] + [(url(6), index(*[url(f"p{i}") for i in range(80)]))]
    files += [(url(f"p{i}"), f"<urlset><url><loc>https://a.example/{i}</loc></url></urlset>".encode()) for i in range(80)]
    maps = spark.createDataFrame([("https://a.example/", u, b) for u, b in files], "site string, url string, body binary")
    reached = SF.expand_sitemaps(maps.where(F.col("url") == url(0)).select("site", "url"), SF.parse_sitemaps(maps).cache())
    assert reached.count() == 87 and SF.sitemap_urls(reached).count() == 80
    assert reached.agg(F.max("depth")).first()[0] == 7


def test_a_map_that_breaks_off_keeps_what_was_read(spark):
    body = ("<urlset>" + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(20)) + "</urlset>").encode()
    maps = spark.createDataFrame([("s", "u", body)], "site string, url string, body binary")
    row = SF.parse_sitemaps(maps, max_nodes=21).first()
    assert row["error"] == "more than 21 nodes" and len(row["locs"]) == 10
    assert len(SF.parse_sitemaps(maps).first()["locs"]) == 20


def test_gap_is_whole_and_a_limit_cuts_its_end(spark):
    day = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(i, f"q{i:04d}", 1, day, None, "their.example", 1 + i % 40) for i in range(700)] + [(i, f"q{i:04d}", 1, day, None, "our.example", 3) for i in range(0, 700, 2)],
                                 "snapshot_id long, query string, region int, fetched_at timestamp, error string, domain string, position int")
    whole = S.competitor_gap(docs, "our.example", "their.example")
    assert whole.count() == 700 and whole.where("ahead = 'missing'").count() == 350
    assert {r["ahead"] for r in S.competitor_gap(docs, "our.example", "their.example", limit=350).collect()} == {"missing"}
    assert S.domain_queries(docs, "their.example").count() == 700


def test_depth_is_the_asked_one(spark):
    assert [SP.pages_for(n) for n in (1, 10, 11, 100)] == [1, 1, 2, 10]


def test_a_later_good_delivery_wins(spark):
    page = SP.PAGE_DOC
    doc = lambda url: {f.name: None for f in page.fields} | {"url": url, "domain": "a.example", "is_wizard": False, "title": "t", "title_hlwords": 0}
    rows = [
        (1, "q", 1, 0, dt.datetime(2024, 1, 1), None, 5, [doc("https://a.example/jan")]), (1, "q", 1, 0, dt.datetime(2024, 2, 1), None, 9, [doc("https://a.example/feb")]),
        (1, "q", 1, 0, dt.datetime(2024, 3, 1), "timeout", None, None), (1, "q", 1, 1, dt.datetime(2024, 2, 1), None, 9, [doc("https://a.example/two")]),
    ]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("fetch_id", T.LongType()), T.StructField("query", T.StringType()), T.StructField("region", T.IntegerType()), T.StructField("page_no", T.IntegerType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("error", T.StringType()), T.StructField("found_all", T.LongType()), T.StructField("docs", T.ArrayType(page))])
    merged = SP.merge_serp_pages(spark.createDataFrame(rows, schema), 20).first()
    assert merged["error"] is None and [d["url"] for d in merged["docs"]] == ["https://a.example/feb", "https://a.example/two"]


def test_sync_limit_caps_additions_only(spark):
    latest = spark.createDataFrame([("h", f"phrase {i:03d}", 1000 - i, i) for i in range(80)], "host_id string, query string, shows long, clicks long")
    tracked = spark.createDataFrame([("h", "phrase 070"), ("h", "gone")], "host_id string, query string")
    core = spark.createDataFrame([], "host_id string, phrase string, verdict string")
    pages = spark.createDataFrame([], "host_id string, query string, url string")
    out = {r["query"]: (r["action"], r["reason"], r["shows"]) for r in C.sync_pool(latest, tracked, core, pages, C.Niche(), min_shows=1, limit=60).collect()}
    assert out["phrase 070"] == ("keep", "shown_and_tracked", 930) and out["gone"] == ("retire", "no_shows", 0)
    assert out["phrase 059"][0] == "add" and out["phrase 060"] == ("skip", "over_limit", 940)


def _pages(spark, rows):
    base = spark.createDataFrame(rows, "site string, url string, page_key string, status int, robots_meta string, title string")
    empty = F.array().cast("array<string>")
    return base.withColumns({"internal_links": empty, "error": F.lit(None).cast("string"), "redirect_chain": empty, "description": F.lit(""), "canonical": F.lit("")})


def test_a_closed_key_closes_all_its_addresses(spark):
    s = "https://a.example"
    pages = _pages(spark, [(s, s + "/a", s + "/a", 200, "noindex", "T"), (s, s + "/a/", s + "/a", 200, "", "T"), (s, s + "/b", s + "/b", 200, "", "T"), (s, s + "/c", s + "/c", 200, "", " t ")])
    assert sorted(r["url"] for r in AU.shown_pages(pages).collect()) == [s + "/b", s + "/c"]
    members = AU.duplicate_members(pages, "title").collect()
    assert sorted((r["value"], r["url"], r["pages"]) for r in members) == [("t", s + "/b", 2), ("t", s + "/c", 2)]


def test_orphans_join_targets_counted_once(spark):
    pages = _pages(spark, [("s", "https://a.example/b", "https://a.example/b", 200, "", "T")])
    plan = AU.orphan_findings(pages)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("LeftAnti")
    assert "Aggregate" in plan[join:]


@pytest.mark.parametrize(
    "url, domain, expected",
    [
        ("https://xn--e1afmkfd.xn--p1ai/", "пример.рф", True), ("https://пример.рф/", "xn--e1afmkfd.xn--p1ai", True), ("https://blog.xn--e1afmkfd.xn--p1ai/x", "https://пример.рф", True),
        ("https://пример.рф/", "blog.пример.рф", False), ("https://example.com", "пример.рф", False), ("https://www.example.com/a", "example.com", True), ("", "пример.рф", False),
    ],
)
def test_both_spellings_of_a_host_match(spark, url, domain, expected):
    row = spark.createDataFrame([(url, domain)], "url string, domain string").select(K.domain_matches_column("url", "domain").alias("a"), K.domain_matches("url", domain).alias("b")).first()
    assert (row["a"], row["b"]) == (expected, expected)


def test_citations_in_either_spelling(spark):
    source = "array<struct<url: string, title: string, hint: string, used: boolean>>"
    rows = [(1, "пример.рф", "see xn--e1afmkfd.xn--p1ai", [("https://xn--e1afmkfd.xn--p1ai/a", "t", None, True), ("https://rival.example/", "r", None, True)])]
    answers = spark.createDataFrame(rows, f"id int, domain string, text string, sources {source}")
    out = V.rival_domains(V.resolve_citations(answers)).first()
    assert out["cited"] and out["in_sources"] and out["mentioned"] and [r["domain"] for r in out["rivals"]] == ["rival.example"]


def test_first_and_later_loads(spark, tmp_path):
    window = str(tmp_path / "windows")
    new = spark.createDataFrame([("q", "2024-01-07", 5, dt.datetime(2024, 1, 8))], "query string, date_to string, shows int, fetched_at timestamp")
    WH.save_window(spark, window, new, ["query", "date_to"])
    WH.save_window(spark, window, new.withColumn("shows", F.lit(None).cast("int")).withColumn("fetched_at", F.lit(dt.datetime(2024, 1, 9))), ["query", "date_to"])
    assert [(r["shows"], r["fetched_at"].day) for r in WH.window_store(spark, window).read("rows").collect()] == [(5, 9)]
    docs = str(tmp_path / "docs")
    make = lambda rows: spark.createDataFrame(rows, "snapshot_id long, position int, url string, fetched_at timestamp, ingested_at timestamp")
    day = lambda n: dt.datetime(2024, 1, n)
    WH.append_docs(make([(1, 1, "old", day(1), day(1)), (1, 2, "kept", day(1), day(1)), (2, 1, "other", day(2), day(2))]), docs)
    WH.append_docs(make([(1, 1, "new", day(3), day(3)), (3, 1, "third", day(3), day(3))]), docs)
    assert sorted((r["snapshot_id"], r["position"], r["url"]) for r in WH.docs_store(spark, docs).read("docs").collect()) == [(1, 1, "new"), (1, 2, "kept"), (2, 1, "other"), (3, 1, "third")]


# --- one query in two regions


DAY = dt.datetime(2024, 1, 1)


def test_a_place_in_one_region_leaves_the_gap_in_the_other(spark):
    docs = spark.createDataFrame(
        [(q, region, domain, place, f"https://{domain}/{q}", DAY) for q in ("a", "b") for region, domain, place in ((1, "we.example", 1), (1, "they.example", 2), (2, "they.example", 3))],
        "query string, region int, domain string, position int, url string, fetched_at timestamp")
    candidates = spark.createDataFrame([("s", q, r) for q in ("a", "b") for r in (1, 2)], "site string, query string, region int")
    sites = spark.createDataFrame([("s", "we.example")], "site string, domain string")
    demand = spark.createDataFrame([("s", "a", 10), ("s", "b", 20)], "site string, query_key string, freq long")
    empty = lambda schema: spark.createDataFrame([], schema)
    out = P.gap_actions(candidates, docs, sites, empty("site string, target_query string"), empty("site string, query string, shows long"), empty("site string, query_key string"), demand)
    assert sorted((r["query"], r["tie"], r["count"]) for r in out.collect()) == [("a", "a 2", 1), ("b", "b 2", 1)]


def test_one_page_in_each_region_is_no_dispute(spark):
    def serp(rows):
        own = spark.createDataFrame([("s", "q", region, url, 1, DAY) for region, url in rows], "site string, query string, region int, url string, position int, fetched_at timestamp")
        empty = lambda schema: spark.createDataFrame([], schema)
        return P.cannibalization_evidence(
            empty("site string, url string, target_query string, created_at timestamp"), empty("site string, url string, target_query string, verdict string, ranking_url string, checked_at timestamp"),
            empty("site string, query string, url string, shows long, fetched_at timestamp"), own, empty("site string, query string, n int, url string, checked_at timestamp")).count()

    assert serp([(1, "https://s/x"), (2, "https://s/y")]) == 0 and serp([(1, "https://s/x"), (1, "https://s/y")]) == 2


def test_articles_are_measured_per_region_and_run(spark):
    rows = [(1, "q", 1, "r1", 1, 5), (2, "q", 1, "r1", 2, 4), (3, "q", 2, "r1", 1, 9), (4, "q", 1, "r2", 8, 2)]
    docs = spark.createDataFrame([(i, q, region, run, dt.datetime(2024, 1, day), None, place, False, "https://e.ru/a", "e.ru") for i, q, region, run, day, place in rows],
                                 "snapshot_id long, query string, region int, run_id string, fetched_at timestamp, error string, position int, is_wizard boolean, url string, domain string")
    pairs = spark.createDataFrame([(1, "https://e.ru/a", "q")], "article_id long, url string, query string")
    every = A.measure_articles(pairs, docs)
    assert sorted((r["region"], r["position"]) for r in every.collect()) == [(1, 2), (1, 4), (2, 9)]
    one = A.measure_articles(pairs.withColumn("region", F.lit(2)), docs)
    assert [(r["region"], r["position"]) for r in one.collect()] == [(2, 9)]
    articles = spark.createDataFrame([(1, "https://e.ru/a", "q", 2), (2, "https://e.ru/b", "z", 1)], "article_id long, url string, target_query string, region int")
    report = {r["article_id"]: (r["position"], r["verdict"]) for r in A.articles_latest(articles, every.withColumn("id", F.col("snapshot_id"))).collect()}
    assert report == {1: (9, L.WORKS), 2: (None, L.NO_DATA)}


def test_the_plan_holds_every_section(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    finding = "site string, severity string, code string, url string, evidence string, measured_at timestamp"
    audit = spark.createDataFrame([("s", "critical", "redirect-chain", "https://s/x", "e", DAY), ("s", "minor", "missing-og", "https://s/a", "e", DAY)], finding)
    ready = spark.createDataFrame([("s", "critical", "robots-blocks-gptbot", "u", "whole site", DAY)], finding)
    queries = spark.createDataFrame([("s", "win", 40, 2, 5.0, DAY), ("s", "quiet", 50, 0, 2.0, DAY)], "site string, query string, shows long, clicks long, avg_show_position double, fetched_at timestamp")
    pages = spark.createDataFrame([("s", "win", "/a", DAY), ("s", "quiet", "/b", DAY)], "site string, query_key string, url string, fetched_at timestamp").withColumns({"date_from": F.lit(DAY.date()), "date_to": F.lit(DAY.date())})
    tracker = empty("site string, query string, position int, url string, checked_at timestamp")
    queries = queries.withColumns({"date_from": F.lit(DAY.date()), "date_to": F.lit(DAY.date())})
    demand = spark.createDataFrame([("s", q, 10) for q in ("gap", "hole")], "site string, query_key string, freq long")
    items = P.query_items(queries, pages, tracker, demand)
    articles = spark.createDataFrame([("s", "/c", "red door", DAY), ("s", "/d", "door red", DAY)], "site string, url string, target_query string, created_at timestamp")
    evidence = P.cannibalization_evidence(
        articles, empty("site string, url string, target_query string, verdict string, ranking_url string, checked_at timestamp"), empty("site string, query string, url string, shows long, fetched_at timestamp"),
        empty("site string, query string, region int, url string, position int, fetched_at timestamp"), empty("site string, query string, n int, url string, checked_at timestamp"))
    docs = spark.createDataFrame([(q, 1, "they.example", 1, "https://they.example/", DAY) for q in ("gap", "hole")], "query string, region int, domain string, position int, url string, fetched_at timestamp")
    candidates = spark.createDataFrame([("s", q, 1) for q in ("gap", "hole")], "site string, query string, region int")
    sites = spark.createDataFrame([("s", "we.example")], "site string, domain string")
    actions, plan = P.build_plan(sites, items, queries, evidence, candidates, docs, articles, pages, demand, audit, ready, limit=6)
    assert {r["section"] for r in actions.select("section").collect()} == set(L.SECTIONS)
    assert [r["section"] for r in plan.orderBy("place").collect()] == ["indexing", "quick_wins", "snippet", "cannibalization", "ai_search", "competitor_gaps"]
    assert {(r["section"], r["hidden"]) for r in P.hidden_counts(actions, plan).collect()} == {("competitor_gaps", 1), ("other", 1)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_articles_and_snapshots_make_is_not_dealt_again(spark):
    docs = spark.createDataFrame([(1, "q", 1, "r1", DAY, None, 2, False, "https://e.ru/a", "e.ru")], "snapshot_id long, query string, region int, run_id string, fetched_at timestamp, error string, position int, is_wizard boolean, url string, domain string")
    pairs = spark.createDataFrame([(1, "https://e.ru/a", "q")], "article_id long, url string, query string")
    plan = _plan(A.measure_articles(pairs, docs))
    first = min(plan.index(join) for join in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if join in plan)
    assert "Exchange" not in plan[:first] and "host" not in plan[first:].split("\n")[0]


def test_odd_articles_and_pages_are_measured(spark):
    rows = [("https://e.ru/a", "e.ru", 3, False), ("https://e.ru/a", "e.ru", 2, False), ("https://e.ru/b", "e.ru", 1, True), (None, "www.e.ru", 4, False), ("https://e.ru/c", "e.ru", None, False)]
    docs = spark.createDataFrame([(1, "q", 1, "r1", DAY, None, place, wizard, url, domain) for url, domain, place, wizard in rows] + [(2, "w", 1, "r1", DAY, "timeout", 1, False, "https://e.ru/a", "e.ru")],
                                 "snapshot_id long, query string, region int, run_id string, fetched_at timestamp, error string, position int, is_wizard boolean, url string, domain string")
    pairs = spark.createDataFrame([(1, "https://e.ru/a", "q"), (1, "https://e.ru/a", "q"), (2, "https://e.ru/c/", "q"), (3, None, "q"), (4, "https://e.ru/a", "w"), (5, "https://e.ru/a", None)], "article_id long, url string, query string")
    got = sorted((r["article_id"], r["position"] or 0, r["ranking_url"] or "", r["error"] or "") for r in A.measure_articles(pairs, docs).collect())
    assert got == [(1, 2, "https://e.ru/c", ""), (1, 2, "https://e.ru/c", ""), (2, 0, "https://e.ru/c", ""), (3, 0, "", ""), (4, 0, "", "timeout")]


def test_checks_are_one_state_before_they_meet_their_articles(spark):
    checks = spark.createDataFrame([(1, "q", i, DAY + dt.timedelta(i), i, i, "u", True, None) for i in range(1, 4)] + [(1, "other", 9, DAY, 9, 9, "u", True, None)],
                                   "article_id long, query string, id long, checked_at timestamp, position int, domain_position int, ranking_url string, is_target boolean, error string")
    articles = spark.createDataFrame([(1, "q"), (2, "q")], "article_id long, target_query string")
    report = A.articles_latest(articles, checks)
    assert {(r["article_id"], r["position"], r["previous"], r["measurements"]) for r in report.collect()} == {(1, 3, 2, 3), (2, None, None, 0)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftSemi"):]


def test_lines_meet_as_plain_columns(spark, tmp_path):
    from visilake import bindings as B

    tables = {
        "region": ([(1, "WEST")], "r_regionkey int, r_name string"), "nation": ([(1, "N_1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(7, 1), (None, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(3, "small ring", "T", "Brand#1", 9), (3, "small ring", "T", "Brand#1", 9)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "lineitem": ([(1, 1, 99, 7, "N", "F", DAY), (1, 2, 3, 7, "N", "F", DAY), (1, 3, 3, None, "R", "F", DAY)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = B.page_lines(spark, str(tmp_path), "nation")
    # a line of an unknown part keeps its place, a part that comes twice gives two rows
    assert [(r["position"], r["organic_position"], r["url"], r["title"]) for r in found.collect()] == [(2, 2, "https://n-1.example/brand-1/9", "small ring T")] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "https://" in plan[: plan.index("RepartitionByExpression")] and "https://" not in plan[plan.index("RepartitionByExpression"):]


def test_documents_are_numbered_once_a_snapshot(spark):
    pages = SP.serp_docs_from_xml(spark.createDataFrame([("f", 0, "q", 1, DAY, "<x/>")], "fetch_id string, page_no int, query string, region int, fetched_at timestamp, xml string"))
    plan = SP.merge_serp_pages(pages, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(") == 1


def test_page_facts_are_objects_of_few_pages_at_a_time(monkeypatch):
    import pyarrow as pa

    from visilake.sources import html as H

    alive, most, read = [0], [0], H._read

    class Facts(dict):
        def __init__(self, *a):
            super().__init__(*a)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    monkeypatch.setattr(H, "_read", lambda url, html: Facts(read(url, html)))
    n = 2 * H.PAGES + 7
    pages = [f"<title>t{i}</title><meta property='og:type' content='o{i}'><a href='/x{i}'>w</a>" if i % 5 else None for i in range(n)]
    facts = H._page_facts.func(pa.array([f"https://e.ru/{i}" for i in range(n)]), pa.array(pages, pa.string())).to_pylist()
    assert [f["title"] for f in facts] == [f"t{i}" if i % 5 else None for i in range(n)] and facts[1]["og"] == [("og:type", "o1")] and facts[1]["hrefs"] == ["https://e.ru/x1"]
    assert most[0] <= H.PAGES
