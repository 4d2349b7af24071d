"""Core, articles, briefs, audit, stored tables and the plan on small planted inputs."""

import datetime as dt

from pyspark.sql import functions as F

from visilake.functions import lists as L
from visilake.operators import articles as A
from visilake.operators import audit as AU
from visilake.operators import brief as BR
from visilake.operators import core as C
from visilake.operators import readiness as RD
from visilake.plans import actions as P
from visilake.sinks import warehouse as WH
from visilake.sources import html as H

D = lambda day, month=1: dt.date(2024, month, day)
T = lambda day, month=1: dt.datetime(2024, month, day)
NICHE = C.Niche(services=("остекл", "монтаж"), objects=("балкон", "лодж"), domain="https://www.oknadom.ru/", vendor="rehau", foreign_name=r"жк\s+", client_marks="забронировать")


# --- core ---------------------------------------------------------------------------------


def test_judging_ladder(spark):
    rows = [
        ("остекление", 50, "top", "Остекление ", "is_seed"), ("остекление лоджии", 5, "top", "окна", "below_min_freq"),
        ("что такое окно это", 50, "top", "окна", "noise"), ("жк легенда", 50, "top", "окна", "foreign_name"), ("Rehau цена", 50, "top", "окна", "vendor"),
        ("окна настройка", 50, "top", "окна", "setup_of_broad_seed"), ("окна настройка балкона", 50, "top", "окна", "refinement"), ("окна цена", 50, "top", "окна", "refinement"),
        ("монтаж рам", 50, "association", "окна", "niche_service"), ("балкон дизайн", 50, "association", "окна", "object_without_service"), ("двери", 50, "association", "окна", "outside_niche"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, phrase string, freq long, kind string, seed string, reason string")
    got = df.withColumn("j", C.judge_candidate("phrase", "freq", "kind", "seed", NICHE)).orderBy("i").select("j.reason").collect()
    assert [r[0] for r in got] == [r[-1] for r in rows]
    half = C.Niche(services=("остекл",))
    assert not half.defined and df.limit(1).select(C.niche_decision(F.lit("двери"), half)["reason"]).first()[0] == "dictionary_undefined"
    kinds = spark.createDataFrame([("окна дом москва",), ("остекление балкона",), ("остекление",)], "p string").select(C.classify_phrase("p", ["Окна-Дом"], NICHE))
    assert [r[0] for r in kinds.collect()] == [L.BRAND, L.TARGET, L.ADJACENT]


def test_collect_keeps_overflow_and_first_owner(spark):
    seeds = spark.createDataFrame([("окнадом", 0, True, 10), ("окна", 1, False, None)], "seed string, ord int, is_brand boolean, freq long")
    grown = [("окнадом", "top", 1, "окнадом балкон", 9), ("окнадом", "top", 2, "шины", 99), ("окна", "top", 1, " шины", 70)] + [("окна", "top", i, f"окна вид {i}", 100 - i) for i in range(2, 6)]
    core = C.collect_core(seeds, spark.createDataFrame(grown, "seed string, kind string, place int, phrase string, freq long"), ["окнадом"], NICHE, quota=2)
    got = {r.phrase: (r.kind, r.verdict, r.reason, r.over_quota, r.seed) for r in core.collect()}
    assert got["шины"] == (L.BRAND, L.DROP, "brand_ambiguous", False, "окнадом")
    assert got["окнадом балкон"] == (L.BRAND, L.EDGE, "brand_qualified", False, "окнадом")
    assert [got[f"окна вид {i}"][1:4] for i in range(2, 6)] == [(L.EDGE, "refinement", False)] * 2 + [(L.DROP, "refinement", True)] * 2


def test_word_forms_fold_only_with_one_demand(spark):
    rows = [("сквозная аналитика", 10, "expansion", L.EDGE, "a"), ("сквозные аналитики", 10, "expansion", L.CORE, "b"), ("сквозной аналитики", None, "expansion", L.DROP, "c"),
            ("0 7", 5, "expansion", L.EDGE, "d"), ("0.7", 6, "expansion", L.EDGE, "e"), ("окна", 1, "seed", L.EDGE, "f")]
    core = spark.createDataFrame(rows, "phrase string, freq long, source string, verdict string, reason string").withColumns(
        {"competition": F.lit(1.5), "our_position": F.lit(3), "top_domains": F.array(F.lit("x")), "commercial": F.lit(True)}
    )
    got = {r.phrase: (r.form_state, r.verdict, r.reason, r.keeper) for r in C.dedup_forms(core).collect()}
    assert got["сквозная аналитика"] == ("collapsed", L.CORE, "b", "сквозная аналитика")
    assert got["сквозные аналитики"] == ("form_of", L.DROP, "form_of", "сквозная аналитика") == got["сквозной аналитики"]
    assert got["0 7"][0] == got["0.7"][0] == "differing_forms" and got["окна"][0] == "single"


def test_rejudge_spares_measured_rows(spark):
    rows = [("остекление балкона", "adjacent", L.DROP, "outside_niche", None, None), ("остекление лоджий", "adjacent", L.EDGE, "commercial_top", 40.0, None),
            ("шторы", "brand", L.DROP, "brand_ambiguous", None, None), ("монтаж балкона", "brand", L.DROP, "brand_ambiguous", None, None), ("двери", "target", L.EDGE, "refinement", None, None)]
    core = spark.createDataFrame(rows, "phrase string, kind string, verdict string, reason string, competition double, our_position int").withColumn("top_domains", F.array().cast("array<string>"))
    got = {r.phrase: r for r in C.rejudge_core(core, ["окнадом"], NICHE).collect()}
    assert (got["остекление балкона"].new_kind, got["остекление балкона"].new_verdict) == (L.TARGET, L.EDGE)
    assert got["остекление лоджий"].new_verdict == L.EDGE and got["остекление лоджий"].needs_review
    assert got["шторы"].new_kind == L.BRAND and not got["шторы"].kind_changed
    assert got["монтаж балкона"].brand_lost and got["монтаж балкона"].new_verdict == L.EDGE
    assert (got["двери"].new_kind, got["двери"].new_verdict) == (L.ADJACENT, L.EDGE)


def test_verdicts_from_results(spark):
    docs = [("остекление балкона", False, 1, 1, False, "a.ru", "Монтаж балконов"), ("остекление балкона", False, 2, 2, False, "ru.wikipedia.org", "Балкон"), ("остекление балкона", False, 3, None, True, "yandex.ru", "Видео"),
            ("остекление лоджии", False, 1, 1, False, "blog.x.ru", "Что такое лоджия"), ("окнадом", True, 1, 1, False, "b.ru", "Двери")]
    docs = spark.createDataFrame(docs, "phrase string, niche_only boolean, position int, organic_position int, is_wizard boolean, domain string, title string").withColumns({"passage": F.lit(None).cast("string"), "snapshot_id": F.lit(2).cast("long"), "fetched_at": F.lit(T(2))})
    older = docs.withColumns({"snapshot_id": F.lit(1).cast("long"), "fetched_at": F.lit(T(1)), "title": F.lit("Монтаж балконов")})
    docs = docs.unionByName(older)
    profile = C.domain_profile(docs, NICHE)
    p = {r.phrase: (r.docs, r.specialized, r.educational) for r in profile.collect()}
    assert p == {"остекление балкона": (2, 2, 1), "остекление лоджии": (1, 1, 1), "окнадом": (1, 0, 0)}
    core = spark.createDataFrame([("остекление балкона", L.TARGET), ("остекление лоджии", L.TARGET), ("окнадом", L.BRAND), ("контакты остекление балкона", L.TARGET)], "phrase string, kind string").withColumns(
        {"verdict": F.lit(L.EDGE), "reason": F.lit("seed"), "commercial": F.lit(None).cast("boolean"), "competition": F.lit(None).cast("double"), "our_position": F.lit(None).cast("int"), "top_domains": F.array().cast("array<string>")}
    )
    scores = core.select("phrase", F.lit(10.0).alias("competition"), F.lit(None).cast("int").alias("our_position"), F.lit(None).cast("string").alias("error"))
    got = {r.phrase: (r.kind, r.verdict, r.reason) for r in C.core_verdict(core, profile, scores, NICHE).collect()}
    assert got == {"остекление балкона": (L.TARGET, L.CORE, "commercial_top"), "остекление лоджии": (L.ADJACENT, L.EDGE, "educational_top"),
                   "окнадом": (L.BRAND, L.EDGE, "brand_ambiguous"), "контакты остекление балкона": (L.TARGET, L.EDGE, "no_usable_documents")}


# --- stored tables --------------------------------------------------------------------------

WINDOW = "host_id string, query string, date_from date, date_to date, shows long, clicks long, fetched_at timestamp"


def test_load_windows_are_never_mixed(spark):
    long, short = (D(1), D(28)), (D(22), D(28))
    rows = [("h", "a", *long, 100, 1, T(29)), ("h", "b", *long, 50, 1, T(29)), ("h", "a", *short, 20, 1, T(30)), ("h", "b", *short, 7, 1, T(30)), ("g", "a", *long, 5, 0, T(29)), ("g", "a", *short, 3, 0, T(29))]
    got = {r.host_id: (str(r.date_from), r.queries, r.shows) for r in WH.window_totals(spark.createDataFrame(rows, WINDOW)).collect()}
    assert got == {"h": ("2024-01-22", 2, 27), "g": ("2024-01-01", 1, 5)}


def test_upsert_keeps_measured_values_and_rewrites_touched_partitions(spark, tmp_path):
    base = spark.createDataFrame([("h", "a", D(1), D(28), 10, 2, T(1, 2)), ("h", "b", D(1), D(28), 5, 0, T(1, 2)), ("h", "a", D(1), D(7), 1, 1, T(8))], WINDOW)
    new = spark.createDataFrame([("h", "a", D(1), D(28), None, 3, T(2, 2)), ("h", "c", D(1), D(28), 9, 9, T(2, 2))], WINDOW)
    keys = ["host_id", "query", "date_from", "date_to"]
    path = str(tmp_path / "t")
    WH.save_window(spark, path, base, keys)
    WH.save_window(spark, path, new, keys)
    rows = sorted((r.query, str(r.date_to), r.shows, r.clicks) for r in WH.window_store(spark, path).read("rows").collect())
    assert rows == [("a", "2024-01-07", 1, 1), ("a", "2024-01-28", 10, 3), ("b", "2024-01-28", 5, 0), ("c", "2024-01-28", 9, 9)]
    docs = spark.createDataFrame([(1, 1, "old", T(1), T(1)), (1, 1, "new", T(1), T(2)), (1, 2, "x", T(1), T(1))], "snapshot_id long, position int, url string, fetched_at timestamp, ingested_at timestamp")
    WH.append_docs(docs, str(tmp_path / "d"))
    WH.append_docs(docs.limit(0), str(tmp_path / "d"))
    assert sorted(r.url for r in WH.docs_store(spark, str(tmp_path / "d")).read("docs").collect()) == ["new", "x"]


def test_core_upsert_guards_verdicts(spark):
    schema = "project_id long, phrase string, kind string, freq long, source string, commercial boolean, competition double, our_position int, top_domains array<string>, verdict string, reason string, collected_at timestamp"
    row = lambda phrase, verdict, competition=None, domains=(): (1, phrase, "target", 1, "s", None, competition, None, list(domains), verdict, "r", T(1))
    base = spark.createDataFrame([row("a", L.CORE, 50.0, ["x"]), row("b", L.CORE, 50.0), row("c", L.CORE), row("d", L.EDGE)], schema)
    new = spark.createDataFrame([row("a", L.EDGE), row("b", L.DROP), row("c", L.EDGE, 10.0), row("e", L.EDGE)], schema)
    got = {r.phrase: (r.verdict, r.competition, r.top_domains) for r in WH.upsert_core(base, new).collect()}
    assert got == {"a": (L.CORE, 50.0, ["x"]), "b": (L.DROP, 50.0, []), "c": (L.EDGE, 10.0, []), "d": (L.EDGE, None, []), "e": (L.EDGE, None, [])}


# --- articles and briefs --------------------------------------------------------------------


def test_article_places_and_verdicts(spark):
    docs = [(1, "q", 1, True, "https://yandex.ru/", "yandex.ru"), (1, "q", 2, False, "https://www.e.ru/other/", "e.ru"), (1, "q", 3, False, "https://e.ru/blog/%D0%BE/?x=1", "e.ru"), (2, "w", 12, False, "https://e.ru/blog/о", "e.ru"), (3, "z", 1, False, "https://f.ru/", "f.ru")]
    docs = spark.createDataFrame(docs, "snapshot_id long, query string, position int, is_wizard boolean, url string, domain string").withColumns({"region": F.lit(1), "fetched_at": F.lit(T(1)), "error": F.lit(None).cast("string"), "run_id": F.lit("r")})
    articles = spark.createDataFrame([(1, "http://www.e.ru/blog/о/", " q ", ["w", "q", "", "z"])], "article_id long, url string, target_query string, extra_queries array<string>")
    rows = A.measure_articles(A.article_queries(articles), docs).withColumn("verdict", A.article_verdict())
    got = {r["query"]: (r.position, r.domain_position, r.is_target, r.verdict) for r in rows.collect()}
    assert got == {"q": (3, 2, False, L.WORKS), "w": (12, 12, True, L.COMING), "z": (None, None, False, L.MISSING)}
    verdicts = spark.createDataFrame([(15, 4), (None, 4), (15, 15), (31, None), (31, 31), (10, 2)], "position int, domain_position int").select(A.article_verdict())
    assert [r[0] for r in verdicts.collect()] == [L.REPLACED, L.REPLACED, L.COMING, L.MISSING, L.MISSING, L.WORKS]


def test_taken_queries(spark):
    report = spark.createDataFrame([("https://e.ru/a", "остекление балкона", "https://e.ru/b", 3)], "url string, target_query string, ranking_url string, domain_position int")
    work = spark.createDataFrame([("m1", "монтаж окна")], "art_id string, topic string")
    asked = spark.createDataFrame([("остекления балконов", None), ("монтаж окон", None), ("монтаж окна", "m1"), ("двери", None)], "query string, exclude_id string")
    got = {r["query"]: (r.verdict, r.reasons) for r in A.query_is_taken(asked, report, work).collect()}
    assert got["остекления балконов"] == ("taken", ["claimed", "ranking"]) and got["монтаж окна"] == ("free", []) and got["двери"] == ("free", [])


def test_brief_gaps_and_advice(spark):
    docs = spark.createDataFrame(
        [(1, "окна", i, f"vk{i}.ru", f"Как купить окна {'кейс' if i == 1 else ''}", "https://x/", 0, 0, 5, "20200101T000000") for i in range(1, 5)],
        "snapshot_id long, query string, organic_position int, domain string, title string, url string, title_hlwords int, url_depth int, domain_doccount long, modtime string",
    ).withColumns({"position": F.col("organic_position"), "is_wizard": F.lit(False), "region": F.lit(1), "error": F.lit(None).cast("string"), "passage": F.lit(None).cast("string")})
    related = BR.related_queries(spark.createDataFrame([("окна", "association", 0, "двери", 900), ("окна", "top", 1, "сколько стоит окна", 5), ("окна", "top", 2, " Окна", 7), ("окна", "top", 3, "Сколько Стоит окна", 9)], "query string, kind string, place int, phrase string, freq long"))
    assert [(r.rank, r.phrase) for r in related.orderBy("rank").collect()] == [(1, "Сколько Стоит окна"), (2, "двери")]
    asked = spark.createDataFrame([("окна", 1, "сколько стоит окна", 5, "top")], "query string, rank int, phrase string, freq long, kind string")
    gaps = BR.content_gaps(BR.brief_facts(docs, "2024-01-01 00:00:00"), BR.related_facts(asked))
    assert [g.code for g in gaps.first().gaps] == ["no_digits", "stale", "homepages", "no_exact_title", "price_unanswered"]
    scores = spark.createDataFrame([(1, 20.0, L.BAND_LOW, None)], "snapshot_id long, score double, band string, our_position int")
    row = BR.recommendations(gaps, scores, spark.createDataFrame([("окна", 50)], "query string, freq long")).first()
    assert row.format == "вопрос «как»"
    assert row.advice == ["take_format", "put_number_in_title", "give_fresh_data", "answer_closer_than_homepage", "exact_h1", "give_prices", "take", "low_demand", "headings_from_refinements"]


# --- audit and plan --------------------------------------------------------------------------


def test_planted_site(spark):
    site = "https://e.ru/"
    text = "слово " * 300
    page = lambda title, head="", body="": f"<html><head><title>{title}</title>{head}</head><body><h1>h</h1>{body}{text}</body></html>"
    menu = "".join(f'<a href="/{x}">x</a>' for x in ("dup-a/", "dup-b?utm_source=z", "gone", "canon", "closed", "hidden"))
    pages = [("", 200, page("Главная страница сайта об окнах и балконах", body=menu)), ("dup-a", 200, page("Дубль")), ("dup-b", 200, page(" дубль ")), ("canon", 200, page("", '<link rel="canonical" href="/other">')),
             ("closed", 200, page("c", '<meta name="robots" content="noindex">')), ("gone", 404, None), ("lost", 404, None), ("down", 503, None), ("alone", 200, page("a", '<link rel="canonical" href="https://z.ru/">'))]
    crawl = spark.createDataFrame([(site, site + p, s, h, None) for p, s, h in pages], "site string, url string, status int, html string, error string")
    facts = H.page_facts(crawl).persist()
    sitemap = spark.createDataFrame([(site, site + "closed/"), (site, site + "hidden")], "site string, url string")
    disallowed = spark.createDataFrame([(site, site + "hidden")], "site string, url string")
    found = {}
    for r in AU.audit_findings(facts, sitemap, disallowed).collect():
        found.setdefault(r.code, set()).add(r.url.removeprefix(site))
    assert found["broken-internal-link"] == {"gone"} and found["page-unavailable"] == {"lost", "down"}
    assert found["duplicate-title"] == {"dup-a", "dup-b"} and found["missing-title"] == {"canon"}
    assert found["noindex-in-sitemap"] == {"closed"} and found["robots-disallow-in-sitemap"] == {"hidden"} and found["noindex-not-checked"] == {""}
    assert found["canonical-mismatch"] == {"canon"} and found["canonical-external"] == {"alone"} and found["orphan-page"] == {"alone"}
    assert "closed" not in found["missing-description"] and "closed" in found["missing-canonical"] and "thin-content" not in found
    assert [r.url for r in AU.links_to_check(facts, 5).collect()] == [site + "hidden"]
    ready = RD.page_findings(H.ai_page_facts(facts).withColumn("is_home", F.col("url") == site))
    assert {r.code for r in ready.where(F.col("url") == site).collect()} == {"jsonld-missing", "markdown-alternate-missing", "faq-schema-missing"}


def test_plan_routes_and_orders(spark):
    queries = spark.createDataFrame([("s", "сниппет", 40, 0, 6.0), ("s", "выигрыш", 40, 3, 6.0), ("s", "далеко", 50, 0, 30.0), ("s", "без страницы", 25, 1, 8.0)], "site string, query string, shows long, clicks long, avg_show_position double").withColumn("fetched_at", F.lit(T(1)))
    pages = spark.createDataFrame([("s", "сниппет", "https://s/a/"), ("s", "выигрыш", "/A")], "site string, query_key string, url string")
    tracker = spark.createDataFrame([("s", "выигрыш", 5, "/z"), ("s", "новый", 7, "/b"), ("s", "без спроса", 7, "/b"), ("s", "первый", 2, "/b")], "site string, query string, position int, url string").withColumn("checked_at", F.lit(T(1)))
    demand = spark.createDataFrame([("s", "новый", 90), ("s", "выигрыш", 9)], "site string, query_key string, freq long")
    items = P.query_items(queries, pages, tracker, demand).persist()
    actions = P.page_actions(items)
    assert {(r.section, r["query"], r.url, r.rule, int(r.k1), int(r.k2)) for r in actions.collect()} == {
        ("snippet", "сниппет", "/a/", "shows_without_clicks", -40, 0), ("quick_wins", "выигрыш", "/A", "owner_position_band", -40, 0), ("quick_wins", "новый", "/b", "tracker_position_band", 0, -90)}
    assert {(r.skipped, r.queries) for r in P.skipped_queries(items).collect()} == {("no_page", 1), ("no_demand", 1)}
    assert all(r.in_both == (r["query"] != "новый") for r in P.page_sections(actions).collect())
    findings = spark.createDataFrame([("s", "critical", "redirect-chain", "https://s/x", "e"), ("s", "minor", "missing-og", "https://s/b", "e"), ("s", "minor", "missing-og", "https://s/a", "e"), ("s", "minor", "noindex-not-checked", "https://s/", "e")], "site string, severity string, code string, url string, evidence string").withColumn("measured_at", F.lit(T(1)))
    readiness = spark.createDataFrame([("s", "major", "llms-txt-missing", "u", "e"), ("s", "minor", "jsonld-missing", "u", "e"), ("s", "critical", "robots-blocks-gptbot", "u", "whole site"), ("s", "major", "page-unavailable", "u", "e")], "site string, severity string, code string, url string, evidence string").withColumn("measured_at", F.lit(T(1)))
    everything = actions.unionByName(P.finding_actions(findings, readiness))
    plan = P.action_plan(everything, 7)
    assert [(r.place, r.section, r.rule) for r in plan.orderBy("place").collect()] == [
        (1, "indexing", "audit:redirect-chain"), (2, "quick_wins", "owner_position_band"), (3, "quick_wins", "tracker_position_band"), (4, "snippet", "shows_without_clicks"),
        (5, "ai_search", "readiness:robots-blocks-gptbot"), (6, "ai_search", "readiness:llms-txt-missing"), (7, "other", "audit:missing-og")]
    assert [(r.section, r.hidden) for r in P.hidden_counts(everything, plan).collect()] == [("other", 1)]
    og = plan.where("rule = 'audit:missing-og'").first()
    assert og["count"] == 2 and og.url == "https://s/a" and len(og.evidence) == 2


def test_cannibalization_needs_more_than_one_snapshot(spark):
    articles = spark.createDataFrame([("s", "/a", "остекление балкона"), ("s", "/b", "остекления балконов"), ("s", "/c", "двери")], "site string, url string, target_query string").withColumn("created_at", F.lit(T(1)))
    report = articles.select("site", "url", "target_query", F.lit(L.WORKS).alias("verdict"), F.lit(None).cast("string").alias("ranking_url"), F.col("created_at").alias("checked_at"))
    owner = spark.createDataFrame([("s", "двери", "/d", 12), ("s", "дверь", "/e", 2)], "site string, query string, url string, shows long").withColumn("fetched_at", F.lit(T(1)))
    own = spark.createDataFrame([("s", "бренд", "https://s/x", 1), ("s", "бренд", "https://s/y", 2)], "site string, query string, url string, position int").withColumns({"fetched_at": F.lit(T(1)), "region": F.lit(1)})
    history = spark.createDataFrame([("s", "полы", 1, "/p"), ("s", "полы", 2, "/q"), ("s", "окна", 1, "/o"), ("s", "окна", 2, "https://s/O/")], "site string, query string, n int, url string").withColumn("checked_at", F.lit(T(1)))
    evidence = P.cannibalization_evidence(articles, report, owner, own, history)
    got = {r["query"]: (r.rule, r.url) for r in P.cannibalization_actions(evidence, owner.select("site", "query", "shows")).collect()}
    assert got == {"остекление балкона": ("cannibalization:registry", "/a and /b"), "двери": ("cannibalization:owner", "/c and /d"), "полы": ("cannibalization:tracker", "/p and /q")}
