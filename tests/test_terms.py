"""Dictionaries as tables against brute force and against dictionaries in the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from visilake.functions import lists as L
from visilake.operators import core as C
from visilake.operators import terms as T

LETTERS = "abcdeнопк"


def word(rnd, low=2, high=9):
    return "".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(low, high)))


def phrases(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, phrase string")


def dictionary(spark, rows):
    return spark.createDataFrame(rows, "mark string, term string")


def hits(df, text="phrase"):
    found = [(r[text], r["mark"], r["term"]) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


ODD = [None, "", " ", "one", "ONE Two", "ab-cd ef", "ab_cd", "a" * 4000, "Ёлка ёж", "b", "naïve ÀÉ", "ab ab ab", "нос Нос"]


def test_fifty_thousand_terms_equal_brute_force(spark):
    rnd = random.Random(1)
    said = ODD + [" ".join(word(rnd) for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    terms = list({(m, word(rnd, 1, 10)) for m in ("x", "y") for _ in range(25_000)}) + [("x", ""), ("x", None), ("y", "ab"), ("y", "ab"), ("z", "a" * 3000), ("z", "нос")]
    table, rows = dictionary(spark, terms).repartition(4), phrases(spark, said + said[:50])
    known = {(m, t) for m, t in terms if t}
    by_term = {}
    for m, t in known:
        by_term.setdefault(t, set()).add(m)
    longest = max(map(len, by_term))

    def beginnings(text):
        return {w[:n] for w in re.findall(r"\w+", text.lower()) for n in range(1, min(len(w), longest) + 1)}

    def inside(text):
        return {text[i : i + n] for i in range(len(text)) for n in range(1, min(len(text) - i, 12) + 1)} | ({"a" * 3000} if "a" * 3000 in text else set())

    for made, parts in ((T.word_prefixes(rows, table), beginnings), (T.contained(rows, table), inside)):
        assert hits(made) == {(text, m, t) for text in said if text for t in parts(text) & by_term.keys() for m in by_term[t]}


@pytest.mark.parametrize("n", [0, 3])
def test_small_and_empty_dictionaries(spark, n):
    terms = dictionary(spark, [("x", "one"), ("y", "ab"), ("x", "tw")][:n])
    rows = phrases(spark, ODD)
    marked = {r["id"]: r["marks"] for r in T.with_marks(rows, T.word_prefixes(rows, terms)).collect()}
    assert len(marked) == len(ODD) and (marked[4], marked[5], marked[0]) == ((["x"], ["y"], []) if n else ([], [], []))
    assert T.contained(rows.limit(0), terms).collect() == []


def size_of(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    return len(plan.treeString().splitlines())


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    rows = phrases(spark, ["one two"])
    sizes = set()
    for n in (5, 5000):
        terms = spark.range(n).select(F.element_at(F.array(F.lit("service"), F.lit("object"), F.lit("brand")), (F.col("id") % 3 + 1).cast("int")).alias("mark"), F.concat(F.lit("term"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("term"))
        made = T.classify_phrases(rows, terms)
        sizes.add(size_of(made))
        assert made.collect()[0]["kind"] == L.ADJACENT
    assert len(sizes) == 1


SERVICES, OBJECTS, BRANDS = ("остекл", "монтаж", "ab"), ("балкон", "лодж", "cd"), ("Окна-Дом", "a b", "ка")
TABLE = [("service", s) for s in SERVICES] + [("object", s) for s in OBJECTS] + [(L.BRAND, b) for b in BRANDS]
SAID = ODD + ["остекление балкона", "окна дом москва", "Монтаж окон", "лоджия", "ab cd", "A-B", "каб", "двери под ключ", "своими руками остекление балкона"]


@pytest.mark.parametrize("halves", ["both", "services", "none"])
def test_classes_equal_those_of_a_dictionary_in_the_plan(spark, halves):
    niche = C.Niche(services=SERVICES if halves != "none" else (), objects=OBJECTS if halves == "both" else ())
    table = [r for r in TABLE if r[0] == L.BRAND or halves == "both" or (halves == "services" and r[0] == "service")]
    rows = phrases(spark, SAID)
    want = {r["id"]: r["kind"] for r in rows.select("id", C.classify_phrase("phrase", BRANDS, niche).alias("kind")).collect()}
    found = T.classify_phrases(rows, dictionary(spark, table))
    assert found.columns == ["id", "phrase", "kind"] and {r["id"]: r["kind"] for r in found.collect()} == want


@pytest.mark.parametrize("halves", ["both", "services"])
def test_judgements_equal_those_of_a_dictionary_in_the_plan(spark, halves):
    patterns = dict(vendor="двери", foreign_name=r"жк\s+")
    niche = C.Niche(services=SERVICES, objects=OBJECTS if halves == "both" else (), **patterns)
    said = [p for p in SAID if p] + ["жк остекление", "жк балкон", "двери балкон"]
    rows = spark.createDataFrame([(s, k, p, f) for p in said for s in ("окна", "балкон", p) for k in ("top", "association") for f in (1, 500)], "seed string, kind string, phrase string, freq long")
    want = rows.select("seed", "kind", "phrase", "freq", C.judge_candidate("phrase", "freq", "kind", "seed", niche).alias("j")).select("seed", "kind", "phrase", "freq", "j.accepted", "j.reason")
    table = dictionary(spark, [r for r in TABLE if r[0] == "service" or halves == "both"])
    found = T.judge_candidates(rows, table, C.Niche(**patterns))
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_profiles_equal_those_of_a_dictionary_in_the_plan(spark):
    rnd = random.Random(3)
    titles = ["остекление балконов", "купить лоджия", "энциклопедия", None, "Забронировать монтаж", "ab Игра cd"]
    domains = ["www.okna.ru", "ru.wikipedia.org", "balkon-shop.ru", "x.ru", None]
    docs = spark.createDataFrame(
        [(p, p == "a", s, f"2024-01-0{s % 3 + 1}", k, k, k == 4, rnd.choice(domains), rnd.choice(titles), rnd.choice([None, "лоджия", "ИГРА"])) for p in "abcd" for s in range(1, 4) for k in range(1, 13)],
        "phrase string, niche_only boolean, snapshot_id int, fetched_at string, position int, organic_position int, is_wizard boolean, domain string, title string, passage string")
    niche = C.Niche(services=SERVICES, objects=OBJECTS, client_marks="забронировать", other_meaning=("Игра", "зоо"), specialist_domains=("okna", "balkon"), specialist_domains_niche=("balkon",))
    marks = TABLE + [("specialist", "okna"), ("specialist", "balkon"), ("specialist_niche", "balkon"), ("other_meaning", "Игра"), ("other_meaning", "зоо")]
    want = {tuple(map(str, r)) for r in C.domain_profile(docs, niche).collect()}
    found = T.domain_profile(docs, dictionary(spark, marks), C.Niche(client_marks="забронировать"))
    assert {tuple(map(str, r)) for r in found.collect()} == want and len(want) == 4
