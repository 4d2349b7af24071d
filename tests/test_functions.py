"""Keys, word forms and other scalar columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visilake.functions import keys as K
from visilake.functions import words as W


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column.alias("out")).collect()]


# Golden pairs whose keys must meet, and pairs whose keys must stay apart.
SAME = [
    ("сквозная аналитика", "сквозные аналитики"),
    ("система сквозной аналитики", "аналитика система сквозной"),
    ("сквозная аналитика битрикс24", "сквозную аналитику битрикс24"),
    ("сервисы сквозной аналитики", "сквозная аналитика сервисы"),
    ("метрика сквозную аналитику", "сквозная аналитика метрики"),
    ("настройка сквозной аналитики", "сквозная аналитика настройка"),
    ("брендинг жилого комплекса", "брендинги жилых комплексов"),
    ("маркетинг застройщика", "маркетинг застройщиков"),
]
DIFFERENT = [
    ("сквозная аналитика битрикс", "сквозная аналитика битрикс24"),
    ("сквозная аналитика битрикс 24", "сквозная аналитика битрикс24"),
    ("сквозная аналитика", "сквозная аналитика метрики"),
    ("брендинг жк", "брендинг жк москва"),
]
#: the same on other words
OWN_SAME = [("купить окна", "окно купить"), ("доставка цветов", "Цветы  доставка"), ("ремонт квартир", "квартира: ремонты"), ("steel rings", "rings steel")]
OWN_DIFFERENT = [("ремонт квартир", "ремонт домов"), ("доставка цветов", "доставка"), ("steel rings", "steel ring 24")]


def test_word_forms_meet_and_stay_apart(spark):
    pairs = spark.createDataFrame(
        [(a, b, True) for a, b in SAME + OWN_SAME] + [(a, b, False) for a, b in DIFFERENT + OWN_DIFFERENT], "a string, b string, same boolean"
    )
    wrong = pairs.where(W.same_query("a", "b") != F.col("same")).collect()
    assert wrong == []


def test_stems(spark):
    # published stems of the Russian Snowball vocabulary, and words without Russian letters
    words = ["вавиловка", "вагнера", "вазах", "валится", "ROI", "битрикс24", "Ёлки", "нн", "", "важнейшие"]
    stems = values(spark, W.stem_ru("v"), words)
    assert stems == ["вавиловк", "вагнер", "ваз", "вал", "roi", "битрикс24", "елк", "нн", "", "важн"]


def test_canonical_prefers_named_then_direct_then_short(spark):
    rows = spark.createDataFrame(
        [("сквозные аналитики",), ("сквозную аналитику",), ("аналитика сквозная",), ("сквозная аналитика",)], "p string"
    )
    assert rows.agg(W.pick_canonical("p", F.lit(False))).first()[0] == "сквозная аналитика"
    assert rows.agg(W.pick_canonical("p", F.col("p") == "сквозную аналитику")).first()[0] == "сквозную аналитику"


def test_domains(spark):
    raw = [" HTTPS://www.Example.RU/a", "example.ru", "http://www.www.example.ru", "www.example.ru/x"]
    assert values(spark, K.normalize_domain("v"), raw) == ["example.ru", "example.ru", "www.example.ru", "example.ru"]
    hosts = values(
        spark,
        K.host_of("v"),
        ["https://user:pw@WWW.www.Shop.Example.co.uk.:8080/a?b#c", "//example.ru/x", "::1", "http://[2a00::1]:80/x", "", None],
    )
    assert hosts == ["shop.example.co.uk", "example.ru", "::1", "2a00::1", "", ""]
    registered = values(spark, K.registrable_domain("v"), ["a.shop.example.co.uk", "a.b.example.ru", "10.0.0.1", "me.github.io", "x.me.github.io"])
    assert registered == ["example.co.uk", "example.ru", "10.0.0.1", "me.github.io", "me.github.io"]


@pytest.mark.parametrize(
    "url, domain, mode, expected",
    [
        ("https://blog.example.ru/x", "example.ru", "site", True),
        ("https://blog.example.ru/x", "example.ru", "host", False),
        ("https://www.example.ru/x", "example.ru", "host", True),
        ("https://shop.example.co.uk/", "example.co.uk", "site", True),
        ("https://other.co.uk/", "example.co.uk", "site", False),
        ("https://blog.example.ru/", "blog.example.ru", "site", True),
        ("https://a.blog.example.ru/", "blog.example.ru", "site", True),
        ("https://shop.example.ru/", "blog.example.ru", "site", False),
        ("https://xn--e1afmkfd.xn--p1ai/", "пример.рф", "site", True),
        ("https://пример.рф/", "xn--e1afmkfd.xn--p1ai", "site", True),
        ("https://notexample.ru/", "example.ru", "site", False),
    ],
)
def test_domain_matches(spark, url, domain, mode, expected):
    assert values(spark, K.domain_matches("v", domain, mode), [url]) == [expected]


def test_idna_helpers(spark):
    assert values(spark, K.host_to_unicode("v"), ["xn--e1afmkfd.xn--p1ai", "a.b", None]) == ["пример.рф", "a.b", None]
    assert values(spark, K.host_to_ascii("v"), ["пример.рф"]) == ["xn--e1afmkfd.xn--p1ai"]


def test_addresses(spark):
    urls = ["HTTPS://Example.RU/Path/", "http://example.ru:80", "https://example.ru:8443/a#x", "http://[::1]:8080/"]
    assert values(spark, K.normalize_url("v"), urls) == [
        "https://example.ru/Path/", "http://example.ru/", "https://example.ru:8443/a", "http://[::1]:8080/",
    ]
    a, b, c, d = values(
        spark,
        K.dedup_key("v"),
        ["https://e.ru/blog/x/", "https://e.ru/blog/x?utm_source=blog&utm_campaign=y", "https://e.ru/о%7e?q=1&from=a&z", "https://e.ru//"],
    )
    assert a == b == "https://e.ru/blog/x"
    assert c == "https://e.ru/%D0%BE%7E?q=1&z" and d == "https://e.ru/"
    assert values(spark, K.normalize_path("v"), ["/Blog/X/", "https://e.ru/blog/x/?a", "blog", "https://e.ru", "", None]) == [
        "/blog/x", "/blog/x", "/blog", "/", "", "",
    ]
    assert values(spark, K.article_url_key("v"), ["https://www.E.ru:443/Blog/%D0%BE%ZZ/", "http://e.ru/Blog/о%ZZ?x", "e.ru/a+b"]) == [
        "e.ru/Blog/о%ZZ", "e.ru/Blog/о%ZZ", "e.ru/a+b",
    ]
    assert values(spark, K.crawlable("v"), ["https://e.ru/a.pdf", "mailto:x@y", "/a/b", "https://e.ru/a.html"]) == [False, False, True, True]
    assert values(spark, K.same_site("v", F.lit("https://example.ru/")), ["https://www.example.ru/a", "http://blog.example.ru", "http://xexample.ru"]) == [True, True, False]
    assert values(spark, K.url_depth("v"), ["https://e.ru", "https://e.ru/a/b/", "/x"]) == [0, 2, 1]


def test_text_and_numbers(spark):
    assert values(spark, K.clean_text("v", 12), ["a​|b\n c d", "abcdefghijk lmn"]) == ["a b c d", "abcdefghijk…"]
    assert values(spark, K.slug("v"), ["Щука и Ёж!", "***"]) == ["schuka-i-ezh", "project"]
    assert values(spark, K.word_count("v"), ["два слова, 25км"]) == [4]
    assert values(spark, K.query_words("v"), ["на два слова", "a b"]) == [2, 1]
    assert values(spark, W.contains_query("v", F.lit("сквозную аналитику")), ["О сквозной аналитике", "о метрике"]) == [True, False]
    assert values(spark, W.brand_match("v", ["гранит строй"]), ["ГранитСтрой москва", "гранит"]) == [True, False]
    assert values(spark, F.array_join(W.prefix_hits("v", ("остекл", "окн")), ","), ["остекление окна"]) == ["остекл,окн"]
    row = spark.range(1).select(K.ctr(F.lit(3), F.lit(40)).alias("a"), K.ctr(F.lit(3), F.lit(0)).alias("b")).first()
    assert (row.a, row.b) == (7.5, None)
    assert values(spark, K.parse_modtime("v"), ["20210729T083812", "bad"]) == [dt.datetime(2021, 7, 29, 8, 38, 12), None]
    assert values(spark, K.is_portal("v"), ["www.vk.com", "m.vk.com", "notvk.com", None]) == [True, True, False, False]
    assert values(spark, K.is_wizard("v"), ["Картинки по запросу окна", "Окна"]) == [True, False]
