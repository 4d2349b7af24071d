"""URL filters by a cascade of Bloom filters: exact membership of keys without a join.

The first level of a cascade encodes the listed keys. The keys of the corpus that pass it without
being listed are its false positives: the second level encodes those, the third the listed keys that
pass the second, and so on until a level lets nothing wrong through. A key of the corpus is listed
if the first level that refuses it is an even one. All keys that any URL can ask for were asked while
building (the complete key universe), so the answer is exact, and the corpus itself is only scanned:
one pass to measure the universe, one for the false positives.

A key is a host or one of its parents, with a beginning of the path: ``example.com/en/``. What a URL
can ask for follows from the shapes of the listed keys (number of labels, length of the path), so a
host of a thousand labels or a path of a megabyte asks for no more keys than any other.

Size: the first level takes about 2.2 log2(u) bits a listed key, at most 17, for u keys in the universe to each
listed one; the second about 9 bits a false positive, and the rest little: ten million listed keys
over 10^9 take some 30 MB. A level reaches the tasks as a scalar subquery. Its words are filled by a distributed
``bit_or``; only finished words meet, 4096 to an array.

A null URL or one without ``://`` has an empty host and path, which no key fits. Equal rows get equal
answers and are all returned; letter case of paths counts. Columns of other names play no part. An
empty list lets everything through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

#: bits that a key sets: at most in the first level, and in each later one
MOST_BITS, LATER_BITS = 8, 4
#: words are this much larger than scattered bits would need, as keys meet unevenly in them
ROOM = 1.5
CHUNK = 4096
#: (key, verdict) of the rules that hold in any case (fixed values)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: a host is listed from the label on that has one of these words between its hyphens
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
LISTED_HOST = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(LISTED_WORDS)})(?:-[^.]*)?\..+)$"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.instr(F.col(url), F.lit("://"))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, length of the path) of ``key``: few, however long the list."""
    host = F.substring_index("key", "/", 1)
    labels = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return sorted((r[0], r[1]) for r in keys.select(labels, F.char_length("key") - F.char_length(host)).distinct().collect())


def asked(shapes: list[tuple[int, int]], host: str = "host", path: str = "path") -> list[Column]:
    """The key of each shape that a URL asks for; null where the URL is shorter."""
    labels = F.char_length(host) - F.char_length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1
    return [
        F.when((labels >= n) & (F.char_length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in shapes
    ]


class Level:
    """One Bloom filter: a key sets ``hashes`` bits of one 64-bit word; the words are stored as an array of arrays."""

    def __init__(self, keys: DataFrame, n: int, hashes: int, number: int):
        self.hashes, self.number = hashes, number
        self.size = max(1, math.ceil(n * hashes * ROOM / math.log(2) / 64))
        place, mask = self._place_and_mask(F.col("key"))
        set_bits = keys.select(place.alias("word"), mask.alias("bits"))
        blank = keys.sparkSession.range(self.size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = set_bits.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        chunks = words.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
        whole = chunks.agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("words.bits").alias("words")))).alias("chunks"))
        self.words = stored(whole.select(F.col("chunks.words").alias("words")), "bloom")

    def _place_and_mask(self, key: Column) -> tuple[Column, Column]:
        """The word of a key and the bits it sets there."""
        place = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.size).cast("long"))
        drawn = F.xxhash64(key, F.lit(2 * self.number + 1))
        bits = [F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(self.hashes)]
        mask = F.lit(0).cast("long")
        for bit in bits:
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return place, mask

    def passes(self, key: Column) -> Column:
        place, mask = self._place_and_mask(key)
        word = F.get(F.get(self.words.scalar(), F.floor(place / CHUNK).cast("int")), (place % CHUNK).cast("int"))
        return word.bitwiseAND(mask) == mask


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both with a column ``key``).

    The universe may repeat keys and may hold nulls, which are in no list.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = stored(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        self.levels: list[Level] = []
        self.keys = listed.count()
        if not self.keys:
            return
        universe = universe.select("key").where("key IS NOT NULL")
        ratio = universe.select(F.approx_count_distinct("key", 0.02)).first()[0] / self.keys
        self._add(listed, self.keys, min(MOST_BITS, max(2, math.ceil(math.log2(max(ratio, 1.0))))))
        inside = listed
        outside = stored(universe.where(self.levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"), "wrong")
        wrong = outside.count()
        while wrong:  # those that the last level lets through and should not
            self._add(outside, wrong, LATER_BITS)
            inside, outside = outside, stored(inside.where(self.levels[-1].passes(F.col("key"))), "wrong")
            wrong = outside.count()

    def _add(self, keys: DataFrame, n: int, hashes: int) -> None:
        self.levels.append(Level(keys, n, hashes, len(self.levels)))

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a null key is not."""
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            refused = F.lit(level.number % 2 == 1)
            found = F.when(level.passes(key), found).otherwise(refused)
        return key.isNotNull() & found


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest rule that fits decides, else the list.

    ``rules``: (key, verdict), ``listed``: (key). A key fits its host and all subdomains where the
    path starts with the key's. Without a rule a URL is blocked if a listed key fits it.
    """
    host, path = host_and_path(url)
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = parts.select("host", "path")

    def universe(shapes: list[tuple[int, int]]) -> DataFrame:
        return urls.select(F.explode(F.array(*asked(shapes))).alias("key")) if shapes else urls.select(F.lit(None).cast("string").alias("key"))

    rule_shapes, list_shapes = key_shapes(rules), key_shapes(listed)
    ruled, blocking = Cascade(rules, universe(rule_shapes)), Cascade(rules.where("verdict = 'block'"), rules)
    held = Cascade(listed, universe(list_shapes))

    def fitting(cascade: Cascade, shapes: list[tuple[int, int]]) -> Column:
        """The longest key of the cascade that fits."""
        found = [F.when(cascade.contains(k), F.struct(F.char_length(k).alias("n"), k.alias("key"))) for k in asked(shapes)]
        return F.array_max(F.array(*found))["key"] if found else F.lit(None).cast("string")

    told = parts.select("*", fitting(ruled, rule_shapes).alias("rule"), fitting(held, list_shapes).alias("listed"))
    blocked = F.when(F.col("rule").isNotNull(), blocking.contains(F.col("rule"))).otherwise(F.col("listed").isNotNull())
    return told.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "listed")


def listed_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """(key) of the hosts in ``pages`` that a listed word marks, from the marked label on."""
    host, _ = host_and_path(url)
    found = pages.select(F.regexp_extract(host, LISTED_HOST, 1).alias("host")).where("host <> ''").distinct()
    return found.select(F.concat("host", F.lit("/")).alias("key"))


def verdict_rows(pages: DataFrame) -> DataFrame:
    """Verdicts of all pages under ``RULES`` and the corpus's own listed hosts."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "key string, verdict string")
    return judge(pages, rules, listed_hosts(pages))
