"""Matching against dictionaries that are tables: any number of terms, one plan.

``terms`` are rows (mark, term): a mark is what a term stands for (a service, a brand, a rival's
site). Texts and terms meet in an equi-join on anchors, the first code points of a term, and the whole
term is compared inside the join. So a dictionary of fifty thousand terms has a plan of the same size as
one of five, is dealt like any table, and is broadcast only if Spark measures it as small. Each
different text is matched once. Of the dictionary the driver learns two facts: which anchor lengths
occur (at most ``ANCHOR``) and how long the longest term is.

Null texts and null or empty terms match nothing; repeated terms count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L
from ..functions import words as WD
from . import core as C

#: code points of an anchor; shorter terms are anchored whole
ANCHOR = 6


class Terms:
    """A dictionary (mark, term), with what is needed to look for it."""

    def __init__(self, rows: DataFrame):
        held = rows.select("mark", "term").where(F.coalesce("term", F.lit("")) != "").distinct()
        self.rows = held.select("mark", "term", F.substring("term", 1, ANCHOR).alias("_anchor"))
        size = F.char_length("term")
        self.lengths, self.longest = held.agg(F.array_sort(F.collect_set(F.least(size, F.lit(ANCHOR)))), F.coalesce(F.max(size), F.lit(0))).first()

    def meet(self, asked: DataFrame, rest: str, text: str) -> DataFrame:
        """(text, mark, term) where a term begins ``rest``."""
        anchors = [F.substring(F.col(rest), F.lit(1), F.lit(n)) for n in self.lengths]
        anchored = asked.select(text, rest, F.explode(F.array_distinct(F.array(*anchors))).alias("_anchor"))
        return anchored.join(self.rows, "_anchor").where(F.startswith(rest, "term")).select(text, "mark", "term").distinct()

    def none(self, texts: DataFrame, text: str) -> DataFrame:
        return texts.select(text).where("false").select(text, F.lit("").alias("mark"), F.lit("").alias("term"))


def word_prefixes(texts: DataFrame, terms: DataFrame | Terms, text: str = "phrase") -> DataFrame:
    """(text, mark, term): terms that some word of the lower-cased text starts with."""
    known = terms if isinstance(terms, Terms) else Terms(terms)
    if not known.lengths:
        return known.none(texts, text)
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\w+)"), F.lit(1))
    begun = F.array_distinct(F.transform(words, lambda w: F.substring(w, F.lit(1), F.lit(known.longest))))
    return known.meet(texts.select(text).distinct().select(text, F.explode(begun).alias("_rest")), "_rest", text)


def contained(texts: DataFrame, terms: DataFrame | Terms, text: str = "phrase", within: Column | None = None) -> DataFrame:
    """(text, mark, term): terms that stand anywhere in ``within``, a column of the text (default: the text)."""
    known = terms if isinstance(terms, Terms) else Terms(terms)
    if not known.lengths:
        return known.none(texts, text)
    rows = texts.select(text).distinct().select(text, (F.col(text) if within is None else within).alias("_within"))
    size = F.char_length("_within")
    rests = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("_within"), i, F.lit(known.longest)))
    return known.meet(rows.select(text, F.explode(F.array_distinct(F.when(size > 0, rests))).alias("_rest")), "_rest", text)


def brand_terms(terms: DataFrame) -> DataFrame:
    """Terms by letters and digits only, as :func:`~visilake.functions.words.brand_match` compares them."""
    return terms.select("mark", WD.alnum_key("term").alias("term"))


def with_marks(rows: DataFrame, hits: DataFrame, text: str = "phrase", name: str = "marks") -> DataFrame:
    """``rows`` with the sorted marks of their text (few different marks; terms can be many)."""
    marks = hits.groupBy(text).agg(F.array_sort(F.collect_set("mark")).alias(name))
    return rows.join(marks, text, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def phrase_marks(rows: DataFrame, terms: DataFrame, text: str = "phrase", name: str = "marks") -> DataFrame:
    """``rows`` with the marks of each phrase: of brands anywhere in its letters, of all others at the start of a word."""
    brands = brand_terms(terms.where(F.col("mark") == L.BRAND))
    hits = word_prefixes(rows, terms.where(F.col("mark") != L.BRAND), text).unionByName(contained(rows, brands, text, WD.alnum_key(text)))
    return with_marks(rows, hits, text, name)


def has(mark: str, marks: str = "marks") -> Column:
    return F.array_contains(marks, mark)


SERVICE, OBJECT = "service", "object"


def classify_phrases(rows: DataFrame, terms: DataFrame, text: str = "phrase") -> DataFrame:
    """``rows`` with ``kind``: brand by name, target by service and object together, else adjacent.

    The table form of :func:`~visilake.operators.core.classify_phrase`; half a dictionary counts as none.
    """
    halves = terms.where(F.col("mark").isin(SERVICE, OBJECT)).select("mark").distinct().count()
    target = has(SERVICE, "_marks") & has(OBJECT, "_marks") if halves == 2 else F.lit(False)
    marked = phrase_marks(rows, terms, text, "_marks")
    kind = F.when(has(L.BRAND, "_marks"), L.BRAND).when(target, L.TARGET).otherwise(L.ADJACENT)
    return marked.withColumn("kind", kind).select(*rows.columns, "kind")


def site_marks(docs: DataFrame, terms: DataFrame, domain: str = "domain", name: str = "marks") -> DataFrame:
    """``docs`` with the marks of their domain: those of terms in its bare spelling."""
    return with_marks(docs, contained(docs, terms, domain, K.bare_domain(domain)), domain, name)


def judge_candidates(rows: DataFrame, terms: DataFrame, niche: C.Niche, min_freq: int = L.POOL_MIN_FREQ, tracked: Column | None = None) -> DataFrame:
    """``rows`` (seed, kind, phrase, freq, ...) with ``accepted`` and ``reason``.

    The table form of :func:`~visilake.operators.core.judge_candidate`: services and objects come from
    ``terms``, only the patterns of ``niche`` are used; half a dictionary counts as none.
    """
    found = {r[0] for r in terms.where(F.col("mark").isin(SERVICE, OBJECT)).select("mark").distinct().collect()}
    whole = len(found) == 2
    halves = Terms(terms.where(F.col("mark").isin(SERVICE, OBJECT) & F.lit(whole)))
    marked = with_marks(rows, word_prefixes(rows, halves), name="_marks")
    marked = with_marks(marked, word_prefixes(rows, halves, "seed"), "seed", "_seed_marks")
    hits = C.Hits(has(SERVICE, "_marks"), has(OBJECT, "_marks"), has(OBJECT, "_seed_marks") if whole else None, whole)
    judged = marked.withColumn("_j", C.judge_candidate("phrase", "freq", "kind", "seed", niche, min_freq, tracked, hits))
    return judged.select(*rows.columns, "_j.accepted", "_j.reason")


SPECIALIST, SPECIALIST_NICHE, OTHER_MEANING = "specialist", "specialist_niche", "other_meaning"


def domain_profile(docs: DataFrame, terms: DataFrame, niche: C.Niche, top: int = 10) -> DataFrame:
    """The table form of :func:`~visilake.operators.core.domain_profile`.

    Marks of ``terms``: service and object (word beginnings in title and passage), other_meaning (anywhere in
    them), specialist and specialist_niche (anywhere in the domain). Of ``niche`` only patterns are used.
    """
    newest = C.newest_results(docs)
    sites = newest.where(~F.col("is_wizard") & (F.col("organic_position") <= top)).withColumn("_text", C.result_text())
    halves = terms.where(F.col("mark").isin(SERVICE, OBJECT))
    whole = halves.select("mark").distinct().count() == 2
    meanings = terms.where(F.col("mark") == OTHER_MEANING).select("mark", F.lower("term").alias("term"))
    hits = word_prefixes(sites, halves, "_text").unionByName(contained(sites, meanings, "_text", F.lower("_text")))
    marked = with_marks(sites, hits, "_text", "_said")
    marked = site_marks(marked, terms.where(F.col("mark").isin(SPECIALIST, SPECIALIST_NICHE)), "domain", "_site")
    wide = has(SERVICE, "_said") | has(OBJECT, "_said") if whole else F.col("_text").rlike(L.COMMERCIAL)
    narrow = has(OBJECT, "_said") if whole else F.lit(False)
    specialist = F.when(F.col("niche_only"), narrow | has(SPECIALIST_NICHE, "_site")).otherwise(wide | has(SPECIALIST, "_site"))
    return C.profile_counts(marked, specialist, has(OTHER_MEANING, "_said"), niche)
