"""Word forms: stems, phrase keys and phrase predicates, as JVM expressions.

A stem is worked out inside the row, so a key never needs a shuffle; words without
Cyrillic letters take the short branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists as L
from .keys import ColumnOrName, _c, let, strings

_V = f"[{L.VOWELS}]"
_NOT_V = f"[^{L.VOWELS}]"


def _any(endings) -> str:
    return "|".join(endings)


# An ending "after a" counts only behind а or я, and that letter stays.
_PERFECTIVE = f"([ая])(?:{_any(L.PERFECTIVE_AFTER_A)})$|(?:{_any(L.PERFECTIVE)})$"
_REFLEXIVE = f"(?:{_any(L.REFLEXIVE)})$"
_ADJECTIVE = f"(?:{_any(L.ADJECTIVE)})$"
_PARTICIPLE = f"([ая])(?:{_any(L.PARTICIPLE_AFTER_A)})$|(?:{_any(L.PARTICIPLE)})$"
_VERB_AFTER_A = f"([ая])(?:{_any(L.VERB_AFTER_A)})$"
_VERB = f"(?:{_any(L.VERB)})$"
_NOUN = f"(?:{_any(L.NOUN)})$"
_DERIVATIONAL = f"(?:{_any(L.DERIVATIONAL)})$"
_SUPERLATIVE = f"(?:{_any(L.SUPERLATIVE)})$"


def _cut(text: Column, pattern: str, keep: str = "") -> Column:
    return F.regexp_replace(text, pattern, keep)


def _inflection_off(tail: Column) -> Column:
    """Drop the grammatical ending of the part behind the first vowel."""

    def after_reflexive(t: Column) -> Column:
        return (
            F.when(t.rlike(_ADJECTIVE), _cut(_cut(t, _ADJECTIVE), _PARTICIPLE, "$1"))
            .when(t.rlike(_PARTICIPLE), _cut(t, _PARTICIPLE, "$1"))
            .when(t.rlike(_VERB_AFTER_A), _cut(t, _VERB_AFTER_A, "$1"))
            .when(t.rlike(_VERB), _cut(t, _VERB))
            .otherwise(_cut(t, _NOUN))
        )

    inflected = F.when(tail.rlike(_PERFECTIVE), _cut(tail, _PERFECTIVE, "$1")).otherwise(
        let(_cut(tail, _REFLEXIVE), after_reflexive)
    )
    return _cut(inflected, "и$")


def _russian_stem(word: Column) -> Column:
    head = F.regexp_extract(word, f"^(.*?{_V})", 1)
    # where the second vowel-consonant boundary lies; a word without one has no such region
    second = F.regexp_extract(word, f"^((?:.*?{_V}{_NOT_V}){{2}})", 1)
    region2 = F.when(second == "", F.char_length(word)).otherwise(F.char_length(second))
    parts = F.struct(
        head.alias("head"),
        _inflection_off(F.substr(word, F.char_length(head) + 1)).alias("tail"),
        region2.alias("region2"),
    )

    def derivation_off(p: Column) -> Column:
        shorter = _cut(p["tail"], _DERIVATIONAL)
        fits = F.char_length(p["head"]) + F.char_length(shorter) >= p["region2"]
        return F.struct(p["head"].alias("head"), F.when(fits, shorter).otherwise(p["tail"]).alias("tail"))

    def finish(p: Column) -> Column:
        whole = F.concat(p["head"], p["tail"])
        degree = F.concat(p["head"], _cut(p["tail"], _SUPERLATIVE))
        single_n = (
            F.when(whole.rlike("нн$"), _cut(whole, "н$"))
            .when(p["tail"].rlike(_SUPERLATIVE), _cut(degree, "нн$", "н"))
            .otherwise(whole)
        )
        return _cut(single_n, "ь$")

    stemmed = let(let(parts, derivation_off), finish)
    return let(stemmed, lambda s: F.when(s == "", word).otherwise(s))


def folded(col: ColumnOrName) -> Column:
    return F.replace(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit("ё"), F.lit("е"))


def stem_ru(word: ColumnOrName) -> Column:
    """Stem of one word; Latin words and numbers come back lower-cased only."""
    return let(folded(word), lambda w: F.when(w.rlike(_V), _russian_stem(w)).otherwise(w))


def words_of(phrase: ColumnOrName) -> Column:
    """Words of a phrase: letters and digits, inner hyphens kept."""
    return F.regexp_extract_all(folded(phrase), F.lit("([0-9a-zа-я]+(?:-[0-9a-zа-я]+)*)"), F.lit(1))


def stems_of(phrase: ColumnOrName, longer_than: int = 0) -> Column:
    """Stems of the words of a phrase, longer ones only if asked."""
    words = words_of(phrase)
    if longer_than:
        words = F.filter(words, lambda w: F.char_length(w) > longer_than)
    return F.transform(words, lambda w: F.when(w.rlike(_V), _russian_stem(w)).otherwise(w))


def stem_key(phrase: ColumnOrName) -> Column:
    """One key for all word forms and word orders of a phrase."""
    return F.array_join(F.array_sort(stems_of(phrase)), " ")


def same_query(left: ColumnOrName, right: ColumnOrName) -> Column:
    key = stem_key(left)
    return (key != "") & (key == stem_key(right))


def contains_query(text: ColumnOrName, query: ColumnOrName) -> Column:
    """Every significant word of the query is in the text, in any form."""
    need = stems_of(query, longer_than=3)
    return (F.size(need) > 0) & (F.size(F.array_except(need, stems_of(text, longer_than=3))) == 0)


def oblique_score(phrase: ColumnOrName) -> Column:
    """How unlike a dictionary form the phrase looks."""
    words = words_of(phrase)
    oblique = F.size(F.filter(words, lambda w: w.rlike(f"(?:{_any(L.OBLIQUE)})$")))
    reversed_order = (F.size(words) > 1) & F.element_at(words, -1).rlike(f"(?:{_any(L.ADJECTIVE_TAIL)})$")
    return oblique + F.coalesce(reversed_order.cast("int"), F.lit(0))


def canonical_order(phrase: ColumnOrName, preferred: Column) -> Column:
    """Sort key of :func:`pick_canonical`."""
    phrase = _c(phrase)
    return F.struct(
        F.when(preferred, 0).otherwise(1).alias("named"),
        oblique_score(phrase).alias("oblique"),
        F.char_length(phrase).alias("length"),
        phrase.alias("phrase"),
    )


def pick_canonical(phrase: ColumnOrName, preferred: Column) -> Column:
    """Aggregate: the variant that stands for a group of word forms."""
    return F.min(canonical_order(phrase, preferred))["phrase"]


# --- phrase predicates over small dictionaries ------------------------------------


def alnum_key(col: ColumnOrName) -> Column:
    """Letters and digits only, so spaced and joined spellings meet."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^0-9a-zа-яё]+", "")


def _alnum(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch in "0123456789" or "a" <= ch <= "z" or "а" <= ch <= "я" or ch == "ё")


def brand_match(phrase: ColumnOrName, terms) -> Column:
    """The phrase carries one of the brand terms."""
    keys = [k for k in dict.fromkeys(_alnum(t) for t in terms) if k]
    if not keys:
        return F.lit(False)
    return alnum_key(phrase).rlike("|".join(keys))


def prefix_hits(phrase: ColumnOrName, stems) -> Column:
    """Dictionary stems some word of the phrase starts with, in dictionary order."""
    stems = list(dict.fromkeys(stems))
    if not stems:
        return F.array().cast("array<string>")
    words = F.regexp_extract_all(F.lower(_c(phrase)), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.filter(strings(stems), lambda s: F.exists(words, lambda w: F.startswith(w, s)))


def has_prefix(phrase: ColumnOrName, stems) -> Column:
    return F.size(prefix_hits(phrase, stems)) > 0
