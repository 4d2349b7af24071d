"""Whole results of operators against plain loops: language profiles, weighted samples, long texts."""

import collections
import hashlib
import math
import random
import struct

import pytest
import xxhash

from visilake.llm import language, sampling, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the of and to in is it that was for with as on be at by this had not are but from or have an they".split()
GERMAN = "der die das und ist nicht ein mit auf für von den im zu sich dem auch als nach wie über".split()
FRENCH = "le la les de des et est pas un une dans pour que qui sur avec ce il elle nous à été".split()
M64 = (1 << 64) - 1


def prose(seed, n, words):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", "er", "en"]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


# --- 1


def gram_key(gram):
    """The 40 bits an n-gram is ranked by among equal counts."""
    number = 0
    for point in gram:
        number = number << 21 | ord(point)
    mixed = number * 0x9E3779B97F4A7C15 & M64
    mixed ^= mixed >> 32
    return (mixed * 0xD6E8FEB86659FD93 & M64) >> 24


def grams(text):
    """Counts of one to three code points of runs of letters between blanks."""
    flat, out = " ", collections.Counter()
    for sign in text.lower():
        if sign.isalpha():
            flat += sign
        elif flat[-1] != " ":
            flat += " "
    flat += " " if flat[-1] != " " else ""
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            gram = flat[i : i + n]
            if " " not in gram[1:-1] and gram != " ":
                out[gram_key(gram)] += 1
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda k: (-counts[k], k))[:size]


def predicted(text, profiles, size):
    own = ranked(grams(text or ""), size)
    if not own or not profiles:
        return "und", 0.0, 0.0
    share = {}
    for name, profile in profiles.items():
        place = {k: i for i, k in enumerate(profile)}
        share[name] = sum(abs(place[k] - i) if k in place else size for i, k in enumerate(own)) / (len(own) * size)
    best = min(sorted(share), key=share.get)
    low = sorted(share.values())
    return best, 1 - low[0], low[1] - low[0] if len(low) > 1 else 0.0


@pytest.mark.parametrize("size", [300, 20])
def test_languages_equal_a_plain_loop(spark, monkeypatch, size):
    monkeypatch.setattr(language, "SLICE_CHARS", 700)  # many texts are longer than a slice
    rows = [(i, prose(i, 5 + 4 * (i % 60), w), lang) for w, lang, first in ((ENGLISH, "en", 0), (GERMAN, "de", 200), (FRENCH, "fr", 400)) for i in range(first, first + 70)]
    odd = ["", None, "a", "ab ab", "123", "x" * 3000, "é" * 800 + " the der le", "日本語" * 500, "the\nder\nle\n" * 300, "ΑΣ ΑΣ. İ K", "the der le", prose(1, 2000, ENGLISH + GERMAN)]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(5, prose(99, 30, FRENCH), "fr"), (5, rows[5][1], "en")]
    docs = table(spark, rows)
    learned = collections.defaultdict(collections.Counter)
    for r in language.learned_rows(docs).collect():
        learned[r["lang"]] += grams(r["text"])
    profiles = {name: ranked(counts, size) for name, counts in learned.items()}
    assert language.train_profiles(language.learned_rows(docs), size) == profiles
    found = language.identify(docs, profiles, size).collect()
    assert len(found) == len(rows)
    for r in found:
        lang, score, margin = predicted(r["text"], profiles, size)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-12) and r["margin"] == pytest.approx(margin, abs=1e-12), r["text"][:40]


@pytest.mark.parametrize("slice_chars", [1, 2, 5, 64, 100_000])
def test_long_texts_have_the_same_counts(monkeypatch, slice_chars):
    monkeypatch.setattr(language, "SLICE_CHARS", slice_chars)
    rnd = random.Random(slice_chars)
    for text in ["", "a", " a", "ab c", "ab\nc\td", "x" * 50, "ΑΣ. ΑΣΑ", "".join(rnd.choice("abcé 1\nΣ日İ") for _ in range(400))]:
        key, count = language.long_gram_counts(text)
        assert dict(zip(key.tolist(), count.tolist(), strict=True)) == grams(text)


# --- 6


def xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def winners(text):
    """(term, t) with the least bid for each sample."""
    counts = collections.Counter(xx(w.encode()) for w in text.split())
    out = []
    for sample in range(sampling.SAMPLES):
        def drawn(term, k):
            return xx(struct.pack("<i", k), xx(struct.pack("<Q", term)))

        def two(h):
            return ((h & 0xFFFFFFFF) + 0.5) * 2.0**-32 * ((h >> 32) + 0.5) * 2.0**-32

        best = None
        for term, n in counts.items():
            r = -math.log(two(drawn(term, sample)))
            c = math.log(-math.log(two(drawn(term, sample + 1000))))
            b = (drawn(term, sample + 2000) >> 11) * 2.0**-53
            t = math.floor(math.log(n) / r + b)
            bid = c - r * (t - b + 1)
            best = min(best or (bid, term, t), (bid, term, t))
        out.append(best and best[1:])
    return out


def test_samples_and_likeness_equal_a_plain_loop(spark):
    texts = {i: prose(i // 3, 40 + i, ENGLISH[: 8 + i]) for i in range(18)} | {30: "one", 31: "one one one", 40: "", 41: "ab cd"}
    texts[50] = texts[4]
    docs = table(spark, [(i, t, "en") for i, t in texts.items()])
    found = {r["doc_id"]: r for r in sampling.fingerprint_rows(docs).collect()}
    order = sorted(texts, reverse=True)
    follow = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    edited = {}
    for i, t in texts.items():
        part = len(t) // 3
        edited[i] = t[: len(t) - part] + texts[follow[i]][:part]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest() and found[i]["n_chars"] == len(t)
    own, other = {i: winners(t) for i, t in texts.items()}, {i: winners(t) for i, t in edited.items()}
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / sampling.SAMPLES
    for i, r in found.items():
        assert r["near_edited"] == same(own[i], other[i]) and r["near_next"] == same(own[i], own[follow[i]]), i
    parts = lambda p: [p[8 * k : 8 * k + 8] for k in range(sampling.SAMPLES)]
    for i in texts:
        for j in texts:
            assert [a == b for a, b in zip(parts(found[i]["fingerprint"]), parts(found[j]["edited_fingerprint"]), strict=True)] == [a == b for a, b in zip(own[i], other[j], strict=True)]


# --- 7


def removed(rows, size):
    """Which words of each (id, text) a window covers that starts in a smaller id too."""
    starts = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            if i is not None:
                starts[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - size + 1):
            if i is not None and min(starts[tuple(w[k : k + size])]) < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return collections.Counter(out)


def passages(seed, n):
    rnd = random.Random(seed)
    shared = [" ".join(prose(1000 + k, 20 + 3 * k, ENGLISH).split()) for k in range(6)]
    return [(i, " ".join(rnd.choice([prose(rnd.random(), rnd.randrange(1, 30), FRENCH), rnd.choice(shared)]) for _ in range(rnd.randrange(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("kind", ["unique ids", "ids with several texts"])
def test_windows_equal_a_plain_loop(spark, monkeypatch, kind):
    monkeypatch.setattr(windows, "SLICE_BYTES", 600)  # many texts are longer than a slice
    rows = passages(1, 60)
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "a " * 500), (205, "a " * 400), (None, rows[5][1]), (None, None)]
    if kind != "unique ids":
        rows += [(7, rows[8][1]), (7, rows[9][1] + " " + rows[9][1]), (7, rows[8][1]), (59, rows[7][1]), (-1, rows[30][1])]
    found = windows.remove_repeats(table(spark, [(i, t, "en") for i, t in rows])).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in found)
    assert got == removed(rows, windows.SIZE)


@pytest.mark.parametrize("bits", [12, 18])
def test_windows_of_one_hash_are_told_apart_by_their_check(spark, bits):
    rows = passages(2, 60)
    found = windows.remove_repeats(table(spark, [(i, t, "en") for i, t in rows]), bits=bits).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept_text"]) for r in found) == removed(rows, windows.SIZE)
