"""The pipeline's stages on planted documents, against what each must do."""

import random

import public_tokenizers
import pytest

import corpus_pipeline as cp
from visilake.llm import lattice

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def made_up(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(STEMS) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark of three items, as the stages read it."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, made_up(900 + i, 30)) for i in range(3)] + [(3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_language_keeps_what_has_letters(spark, folder):
    rows = [(i, made_up(i, 60), "a") for i in range(40)] + [(50, None, "a"), (51, "", "a"), (52, "123 456 !!", "a"), (None, made_up(60, 20), None)]
    kept = cp.keep_known_languages(spark, table(spark, rows), folder)
    assert kept.columns == list(cp.COLUMNS)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in range(40)] + [(True, None)]


def test_one_of_each_group_of_copies_stays(spark, folder):
    base = {i: made_up(100 + i, 150 + 40 * i) for i in range(12)}
    rows = [(i, t, "a") for i, t in base.items()]
    for i, t in base.items():
        words = t.split()
        rows.append((100 + i, t, "b"))  # exact
        rows.append((200 + i, " ".join([*words[:50], "changed", *words[51:]]).upper(), "b"))  # near: one word and letter case
        rows.append((300 + i, " ".join(words[: len(words) // 2]) + " " + made_up(500 + i, len(words)), "b"))  # a third is shared: stays
    rows += [(0, base[0], "a"), (None, base[1], "c"), (None, made_up(700, 80), "c"), (None, made_up(700, 80), "c"), (400, "", "a"), (401, None, "a"), (402, "one two", "a")]
    kept = cp.keep_one_of_copies(spark, table(spark, rows).repartition(3), folder).collect()
    ids = sorted((r["doc_id"] for r in kept if r["doc_id"] is not None))
    assert ids == sorted([*base, *[300 + i for i in base], 400, 402])
    assert [r["text"] for r in kept if r["doc_id"] is None] == [made_up(700, 80)]


@pytest.mark.parametrize("labels", ["none", "held out", "letterless"])
def test_language_keeps_letters_when_nothing_can_be_learned(spark, folder, labels):
    rows = [(i, made_up(i, 60), "a") for i in range(20)] + [(50, None, "a"), (51, "", "a"), (52, "123 456 !!", "a"), (53, "1 é", "a"), (None, made_up(60, 20), None)]
    docs = table(spark, rows)
    held_out = "crc32(cast(doc_id as string)) % 5 = 0"
    label = {"none": "cast(null as string)", "held out": f"if({held_out}, lang, null)", "letterless": "if(doc_id = 52, lang, null)"}[labels]
    kept = cp.keep_known_languages(spark, docs.selectExpr("doc_id", "text", f"{label} as lang", "source", "n_chars"), folder)
    assert kept.columns == list(cp.COLUMNS)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in [*range(20), 53]] + [(True, None)]


def shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_copies_are_judged_by_their_shingles(spark, folder):
    """Of 100 shingles 75 shared: both stay; 80 shared: one stays, whatever their fingerprints say."""
    rows = []
    for i in range(60):
        words = made_up(2000 + i, 104).split()
        rows += [(i, " ".join(words), "a"), (100 + i, " ".join(words[25 if i < 30 else 20 :]), "b")]
    assert all(len(shingles(rows[2 * i + 1][1])) / len(shingles(rows[2 * i][1])) == (0.75 if i < 30 else 0.8) for i in range(60))
    rows += [(200, "a b c d e f g h", "a"), (201, "a b c d e f g h i", "a"), (202, "A b c d\te " * 40, "a"), (203, "a b c d e " * 4, "a")]  # 4 of 5; equal sets
    kept = cp.keep_one_of_copies(spark, table(spark, rows).repartition(3), folder).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([*range(60), *range(100, 130), 200, 202])


def test_similar_groups_in_divided_keys(spark):
    """A hot key, divided over shards, finds the groups that comparing all pairs finds."""
    rnd = random.Random(3)
    head, rows = made_up(3000, 30).split(), []
    for i in range(30):
        own = made_up(3100 + i, 20).split()
        for _ in range(5):
            rows.append((len(rows), " ".join([*head[: rnd.randrange(20, 31)], *own[: rnd.randrange(2, 21)]])))
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = cp.simhash.similar_groups(docs, 5, 4, cp.KEYS, cp.CANDIDATE_BITS, cp.NEAR_BITS, cp.SIMILAR, shard_points=16).collect()
    assert 10 < len(set(label)) < 140 and {r["doc_id"]: r["component_id"] for r in made} == dict(enumerate(label))


def test_leaks_go_and_others_stay(spark, folder):
    items = [made_up(900 + i, 30) for i in range(3)]
    rows = [(i, made_up(i, 100), "a") for i in range(10)]
    rows += [(20 + i, made_up(30 + i, 40) + "\n" + t + " " + made_up(40 + i, 40), "a") for i, t in enumerate(items)]
    rows += [(30, made_up(1, 20) + " " + items[0].upper().replace("TH", "th", 3)[:-1] + " " + made_up(2, 20), "a"), (31, items[1][: len(items[1]) // 3], "a"), (20, "same id, clean " + made_up(8, 30), "a"), (None, None, None)]
    kept = cp.drop_benchmark_leaks(spark, table(spark, rows), folder).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [*range(10), 20, 31] and sum(r["doc_id"] is None for r in kept) == 1


def test_live_secrets_are_masked_in_place(spark, folder):
    own, shared = "q7W2e9R4t6Y1u8I3", "A1b2C3d4E5f6G7h8"
    rows = [(1, f"x token = {own}. y {own}", "a"), (2, "clean", "b"), (3, None, None)] + [(10 + i, f"secret: {shared}", f"s{i}") for i in range(5)]
    out = {r["doc_id"]: r for r in cp.mask_live_secrets(spark, table(spark, rows), folder).collect()}
    # the full stop belongs to the secret's signs, so the first value ends in one
    assert own + "." not in out[1]["text"] and cp.MARK in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "clean" and out[3]["text"] is None
    assert all(shared in out[10 + i]["text"] for i in range(5))


def test_run(spark, tmp_path):
    texts = [made_up(i, 120) for i in range(30)]
    table(spark, [(i, t, f"s{i % 7}") for i, t in enumerate(texts)] + [(90, texts[0], "s"), (91, None, "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, texts[5][100:400])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    decoded = {r["doc_id"]: r["decoded"] for r in lattice.decode(out, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert decoded == {i: t for i, t in enumerate(texts) if i != 5}


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_stages_take_extra_columns_and_very_long_texts(spark, folder):
    long = made_up(77, 60_000)
    rows = [(1, made_up(1, 80), "a"), (2, long, "a"), (3, long + " end", "b"), (4, made_up(4, 40) + "\n" + made_up(900, 30) + " " + made_up(5, 40), "a"), (5, long[:200_000] + " " + made_up(901, 30) + " " + made_up(6, 9000), "c"), (None, made_up(8, 30), None)]
    docs = table(spark, rows).selectExpr(
        "*", "1 AS row_name", "2 AS row_key", "'x' AS name", "3 AS node", "4 AS hash", "5 AS spans", "6 AS item_id", "7 AS start", "8 AS lang_pred", "9 AS score", "10 AS print", "11 AS size", "12 AS secret", "13 AS secrets")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == list(cp.COLUMNS), name
        ids = sorted((r["doc_id"] or 0) for r in kept.collect())
        assert ids == {"near_copies": [0, 1, 2, 4, 5], "leaks": [0, 1, 2, 3]}.get(name, [0, 1, 2, 3, 4, 5]), name
    assert sorted((r["doc_id"] or 0) for r in cp.STAGES[-1][1](spark, docs, folder).collect()) == [0, 1, 2, 3, 4, 5]


def test_language_drops_what_is_far_from_every_profile(spark, folder):
    rows = [(i, made_up(i, 60), "a") for i in range(40)]
    strange = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "いろはにほへと ちりぬるを わかよたれそ " * 5]
    rows += [(100 + i, t, "a") for i, t in enumerate(strange)] + [(200, "Съешь", "a"), (201, "いろは 123", "a"), (202, made_up(3, 30) + " Съешь же ещё", "a"), (203, made_up(4, 2).upper() + "!!", "a")]
    kept = sorted(r["doc_id"] for r in cp.keep_known_languages(spark, table(spark, rows), folder).collect())
    assert kept == [*range(40), 200, 201, 202, 203]


def test_short_benchmark_items_are_no_leak(spark, tmp_path):
    spark.createDataFrame([(1, "Paris"), (2, "two words"), (3, "three short words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "in Paris there are two words", "a"), (2, "here: Three  short\nwords.", "a"), (3, "three short wordsmiths", "a")]
    assert sorted(r["doc_id"] for r in cp.drop_benchmark_leaks(spark, table(spark, rows), str(tmp_path)).collect()) == [1, 3]
