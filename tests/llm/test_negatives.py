"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from visilake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vector(rnd, dim, scale=0.15):
    return [float(np.float32(rnd.gauss(0, scale))) for _ in range(dim)]


def brute(rows, every, positives=5, least=30, most=90, k=10):
    kept = {}
    for vec_id, parts, label in rows:
        if vec_id is None or parts is None or label is None or any(x is None or not math.isfinite(x) for x in parts):
            continue
        scaled = [math.floor(max(-(2.0**24), min(2.0**24, 256 * x))) for x in parts]
        kept[vec_id] = min(kept.get(vec_id, (label, scaled)), (label, scaled))
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))  # noqa: B905, E731
    out = set()
    for a in kept:
        if a % every:
            continue
        order = sorted((b for b in kept if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in order if kept[b][0] == kept[a][0]][:positives]:
            s = score(a, p)
            found = [b for b in order if kept[b][0] != kept[a][0] and least * s <= 100 * score(a, b) <= most * s][:k]
            out |= {(a, p, i + 1, b, s, score(a, b)) for i, b in enumerate(found)}
    return out


def check(spark, rows, every=10, **more):
    made = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=every, **more)
    found = [tuple(r) for r in made.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, every)
    return found


@pytest.mark.parametrize(("dim", "block"), [(64, 8192), (64, 37), (10, 50), (100, 8192)])
def test_equal_to_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", max(3, block // 8))
    rnd = random.Random(dim)
    assert check(spark, [(i, vector(rnd, dim), rnd.randrange(3)) for i in range(250)])


def test_ties_copies_and_a_hot_label(spark):
    rnd = random.Random(1)
    one, two = vector(rnd, 64), vector(rnd, 64)
    mixed = [float(np.float32(0.6 * a + 0.4 * b)) for a, b in zip(one, two, strict=True)]
    rows = [(i, one, 0) for i in range(60)] + [(100 + i, mixed, 1) for i in range(60)] + [(300 + i, vector(rnd, 64), i % 2) for i in range(80)]
    found = check(spark, rows)
    assert {r[1] for r in found if r[0] == 0} <= {1, 2, 3, 4, 5}  # the smallest ids among equal scores


def test_odd_rows(spark):
    rnd = random.Random(2)
    good = [(i, vector(rnd, 64), i % 3) for i in range(60)]
    odd = [(100, None, 1), (101, vector(rnd, 64), None), (None, vector(rnd, 64), 1), (102, [*vector(rnd, 63), None], 1), (103, [*vector(rnd, 63), float("nan")], 1), (104, [float("inf"), *vector(rnd, 63)], 1),
           (110, [], 1), (120, vector(rnd, 5), 2), (130, [0.0] * 64, 0), (140, [3e30] * 64, 1), (150, [-3e4, 3e4] * 32, 1), good[3], (4, vector(rnd, 64), 0), (4, vector(rnd, 64), 2)]
    check(spark, good + odd)


def test_small_tables(spark):
    empty = negatives.hard_negatives(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.negative_rows(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).collect() == []
    assert negatives.negative_rows(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(0, [1.0], 0, 7, 8), (1, [1.0], 1, 7, 8), (2, [0.5], 0, 7, 8), (3, [0.4], 1, 7, 8)], SCHEMA + ", parts int, score int")
    # ids 0 and 7 take the next label: 0 joins label 1
    assert [tuple(r) for r in negatives.negative_rows(clash).orderBy("positive_id", "rank").collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_intervals_hold_the_scores():
    rnd = np.random.default_rng(3)
    for dim in (64, 128):
        for x in (rnd.integers(-300, 300, (200, dim)), rnd.integers(-(1 << 24), 1 << 24, (50, dim)), np.eye(dim, dtype=np.int64) * 77, np.ones((3, dim), np.int64)):
            turned = negatives.rotated(x)
            assert ((turned @ turned[0]) == dim * (x @ x[0])).all() if np.abs(x).max() < 1000 else True
            codes, along, rest = negatives.coded(turned)
            import pyarrow as pa

            table = pa.table({"vec_id": np.arange(len(x)), "label": np.zeros(len(x), np.int64), "parts": list(x), "codes": [c.tobytes() for c in codes], "along": list(along), "rest": rest})
            rows = negatives.Rows(table, dim)
            for i in range(min(5, len(x))):
                _, least, most = rows.interval(turned[i], slice(None))
                exact = x.astype(object) @ x[i].astype(object)
                assert all(lo <= s <= hi for lo, s, hi in zip(least, exact, most, strict=True))
