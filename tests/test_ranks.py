"""Ranks: medians, samples, history, noise and run planning."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from visilake.functions import lists as L
from visilake.operators import ranks as R
from visilake.operators import serp as S
from visilake.session import local_session

D = lambda day, hour=0: dt.datetime(2024, 1, day, hour)

MEDIANS = [
    ([5, 3, 7], 5), ([5], 5), ([3, 7], 3), ([5, None, None], None), ([5, 6, None], 6), ([5, None], None), ([None, None], None), ([], None),
]


@pytest.mark.parametrize("samples, expected", MEDIANS)
def test_median_of_samples(spark, samples, expected):
    rows = spark.createDataFrame([(samples,)], "s array<int>")
    assert rows.select(R.median_of_samples(F.col("s"))).first()[0] == expected


def test_median_aggregate_follows_the_same_table(spark):
    rows = [(str(i), v) for i, (s, _) in enumerate(MEDIANS) for v in s]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k string, position int").groupBy("k").agg(R.median_position("position").alias("m")).collect()}
    assert got == {str(i): e for i, (s, e) in enumerate(MEDIANS) if s}


def serp(spark, hits, errors=()):
    """Snapshots 1..n of one query; ``hits`` gives our place in each (None = absent)."""
    snaps = [(i, "окна", 225, "r1", D(1, i), "timeout" if i in errors else None) for i in range(1, len(hits) + 1)]
    docs = []
    for i, place in enumerate(hits, 1):
        docs.append((i, 1, None, True, "https://yandex.ru/video", "yandex.ru"))
        docs += [(i, p + 1, p, False, f"https://{'www.example.ru' if p == place else f's{p}.ru'}/{i}", "WWW.example.ru" if p == place else f"s{p}.ru") for p in range(1, 9)]
    return (
        spark.createDataFrame(snaps, "snapshot_id long, query string, region int, run_id string, fetched_at timestamp, error string"),
        spark.createDataFrame(docs, "snapshot_id long, position int, organic_position int, is_wizard boolean, url string, domain string"),
    )


def test_measure_median_spread_and_representative(spark):
    row = R.measure(*serp(spark, [5, 3, 5, 4], errors=(4,)), "www.example.ru").first()
    assert (row.median, row.min, row.max, row.found_in, row.snapshots, row.failed) == (5, 3, 5, 3, 3, 1)
    assert [(s.position, s.n) for s in row.samples] == [(3, 1), (5, 2)]
    assert (row.snapshot_id, row.url) == (1, "https://www.example.ru/1")


def test_measure_absent_median_takes_first_snapshot(spark):
    row = R.measure(*serp(spark, [None, 4, None]), "example.ru").first()
    assert (row["median"], row["min"], row["snapshot_id"], row["url"]) == (None, 4, 1, None)


def test_record_positions_writes_absence_and_median(spark):
    snaps, docs = serp(spark, [5, 3, 5])
    chosen = R.representative_snapshot(R.measure(snaps, docs, "example.ru"))
    rows = {r.domain: r for r in R.record_positions(chosen, docs, ["example.ru", "s1.ru", "absent.ru"], primary="example.ru").collect()}
    assert {d: r.position for d, r in rows.items()} == {"example.ru": 5, "s1.ru": 1, "absent.ru": None}
    assert rows["s1.ru"].samples is None and len(rows["example.ru"].samples) == 2


def positions(spark, rows):
    return spark.createDataFrame(
        [(i, q, 225, "example.ru", p, None, D(d), [(x, 1) for x in s] if s else None) for i, (q, p, d, s) in enumerate(rows)],
        "id long, query string, region int, domain string, position int, url string, checked_at timestamp, samples " + R.SAMPLES,
    )


def test_latest_positions_delta_and_noise(spark):
    latest = {
        r.query: r
        for r in R.latest_positions(
            positions(spark, [("a", 9, 1, None), ("a", 7, 2, None), ("a", 5, 3, [4, 5, 8]), ("b", None, 1, None), ("b", 4, 2, [4, 4]), ("c", 3, 1, None), ("c", 3, 2, [2, 9]), ("d", 20, 1, None), ("d", 5, 2, [5, 6])]),
            "www.example.ru", 225,
        ).collect()
    }
    a, b, c, d = latest["a"], latest["b"], latest["c"], latest["d"]
    assert (a.position, a.previous, a.delta, a.spread_low, a.spread_high, a.within_noise, a.measurements) == (5, 7, 2, 4, 8, True, 3)
    assert (b.delta, b.spread_low, b.within_noise) == (None, None, False)
    assert (c.delta, c.within_noise) == (0, False)
    assert (d.delta, d.within_noise) == (15, False)
    assert [r.query for r in R.movers(spark.createDataFrame([a, b, c, d], R.latest_positions(positions(spark, [("a", 1, 1, None)]), "example.ru").schema)).collect()] == ["d", "a"]


def test_calibration(spark):
    rows = [(1, 225, "example.ru", 3, 5, D(1)), (2, 225, "example.ru", 9, 4, D(2)), (3, 225, "example.ru", None, 4, D(3)), (4, 225, "example.ru", 0, 4, D(3))]
    r = R.calibration_report(spark.createDataFrame(rows, "id int, region int, domain string, seen_position int, api_position int, checked_at timestamp"), "example.ru").first()
    assert (r.checks, r.comparable, r.avg_offset, r.max_offset, r.trustworthy) == (4, 2, -1.5, -5, False)


def test_measurement_plan_and_gate(spark):
    queries = spark.createDataFrame([("Окна ", 0), ("окна", 1), ("двери", 2), ("полы", 3), (" ", 4)], "query string, ord int")
    ranks = positions(spark, [("окна", 3, 1, None), ("двери", None, 1, None)])
    plan = R.measurement_plan(queries, R.latest_positions(ranks, "example.ru"), n=30)
    assert {r["query"]: (r.state, r.samples, r.calls) for r in plan.collect()} == {"Окна ": ("hot", 3, 9), "двери": ("cold", 1, 3), "полы": ("new", 3, 9)}
    gate = R.run_gate(plan, ranks, "example.ru", 225, "2024-01-05 12:00:00", rate=0.0305).first()
    assert (gate.calls, gate.due, gate.stopped, gate.days_passed) == (21, False, "too_early", 4.5) and gate.cost == pytest.approx(0.6405)
    assert R.run_gate(plan, ranks, "example.ru", 225, "2024-02-05 00:00:00", cap=20).first().stopped == "over_cap"
    assert R.run_gate(plan, ranks, "other.ru", 225, "2024-01-05 00:00:00").first().stopped is None


def test_competition_score(spark):
    as_of = dt.datetime(2024, 6, 1)
    ago = lambda days: (as_of - dt.timedelta(days=days)).strftime("%Y%m%dT%H%M%S")
    docs = [
        (1, "окна москва", 225, 1, 1, False, "example.ru", 2, 1, 50, ago(10)),
        (1, "окна москва", 225, 2, 2, False, "vk.com", 1, 0, 1000, ago(20)),
        (1, "окна москва", 225, 3, 3, False, "another.ru", 0, 2, 5, ago(3 * 365)),
        (1, "окна москва", 225, 4, 4, False, "site4.ru", 2, 0, 20, None),
        (1, "окна москва", 225, 5, 5, False, "site5.ru", 1, 3, 2, ago(5)),
        (1, "окна москва", 225, 6, None, True, "yandex.ru", 2, 0, 9, None),
    ]
    frame = spark.createDataFrame(
        docs, "snapshot_id long, query string, region int, position int, organic_position int, is_wizard boolean, domain string, title_hlwords int, url_depth int, domain_doccount long, modtime string"
    ).withColumn("error", F.lit(None).cast("string")).withColumn("url", F.lit("u"))
    row = S.competition_score(frame, as_of.isoformat(" "), our_domain="site4.ru").first()
    assert (row.title_fit, row.depth_coverage, row.portal_share, row.homepage_share, row.freshness) == (0.6, 0.441, 0.2, 0.4, 0.75)
    assert (row.score, row.band, row.our_position, row.docs_analysed) == (48.2, L.BAND_MIDDLE, 4, 5)
    bands = spark.createDataFrame([(29.9,), (30.0,), (60.0,), (60.1,), (None,)], "s double").select(S.competition_band("s"))
    assert [r[0] for r in bands.collect()] == [L.BAND_LOW, L.BAND_MIDDLE, L.BAND_MIDDLE, L.BAND_HIGH, L.BAND_NONE]


def test_gap_puts_missing_queries_first(spark):
    rows = [(1, "a", 1, "their.ru", D(1), 2), (1, "a", 1, "our.ru", D(1), 4), (2, "b", 1, "their.ru", D(1), 9), (3, "a", 1, "their.ru", D(2), 5), (4, "c", 1, "their.ru", D(3), 1)]
    docs = spark.createDataFrame(rows, "snapshot_id long, query string, region int, domain string, fetched_at timestamp, position int").withColumn(
        "error", F.when(F.col("snapshot_id") == 4, "timeout")
    )
    assert [tuple(r) for r in S.competitor_gap(docs, "our.ru", "www.their.ru").collect()] == [("b", 9, None, "missing"), ("a", 5, 4, "we")]


def test_the_newest_two_are_one_state_of_one_read(spark, tmp_path):
    """Ties in time go by id, nulls are oldest, hot keys are combined before they move; against a plain loop."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([1, 2]), rnd.choice([None, *[dt.datetime(2024, 1, d) for d in range(1, 6)]]), rnd.choice([None, 1, 5, 9])) for i in range(400)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "id int, query string, region int, checked_at timestamp, position int").repartition(6).write.parquet(path)
    found = R.newest_two(spark.read.parquet(path), ["query", "region"], F.struct("checked_at", "id", "position"))
    plan = found._jdf.queryExecution().executedPlan().toString()  # before it runs
    want = {}
    for key in {(q, r) for _, q, r, _, _ in rows}:
        mine = sorted(((t is not None, t, i, p) for i, q, r, t, p in rows if (q, r) == key), key=lambda x: (x[0], x[1] or dt.datetime.min, x[2]), reverse=True)
        want[key] = ([m[2] for m in mine[:2]], len(mine))
    got = {(r["query"], r["region"]): ([x["id"] for x in (r["cur"], r["prev"]) if x is not None], r["measurements"]) for r in found.collect()}
    assert got == want
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    one = R.newest_two(spark.read.parquet(path).limit(1), ["query"], F.struct("checked_at", "id")).first()
    assert one["prev"] is None and one["measurements"] == 1
    assert R.newest_two(spark.read.parquet(path).where("false"), ["query"], F.struct("checked_at", "id")).collect() == []
