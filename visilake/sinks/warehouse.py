"""Stored tables: appends, keyed upserts, load windows and totals.

What replaces stored rows goes through a :class:`~visilake.sinks.versions.Store`: readers see the
version before a load or the one after it, never rows in between, and a load that fails changes nothing.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from .versions import Store

CORE, EDGE, DROP = "ядро", "периферия", "отбросить"


# --- appends --------------------------------------------------------------------------


def latest_docs(docs: DataFrame, ingest: str = "ingested_at") -> DataFrame:
    """One document per (snapshot, position): a repeated delivery replaces the earlier one."""
    rest = [c for c in docs.columns if c not in ("snapshot_id", "position")]
    newest = F.max(F.struct(ingest, *[c for c in rest if c != ingest])).alias("d")
    return docs.groupBy("snapshot_id", "position").agg(newest).select("snapshot_id", "position", *[F.col(f"d.{c}").alias(c) for c in rest])


def append_snapshots(rows: DataFrame, path: str, time_column: str, partition: str = "dt") -> None:
    """Append measurement facts under a date partition."""
    rows.withColumn(partition, F.to_date(time_column)).write.mode("append").partitionBy(partition).parquet(path)


def docs_store(spark: SparkSession, path: str, partition: str = "dt") -> Store:
    return Store(spark, path, {"docs": partition})


def append_docs(docs: DataFrame, path: str, time_column: str = "fetched_at", ingest: str = "ingested_at", partition: str = "dt") -> int:
    """Append documents; a (snapshot, position) slot delivered again replaces the stored one. The new version.

    A slot stays in the partition of its first delivery, and only partitions that hold a
    slot of the new rows' snapshots are written anew.
    """
    store = docs_store(docs.sparkSession, path, partition)

    def build(manifest: dict):
        new = docs.withColumn(partition, F.to_date(time_column))
        old = store.read("docs", manifest=manifest)
        if old is not None:
            held = old.join(new.select("snapshot_id").distinct(), "snapshot_id", "left_semi").select(partition).distinct()
            days = held.unionByName(new.select(partition).distinct()).distinct()
            new = old.join(days, partition, "left_semi").select(new.columns).unionByName(new)
        first = F.min(partition).alias(partition)
        rest = [c for c in new.columns if c not in ("snapshot_id", "position", partition)]
        newest = F.max(F.struct(ingest, *[c for c in rest if c != ingest])).alias("d")
        rows = new.groupBy("snapshot_id", "position").agg(newest, first).select("snapshot_id", "position", *[F.col(f"d.{c}").alias(c) for c in rest], partition)
        return {"docs": rows}, None

    return store.change(build)


# --- upserts --------------------------------------------------------------------------


def upsert_window(base: DataFrame, new: DataFrame, keys: list[str], newest: str = "fetched_at") -> DataFrame:
    """Keyed upsert where a new NULL never overwrites a measured value.

    One pre-combined aggregation of the union; the window dates belong to ``keys``.
    """
    values = [c for c in base.columns if c not in keys]
    both = base.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_s", newest)
    measured = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values if c != newest]
    out = both.groupBy(*keys).agg(*measured, F.max_by(newest, order).alias(newest))
    return out.select(*base.columns)


def window_store(spark: SparkSession, path: str, partition: str = "date_to") -> Store:
    return Store(spark, path, {"rows": partition, "totals": partition})


def totals_of(rows: DataFrame, group: list[str], partition: str = "date_to", newest: str = "fetched_at", measures: tuple[str, ...] = ("shows", "clicks")) -> DataFrame:
    """Totals of each group's every load window: partial sums a later choice of windows only picks from."""
    return rows.groupBy(*group, "date_from", partition).agg(
        F.max(newest).alias(newest), F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in measures])


def save_window(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str = "date_to", newest: str = "fetched_at",
    totals: list[str] | None = None, measures: tuple[str, ...] = ("shows", "clicks"),
) -> int:
    """Upsert into a stored table, writing only the partitions the new rows fall in. The new version.

    ``totals``: columns (such as ``["host_id"]``) whose totals by load window are stored beside the rows, in the same
    version; only windows of the written partitions are summed again, from the rows just written.
    """
    store = window_store(spark, path, partition)

    def build(manifest: dict):
        stored = store.read("rows", manifest=manifest)
        base = new.limit(0) if stored is None else stored.join(new.select(partition).distinct(), partition, "left_semi")
        made = {"rows": upsert_window(base, new, keys, newest)}
        if totals:
            made["totals"] = lambda staged: totals_of(store.staged_rows(staged, "rows"), totals, partition, newest, measures)
        return made, None

    return store.change(build)


def stored_totals(store: Store, group: list[str], version: int | None = None) -> DataFrame | None:
    """:func:`window_totals` from the stored totals of :func:`save_window`: the rows themselves are not read."""
    state = store.read("totals", version)
    if state is None:
        return None
    order = F.struct("date_to", "fetched_at", (-F.unix_date("date_from")).alias("length"))
    rest = [c for c in state.columns if c not in group]
    return state.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("t")).select(*group, "t.*")


def core_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"core": "project_id"})


def save_core(spark: SparkSession, path: str, project_id: int, new: DataFrame, min_measured: float = 0.5) -> int:
    """Upsert a project's collected core (:func:`upsert_core`), unless too few of its rows have a frequency. The new version.

    "No data" is not "no demand": a load in which less than ``min_measured`` of the rows have a
    frequency raises :class:`~visilake.sinks.versions.Rejected`. The share is observed while the rows
    are written, so the input is computed once.
    """
    store = core_store(spark, path)

    def build(manifest: dict):
        seen = Observation()
        mine = new.where(F.col("project_id") == project_id)
        watched = mine.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("freq").alias("measured"))
        stored = store.read("core", manifest=manifest)
        base = None if stored is None else stored.where(F.col("project_id") == project_id)
        rows = watched if base is None else upsert_core(base, watched).select(new.columns)

        def guard():
            try:
                counts = seen.get
            except Py4JJavaError:  # Spark saw that there are no rows and observed nothing
                counts = {"rows": 0, "measured": 0}
            return counts, counts["rows"] == 0 or counts["measured"] >= min_measured * counts["rows"]

        return {"core": rows}, guard

    return store.change(build)


def upsert_core(base: DataFrame, new: DataFrame) -> DataFrame:
    """Keyword-core upsert on (project_id, phrase).

    "Drop" comes from rules and always wins; a pass that measured nothing cannot demote a
    phrase that reached the core; measured fields are replaced only by measured ones.
    """
    b, n = base.alias("b"), new.alias("n")
    joined = b.join(n, ["project_id", "phrase"], "full_outer")
    has_new = F.col("n.verdict").isNotNull()

    def newer(c: str) -> Column:
        return F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    def measured(c: str) -> Column:
        return F.coalesce(f"n.{c}", f"b.{c}").alias(c)

    verdict = (
        F.when(~has_new, F.col("b.verdict"))
        .when(F.col("n.verdict") == DROP, F.col("n.verdict"))
        .when(F.col("n.competition").isNull() & F.col("n.our_position").isNull() & (F.col("b.verdict") == CORE), F.col("b.verdict"))
        .otherwise(F.col("n.verdict"))
    )
    domains = F.when(has_new & (F.size("n.top_domains") > 0), F.col("n.top_domains")).otherwise(F.coalesce("b.top_domains", "n.top_domains"))
    return joined.select(
        "project_id", "phrase", newer("kind"), newer("freq"), newer("source"),
        measured("commercial"), measured("competition"), measured("our_position"),
        domains.alias("top_domains"), verdict.alias("verdict"), newer("reason"), newer("collected_at"),
    )


# --- load windows ---------------------------------------------------------------------


def latest_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The one load window per key: latest end, then latest load, then the longer one."""
    windows = rows.groupBy(*keys, "date_from", "date_to").agg(F.max("fetched_at").alias("fetched_at"))
    order = F.struct("date_to", "fetched_at", (-F.unix_date("date_from")).alias("length"))
    return windows.groupBy(*keys).agg(F.max_by(F.struct("date_from", "date_to"), order).alias("w")).select(*keys, "w.date_from", "w.date_to")


def latest_window(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the latest load window; two windows are never mixed."""
    return rows.join(latest_windows(rows, keys), [*keys, "date_from", "date_to"], "left_semi")


def search_queries_map(rows: DataFrame) -> DataFrame:
    """Latest window keyed by the lower-case query text."""
    return latest_window(rows, ["host_id"]).withColumn("query_key", K.squeezed("query"))


def landing_pages_map(rows: DataFrame) -> DataFrame:
    """Latest landing-page window keyed by path; of several spellings the most visited is kept last."""
    latest = latest_window(rows, ["counter", "source"]).withColumn("path_key", K.normalize_path("url"))
    rest = [c for c in latest.columns if c not in ("counter", "source", "path_key")]
    pick = F.min_by(F.struct(*rest), F.struct(F.coalesce("visits", F.lit(-1)), "url"))
    return latest.groupBy("counter", "source", "path_key").agg(pick.alias("r")).select("counter", "source", "path_key", "r.*")


def window_totals(rows: DataFrame) -> DataFrame:
    """Queries, shows and clicks of each host's own latest window."""
    return latest_window(rows, ["host_id"]).groupBy("host_id", "date_from", "date_to").agg(
        F.max("fetched_at").alias("fetched_at"), F.count(F.lit(1)).alias("queries"),
        F.sum("shows").alias("shows"), F.sum("clicks").alias("clicks"),
    )


def warehouse_stats(tables: dict[str, DataFrame], snapshots: DataFrame, search_queries: DataFrame) -> DataFrame:
    """Row counts by table, first and last snapshot, owner totals: (metric, value)."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.col("value").cast("string").alias("value")) for name, df in tables.items()]
    span = snapshots.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"))
    parts.append(span.select(F.inline(F.array(
        F.struct(F.lit("first_snapshot").alias("metric"), F.date_format("a", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("last_snapshot").alias("metric"), F.date_format("b", "yyyy-MM-dd").alias("value")),
    ))))
    totals = window_totals(search_queries).agg(F.coalesce(F.sum("shows"), F.lit(0)).alias("s"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("c"))
    parts.append(totals.select(F.inline(F.array(
        F.struct(F.lit("shows_all_hosts").alias("metric"), F.col("s").cast("string").alias("value")),
        F.struct(F.lit("clicks_all_hosts").alias("metric"), F.col("c").cast("string").alias("value")),
    ))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pages_by_query_latest(rows: DataFrame) -> DataFrame:
    """Last page of every query, by the query's own latest load rather than one global window."""
    own_last = rows.groupBy("host_id", "query").agg(F.max("date_to").alias("date_to"))
    kept = rows.join(own_last, ["host_id", "query", "date_to"], "left_semi").where(F.coalesce(F.trim("url"), F.lit("")) != "")
    rest = [c for c in rows.columns if c != "host_id"]
    order = F.struct("date_to", "fetched_at", (-F.unix_date("date_from")).alias("length"), "query", "url")
    return (
        kept.groupBy("host_id", K.squeezed("query").alias("query_key"))
        .agg(F.max_by(F.struct(*rest), order).alias("r")).select("host_id", "query_key", "r.*")
    )
