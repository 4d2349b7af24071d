"""Demand payloads (JSON) to typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

_PHRASES = "array<struct<phrase:string,count:string>>"
_ANSWER = f"struct<_error:string,totalCount:string,results:{_PHRASES},associations:{_PHRASES}>"
_SERIES = "struct<_error:string,results:array<struct<date:string,count:string,share:string>>>"
_REGIONS = "struct<_error:string,results:array<struct<region:string,count:string,share:string,affinityIndex:string>>>"


def _whole(col):
    """A count that may come as text; unreadable is zero."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def keyword_frequencies_from_json(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Demand of the asked phrase: zero stays zero, an error is NULL."""
    answer = F.from_json(F.col(payload), _ANSWER)
    keep = [c for c in raw.columns if c != payload]
    return raw.select(*keep, answer.alias("_a")).select(
        *keep,
        F.when(F.col("_a._error").isNull(), _whole(F.col("_a.totalCount"))).alias("freq"),
        F.col("_a._error").alias("error"),
    )


def keyword_expansions_from_json(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Suggested phrases in answer order: refinements (``top``), then associations."""
    keep = [c for c in raw.columns if c != payload]
    nothing = F.array().cast(_PHRASES)

    def kind(field, name):
        return F.transform(
            F.coalesce(F.col(f"_a.{field}"), nothing),
            lambda r, i: F.struct(
                F.lit(name).alias("kind"),
                (i + 1).cast("int").alias("place"),
                F.coalesce(r["phrase"], F.lit("")).alias("phrase"),
                _whole(r["count"]).alias("freq"),
            ),
        )

    parsed = raw.select(*keep, F.from_json(F.col(payload), _ANSWER).alias("_a")).where("_a._error IS NULL")
    return parsed.select(*keep, F.inline(F.concat(kind("results", "top"), kind("associations", "association"))))


def keyword_snapshot(lines: DataFrame) -> DataFrame:
    """Demand by seed from the newest snapshot among stored lines, newest by name.

    ``lines``: file, line_no (any order of the lines of a file), value (one JSON document). Unreadable
    lines and error rows are left out; the last line of a seed counts; older files are read for
    their names only.
    """
    newest = lines.where(F.col("file") == lines.agg(F.max("file")).scalar())
    return _snapshot_rows(newest.select("value", F.struct("line_no").alias("at")))


def latest_keyword_snapshot(spark, folder: str) -> DataFrame:
    """:func:`keyword_snapshot` of the newest JSONL file of a folder.

    The driver picks the newest path from a listing of names; older files stay unread.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wordstat-*.jsonl").load(folder)
    newest = files.agg(F.max_by("path", F.element_at(F.split("path", "/"), -1))).first()[0]
    if newest is None:
        return spark.createDataFrame([], "seed string, freq long")
    return _snapshot_rows(spark.read.text(newest).select("value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")))


def _snapshot_rows(lines: DataFrame) -> DataFrame:
    """(seed, freq) from (value, at): the last good line of each seed."""
    row = "struct<seed:string,response:struct<_error:string,totalCount:string>>"
    read = lines.select("at", F.try_parse_json(F.trim("value")).isNotNull().alias("readable"), F.from_json(F.trim("value"), row).alias("r"))
    return (
        read.where("readable AND r.response._error IS NULL")
        .groupBy(F.coalesce("r.seed", F.lit("")).alias("seed"))
        .agg(F.max_by(_whole(F.col("r.response.totalCount")), "at").alias("freq"))
    )


def demand_dynamics(raw: DataFrame, payload: str = "response") -> DataFrame:
    """Time series of a phrase; an unreadable share is NULL."""
    keep = [c for c in raw.columns if c != payload]
    points = raw.select(*keep, F.from_json(F.col(payload), _SERIES).alias("_a")).where("_a._error IS NULL")
    return points.select(*keep, F.explode("_a.results").alias("_p")).select(
        *keep,
        F.coalesce("_p.date", F.lit("")).alias("date"),
        F.to_date(F.try_to_timestamp(F.col("_p.date"))).alias("day"),
        _whole(F.col("_p.count")).alias("count"),
        F.col("_p.share").try_cast("double").alias("share"),
    )


def demand_by_region(raw: DataFrame, names: DataFrame | None = None, payload: str = "response") -> DataFrame:
    """Demand by region with its share and affinity; names come from the region tree."""
    keep = [c for c in raw.columns if c != payload]
    rows = raw.select(*keep, F.from_json(F.col(payload), _REGIONS).alias("_a")).where("_a._error IS NULL")
    out = rows.select(*keep, F.explode("_a.results").alias("_r")).select(
        *keep,
        F.coalesce("_r.region", F.lit("")).alias("region_id"),
        _whole(F.col("_r.count")).alias("count"),
        F.col("_r.share").try_cast("double").alias("share"),
        F.col("_r.affinityIndex").try_cast("double").alias("affinity"),
    )
    if names is None:
        return out
    return out.join(names.select(F.col("id").alias("region_id"), "label"), "region_id", "left")


def flatten_region_tree(raw: DataFrame, payload: str = "response") -> DataFrame:
    """All (id, label, level) of a nested tree of any depth, beside the other columns of ``raw``.

    One step a level, lineage cut at each; the walk ends with the first level without nodes.
    """
    tvf = raw.sparkSession.tvf
    keep = [c for c in raw.columns if c != payload]

    def below(rows: DataFrame, path: str, level: int) -> DataFrame:
        nodes = rows.lateralJoin(tvf.variant_explode(F.variant_get(F.col("_node").outer(), path, "variant")))
        return checkpointed(nodes.select(*keep, F.col("value").alias("_node"), F.lit(level).alias("level")))

    depth, found = 1, None
    level = below(raw.where(f"get_json_object({payload}, '$._error') IS NULL").select(*keep, F.try_parse_json(F.col(payload)).alias("_node")), "$.regions", 1)
    while found is None or not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        depth += 1
        level = below(level, "$.children", depth)
    text = lambda path: F.coalesce(F.try_variant_get("_node", path, "string"), F.lit(""))
    return found.select(*keep, text("$.id").alias("id"), text("$.label").alias("label"), "level")
