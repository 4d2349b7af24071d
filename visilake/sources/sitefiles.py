"""Site files: robots.txt, sitemaps and llms.txt."""

from __future__ import annotations

import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions import lists as L
from ..session import checkpointed
from . import xml

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots.txt text to numbered groups: (site, group_no, agents, kind, path, line_no, line).

    A group starts at the first ``User-agent`` after a rule or a blank line; a blank line
    closes it. Rules outside a group do not count. The windows stay within one file.
    """
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), _LINE_ENDS)).alias("i", "raw"))
    body = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key = F.when(F.contains(body, F.lit(":")), F.lower(F.trim(F.substring_index(body, ":", 1))))
    kind = (
        F.when(F.col("raw") == "", "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), key)
    )
    events = lines.select(
        "site", (F.col("i") + 1).alias("line_no"), F.trim("raw").alias("line"), kind.alias("kind"),
        F.trim(F.regexp_replace(body, "^[^:]*:", "")).alias("value"),
    ).where("kind IS NOT NULL")
    file_order = W.partitionBy("site").orderBy("line_no")
    agent = F.col("kind") == "agent"
    marked = events.withColumn("_blanks", F.count_if(F.col("kind") == "blank").over(file_order)).withColumn(
        "_start", (agent & ~F.coalesce(F.lag("kind").over(file_order) == "agent", F.lit(False))).cast("int")
    )
    grouped = marked.withColumn("group_no", F.sum("_start").over(file_order)).withColumn(
        "_open", F.last(F.when(agent, F.col("_blanks")), ignorenulls=True).over(file_order)
    )
    inside = grouped.where((F.col("kind") != "blank") & (F.col("group_no") > 0) & (F.col("_blanks") == F.col("_open")))
    group = W.partitionBy("site", "group_no")
    agents = F.transform(
        F.array_sort(F.collect_list(F.when(agent, F.struct("line_no", "value", "line"))).over(group)),
        lambda a: F.struct(a["line_no"].alias("line_no"), F.lower(K.percent_decode(a["value"])).alias("agent"), a["line"].alias("line")),
    )
    return (
        inside.withColumn("agents", agents)
        .where(F.col("kind") != "agent")
        .select("site", "group_no", "agents", "kind", K.percent_decode("value").alias("path"), "line_no", "line")
    )


def declared_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap addresses named in robots.txt."""
    lines = robots.select("site", F.explode(F.split(F.coalesce("text", F.lit("")), _LINE_ENDS)).alias("raw"))
    return (
        lines.where(F.lower(F.trim("raw")).startswith("sitemap:"))
        .select("site", F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("url"))
        .where("url <> ''")
        .distinct()
    )


# --- sitemaps -----------------------------------------------------------------------

_MAP = T.StructType(
    [
        T.StructField("is_index", T.BooleanType()),
        T.StructField("locs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _unpacked(body: bytes, max_bytes: int) -> bytes:
    if body[:2] != b"\x1f\x8b":
        return body
    reader = zlib.decompressobj(31)
    out = reader.decompress(body, max_bytes + 1)
    if len(out) > max_bytes:
        raise OverflowError(f"more than {max_bytes} bytes unpacked")
    return out


def _read_map(body, max_bytes: int = L.SITEMAP_UNPACKED_LIMIT, max_nodes: int = xml.MAX_NODES) -> dict:
    """What a map lists; of a map that breaks off at a bound, what was read before, with the error."""
    path: list[str] = []
    found = {"root": None}
    locs: list[str] = []
    state = {"entry": False, "text": None, "open": False}

    def start(tag, _):
        path.append(tag.lower())
        if len(path) == 1:
            found["root"] = path[0]
        elif len(path) == 2:
            state["entry"] = True
        elif len(path) == 3 and state["entry"] and path[-1] == "loc":
            state["text"], state["open"] = [], True
        elif len(path) > 3:
            state["open"] = False

    def text(data):
        if state["open"]:
            state["text"].append(data)

    def end(_):
        if len(path) == 3 and state["text"] is not None:
            value = "".join(state["text"]).strip()
            if value:
                locs.append(value)
                state["entry"] = False
            state["text"], state["open"] = None, False
        path.pop()

    empty = {"is_index": False, "locs": []}
    if not body:
        return {**empty, "error": None}
    try:
        xml.walk(_unpacked(body, max_bytes) if isinstance(body, bytes) else body, start, end, text, max_nodes)
    except (xml.Refused, OverflowError) as problem:
        return {"is_index": found["root"] == "sitemapindex", "locs": locs, "error": str(problem)}
    except (expat.ExpatError, zlib.error, ValueError):
        return {**empty, "error": None}
    return {"is_index": found["root"] == "sitemapindex", "locs": locs, "error": None}


def parse_sitemaps(maps: DataFrame, max_bytes: int = L.SITEMAP_UNPACKED_LIMIT, max_nodes: int = xml.MAX_NODES) -> DataFrame:
    """Parse each sitemap file once: (site, url, is_index, locs, error).

    The bounds guard the task that unpacks a file; a file beyond them carries an error.
    """

    @F.pandas_udf(_MAP)
    def parse(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_map(b, max_bytes, max_nodes) for b in bodies], columns=_MAP.fieldNames())

    return maps.select("site", "url", parse(F.col("body")).alias("_m")).select("site", "url", "_m.*")


def _own(url, site):
    own = K.registrable_domain(url)
    return F.lower(url).rlike("^https?://") & (own != "") & (own == K.registrable_domain(site))


def expand_sitemaps(starts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Maps reached from the starting ones: (site, url, depth, foreign, is_index, locs, error).

    An index opens its maps level by level, however many and however deep; a map of another
    registered domain is listed as foreign and not opened. The walk carries addresses only,
    each level one equi-join with the parsed files (store those first) and a lineage cut; it
    ends with the first level that reached nothing new. Lists are joined once at the end.
    """
    links = parsed.where("is_index").select("site", "url", F.explode(F.array_distinct("locs")).alias("next"))
    level, seen, depth = starts.select("site", "url"), None, 0
    while True:
        fresh = level.distinct()
        if seen is not None:
            fresh = fresh.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        fresh = checkpointed(fresh.select("site", "url", F.lit(depth).alias("depth"), (~_own(F.col("url"), F.col("site"))).alias("foreign")))
        if fresh.isEmpty():
            break
        seen = fresh if seen is None else seen.unionByName(fresh)
        level = fresh.where("NOT foreign").join(links, ["site", "url"]).select("site", F.col("next").alias("url"))
        depth += 1
    if seen is None:
        seen = fresh
    reached = seen.join(parsed, ["site", "url"], "left")
    for name, kind in (("is_index", "boolean"), ("locs", "array<string>"), ("error", "string")):
        reached = reached.withColumn(name, F.when(~F.col("foreign"), F.col(name)).cast(kind))
    return reached.select("site", "url", "depth", "foreign", "is_index", "locs", "error")


def sitemap_urls(expanded: DataFrame) -> DataFrame:
    """Page addresses listed in the maps that were read."""
    return expanded.where("NOT foreign AND NOT is_index").select("site", F.explode("locs").alias("url"), F.col("url").alias("map_url"))


# --- llms.txt ------------------------------------------------------------------------


def llms_txt_findings(files: DataFrame) -> DataFrame:
    """Structural findings of llms.txt files: (site, severity, code, url, evidence)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿+", "")
    files = files.select("site", "url", text.alias("text"))
    blank = r"(?U)^\s*$"
    lines = files.select("site", "url", F.posexplode(F.split("text", _LINE_ENDS)).alias("i", "line")).where(~F.col("line").rlike(blank))
    in_file = W.partitionBy("site", "url").orderBy("i")
    line = F.col("line")
    has_link = line.rlike(r"\[[^\]]+\]\([^)\s]+\)")
    item = line.rlike(r"(?U)^\s*[-*+]\s+")
    marked = lines.select(
        "site", "url", "i", "line",
        line.rlike(r"(?U)^#\s+\S").alias("h1"),
        line.rlike(r"(?U)^##\s+\S").alias("h2"),
        line.rlike(r"(?U)^#{3,6}\s+\S").alias("deeper"),
        item.alias("item"), (item & has_link).alias("good"),
        F.row_number().over(in_file).alias("n"),
        F.count_if(line.rlike(r"(?U)^##\s+\S")).over(in_file).alias("section"),
    )
    sections = marked.groupBy("site", "url", "section").agg(
        F.max(F.when(F.col("h2"), F.col("line"))).alias("heading"),
        F.count_if("item").alias("items"),
        F.count_if("good").alias("good"),
        F.min(F.when(F.col("item") & ~F.col("good"), F.struct("i", "line"))).alias("bad"),
        F.min(F.when(F.col("n") == 1, F.struct("line", "h1"))).alias("first"),
        F.min(F.when(F.col("n") == 2, F.col("line"))).alias("second"),
        F.count_if("h1").alias("h1s"),
        F.min(F.when(F.col("deeper") & (F.col("n") > 1), F.struct("i", "line"))).alias("deeper"),
    )
    whole = sections.groupBy("site", "url").agg(
        F.max("section").alias("sections"),
        F.sum(F.when(F.col("section") > 0, F.col("good")).otherwise(0)).alias("links"),
        F.max("first").alias("first"), F.max("second").alias("second"),
        F.sum("h1s").alias("h1s"),
        F.max(F.when(F.col("section") == 0, F.col("deeper"))).alias("deeper"),
    )
    whole = files.select("site", "url").join(whole, ["site", "url"], "left")

    def row(severity, code, evidence):
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), evidence.cast("string").alias("evidence"))

    filled = F.col("first").isNotNull()
    quoted_start = F.coalesce(F.ltrim("second").startswith(">"), F.lit(False))
    file_rules = F.array_compact(
        F.array(
            F.when(~filled, row("major", "llms-txt-empty", F.lit("0 lines"))),
            F.when(filled & ~F.col("first.h1"), row("major", "llms-txt-no-h1", F.col("first.line"))),
            F.when(F.col("h1s") > 1, row("minor", "llms-txt-many-h1", F.col("h1s"))),
            F.when(filled & F.col("first.h1") & ~quoted_start, row("minor", "llms-txt-no-summary", F.coalesce("second", F.lit("")))),
            F.when(F.col("deeper").isNotNull(), row("minor", "llms-txt-heading-before-sections", F.col("deeper.line"))),
            F.when(filled & (F.col("sections") == 0), row("minor", "llms-txt-no-sections", F.lit("0 sections"))),
            F.when(filled & (F.col("sections") > 0) & (F.col("links") == 0), row("major", "llms-txt-no-links", F.lit("0 links"))),
        )
    )
    section_rules = F.array_compact(
        F.array(
            F.when(F.col("bad").isNotNull(), row("minor", "llms-txt-item-without-link", F.col("bad.line"))),
            F.when(F.col("items") == 0, row("minor", "llms-txt-section-without-list", F.col("heading"))),
        )
    )
    return whole.select("site", "url", F.inline(file_rules)).unionByName(
        sections.where("section > 0").select("site", "url", F.inline(section_rules))
    )
