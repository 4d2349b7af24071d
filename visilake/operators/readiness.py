"""Readiness of sites for AI answer engines: robot access, llms.txt, structured data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L
from ..sources.sitefiles import llms_txt_findings, robots_rules
from .audit import FINDING, _finding, _rows, severity_rank


def _bots() -> Column:
    return F.array(
        *[F.struct(F.lit(t).alias("bot"), F.lit(o).alias("owner"), F.lit(r).alias("role"), F.lit(s).alias("severity")) for t, o, r, s in L.BOTS]
    )


def _sendable(path: Column) -> Column:
    return K.percent_encode(K.percent_decode(path), K._PATH_KEEP + "?")


def robots_by_site(robots: DataFrame) -> DataFrame:
    """One row per site: its robots groups in file order (as large as the file, no more)."""
    rules = robots_rules(robots)
    groups = rules.groupBy("site", "group_no").agg(
        F.first("agents").alias("agents"),
        F.array_sort(F.collect_list(F.struct("line_no", "kind", _sendable(F.col("path")).alias("path"), "line"))).alias("rules"),
    )
    return groups.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("group_no", "agents", "rules"))).alias("groups"))


def bot_access(robots: DataFrame, paths: DataFrame | None = None, bots: Column | None = None) -> DataFrame:
    """May each AI robot open the root and the sample paths of a site.

    The first group whose token is part of the robot's name decides, else the ``*`` group;
    inside it, the first rule that matches. ``robots``: site, text, optional status;
    ``paths``: site, paths (array).
    """
    status = F.col("status") if "status" in robots.columns else F.lit(200)
    sites = robots.select("site", status.cast("int").alias("status")).join(
        robots_by_site(robots.where(status == 200)), "site", "left"
    )
    if paths is not None:
        sites = sites.join(paths, "site", "left")
        listed = F.coalesce(F.filter("paths", lambda p: p != "/"), F.array().cast("array<string>"))
        sites = sites.withColumn("paths", F.concat(F.array(F.lit("/")), listed))
    else:
        sites = sites.withColumn("paths", F.array(F.lit("/")))
    rows = sites.select("site", "status", "groups", "paths", F.inline(_bots() if bots is None else bots))
    token = F.lower("bot")
    groups = F.coalesce("groups", F.filter("groups", lambda g: F.lit(False)))
    named = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a["agent"] != "*") & F.contains(token, a["agent"])) & ~F.exists(g["agents"], lambda a: a["agent"] == "*"))
    general = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["agent"] == "*"))
    rows = rows.withColumn("group", F.coalesce(F.get(named, F.lit(0)), F.get(general, F.lit(0))))

    def first_rule(path: Column) -> Column:
        sent = _sendable(path)
        return F.get(F.filter("group.rules", lambda r: (r["path"] == "*") | F.startswith(sent, r["path"])), F.lit(0))

    judged = F.transform(
        "paths", lambda p: F.struct(p.alias("path"), first_rule(p).alias("rule"))
    )
    shut = F.filter(judged, lambda j: (j["rule"]["kind"] == "disallow") & (j["rule"]["path"] != ""))
    rows = rows.withColumn("shut", F.when(F.col("status").isin(401, 403), F.transform("paths", lambda p: F.struct(p.alias("path"), F.lit(None).cast("struct<line_no:int,kind:string,path:string,line:string>").alias("rule")))).otherwise(F.coalesce(shut, F.filter(judged, lambda j: F.lit(False)))))
    return rows.select(
        "site", "bot", "owner", "role", "severity",
        (F.size("shut") == 0).alias("allowed"),
        F.transform("shut", lambda s: s["path"]).alias("blocked_paths"),
        F.exists("shut", lambda s: s["path"] == "/").alias("whole_site"),
        F.get("shut", F.lit(0))["rule"]["line_no"].cast("int").alias("line_no"),
        F.get("shut", F.lit(0))["rule"]["line"].alias("line"),
    )


def bot_findings(access: DataFrame) -> DataFrame:
    """One finding per closed robot, as severe as the robot's role."""
    where = F.when(F.col("whole_site"), F.lit("whole site")).otherwise(F.array_join("blocked_paths", ", "))
    return access.where("NOT allowed").select(
        "site", "severity",
        F.concat(F.lit("robots-blocks-"), F.lower("bot")).alias("code"),
        F.concat(F.regexp_replace("site", "/+$", ""), F.lit("/robots.txt")).alias("url"),
        F.concat(F.col("bot"), F.lit(": "), where, F.coalesce(F.concat(F.lit(" by line "), F.col("line_no").cast("string")), F.lit(""))).alias("evidence"),
    )


def _html_like() -> Column:
    head = F.lower(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", ""), 1, 200))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return F.contains(kind, F.lit("text/html")) | F.startswith(head, F.lit("<!doctype html")) | F.startswith(head, F.lit("<html"))


def file_findings(files: DataFrame) -> DataFrame:
    """State of llms.txt, llms-full.txt and robots.txt by answer and content.

    ``files``: site, kind (``llms``, ``llms_full``, ``robots``), url, status, content_type, text.
    """
    found = (F.col("status") == 200) & ~_html_like()
    answer = F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none")))
    kind = F.col("kind")
    status = F.coalesce("status", F.lit(0))
    states = _rows(
        files,
        [
            F.when((kind == "llms") & ~found, F.when(status == 200, _finding("major", "llms-txt-is-html", F.coalesce("content_type", F.lit("")))).otherwise(_finding("major", "llms-txt-missing", answer))),
            F.when((kind == "llms_full") & ~found, _finding("minor", "llms-full-txt-missing", answer)),
            F.when((kind == "robots") & status.isin(401, 403), _finding("critical", "robots-txt-forbidden", answer))
            .when((kind == "robots") & ((status >= 500) | (status == 0)), _finding("major", "robots-txt-unavailable", answer)),
        ],
    )
    return states.unionByName(llms_txt_findings(files.where((kind == "llms") & found)).select(*FINDING))


def page_findings(facts: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """Structured-data and Markdown-version findings of the checked pages.

    ``facts`` comes from ``ai_page_facts`` with a flag ``is_home``; ``alternates`` holds the
    answers of Markdown addresses: url, status, content_type, text.
    """
    home = F.col("is_home")
    answered = F.col("status") == 200
    alternate = F.col("markdown_alternate")
    rows = facts
    if alternates is not None:
        checked = alternates.select(F.col("url").alias("markdown_alternate"), ((F.col("status") == 200) & ~_html_like()).alias("served")).distinct()
        rows = rows.join(checked, "markdown_alternate", "left")
    else:
        rows = rows.withColumn("served", F.lit(None).cast("boolean"))
    types = F.array_join("jsonld_types", ", ")
    organization = F.arrays_overlap(F.coalesce("jsonld_types", F.array().cast("array<string>")), K.strings(L.ORGANIZATION_TYPES))
    own = K.registrable_domain("markdown_alternate") == K.registrable_domain("url")
    single = _rows(
        rows,
        [
            F.when(~F.coalesce(answered, F.lit(False)), F.when(home, _finding("critical", "page-unavailable", F.coalesce("error", F.col("status").cast("string")))).otherwise(_finding("major", "page-unavailable", F.coalesce("error", F.col("status").cast("string"))))),
            F.when(answered & (F.col("jsonld_blocks") == 0), F.when(home, _finding("major", "jsonld-missing", F.lit("0 blocks"))).otherwise(_finding("minor", "jsonld-missing", F.lit("0 blocks")))),
            F.when(answered & home & (F.col("jsonld_blocks") > 0) & ~organization, _finding("minor", "jsonld-no-organization", types)),
            F.when(answered & alternate.isNotNull() & ~own, _finding("minor", "markdown-alternate-foreign", alternate)),
            F.when(answered & alternate.isNotNull() & own & ~F.coalesce("served", F.lit(True)), _finding("major", "markdown-alternate-broken", alternate)),
            F.when(answered & home & alternate.isNull(), _finding("minor", "markdown-alternate-missing", F.lit("0 links"))),
        ],
    )
    invalid = rows.where(answered).select("site", "url", F.explode("jsonld_errors").alias("why"))
    bad_blocks = invalid.select("site", F.lit("major").alias("severity"), F.lit("jsonld-invalid").alias("code"), "url", F.col("why").alias("evidence"))
    faq = rows.groupBy("site").agg(F.max("faq").alias("faq"), F.count(F.lit(1)).alias("n")).where("NOT coalesce(faq, false)").withColumn("url", F.col("site"))
    no_faq = _rows(faq, [_finding("minor", "faq-schema-missing", F.concat(F.lit("0 of "), F.col("n").cast("string")))])
    return reduce(DataFrame.unionByName, [single, bad_blocks, no_faq])


def ai_readiness(facts: DataFrame, files: DataFrame, paths: DataFrame | None = None, alternates: DataFrame | None = None) -> DataFrame:
    """All readiness findings of all sites; order them by severity_rank where they are shown."""
    robots = files.where("kind = 'robots'")
    robots = robots.withColumn("status", F.when((F.col("status") == 200) & _html_like(), 0).otherwise(F.col("status")))
    findings = file_findings(files).unionByName(page_findings(facts, alternates)).unionByName(bot_findings(bot_access(robots, paths)))
    return findings.withColumn("severity_rank", severity_rank())
