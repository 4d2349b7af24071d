"""Crawled pages: HTML to page facts, one parse for the audit and the AI-readiness rules."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import keys as K
from ..functions import lists as L

_S, _I, _A = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
FACTS = T.StructType(
    [
        T.StructField("title", _S),
        T.StructField("description", _S),
        T.StructField("robots_meta", _S),
        T.StructField("canonical", _S),
        T.StructField("og", T.MapType(_S, _S)),
        T.StructField("h1", _A),
        T.StructField("hrefs", _A),
        T.StructField("schema_types", _A),
        T.StructField("word_count", _I),
        T.StructField("images_total", _I),
        T.StructField("images_no_alt", _I),
        T.StructField("jsonld_blocks", _I),
        T.StructField("jsonld_types", _A),
        T.StructField("jsonld_errors", _A),
        T.StructField("microdata_types", _A),
        T.StructField("markdown_alternates", _A),
        T.StructField("parse_error", _S),
    ]
)

_WORDS = re.compile(r"[^\W\d_]+|\d+")
_HOST = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?)([^/?#:]*)")


def _ascii_host(url: str) -> str:
    """The address with its host as browsers send it."""
    if url.isascii():
        return url
    return _HOST.sub(lambda m: m.group(1) + K._idna(m.group(2).lower(), "ascii"), url, count=1)


def _short_type(value: str) -> str:
    return value.strip().rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1]


def _declared_types(node):
    """Every @type text of a JSON-LD tree, in document order."""
    pending = [node]
    while pending:
        item = pending.pop()
        if isinstance(item, dict):
            kinds = item.get("@type")
            for kind in kinds if isinstance(kinds, list) else [kinds]:
                if isinstance(kind, str):
                    yield kind
            pending.extend(reversed([v for v in item.values() if isinstance(v, (dict, list))]))
        elif isinstance(item, list):
            pending.extend(reversed(item))


class _Reader(HTMLParser):
    """Gathers the facts of one page; ``sink`` says where running text goes."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base = url
        self.facts = {f.name: None for f in FACTS}
        self.facts.update(og={}, images_total=0, images_no_alt=0, jsonld_blocks=0)
        for name in ("h1", "hrefs", "schema_types", "jsonld_types", "jsonld_errors", "microdata_types", "markdown_alternates"):
            self.facts[name] = []
        self.hidden = 0
        self.script: list[str] | None = None
        self.script_strict = False
        self.heading: list[str] | None = None
        self.caption: list[str] | None = None
        self.words = 0

    def handle_starttag(self, tag, attrs):
        a = {name.lower(): value or "" for name, value in attrs}
        if "itemtype" in a:
            self._schema(a["itemtype"])
            if a["itemtype"]:
                self.facts["microdata_types"].append(a["itemtype"].rstrip("/").rsplit("/", 1)[-1])
        if tag in L.HIDDEN_TAGS:
            kind = a.get("type", "").lower()
            if tag == "script" and "ld+json" in kind:
                self.script = []
                self.script_strict = kind.split(";")[0].strip() == "application/ld+json"
            self.hidden += 1
            return
        reader = getattr(self, f"_on_{tag}", None)
        if reader:
            reader(a)

    def _on_base(self, a):
        if a.get("href"):
            self.base = self._joined(a["href"])

    def _on_title(self, a):
        if self.caption is None:
            self.caption = []

    def _on_h1(self, a):
        self.heading = []

    def _on_a(self, a):
        target = a.get("href", "").strip()
        if target and not target.startswith("#"):
            self.facts["hrefs"].append(_ascii_host(self._joined(target)))

    def _on_img(self, a):
        self.facts["images_total"] += 1
        self.facts["images_no_alt"] += "alt" not in a

    def _on_link(self, a):
        roles = a.get("rel", "").lower().split()
        if "canonical" in roles and a.get("href"):
            self.facts["canonical"] = _ascii_host(self._joined(a["href"].strip()))
        if "alternate" in roles and a.get("type", "").lower().startswith("text/markdown") and a.get("href"):
            self.facts["markdown_alternates"].append(self._joined(a["href"]))

    def _on_meta(self, a):
        name = (a.get("property") or a.get("name") or "").strip().lower()
        content = a.get("content", "").strip()
        if not (name and content):
            return
        if name.startswith("og:"):
            self.facts["og"].setdefault(name, content)
        elif name == "description":
            self.facts["description"] = self.facts["description"] or content
        elif name in ("robots", "yandex", "googlebot"):
            self.facts["robots_meta"] = "; ".join(filter(None, (self.facts["robots_meta"], content)))

    def _joined(self, target: str) -> str:
        try:
            return urljoin(self.base, target)
        except ValueError:
            return target

    def _schema(self, value: str):
        name = _short_type(value)
        if name and name not in self.facts["schema_types"]:
            self.facts["schema_types"].append(name)

    def handle_endtag(self, tag):
        if tag in L.HIDDEN_TAGS:
            if tag == "script" and self.script is not None:
                self._structured("".join(self.script))
                self.script = None
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            if self.facts["title"] is None:
                self.facts["title"] = text or None
            self.caption = None
        elif tag == "h1" and self.heading is not None:
            self.facts["h1"].append(" ".join(" ".join(self.heading).split()))
            self.heading = None

    def _structured(self, text: str):
        self.facts["jsonld_blocks"] += self.script_strict
        try:
            types = list(_declared_types(json.loads(text)))
        except (ValueError, RecursionError) as problem:
            if self.script_strict:
                self.facts["jsonld_errors"].append(f"{getattr(problem, 'msg', problem)} at {getattr(problem, 'pos', 0)}")
            return
        for kind in types:
            self._schema(kind)
        if self.script_strict:
            self.facts["jsonld_types"].extend(types)

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.hidden:
            return
        elif self.caption is not None:
            self.caption.append(data)
        else:
            if self.heading is not None:
                self.heading.append(data)
            self.words += len(_WORDS.findall(data))


def _read(url: str | None, html: str | None) -> dict:
    reader = _Reader(url or "")
    if html is not None:
        try:
            reader.feed(html)
            reader.close()
        except Exception as problem:  # a broken page is a row with a reason, not a failed job
            empty = _Reader(url or "").facts
            return {**empty, "word_count": 0, "parse_error": f"{type(problem).__name__}: {problem}"}
    return {**reader.facts, "word_count": reader.words}


#: pages whose text and facts are Python objects at a time; the others stay in Arrow buffers
PAGES = 100


@F.arrow_udf(FACTS)
def _page_facts(urls: pa.Array, htmls: pa.Array) -> pa.Array:
    kind = to_arrow_type(FACTS)

    def part(at: int) -> pa.Array:
        pages = zip(urls.slice(at, PAGES).to_pylist(), htmls.slice(at, PAGES).to_pylist(), strict=True)
        return pa.array([f | {"og": [*f["og"].items()]} for f in (_read(u, h) for u, h in pages)], kind)

    parts = [part(at) for at in range(0, len(urls), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def page_facts(crawl: DataFrame) -> DataFrame:
    """One row of facts per crawled page.

    ``crawl``: site (root address), url, status, html; optional redirect_chain,
    content_type, headers (map), link_header, error. Only an HTML answer is parsed; the
    rest keeps its status and reason. Links are normalised, de-duplicated and split into
    internal and external inside the row.
    """
    content_type = F.lower(F.coalesce(_optional(crawl, "content_type", "string"), F.lit("")))
    html_like = (content_type == "") | content_type.rlike("|".join(re.escape(t) for t in L.HTML_TYPES))
    given = _optional(crawl, "error", "string")
    answered = given.isNull() & F.col("status").isNotNull() & (F.col("status") < 400)
    reason = F.coalesce(given, F.when(answered & ~html_like, F.concat(F.lit("not HTML: "), F.substring_index(content_type, ";", 1))))
    headers = _optional(crawl, "headers", "map<string,string>")
    header_robots = F.coalesce(F.try_element_at(headers, F.lit("X-Robots-Tag")), F.try_element_at(headers, F.lit("x-robots-tag")))
    link_header = F.coalesce(F.try_element_at(headers, F.lit("Link")), F.try_element_at(headers, F.lit("link")))
    extra = [c for c in crawl.columns if c not in ("site", "url", "status", "html", "redirect_chain", "content_type", "headers", "error")]

    base = crawl.select(
        *extra,
        "site",
        K.normalize_url("url").alias("url"),
        "status",
        F.coalesce(_optional(crawl, "redirect_chain", "array<string>"), F.array().cast("array<string>")).alias("redirect_chain"),
        reason.alias("error"),
        header_robots.alias("_hr"),
        link_header.alias("_lh"),
        F.when(answered & html_like, F.col("html")).alias("_html"),
    )
    final_url = F.coalesce(F.try_element_at("redirect_chain", F.lit(-1)), F.col("url"))
    read = base.withColumn("_f", _page_facts(final_url, F.col("_html"))).drop("_html")
    links = F.array_distinct(F.transform(F.filter("_f.hrefs", K.crawlable), K.normalize_url))
    header_tail = F.concat(F.lit("X-Robots-Tag: "), F.col("_hr"))
    facts = ("title", "description", "canonical", "og", "h1", "schema_types", "word_count", "images_total",
             "images_no_alt", "jsonld_blocks", "jsonld_types", "jsonld_errors", "microdata_types")
    return (
        read.withColumn("_links", links)
        .select(
            *extra, "site", "url", "status", "redirect_chain",
            F.coalesce("error", "_f.parse_error").alias("error"),
            *[F.col(f"_f.{name}").alias(name) for name in facts],
            F.coalesce(F.char_length("_f.title"), F.lit(0)).alias("title_len"),
            F.coalesce(F.char_length("_f.description"), F.lit(0)).alias("description_len"),
            F.when(F.col("_hr").isNull(), F.col("_f.robots_meta")).otherwise(F.concat_ws("; ", "_f.robots_meta", header_tail)).alias("robots_meta"),
            F.concat("_f.markdown_alternates", markdown_alternates_from_header(F.col("_lh"))).alias("markdown_alternates"),
            F.filter("_links", lambda u: K.same_site(u, F.col("site"))).alias("internal_links"),
            F.filter("_links", lambda u: ~K.same_site(u, F.col("site"))).alias("external_links"),
        )
        .withColumn("page_key", K.dedup_key("url"))
    )


def markdown_alternates_from_header(header: Column) -> Column:
    """Addresses of Markdown versions named in a ``Link`` header."""
    parts = F.split(F.coalesce(header, F.lit("")), ",")
    named = F.filter(
        parts, lambda p: p.rlike(r'(?i)rel="?[^";]*\balternate\b') & F.contains(F.lower(p), F.lit("text/markdown"))
    )
    return F.filter(F.transform(named, lambda p: F.regexp_extract(p, "<([^>]+)>", 1)), lambda u: u != "")


def ai_page_facts(facts: DataFrame) -> DataFrame:
    """The AI-readiness side of the page facts: structured data, FAQ mark, Markdown version."""
    return facts.select(
        "site", "url", "status", "error", "jsonld_blocks",
        F.array_sort(F.array_distinct("jsonld_types")).alias("jsonld_types"),
        "jsonld_errors",
        "microdata_types",
        (F.array_contains("jsonld_types", "FAQPage") | F.array_contains("microdata_types", "FAQPage")).alias("faq"),
        F.get("markdown_alternates", F.lit(0)).alias("markdown_alternate"),
    )
