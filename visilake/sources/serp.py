"""Result pages: raw XML payloads to documents, pages to snapshots."""

from __future__ import annotations

import re
from functools import reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import keys as K
from ..functions import lists as L
from ..functions.keys import let
from ..session import checkpointed
from . import xml

PAGE_DOC = T.StructType(
    [
        T.StructField("is_wizard", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_hlwords", T.IntegerType()),
        T.StructField("domain_doccount", T.LongType()),
        T.StructField("modtime", T.StringType()),
        T.StructField("passage", T.StringType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("found_all", T.LongType()),
        T.StructField("docs", T.ArrayType(PAGE_DOC)),
    ]
)

_BLOCK = re.compile(L.WIZARD_BLOCK, re.I)


def _whole(text: str | None) -> int:
    return int((text or "").strip() or 0)


class _ResultPage:
    """Collects one result page from parser events."""

    FIELDS = ("url", "domain", "title", "modtime", "passage")

    def __init__(self):
        self.path: list[str] = []
        self.error = self.error_code = None
        self.found = None
        self.docs: list[dict] = []
        self.group = self.doc = None
        self.group_first = 0
        self.capture: list[tuple[int, str, list[str]]] = []

    def _open(self, name):
        self.capture.append((len(self.path), name, []))

    def start(self, tag, attributes):
        parent = self.path[-1] if self.path else None
        self.path.append(tag)
        if tag == "error" and parent == "response" and self.error is None:
            self.error_code = attributes.get("code")
            self._open("error")
        elif tag == "found" and parent == "response" and attributes.get("priority") == "all" and self.found is None:
            self._open("found")
        elif tag == "group" and self.path[-3:-1] == ["results", "grouping"]:
            self.group, self.group_first = {"domain": None, "doccount": None}, len(self.docs)
        elif self.group is not None and parent == "group":
            if tag == "categ" and self.group["domain"] is None:
                self.group["domain"] = attributes.get("name") or ""
            elif tag == "doccount" and self.group["doccount"] is None:
                self._open("doccount")
            elif tag == "doc":
                self.doc = {"hlwords": 0}
        elif self.doc is not None:
            if parent == "doc" and tag in self.FIELDS[:4] and tag not in self.doc:
                self.doc[tag] = ""
                self._open(tag)
            elif parent == "passages" and self.path[-3] == "doc" and tag == "passage" and tag not in self.doc:
                self.doc[tag] = ""
                self._open(tag)
            elif tag == "hlword" and parent == "title" and self.path[-3] == "doc" and self.capture and self.capture[-1][1] == "title":
                self.doc["hlwords"] += 1

    def text(self, data):
        if self.capture:
            for _, _, parts in self.capture:
                parts.append(data)

    def end(self, tag):
        if self.capture and self.capture[-1][0] == len(self.path):
            _, name, parts = self.capture.pop()
            value = "".join(parts).strip()
            if name == "error":
                self.error = value or self.error_code or "unknown error"
            elif name == "found":
                self.found = _whole(value)
            elif name == "doccount":
                self.group["doccount"] = _whole(value)
            else:
                self.doc[name] = value
        self.path.pop()
        if tag == "doc" and self.doc is not None and self.path and self.path[-1] == "group":
            self.docs.append(self.doc)
            self.doc = None
        elif tag == "group" and self.group is not None and self.path[-1:] == ["grouping"]:
            for doc in self.docs[self.group_first:]:
                doc["group"] = self.group
            self.group = None

    def result(self) -> dict:
        if self.error is not None:
            return {"error": self.error, "found_all": 0, "docs": []}
        docs = [
            {
                "is_wizard": bool(_BLOCK.match(d.get("title", ""))),
                "url": d.get("url", ""),
                "domain": d.get("domain") or d["group"]["domain"] or "",
                "title": d.get("title", ""),
                "title_hlwords": d["hlwords"],
                "domain_doccount": d["group"]["doccount"] or 0,
                "modtime": d.get("modtime") or None,
                "passage": d.get("passage") or None,
            }
            for d in self.docs
        ]
        return {"error": None, "found_all": self.found or 0, "docs": docs}


def _read_page(payload: str | None) -> dict:
    page = _ResultPage()
    try:
        xml.walk(payload or "", page.start, page.end, page.text)
        return page.result()
    except (xml.Refused, expat.ExpatError, ValueError) as problem:
        return {"error": f"{type(problem).__name__}: {problem}", "found_all": 0, "docs": []}


#: payloads taken out of a batch at once
PAYLOADS = 500


@F.arrow_udf(PAGE)
def _parse_pages(payloads: pa.Array) -> pa.Array:
    kind = to_arrow_type(PAGE)
    parts = [pa.array([_read_page(p) for p in payloads.slice(at, PAYLOADS).to_pylist()], kind) for at in range(0, len(payloads), PAYLOADS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def serp_docs_from_xml(raw: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Parse raw result pages in parallel; a bad page becomes an error row, never a failed job."""
    parsed = raw.withColumn("_page", _parse_pages(F.col(xml_col))).drop(xml_col)
    return parsed.select(*[c for c in parsed.columns if c != "_page"], "_page.error", "_page.found_all", "_page.docs")


def read_deliveries(raw: DataFrame, n: int, xml_col: str = "xml") -> DataFrame:
    """Pages a depth of ``n`` needs, parsed: of several deliveries of one page the one that counts.

    A good delivery wins over a failed one, then the later one. What was delivered is ranked on
    narrow keys; then the newest delivery of each page is fetched by a semi join and parsed, and only
    pages whose delivery failed have their next one parsed. Deliveries that lose are never parsed, and payloads
    are never sorted. Feed the result to :func:`merge_serp_pages`.
    """
    slot = ["fetch_id", "page_no", "_asked"]
    one = [*slot, "fetched_at", "_print"]
    raw = raw.where(F.col("page_no") < pages_for(n)).withColumns({"_asked": F.xxhash64("query", "region"), "_print": F.xxhash64(xml_col)})
    newest = W.partitionBy(*slot).orderBy(F.desc("fetched_at"), "_print")
    waiting = checkpointed(raw.select(*one).distinct().withColumn("_turn", F.row_number().over(newest)))
    read, turn = [], 1
    while True:
        mine = raw.join(waiting.where(F.col("_turn") == turn).drop("_turn"), one, "left_semi").dropDuplicates(one)
        pages = checkpointed(serp_docs_from_xml(mine, xml_col))
        read.append(pages)
        failed = pages.where("error IS NOT NULL").select(*slot)
        waiting = checkpointed(waiting.where(F.col("_turn") > turn).join(failed, slot, "left_semi"))
        if waiting.isEmpty():
            break
        turn += 1
    good = [pages.where("error IS NULL") for pages in read]
    none = read[0].where("error IS NOT NULL")  # the newest of those that all failed
    for pages in good[1:]:
        none = none.join(pages.select(*slot), slot, "left_anti")
    return reduce(DataFrame.unionByName, [*good, none]).drop("_asked", "_print")


def page_docs(pages: DataFrame) -> DataFrame:
    """Documents of single pages with their own running and organic positions."""
    numbered = _numbered(F.col("docs"))
    keep = [c for c in pages.columns if c not in ("docs", "error", "found_all")]
    return pages.select(*keep, F.inline(numbered))


def pages_for(n: int) -> int:
    """Pages a depth costs."""
    return -(-max(1, int(n)) // L.DOCS_PER_PAGE)


def _numbered(docs: Column) -> Column:
    """Running position, and position among sites only; ``docs`` is worked out once."""
    return let(let(docs, lambda d: F.struct(d.alias("docs"), d["is_wizard"].alias("wizards"))), lambda both: _with_places(both["docs"], both["wizards"]))


def _with_places(docs: Column, wizards: Column) -> Column:
    def number(doc: Column, i: Column) -> Column:
        organic = F.size(F.filter(F.slice(wizards, F.lit(1), i + 1), lambda w: ~w))
        return F.struct(
            (i + 1).cast("int").alias("position"),
            F.when(~doc["is_wizard"], organic).alias("organic_position"),
            *[doc[f].alias(f) for f in ("is_wizard", "url", "domain", "title", "title_hlwords")],
            K.url_depth(doc["url"]).alias("url_depth"),
            *[doc[f].alias(f) for f in ("domain_doccount", "modtime", "passage")],
        )

    return F.transform(docs, number)


def _first_of_each_url(docs: Column) -> Column:
    """A repeated address keeps its slot in the numbering and is listed once.

    ``docs`` and their addresses are worked out once, not once a document.
    """

    def firsts(both: Column) -> Column:
        address = lambda i: F.get(both["addresses"], i)
        return F.filter(both["docs"], lambda d, i: (address(i) == "") | (F.array_position(both["addresses"], address(i)) == i + 1))

    keyed = lambda docs: F.struct(docs.alias("docs"), F.transform(docs, lambda d: K.squeezed(d["url"])).alias("addresses"))
    return let(let(docs, keyed), firsts)


def _page_slots(pages: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """One row per fetch with the needed pages side by side.

    A page slot is a bounded aggregate (at most ``n`` documents), combined before the
    shuffle, so repeated deliveries of one fetch cannot pile up in a task. Of several
    deliveries of a page a good one wins over a failed one, then the later one.
    """
    need = pages_for(n)
    slots = [f"_p{i}" for i in range(need)]
    page = F.struct(
        "error", "found_all",
        F.slice(F.coalesce("docs", F.array().cast(T.ArrayType(PAGE_DOC))), 1, max(1, n)).alias("docs"),
        F.col("fetched_at"),
    )
    newest = F.struct(F.col("error").isNull(), "fetched_at", F.xxhash64("error", "found_all", "docs"))
    return (
        pages.where(F.col("page_no") < need)
        .groupBy("fetch_id", "query", "region")
        .agg(*[F.max_by(F.when(F.col("page_no") == i, page), F.when(F.col("page_no") == i, newest)).alias(s) for i, s in enumerate(slots)]),
        slots,
    )


def _problem(slots: list[str]) -> Column:
    total = len(slots)
    reasons = []
    for i, slot in enumerate(slots):
        where = f"page {i + 1} of {total}: " if total > 1 else ""
        page = F.col(slot)
        reasons.append(
            F.when(page.isNull(), F.lit(where + "not collected")).when(
                page["error"].isNotNull(), F.concat(F.lit(where), page["error"])
            )
        )
    return F.coalesce(*reasons)


def flag_incomplete(pages: DataFrame, n: int) -> DataFrame:
    """Completeness gate: pages a fetch needs, pages it has, and the first problem."""
    slotted, slots = _page_slots(pages, n)
    fine = [(F.col(s).isNotNull() & F.col(s)["error"].isNull()).cast("int") for s in slots]
    return slotted.select(
        "fetch_id", "query", "region",
        F.lit(len(slots)).alias("pages_needed"),
        sum(fine[1:], fine[0]).alias("pages_ok"),
        _problem(slots).alias("error"),
    )


def merge_serp_pages(pages: DataFrame, n: int) -> DataFrame:
    """Stitch the pages of a fetch into one snapshot of depth ``n``.

    Numbering runs through the pages; collection stops at the first missing or failed
    page, which the snapshot then carries as ``error`` next to the documents it has.
    """
    slotted, slots = _page_slots(pages, n)
    fine = [F.col(s).isNotNull() & F.col(s)["error"].isNull() for s in slots]
    usable, so_far = [], F.lit(True)
    for slot, ok in zip(slots, fine):
        so_far = so_far & ok
        usable.append(F.when(so_far, F.col(slot)))
    kept = slotted.withColumn("_pages", F.array_compact(F.array(*usable)))
    depth = max(1, int(n))
    raw_docs = F.slice(F.flatten(F.col("_pages.docs")), 1, depth)
    snapshots = kept.select(
        F.col("fetch_id").alias("snapshot_id"), "query", "region",
        F.coalesce(F.get("_pages", F.lit(0))["fetched_at"], *[F.col(s)["fetched_at"] for s in slots]).alias("fetched_at"),
        F.coalesce(F.array_max(F.col("_pages.found_all")), F.lit(0)).alias("found_all"),
        _problem(slots).alias("error"),
        raw_docs.alias("docs"),
    )
    return snapshots.withColumn("docs", _first_of_each_url(_numbered(F.col("docs"))))


def snapshot_docs(snapshots: DataFrame) -> DataFrame:
    """Documents table of merged snapshots."""
    return snapshots.select("snapshot_id", "query", "region", "fetched_at", "error", F.inline("docs"))
