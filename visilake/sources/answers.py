"""AI answers: raw payloads of five providers to one shape.

Each provider branch is one row-local expression, so parsing needs neither Python nor a
shuffle. A source is ``(url, title, used, hint)``: ``used`` is NULL where the provider
does not tell, ``hint`` names the site behind a redirect address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.keys import let

PROVIDERS = ("yandex", "perplexity", "openai", "gemini", "anthropic")
#: Hosts that hide the real address (fixed values).
REDIRECT_HOSTS = ("vertexaisearch.cloud.google.com",)

SOURCES = "array<struct<url:string,title:string,used:boolean,hint:string>>"
_LINK = "struct<url:string,title:string>"
_RESULT = "struct<id:int,url:string,title:string>"

_YANDEX = (
    "array<struct<message:struct<content:string>,isAnswerRejected:boolean,"
    "sources:array<struct<url:string,title:string,used:boolean>>>>"
)
_PERPLEXITY = (
    f"struct<output:array<struct<type:string,results:array<{_RESULT}>,content:array<struct<text:string>>>>,"
    f"output_text:string,choices:array<struct<message:struct<content:string>>>,"
    f"search_results:array<{_RESULT}>,citations:array<string>>"
)
_OPENAI_ITEM = (
    "struct<type:string,content:array<struct<text:string,annotations:array<struct<type:string,url:string,title:string,"
    f"url_citation:{_LINK}>>>>,action:struct<sources:array<{_LINK}>>>"
)
_OPENAI = f"struct<output:array<{_OPENAI_ITEM}>>"
_GEMINI = (
    "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,"
    "groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string,domain:string>>>,"
    "groundingSupports:array<struct<groundingChunkIndices:array<int>>>>>>>"
)
_ANTHROPIC = (
    "struct<content:array<struct<type:string,text:string,content:string,"
    "citations:array<struct<type:string,url:string,title:string>>>>>"
)


def _list(col: Column, of: str) -> Column:
    return F.coalesce(col, F.array().cast(f"array<{of}>"))


def _source(url: Column, title: Column, used: Column, hint: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce(title, F.lit("")).alias("title"),
        used.cast("boolean").alias("used"),
        (F.lit(None) if hint is None else hint).cast("string").alias("hint"),
    )


def _answer(text: Column, sources: Column, rejected: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(sources, F.array()).cast(SOURCES).alias("sources"),
        F.coalesce(F.lit(False) if rejected is None else rejected, F.lit(False)).alias("rejected"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


def _texts(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), sep)


def _yandex(raw: Column) -> Column:
    def read(answer: Column) -> Column:
        return _answer(
            answer["message"]["content"],
            F.transform(
                _list(answer["sources"], "struct<url:string,title:string,used:boolean>"),
                lambda s: _source(s["url"], s["title"], F.coalesce(s["used"], F.lit(False))),
            ),
            answer["isAnswerRejected"],
        )

    return let(F.try_element_at(F.from_json(raw, _YANDEX), F.lit(-1)), read)


def _perplexity(raw: Column) -> Column:
    def read(p: Column) -> Column:
        output = _list(p["output"], f"struct<type:string,results:array<{_RESULT}>,content:array<struct<text:string>>>")
        said = F.flatten(
            F.transform(F.filter(output, lambda o: o["type"] == "message"), lambda o: _list(o["content"]["text"], "string"))
        )
        agent_text = F.coalesce(F.nullif(_texts(said, "\n"), F.lit("")), p["output_text"])
        agent_found = F.flatten(
            F.transform(F.filter(output, lambda o: o["type"] == "search_results"), lambda o: _list(o["results"], _RESULT))
        )
        chat_text = F.array_join(F.array_compact(_list(p["choices"]["message"]["content"], "string")), "\n")
        listed = _list(p["search_results"], _RESULT)
        extra = F.filter(
            F.transform(
                _list(p["citations"], "string"),
                lambda u, i: F.struct((i + 1).cast("int").alias("id"), u.alias("url"), F.lit("").alias("title")),
            ),
            lambda r: ~F.array_contains(F.transform(listed, lambda k: F.coalesce(k["url"], F.lit(""))), F.coalesce(r["url"], F.lit(""))),
        )
        chat_found = F.transform(
            F.concat(listed, extra),
            lambda r, i: F.struct(F.coalesce(r["id"], (i + 1).cast("int")).alias("id"), r["url"].alias("url"), r["title"].alias("title")),
        )
        by_agent = p["output"].isNotNull()
        return F.struct(
            F.when(by_agent, agent_text).otherwise(chat_text).alias("text"),
            F.when(by_agent, agent_found).otherwise(chat_found).alias("found"),
        )

    def mark(r: Column) -> Column:
        markers = F.transform(
            F.regexp_extract_all(F.coalesce(r["text"], F.lit("")), F.lit(r"\[(?:web:)?(\d+)\]"), F.lit(1)),
            lambda m: m.try_cast("int"),
        )
        return _answer(
            r["text"],
            F.transform(
                r["found"],
                lambda s: _source(
                    s["url"], s["title"],
                    F.when(F.size(markers) > 0, F.coalesce(F.array_contains(markers, s["id"]), F.lit(False))),
                ),
            ),
        )

    return let(let(F.from_json(raw, _PERPLEXITY), read), mark)


def _openai(raw: Column) -> Column:
    items = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, f"array<{_OPENAI_ITEM}>")).otherwise(
        F.from_json(raw, _OPENAI)["output"]
    )

    def read(items: Column) -> Column:
        items = _list(items, _OPENAI_ITEM)
        contents = F.flatten(
            F.transform(
                F.filter(items, lambda o: o["type"] == "message"),
                lambda o: F.coalesce(o["content"], F.filter(o["content"], lambda c: F.lit(False)), F.array().cast(
                    "array<struct<text:string,annotations:array<struct<type:string,url:string,title:string,"
                    f"url_citation:{_LINK}>>>>"
                )),
            )
        )
        notes = F.flatten(
            F.transform(
                contents,
                lambda c: F.transform(
                    F.filter(
                        _list(c["annotations"], f"struct<type:string,url:string,title:string,url_citation:{_LINK}>"),
                        lambda a: a["type"] == "url_citation",
                    ),
                    lambda a: F.struct(
                        F.coalesce(F.when(a["url_citation"].isNotNull(), a["url_citation"]["url"]).otherwise(a["url"]), F.lit("")).alias("url"),
                        F.when(a["url_citation"].isNotNull(), a["url_citation"]["title"]).otherwise(a["title"]).alias("title"),
                    ),
                ),
            )
        )
        consulted = F.flatten(
            F.transform(
                F.filter(items, lambda o: o["type"] == "web_search_call"),
                lambda o: F.filter(_list(o["action"]["sources"], _LINK), lambda s: F.coalesce(s["url"], F.lit("")) != ""),
            )
        )
        cited = F.transform(notes, lambda n: n["url"])
        return _answer(
            _texts(F.transform(contents, lambda c: c["text"]), "\n"),
            F.concat(
                F.transform(notes, lambda n: _source(n["url"], n["title"], F.lit(True))),
                F.transform(
                    F.filter(consulted, lambda s: ~F.array_contains(cited, s["url"])),
                    lambda s: _source(s["url"], s["title"], F.lit(False)),
                ),
            ),
        )

    return let(items, read)


def is_redirect(url: Column) -> Column:
    """The address leads to the site only through the provider."""
    return let(K.host_of(url), is_redirect_host)


def is_redirect_host(host: Column) -> Column:
    """:func:`is_redirect` of a host, as ``host_of`` gives it."""
    hit = F.lit(False)
    for name in REDIRECT_HOSTS:
        hit = hit | (host == name) | F.endswith(host, F.lit("." + name))
    return hit


def looks_like_domain(text: Column) -> Column:
    """A bare domain rather than words."""
    return F.coalesce(F.trim(text).rlike(r"^[^ ./]+(?:\.[^ ./]+)+$"), F.lit(False))


def _gemini(raw: Column) -> Column:
    def read(c: Column) -> Column:
        meta = c["groundingMetadata"]
        supports = meta["groundingSupports"]
        used = F.flatten(F.transform(supports, lambda s: _list(s["groundingChunkIndices"], "int")))

        def source(chunk: Column, i: Column) -> Column:
            web = chunk["web"]
            hint = F.nullif(web["domain"], F.lit(""))
            return _source(
                web["uri"], web["title"],
                F.when(supports.isNotNull(), F.array_contains(used, i)),
                F.coalesce(hint, F.when(is_redirect(web["uri"]) & looks_like_domain(web["title"]), web["title"])),
            )

        return _answer(
            _texts(_list(c["content"]["parts"]["text"], "string"), "\n"),
            F.transform(_list(meta["groundingChunks"], "struct<web:struct<uri:string,title:string,domain:string>>"), source),
        )

    return let(F.get(F.from_json(raw, _GEMINI)["candidates"], F.lit(0)), read)


def _anthropic(raw: Column) -> Column:
    result = "struct<type:string,url:string,title:string>"

    def read(p: Column) -> Column:
        blocks = _list(p["content"], f"struct<type:string,text:string,content:string,citations:array<{result}>>")
        texts = F.filter(blocks, lambda b: b["type"] == "text")
        tools = F.filter(blocks, lambda b: b["type"] == "web_search_tool_result")
        found = F.filter(
            F.flatten(F.transform(
                F.filter(tools, lambda b: F.startswith(F.ltrim(F.coalesce(b["content"], F.lit(""))), F.lit("["))),
                lambda b: _list(F.from_json(b["content"], f"array<{result}>"), result),
            )),
            lambda r: r["type"] == "web_search_result",
        )
        cited = F.filter(
            F.flatten(F.transform(texts, lambda b: _list(b["citations"], result))),
            lambda c: c["type"] == "web_search_result_location",
        )
        failures = F.transform(
            F.filter(tools, lambda b: F.startswith(F.ltrim(F.coalesce(b["content"], F.lit(""))), F.lit("{"))),
            lambda b: F.coalesce(F.get_json_object(b["content"], "$.error_code"), F.lit("search error")),
        )
        link = lambda s: F.coalesce(s["url"], F.lit(""))
        cited_urls, known = F.transform(cited, link), F.transform(found, link)
        return F.struct(
            F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), "").alias("text"),
            F.concat(
                F.transform(found, lambda s: _source(s["url"], s["title"], F.array_contains(cited_urls, link(s)))),
                F.transform(
                    F.filter(cited, lambda s: ~F.array_contains(known, link(s))),
                    lambda s: _source(s["url"], s["title"], F.lit(True)),
                ),
            ).alias("sources"),
            F.array_join(failures, ", ").alias("failures"),
        )

    def finish(r: Column) -> Column:
        return _answer(
            r["text"], r["sources"],
            error=F.when((r["failures"] != "") & (F.size(r["sources"]) == 0), r["failures"]),
        )

    return let(let(F.from_json(raw, _ANTHROPIC), read), finish)


def ai_answers_from_json(raw: DataFrame, payload: str = "raw", provider: str = "provider") -> DataFrame:
    """Answers of all providers: text, ordered sources, refusal flag and error."""
    body, name = F.col(payload), F.col(provider)
    parsed = (
        F.when(name == "yandex", _yandex(body))
        .when(name == "perplexity", _perplexity(body))
        .when(name == "openai", _openai(body))
        .when(name == "gemini", _gemini(body))
        .when(name == "anthropic", _anthropic(body))
    )
    keep = [c for c in raw.columns if c not in (payload, "error")]
    given = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    return raw.select(*keep, given.alias("_given"), parsed.alias("_a")).select(
        *keep, "_a.text", "_a.sources", "_a.rejected", F.coalesce("_given", "_a.error").alias("error")
    )
