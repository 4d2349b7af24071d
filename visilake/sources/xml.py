"""Guarded reading of foreign XML inside a task: no DTD, and a bound on nodes that callers can set."""

from __future__ import annotations

from xml.parsers import expat

#: Nodes one document may hold unless the caller says otherwise (fixed value).
MAX_NODES = 500_000


class Refused(ValueError):
    """The document declares a DTD or holds too many nodes."""


def walk(data: str | bytes, start, end, text, max_nodes: int = MAX_NODES) -> None:
    """Feed events of one document to three callbacks; raise on anything unsafe or malformed."""
    body = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
    parser = expat.ParserCreate("utf-8" if isinstance(data, str) else None)
    parser.buffer_text = True
    seen = 0

    def on_start(tag, attributes):
        nonlocal seen
        seen += 1
        if seen > max_nodes:
            raise Refused(f"more than {max_nodes} nodes")
        start(tag.rsplit(":", 1)[-1], attributes)

    def on_doctype(*_):
        raise Refused("html page instead of xml" if b"<!doctype html" in body[:4096].lower() else "dtd declared")

    parser.StartDoctypeDeclHandler = on_doctype
    parser.StartElementHandler = on_start
    parser.EndElementHandler = lambda tag: end(tag.rsplit(":", 1)[-1])
    parser.CharacterDataHandler = text
    parser.Parse(body, True)
