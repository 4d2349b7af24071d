"""Registered queries: name → (DataFrame builder, SQL twin or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("keys", "pages", "owner", "ranks", "core", "articles", "audit", "answers", "plan")


def registered() -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in import_module(f"{__name__}.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} registered twice")
            found[key] = value
    return found
