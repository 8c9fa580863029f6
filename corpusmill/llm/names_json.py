"""Names in JSON text, as people left it."""

from __future__ import annotations

import json


def _reject(token: str):
    raise ValueError(token)


def named(text: str | None) -> list[tuple[str, str | None]]:
    """(name, type) of the objects with a text ``name`` in a whole valid JSON array; else none.

    Names are trimmed and their inner white space is made one space; blank names, and names that aren't valid
    Unicode, are dropped. A type that isn't text is null."""
    if not text:
        return []
    try:
        value = json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, list):
        return []
    out = []
    for x in value:
        if isinstance(x, dict) and isinstance(x.get("name"), str):
            name = " ".join(x["name"].split())
            if name and not any("\ud800" <= c <= "\udfff" for c in name):
                kind = x.get("type")
                out.append((name, kind if isinstance(kind, str) and kind.isprintable() else None))
    return out
