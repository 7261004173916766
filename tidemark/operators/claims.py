"""Checks of stated figures against persisted results."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

_OPEN = re.compile(r"\b(TODO|TBD|FIXME|XXX)\b|\{\{|\}\}")


def lookup(results: Mapping[str, Any], path: str) -> Any:
    """The value at a dotted path of nested results."""
    at: Any = results
    for part in path.split("."):
        at = at[int(part)] if isinstance(at, (list, tuple)) else at[part]
    return at


def check_claims(results: Mapping[str, Any], claims: Iterable[tuple[str, float, float]]) -> list[dict]:
    """One row per claim (path, stated, tolerance): found value, and whether it
    is within the tolerance. A path that leads nowhere, or to no number, fails."""
    out = []
    for path, stated, tolerance in claims:
        try:
            found = float(lookup(results, path))
        except (KeyError, IndexError, TypeError, ValueError):
            found = None
        out.append({"claim": path, "stated": stated, "found": found, "ok": found is not None and abs(found - stated) <= tolerance})
    return out


def open_places(text: str) -> list[int]:
    """Numbers of the lines that still hold a placeholder."""
    return [i for i, line in enumerate(text.splitlines(), 1) if _OPEN.search(line)]
