"""The text form of a search, {label="value", ...} |= "text" or |~ "pattern", and its request parameters."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping
from datetime import UTC, datetime

from .search import Query

_TIME = re.compile(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)")


def _unquoted(value: str) -> str:
    return value.strip().strip("\"'")


def conditions(expression: str) -> dict:
    """labels, contains and regex for a Query. All may be left out; of both filters the pattern counts."""
    rest, labels = expression.strip(), {}
    if rest.startswith("{"):
        inside, closed, rest = rest[1:].partition("}")
        if not closed:
            raise ValueError("the selector isn't closed")
        for part in filter(None, map(str.strip, inside.split(","))):
            name, equals, value = part.partition("=")
            if not equals:
                raise ValueError(f"no label and value: {part!r}")
            labels[name.strip()] = _unquoted(value)
    found = {op: _unquoted(rest.partition(op)[2]) for op in ("|~", "|=") if op in rest}
    pattern = found.get("|~", "")
    return {"labels": labels, "regex": pattern, "contains": "" if "|~" in found else found.get("|=", "")}


def time_ns(value: str) -> int | None:
    """Nanoseconds since 1970, or an RFC 3339 time in them; None if blank."""
    value = value.strip()
    if not value:
        return None
    if re.fullmatch(r"[+-]?\d+", value):
        return int(value)
    m = _TIME.fullmatch(value)
    if not m:
        raise ValueError(f"no time: {value!r}")
    whole = datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in 'Zz' else m[4]}")
    return int((whole - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000_000 + int((m[3] or "").ljust(9, "0"))


def request(params: Mapping[str, str], ranged: bool, tenant: str = "", now_ns: int | None = None) -> Query:
    """A Query from `query`, `limit`, `tenant` and `start` and `end`, or for an instant `time` or `end` (a nanosecond to
    each side; now if there is neither). A limit that is no number, or none above 0, is 100."""
    if ranged:
        start, end = (time_ns(params.get(k, "")) for k in ("start", "end"))
        if start is None or end is None:
            raise ValueError("start and end are required")
    else:
        at = time_ns(params.get("time", "").strip() or params.get("end", ""))
        at = (time.time_ns() if now_ns is None else now_ns) if at is None else at
        start, end = at - 1, at + 1
    limit = params.get("limit", "")
    limit = int(limit) if re.fullmatch(r"\+?\d+", limit) else 0
    owner = next((t for t in (tenant, params.get("tenant", "")) if t.strip()), "default")
    return Query(owner, start, end, limit=limit or 100, **conditions(params.get("query", "")))
