"""Durations and moments given as text, on the driver."""

from __future__ import annotations

import re
from datetime import UTC, datetime

UNITS = {"h": 3600, "d": 86_400, "w": 604_800}


def duration_ns(text: str) -> int:
    """`12h`, `30d` or `2w` in nanoseconds."""
    m = re.fullmatch(r"(\d+)([hdw])", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]] * 10**9


def since_ns(text: str | None, now_ns: int) -> int | None:
    """A duration back from now, or an ISO date or time (UTC where it names no zone)."""
    if not text:
        return None
    try:
        return now_ns - duration_ns(text)
    except ValueError:
        t = datetime.fromisoformat(text)
        t = t if t.tzinfo else t.replace(tzinfo=UTC)
        return int(t.timestamp()) * 10**9 + t.microsecond * 1000
