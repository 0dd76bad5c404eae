"""Checks of what callers pass in."""

from __future__ import annotations

# Page sizes and bulk sizes that callers rely on.
DEFAULT_LIMIT, MAX_LIMIT, MAX_BULK = 8, 50, 1000


def clamp_limit(raw) -> int:
    """Leading whole number of the text, 8 if there is none above 0, 50 at most."""
    import re

    found = re.match(r"\s*([+-]?\d+)", str(raw))
    value = int(found[1]) if found else 0
    return min(value, MAX_LIMIT) if value > 0 else DEFAULT_LIMIT


def bulk_count(raw) -> int:
    try:
        value = float(raw)
    except (TypeError, ValueError):
        value = 0.0
    if value != value or value <= 0 or value != int(value):
        raise ValueError("count must be a positive whole number")
    if value > MAX_BULK:
        raise ValueError(f"count cannot be more than {MAX_BULK}")
    return int(value)


def source_id(raw) -> int:
    text = str(raw)
    if not text.isascii() or not text.isdigit():
        raise ValueError("a source id is a whole number")
    return int(text)
