"""Column names and spreadsheet-style column letters; small plan-time helpers."""

from __future__ import annotations

import re

# Fixed value: names a reader invents for blank headers.
PLACEHOLDER = re.compile(r"^unnamed[:\s_]\s*\d*", re.IGNORECASE)


def clean_name(raw) -> str:
    """Lower snake case of one header, or of the named levels of one with several; empty when it carries no name."""
    levels = [str(level).strip() for level in raw] if isinstance(raw, tuple) else [str(raw)]
    named = levels if len(levels) == 1 else [level for level in levels if not PLACEHOLDER.match(level)]
    words = re.findall("[a-z0-9]+", " ".join(named).lower())
    name = "_".join(words)
    return "" if words == ["nan"] or PLACEHOLDER.match(name) else name


def clean_names(raw_names) -> list[str]:
    """Cleaned headers, blanks numbered by position and repeats numbered until unique."""
    taken: set[str] = set()
    used: dict[str, int] = {}
    result = []
    for position, raw in enumerate(raw_names):
        stem = clean_name("" if raw is None else raw) or f"col_{position}"
        name = stem
        while name in taken:
            used[stem] = used.get(stem, 0) + 1
            name = f"{stem}_{used[stem]}"
        taken.add(name)
        result.append(name)
    return result


def letters(position: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out = ""
    while position >= 0:
        position, digit = divmod(position, 26)
        out = chr(ord("A") + digit) + out
        position -= 1
    return out


def position(name: str) -> int:
    """The inverse of :func:`letters`."""
    value = 0
    for letter in name.upper():
        value = value * 26 + ord(letter) - ord("A") + 1
    return value - 1
