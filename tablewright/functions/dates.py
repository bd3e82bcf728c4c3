"""Dates in text: choose one format from a representative value, then parse strictly by it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, as (name, pattern, ISO form or Spark format).
# A ``$``-form is rewritten to ISO text and cast to a zone-free timestamp, so the session time
# zone plays no part; the month-name layouts go through a date format.
DATE_LAYOUTS = [
    ("Y-m-d", r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1-$2-$3"),
    ("Y/m/d", r"(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    ("Y-m", r"(\d{4})-(\d{1,2})", "$1-$2-01"),
    ("m/d/Y", r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    ("d/m/Y", r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$2-$1"),
    ("m-d-Y", r"(\d{1,2})-(\d{1,2})-(\d{4})", "$3-$1-$2"),
    ("d-m-Y", r"(\d{1,2})-(\d{1,2})-(\d{4})", "$3-$2-$1"),
    ("m.d.Y", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$1-$2"),
    ("d.m.Y", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1"),
    ("b d, Y", r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
    ("d b Y", r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"),
    ("B d, Y", r"[A-Z][a-z]{3,8} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    ("d B Y", r"\d{1,2} [A-Z][a-z]{3,8} \d{4}", "d MMMM yyyy"),
    ("m/d/y", r"(\d{1,2})/(\d{1,2})/(\d{2})", "$3-$1-$2"),
    ("d/m/y", r"(\d{1,2})/(\d{1,2})/(\d{2})", "$3-$2-$1"),
    ("m-d-y", r"(\d{1,2})-(\d{1,2})-(\d{2})", "$3-$1-$2"),
    ("d-m-y", r"(\d{1,2})-(\d{1,2})-(\d{2})", "$3-$2-$1"),
    ("m.d.y", r"(\d{1,2})\.(\d{1,2})\.(\d{2})", "$3-$1-$2"),
    ("d.m.y", r"(\d{1,2})\.(\d{1,2})\.(\d{2})", "$3-$2-$1"),
]
# Fixed value: two-digit years from here on are of the last century.
LAST_CENTURY = 69
# Accepted time-of-day endings for the numeric layouts.
TIME_LAYOUTS = [
    ("", ""),
    (" H:M", r"[ ](\d{1,2}:\d{2})"),
    (" H:M:S", r"[ ](\d{1,2}:\d{2}:\d{2})"),
    (" H:M:S.f", r"[ ](\d{1,2}:\d{2}:\d{2}\.\d{1,9})"),
    ("TH:M", r"T(\d{1,2}:\d{2})"),
    ("TH:M:S", r"T(\d{1,2}:\d{2}:\d{2})"),
    ("TH:M:S.f", r"T(\d{1,2}:\d{2}:\d{2}\.\d{1,9})"),
]
# Endings in half days, and what may follow a time of day as its zone.
HALF_DAY_LAYOUTS = [
    (" I:M p", r"[ ]((?:0?[1-9]|1[0-2]):\d{2}) ?[AaPp][Mm]"),
    (" I:M:S p", r"[ ]((?:0?[1-9]|1[0-2]):\d{2}:\d{2}) ?[AaPp][Mm]"),
]
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})"


@dataclass(frozen=True)
class DateFormat:
    """One date layout together with one time-of-day ending."""

    name: str
    pattern: str
    target: str
    short_year: bool = False
    half_days: bool = False

    def parse(self, text: Column) -> Column:
        """TIMESTAMP_NTZ, or NULL where the text is not exactly of this format.

        A zone is read but not applied: the time is the one that the text shows.
        """
        if "$" in self.target:
            iso = F.regexp_replace(text, self.pattern, self.target)
            if self.short_year:
                iso = F.concat(F.when(F.substring(iso, 1, 2) >= str(LAST_CENTURY), F.lit("19")).otherwise(F.lit("20")), iso)
            value = iso.try_cast("timestamp_ntz")
            if self.half_days:
                noon = F.make_dt_interval(F.lit(0), F.lit(12))
                late, twelve = F.lower(text).endswith("pm"), F.hour(value) == 12
                value = F.when(late & ~twelve, value + noon).when(~late & twelve, value - noon).otherwise(value)
        else:
            value = F.try_to_date(text, self.target).cast("timestamp_ntz")
        return F.when(text.rlike(self.pattern), value)


def _formats() -> list[DateFormat]:
    found = []
    for name, pattern, target in DATE_LAYOUTS:
        short = name.endswith("y")
        found.append(DateFormat(name, f"^{pattern}$", target, short))
        if "$" not in target or name == "Y-m":
            continue
        timed = f"{target} ${target.count('$') + 1}"
        for ending, time_pattern in TIME_LAYOUTS[1:]:
            found.append(DateFormat(name + ending, f"^{pattern}{time_pattern}$", timed, short))
            found.append(DateFormat(f"{name}{ending}z", f"^{pattern}{time_pattern}{ZONE}$", timed, short))
        for ending, time_pattern in HALF_DAY_LAYOUTS:
            found.append(DateFormat(name + ending, f"^{pattern}{time_pattern}$", timed, short, True))
    return found


FORMATS = _formats()
SHORTEST = 6  # as in 2024-1
# What every text in any of the formats starts with.
SHAPE = "^(?:" + "|".join(dict.fromkeys(pattern for _, pattern, _ in DATE_LAYOUTS)) + ")"


def format_of(sample: str | None) -> DateFormat | None:
    """The format a value is read by: month first unless its first part cannot be a month."""
    if sample is None:
        return None
    for fmt in FORMATS:
        hit = re.match(fmt.pattern, sample)
        if not hit:
            continue
        if fmt.name[0] == "m" and int(hit.group(1)) > 12:
            continue
        if fmt.name[0] == "d" and hit.groups() and int(hit.group(1)) > 31:
            continue
        return fmt
    return None


def format_named(name: str) -> DateFormat:
    for fmt in FORMATS:
        if fmt.name == name:
            return fmt
    raise ValueError(f"unknown date format {name!r}")


def parse_date(text: Column, name: str) -> Column:
    """Lenient date parse by a format name such as ``Y-m-d`` or ``m/d/Y``."""
    return format_named(name).parse(text)
