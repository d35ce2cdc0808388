"""What a request may hold: a gate over rows of requests, and the same rules for a single one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of ids, and least and most of lengths and numbers.
PATTERNS = {"nbk_id": r"NBK\d+", "passage_id": r"NBK\d+:\d{4}"}
LENGTHS = {"query": (1, 512)}
RANGES = {"limit": (1, 100), "neighbors": (0, 5), "snippet_chars": (80, 800)}


def _fault(field: str, value: Column) -> Column:
    if field in PATTERNS:
        return ~value.rlike(f"^(?:{PATTERNS[field]})\\z")
    return ~F.length(value).between(*LENGTHS[field]) if field in LENGTHS else ~value.between(*RANGES[field])


def faults(requests: DataFrame) -> Column:
    """The names of the fields of a request that are outside their domain, sorted; a field that is null or isn't there wasn't given."""
    fields = sorted(f for f in (*PATTERNS, *LENGTHS, *RANGES) if f in requests.columns)
    found = [F.when(_fault(f, F.col(f)), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def parted(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be answered, and those that can't with their ``faults``."""
    judged = requests.withColumn("faults", faults(requests))
    return judged.filter(F.size("faults") == 0).drop("faults"), judged.filter(F.size("faults") > 0)


def check(**fields) -> None:
    """The same rules for one request; raises ValueError with the fields that are outside their domain."""
    bad = []
    for f, v in fields.items():
        if v is None:
            continue
        if f in PATTERNS:
            fits, domain = isinstance(v, str) and re.fullmatch(PATTERNS[f], v, re.ASCII) is not None, PATTERNS[f]
        elif f in LENGTHS:
            (least, most), n = LENGTHS[f], len(v)
            fits, domain = least <= n <= most, f"{least} to {most} characters"
        elif f in RANGES:
            least, most = RANGES[f]
            fits, domain = least <= v <= most, f"{least} to {most}"
        else:
            raise TypeError(f"no such field: {f}")
        if not fits:
            bad.append(f"{f} ({domain})")
    if bad:
        raise ValueError(f"outside their domain: {', '.join(sorted(bad))}")
