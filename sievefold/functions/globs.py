"""Name patterns with * and ?, translated to expressions that Spark evaluates; none can backtrack far."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.matching import plain_fold
from .fold import fold_text

#: What scans leave out by default.
DEFAULT_EXCLUSIONS = ("~$*", "Thumbs.db", "desktop.ini", ".DS_Store", "$RECYCLE.BIN", "System Volume Information", "*.tmp")


def any_of(conditions: list[Column], otherwise: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(otherwise)


def like(pattern: str) -> str:
    """* and ? as LIKE's % and _, all else literal."""
    return re.sub(r"[\\%_]", lambda m: "\\" + m.group(), pattern).replace("*", "%").replace("?", "_")


def matches_any(value: Column, patterns: list[str], *, when_empty: bool = True) -> Column:
    """Case-insensitive; an empty list of patterns lets everything through."""
    return any_of([value.ilike(like(p)) for p in patterns], when_empty)


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern with a slash is compared with the relative path, another one with the name."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.substring_index(unix, "/", -1)
    return any_of([(unix if "/" in p else name).ilike(like(p)) for p in patterns])


def folded_regex(pattern: str) -> str:
    parts = re.split(r"([*?])", plain_fold(pattern))
    return "".join({"*": ".*", "?": "."}.get(p) or re.sub(r"([^A-Za-z0-9 ])", r"\\\1", p) for p in parts)


def address_excluded(address: Column, patterns: list[str]) -> Column:
    """Accents and case don't count."""
    return any_of([fold_text(address).rlike(f"(?s)^{folded_regex(p)}$") for p in patterns if p.strip()])


def folder_excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the mail folder or one above it matches: plain names at any level, patterns with a slash from the top."""
    rules = [p.strip().replace("\\", "/").strip("/") for p in patterns]
    folded = F.transform(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != ""), lambda s: fold_text(s))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), F.lit("/"))
    # a star may cross separators only where the whole path is compared
    deep = [joined.rlike(f"(?s)^/{folded_regex(r)}/") for r in rules if "/" in r]
    named = "|".join(folded_regex(r) for r in rules if r and "/" not in r)
    plain = [F.exists(folded, lambda s: s.rlike(f"(?s)^(?:{named})$"))] if named else []
    return any_of(deep + plain)


def site_excluded(site: Column, patterns: list[str]) -> Column:
    """A site's pattern covers the sites below it."""
    return any_of([fold_text(site).rlike(f"(?s)^{folded_regex(p)}(/.*)?$") for p in patterns if p.strip()])
