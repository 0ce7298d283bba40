"""Paper-id expressions and the id-pattern rules (P5-P8, F1-F3 helpers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_id(vid) -> Column:
    """P5: drop a trailing version ``v<digits>``; ids without one are unchanged
    (archive names containing ``v``, e.g. ``solv-int/...``, stay whole)."""
    return F.regexp_replace(_col(vid), r"v[0-9]+$", "")


def id_from_url(url, old_ids: bool = False) -> Column:
    """The id named by an abstract URL: its last path segment, or with
    ``old_ids`` everything after ``/abs/`` (keeps ``math/0309136``)."""
    u = _col(url)
    if old_ids:
        return F.regexp_extract(u, r"/abs/(.+)$", 1)
    return F.element_at(F.split(u, "/"), -1)


def with_version(bid, ver: str = "v1") -> Column:
    """Attach a version suffix to a base id."""
    return F.concat(_col(bid), F.lit(ver))


def to_java_regex(pattern: str) -> str:
    """Python-regex spelling -> Java spelling for the few constructs that differ.

    Named groups ``(?P<n>...)`` / ``(?P=n)`` are rewritten; the rest of the
    syntax used for ids is common to both.
    """
    p = re.sub(r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", r"\\k<\1>", p)
    return p


def regex_search(c, pattern: str) -> Column:
    """unanchored search (Python ``re.search``)."""
    return _col(c).rlike(to_java_regex(pattern))


def regex_match(c, pattern: str) -> Column:
    """anchored at the start only (Python ``re.match``)."""
    return _col(c).rlike("^(?:" + to_java_regex(pattern) + ")")


_VER_SUFFIX = re.compile(r"(v\d+)\$?$")


def split_versioned_pattern(pattern: str | None):
    """F3 driver step: ``(base_pattern, version)`` of an id pattern.

    A pattern ending in ``v<digits>`` (optionally followed by ``$``) names a
    version: the base pattern is the pattern without that suffix (and without a
    trailing ``$``). Otherwise the version is ``v1`` and the base pattern is the
    pattern itself. ``None`` means "all ids".
    """
    if not pattern:
        return None, "v1", False
    m = _VER_SUFFIX.search(pattern)
    if m:
        base = pattern[:m.start()].rstrip("$")
        return base, m.group(1), True
    return pattern, "v1", False
