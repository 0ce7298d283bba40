"""Date expressions: RFC-2822 stamps, ISO text, inclusive day bounds.

All are built-in column expressions, so they stay inside whole-stage codegen
and are evaluated in the scan's stage.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC-2822 pieces: "[Day, ]d Mon yyyy HH:MM[:SS] zone"
_DAY_MON_YEAR = r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})"
_TIME = r"[0-9]{4} +([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
_ZONE = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})? +([A-Za-z]+|[+-][0-9]{4})\s*$"
# a time of day that does not exist
_NO_TIME = r"[0-9]{4} +(?:(?:2[4-9]|[3-9][0-9]):|[0-9]{1,2}:[6-9][0-9]|[0-9]{1,2}:[0-9]{2}:[6-9][0-9])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc2822_date(stamp) -> Column:
    """The calendar date written in an RFC-2822 stamp (its own zone), NULL
    when it cannot be read or the time of day does not exist (the reference
    stores ``""``)."""
    s = F.regexp_extract(_col(stamp), _DAY_MON_YEAR, 1)
    return F.when(~_col(stamp).rlike(_NO_TIME), F.try_to_date(F.nullif(s, F.lit("")), "d MMM yyyy"))


# Offsets of the zone names that RFC 2822 mail headers use.
ZONES = {"UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
         "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00",
         "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}


def _zone_suffix(stamp: Column) -> Column:
    """``+hh:mm``; empty for ``-0000``, no zone or an unknown name (a time
    without a zone); NULL for an impossible offset."""
    z = F.upper(F.regexp_extract(stamp, _ZONE, 1))
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return (F.when(z == "-0000", F.lit(""))
            .when(z.rlike("^[+-]([01][0-9]|2[0-3])[0-5][0-9]$"),
                  F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2)))
            .when(z.rlike("^[+-]"), F.lit(None))
            .otherwise(F.coalesce(F.try_element_at(names, z), F.lit(""))))


def rfc2822_iso(stamp) -> Column:
    """ISO-8601 text of an RFC-2822 stamp keeping its own offset,
    ``2007-04-02T19:18:42+00:00`` for GMT; NULL when unreadable or when the
    time of day does not exist."""
    s = _col(stamp)
    d = rfc2822_date(s)
    hh = F.regexp_extract(s, _TIME, 1)
    mm = F.regexp_extract(s, _TIME, 2)
    ss = F.regexp_extract(s, _TIME, 3)
    t = F.concat(F.lpad(hh, 2, "0"), F.lit(":"), mm, F.lit(":"),
                 F.when(ss == "", F.lit("00")).otherwise(ss))
    zone = _zone_suffix(s)
    ok = d.isNotNull() & t.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$") & zone.isNotNull()
    return F.when(ok, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T"), t, zone))


def rfc2822_instant(stamp) -> Column:
    """P2 typed: the instant of an RFC-2822 stamp as a TIMESTAMP (offset applied)."""
    return F.try_to_timestamp(rfc2822_iso(stamp))


def iso_day(ts_text) -> Column:
    """Date part of an ISO timestamp text (first 10 characters)."""
    return F.try_to_date(F.substring(_col(ts_text), 1, 10), "yyyy-MM-dd")


def _as_date(v):
    if v is None or v == "":
        return None
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


def day_bounds(ts, start=None, end=None) -> Column:
    """Inclusive day range on a timestamp column: ``start 00:00 <= ts <
    end + 1 day``; either side may be open. Bounds come from typed dates."""
    c = _col(ts)
    s, e = _as_date(start), _as_date(end)
    cond = F.lit(True)
    if s is not None:
        cond = cond & (c >= F.lit(_dt.datetime.combine(s, _dt.time())))
    if e is not None:
        cond = cond & (c < F.lit(_dt.datetime.combine(e + _dt.timedelta(days=1), _dt.time())))
    return cond


def date_in_range(d, start=None, end=None) -> Column:
    """inclusive date range with the reference's null rule: a missing date
    fails a start bound but passes an end-only bound."""
    c = _col(d)
    s, e = _as_date(start), _as_date(end)
    if s is None and e is None:
        return F.lit(True)
    if s is not None and e is not None:
        return (c >= F.lit(s)) & (c <= F.lit(e))
    if s is not None:
        return c >= F.lit(s)
    return c.isNull() | (c <= F.lit(e))
