"""Reading of timestamps that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts.  A zone is allowed only after a T.
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
_DATE = r"\d{4}-\d{2}-\d{2}"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})"


def parse_timestamp(c: Column, allow_date: bool = True) -> Column:
    """UTC instant of a text in an accepted layout, else NULL."""
    layouts = [f"{_DATE}[T ]{_CLOCK}", f"{_DATE}T{_CLOCK}{_ZONE}"]
    if allow_date:
        layouts.append(_DATE)
    known = c.rlike("^(?:" + "|".join(layouts) + ")$")
    zone = F.regexp_extract(c, r":\d{2}(?:[.,]\d+)?([+-]\d{2}:\d{2})$", 1)
    local = F.regexp_replace(F.regexp_replace(c, r"(?:Z|(?<=:.{2,40})[+-]\d{2}:\d{2})$", ""), ",", ".")
    clock = local.try_cast("timestamp_ntz")
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 5, 2).try_cast("int")
    shift = (hours * 3600 + minutes * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    moved = F.when(zone == "", clock).otherwise(
        F.timestamp_add("SECOND", -shift, clock)
    )
    sane = (zone == "") | ((hours < 24) & (minutes < 60))
    return F.when(known & sane, moved)


def parse_expiry(c: Column) -> Column:
    """As above for the end of an event: no bare dates, whole seconds."""
    moment = parse_timestamp(F.trim(c), allow_date=False)
    return F.date_trunc("second", moment).cast("timestamp_ntz")
