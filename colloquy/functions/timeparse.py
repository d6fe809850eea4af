"""Time bounds and durations as people write them, to epoch milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timezone, tzinfo

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_FORMATS = ("%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S")
_MOST = (1 << 63) - 1


def parse_duration(text: str) -> int:
    """Milliseconds of ``90s``, ``5m``, ``6h``, ``2d``, ``1w``; a bare number is hours."""
    m = re.fullmatch(r"(\d+)([smhdw]?)", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    ms = int(m[1]) * _UNITS[m[2] or "h"] * 1000
    if ms > _MOST:
        raise ValueError(f"the duration is too long: {text!r}")
    return ms


def parse_bound(text: str, now_ms: int, zone: tzinfo) -> int:
    """A date (local midnight), a local date and time, epoch milliseconds, or a duration ago."""
    text = text.strip()
    for form in ("%Y-%m-%d", *_FORMATS):
        try:
            naive = datetime.strptime(text, form)
        except ValueError:
            continue
        local = naive.replace(tzinfo=zone, fold=0)
        if local.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) != naive:
            raise ValueError(f"no such local time: {text!r}")
        return int(local.timestamp() * 1000)
    if re.fullmatch(r"\d{10,}", text):
        return int(text)
    return now_ms - parse_duration(text)


def fmt_ts(ms, zone: str):
    """A column of milliseconds as local date and time of ``zone``; ``-`` for an unknown time."""
    from pyspark.sql import functions as F

    utc = F.timestamp_millis(ms).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
