"""Date and time expressions. The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.params import LOCAL_ZONE

# ---- fixed values -----------------------------------------------------------
# obsolete zone names of mail dates
ZONE_NAMES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
ZONED_FORMATS = [
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy HH:mm xx",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]xx",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss xx",
]
LOCAL_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "yyyy年M月d日 HH:mm",
    "yyyy年M月d日",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]
SCOPE_DAYS = {"day": 1, "week": 7, "month": 30}
# ---- end of fixed values ----------------------------------------------------


def to_local(instant: Column, zone: str = LOCAL_ZONE, source_zone: Column | None = None) -> Column:
    """Local wall time of an instant, or of a wall time of `source_zone`.

    The result does not depend on the session zone.
    """
    if source_zone is not None:
        return F.convert_timezone(source_zone, F.lit(zone), instant.cast("timestamp_ntz"))
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def parse_local(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """Local wall time of a written date in any of the known forms, else null."""
    bare = F.regexp_replace(F.trim(text), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    named = F.regexp_extract(bare, r"\s([A-Z]{1,3})$", 1)
    offset = F.create_map(*[F.lit(x) for pair in ZONE_NAMES.items() for x in pair])
    numeric = F.when(named != "", F.concat(F.regexp_replace(bare, r"[A-Z]{1,3}$", ""),
                                           F.try_element_at(offset, named))).otherwise(bare)
    zoned = [to_local(F.try_to_timestamp(numeric, F.lit(f)), zone) for f in ZONED_FORMATS]
    local = [F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in LOCAL_FORMATS]
    return F.coalesce(*zoned, *local)


def within_hours(moment: Column, as_of: Column, hours: int = 24) -> Column:
    """Not older than `hours` at `as_of`; later moments pass."""
    return as_of - moment <= F.expr(f"INTERVAL {hours} HOURS")


def on_day(moment: Column, day: Column) -> Column:
    """Half-open day test that keeps pushdown and partition pruning."""
    start = day.cast("date")
    return (moment >= start.cast("timestamp_ntz")) & (moment < F.date_add(start, 1).cast("timestamp_ntz"))


def in_time_window(moment: Column, start: str, end: str) -> Column:
    """HH:mm window with both ends included; it may run over midnight."""
    clock = F.date_format(moment, "HH:mm:ss.SSSSSS")
    low, high = f"{start}:00.000000", f"{end}:00.000000"
    if low <= high:
        return (clock >= low) & (clock <= high)
    return (clock >= low) | (clock <= high)


def scope_start(scope: Column, base: Column) -> Column:
    """First day of a day, week or month range that ends at `base`."""
    back = F.lit(0)
    for name, days in SCOPE_DAYS.items():
        back = F.when(scope == name, days - 1).otherwise(back)
    return F.date_sub(base, back)


def in_scope(moment: Column, scope: Column, base: Column) -> Column:
    first = scope_start(scope, base)
    return (moment >= first.cast("timestamp_ntz")) & (moment < F.date_add(base, 1).cast("timestamp_ntz"))


def trailing_days(moment: Column, as_of: Column, days: int = 7) -> Column:
    return moment >= as_of - F.expr(f"INTERVAL {days} DAYS")


def format_or_empty(moment: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.coalesce(F.date_format(moment, pattern), F.lit(""))
