"""Values of dates, times and intervals that are written in different ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000

# Interval units, their spellings and their microseconds. A month
# counts as 30 days and a year as 12 months, as they do when intervals are
# compared.
INTERVAL_UNITS = (
    ("y yr yrs year years", 360 * 86_400 * SECOND),
    ("mon mons month months", 30 * 86_400 * SECOND),
    ("w week weeks", 7 * 86_400 * SECOND),
    ("d day days", 86_400 * SECOND),
    ("h hr hrs hour hours", 3_600 * SECOND),
    ("m min mins minute minutes", 60 * SECOND),
    ("s sec secs second seconds", SECOND),
    ("ms msec msecs millisecond milliseconds", 1_000),
    ("us usec usecs microsecond microseconds", 1),
)

CLOCK = r"-?\d+:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?"
AMOUNT = r"(-?\d+(?:\.\d+)?)\s*([a-z]+)"


def interval_microseconds(text: Column) -> Column:
    """Length of an interval: ``@ 2 hours 30 minutes``, ``2h 30m``, ``02:30:00``,
    ``1 day 02:00``, with ``ago`` for its negative. NULL if it cannot be read."""
    text = F.lower(F.trim(text))
    clock = F.regexp_extract(text, CLOCK, 0)
    rest = F.regexp_replace(text, CLOCK + r"|\bago\b", " ")
    size = F.create_map(*[F.lit(x) for names, n in INTERVAL_UNITS for name in names.split() for x in (name, n)])
    amounts = F.regexp_extract_all(rest, F.lit(AMOUNT), F.lit(1))
    units = F.regexp_extract_all(rest, F.lit(AMOUNT), F.lit(2))
    parts = F.zip_with(amounts, units, lambda a, u: a.try_cast("decimal(18,6)") * size[u])
    zero = F.lit(0).cast("decimal(38,6)")
    total = F.aggregate(parts, zero, lambda sum_, part: (sum_ + part).cast("decimal(38,6)"))

    fields = F.transform(F.split(F.replace(clock, F.lit("-"), F.lit("")), ":"), lambda f: f.try_cast("decimal(18,6)"))
    seconds = fields[0] * 3_600 + fields[1] * 60 + F.coalesce(F.get(fields, F.lit(2)), F.lit(0))
    signed = F.when(clock.startswith("-"), -seconds).otherwise(seconds) * SECOND
    total = total + F.when(clock != "", signed).otherwise(F.lit(0))
    total = F.when(text.rlike(r"\bago$"), -total).otherwise(total)
    return F.when((clock != "") | (F.size(units) > 0), F.round(total).cast("bigint"))


def time_value(text: Column, declared: str) -> Column:
    """Moment a text stands for, by declared type; NULL if it is none."""
    if declared.startswith("date"):
        return F.to_date(F.try_to_timestamp(text)).cast("timestamp")
    if declared.startswith("timestamp"):
        return F.try_to_timestamp(text)
    return F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), text))
