"""ISO 8601 dates and date-times from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.urls import let


def _clock(prefix: str) -> str:
    """Hours, and in extended or basic form minutes, seconds and their fraction."""
    end = rf"(?:[.,](?<{prefix}f{{0}}>[0-9]+))?"
    extended = rf"(?::(?<{prefix}m1>[0-9]{{2}})(?::(?<{prefix}s1>[0-9]{{2}}){end.format(1)})?)?"
    basic = rf"(?<{prefix}m2>[0-9]{{2}})(?:(?<{prefix}s2>[0-9]{{2}}){end.format(2)})?"
    return rf"(?<{prefix}h>[0-9]{{2}})(?:{basic}|{extended})"


_ISO = (
    r"(?s)^(?<y>[0-9]{4})(?:-(?<mo1>[0-9]{2})-(?<d1>[0-9]{2})|(?<mo2>[0-9]{2})(?<d2>[0-9]{2})"
    r"|-W(?<w1>[0-9]{2})(?:-(?<k1>[0-9]))?|W(?<w2>[0-9]{2})(?<k2>[0-9])?)"
    rf"(?:[^0-9-]{_clock('t')}(?:(?<sign>[+-]){_clock('o')})?)?\z"
)
#: Year, month, day, week, day of the week, time, sign and time of the offset; empty where they are missing.
_PARTS = "${y},${mo1}${mo2},${d1}${d2},${w1}${w2},${k1}${k2}," + ",".join(
    ["${th}", "${tm1}${tm2}", "${ts1}${ts2}", "${tf1}${tf2}", "${sign}", "${oh}", "${om1}${om2}", "${os1}${os2}", "${of1}${of2}"]
)


def _number(part: Column, missing: int | None = 0) -> Column:
    return F.coalesce(F.when(part != "", part.try_cast("int")), F.lit(missing).cast("int"))


def _micros(fraction: Column) -> Column:
    """A fraction of a second, cut to six digits."""
    return F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("int")


def parse_date(text: Column) -> Column:
    """ISO date or date-time as a timestamp, else NULL; without an offset it is UTC.

    Calendar and week dates in extended and basic form, with any one character
    before the time that is no digit or hyphen; the time may end behind the hours,
    minutes or seconds, whose fraction is cut to six digits, and so may the offset.
    """
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    parts = F.split(F.regexp_replace(plain, _ISO, _PARTS), ",")
    return F.when(plain.rlike(_ISO), let(parts, _instant))


def _instant(p: Column) -> Column:
    year, second = _number(p[0]), _number(p[7])
    first = F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(4))
    monday = F.date_sub(first, F.weekday(first))
    week, day = _number(p[3], None), _number(p[4], 1)
    last = F.weekofyear(F.make_date(F.greatest(year, F.lit(1)), F.lit(12), F.lit(28)))
    weekly = F.when(week.between(1, last) & day.between(1, 7), F.date_add(monday, (week - 1) * 7 + day - 1))
    calendar = week.isNull()
    month_of = F.when(calendar, _number(p[1])).otherwise(F.month(weekly))
    day_of = F.when(calendar, _number(p[2])).otherwise(F.dayofmonth(weekly))
    year_of = F.when(calendar, year).otherwise(F.year(weekly))
    whole = F.try_make_timestamp(year_of, month_of, day_of, _number(p[5]), _number(p[6]), second.cast("decimal(16,6)"), F.lit("UTC"))
    away = (_number(p[10]) * 3600 + _number(p[11]) * 60 + _number(p[12])).cast("long")
    shift = F.when(away == 0, 0).otherwise(away * 1_000_000 + _micros(p[13]))  # no whole second away is UTC, as in the standard library
    valid = (year >= 1) & year_of.between(1, 9999) & (second <= 59) & (shift < 86_400_000_000)
    moved = F.unix_micros(whole) + _micros(p[8]) - F.when(p[9] == "-", -shift).otherwise(shift)
    return F.when(valid, F.timestamp_micros(moved))
