"""Mail and web dates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmeter.functions.text import bound

# One pass over a mail date. Every piece is possessive, so a date is read from
# left to right without going back, and each piece may be missing.
_MAIL_DATE = (
    r"(?s)\A\s*+(?:[A-Za-z]++\s*+,?+\s*+)?+"  # weekday
    r"(?:(?![A-Za-z])[^0-9]*+([0-9]*+)\S*+\s*+|())"  # 1 day, 2 month comes first
    r"(?:(?![0-9])([A-Za-z]{0,3}+)\S*+\s*+)?+"  # 3 month
    r"(?:\2([0-9]++)\S*+\s*+)?+"  # 4 day behind the month
    r"(?:(?=([0-9].:))|([0-9]++)\S*+\s*+|(?![0-9])\S*+\s*+)"  # 5 no year, 6 year
    r"(?:([0-9]++)\s*+(?::\s*+(?:([0-9]++)\s*+(?::\s*+(?:([0-9]++)\S*+\s*+)?+)?+)?+)?+"  # 7 8 9 time
    r"|(?![0-9])\S*+\s*+)"
    r"(?:([+-])([0-9]++)|([A-Za-z].{0,2}))?+.*\z"  # 10 sign, 11 digits, 12 zone name
)
_SEP = "\x01"
_PIECES = _SEP.join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12))

# Military zones in minutes as the mail library reads them; J and Z are UTC.
MILITARY = {
    **{c: -60 * (i + 1) for i, c in enumerate("abcdefghiklm")},
    **{c: 60 * (i + 1) for i, c in enumerate("nopqrstuvwxy")},
}
# Named zones in minutes, by first letter: standard time when the
# second letter is s, else daylight time.
NAMED = {"c": (-360, -300), "e": (-300, -240), "m": (-420, -360), "p": (-480, -420)}


def _month(letters: Column) -> Column:
    """Month by its first letters; unknown ones are January."""
    m = F.lower(letters)
    c, cc = F.substring(m, 1, 1), F.substring(m, 1, 2)
    return (
        F.when(cc == "au", 8)
        .when(c == "a", 4)
        .when(c == "d", 12)
        .when(c == "f", 2)
        .when(m == "jul", 7)
        .when(cc == "ju", 6)
        .when(m == "may", 5)
        .when(c == "m", 3)
        .when(c == "n", 11)
        .when(c == "o", 10)
        .when(c == "s", 9)
        .otherwise(1)
    )


def _zone(sign: Column, digits: Column, name: Column) -> Column:
    offset = digits.try_cast("int")
    minutes = F.floor(offset / 100) * 60 + offset % 100
    z = F.lower(name)
    c, second = F.substring(z, 1, 1), F.substring(z, 2, 1)
    named = F.when((F.char_length(z) >= 2) & c.isin("g", "u"), 0)
    for letter, (standard, daylight) in NAMED.items():
        named = named.when(
            (F.char_length(z) >= 2) & (c == letter), F.when(second == "s", standard).otherwise(daylight)
        )
    military = F.create_map(*[F.lit(x) for kv in MILITARY.items() for x in kv])[c]
    return (
        F.when(sign == "+", minutes)
        .when(sign == "-", -minutes)
        .when(name != "", F.coalesce(named, military, F.lit(0)))
        .otherwise(0)
        .cast("int")
    )


def mail_date(text: Column, now: Column | None = None) -> Column:
    """``struct(ts, zone_min)``: UTC instant and zone; missing parts take their defaults.

    ``now`` gives the year of a date that has none before its time.
    """
    pieces = F.split(F.regexp_replace(text, _MAIL_DATE, _PIECES), _SEP)

    def read(parts: Column) -> Column:
        def part(i: int) -> Column:
            return F.get(parts, F.lit(i))

        def number(c: Column, top: int, low: int, default: int) -> Column:
            n = c.try_cast("int")
            return F.when(n.between(low, top), n).otherwise(default)

        day = number(F.when(part(0) != "", part(0)).otherwise(part(2)), 31, 1, 1)
        raw_year = part(4).try_cast("int")
        this_year = F.year(now) if now is not None else F.lit(1970)
        year = (
            F.when(part(3) != "", this_year)
            .when(part(4) == "", 1970)
            .when(raw_year < 70, raw_year + 2000)
            .when(raw_year < 1000, raw_year + 1900)
            .when(raw_year <= 9999, raw_year)
        )
        # Days and minutes are added to the first of the month, so 31 June is 1 July.
        local = (
            F.unix_date(F.make_date(year, _month(part(1)), F.lit(1))).cast("bigint") * 86400
            + (day - 1) * 86400
            + number(part(5), 23, 0, 0) * 3600
            + number(part(6), 59, 0, 0) * 60
            + number(part(7), 59, 0, 0)
        )
        return bound(
            _zone(part(8), part(9), part(10)),
            lambda zone: F.struct(F.timestamp_seconds(local - zone * 60).alias("ts"), zone.alias("zone_min")),
        )

    # A date is taken apart once; all its numbers come from that.
    return F.when(text.isNotNull(), bound(pieces, read))


# The web date layouts differ in the separator and a leading weekday.
_HTTP_DATE = (
    r"^\s*(?:\S{1,3},\s*)?([0-9]+)(?:/|-|\s+)([A-Z][a-z]{2})(?:/|-|\s+)([0-9]+)\s+([0-9]+):([0-9]+):([0-9]+)"
)
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def http_date(text: Column) -> Column:
    """Epoch seconds of a web date in one of four layouts, else 0."""
    field = [F.regexp_extract(text, _HTTP_DATE, i) for i in range(1, 7)]
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), field[1])
    day, year, hour, minute, second = (field[i].try_cast("int") for i in (0, 2, 3, 4, 5))
    good = (month > 0) & year.between(1971, 9999)
    first = F.make_date(F.when(good, year), F.when(good, month.cast("int")), F.lit(1))
    seconds = (
        F.unix_date(first).cast("bigint") * 86400 + (day - 1) * 86400 + hour * 3600 + minute * 60 + second
    )
    return F.coalesce(F.when(good, seconds), F.lit(0).cast("bigint"))


def local_time(ts: Column, zone_min: Column) -> Column:
    """The instant as a wall clock of its zone."""
    return F.timestamp_seconds(F.unix_seconds(ts) + zone_min * 60)


def week(ts: Column, iso: bool = True) -> Column:
    """ISO week; without ``iso`` the first week of next year counts as 53 in December."""
    w = F.weekofyear(ts)
    return w if iso else F.when((w == 1) & (F.month(ts) == 12), 53).otherwise(w)


def is_leap(ts: Column) -> Column:
    y = F.year(ts)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))
