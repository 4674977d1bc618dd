"""All valid readings of a written timestamp, as column expressions."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the months in six languages, in lower case and without accents; abbreviations are their first three letters.
MONTHS = [
    "january enero janvier januar gennaio janeiro ene jan gen jaenner",
    "february febrero fevrier februar febbraio fevereiro feb fev",
    "march marzo mars marz marco maerz mar",
    "april abril avril aprile apr abr avr",
    "may mayo mai maggio maio mag",
    "june junio juin juni giugno junho jun giu",
    "july julio juillet juli luglio julho jul lug juil",
    "august agosto aout aug ago",
    "september septiembre setiembre septembre settembre setembro sep sept set",
    "october octubre octobre oktober ottobre outubro oct okt ott out",
    "november noviembre novembre novembro nov",
    "december diciembre decembre dezember dicembre dezembro dec dic dez",
]
#: Zone abbreviations that stand for one offset, in minutes.
ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])[Mm])?"
_ZONE = r" ?(Z|[A-Z]{3,4}|(?:UTC|GMT)?[+-]\d{2}:?\d{2})?(?:\[([^\]]+)\])?"
#: Shapes: (letter, pattern, order of the parts a, b, year, hour, minute, second, fraction, half of day, zone).
SHAPES = [
    ("I", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_CLOCK}{_ZONE})?$", "$2|$3|$1|$4|$5|$6|$7|$8|$9"),
    ("S", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("D", rf"^(?:\p{{L}}+, ?)?(\d{{1,2}})(?:\. ?|[ -])(?:de )?(\p{{L}}{{3,}})\.?[ -](?:de )?(\d{{4}}|\d{{2}})(?:,? {_CLOCK}{_ZONE})?$", "$2|$1|$3|$4|$5|$6|$7|$8|$9"),
    ("M", rf"^(?:\p{{L}}+ )?(\p{{L}}{{3,}})\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_CLOCK}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("C", r"^(\d{4})(\d{2})(\d{2})(?:_(\d{2})(\d{2})(\d{2}))?$", "$2|$3|$1|$4|$5|$6|||"),
    ("E", r"^(-?\d{9,10})(\d{3})?$", "||||||||$1"),
]

READINGS = "array<struct<format:string,micros:bigint,day:int>>"
_DAY = 86_400_000_000


def valid_zone(name: Column) -> Column:
    """The name if it is a zone known here, else null."""
    return F.when(name.isin(sorted(available_timezones())), name)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def instants(wall: Column, zone: Column) -> Column:
    """The instants, none to two, at which clocks of ``zone`` show ``wall``; both in microseconds, ascending; null where the zone is."""
    shown = lambda micros: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))
    guess = F.array(*[wall - (shown(wall + d) - (wall + d)) for d in (-_DAY, _DAY)])
    return F.when(zone.isNotNull() & wall.isNotNull(), F.array_sort(F.filter(F.array_distinct(guess), lambda u: shown(u) == wall)))


def parts(value: Column) -> Column:
    """array<string>: letter of the shape, month or first number, day or second number, year, hour, minute, second, fraction, half of day, zone; one entry if no shape fits."""
    text = F.trim(F.regexp_replace(value, r"[\s\x{a0}]+", " "))
    for letter, pattern, order in SHAPES:
        text = F.regexp_replace(text, pattern, f"{letter}|{order}")
    return F.split(text, r"\|")


def readings(p: Column, zone: Column, month_first: Column) -> Column:
    """All valid readings of a value's ``parts``: a format, and either an instant (``micros`` UTC) or, for a value without a time, its ``day`` since 1970.

    month_first: whether all-number dates with slashes begin with the month; where it is null both orders are read. A wall time is read in ``zone``; one that
    occurs twice has two readings, one that is skipped, or without a zone, none.
    """
    return F.when(F.size(p) < 10, F.array().cast(READINGS)).otherwise(let(_fields(p), lambda f: _readings(f, zone, month_first)))


def _fields(p: Column) -> Column:
    """The numbers in a value's ``parts``; null where one is missing or out of range."""
    get = lambda i: F.get(p, F.lit(i))
    number = lambda i: get(i).try_cast("int")
    letter, tag = get(0), get(9)
    months = F.create_map(*[x for i, names in enumerate(MONTHS) for n in dict.fromkeys(names.split()) for x in (F.lit(n), F.lit(i + 1))])
    word = F.translate(F.lower(get(1)), "áàâãäéèêíóôõöúûüç", "aaaaaeeeioooouuuc")
    named = F.coalesce(F.try_element_at(months, word), F.try_element_at(months, F.substring(word, 1, 3)))
    raw, hour = number(3), number(4)
    year = F.when(F.length(get(3)) == 2, raw + F.when(raw < 69, 2000).otherwise(1900)).otherwise(raw)
    half = F.upper(get(8))
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(half == "P", 12).otherwise(0))
    minute, second = number(5), F.coalesce(number(6), F.lit(0))
    micro = F.coalesce(F.rpad(F.substring(get(7), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long"))
    clock = F.when((hour <= 23) & (minute <= 59) & (second <= 59), (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + micro)
    shape = r"([+-])(\d{2}):?(\d{2})$"
    shift = F.regexp_extract(tag, shape, 2).try_cast("int") * 60 + F.regexp_extract(tag, shape, 3).try_cast("int")
    zones = F.create_map(*[x for name, m in ZONES.items() for x in (F.lit(name), F.lit(m))])
    sign = F.regexp_extract(tag, shape, 1)
    offset = F.when(tag == "", F.lit(None).cast("int")).when(letter == "E", F.lit(None).cast("int")).when(sign == "-", -shift).when(sign == "+", shift).otherwise(F.try_element_at(zones, tag))
    return F.struct(
        letter.alias("letter"),
        F.when(letter.isin("D", "M"), named).otherwise(number(1)).alias("one"),
        number(2).alias("two"),
        year.alias("year"),
        (get(4) != "").alias("timed"),
        F.when(get(4) != "", clock).alias("clock"),
        (tag != "").alias("zoned"),
        offset.alias("offset"),
        F.when(letter == "E", tag.try_cast("long")).alias("epoch"),
    )


def _readings(f: Column, zone: Column, month_first: Column) -> Column:
    empty = F.array().cast(READINGS)
    year, null = f["year"], F.lit(None)

    def date(month: Column, day: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return F.when((year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= last), F.unix_date(F.make_date(year, month, day)))

    def at(day: Column, name: Column) -> Column:
        as_day = F.array(F.struct(name.alias("format"), null.cast("bigint").alias("micros"), day.alias("day")))
        known = let(day.cast("long") * _DAY + f["clock"], lambda wall: F.when(f["zoned"], F.array(wall - f["offset"].cast("long") * 60_000_000)).otherwise(instants(wall, zone)))
        as_time = F.transform(F.filter(known, lambda u: u.isNotNull()), lambda u: F.struct(name.alias("format"), u.alias("micros"), null.cast("int").alias("day")))
        return F.when(day.isNull(), empty).when(f["timed"], F.coalesce(as_time, empty)).otherwise(as_day)

    dated = lambda month, day, name: let(date(month, day), lambda d: at(d, name))
    mdy = F.when(F.coalesce(month_first, F.lit(True)), dated(f["one"], f["two"], F.lit("S:mdy"))).otherwise(empty)
    dmy = F.when(~F.coalesce(month_first, F.lit(False)), dated(f["two"], f["one"], F.lit("S:dmy"))).otherwise(empty)
    stamp = F.array(F.struct(F.lit("E").alias("format"), (f["epoch"] * 1_000_000).alias("micros"), null.cast("int").alias("day")))
    got = F.when(f["letter"] == "S", F.concat(mdy, dmy)).when(f["letter"] == "E", stamp).otherwise(dated(f["one"], f["two"], f["letter"]))
    return F.coalesce(got, empty)


def utc_form(reading: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of an instant, fractions dropped, or ``YYYY-MM-DD`` of a day; null for a null reading. It doesn't depend on the session's zone."""
    seconds = F.floor(reading["micros"] / 1_000_000)
    day = F.floor(seconds / 86_400)
    rest = (seconds - day * 86_400).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat(F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))
    date = lambda n: F.date_from_unix_date(n.cast("int")).cast("string")
    return F.when(reading["micros"].isNotNull(), F.concat(date(day), clock)).otherwise(date(reading["day"]))
