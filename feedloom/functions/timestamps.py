"""Time strings of many formats and zones to one UTC instant, in native columns.

An ordered cascade of anchored patterns: the first pattern that matches the whole (folded) string rewrites
it to one canonical list of parts, and only that list is read any further. Nothing is guessed outside the
cascade, so an unreadable string gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.session import SPACE

# Names of months in English, German, French, Spanish and Russian, short and long.
MONTHS = {
    1: "jan january januar jän jänner janv janvier ene enero янв январь января",
    2: "feb february februar févr fév février fevr fev fevrier febrero фев февр февраль февраля",
    3: "mar march mär märz mrz maerz mars marzo мар март марта",
    4: "apr april avr avril abr abril апр апрель апреля",
    5: "may mai mayo май мая",
    6: "jun june juni juin junio июн июнь июня",
    7: "jul july juli juil juillet julio июл июль июля",
    8: "aug august août aout aoû ago agosto авг август августа",
    9: "sep sept september septembre septiembre setiembre сен сент сентябрь сентября",
    10: "oct october okt oktober octobre octubre окт октябрь октября",
    11: "nov november novembre noviembre ноя нояб ноябрь ноября",
    12: "dec december dez dezember déc décembre decembre dic diciembre дек декабрь декабря",
}

# Offsets in minutes of zone names as they are written in mail and feeds.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60,
    "mez": 60, "mesz": 120, "mest": 120, "eet": 120, "eest": 180, "msk": 180, "msd": 240, "sast": 120, "ist": 330,
    "npt": 345, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "brt": -180,
    "art": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_DAY = r"(?:\p{L}{2,14}\.?,? )?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AP = r"(?: ?([ap])\.?m\.?)?"
_ZONE = r"(?: ?((?:utc|gmt)?[+\-−]\d{1,2}(?::?\d{2})?|[a-z]{1,5}))?"

#: (name, pattern, order of the parts year|month|day|hour|minute|second|fraction|half|zone).
CASCADE = [
    ("iso", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:t| |, ?){_TIME}{_AP}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("compact", rf"(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("mail", rf"{_DAY}(\d{{1,2}})\.?[ -](\p{{L}}{{3,12}})\.?,?[ -](\d{{4}}|\d{{2}})(?:,? {_TIME}{_AP}{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("asctime", rf"{_DAY}(\p{{L}}{{3,12}})\.? (\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})", "$8|$1|$2|$3|$4|$5|$6||$7"),
    ("month first", rf"{_DAY}(\p{{L}}{{3,12}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_TIME}{_AP}{_ZONE})?", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("year slash", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:,?[ t]{_TIME}{_AP}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("slash", rf"{_DAY}(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,? {_TIME}{_AP}{_ZONE})?", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("year dot", rf"(\d{{4}})\.(\d{{1,2}})\.(\d{{1,2}})(?:,? {_TIME}{_AP}{_ZONE})?", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("dot", rf"{_DAY}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,? {_TIME}{_AP}{_ZONE})?", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("chinese", rf"(\d{{4}}) ?年 ?(\d{{1,2}}) ?月 ?(\d{{1,2}}) ?[日号]?(?: ?(?:星期|周).)?(?: ?([上下])午)? ?{_TIME}{_ZONE}", "$1|$2|$3|$5|$6|$7|$8|$4|$9"),
    ("chinese date", r"(\d{4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?[日号]?", "$1|$2|$3||||||"),
]


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def fold(c: Column) -> Column:
    """Lower case, one blank for each run of white space, no remark in brackets at the end."""
    c = F.regexp_replace(F.lower(c), rf"{SPACE}+", " ")
    c = F.regexp_replace(c, r" ?[(\[][^()\[\]]*[)\]] ?\z", "")
    return F.trim(c)


def parts(s: Column) -> Column:
    """The canonical list of parts of a folded string, null if no pattern of the cascade matches."""
    out = None
    for _, pattern, order in CASCADE:
        hit, to = s.rlike(rf"\A{pattern}\z"), F.regexp_replace(s, rf"\A{pattern}\z", order)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return F.split(out, r"\|", -1)


def unix_micros(s: Column) -> Column:
    """Plain numbers as Unix times, the unit told by the number of digits before the point."""
    whole = F.regexp_extract(s, r"\A([+-]?)(\d{1,20})(?:\.(\d+))?\z", 2)
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    fraction = F.regexp_extract(s, r"\A[+-]?\d+\.(\d+)\z", 1)
    n, size = whole.try_cast("bigint"), F.length(whole)
    seconds = n * 1000000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint")
    return sign * (F.when(size <= 11, seconds).when(size <= 14, n * 1000).when(size <= 17, n).otherwise(F.floor(n / 1000)))


def offset_minutes(z: Column) -> Column:
    """Minutes east of UTC of a written zone; null if the zone is unknown or impossible."""
    pattern = r"\A(?:utc|gmt)?([+\-−])(\d{1,2}):?(\d{2})?\z"
    h = F.regexp_extract(z, pattern, 2).try_cast("int")
    m = F.coalesce(F.nullif(F.regexp_extract(z, pattern, 3), F.lit("")), F.lit("0")).try_cast("int")
    sign = F.when(F.regexp_extract(z, pattern, 1) == "+", 1).otherwise(-1)
    numeric = F.when((h <= 18) & (m < 60), sign * (h * 60 + m))
    return F.when(z.rlike(pattern), numeric).otherwise(F.try_element_at(_literal_map(ZONES), z))


def _once(value: Column, then) -> Column:
    """then(value), with the value worked out once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _instant(s: Column, p: Column, tz: Column) -> Column:
    part = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    number = lambda i, default=None: (F.coalesce(part(i), F.lit(default)) if default else part(i)).try_cast("int")
    month = {w: n for n, words in MONTHS.items() for w in words.split()}
    year = F.when(F.length(part(0)) == 2, number(0) + 2000).otherwise(number(0))
    hour, half = number(3, "0"), F.translate(part(7), "ap上下", "apap")
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.rpad(F.substring(F.coalesce(part(6), F.lit("0")), 1, 6), 6, "0").try_cast("bigint")
    zone = part(8)
    second = F.when(number(4, "0") < 60, number(5, "0"))
    at = F.unix_micros(
        F.try_make_timestamp(
            year,
            F.coalesce(number(1), F.try_element_at(_literal_map(month), part(1))),
            number(2),
            F.when(hour < 24, hour),
            number(4, "0"),
            F.when(second < 60, second).cast("decimal(8,6)"),
            F.when(zone.isNotNull(), F.lit("UTC")).otherwise(F.coalesce(tz, F.lit("UTC"))),
        )
    )
    east = F.when(zone.isNull(), F.lit(0)).otherwise(offset_minutes(zone))
    return F.when(s.rlike(r"\A[+-]?\d{1,20}(\.\d+)?\z"), unix_micros(s)).otherwise(at - east * F.lit(60000000).cast("bigint") + fraction)


def utc_micros(c: Column, zone: Column) -> Column:
    """The instant of the string `c` in microseconds since 1970-01-01 UTC, or null.

    `zone` has the IANA zone of strings without a written one; null means UTC. A wall time that occurs twice is the
    first; one that a clock change skips is moved on by the length of the gap (the rule of java.time, which
    try_make_timestamp follows). Null, blank, relative and impossible values give null.
    """
    return _once(fold(c), lambda s: _once(parts(s), lambda p: _instant(s, p, zone))).cast("bigint")


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
