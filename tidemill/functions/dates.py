"""Dates in texts and due times, as expressions; question ranges, on the driver."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, fold, fold_value, let

FIRST_YEAR, LAST_YEAR = 1900, 2100
_MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}


def _date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


#: The forms of a date, folded, in the order in which they decide: {d}, {m} and {y} are numbers, {n} a month's name.
_FORMS = (
    r"ngay\s*{d}[.\s]*thang\s*{m}[.\s]*nam\s*{y}",
    r"\b{y}-{m}-{d}\b",
    r"\b{d}[/.-]{m}[/.-]{y}\b",
    r"\b(?:thang\s*)?{m}\s*[/-]\s*{y}\b",
    r"\b{d}(?:st|nd|rd|th)?\s+{n}\.?,?\s+{y}\b",
    r"\b{n}\.?\s+(?:{d}(?:st|nd|rd|th)?,?\s+)?{y}\b",
)


def any_date(c: C) -> Column:
    """The first date of the first form that a text holds (`_FORMS`); null if that one is no day of 1900 to 2100.

    A form without a day means the first of its month.  Points between digits are dropped first: OCR leaves them.
    """
    names = "|".join(sorted(_MONTHS, key=len, reverse=True))
    number = F.create_map(*(F.lit(x) for k, v in _MONTHS.items() for x in (k, str(v))))
    parts = {"d": r"(\d{1,2})", "m": r"(\d{1,2})", "y": r"(\d{4})", "n": f"({names})"}

    def decided(t: Column) -> Column:
        out = F.lit(None).cast("date")
        for form in reversed(_FORMS):
            order = re.findall(r"\{([dmyn])\}", form)
            pattern = re.sub(r"\{([dmyn])\}", lambda m: parts[m[1]], form)

            def part(name: str, pattern: str = pattern, order: list[str] = order) -> Column:
                return F.regexp_extract(t, pattern, order.index(name) + 1)

            month = F.try_element_at(number, part("n")) if "n" in order else part("m")
            day = F.coalesce(F.nullif(part("d"), F.lit("")), F.lit("1")) if "d" in order else F.lit("1")
            out = F.when(t.rlike(pattern), _date(part("y"), month, day)).otherwise(out)
        return out

    return let(fold(F.regexp_replace(col(c), r"(\d)\.+(?=\d)", "$1")), decided)


def _month(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


_DAY = r"(\d{1,2})/(\d{1,2})/(\d{4})"
_ROMAN = ("i", "ii", "iii", "iv")


def _day(groups: tuple[str, ...]) -> date | None:
    try:
        return date(int(groups[2]), int(groups[1]), int(groups[0]))
    except ValueError:
        return None


def _quarter(name: str, year: str | None, today: date) -> tuple[date, date] | None:
    q = _ROMAN.index(name) + 1 if name in _ROMAN else int(name)
    if not 1 <= q <= 4:
        return None
    own = int(year) if year else today.year
    return date(own, 3 * q - 2, 1), _month(own, 3 * q)[1]


def _year(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year, 12, 31)


def question_range(text: str, today: date) -> tuple[date | None, date | None]:
    """The closed range of dates that a question asks for; an open end is None.

    Of the forms, the first that holds decides: from a day to a day, a quarter, a month of a year,
    this or last month, this or last year, before or from a day on, a year.  A month needs its year.
    """
    t = fold_value(text)
    last = today.replace(day=1) - timedelta(days=1)
    forms = (
        (rf"\b(?:tu|from) (?:ngay )?{_DAY} (?:den|to) (?:ngay )?{_DAY}", lambda m: (_day(m.groups()[:3]), _day(m.groups()[3:]))),
        (r"\b(?:quy|quarter)\s+(\d|i{1,3}|iv)\b(?:\s*(?:/|nam|of)\s*(\d{4}))?", lambda m: _quarter(m[1], m[2], today)),
        (r"\b(?:thang|month)\s+(\d{1,2})\s*(?:/|nam|of)\s*(\d{4})\b", lambda m: _month(int(m[2]), int(m[1])) if 1 <= int(m[1]) <= 12 else None),
        (r"\b(?:thang nay|this month)\b", lambda m: _month(today.year, today.month)),
        (r"\b(?:thang truoc|last month)\b", lambda m: _month(last.year, last.month)),
        (r"\b(?:nam nay|this year)\b", lambda m: _year(today.year)),
        (r"\b(?:nam (?:ngoai|truoc)|last year)\b", lambda m: _year(today.year - 1)),
        (rf"\b(?:truoc|before)\s+(?:ngay\s+)?{_DAY}", lambda m: (None, _day(m.groups()))),
        (rf"\b(?:sau|tu|ke tu|after|since|from)\s+(?:ngay\s+)?{_DAY}", lambda m: (_day(m.groups()), None)),
        (r"\b(19\d\d|20\d\d)\b", lambda m: _year(int(m[1]))),
    )
    for pattern, made in forms:
        if (m := re.search(pattern, t)) and (out := made(m)):
            return out
    return None, None


#: Weekdays as they are written, folded; Monday is 0.
WEEKDAYS = {
    "thu hai": 0, "thu 2": 0, "t2": 0,
    "thu ba": 1, "thu 3": 1, "t3": 1,
    "thu tu": 2, "thu 4": 2, "t4": 2,
    "thu nam": 3, "thu 5": 3, "t5": 3,
    "thu sau": 4, "thu 6": 4, "t6": 4,
    "thu bay": 5, "thu 7": 5, "t7": 5,
    "chu nhat": 6, "cn": 6,
}
#: Words behind which `mai` is a person's name, folded.
PERSON_CUES = (
    "voi", "gap", "cho", "gui", "goi", "nhan", "hoi", "don", "moi", "cung", "giup",
    "anh", "chi", "em", "ban", "co", "chu", "bac", "ong", "ba", "di", "thay", "sep",
)
WEEK = "week"
#: What phrases say of a day, folded: days from today, or the week; the first that a text holds counts.
DAY_RULES: tuple[tuple[str, int | str], ...] = (
    ("ngay mai|sang mai|chieu mai|toi mai", 1),
    ("hom nay|today|sang nay|trua nay|chieu nay|toi nay|dem nay", 0),
    ("mai", 1),
    ("tuan nay|this week", WEEK),
)
#: A part of the day: the hours that it moves, and by how much; noon is 12 whatever its hour.
HOUR_RULES = {"sang": (0, -1, 0), "trua": (0, 11, None), "chieu": (0, 11, 12), "toi": (0, 11, 12), "dem": (6, 11, 12), "am": (12, 12, -12), "pm": (0, 11, 12)}
#: The parts as they are written; without its accents, evening is the same word as I.
ACCENTED_PARTS = {"sáng": "sang", "trưa": "trua", "chiều": "chieu", "tối": "toi", "đêm": "dem"}


def local_time(now: datetime, zone: str) -> datetime:
    """A time without a zone is UTC."""
    return (now if now.tzinfo else now.replace(tzinfo=UTC)).astimezone(ZoneInfo(zone))


def _among(words: str, text: str) -> str | None:
    found = re.search(rf"\b(?:{words})\b", text)
    return found and found[0]


def _said_day(text: str) -> int | str | None:
    folded = fold_value(text)
    return next((day for words, day in DAY_RULES if _among(words, folded)), None)


def _days(now: datetime, zone: str, first: int, last: int) -> tuple[datetime, datetime]:
    """From the begin of a day to the begin of another, both counted from today."""
    at = local_time(now, zone)
    today = datetime.combine(at.date(), time(), at.tzinfo)
    return today + timedelta(days=first), today + timedelta(days=last)


def calendar_window(text: str, now: datetime, zone: str = "UTC") -> tuple[datetime, datetime]:
    """The half-open window that a question means: tomorrow, today, this week, or the next seven days."""
    said, at = _said_day(text), local_time(now, zone)
    if said is None:
        return at, at + timedelta(days=7)
    first = -at.weekday() if said == WEEK else said
    return _days(now, zone, first, first + (7 if said == WEEK else 1))


def past_window(text: str, now: datetime, zone: str = "UTC", days: int = 14) -> tuple[datetime, datetime]:
    """Yesterday, today until now, or the last days until now."""
    at = local_time(now, zone)
    if _among("hom qua", fold_value(text)):
        return _days(now, zone, -1, 0)
    return (_days(now, zone, 0, 0)[0] if _said_day(text) == 0 else at - timedelta(days=days)), at


def _part_of_day(text: str, folded: str) -> str | None:
    """The part of the day beside an hour or a day, or anywhere with its accents."""
    parts = "|".join(HOUR_RULES)
    beside_hour = re.search(rf"\d\s*(?:h|gio|:)\s*\d*\s*({parts})\b", folded)
    if beside_hour:
        return beside_hour[1]
    written = _among("|".join(ACCENTED_PARTS), text.lower())
    beside_day = re.search(rf"\b({'|'.join(ACCENTED_PARTS.values())}) (?:nay|mai)\b", folded)
    return ACCENTED_PARTS[written] if written else beside_day and beside_day[1]


def _on_clock(hour: int, part: str | None) -> int:
    low, high, move = HOUR_RULES.get(part, (0, -1, 0))
    return hour if not low <= hour <= high else 12 if move is None else hour + move


def event_times(text: str, now: datetime, zone: str = "UTC", minutes: int = 60) -> tuple[datetime, datetime] | None:
    """Begin and end of an event from an hour (`10h30`, `9 gio`, `14:00`), a part of the day and a day; None without an hour.

    The day is the first of those that the text allows (its weekday, its day, or any) on which the hour
    is still to come; a day that was named stays, even if its hour is past.
    """
    folded, at = fold_value(text), local_time(now, zone)
    clock = re.search(r"\b(\d{1,2})\s*(?:h|gio|:)\s*(\d{1,2})?(?!\d)", folded)
    if not clock:
        return None
    hour, minute = _on_clock(int(clock[1]), _part_of_day(text, folded)), int(clock[2] or 0)
    if hour > 23 or minute > 59:
        return None
    weekday, said = _among("|".join(WEEKDAYS), folded), _said_day(text)
    begins = [_days(now, zone, ahead, 0)[0] + timedelta(hours=hour, minutes=minute) for ahead in range(8)]
    if weekday:
        allowed = [b for b in begins if b.weekday() == WEEKDAYS[weekday] and b > at]
    elif said in (0, 1):
        allowed = [begins[said]]
    else:
        allowed = [b for b in begins if b > at]
    return allowed[0], allowed[0] + timedelta(minutes=minutes)


#: Days from today that relative due phrases mean.
DUE_DAYS = {"hom nay": 0, "ngay mai": 1, "mai": 1, "ngay kia": 2}


def _named_day(name: str, today: date) -> date:
    """A relative day, or the next such weekday after today."""
    ahead = DUE_DAYS[name] if name in DUE_DAYS else next(n for n in range(1, 8) if (today.weekday() + n) % 7 == WEEKDAYS[name])
    return today + timedelta(days=ahead)


def _numbered_day(day: str, month: str, year: str | None, today: date) -> date | None:
    """A day of a year, or the next such day."""
    years = [int(year)] if year else [today.year, today.year + 1]
    days = [_day((day, month, str(y))) for y in years]
    return days[0] if year or days[0] is None or days[0] >= today else days[1]


def due_date(text: str, today: date) -> date | None:
    """The date of a task's last due phrase: a day and month (the next such, without a year), a relative day, the next weekday.

    A bare `mai` behind a word that introduces a person is a name.
    """
    folded = fold_value(text)
    names = "|".join(sorted([*DUE_DAYS, *WEEKDAYS], key=len, reverse=True))
    phrases = re.finditer(rf"(?:(?P<before>\w+) )?\b(?P<name>{names})\b|\b(?P<day>\d{{1,2}})[/-](?P<month>\d{{1,2}})(?:[/-](?P<year>\d{{4}}))?\b", folded)
    meant = [m for m in phrases if not (m["name"] == "mai" and m["before"] in PERSON_CUES)]
    if not meant:
        return None
    last = meant[-1]
    return _named_day(last["name"], today) if last["name"] else _numbered_day(last["day"], last["month"], last["year"], today)


def in_zone(c: C, zone: C | str) -> Column:
    """A UTC time as it is shown in a zone (a column or a zone's name)."""
    return F.from_utc_timestamp(col(c), zone)


def briefing_due(start_minute: C, last_run: C, now: C, catch_up_hours: int = 6) -> Column:
    """Not sent today, and the start is past by no more than the catch-up hours."""
    now = col(now)
    minute = F.hour(now) * 60 + F.minute(now)
    fresh = col(last_run).isNull() | (F.to_date(col(last_run)) < F.to_date(now))
    return fresh & (minute >= col(start_minute)) & (minute < col(start_minute) + 60 * catch_up_hours)


def routine_due(start_minute: C, weekdays: C, last_run: C, now: C, window_minutes: int = 120) -> Column:
    """On a chosen weekday (1 Monday to 7), not run today, within the window after its start."""
    now = col(now)
    minute = F.hour(now) * 60 + F.minute(now)
    weekday = F.weekday(now) + 1
    fresh = F.col(last_run).isNull() | (F.to_date(col(last_run)) < F.to_date(now))
    return F.array_contains(col(weekdays), weekday) & fresh & (minute >= col(start_minute)) & (minute < col(start_minute) + window_minutes)


def backoff_seconds(attempts: C, most: int = 300) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(col(attempts), F.lit(8))).cast("int"))
